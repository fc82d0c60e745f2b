"""Compound files: a small file system of streams inside one file, as Outlook's messages use it."""

from __future__ import annotations

import struct

SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE = 0xFFFFFFFA  # this and above are no sectors


class CompoundError(ValueError):
    pass


class _Sectors:
    """A run of equal sectors and the table that chains them."""

    def __init__(self, data: bytes, size: int, first: int, table: list[int]):
        self.data, self.size, self.first, self.table = data, size, first, table

    def chain(self, at: int, length: int | None = None) -> bytes:
        out, seen = [], 0
        while at < _FREE and (length is None or seen * self.size < length):
            if at >= len(self.table) or seen > len(self.table):
                raise CompoundError("a chain of sectors is broken")
            start = self.first + at * self.size
            out.append(self.data[start : start + self.size])
            at, seen = self.table[at], seen + 1
        whole = b"".join(out)
        return whole if length is None else whole[:length]


def _numbers(raw: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))


def streams(data: bytes) -> dict[str, bytes]:
    """The content of each stream by its path, storages parted by a slash."""
    if not data.startswith(SIGNATURE) or len(data) < 512:
        raise CompoundError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    if not 7 <= shift <= 20 or not 2 <= mini_shift <= shift:
        raise CompoundError("odd sector sizes")
    size = 1 << shift
    directory, _, cutoff, mini_first, _, more, n_more = struct.unpack_from("<7I", data, 48)
    where = _numbers(data[76:512])
    while more < _FREE and n_more:
        block = _numbers(data[(more + 1) * size : (more + 2) * size])
        if not block:
            raise CompoundError("the table of tables is cut off")
        where += block[:-1]
        more, n_more = block[-1], n_more - 1
    table = [x for s in where if s < _FREE for x in _numbers(data[(s + 1) * size : (s + 2) * size])]
    large = _Sectors(data, size, size, table)
    entries = large.chain(directory)
    if len(entries) < 128:
        raise CompoundError("no directory")

    def entry(i: int) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, size)"""
        raw = entries[128 * i : 128 * i + 128]
        if len(raw) < 128:
            raise CompoundError("an entry lies outside the directory")
        n, kind = struct.unpack_from("<HB", raw, 64)
        left, right, child = struct.unpack_from("<3I", raw, 68)
        start, length = struct.unpack_from("<II", raw, 116)
        return raw[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, length

    root = entry(0)
    small = _Sectors(large.chain(root[5], root[6]), 1 << mini_shift, 0, _numbers(large.chain(mini_first)) if mini_first < _FREE else [])
    out, todo, seen = {}, [(root[4], "")], set()
    while todo:
        i, below = todo.pop()
        if i >= _FREE or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, child, start, length = entry(i)
        todo += [(left, below), (right, below)]
        if kind == 1:
            todo.append((child, f"{below}{name}/"))
        elif kind == 2:
            out[below + name] = (small if length < cutoff else large).chain(start, length) if length else b""
    return out
