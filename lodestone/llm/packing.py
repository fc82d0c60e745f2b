"""Packing of tokenised documents into sequences, best fit decreasing.

A document is its ids and an end id. One longer than the window is first cut into full windows; what remains, at most a
window, goes whole into the sequence with the least room that still holds it. The open sequences stand in the leaves of
a segment tree by their remaining capacity, so the tightest is found in logarithmic time. Sequences that end up with
much room are then opened again: their pieces, cut where it helps, fill the room of the others.

Pieces are dealt to shards of a fixed mean size by a hash of document and position, and each shard packs on its own, so
a shard needs bounded memory and padding is a few sequences a shard, at any size of the input. Null text counts as
empty: its document is its end id alone. Documents of equal id are cut alike and packed apart; ties in length go by id,
then start. An empty table packs into nothing. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoder, little
from lodestone.llm.common import per_batch, trim

#: Pieces of a shard, on average.
SHARD = 8192
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class Rooms:
    """A segment tree over remaining capacities: which leaf at or right of one has an open sequence."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)  # open sequences below each node
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.any[at] += n
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest open sequence with room for length, taken out; None if there is none."""
        at = length + self.size
        while not self.any[at]:  # up to the first node whose right neighbour has one
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The sequence of each length, which come in decreasing order, and the room left in each sequence."""
    rooms, left, out = Rooms(capacity), [], []
    for n in lengths:
        room, sequence = rooms.take(n) or (capacity, len(left))
        if sequence == len(left):
            left.append(capacity)
        left[sequence] = room - n
        out.append(sequence)
        if left[sequence]:
            rooms.put(left[sequence], sequence)
    return out, left


def pack_shard(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, from, to, sequence) for lengths in decreasing order, in the order in which they stand in their sequences."""
    where, left = best_fit(lengths, capacity)
    total, last = sum(left), len(left)
    # as many of the emptiest sequences as the others' room can hold are dissolved
    emptiest, dissolved = sorted((s for s in range(last) if left[s]), key=lambda s: (-left[s], s)), set()
    for s in emptiest:
        if total - left[s] < capacity - left[s]:
            break
        total -= left[s] + (capacity - left[s])
        dissolved.add(s)
    out = [(i, 0, n, s) for i, (n, s) in enumerate(zip(lengths, where, strict=True)) if s not in dissolved]
    gaps = [s for s in emptiest if s not in dissolved]
    for i, n in enumerate(lengths):
        at = 0
        while where[i] in dissolved and at < n:
            s = gaps[-1]
            to = min(n, at + left[s])
            out.append((i, at, to, s))
            left[s] -= to - at
            at = to
            if not left[s]:
                gaps.pop()
    return out


def windows(docs: DataFrame, path: str, end: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: full windows, then the rest."""
    names = ("doc_id", "start", "length", "ids", "doc_tokens")

    def f(rows: dict) -> dict:
        out: dict[str, list] = {k: [] for k in names}
        for i, ids in zip(rows["id"], encoder(path, direct=True).encode_many(rows["text"]), strict=True):
            ids += little([end])
            n = len(ids) // 4
            for at in range(0, n, window):
                for k, v in zip(out, (i, at, min(window, n - at), ids[4 * at : 4 * (at + window)], n), strict=True):
                    out[k].append(v)
        return out

    return per_batch(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), PIECES, f)


def pack(docs: DataFrame, path: str, end: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: each piece with its ids and its place."""
    # a document has at most one piece more than its bytes fill windows, so shards keep their mean size without a count of pieces
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col)))).first()
    return place(windows(docs, path, end, window, id_col, text_col), window, -(-(rows + (size or 0) // window) // SHARD))


def place(pieces: DataFrame, window: int, shards: int) -> DataFrame:
    """pieces with sequence_id and offset, packed in so many shards; a piece that is cut here is cut with its ids."""
    shards, fields = max(1, shards), pieces.columns

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).select(fields).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        placed, used, offsets = pack_shard(t["length"].to_pylist(), window), {}, []
        for _, a, b, s in placed:
            offsets.append(used.get(s, 0))
            used[s] = offsets[-1] + b - a
        i, a, b, s = (np.array([x[k] for x in placed], dtype=np.int64) for k in range(4))
        out, own = t.take(i), t["ids"].to_pylist()
        for name, values in (("start", np.asarray(out["start"]) + a), ("length", b - a), ("ids", pa.array([own[p][4 * x : 4 * y] for p, x, y, _ in placed], pa.binary()))):
            out = out.set_column(fields.index(name), name, pa.chunked_array([values]))
        out = out.append_column("sequence_id", pa.chunked_array([(key[0].as_py() << 32) + s])).append_column("offset", pa.chunked_array([np.array(offsets, dtype=np.int64)]))
        yield from out.combine_chunks().to_batches(max_chunksize=4096)
        del t, out, own
        trim()

    shard = F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).alias("shard")
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return pieces.groupBy(shard).applyInArrow(run, schema + ", sequence_id long, offset long")


def pack_digests(docs: DataFrame, path: str, end: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of pack(), with the CRC-32 of each piece's ids in their stead."""
    packed = pack(docs, path, end, window, id_col, text_col)
    return packed.select(*(F.crc32("ids").alias("ids_crc32") if n == "ids" else n for n in packed.columns))


def sequences(packed: DataFrame, window: int = 2048, pad: int = 0) -> DataFrame:
    """sequence_id, ids: each sequence's pieces in place, padded to the window; a sequence has at most a window of ids, so a group is bounded."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return joined.select("sequence_id", F.rpad(ids, 4 * window, little([pad])).alias("ids"))


__all__ = ["Rooms", "best_fit", "pack", "pack_digests", "pack_shard", "place", "sequences", "windows"]
