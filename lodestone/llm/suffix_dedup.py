"""Removal of repeated byte strings by column-wise construction over many windows.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in its own document or another.
Strings that are equal have the same least hash among their ANCHOR-byte substrings, at the same place (the first, in a
tie); so each start of a string is dealt to that anchor, and a run of starts with one anchor is a window of text. Only
windows of equal anchors can share a string, and they share it at the same distance from the anchor.

Windows of one anchor are aligned at it and ordered column by column, from the right: each round inserts one symbol of
every window, orders the suffixes that begin there by that symbol and, among equals, by the round before, and updates
the common prefixes of neighbours (one more for equal symbols, the least on the way to the last window with the symbol
where the neighbour changes; none otherwise). A neighbour with a common prefix of ``length`` is a repeated string. Round
by round only the previous order and prefixes are read, in sequence, for all anchors of a task at once. That is the
collection construction with its rows limited to aligned suffixes: inserted into one transform of everything, each round
would rewrite the transform, once for each byte of the longest document.

Equal windows (of one 128-bit BLAKE2 digest) are a class. It sends two of its occurrences, the first and the last, to the
construction, however many there are, so a passage in a third of all documents is no large group, and it is the bytes of
unlike places that are compared. An anchor with more than GROUP different windows isn't ordered in one task: digests of
its strings are counted instead, in parts that are summed before they are dealt out.

Null text counts as empty; texts under ``length`` bytes lose nothing. Repeated rows are documents of their own: they
share all their strings, so they lose all of them. A row is known by its id and a hash of its id and text. An empty table
gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_batch, stored

#: Bytes of an anchor; different windows of an anchor in one task; windows of a task, on average; starts worked on at once.
ANCHOR, GROUP, TASK, AT_ONCE = 64, 8192, 2048, 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = _powers.get(base, np.ones(1, dtype=np.uint64))
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _powers[base] = out
    return out[:n]


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[data] * _power(_BASE, len(data)), dtype=np.uint64)])
    h = (total[k:] - total[:-k]) * _power(_INVERSE, len(data) - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    x = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    x[:n] = h
    x = x.reshape(-1, w)
    ahead, behind = np.minimum.accumulate(x, axis=1).ravel(), np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def windows(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, its place, first start, one past the last start) of every run of starts with one anchor."""
    out = []
    for at in range(0, len(data) - length + 1, AT_ONCE):
        part = data[at : at + AT_ONCE + length - 1]
        h = rolling(part, ANCHOR)
        least = sliding_least(h, length - ANCHOR + 1)
        new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        values = np.unique(least[new])
        place = np.flatnonzero(np.isin(h, values))
        rank, step = np.searchsorted(values, h[place]), len(h) + 1
        by = rank * step + place
        by.sort()
        # the first place at or after each start that has the start's least hash
        anchor = by[np.searchsorted(by, np.searchsorted(values, least) * step + np.arange(len(least)))] % step
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        out.append((h[anchor[first]], at + anchor[first], at + first, at + np.append(first[1:], len(least))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def repeated(group: np.ndarray, texts: list[bytes], left: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each window (its group, its bytes, the anchor's place in them) the spans of starts, from the anchor, whose string another window of the group has there."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    reach, width = int(left.max(initial=0)), int(left.max(initial=0) + (sizes - left).max(initial=0))
    column = np.full((width, n), 256, dtype=np.int16)
    for i, t in enumerate(texts):
        column[reach - left[i] : reach - left[i] + sizes[i], i] = np.frombuffer(t, dtype=np.uint8)
    order = np.argsort(group, kind="stable")
    rank = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]]))  # stays: rows move within their group alone
    base, common = rank * 512, np.zeros(n, dtype=np.int64)
    marks = np.zeros((max(0, width - length) + 1, n), dtype=bool)
    for c in range(width - 1, -1, -1):
        key = base + column[c, order]
        if (key[1:] >= key[:-1]).all():
            same = key[1:] == key[:-1]
            common[1:] = np.where(same, common[1:] + 1, 0)
        else:
            move = np.argsort(key, kind="stable")
            key = key[move]
            same, before, now = key[1:] == key[:-1], move[:-1], move[1:]
            fresh = np.zeros(n, dtype=np.int64)
            fresh[1:] = np.where(same, common[now] + 1, 0)
            far = np.flatnonzero(same & (now != before + 1))
            if len(far):
                ends = np.stack([before[far] + 1, now[far] + 1], axis=1).ravel()
                fresh[1 + far] = np.minimum.reduceat(np.append(common, 0), ends)[::2] + 1
            order, common = order[move], fresh
        if c <= width - length:
            hit = common >= length
            hit[:-1] |= hit[1:]
            marks[c, order] = hit
    out = []
    for i in range(n):
        own = marks[reach - left[i] : reach - left[i] + sizes[i] - length + 1, i]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        out.append([(int(a) - int(left[i]), int(b) - int(left[i])) for a, b in edge.reshape(-1, 2)])
    return out


SPANS = "array<struct<a: int, b: int>>"


def _occurrences(rows: dict, length: int) -> dict:
    out: dict[str, list] = {k: [] for k in ("anchor", "window", "check", "row", "print", "pos", "back", "size")}
    for row, print_, text in zip(rows["row"], rows["print"], rows["text"], strict=True):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) < length:
            continue
        h, place, first, last = windows(np.frombuffer(raw, dtype=np.uint8), length)
        back, size = place - first, last - first + length - 1
        digests = b"".join([hashlib.blake2b(raw[a : a + s], digest_size=16, salt=b.to_bytes(4, "little")).digest() for a, s, b in zip(first.tolist(), size.tolist(), back.tolist(), strict=True)])
        window, check = np.frombuffer(digests, dtype="<i8").reshape(-1, 2).T
        for k, v in zip(out, (h.view(np.int64), window, check, np.full(len(h), row, dtype=np.int64), np.full(len(h), print_, dtype=np.int64), place, back, size), strict=True):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in out.items()}


def spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, removed): rows has row, print, id, text; removed has row, print and the covered spans [a, b) of its bytes, not merged."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("row"), F.xxhash64("id", "text").alias("print"), "id", "text")
    found = per_batch(rows.select("row", "print", "text"), "anchor long, window long, check long, row long, print long, pos int, back int, size int", lambda r: _occurrences(r, length))
    found = stored(found)
    several = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    found = stored(found.join(stored(several), "anchor"))
    place = F.struct("row", "print", "pos", "back", "size")
    classes = found.groupBy("anchor", "window", "check").agg(F.min(place).alias("one"), F.max(place).alias("other"), F.count("*").alias("n"))
    classes = stored(classes.select("anchor", "window", "check", F.when(F.col("n") > 1, F.array("one", "other")).otherwise(F.array("one")).alias("places")))
    crowded = classes.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > GROUP).select("anchor", F.lit(True).alias("crowded"))

    # the bytes of one occurrence of each window, or of two
    asked = classes.join(stored(crowded), "anchor", "left").select("anchor", "window", "check", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.posexplode("places").alias("copy", "at"))
    asked = asked.select("at.row", "at.print", F.struct("anchor", "window", "check", "copy", "crowded", "at.pos", "at.back", "at.size").alias("asked"))
    asked = asked.groupBy("row", "print").agg(F.collect_list("asked").alias("asked"))

    def cut_out(r: dict) -> dict:
        names = ("anchor", "window", "check", "copy", "crowded", "back")
        out: dict[str, list] = {k: [] for k in (*names, "bytes")}
        for text, asked_ in zip(r["text"], r["asked"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for x in asked_:
                for name in names:
                    out[name].append(x[name])
                a = x["pos"] - x["back"]
                out["bytes"].append(raw[a : a + x["size"]])
        return out

    texts = rows.select("row", "print", "text").join(asked, ["row", "print"])
    cuts = stored(per_batch(texts, "anchor long, window long, check long, copy int, crowded boolean, back int, bytes binary", cut_out).dropDuplicates(["window", "check", "copy"]))
    tasks = max(1, -(-cuts.count() // TASK))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        group = np.unique(np.asarray(t["anchor"]), return_inverse=True)[1]
        got = repeated(group, t["bytes"].to_pylist(), np.asarray(t["back"], dtype=np.int64), length)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        out = pa.table([t["window"], t["check"], pa.chunked_array([pa.array([[{"a": a, "b": b} for a, b in x] for x in got], kind)])], names=["window", "check", "spans"])
        yield from out.filter(pa.array([bool(x) and not copy for x, copy in zip(got, t["copy"].to_pylist(), strict=True)], pa.bool_())).combine_chunks().to_batches()

    task = F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task")
    ordered = cuts.filter("NOT crowded").groupBy(task).applyInArrow(order, f"window long, check long, spans {SPANS}")

    def strings(r: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("window", "check", "copy", "at", "string")}
        for window, check, copy, back, raw in zip(r["window"], r["check"], r["copy"], r["back"], r["bytes"], strict=True):
            for i in range(len(raw) - length + 1):
                for name, v in zip(out, (window, check, copy, i - back, xxhash.xxh3_128_digest(raw[i : i + length])), strict=True):
                    out[name].append(v)
        return out

    many = per_batch(cuts.filter("crowded").drop("anchor", "crowded"), "window long, check long, copy int, at int, string binary", strings)
    twice = many.groupBy("at", "string").agg(F.count("*").alias("n")).filter("n > 1").select("at", "string")
    counted = many.filter("copy = 0").join(twice, ["at", "string"]).groupBy("window", "check").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))

    gone = stored(ordered.unionByName(counted))
    covered = F.transform("spans", lambda s: F.struct((F.col("pos") + s["a"]).alias("a"), (F.col("pos") + s["b"] + length - 1).alias("b")))
    removed = found.join(gone, ["window", "check"]).select("row", "print", covered.alias("covered"))
    return rows, removed.groupBy("row", "print").agg(F.flatten(F.collect_list("covered")).alias("covered"))


def merged(covered: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in covered or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(raw)], strict=True))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining bytes), text (these bytes as text, U+FFFD where a character lost some of its own)."""

    def f(r: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept", "text")}
        for i, text, covered in zip(r["id"], r["text"], r["covered"], strict=True):
            raw, runs = (text or "").encode("utf-8", "surrogatepass"), merged(covered)
            kept = without(raw, runs)
            for name, v in zip(out, (i, len(raw), sum(b - a for a, b in runs), len(runs), kept, kept.decode("utf-8", "replace")), strict=True):
                out[name].append(v)
        return out

    rows, removed = spans(docs, length, id_col, text_col)
    out = per_batch(rows.join(stored(removed), ["row", "print"], "left").select("id", "text", "covered"), "id long, n_bytes long, n_removed long, n_spans long, kept binary, text string", f)
    return out.withColumnRenamed("id", id_col)

