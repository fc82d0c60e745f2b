"""Language-model scores by prediction by partial matching over a byte-context trie.

Text is its words ([^\\x20\\x09-\\x0D]+, A-Z in lower case) joined by one space, then one end symbol. The trie has every
context of up to ``order`` bytes of all training texts, with no bound on their number. A symbol is coded in the longest
context seen; unseen there, an escape is coded with the share U/2T (U distinct symbols, T occurrences; a symbol seen n
times has (2n-1)/2T) and the next shorter context tries, without the symbols that the longer one has excluded. As a
longer context's symbols are a subset of the shorter's, what remains after exclusion is two numbers for each context.
After the empty context, all byte values not yet seen are equally likely.

The trie is never in one place. A text's score is the sum of the log-probabilities of its (order+1)-grams, so:

1. Texts are taken in blocks of about BLOCK bytes, in the order in which their partitions are read. A block sends each
   part (a hash of the gram) its distinct grams, with their numbers in training texts, and its distinct words likewise.
2. A part sums them up: an index of grams and words with the blocks that ask for them.
3. Grams are dealt by the last CONTEXT bytes of their contexts. Such a share has whole subtrees of the trie, and finds the
   log-probabilities of all its grams at once; the levels above, of which there are at most 256^CONTEXT grams whatever
   the input, are broadcast.
4. Parts send each block its grams' log-probabilities and its words' counts, and the block's texts are scored by them.

Null text counts as empty: it has the end symbol alone. Repeated rows score alike. With no training text, the model is
uniform over bytes and base scores are zero. An empty table gives an empty result. Other columns aren't read. The table
is read twice and must come in the same partitions both times, as files do; rows that don't raise an error.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import AT_ONCE, small_batches, stored
from lodestone.llm.simhash import words

#: Bytes of the texts that share a table of grams, and of the texts that are taken apart at once.
BLOCK, STEP = 1 << 24, 1 << 20
#: Bytes of text for each part of the index; grams that are sorted at once.
PART, SORTED = 1 << 24, 1 << 22
#: Context bytes that share a subtree.
CONTEXT = 3


def mask(n: int) -> np.uint64:
    """The low n bytes."""
    return np.uint64((1 << 8 * n) - 1)


def grams(texts: list[list[bytes]], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (order+1)-grams that end at the symbols of texts, given as words, and the text of each; a bounded number at once."""
    pad = b"\n" * order
    parts = [pad + b" ".join(t) + b"\n" for t in texts]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    symbols, starts = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(lengths) - lengths
    on, text = np.ones(len(symbols), dtype=bool), np.repeat(np.arange(len(parts), dtype=np.uint64), lengths)
    on[(starts[:, None] + np.arange(order)).ravel()] = False  # the padding is context alone
    for at in range(0, len(symbols) - order, STEP):
        piece = symbols[at : at + STEP + order]
        key = np.zeros(len(piece) - order, dtype=np.uint64)
        for i in range(order + 1):
            key <<= np.uint64(8)
            key |= piece[i : i + len(key)]
        now = slice(at + order, at + order + len(key))
        yield key[on[now]], text[now][on[now]]


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts."""
    if len(keys) and not (keys[1:] >= keys[:-1]).all():
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
    at = firsts(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def levels(keys: np.ndarray, n: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct grams of each order in orders, and their counts, from those of a longer order or of the longest one asked for."""
    out = []
    for k in reversed(orders):
        keys, n = add_up(keys & mask(k + 1), n)
        out.append((keys, n))
    return out[::-1]


class Trie:
    """Log10 probabilities from the counts of grams of each order."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: sorted grams of k+1 bytes and their counts. Shorter grams of each gram are there, and all symbols of their contexts."""
        self.order, self.levels = len(levels) - 1, levels
        totals, kinds, self.contexts = [], [], []
        for keys, n in levels:
            c, total = add_up(keys >> np.uint64(8), n)
            self.contexts.append(c)
            totals.append(total.astype(np.float64))
            kinds.append(add_up(keys >> np.uint64(8), np.ones(len(keys), dtype=np.int64))[1].astype(np.float64))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_all = [np.log10(2 * t) for t in totals]
            self.escape = [np.log10(u / (2 * t)) for t, u in zip(totals, kinds, strict=True)]
            self.log_rest, self.escape_rest = [None], [None]  # of a context of order k, for the step at order k-1 after its escape
            for k in range(1, self.order + 1):
                keys, contexts = levels[k][0], self.contexts[k]
                below = levels[k - 1][1][np.searchsorted(levels[k - 1][0], keys & mask(k))]
                gone = np.bincount(np.searchsorted(contexts, keys >> np.uint64(8)), weights=below, minlength=len(contexts))
                shorter = np.searchsorted(self.contexts[k - 1], contexts & mask(k - 1))
                t, u = totals[k - 1][shorter] - gone, kinds[k - 1][shorter] - kinds[k]
                self.log_rest.append(np.log10(2 * t))
                self.escape_rest.append(np.where(u > 0, np.log10(u / (2 * t)), 0.0))  # nothing left: the escape is certain
        self.unseen = float(-np.log10(max(1, 256 - len(levels[0][0]))))

    def log10(self, key: np.ndarray) -> np.ndarray:
        """Of the last byte of each (order+1)-gram after the others."""
        out = np.zeros(len(key))
        todo, came = np.arange(len(key)), np.full(len(key), -1, dtype=np.int64)  # came: the longer context that was escaped, or -1
        for k in range(self.order, -1, -1):
            g = key[todo] & mask(k + 1)
            at, ctx = find(self.levels[k][0], g), find(self.contexts[k], g >> np.uint64(8))
            hit, fresh = at >= 0, came < 0
            own = np.log10(2 * self.levels[k][1][at[hit]].astype(np.float64) - 1)
            rest = np.where(fresh[hit], self.log_all[k][ctx[hit]], self.log_rest[k + 1][came[hit]] if k < self.order and len(self.log_rest[k + 1]) else 0.0)
            out[todo[hit]] += own - rest
            c = ~hit & fresh & (ctx >= 0)
            out[todo[c]] += self.escape[k][ctx[c]]
            d = ~hit & ~fresh
            if d.any():
                out[todo[d]] += self.escape_rest[k + 1][came[d]]
            todo, came = todo[~hit], ctx[~hit]
        out[todo] += self.unseen
        return out


def in_blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a partition with the number of their block, which follows from the bytes of the texts before them."""
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64) + 16
        before = done + np.cumsum(size) - size
        done += int(size.sum())
        at = [*firsts(before // BLOCK), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            yield part << 32 | int(before[a] // BLOCK), batch.slice(a, b - a)


def steps(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(the first's place, the words of each) of some texts at a time."""
    out, n, first = [], 0, 0
    for i, t in enumerate(texts):
        out.append(words(t))
        n += len(t or "") + 16
        if n >= STEP:
            yield first, out
            out, n, first = [], 0, i + 1
    if out:
        yield first, out


class Asked:
    """The distinct grams and words of a block, with their numbers in training texts."""

    def __init__(self, order: int):
        self.order, self.held, self.buffer, self.n = order, [], np.empty(max(SORTED, STEP), dtype=np.uint64), 0
        self.words: Counter = Counter()
        self.texts = 0

    def add(self, texts: list[list[bytes]], learn: np.ndarray) -> None:
        for key, text in grams(texts, self.order):
            if self.n + len(key) > len(self.buffer):
                self.flush()
            self.buffer[self.n : self.n + len(key)] = key << np.uint64(1) | learn[text.astype(np.int64)]
            self.n += len(key)
        for t, on in zip(texts, learn.tolist(), strict=True):
            if on:
                self.words.update(t)
                self.texts += 1
            else:
                self.words.update(dict.fromkeys(t, 0))

    def flush(self) -> None:
        now = self.buffer[: self.n]
        now.sort()
        at = firsts(now)
        self.held.append((now[at], np.diff(np.append(at, self.n))))
        self.n = 0

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        key, n = add_up(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        return add_up(key >> np.uint64(1), np.where(key & np.uint64(1), n, 0))


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their part, where each part begins and ends)."""
    by = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return by, np.searchsorted(part[by], np.arange(parts + 1))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _table(columns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if columns[schema.names[0]]:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(text))


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: in order or small, they then compress well where they are shuffled."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(x.T).view(kind).ravel()


def _numbers(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [_unpacked(x, kind) for x in column.to_pylist()]


def _joined(arrays: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *arrays])


ASKED = "part long, block long, grams binary, n binary, words array<binary>, word_n array<long>, texts long"
INDEX = "part long, grams binary, n binary, asks binary, blocks binary, words array<binary>, word_n array<long>, word_asks binary, word_blocks binary, texts long, words_n long, words_seen long, low binary, low_n binary"
FOUND = "block long, grams binary, logs binary, words array<binary>, word_n array<long>"


def asked(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """Step 1, from (id, text, learn)."""
    schema = _schema(ASKED)

    def emit(block: int, a: Asked) -> Iterator[pa.RecordBatch]:
        key, n = a.grams()
        by, at = by_part(part_of(key, parts), parts)
        key, n = key[by], n[by].astype("<u4")
        said: list[list] = [[] for _ in range(parts)]
        for w in a.words:
            said[zlib.crc32(w) % parts].append(w)
        out: dict[str, list] = {f: [] for f in schema.names}
        for p in range(parts):
            if at[p] < at[p + 1] or said[p] or not p:
                row = (p, block, _packed(key[at[p] : at[p + 1]]), _packed(n[at[p] : at[p + 1]]), said[p], [*map(a.words.__getitem__, said[p])], a.texts if not p else 0)
                for f, v in zip(out, row, strict=True):
                    out[f].append(v)
        yield from _table(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, None
        for block, rows in in_blocks(batches, 1):
            if block != last:
                if now:
                    yield from emit(last, now)
                last, now = block, Asked(order)
            learn = np.asarray(rows.column(2).to_pylist(), dtype=bool)
            for at in range(0, rows.num_rows, AT_ONCE):
                for k, texts in steps(rows.column(1).slice(at, AT_ONCE).to_pylist()):
                    now.add(texts, learn[at + k : at + k + len(texts)])
        if now:
            yield from emit(last, now)

    return docs.mapInArrow(run, ASKED)


def indexed(asks: DataFrame, order: int, context: int) -> DataFrame:
    """Step 2: a row for each part. The shorter grams' counts go along, for the levels that are broadcast."""
    schema = _schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        blocks, each = np.asarray(t["block"], dtype="<i8"), _numbers(t["grams"], "<u8")
        key, n = _joined(each, "<u8"), _joined(_numbers(t["n"], "<u4"), "<i8")
        block = np.repeat(blocks, [len(x) for x in each])
        by = np.argsort(key, kind="stable")
        key, n, block = key[by], n[by], block[by]
        at = firsts(key)
        grams_, n = key[at], np.add.reduceat(n, at) if len(at) else n
        of: dict[bytes, list] = {}
        for b, said, counts in zip(blocks.tolist(), t["words"].to_pylist(), t["word_n"].to_pylist(), strict=True):
            for w, c in zip(said, counts, strict=True):
                if (x := of.get(w)) is None:
                    of[w] = [c, b]
                else:
                    x[0] += c
                    x.append(b)
        seen = n > 0
        low, low_n = add_up(grams_[seen] & mask(context), n[seen])
        counts = [x[0] for x in of.values()]
        row = {
            "part": t["part"][0].as_py(), "grams": _packed(grams_), "n": _packed(n), "asks": _packed(np.diff(np.append(at, len(key))).astype("<u4")), "blocks": _packed(block),
            "words": [*of], "word_n": counts, "word_asks": _packed(np.array([len(x) - 1 for x in of.values()], dtype="<u4")), "word_blocks": _packed(np.array([b for x in of.values() for b in x[1:]], dtype="<i8")),
            "texts": pc.sum(t["texts"]).as_py(), "words_n": sum(counts), "words_seen": sum(c > 0 for c in counts), "low": _packed(low), "low_n": _packed(low_n),
        }
        yield from _table({k: [v] for k, v in row.items()}, schema)

    return asks.groupBy("part").applyInArrow(run, INDEX)


def short_levels(index: DataFrame, context: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trie's levels of grams of up to ``context`` bytes; what comes to the driver is at most 256^context numbers."""
    if not context:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, n in zip(_numbers(b.column(0), "<i8"), _numbers(b.column(1), "<i8"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(n)], names=["gram", "n"])

    t = index.select("low", "low_n").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return levels(np.asarray(t["gram"], dtype=np.int64).view(np.uint64), np.asarray(t["n"], dtype=np.int64), range(context))


def predicted(index: DataFrame, order: int, context: int, parts: int) -> DataFrame:
    """Step 3: (part, grams, logs) of all grams."""
    sent = index.sparkSession.sparkContext.broadcast(short_levels(index, context))
    dealt_schema, schema = _schema("share long, part long, grams binary, n binary"), _schema("part long, grams binary, logs binary")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, key, n in zip(b.column(0).to_pylist(), _numbers(b.column(1), "<u8"), _numbers(b.column(2), "<i8"), strict=True):
                by, at = by_part(part_of(key >> np.uint64(8) & mask(context), parts), parts)
                some = [s for s in range(parts) if at[s] < at[s + 1]]
                key, n = key[by], n[by]
                yield from _table({"share": some, "part": [p] * len(some), "grams": [_packed(key[at[s] : at[s + 1]]) for s in some], "n": [_packed(n[at[s] : at[s + 1]]) for s in some]}, dealt_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        each = _numbers(t["grams"], "<u8")
        key, n = _joined(each, "<u8"), _joined(_numbers(t["n"], "<i8"), "<i8")
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        trie = Trie(sent.value + levels(key[n > 0], n[n > 0], range(context, order + 1)))
        logs = np.empty(len(key))
        logs[by] = trie.log10(key)
        ends = np.cumsum([len(x) for x in each])
        yield from _table({"part": t["part"].to_pylist(), "grams": [_packed(x) for x in each], "logs": [_packed(logs[e - len(x) : e]) for x, e in zip(each, ends, strict=True)]}, schema)

    return index.select("part", "grams", "n").mapInArrow(deal, "share long, part long, grams binary, n binary").groupBy("share").applyInArrow(run, "part long, grams binary, logs binary")


def answered(index: DataFrame, logs: DataFrame) -> DataFrame:
    """Step 4, the parts' side: what each block asked for."""
    schema = _schema(FOUND)

    def entries(asks: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the blocks, the places of what they asked for, where each block's begin)."""
        ids, block = np.unique(blocks, return_inverse=True)
        place = np.repeat(np.arange(len(asks)), asks)
        by, at = by_part(block, len(ids))
        return ids, place[by], at

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[int, list] = {}
        for x in left.to_pylist():
            key, log = _joined(_numbers(right["grams"], "<u8"), "<u8"), _joined(_numbers(right["logs"], "<f8"), "<f8")
            by = np.argsort(key, kind="stable")
            key, log = key[by], log[by]
            ids, place, at = entries(_unpacked(x["asks"], "<u4"), _unpacked(x["blocks"], "<i8"))
            for k, b in enumerate(ids.tolist()):
                p = place[at[k] : at[k + 1]]
                out[b] = [_packed(key[p]), _packed(log[p]), [], []]
            said, counts = pa.array(x["words"], pa.binary()), np.array(x["word_n"], dtype=np.int64)
            ids, place, at = entries(_unpacked(x["word_asks"], "<u4"), _unpacked(x["word_blocks"], "<i8"))
            for k, b in enumerate(ids.tolist()):
                p = place[at[k] : at[k + 1]]
                out.setdefault(b, [b"", b"", [], []])[2:] = [said.take(pa.array(p)).to_pylist(), counts[p].tolist()]
        return pa.table([pa.array([*out], pa.int64()), *(pa.array([x[i] for x in out.values()], schema.field(i + 1).type) for i in range(4))], schema=schema)

    return index.select("part", "asks", "blocks", "words", "word_n", "word_asks", "word_blocks").groupBy("part").cogroup(logs.groupBy("part")).applyInArrow(run, FOUND)


def scored(docs: DataFrame, found: DataFrame, order: int) -> DataFrame:
    """Step 4, the blocks' side: id, n_tokens, n_known, logs, score; the end symbol isn't in n_known and logs."""
    tagged = "id long, text string, block long"

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in in_blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(rows.num_rows, block, dtype=np.int64))], names=["id", "text", "block"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, log = _joined(_numbers(right["grams"], "<u8"), "<u8"), _joined(_numbers(right["logs"], "<f8"), "<f8")
        by = np.argsort(key, kind="stable")
        key, log = key[by], log[by]
        count = {w: c for said, counts in zip(right["words"].to_pylist(), right["word_n"].to_pylist(), strict=True) for w, c in zip(said, counts, strict=True)}
        tokens, known, logs, score = (np.zeros(left.num_rows, dtype=k) for k in (np.int64, np.int64, np.float64, np.float64))
        for first, texts in ((a + k, t) for a in range(0, left.num_rows, AT_ONCE) for k, t in steps(left["text"].slice(a, AT_ONCE).to_pylist())):
            now = slice(first, first + len(texts))
            for g, text in grams(texts, order):
                g = g << np.uint64(16) | text
                g.sort()
                new = firsts(g >> np.uint64(16))
                place = find(key, g[new] >> np.uint64(16))
                if (place < 0).any():
                    raise RuntimeError("the documents came in other partitions when they were read again; write them to a table first")
                score[now] += np.bincount((g & np.uint64(0xFFFF)).astype(np.int64), weights=np.repeat(log[place], np.diff(np.append(new, len(g)))), minlength=len(texts))
            n = np.array([len(t) for t in texts])
            c = np.fromiter(map(count.__getitem__, chain.from_iterable(texts)), dtype=np.float64, count=int(n.sum()))
            of = np.repeat(np.arange(len(texts)), n)
            tokens[now], known[now], logs[now] = n + 1, np.bincount(of, weights=c > 0, minlength=len(texts)), np.bincount(of, weights=np.log10(c + 1), minlength=len(texts))
        return pa.table([left["id"], pa.array(tokens), pa.array(known), pa.array(logs), pa.array(score)], names=["id", "n_tokens", "known", "logs", "score"])

    return docs.select("id", "text").mapInArrow(tag, tagged).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "id long, n_tokens long, known long, logs double, score double")


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 5) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row of docs; the model learns from the rows where ``learn`` holds.

    base_score is the add-one unigram over words. order is at most 5, so that a gram and the place of its text fit a number.
    """
    if not 0 <= order <= 5:
        raise ValueError("order is from 0 to 5")
    small_batches(docs.sparkSession)
    rows, context = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")), min(order, CONTEXT)
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))
    index = stored(indexed(asked(rows, order, parts), order, context))
    texts, n, kinds = (x or 0 for x in index.agg(F.sum("texts"), F.sum("words_n"), F.sum("words_seen")).first())
    total, v = n + texts, kinds + (texts > 0)
    out = scored(rows, answered(index, predicted(index, order, context, parts)), order)
    base = F.col("logs") + F.lit(float(np.log10(texts + 1))) - F.col("n_tokens") * F.lit(float(np.log10(total + v + 1)))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
