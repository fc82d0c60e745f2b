"""Near duplicates by SimHash, found with a Gray-order hierarchical index.

A document's fingerprint has bit b set where over half of its shingles' XXH64 values (seed 42, repeats counted) have it
set. Distinct fingerprints go to buckets by the bits of one of ``distance + 1`` blocks: two that differ in at most
``distance`` bits agree in a block. In a bucket they stand in order of Gray rank, in which neighbours differ in few bits;
upper nodes hold the bit patterns that a run of them shares under a mask, byte by byte. A query walks the nodes level by
level with the differences that it has gathered so far, and leaves a node, with all beneath it, once they exceed
``distance``. Large buckets are dealt as pairs of blocks of rows. Buckets emit a star for each component found in them,
never all pairs; components across buckets are joined by alternating stars.

Texts without a word have fingerprint zero and link like any other; null counts as empty; fewer words than a shingle has
make one shingle. Equal fingerprints are one class. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, forget, keyed, per_batch, slices, small_batches, split_by, stored, trim, unstored, without
from lodestone.llm.components import components

SEED = 42
#: Rows of a block of a large bucket, and queries that walk a bucket's index at once.
BLOCK = 1024
#: Bits of a shingle's hash that name the counter that orders it, and counters in a part; rows of shared shingles that a task holds, one shingle's at least.
COUNTED, PART, HELD = 22, 1 << 14, 1 << 18
NAMES = ["token", "node", "root", "size", "place"]
#: Rows of one shingle that meet pair by pair; more are a crowd. Shingles in a block of a crowd, beside BLOCK rows.
FEW, VALUES = 32, 1 << 19

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; bytes.split() parts at just these six characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int) -> int:
    w = words(text)
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    h, seed = xxhash.xxh64_intdigest, SEED
    values = np.array([h(g, seed) for g in grams], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        total += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(values), bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The rank of each word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order, with a level of shared masked patterns for each byte from the top."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values = values[self.order]
        by_byte = self.values.astype(">u8").view(np.uint8).reshape(-1, 8)
        self.starts, self.patterns, self.children = [], [], []
        new = np.zeros(len(values), dtype=bool)
        new[:1] = True
        before = np.zeros(1, dtype=np.int64)
        for level in range(8):  # a Gray prefix and a binary prefix change at the same rows
            new = new.copy()
            new[1:] |= by_byte[1:, level] != by_byte[:-1, level]
            starts = np.flatnonzero(new)
            self.children.append(np.append(np.searchsorted(starts, before), len(starts)))
            self.starts.append(starts)
            self.patterns.append(by_byte[starts, level])
            before = starts
        self.ends = np.append(self.starts[-1][1:], len(values))

    def near(self, queries: np.ndarray, distance: int, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query position, position in values as given) at up to ``distance``, a bounded block at a time."""
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.uint8))]
        by_byte = queries.astype(">u8").view(np.uint8).reshape(-1, 8)
        while todo:
            level, q, node, gone = todo.pop()
            if level == 8:
                n = self.ends[node] - self.starts[-1][node]
                yield np.repeat(q, n), self.order[_ranges(self.starts[-1][node], n)]
                continue
            at, n = self.children[level][node], self.children[level][node + 1] - self.children[level][node]
            parts = [slice(None)] if n.sum() <= most or len(q) == 1 else [slice(0, len(q) // 2), slice(len(q) // 2, None)]
            if len(parts) > 1:
                todo += [(level, q[p], node[p], gone[p]) for p in parts]
                continue
            to, who = _ranges(at, n), np.repeat(q, n)
            sum_ = np.repeat(gone, n) + _POPCOUNT[by_byte[who, level] ^ self.patterns[level][to]]
            on = sum_ <= distance
            if on.any():
                todo.append((level + 1, who[on], to[on], sum_[on]))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1 ... for each i, one after another."""
    total = int(lengths.sum())
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)


def local_stars(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, least value) for the values of the two sides that link across, grouped as far as these links reach."""
    values = np.unique(np.concatenate([left, right]))
    index, label = GrayIndex(right), np.arange(len(values))
    place_r, place_l = np.searchsorted(values, right), np.searchsorted(values, left)
    pairs = True
    while pairs:
        pairs = False
        for at in range(0, len(left), BLOCK):
            for q, r in index.near(left[at : at + BLOCK], distance):
                a, b = place_l[at + q], place_r[r]
                least = np.minimum(label[a], label[b])
                if (least < label[a]).any() or (least < label[b]).any():
                    pairs = True
                    np.minimum.at(label, a, least)
                    np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]
    far = label != np.arange(len(values))
    return values[far], values[label[far]]


def mixed(values: np.ndarray) -> np.ndarray:
    """Longs, each to another, as if at random."""
    x = values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _as_unsigned(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)


def block_masks(distance: int) -> list[int]:
    """distance + 1 masks that part the 64 bits."""
    n = distance + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def dealt_buckets(prints: DataFrame, masks: list[int], f) -> DataFrame:
    """(u, v) that f gives for the fingerprints fp (signed long) that agree under a mask; large buckets go as pairs of blocks."""
    keyed = cut(prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("block", "key")))
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = cut(sizes.select("block", "key", blocks.alias("blocks")))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a row meets its own block and each other one: key (i, j), i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = keyed.join(sizes, ["block", "key"]).select("block", "key", "fp", "blocks", mine.alias("mine"), other)
    # small buckets share a task: what lies near in another of them is a link all the same
    large, several = F.col("blocks") > 1, max(1, -(-keyed.count() // BLOCK))
    group = F.when(large, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(several)))
    dealt = dealt.select("block", large.alias("large"), group.alias("group"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        fp, mine, i, j = (_as_unsigned(t["fp"]) if n == "fp" else np.asarray(t[n]) for n in ("fp", "mine", "i", "j"))
        a, b = f(fp[mine == i], fp[mine == j])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    return dealt.groupBy("block", "large", "group", "i", "j").applyInArrow(run, "u long, v long")


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) of distinct fingerprints fp (signed long) that join what lies within ``distance``; stars, not all pairs."""
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance)]
    return dealt_buckets(prints, masks, lambda left, right: local_stars(left, right, distance))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One line per row: id, fingerprint (16 hex digits), component_id, the least id reachable."""

    def f(rows: dict) -> dict:
        values = np.array([fingerprint(t, shingle) for t in rows["text"]], dtype=np.uint64)
        return {"id": rows["id"], "fp": values.view(np.int64)}

    prints = cut(per_batch(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id long, fp long", f))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    of = components(links(classes.select("fp"), distance))
    of = of.unionByName(of.select(F.col("root").alias("node"), "root").distinct())
    of = cut(of.join(classes.withColumnRenamed("fp", "node"), "node"))
    least = of.groupBy("root").agg(F.min("least").alias("least"))
    classes = classes.join(of.drop("least").join(least, "root").select(F.col("node").alias("fp"), F.col("least").alias("least_of")), "fp", "left")
    classes = cut(classes.select("fp", F.coalesce("least_of", "least").alias("component_id")))
    out = prints.join(classes.hint("merge"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sampled_masks(tables: int, bits: int) -> list[int]:
    """tables masks of so many of the 64 bits each, always the same."""
    rng = np.random.default_rng(SEED)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]


def least_neighbours(values: np.ndarray, others: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of both sides' values the least value of the other side within distance, where that is less."""
    least: dict[str, np.ndarray] = {"l": values.copy(), "r": others.copy()}
    index = GrayIndex(others)
    for at in range(0, len(values), BLOCK):
        for q, r in index.near(values[at : at + BLOCK], distance):
            np.minimum.at(least["l"], at + q, others[r])
            np.minimum.at(least["r"], r, values[at + q])
    u, v = np.concatenate([values, others]), np.concatenate([least["l"], least["r"]])
    return u[v < u], v[v < u]


def _shingles(text: str | None, n: int) -> np.ndarray:
    w = words(text)
    grams = map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else [b" ".join(w)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64))


def _counters(rows: DataFrame, shingle: int) -> np.ndarray:
    """How common the shingles of each counter are in all rows, as a logarithm. It only orders what least_shingles() looks at."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTED, dtype=np.uint32)
        for batch in chain.from_iterable(map(slices, batches)):
            for t in batch.column(0).to_pylist():
                np.add.at(n, _counter(_shingles(t, shingle)), np.uint32(1))
        parts = n.reshape(-1, PART)
        on = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in on], pa.binary())], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = 0, np.zeros(PART, dtype=np.uint64)
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n += np.frombuffer(zlib.decompress(x), dtype=np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([(np.log2(n + 1.0) * 1000).astype(np.uint16).tobytes()], pa.binary())], names=["part", "n"])

    small_batches(rows.sparkSession)
    out = np.zeros((1 << COUNTED) // PART * PART, dtype=np.uint16).reshape(-1, PART)
    for r in rows.select("text").mapInArrow(count, "part long, n binary").groupBy("part").applyInArrow(add, "part long, n binary").collect():
        out[r["part"]] = np.frombuffer(r["n"], dtype=np.uint16)
    return out.ravel()


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTED)).astype(np.int64)


def least_shingles(values: np.ndarray, similarity: float, counters: np.ndarray) -> np.ndarray:
    """So many first shingles of a sorted set, the rare before the common, that two sets of the similarity share one of them.

    Of a set of n, a set that is similar has at least ``similarity * n``; the first of the shared ones, in any order
    that is the same for all sets, is among the first ``n - similarity * n + 1``. Shingles of one counter go by value.
    """
    n = len(values) - int(np.ceil(similarity * len(values) - 1e-9)) + 1
    return values[np.argsort(counters[_counter(values)], kind="stable")[:n]]


def sharing(token: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by token, size) of one token and unlike groups, whose sets can have the similarity.

    What two sets share from their first shared shingle on is at most what the shorter rest holds.
    """
    on, d = np.arange(len(token)), 0
    while len(on):
        d += 1
        on = on[on + d < len(token)]
        to = on + d
        keep = (token[on] == token[to]) & (size[on] >= similarity * size[to] - 1e-6)
        on = on[keep]  # rows further on are larger still
        to = on + d
        least = similarity / (1 + similarity) * (size[on] + size[to]) - 1e-6
        hit = (group[on] != group[to]) & (np.minimum(size[on] - place[on], size[to] - place[to]) >= least)
        if hit.any():
            yield on[hit], to[hit]


def sharing_pairs(rows: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b, root): all pairs of nodes (row, print, node, root), not yet of one root, that can have the similarity; none is left out.

    Rows meet in every shingle of least_shingles(). They are sorted and read as a stream, so a task holds one shingle's
    rows at a time, and only pairs that pass the bounds on size and place are emitted; their root is null.

    Over FEW rows of a shingle are no pairs but members b, with their root, of a crowd a, for crowd_links(). A crowd is
    named by the least of its members in an order as if at random. So shingles of much the same rows, as those of a family
    of copies are, make a few crowds, and no crowd reaches beyond the rows that share a shingle with the row that names it.
    """
    counters = _counters(rows, shingle)

    def first(r: dict) -> dict:
        sets = [_shingles(t, shingle) for t in r["text"]]
        return {"row": r["row"], "print": r["print"], "size": [len(x) for x in sets], "tokens": [least_shingles(x, similarity, counters).view(np.int64) for x in sets]}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(a: np.ndarray, b: np.ndarray, root: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), root], names=["a", "b", "root"])

        def emit(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.append(True, x[0][1:] != x[0][:-1]))
            n = np.diff(np.append(starts, x.shape[1]))
            several = np.minimum.reduceat(x[2], starts) < np.maximum.reduceat(x[2], starts)
            crowd = np.repeat(np.minimum.reduceat(mixed(x[1]), starts), n)
            many, few = np.repeat(several & (n > FEW), n), np.repeat(several & (n <= FEW), n)
            if many.any():
                a, b, root = np.unique(np.stack([crowd[many], x[1][many], x[2][many]]), axis=1)
                yield out(a, b, pa.array(root))
            x = x[:, few]
            for on, to in sharing(x[0], x[2], x[3], x[4], similarity):
                a, b = np.maximum(x[1][on], x[1][to]), np.minimum(x[1][on], x[1][to])
                yield out(a, b, pa.nulls(len(a), pa.int64()))

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([np.asarray(c) for c in batch.columns]))
                if held[0][0][0] != held[-1][0][-1] and sum(x.shape[1] for x in held) >= HELD:
                    x = np.concatenate(held, axis=1)
                    end = int(np.flatnonzero(x[0] != x[0][-1])[-1]) + 1  # the last token may go on in the next batch
                    yield from emit(x[:, :end])
                    held = [x[:, end:]]
        if held:
            yield from emit(np.concatenate(held, axis=1))
        held.clear()
        trim()

    # texts stay where they are; what is joined with the nodes are the first shingles
    of = per_batch(rows, "row long, print long, size long, tokens array<long>", first)
    of = of.join(nodes, ["row", "print"]).select("node", "root", "size", F.posexplode("tokens").alias("place", "token"))
    dealt = of.select(*(F.col(n).cast("long") for n in NAMES)).repartition("token").sortWithinPartitions("token", "size")
    return dealt.mapInArrow(meet, "a long, b long, root long").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of the left shares with each of the right: those that many pairs share by a product, the others pair by pair."""

    def columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        on = common[at] == values
        order = np.argsort(at[on], kind="stable")
        return at[on][order], row[on][order]

    both = np.zeros((len(left), len(right)), dtype=np.float32)
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    if not len(common):
        return both
    sides = [columns(left), columns(right)]
    n = [np.bincount(c, minlength=len(common)) for c, _ in sides]
    starts, pairs = [np.cumsum(x) - x for x in n], n[0] * n[1]
    dense = np.flatnonzero(100 * pairs >= both.size)
    for at in range(0, len(dense), 1024):
        part, m = dense[at : at + 1024], []
        for (_, row), first, k, size in zip(sides, starts, n, both.shape, strict=True):
            m.append(np.zeros((size, len(part)), dtype=np.float32))
            m[-1][row[_ranges(first[part], k[part])], np.repeat(np.arange(len(part)), k[part])] = 1
        both += m[0] @ m[1].T
    rare = np.flatnonzero(100 * pairs < both.size)
    for part in np.split(rare, np.searchsorted(np.cumsum(pairs[rare]), np.arange(1 << 20, pairs[rare].sum() + 1, 1 << 20))):
        times = np.repeat(n[1][part], n[0][part])  # each left row of a value goes with all right rows of it
        i = np.repeat(sides[0][1][_ranges(starts[0][part], n[0][part])], times)
        j = sides[1][1][_ranges(np.repeat(starts[1][part], n[0][part]), times)]
        np.add.at(both.reshape(-1), i * len(right) + j, np.float32(1))
    return both


def set_stars(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for the nodes whose sets have the similarity across the sides (places in nodes), grouped as far as these links reach."""
    size = np.array([len(x) for x in sets], dtype=np.float64)
    both, links = shared_counts([sets[i] for i in left], [sets[i] for i in right]), []
    for at in range(0, len(left), 64):
        b = both[at : at + 64].astype(np.float64)
        i, j = np.nonzero(b >= similarity * (size[left[at : at + 64], None] + size[right] - b))
        links.append(np.stack([left[at + i], right[j]]))
    a, b = np.concatenate(links, axis=1)
    order = np.argsort(nodes)
    label = np.empty(len(nodes), dtype=np.int64)
    label[order] = np.arange(len(nodes))
    a, b = label[a], label[b]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]
    far = label != np.arange(len(nodes))
    return nodes[order[far]], nodes[order[label[far]]]


def crowd_links(rows: DataFrame, nodes: DataFrame, crowds: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): stars that join what has the similarity within each of the crowds (crowd, node, root); never all pairs.

    Every two members of unlike roots are compared, set against set, in one task each for two blocks of rows. Blocks of a
    crowd that is too large for one are made of sizes that are near each other, and of one root where it has many rows;
    blocks whose sizes are too far apart, or that are of one root both, don't meet.
    """
    sets = _forms(rows, nodes, crowds.select("node").distinct(), shingle, np.ndarray.tobytes)
    sizes = sets.select("node", (F.length("set") / 8).cast("long").alias("size"))
    totals = crowds.join(sizes, "node").groupBy("crowd").agg(F.count("*").alias("n"), F.sum("size").alias("values"))
    large = totals.select("crowd", ((F.col("n") > BLOCK) | (F.col("values") > VALUES)).alias("large"))
    apart = crowds.groupBy("crowd", "root").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK // 2).select("crowd", "root", F.col("root").alias("apart"))
    # a little wide, so that sizes of the similarity are of one step or of neighbours
    step = F.floor(F.log("size") / F.lit(max(-1.001 * float(np.log(similarity)), 1e-3)))
    of = crowds.join(sizes, "node").join(large, "crowd").join(apart, ["crowd", "root"], "left")
    of = cut(of.select("crowd", "node", "size", F.when(F.col("large"), step).otherwise(F.lit(0)).cast("int").alias("step"), F.coalesce("apart", F.lit(-1)).alias("apart")))
    kinds = ["crowd", "step", "apart"]
    blocks = of.groupBy(kinds).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / VALUES)).cast("int").alias("blocks"))
    blocks = cut(blocks)
    each = blocks.select(*kinds, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    x, y = F.struct("x.step", "x.apart", "x.block"), F.struct("y.step", "y.apart", "y.block")
    meeting = (x <= y) & (F.abs(F.col("x.step") - F.col("y.step")) <= 1) & ((F.col("x.apart") != F.col("y.apart")) | (F.col("x.apart") < 0))
    tasks = each.alias("x").join(each.alias("y"), F.col("x.crowd") == F.col("y.crowd")).filter(meeting)
    tasks = cut(tasks.select(F.col("x.crowd").alias("crowd"), x.alias("x"), y.alias("y")).withColumn("task", F.monotonically_increasing_id()))
    sides = tasks.select("crowd", "task", F.col("x.*"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    sides = sides.unionByName(tasks.filter("x != y").select("crowd", "task", F.col("y.*"), F.lit(1).alias("side")))
    mine = of.join(blocks, kinds).select(*kinds, "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    dealt = mine.join(sides, [*kinds, "block"]).select("node", "task", "side").join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        node, side = np.asarray(t["node"]), np.asarray(t["side"])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if len(left) and len(right):
            u, v = set_stars(node, [np.frombuffer(x, dtype=np.uint64) for x in t["set"].to_pylist()], left, right, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        trim()

    edges = cut(dealt.select("task", "node", "side", "set").groupBy("task").applyInArrow(compare, "u long, v long"))
    del dealt
    unstored(sets)
    return edges


def similar_members(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, distance: int, tables: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, members). nodes: row, print, id, copies, node of each different row; members: node, keep for the nodes in a group, where keep is the node of the group's least id (nulls last).

    First, large groups are found cheaply: fingerprints over the distinct pairs of neighbouring words meet in a table if
    they agree in its sampled bits, and in each bucket a fingerprint has its least neighbour within ``distance``. Then
    sharing_pairs() gives every other pair of rows in unlike groups that can have the similarity, or a crowd of rows that
    has it and that crowd_links() compares, so nothing is missed.
    A pair counts only if its texts' shingles, all of them, have the similarity asked for. Texts without a word are
    alike. Equal fingerprints are compared with their first row.
    """

    def f(r: dict) -> dict:
        values = np.array([_distinct_print(t) for t in r["text"]], dtype=np.uint64)
        return {"row": r["row"], "print": r["print"], "id": r["id"], "fp": values.view(np.int64)}

    rows = keyed(docs, id_col, text_col)
    prints = per_batch(rows, "row long, print long, id long, fp long", f)
    rows = rows.drop("id")
    # numbered once: what is written is read from there on
    nodes = cut(prints.groupBy("row", "print").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    tried = _sampled_pairs(nodes, distance, tables, bits)
    forget(docs.sparkSession)
    groups = components(similar_pairs(rows, nodes, tried, shingle, similarity))
    groups = cut(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()))
    forget(docs.sparkSession)
    rooted = nodes.select("row", "print", "node").join(groups, "node", "left").select("row", "print", "node", F.coalesce("root", "node").alias("root"))
    more = cut(sharing_pairs(rows, rooted, shingle, similarity))
    del rooted
    forget(docs.sparkSession)
    pairs = cut(more.filter("root is null").select("a", "b").join(tried, ["a", "b"], "left_anti"))
    edges = similar_pairs(rows, nodes, pairs, shingle, similarity).unionByName(groups.toDF("u", "v"))
    crowds = more.filter("root is not null").toDF("crowd", "node", "root")
    if crowds.head(1):
        edges = edges.unionByName(crowd_links(rows, nodes, crowds, shingle, similarity))
    found = components(edges)
    found = cut(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()))
    del edges
    forget(docs.sparkSession)
    least = found.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least"))
    return nodes, found.join(least, "root").select("node", F.col("least.node").alias("keep"))


def _sampled_pairs(nodes: DataFrame, distance: int, tables: int, bits: int) -> DataFrame:
    """(a, b), a > b: nodes whose fingerprints are equal, or least neighbours in a bucket of sampled bits."""
    classes = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")))
    masks = [m - (1 << 64) if m >> 63 else m for m in sampled_masks(tables, bits)]
    pairs = dealt_buckets(classes.select("fp"), masks, lambda left, right: least_neighbours(left, right, distance))
    first = classes.select("fp", "least")
    pairs = pairs.distinct().join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select("a", "b")
    twins = nodes.join(classes.filter("n > 1").hint("merge"), "fp").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return cut(pairs.unionByName(twins).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 10, tables: int = 32, bits: int = 16) -> DataFrame:
    """(id, component_id) of the different rows that are not alone: groups linked by a Jaccard similarity of word shingles, named by their least id."""
    nodes, members = similar_members(docs, id_col, text_col, shingle, similarity, distance, tables, bits)
    ids = nodes.select("node", "id")
    out = members.join(ids, "node").join(ids.toDF("keep", "component_id"), "keep")
    return out.select(F.col("id").alias(id_col), "component_id")


def set_map(values: np.ndarray) -> bytes:
    """A set's size and a map of its values' last bits, four to eight bits a value."""
    bits = np.zeros(1 << max(3, (4 * len(values) - 1).bit_length()), dtype=bool)
    bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return len(values).to_bytes(4, "little") + np.packbits(bits, bitorder="little").tobytes()


def maps_allow(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether sets of these maps can have the similarity: a bit that one map has alone is a value that the other set lacks."""
    sizes, maps, n = [int.from_bytes(m[:4], "little") for m in (x, y)], [int.from_bytes(m[4:], "little") for m in (x, y)], [8 * len(m) - 32 for m in (x, y)]
    least = min(n)
    for i in (0, 1):
        while n[i] > least:  # the map of half as many bits
            n[i] //= 2
            maps[i] = maps[i] >> n[i] | maps[i] & (1 << n[i]) - 1
    both = min(sizes[0] - (maps[0] & ~maps[1]).bit_count(), sizes[1] - (maps[1] & ~maps[0]).bit_count())
    return both >= similarity * (sum(sizes) - both)


def sets_agree(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether sets, sorted and as bytes, have the similarity."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def similar_pairs(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) of the pairs (a, b) of nodes whose texts have the similarity; rows has row, print, text.

    A set goes along with each of its pairs, so pairs that the sets' maps, a tenth of their size, rule out go first.
    """
    likely = _tested(rows, nodes, pairs, shingle, set_map, lambda x, y: maps_allow(x, y, similarity))
    return _tested(rows, nodes, likely.toDF("a", "b"), shingle, np.ndarray.tobytes, lambda x, y: sets_agree(x, y, similarity))


def _tested(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, form: Callable[[np.ndarray], bytes], test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """(u, v) of the pairs (a, b) of nodes that pass the test of their sets' forms."""
    of = _forms(rows, nodes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), shingle, form)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(map(slices, batches)):
            on = [test(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(on, pa.bool_()))
        trim()

    joined = pairs.join(of.toDF("a", "x").hint("merge"), "a").join(of.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    edges = cut(joined.mapInArrow(verify, "u long, v long"))
    del joined
    unstored(of)
    return edges


def _forms(rows: DataFrame, nodes: DataFrame, asked: DataFrame, shingle: int, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(node, set): the forms of the sets of the nodes in asked, stored; for unstored()."""
    asked = cut(nodes.select("row", "print", "node", "copies").join(asked, "node"))

    def sets(r: dict) -> dict:
        return {"row": r["row"], "print": r["print"], "set": [form(_shingles(t, shingle)) for t in r["text"]]}

    # texts stay where they are here as well; a set is moved once more only for a row that is repeated
    of = per_batch(split_by(rows, asked, ["row", "print"])[0], "row long, print long, set binary", sets)
    of = of.join(asked, ["row", "print"]).select("node", "set", "copies")
    if asked.filter("copies > 1").head(1):
        of = of.filter("copies = 1").unionByName(of.filter("copies > 1").dropDuplicates(["node"]))
    of = stored(of.select("node", "set"))
    forget(rows.sparkSession)
    return of


def _distinct_print(text: str | None) -> int:
    w = words(text)
    if not w:
        return 0
    grams = {*map(b" ".join, zip(w, w[1:], strict=False))} or {w[0]}
    values = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
    total = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(values), bitorder="little").view("<u8")[0])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row, that of the least id, of each group of near duplicates; all columns stay.

    Rows are known by id and text, so a repeated id hides no text; of rows that agree in both, one stays, any of them. Null
    text counts as empty, empty texts are one group, null ids come last, an empty table gives an empty result.
    """
    nodes, members = similar_members(docs, id_col, text_col, shingle, similarity, distance=10, tables=32, bits=16)
    away = cut(members.filter("node != keep").select("node").join(nodes, "node").select("row", "print"))
    again = cut(nodes.filter("copies > 1").select("row", "print").join(away, ["row", "print"], "left_anti"))
    return without(docs, away, again, id_col, text_col)
