"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt to ``lists``, and a vector's score is the sum of its partial scores over them. Vectors
are packed into blocks of rows, queries into blocks of queries, and each pair of blocks is one unit of work: no block
grows with the input, and neither queries nor candidates are ever gathered in one place.

1. Every unit gathers, for each query and list, its k best partial scores, and the whole scores of the vectors that these
   name; the k-th best of them over all units is a cutoff that the k-th best score can't be below.
2. The cutoff joins back to the query blocks. A score of at least the cutoff needs a partial score of at least
   cutoff / lists in some list, and a partial score is at most the product of two lengths: rows stand in the order of
   their length in a list, and only those that are long enough for some query are multiplied. Entries that reach
   cutoff / lists are collected.
3. The whole scores of the collected entries alone are resolved, and a unit's k best by (score, least id) go on to the
   final merge.

Null vectors, and those with null or non-finite components, take no part. A query meets the vectors of its own length.
Components are floor(scale * x) with x as double, held within the range of long; scores are exact, and held within that
range where they would leave it. Equal scores go by the smaller id. Rows that repeat an id are candidates of their own;
as a query, an id has the least of its vectors, and no row of a query's id is its candidate. A query with fewer than k
candidates returns all of them. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, stored

#: Vectors of a row block and of a query block, on average.
ROWS, QUERIES = 4096, 1024
#: Scores that are worked on at once; the ends of a score's range; what no partial score is below.
AT_ONCE, LEAST, MOST, NONE = 1 << 20, -(2**63) + 1, 2**63 - 1, -(1 << 200)


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.floor(x.cast("double") * scale).cast("long"), F.lit(LEAST)))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def matrix(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i8").reshape(n, -1) if blob else np.zeros((n, 0), dtype=np.int64)


def packed(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks (width, name, n, ids, data, and any cutoffs; and the number of that width's blocks) of (id, width, v[, cutoff]) with about ``size`` rows each."""
    blocks = vectors.groupBy("width").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("blocks"))
    extra = [c for c in vectors.columns if c == "cutoff"]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        raw = lambda x: pa.array([np.asarray(x, dtype="<i8").tobytes()], pa.binary())
        cols = [*(pa.array([k.as_py()], pa.int64()) for k in key), pa.array([t.num_rows], pa.int64()), raw(t["id"]), raw(t["v"].combine_chunks().flatten()), *(raw(t[c]) for c in extra)]
        yield pa.RecordBatch.from_arrays(cols, names=["width", "blocks", name, "n", "ids", "data", *extra])

    dealt = vectors.join(blocks, "width").withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.col("blocks")))
    return dealt.groupBy("width", "blocks", name).applyInArrow(run, f"width long, blocks long, {name} long, n long, ids binary, data binary" + "".join(f", {c} binary" for c in extra))


def bound(q: np.ndarray, rows: np.ndarray) -> int:
    """What no product of a row of each exceeds, in the sum of its terms' sizes."""
    largest = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return largest(q) * largest(rows) * q.shape[1]


def products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """q @ rows.T, exactly: in long, or as Python's numbers where these would not do."""
    most = bound(q, rows)
    if most < 1 << 24:
        return (q.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (q.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return q @ rows.T if most < 1 << 62 else q.astype(object) @ rows.astype(object).T


def resolved(q: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The whole scores of the pairs (q[i], rows[j])."""
    out, step = np.zeros(len(i), dtype=np.int64), max(1, AT_ONCE // max(1, q.shape[1]))
    small = bound(q, rows) < 1 << 62
    for at in range(0, len(i), step):
        a, b = q[i[at : at + step]], rows[j[at : at + step]]
        out[at : at + step] = (a * b).sum(axis=1) if small else [min(MOST, max(LEAST, sum(map(int.__mul__, x, y)))) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return out


def slices(width: int, lists: int) -> list[slice]:
    return [slice(width * i // lists, width * (i + 1) // lists) for i in range(lists)]


def lengths(x: np.ndarray) -> np.ndarray:
    """Of each row, rounded up."""
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)


def phase_one(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, r_ids: np.ndarray, lists: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best partial scores of each list."""
    own, named = q_ids[:, None] == r_ids[None, :], []
    for s in slices(q.shape[1], lists):
        p = products(q[:, s], rows[:, s])
        if own.any():
            p[own] = NONE if p.dtype == object else np.iinfo(np.int64).min
        named.append(np.argpartition(-p.astype(np.float64), k - 1, axis=1)[:, :k] if p.shape[1] > k else np.broadcast_to(np.arange(p.shape[1]), p.shape))
    named = np.sort(np.concatenate(named, axis=1), axis=1)
    new = np.ones(named.shape, dtype=bool)
    new[:, 1:] = named[:, 1:] != named[:, :-1]
    i, j = np.repeat(np.arange(len(named)), new.sum(axis=1)), named[new]
    on = q_ids[i] != r_ids[j]
    return i[on], j[on]


def phase_two(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, r_ids: np.ndarray, lists: int, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, row) of the entries that reach cutoff / lists in some list, and how many products that took."""
    least = np.array([-(-int(c) // lists) for c in cutoff], dtype=np.int64)  # integers of at least cutoff / lists
    found, made = [], 0
    for s in slices(q.shape[1], lists):
        of_q, of_r = lengths(q[:, s]), lengths(rows[:, s])
        with np.errstate(divide="ignore", invalid="ignore"):  # the length from which a row can reach the least for some query
            need = np.where(least <= 0, 0.0, np.where(of_q > 0, least / of_q, np.inf)).min(initial=np.inf) * (1 - 1e-9)
        by = np.argsort(-of_r, kind="stable")
        long_ = by[: int(np.searchsorted(-of_r[by], -need, side="right"))]
        if not len(long_):
            continue
        p = products(q[:, s], rows[long_][:, s])
        made += p.size
        i, j = np.nonzero(p >= least[:, None])
        found.append(i * len(rows) + long_[j])
    i, j = np.divmod(np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64), max(1, len(rows)))
    on = q_ids[i] != r_ids[j]
    return i[on], j[on], made


def pairs(query_blocks: DataFrame, row_blocks: DataFrame) -> DataFrame:
    """Every block of queries with every block of rows of that width, joined on both numbers: a stated query set against all rows, in blocks."""
    each = lambda blocks, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)).alias(name)
    number = lambda blocks: blocks.select("width", "blocks").distinct().toDF("width", "others")
    rows = row_blocks.join(number(query_blocks), "width").select("width", "rb", F.col("n").alias("rn"), F.col("ids").alias("r_ids"), F.col("data").alias("r_data"), each("others", "qb"))
    asked = query_blocks.drop("blocks").join(number(row_blocks), "width").select("*", each("others", "rb")).drop("others")
    return asked.join(rows.hint("merge"), ["width", "qb", "rb"])


def kept_best(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) with the k best of each query, best first."""
    q, ids, score = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((ids, -score, q))
    q, ids, score = q[by], ids[by], score[by]
    on = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[on], ids[on], score[on]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, lists: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k best of the other vectors."""

    def clean(df: DataFrame) -> DataFrame:
        out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))
        return out.select("id", F.size("x").cast("long").alias("width"), scaled(F.col("x"), scale).alias("v"))

    rows = cut(clean(vectors))
    asked = clean(queries).groupBy("id").agg(F.min(F.struct("width", "v")).alias("x"))
    asked = cut(asked.select("id", "x.width", "x.v"))
    row_blocks = stored(packed(rows, ROWS, "rb"))

    def units(blocks: DataFrame, f) -> DataFrame:
        """The scores of the pairs that f gives for every unit; of each query a task sends on the k best that it has seen."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            for batch in batches:
                for u in batch.to_pylist():
                    q, q_ids = matrix(u["data"], u["n"]), np.frombuffer(u["ids"], dtype="<i8")
                    r, r_ids = matrix(u["r_data"], u["rn"]), np.frombuffer(u["r_ids"], dtype="<i8")
                    step, mine = max(1, AT_ONCE // max(1, len(r))), held.setdefault((u["width"], u["qb"]), [])
                    cutoffs = np.frombuffer(u["cutoff"], dtype="<i8") if "cutoff" in u else None
                    for at in range(0, len(q), step):
                        part = slice(at, at + step)
                        i, j = f(q[part], q_ids[part], r, r_ids, cutoffs[part] if cutoffs is not None else None)
                        score = resolved(q[part], r, i, j)
                        if cutoffs is not None:
                            on = score >= cutoffs[part][i]
                            i, j, score = i[on], j[on], score[on]
                        mine.append((q_ids[part][i], r_ids[j], score))
                    held[u["width"], u["qb"]] = [kept_best(mine, k)]
            for mine in held.values():
                q, ids, score = kept_best(mine, k)
                first = np.flatnonzero(np.concatenate([q[:1] == q[:1], q[1:] != q[:-1]]))
                entries = pa.StructArray.from_arrays([pa.array(-score), pa.array(ids)], names=["least", "vec_id"])
                yield pa.RecordBatch.from_arrays([pa.array(q[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(q)).astype(np.int32)), entries)], names=["id", "found"])

        found = pairs(blocks, row_blocks).mapInArrow(run, "id long, found array<struct<least: long, vec_id: long>>")
        # one list of at most k a query and task
        return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))

    known = units(stored(packed(asked, QUERIES, "qb")), lambda q, q_ids, r, r_ids, _: phase_one(q, q_ids, r, r_ids, lists, k))
    cutoff = F.when(F.size("found") == k, -F.element_at("found", -1)["least"]).otherwise(F.lit(LEAST))
    kth = known.select("id", cutoff.alias("cutoff"))
    asked = cut(asked.join(kth, "id", "left").fillna(LEAST, ["cutoff"]))
    merged = units(stored(packed(asked, QUERIES, "qb")), lambda q, q_ids, r, r_ids, c: phase_two(q, q_ids, r, r_ids, lists, c)[:2])
    ranked = merged.select(F.col("id").alias("query_id"), F.posexplode("found").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.least")).alias("score"))
