"""Filtered top-k over vectors: one query, many queries, sparse vectors; fetches and replacement by file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lodestone.operators.embed import BUCKETS

#: Queries that are sent to tasks at once; more go in further passes. Rows that are multiplied at once.
QUERIES, ROWS = 2048, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def matching(vectors: DataFrame, must: dict | None = None, must_not: dict[str, list] | None = None) -> DataFrame:
    """Equality on all of must; none of the values of must_not, where a row without the field stays."""
    for k, v in (must or {}).items():
        vectors = vectors.filter(F.col(k) == v)
    for k, values in (must_not or {}).items():
        vectors = vectors.filter(F.col(k).isNull() | ~F.col(k).isin(values))
    return vectors


def top_k(vectors: DataFrame, query: list[float], k: int, ids: list[str], threshold: float | None = None, digits: int = 6) -> DataFrame:
    """The k best by cosine, rounded before it ranks; ties by the id columns. No shuffle but k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = vectors.withColumn("score", F.round(cosine(F.col("embedding"), q), digits))
    out = out.filter(F.col("score") >= threshold) if threshold is not None else out
    return out.orderBy(F.desc("score"), *ids).limit(k)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_col: str = "query_id", threshold: float | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank, id, score for every query of (query_id, embedding).

    Queries go to the tasks in passes of at most QUERIES, a proven size; a task keeps k a query, so what is shuffled grows
    with tasks, not with vectors.
    """
    spark = vectors.sparkSession
    numbered = queries.select(F.col(query_col).cast("long").alias("q"), F.col("embedding").cast("array<double>").alias("e")).filter("e IS NOT NULL")
    many = max(1, -(-numbered.count() // QUERIES))
    found = []
    for part in range(many):
        rows = numbered.filter(F.pmod(F.xxhash64("q"), F.lit(many)) == part).orderBy("q").collect()
        if not rows:
            continue
        q_ids = np.array([r["q"] for r in rows], dtype=np.int64)
        matrix = np.array([r["e"] for r in rows], dtype=np.float64)
        sent = spark.sparkContext.broadcast((q_ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, m = sent.value
            best = [np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))]
            for b in batches:
                rows_ = [(i, e) for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if e]
                for at in range(0, len(rows_), 1024):
                    part_ = rows_[at : at + 1024]
                    v = np.array([e for _, e in part_], dtype=np.float64)
                    s = np.round(m @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, digits)
                    ids = np.concatenate([best[0], np.broadcast_to(np.array([i for i, _ in part_], dtype=np.int64), s.shape)], axis=1)
                    s = np.concatenate([best[1], s], axis=1)
                    by = np.lexsort((ids, -s), axis=1)[:, :k]
                    best = [np.take_along_axis(ids, by, axis=1), np.take_along_axis(s, by, axis=1)]
            n = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=["query_id", "id", "score"])

        found.append(vectors.select(F.col(id_col).cast("long"), F.col("embedding")).mapInArrow(run, "query_id long, id long, score double"))
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.filter(F.col("score") >= threshold) if threshold is not None else out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def sparse_top_k(chunks: DataFrame, queries: DataFrame, key: list[str], query_key: list[str], k: int, threshold: float | None = None, digits: int = 6) -> DataFrame:
    """query_key, rank, key, score: for each query the k best of the sparse vectors (buckets, weights), ties by key.

    Queries go to the tasks in passes of at most QUERIES vectors of BUCKETS numbers, a proven size. A task multiplies
    blocks of its rows with all of a pass's queries and keeps k a query; so nothing is joined on a bucket, and what is
    shuffled grows with tasks and queries, not with vectors.
    """
    spark, found = chunks.sparkSession, []
    queries = queries.select(*query_key, "buckets", "weights")
    many = max(1, -(-queries.count() // QUERIES))
    asked_types, key_types = ([df.schema[c].dataType for c in names] for df, names in ((queries, query_key), (chunks, key)))
    schema = T.StructType([*(T.StructField(n, t) for n, t in zip([*query_key, *key], [*asked_types, *key_types], strict=True)), T.StructField("score", T.DoubleType())])
    kinds = to_arrow_schema(schema)
    for part in range(many):
        asked = queries.filter(F.pmod(F.xxhash64(*query_key), F.lit(many)) == part).toArrow()
        if not asked.num_rows:
            continue
        matrix = np.zeros((asked.num_rows, BUCKETS))
        for i, (b, w) in enumerate(zip(asked["buckets"].to_pylist(), asked["weights"].to_pylist(), strict=True)):
            matrix[i, b] = w
        sent = spark.sparkContext.broadcast((asked.select(query_key).combine_chunks(), matrix.T.copy()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, m = sent.value
            held = None  # (query, key columns, score) of the best so far
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    b = batch.slice(at, ROWS)
                    lists, rows = b.column(len(key)), np.zeros((b.num_rows, BUCKETS))
                    n = np.diff(np.asarray(lists.offsets))
                    rows[np.repeat(np.arange(b.num_rows), n), np.asarray(lists.flatten())] = np.asarray(b.column(len(key) + 1).flatten())
                    s = np.round(rows @ m, digits)
                    if threshold is None:
                        on = s > 0  # only vectors that share a bucket are found
                    else:
                        on = s >= threshold
                    if b.num_rows > k:  # what ties with the k-th best stays for now
                        on &= s >= np.partition(s, b.num_rows - k, axis=0)[b.num_rows - k]
                    r, q = np.nonzero(on)
                    new = pa.table([pa.array(q), *(b.column(i).take(pa.array(r)) for i in range(len(key))), pa.array(s[r, q])], names=["q", *key, "score"])
                    held = new if held is None else pa.concat_tables([held, new])
                    if held.num_rows > 4 * k * m.shape[1] + ROWS:
                        held = _best(held, k, key)
            if held is not None and held.num_rows:
                held = _best(held, k, key)
                asked_ = names.take(held["q"].combine_chunks())
                yield from pa.table([*(asked_[c] for c in query_key), *(held[c] for c in key), held["score"]], schema=kinds).combine_chunks().to_batches()

        found.append(chunks.select(*key, "buckets", "weights").mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema).select(*query_key, F.lit(1).alias("rank"), *key, "score")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    rank = F.row_number().over(Window.partitionBy(*query_key).orderBy(F.desc("score"), *key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(*query_key, "rank", *key, "score")


def _best(rows: pa.Table, k: int, key: list[str]) -> pa.Table:
    """The k best rows of each q, ties by key."""
    rows = rows.combine_chunks().sort_by([("q", "ascending"), ("score", "descending"), *((c, "ascending") for c in key)])
    q = np.asarray(rows["q"])
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def file_chunks(vectors: DataFrame, paths: DataFrame, per_file: int = 100) -> DataFrame:
    """The first chunks of the named files, each with score 1."""
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy("chunk_index"))
    out = vectors.join(paths.select("file_path").distinct(), "file_path", "left_semi").withColumn("_r", rank)
    return out.filter(F.col("_r") <= per_file).drop("_r").withColumn("score", F.lit(1.0))


def replace_files(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """new in place of all chunks of its files; (file_path, chunk_index) is the key, so doing it again changes nothing."""
    kept = vectors.join(new.select("file_path").distinct(), "file_path", "left_anti")
    return kept.unionByName(new.dropDuplicates(["file_path", "chunk_index"]))


def delete_files(vectors: DataFrame, paths: DataFrame) -> DataFrame:
    return vectors.join(paths.select("file_path").distinct(), "file_path", "left_anti")
