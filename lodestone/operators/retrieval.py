"""Candidates of a question: merged, fused, supplemented and ranked anew.

Hits are rows (query_id, source_rank, rank, file_path, chunk_index, text, score, file_type): source_rank numbers the
searches of a question in their order, rank the hits of a search. Every order has a tie-break down to the chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import columns as c

KEY = ["file_path", "chunk_index"]
Q = "query_id"


def first_seen(hits: DataFrame) -> DataFrame:
    """One row a chunk, as the first search that found it has it."""
    w = Window.partitionBy(Q, *KEY).orderBy("source_rank", "rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fuse(hits: DataFrame, boost: float = 0.2, most: float = 1.0, digits: int = 6) -> DataFrame:
    """One row a chunk: its best score, up by boost for each further hit, at most ``most``."""
    best = F.max_by(F.struct("text", "file_type"), F.struct("score", -F.col("source_rank"), -F.col("rank"))).alias("b")
    out = hits.groupBy(Q, *KEY).agg(F.max("score").alias("m"), F.count("*").alias("hits"), best)
    score = F.round(F.least(F.col("m") * (1 + F.lit(boost) * (F.col("hits") - 1)), F.lit(most)), digits)
    return out.select(Q, *KEY, "b.text", "b.file_type", "hits", score.alias("score"))


def ranked(hits: DataFrame) -> DataFrame:
    """rank by score, then chunk."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(Q).orderBy(F.desc("score"), *KEY)))


def rerank(hits: DataFrame, words: DataFrame, entity_weight: float = 0.30, word_weight: float = 0.08, digits: int = 6) -> DataFrame:
    """score + weights for the words of (query_id, keywords, entities) that a hit contains; keywords that are entities weigh as these."""
    where = c.searchable(F.col("text"), F.col("file_path"))
    names = F.filter("keywords", lambda k: F.array_contains("entities", k))
    others = F.filter("keywords", lambda k: ~F.array_contains("entities", k))
    out = hits.join(words, Q)
    gain = entity_weight * c.contained(where, names) + word_weight * c.contained(where, others)
    return out.withColumn("score", F.round(F.col("score") + gain, digits)).select(hits.columns)


def missing_keywords(hits: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, keyword: words that no hit contains, and every entity; without the plain forms of an entity. None for a question without hits."""
    where = c.searchable(F.col("text"), F.col("file_path"))
    each = words.select(Q, "entities", F.explode(F.array_distinct(F.concat("keywords", "entities"))).alias("keyword"))
    seen = hits.select(Q, where.alias("where")).join(each.select(Q, "keyword"), Q)
    seen = seen.groupBy(Q, "keyword").agg(F.max(F.contains("where", F.col("keyword"))).alias("seen"))
    entity = F.array_contains("entities", F.col("keyword"))
    plain = F.array_contains("entities", F.rtrim("keyword", F.lit("'s")))
    out = each.join(seen, [Q, "keyword"]).filter(entity | (~F.col("seen") & ~plain))
    return out.select(Q, "keyword")


def supplement_queries(missing: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, keyword, n, query: the four searches for each missing word."""
    k = F.col("keyword")
    rest = F.array_join(F.filter("keywords", lambda w: w != k), " ")
    texts = F.array(F.concat_ws(" ", k, rest), F.format_string("Dear %s email message from to", k), F.format_string("To %s From %s Subject", k, k), F.format_string("From: %s To: sent received message", k))
    return missing.join(words, Q).select(Q, "keyword", F.posexplode(texts).alias("n", "query"))


def supplemented(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """hits and the chunks of extra (with keyword) that they don't have and that contain the keyword."""
    new = extra.filter(F.contains(c.searchable(F.col("text"), F.col("file_path")), F.col("keyword")))
    new = first_seen(new.select(hits.columns)).join(hits.select(Q, *KEY).distinct(), [Q, *KEY], "left_anti")
    return hits.unionByName(new)


def depths(top_k: int | None, default: int = 10, queries: int = 1) -> dict[str, int]:
    """How deep each search goes for the k asked for."""
    k = top_k or default
    broad = max(4 * k, 60)
    return {"k": k, "original": max(k // 2, 5), "diverse": max(k, 15), "broad": broad, "each": max(broad // max(queries, 1), 20), "supplement": max(2 * k, 30)}
