"""What of the hits an answer sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import columns as c

KEY = ["file_path", "chunk_index"]
Q = "query_id"


def without_system_files(hits: DataFrame) -> DataFrame:
    return hits.filter(~c.is_system_path(F.col("file_path")))


def about_entities(hits: DataFrame, words: DataFrame) -> DataFrame:
    """Hits that contain an entity of their question; all, where none does."""
    where = c.searchable(F.col("text"), F.col("file_path"))
    out = hits.join(words.select(Q, "entities"), Q).withColumn("_on", c.contained(where, F.col("entities")) > 0)
    out = out.withColumn("_any", F.max("_on").over(Window.partitionBy(Q)))
    return out.filter(F.col("_on") | ~F.col("_any")).select(hits.columns)


def broad_context(hits: DataFrame, most: int = 40, per_file: int = 2) -> DataFrame:
    """The best of each file, then the second best, up to ``most``: pos."""
    in_file = F.row_number().over(Window.partitionBy(Q, "file_path").orderBy(F.desc("score"), "chunk_index"))
    best = F.max("score").over(Window.partitionBy(Q, "file_path"))
    out = hits.withColumns({"_r": in_file, "_b": best}).filter(F.col("_r") <= per_file)
    pos = F.row_number().over(Window.partitionBy(Q).orderBy("_r", F.desc("_b"), "file_path"))
    return out.withColumn("pos", pos).filter(F.col("pos") <= most).drop("_r", "_b")


def _files(hits: DataFrame) -> DataFrame:
    best = F.struct("score", -F.col("chunk_index"))
    return hits.groupBy(Q, "file_path").agg(F.max("score").alias("score"), F.max_by("file_type", best).alias("file_type"))


def _numbered(files: DataFrame, most: int, *order: Column) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy(Q).orderBy(*order, F.desc("score"), "file_path"))
    return files.withColumn("file_pos", pos).filter(F.col("file_pos") <= most).select(Q, "file_path", "file_pos")


def keyword_files(hits: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, file_path of the files with a hit that contains an entity, or, without entities, a keyword."""
    where = c.searchable(F.col("text"), F.col("file_path"))
    chosen = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.col("keywords"))
    return hits.join(words, Q).filter(c.contained(where, chosen) > 0).select(Q, "file_path").distinct()


def files_by_keyword(hits: DataFrame, preferred: DataFrame, most: int = 5) -> DataFrame:
    """Files to expand: those preferred (query_id, file_path) by score, then others."""
    out = _files(hits).join(preferred.select(Q, "file_path", F.lit(0).alias("_p")).distinct(), [Q, "file_path"], "left")
    return _numbered(out, most, F.coalesce("_p", F.lit(1)))


def files_by_diversity(hits: DataFrame, most: int = 5, diverse: int = 3) -> DataFrame:
    """Files to expand: up to three of other types than the commonest, then that type, then the other types again.

    Of types that are as common, the one that is first by name counts as the commonest.
    """
    files = _files(hits)
    n = files.groupBy(Q, "file_type").agg(F.count("*").alias("n"))
    common = n.groupBy(Q).agg(F.min(F.struct(-F.col("n"), "file_type"))["file_type"].alias("_t"))
    files = files.join(common, Q).withColumn("_d", ~F.col("file_type").eqNullSafe(F.col("_t")))
    rank = F.row_number().over(Window.partitionBy(Q, "_d").orderBy(F.desc("score"), "file_path"))
    group = F.when(F.col("_d") & (rank <= diverse), 0).when(~F.col("_d"), 1).otherwise(2)
    return _numbered(files.withColumn("_g", group), most, F.col("_g"))


def expand(hits: DataFrame, files: DataFrame, vectors: DataFrame, most: int = 40) -> DataFrame:
    """Chunks of the files to expand, in their order and up to a budget each and ``most`` in all; then the hits of other files, uncapped. pos orders them."""
    many = F.count("*").over(Window.partitionBy(Q))
    budget = F.greatest(F.floor(F.lit(most) / many), F.lit(4))
    chosen = files.withColumn("_budget", budget)
    got = vectors.select(*KEY, "text", "file_type").join(chosen, "file_path").withColumn("score", F.lit(1.0))
    got = got.withColumn("_r", F.row_number().over(Window.partitionBy(Q, "file_path").orderBy("chunk_index"))).filter("_r <= _budget")
    got = got.withColumn("pos", F.row_number().over(Window.partitionBy(Q).orderBy("file_pos", "chunk_index"))).filter(F.col("pos") <= most)
    rest = hits.join(files.select(Q, "file_path"), [Q, "file_path"], "left_anti")
    rest = rest.withColumn("pos", F.lit(1 << 20) + F.row_number().over(Window.partitionBy(Q).orderBy(F.desc("score"), *KEY)))
    cols = [Q, *KEY, "text", "file_type", "score"]
    out = got.select(*cols, "pos").unionByName(rest.select(*cols, "pos"))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(Q).orderBy("pos")))


def formatted(context: DataFrame) -> DataFrame:
    """query_id, context: a numbered header and the text of each row, in order of pos. A context has a bounded number of rows."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "file_path", "text")))
    text = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), x["file_path"], F.lit("]\n"), F.coalesce(x["text"], F.lit("")), F.lit("\n"))), "\n")
    return context.groupBy(Q).agg(parts.alias("p")).select(Q, text.alias("context"))


def ordered_sources(context: DataFrame) -> DataFrame:
    """query_id, n, file_path: each file once, in order of its first row."""
    first = context.groupBy(Q, "file_path").agg(F.min("pos").alias("pos"))
    return first.select(Q, F.row_number().over(Window.partitionBy(Q).orderBy("pos", "file_path")).alias("n"), "file_path")
