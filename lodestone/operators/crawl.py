"""Which files are new or changed, and which are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.functions import fixed


def eligible(found: DataFrame, max_mb: int = fixed.GLOBAL_MAX_MB) -> DataFrame:
    """(path, size, mtime) of supported type, not empty, not over the global limit, with type and extension."""
    out = found.withColumn("extension", c.extension(F.col("path"))).withColumn("file_type", c.file_type(F.col("extension")))
    return out.filter(F.col("file_type").isNotNull() & (F.col("size") != 0) & (F.col("size") <= max_mb * 2**20))


def changed(crawl: DataFrame, files: DataFrame) -> DataFrame:
    """Crawled files that the catalog doesn't have, has with an error, or with another size or time. Pending ones aren't changed."""
    known = files.select(F.col("file_path").alias("path"), F.col("status").alias("_s"), F.col("file_size").alias("_n"), F.col("mtime").alias("_t"))
    test = F.col("_s").isNull() | (F.col("_s") == "error") | (F.col("size") != F.col("_n")) | (F.col("mtime") != F.col("_t"))
    return crawl.join(known, "path", "left").filter(test).drop("_s", "_n", "_t")


def deleted(files: DataFrame, disk: DataFrame, prefixes: list[str]) -> DataFrame:
    """Catalog paths under the prefixes that the disk no longer has."""
    return files.filter(c.under(F.col("file_path"), prefixes)).select("file_path").join(disk.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def reindex_set(files: DataFrame, queued: DataFrame) -> DataFrame:
    """Queued paths that are indexed by now: their chunks are replaced."""
    return queued.select("file_path").distinct().join(files.filter("status = 'indexed'").select("file_path"), "file_path", "left_semi")


def pending_resume(files: DataFrame, queued: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Pending files that aren't queued, typed anew and within their type's limit."""
    out = files.filter("status = 'pending'").join(queued.select("file_path").distinct(), "file_path", "left_anti")
    kind = c.file_type(c.extension(F.col("file_path")))
    return out.select("file_path", "file_size", "mtime", kind.alias("file_type")).filter(F.col("file_type").isNotNull() & ~c.too_large(F.col("file_type"), F.col("file_size"), limits))


def split_by_cost(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """lane: skipped_size, gpu or cpu."""
    lane = F.when(c.too_large(F.col("file_type"), F.col("size"), limits), "skipped_size").when(F.col("file_type").isin(fixed.GPU_TYPES), "gpu").otherwise("cpu")
    return files.withColumn("lane", lane)


def change_log(lines: DataFrame) -> DataFrame:
    """ts, action, path of the lines (value) that have the three parts; a path may hold the separator."""
    parts = F.split("value", r"\|", 3)
    return lines.select(parts.alias("p")).filter(F.size("p") == 3).select(F.get("p", F.lit(0)).alias("ts"), F.get("p", F.lit(1)).alias("action"), F.get("p", F.lit(2)).alias("path"))


def trim_log(lines: DataFrame, done: DataFrame) -> DataFrame:
    """Lines whose path isn't done; malformed lines go."""
    parts = F.split("value", r"\|", 3)
    with_path = lines.filter(F.size(parts) == 3).select("value", F.get(parts, F.lit(2)).alias("path"))
    return with_path.join(done.select("path").distinct(), "path", "left_anti").select("value")


def latest_changes(journal: DataFrame, mask: int = fixed.CONTENT_CHANGE) -> DataFrame:
    """The last record of each file reference, directories and deletions out."""
    wanted = journal.filter((F.col("reason").bitwiseAND(F.lit(mask)) != 0) & ~F.col("is_directory"))
    last = wanted.groupBy("ref").agg(F.max_by(F.struct("*"), F.col("usn")).alias("r")).select("r.*")
    return last.filter(~c.reason_has(F.col("reason"), "delete"))
