"""Reports over the catalog."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import columns as c


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


def errors(files: DataFrame) -> DataFrame:
    return files.filter("status = 'error'")


def error_top(files: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent messages, with their share of all errors in percent."""
    by = errors(files).groupBy("error").agg(F.count("*").alias("n"))
    by = by.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
    return by.orderBy(F.desc("n"), F.asc_nulls_first("error")).limit(n)


def error_samples(files: DataFrame, per_group: int = 3) -> DataFrame:
    """The first paths of each message."""
    w = Window.partitionBy("error").orderBy("file_path")
    return errors(files).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_group).select("error", "r", "file_path")


def error_prefixes(files: DataFrame, chars: int = 50, n: int = 10) -> DataFrame:
    by = errors(files).groupBy(F.substring("error", 1, chars).alias("prefix")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), F.asc_nulls_first("prefix")).limit(n)


def error_categories(files: DataFrame, cases: list[tuple[str, list[str]]], otherwise: str) -> DataFrame:
    """Counts by the first case one of whose patterns an error is like, in any case of letters."""
    out = F.lit(otherwise)
    for name, patterns in reversed(cases):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | F.col("error").ilike(p)
        out = F.when(hit, name).otherwise(out)
    return errors(files).groupBy(out.alias("category")).agg(F.count("*").alias("n"))


def error_taxonomy(files: DataFrame, rules: list, empty: str, words: int | None = None, n: int = 10) -> DataFrame:
    """The commonest categories by ordered rules."""
    by = errors(files).groupBy(c.by_rules(F.col("error"), rules, empty, words).alias("category")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "category").limit(n)


def recency(files: DataFrame, now: float) -> DataFrame:
    t = F.col("indexed_at")
    bucket = F.when(t.isNull(), "Never processed").when(t > now - 3600, "Last hour").when(t > now - 86400, "Last day").otherwise("Older")
    return errors(files).groupBy(bucket.alias("timerange")).agg(F.count("*").alias("n"))


def latest(files: DataFrame, n: int, status: str | None = None, skip: int = 0) -> DataFrame:
    """The last files by time; those without one come last."""
    out = files.filter(F.col("status") == status) if status else files
    return out.orderBy(F.desc_nulls_last("indexed_at"), "file_path").offset(skip).limit(n)


def consistency(files: DataFrame) -> DataFrame:
    """Counts of rows whose columns contradict, in one scan."""
    has, e = F.coalesce(F.col("error"), F.lit("")) != "", F.col("status") == "error"
    tests = {
        "pending_with_error": (F.col("status") == "pending") & has,
        "indexed_with_error": (F.col("status") == "indexed") & has,
        "errors_with_text": e & has,
        "errors_without_text": e & ~has,
        "errors_never_indexed": e & F.col("indexed_at").isNull(),
        "errors_once_indexed": e & F.col("indexed_at").isNotNull(),
    }
    return files.agg(*(F.count_if(t).alias(k) for k, t in tests.items()))


def drift(files: DataFrame, vectors: DataFrame) -> DataFrame:
    """Files whose number of chunks in the store isn't the catalog's."""
    a = files.filter("status = 'indexed'").select("file_path", F.col("chunk_count").alias("in_catalog"))
    b = vectors.groupBy("file_path").agg(F.count("*").alias("in_store"))
    return a.join(b, "file_path", "full_outer").filter(~F.col("in_catalog").eqNullSafe(F.col("in_store")))


def errors_like(files: DataFrame, like: list[str] = (), unlike: list[str] = (), paths: list[list[str]] = (), n: int | None = None) -> DataFrame:
    """Errors that are like one of the patterns and like none of the others, in files whose path is like one of each list; the first n by path. An error without a message is like nothing, and unlike nothing."""
    out = errors(files)
    one_of = lambda col, patterns: reduce(lambda a, b: a | b, (F.col(col).like(x) for x in patterns))
    if like:
        out = out.filter(one_of("error", like))
    if unlike:
        out = out.filter(~one_of("error", unlike))
    for patterns in paths:
        out = out.filter(one_of("file_path", patterns))
    return out if n is None else out.orderBy("file_path").limit(n)


def error_shares(files: DataFrame, kinds: dict[str, list[str]], other: str) -> DataFrame:
    """kind, n, pct of all errors, by the first kind one of whose patterns an error is like; the rest, those without a message too, is other."""
    kind = F.lit(other)
    for name, patterns in reversed(kinds.items()):
        kind = F.when(F.coalesce(reduce(lambda a, b: a | b, (F.col("error").like(x) for x in patterns)), F.lit(False)), name).otherwise(kind)
    by = errors(files).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return by.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def timed(steps: list[tuple[str, Callable[[], object]]], limit: float = 60.0) -> list[dict]:
    """Each step's result, error or time-out, and seconds. A step that is over its limit is left to itself, and the rest isn't run."""
    out = []
    for name, f in steps:
        held: dict = {}

        def run(f=f, held=held) -> None:
            try:
                held["result"] = f()
            except Exception as e:  # noqa: BLE001  it is what is reported
                held["error"] = f"{type(e).__name__}: {e}"

        began, t = time.time(), threading.Thread(target=run, daemon=True)
        t.start()
        t.join(limit)
        state = "timeout" if t.is_alive() else "error" if "error" in held else "ok"
        out.append({"step": name, "state": state, "seconds": round(time.time() - began, 1), "error": held.get("error"), "result": held.get("result")})
        if state == "timeout":
            break
    return out


def sample(files: DataFrame, n: int, seed: int) -> DataFrame:
    """A sample of errors that a seed fixes."""
    return errors(files).orderBy(F.md5(F.concat("file_path", F.lit(str(seed)))), "file_path").limit(n)


def extrapolated(sampled: DataFrame, total: int, rules: list, empty: str) -> DataFrame:
    """The sample's categories and what they come to over all errors."""
    by = sampled.groupBy(c.by_rules(F.col("error"), rules, empty).alias("category")).agg(F.count("*").alias("n"))
    return by.withColumn("estimate", F.round(F.col("n") * F.lit(total) / F.sum("n").over(Window.partitionBy())).cast("long"))


def shares(stats: DataFrame) -> DataFrame:
    """Progress and success in percent of catalog.stats()."""
    done = F.col("indexed") + F.col("errors")
    return stats.withColumns({"progress_pct": F.round(100 * done / F.greatest("total", F.lit(1)), 1), "success_pct": F.round(100 * F.col("indexed") / F.greatest(done, F.lit(1)), 1)})
