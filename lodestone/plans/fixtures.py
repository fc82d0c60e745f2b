"""Relations that stand for the model's tables, derived from the driver's tables: for Spark, and as SQL for the oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTS = [".txt", ".md", ".pdf", ".docx", ".msg", ".mp3", ".PNG", ".xyz"]
ERRORS = [None, "", "Failed to open MSG: x.msg: Unknown code page 950", "ffmpeg failed: exit 1", "no such file or directory", "Extraction TIMED OUT after 300 s", "Failed to transcribe audio: bad header", "Cannot extract MSG body", "Permission denied here", "weird thing happened in the reader today again"]
QUESTIONS = [
    "What email address have I used for jill",
    "jill's email and phone number",
    "show jills emails please",
    "find all software license codes",
    "Show me all the invoices from John Smith",
    "list my windows accounts",
    "everything about the garden",
    "every single order with the Acme company",
    "When is the meeting",
    "what is it",
    "Give me the address details regarding Anna-Maria O'Neil",
    "gather every certificate to date",
    "the students' results for the campus",
]
ANSWERS = [
    "Found:\n| File | Key |\n|---|---|\n| a.txt | ABC-1 |\n| b.txt | Not applicable |\n| c.txt | N/A |\nDone.",
    "All good.\n\nNote: some files do not contain a key.",
    "My notebook has no code.\n| Name | Grade |\n| Final | A |",
    "  | x | No key found |\nplain | N/A | text\n",
    "Nothing special\n\n**Note**: the rest was not visible\nin the scan.  ",
    "",
]
MODEL_LINES = ["1. order confirmation license key\n2) \"serial number code\"\n- `product key`\n* abc\n\n• registration code email\n   plain words here  ", "short\nx", "\n".join(f"{i}. query number {i}" for i in range(12))]
NOW = 1_600_000_000.0


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session of one machine that names none, as in tests, has a local one; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or "/tmp/checkpoints"


def table(spark: SparkSession, d: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def values(spark: SparkSession, rows: list, name: str) -> DataFrame:
    """(query_id, name) of a fixed list."""
    return spark.createDataFrame(list(enumerate(rows)), f"query_id long, {name} string")


def corpus(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """file_path, file_size, mtime of each document."""
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    return table(spark, d, "documents").select("doc_id", path.alias("file_path"), F.col("n_chars").alias("file_size"), F.col("doc_id").cast("double").alias("mtime"), *more)


def crawl(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select(F.col("file_path").alias("path"), F.col("file_size").alias("size"), "mtime")


def prior(spark: SparkSession, d: str) -> DataFrame:
    """The catalog before the crawl: some files new, some changed, some in error or pending, one ghost a source."""
    i = F.col("doc_id")
    status = F.when(i % 11 == 0, "error").when(i % 13 == 0, "pending").otherwise("indexed")
    known = corpus(spark, d).filter(i % 5 != 0).select("file_path", (F.col("file_size") + F.when(i % 7 == 0, 1).otherwise(0)).alias("file_size"), "mtime", F.lit(None).cast("string").alias("content_hash"), status.alias("status"), F.when(status == "indexed", F.lit(NOW) + i).alias("indexed_at"), F.when(status == "indexed", i % 9).otherwise(0).alias("chunk_count"), F.when(status == "error", "boom").alias("error"))
    ghosts = table(spark, d, "documents", "source").distinct().select(F.concat(F.lit("/corpus/"), "source", F.lit("/ghost.txt")).alias("file_path"), F.lit(1).cast("long").alias("file_size"), F.lit(1.0).alias("mtime"), F.lit(None).cast("string").alias("content_hash"), F.lit("indexed").alias("status"), F.lit(NOW).alias("indexed_at"), F.lit(1).cast("long").alias("chunk_count"), F.lit(None).cast("string").alias("error"))
    return known.unionByName(ghosts)


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """A large catalog from the orders."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "error").otherwise("pending")
    message = F.element_at(F.array(*(F.lit(e).cast("string") for e in ERRORS)), (k % 10 + 1).cast("int"))
    at = F.when(k % 3 != 0, F.lit(NOW) - (k % 1000) * 300)
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus").select(F.format_string("/orders/%d.msg", k).alias("file_path"), (k % 4096).alias("file_size"), k.cast("double").alias("mtime"), F.lit(None).cast("string").alias("content_hash"), status.alias("status"), at.alias("indexed_at"), (k % 7).alias("chunk_count"), F.when((status == "error") | (k % 50 == 2), message).alias("error"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of four questions, each found by one to three searches, over all documents and their whole texts."""
    i, s = F.col("doc_id"), F.col("source_rank")
    out = corpus(spark, d, "text").withColumn("source_rank", F.explode(F.sequence(F.lit(0), F.pmod(i, F.lit(3)).cast("int"))))
    score = F.round(((i * 37 + s * 101) % 997) / 1000.0, 6)
    path = F.concat(F.lit("/corpus/"), (i / 6).cast("long").cast("string"), F.element_at(F.array(*map(F.lit, EXTS)), ((i / 6).cast("long") % 8 + 1).cast("int")))
    kind = F.element_at(F.array(*map(F.lit, ["text", "pdf", "msg", "docx"])), ((i / 6).cast("long") % 4 + 1).cast("int"))
    return out.select((i % 4).alias("query_id"), "source_rank", i.cast("int").alias("rank"), path.alias("file_path"), (i % 6).cast("int").alias("chunk_index"), "text", score.alias("score"), kind.alias("file_type"))


def words(spark: SparkSession) -> DataFrame:
    rows = [(0, ["the", "jill", "zzz"], ["jill"]), (1, ["que", "and"], []), (2, ["the", "the", "tion"], ["tion"]), (3, ["qqq"], ["qqq"])]
    return spark.createDataFrame(rows, "query_id long, keywords array<string>, entities array<string>")


def _list(rows: list) -> str:
    return "[" + ", ".join("NULL" if r is None else "'" + r.replace("'", "''") + "'" for r in rows) + "]"


def _values(rows: list, name: str) -> str:
    return f"SELECT CAST(i - 1 AS BIGINT) AS query_id, l[i] AS {name} FROM (SELECT {_list(rows)} AS l, unnest(range(1, {len(rows) + 1})) AS i)"


SQL = {
    "corpus": f"corpus AS (SELECT doc_id, text, source, '/corpus/' || source || '/' || doc_id || {_list(EXTS)}[CAST(doc_id % 8 AS INT) + 1] AS file_path, n_chars AS file_size, CAST(doc_id AS DOUBLE) AS mtime FROM documents)",
    "prior": f"""prior0 AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'indexed' END AS st FROM corpus WHERE doc_id % 5 <> 0),
        prior AS (SELECT file_path, file_size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS file_size, mtime, CAST(NULL AS VARCHAR) AS content_hash, st AS status, CASE WHEN st = 'indexed' THEN {NOW} + doc_id END AS indexed_at, CASE WHEN st = 'indexed' THEN doc_id % 9 ELSE 0 END AS chunk_count, CASE WHEN st = 'error' THEN 'boom' END AS error FROM prior0
        UNION ALL SELECT DISTINCT '/corpus/' || source || '/ghost.txt', 1, 1.0, NULL, 'indexed', {NOW}, 1, NULL FROM documents)""",
    "files": f"""files0 AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'error' ELSE 'pending' END AS st FROM orders),
        files AS (SELECT '/orders/' || k || '.msg' AS file_path, k % 4096 AS file_size, CAST(k AS DOUBLE) AS mtime, CAST(NULL AS VARCHAR) AS content_hash, st AS status, CASE WHEN k % 3 <> 0 THEN {NOW} - (k % 1000) * 300 END AS indexed_at, k % 7 AS chunk_count, CASE WHEN st = 'error' OR k % 50 = 2 THEN {_list(ERRORS)}[CAST(k % 10 AS INT) + 1] END AS error FROM files0)""",
    "hits": f"""hits AS (SELECT doc_id % 4 AS query_id, CAST(s AS INT) AS source_rank, CAST(doc_id AS INT) AS rank, '/corpus/' || (doc_id // 6) || {_list(EXTS)}[CAST((doc_id // 6) % 8 AS INT) + 1] AS file_path, CAST(doc_id % 6 AS INT) AS chunk_index, text, round(((doc_id * 37 + s * 101) % 997) / 1000.0, 6) AS score, ['text', 'pdf', 'msg', 'docx'][CAST((doc_id // 6) % 4 AS INT) + 1] AS file_type FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS s FROM documents))""",
    "words": "words AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), ['the', 'jill', 'zzz'], ['jill']), (1, ['que', 'and'], CAST([] AS VARCHAR[])), (2, ['the', 'the', 'tion'], ['tion']), (3, ['qqq'], ['qqq'])) w(query_id, keywords, entities))",
    "questions": f"questions AS ({_values(QUESTIONS, 'question')})",
    "answers": f"answers AS ({_values(ANSWERS, 'answer')})",
    "lines": f"lines AS ({_values(MODEL_LINES, 'reply')})",
}


def sql(body: str, *names: str) -> str:
    """body after the named relations."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + "\n" + body if names else body
