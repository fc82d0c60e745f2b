"""The registered queries over the derived relations, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import columns as c
from lodestone.functions import fixed
from lodestone.operators import catalog, chunk, context, crawl, diagnostics, embed, retrieval, vectors
from lodestone.plans import fixtures as fx
from lodestone.plans.fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *names: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle, *names)
        return f

    return add


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


TYPE = "CASE " + " ".join(f"WHEN lower(ext) IN {_in(e)} THEN '{k}'" for k, e in fixed.EXTENSIONS.items()) + " END"
LIMIT = "CASE file_type " + " ".join(f"WHEN '{k}' THEN {mb * 2**20}" for k, mb in fixed.TYPE_MAX_MB.items()) + f" ELSE {fixed.GLOBAL_MAX_MB * 2**20} END"
EXT = r"lower(regexp_extract({}, '[^./\\](\.[^./\\]+)$', 1))"
WHERE = "lower(coalesce(text, '') || ' ' || coalesce(file_path, ''))"
FILES = ["file_path", "file_size", "mtime", "content_hash", "status", "indexed_at", "chunk_count", "error"]
#: Sizes of the files of the size-guard query, so that each limit is met, passed and just kept.
BIG = 52_428_800
_SIZED = f"sized AS (SELECT *, {TYPE} AS file_type FROM (SELECT file_path, doc_id % 45 * {BIG} + doc_id % 2 AS size, {EXT.format('file_path')} AS ext FROM corpus))"
fx.SQL["sized"] = _SIZED


@query(f"SELECT ext AS extension, {TYPE} AS file_type, count(*) AS n FROM (SELECT {EXT.format('file_path')} AS ext FROM corpus) GROUP BY ALL", "corpus")
def ext_type_map(spark, d):
    e = c.extension(F.col("file_path"))
    return fx.corpus(spark, d).groupBy(e.alias("extension"), c.file_type(e).alias("file_type")).agg(F.count("*").alias("n"))


@query(f"SELECT path, size, mtime, ext AS extension, file_type FROM (SELECT file_path AS path, file_size AS size, mtime, ext, {TYPE} AS file_type FROM (SELECT *, {EXT.format('file_path')} AS ext FROM corpus)) WHERE file_type IS NOT NULL AND size <> 0 AND size <= 524288000", "corpus")
def crawl_eligible(spark, d):
    return crawl.eligible(fx.crawl(spark, d)).select("path", "size", "mtime", "extension", "file_type")


@query(f"SELECT CASE WHEN size > {LIMIT} THEN 'skipped_size' WHEN file_type IN ('audio', 'video') THEN 'gpu' ELSE 'cpu' END AS lane, file_type, count(*) AS n FROM sized GROUP BY ALL", "corpus", "sized")
def size_guard_counts(spark, d):
    i = F.col("doc_id")
    df = fx.corpus(spark, d).select(c.file_type(c.extension(F.col("file_path"))).alias("file_type"), (i % 45 * BIG + i % 2).alias("size"))
    return crawl.split_by_cost(df).groupBy("lane", "file_type").agg(F.count("*").alias("n"))


@query("SELECT c.file_path AS path, c.file_size AS size, c.mtime FROM corpus c LEFT JOIN prior p ON c.file_path = p.file_path WHERE p.file_path IS NULL OR p.status = 'error' OR p.file_size <> c.file_size OR p.mtime <> c.mtime", "corpus", "prior")
def change_detect(spark, d):
    return crawl.changed(fx.crawl(spark, d), fx.prior(spark, d)).select("path", "size", "mtime")


@query("SELECT file_path FROM prior WHERE starts_with(file_path, '/corpus/src1') AND file_path NOT IN (SELECT file_path FROM corpus)", "corpus", "prior")
def deleted_files(spark, d):
    return crawl.deleted(fx.prior(spark, d), fx.crawl(spark, d), ["/corpus/src1"])


@query("SELECT file_path FROM corpus WHERE file_size % 2 = 0 AND file_path IN (SELECT file_path FROM prior WHERE status = 'indexed')", "corpus", "prior")
def reindex_set(spark, d):
    return crawl.reindex_set(fx.prior(spark, d), fx.corpus(spark, d).filter("file_size % 2 = 0"))


@query(f"SELECT * FROM (SELECT file_path, file_size, mtime, {TYPE} AS file_type FROM (SELECT *, {EXT.format('file_path')} AS ext FROM prior WHERE status = 'pending' AND file_path NOT IN (SELECT file_path FROM corpus WHERE file_size % 2 = 0))) WHERE file_type IS NOT NULL AND file_size <= {LIMIT}", "corpus", "prior")
def pending_resume(spark, d):
    return crawl.pending_resume(fx.prior(spark, d), fx.corpus(spark, d).filter("file_size % 2 = 0"))


@query("SELECT * FROM prior WHERE file_path NOT IN (SELECT file_path FROM corpus WHERE file_size % 3 = 0) UNION ALL SELECT file_path, file_size, mtime, NULL, 'pending', NULL, 0, NULL FROM corpus WHERE file_size % 3 = 0", "corpus", "prior")
def catalog_upsert(spark, d):
    return catalog.upsert(fx.prior(spark, d), fx.corpus(spark, d).filter("file_size % 3 = 0").select("file_path", "file_size", "mtime"))


@query(
    """SELECT p.file_path, p.file_size, p.mtime, p.content_hash, CASE WHEN c.doc_id % 3 = 0 THEN 'indexed' WHEN c.doc_id % 3 = 1 THEN 'error' WHEN p.status = 'error' THEN 'pending' ELSE p.status END AS status,
    CASE WHEN c.doc_id % 3 = 0 THEN 1700000000.0 ELSE p.indexed_at END AS indexed_at, CASE WHEN c.doc_id % 3 = 0 THEN c.doc_id % 4 ELSE p.chunk_count END AS chunk_count,
    CASE WHEN c.doc_id % 3 = 0 THEN NULL WHEN c.doc_id % 3 = 1 THEN 'failed' WHEN p.status = 'error' THEN NULL ELSE p.error END AS error FROM prior p LEFT JOIN corpus c ON p.file_path = c.file_path""",
    "corpus",
    "prior",
)
def mark_indexed_error(spark, d):
    got = fx.corpus(spark, d)
    now = catalog.reset_errors(fx.prior(spark, d))
    now = catalog.mark_indexed(now, got.filter("doc_id % 3 = 0").select("file_path", (F.col("doc_id") % 4).alias("n")), 1_700_000_000.0)
    return catalog.mark_error(now, got.filter("doc_id % 3 = 1").select("file_path", F.lit("failed").alias("message")))


REASONS = {"signup": 0x100, "purchase": 0x1, "click": 0x2, "view": 0x8000, "error": 0x200}


@query("SELECT ref, usn, reason FROM (SELECT user_id AS ref, event_id AS usn, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REASONS.items()) + " ELSE 0 END AS reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type IN " + _in(list(REASONS)) + ") WHERE r = 1 AND reason <> 512")
def journal_latest(spark, d):
    reason = F.coalesce(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("event_type")], F.lit(0)).cast("long")
    journal = fx.table(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").alias("ref"), F.col("event_id").alias("usn"), reason.alias("reason"), F.lit(False).alias("is_directory"))
    return crawl.latest_changes(journal).select("ref", "usn", "reason")


LINE = "CASE event_id % 9 WHEN 0 THEN 'broken' WHEN 1 THEN event_type || '|only two' ELSE event_id || '|' || event_type || '|/u/' || user_id || CASE WHEN event_id % 4 = 0 THEN '|x' ELSE '' END END"
PARTS = r"'^([^|]*)\|([^|]*)\|(.*)$'"


def _log(spark, d):
    return fx.table(spark, d, "events", "event_id", "user_id", "event_type").select(F.expr(LINE).alias("value"))


@query(f"SELECT regexp_extract(v, {PARTS}, 1) AS ts, regexp_extract(v, {PARTS}, 2) AS action, regexp_extract(v, {PARTS}, 3) AS path FROM (SELECT {LINE} AS v FROM events) WHERE regexp_matches(v, {PARTS})")
def changelog_parse(spark, d):
    return crawl.change_log(_log(spark, d))


@query(f"SELECT v AS value FROM (SELECT {LINE} AS v FROM events) WHERE regexp_matches(v, {PARTS}) AND regexp_extract(v, {PARTS}, 3) NOT IN (SELECT '/u/' || c_custkey FROM customer)")
def changelog_trim(spark, d):
    return crawl.trim_log(_log(spark, d), fx.table(spark, d, "customer", F.format_string("/u/%d", "c_custkey").alias("path")))


MAP = {"/corpus/src1": "D:\\data", "/corpus": "/mnt/host/", "/corpus/src2": "E:\\"}
_WINDOWS = "replace(ltrim(substr(file_path, 13), '/\\'), '/', '\\')"


@query(f"SELECT file_path, CASE WHEN starts_with(file_path, '/corpus/src1') THEN 'D:\\data\\' || {_WINDOWS} WHEN starts_with(file_path, '/corpus/src2') THEN 'E:\\' || {_WINDOWS} ELSE '/mnt/host/' || ltrim(substr(file_path, 8), '/\\') END AS host_path FROM corpus", "corpus")
def path_translate(spark, d):
    return fx.corpus(spark, d).select("file_path", c.translate_path(F.col("file_path"), MAP).alias("host_path"))


@query("SELECT p AS host_path, CASE WHEN starts_with(f, '/mnt/host') THEN '/corpus/' || ltrim(substr(f, 10), '/') WHEN starts_with(f, 'D:/data') THEN '/corpus/src1/' || ltrim(substr(f, 8), '/') WHEN starts_with(f, 'E:') THEN '/corpus/src2/' || ltrim(substr(f, 3), '/') ELSE p END AS file_path FROM (SELECT p, replace(p, '\\', '/') AS f FROM (SELECT ['D:\\data\\', 'E:\\x\\', '/mnt/host/', 'F:\\'][CAST(doc_id % 4 AS INT) + 1] || doc_id AS p FROM documents))")
def path_reverse(spark, d):
    roots = F.array(*map(F.lit, ["D:\\data\\", "E:\\x\\", "/mnt/host/", "F:\\"]))
    path = F.concat(F.element_at(roots, (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string"))
    return fx.table(spark, d, "documents", path.alias("host_path")).select("host_path", c.reverse_path(F.col("host_path"), MAP).alias("file_path"))


_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_SEPS = ["E'\\n\\n'", "E'\\n'", "'. '", "'? '", "'! '", "'; '", "', '", "' '"]
_LAST = ", ".join(f"CASE WHEN strpos(reverse(w), reverse({s})) > 0 THEN o + 500 + length(w) - strpos(reverse(w), reverse({s})) + 1 END" for s in _SEPS)
CHUNK_CTE = f"""
steps AS (
    SELECT file_path, text, n, CAST(0 AS BIGINT) AS o, CAST(-1 AS BIGINT) AS emitted, CAST(-1 AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS piece, CAST(-1 AS BIGINT) AS start, false AS done FROM (SELECT file_path, text, length(text) AS n FROM corpus) WHERE n > 1000 AND regexp_matches(text, '\\S')
    UNION ALL
    SELECT file_path, text, n, CASE WHEN e - 200 > emitted2 THEN e - 200 ELSE e END, emitted2, CASE WHEN piece2 <> '' THEN idx + 1 ELSE idx END, piece2, o, e >= n
    FROM (SELECT *, CASE WHEN piece2 <> '' THEN o ELSE emitted END AS emitted2 FROM (SELECT *, {_STRIP.format("substring(text, o + 1, e - o)")} AS piece2 FROM (SELECT *, CASE WHEN o + 1000 >= n THEN n ELSE coalesce({_LAST}, o + 1000) END AS e FROM (SELECT *, substring(text, o + 501, least(500, n - o - 500)) AS w FROM steps WHERE NOT done))))
),
chunks AS (SELECT file_path AS source_file, CAST(idx AS INT) AS chunk_index, CAST(start AS INT) AS char_offset, piece AS text FROM steps WHERE piece <> ''
    UNION ALL SELECT file_path, 0, 0, text FROM corpus WHERE length(text) <= 1000 AND regexp_matches(text, '\\S'))"""
fx.SQL["chunks"] = CHUNK_CTE.strip()


def _chunks(spark, d):
    return chunk.chunk(fx.corpus(spark, d, "text"))


@query("SELECT source_file, chunk_index, char_offset, text FROM chunks", "corpus", "chunks")
def chunk_documents(spark, d):
    return _chunks(spark, d)


@query("SELECT source_file, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, max(char_offset) AS last_offset FROM chunks GROUP BY 1", "corpus", "chunks")
def chunk_stats(spark, d):
    return _chunks(spark, d).groupBy("source_file").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("char_offset").alias("last_offset"))


@query("SELECT file_path, chunk_index, substr(text, 1, 200) AS preview, regexp_extract(file_path, '([^/]*)$', 1) AS file_name, round(score, 4) AS score, coalesce(file_type, 'unknown') AS file_type FROM hits", "hits")
def payload_project(spark, d):
    return fx.hits(spark, d).select("file_path", "chunk_index", F.substring("text", 1, 200).alias("preview"), c.basename(F.col("file_path")).alias("file_name"), F.round("score", 4).alias("score"), F.coalesce("file_type", F.lit("unknown")).alias("file_type"))


def _sparse(name: str, rel: str, key: str) -> str:
    return f"""{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM {rel}),
    {name}_c AS (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS n FROM {name}_t GROUP BY ALL),
    {name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {name}_c)"""


fx.SQL["dv"] = _sparse("dv", "documents", "doc_id")
fx.SQL["qv"] = _sparse("qv", "benchmark", "item_id")
fx.SQL["cv"] = _sparse("cv", "chunks", "source_file, chunk_index")


@query("SELECT doc_id, bucket, round(w, 6) AS w FROM dv", "dv")
def embed_hashed(spark, d):
    return embed.hashed(fx.table(spark, d, "documents", "doc_id", "text"), ["doc_id"]).select("doc_id", "bucket", F.round("w", 6).alias("w"))


def _first(spark, d):
    return [float(x) for x in fx.table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]]


COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_Q0 = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT vec_id, label, score FROM (SELECT e.vec_id, e.label, {COS} AS score FROM embeddings e, {_Q0}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return vectors.top_k(fx.table(spark, d, "embeddings"), _first(spark, d), 10, ["vec_id"], 0.1).select("vec_id", "label", "score")


@query(f"SELECT vec_id, label, score FROM (SELECT e.vec_id, e.label, {COS} AS score FROM embeddings e, {_Q0}) WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_include(spark, d):
    return vectors.top_k(vectors.matching(fx.table(spark, d, "embeddings"), {"label": 1}), _first(spark, d), 10, ["vec_id"]).select("vec_id", "label", "score")


@query(f"SELECT vec_id, label, score FROM (SELECT e.vec_id, e.label, {COS} AS score FROM embeddings e, {_Q0}) WHERE label IS NULL OR label NOT IN (0, 2) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_exclude(spark, d):
    return vectors.top_k(vectors.matching(fx.table(spark, d, "embeddings"), None, {"label": [0, 2]}), _first(spark, d), 10, ["vec_id"]).select("vec_id", "label", "score")


@query(f"SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id, {COS} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE r <= 10")
def vector_topk_batch(spark, d):
    v = fx.table(spark, d, "embeddings")
    return vectors.top_k_batch(v, v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("SELECT query_id, CAST(r AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT qv.item_id AS query_id, dv.doc_id, round(sum(dv.w * qv.w), 6) AS score FROM dv JOIN qv USING (bucket) GROUP BY ALL) WHERE score >= 0.3) WHERE r <= 15", "dv", "qv")
def semantic_search(spark, d):
    q = embed.hashed_rows(fx.table(spark, d, "benchmark", F.col("item_id").alias("query_id"), "text"), ["query_id"])
    v = embed.hashed_rows(fx.table(spark, d, "documents", "doc_id", "text"), ["doc_id"])
    return vectors.sparse_top_k(v, q, ["doc_id"], ["query_id"], 15, 0.3)


fx.SQL["store"] = "store AS (SELECT file_path, chunk_index, min(text) AS text, min(file_type) AS file_type FROM hits GROUP BY ALL)"


def _store(spark, d):
    return fx.hits(spark, d).groupBy("file_path", "chunk_index").agg(F.min("text").alias("text"), F.min("file_type").alias("file_type"))


@query("SELECT file_path, chunk_index, text, file_type, 1.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY chunk_index) AS r FROM store WHERE file_path IN (SELECT file_path FROM hits WHERE query_id = 1 AND score > 0.5)) WHERE r <= 4", "hits", "store")
def file_chunks_fetch(spark, d):
    return vectors.file_chunks(_store(spark, d), fx.hits(spark, d).filter("query_id = 1 AND score > 0.5"), 4).select("file_path", "chunk_index", "text", "file_type", "score")


@query(f"SELECT query_id, regexp_matches(question, '{fixed.BROAD}', 'i') AS broad FROM questions", "questions")
def broad_detect(spark, d):
    return fx.values(spark, fx.QUESTIONS, "question").select("query_id", c.is_broad(F.col("question")).alias("broad"))


_KEYWORD = fixed.KEYWORD.replace("'", "''")
KW = f"list_filter(regexp_extract_all(lower(question), '{_KEYWORD}'), lambda x: x NOT IN {_in(fixed.STOP_WORDS)} AND length(x) > 1)"


@query(f"SELECT query_id, array_to_string({KW}, ',') AS keywords FROM questions", "questions")
def query_keywords(spark, d):
    return fx.values(spark, fx.QUESTIONS, "question").select("query_id", F.array_join(c.keywords(F.col("question")), ",").alias("keywords"))


def _all(rx: str, group: int) -> str:
    return f"regexp_extract_all(question, '{rx.replace(chr(39), chr(39) * 2)}', {group}, 'i')"


ENT = f"""list_filter(list_transform(list_concat(list_concat(flatten(list_transform({_all(fixed.AFTER_PREPOSITION, 1)}, lambda x: regexp_split_to_array(trim(x), '\\s+'))), {_all(fixed.POSSESSIVE, 1)}),
    list_transform(list_filter(list_zip({_all(fixed.POSSESSIVE_S, 1)}, {_all(fixed.POSSESSIVE_S, 2)}), lambda p: lower(p[2]) IN {_in(fixed.ATTRIBUTE_NOUNS)} AND (lower(p[1]) || 's') NOT IN {_in(fixed.COMMON_WORDS_S)}), lambda p: p[1])),
    lambda w: regexp_replace(rtrim(lower(w), ''''), '''s$', '')), lambda x: x NOT IN {_in(fixed.STOP_WORDS)} AND length(x) > 1)"""


@query(f"SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS entities FROM (SELECT query_id, {ENT} AS l FROM questions)", "questions")
def query_entities(spark, d):
    return fx.values(spark, fx.QUESTIONS, "question").select("query_id", F.array_join(c.entities(F.col("question")), ",").alias("entities"))


@query("SELECT query_id, array_to_string(list_filter(list_transform(string_split(reply, E'\\n'), lambda s: trim(trim(regexp_replace(regexp_replace(trim(s), '^\\d+[.)]\\s*', ''), '^[-*•]\\s*', ''), '\"''`'))), lambda s: length(s) > 5 AND length(s) < 500)[1:8], '/') AS queries FROM lines", "lines")
def expansion_lines(spark, d):
    return fx.values(spark, fx.MODEL_LINES, "reply").select("query_id", F.array_join(c.expansion_lines(F.col("reply")), "/").alias("queries"))


@query("SELECT query_id, file_path, chunk_index, score, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, chunk_index ORDER BY source_rank, rank) AS r FROM hits) WHERE r = 1", "hits")
def focused_merge(spark, d):
    return retrieval.first_seen(fx.hits(spark, d)).select("query_id", "file_path", "chunk_index", "score", "source_rank")


@query("SELECT query_id, file_path, chunk_index, count(*) AS hits, round(least(max(score) * (1 + 0.2::DOUBLE * (count(*) - 1)), 1.0), 6) AS score FROM (SELECT * REPLACE (CAST(score AS DOUBLE) AS score) FROM hits) GROUP BY ALL", "hits")
def rank_fusion(spark, d):
    return retrieval.fuse(fx.hits(spark, d)).select("query_id", "file_path", "chunk_index", "hits", "score")


@query(f"SELECT DISTINCT w.query_id, w.keyword FROM (SELECT query_id, entities, unnest(list_concat(keywords, entities)) AS keyword FROM words) w JOIN (SELECT query_id, {WHERE} AS t FROM hits) h ON h.query_id = w.query_id GROUP BY w.query_id, w.keyword, w.entities HAVING list_contains(w.entities, w.keyword) OR (NOT bool_or(contains(t, w.keyword)) AND NOT list_contains(w.entities, rtrim(w.keyword, '''s')))", "hits", "words")
def keyword_coverage(spark, d):
    return retrieval.missing_keywords(fx.hits(spark, d), fx.words(spark))


@query(f"SELECT h.query_id, source_rank, file_path, chunk_index, round(CAST(score AS DOUBLE) + 0.3::DOUBLE * len(list_filter(keywords, lambda k: list_contains(entities, k) AND contains({WHERE}, k))) + 0.08::DOUBLE * len(list_filter(keywords, lambda k: NOT list_contains(entities, k) AND contains({WHERE}, k))), 6) AS score FROM hits h JOIN words USING (query_id)", "hits", "words")
def keyword_rerank(spark, d):
    return retrieval.rerank(fx.hits(spark, d), fx.words(spark)).select("query_id", "source_rank", "file_path", "chunk_index", "score")


fx.SQL["filebest"] = "filebest AS (SELECT query_id, file_path, max(score) AS score, arg_max(file_type, (score, -chunk_index)) AS file_type FROM hits GROUP BY ALL)"
_EXPAND = """, budget AS (SELECT *, greatest(40 // count(*) OVER (PARTITION BY query_id), 4) AS b FROM chosen),
    got AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_pos, chunk_index) AS pos FROM (SELECT c.query_id, c.file_path, c.file_pos, s.chunk_index, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY c.query_id, c.file_path ORDER BY s.chunk_index) AS r, c.b FROM budget c JOIN store s ON s.file_path = c.file_path) WHERE r <= b),
    rest AS (SELECT h.query_id, h.file_path, h.chunk_index, h.score::DOUBLE AS score, 1000000 + row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.file_path, h.chunk_index) AS pos FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, chunk_index ORDER BY source_rank, rank) AS fr FROM hits) WHERE fr = 1) h ANTI JOIN chosen c ON c.query_id = h.query_id AND c.file_path = h.file_path)
    SELECT query_id, file_path, chunk_index, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INT) AS pos FROM (SELECT query_id, file_path, chunk_index, score, pos FROM got WHERE pos <= 40 UNION ALL SELECT * FROM rest)"""


def _merged(spark, d):
    return retrieval.first_seen(fx.hits(spark, d))


fx.SQL["first_hits"] = "h0 AS (SELECT * EXCLUDE (fr) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, chunk_index ORDER BY source_rank, rank) AS fr FROM hits) WHERE fr = 1), filebest0 AS (SELECT query_id, file_path, max(score) AS score, arg_max(file_type, (score, -chunk_index)) AS file_type FROM h0 GROUP BY ALL)"
fx.SQL["by_keyword"] = f"kwf AS (SELECT DISTINCT h.query_id, file_path FROM h0 h JOIN words w USING (query_id) WHERE len(list_filter(CASE WHEN len(entities) > 0 THEN entities ELSE keywords END, lambda k: contains({WHERE}, k))) > 0), chosen AS (SELECT query_id, file_path, file_pos FROM (SELECT f.*, row_number() OVER (PARTITION BY f.query_id ORDER BY (k.file_path IS NULL), f.score DESC, f.file_path) AS file_pos FROM filebest0 f LEFT JOIN kwf k ON k.query_id = f.query_id AND k.file_path = f.file_path) WHERE file_pos <= 5)"
fx.SQL["by_diversity"] = "ty AS (SELECT query_id, file_type, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, file_type) AS r FROM filebest0 GROUP BY query_id, file_type), dd AS (SELECT f.*, f.file_type <> t.file_type AS d FROM filebest0 f JOIN ty t ON t.query_id = f.query_id AND t.r = 1), gg AS (SELECT *, CASE WHEN d AND row_number() OVER (PARTITION BY query_id, d ORDER BY score DESC, file_path) <= 3 THEN 0 WHEN NOT d THEN 1 ELSE 2 END AS g FROM dd), chosen AS (SELECT query_id, file_path, file_pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, score DESC, file_path) AS file_pos FROM gg) WHERE file_pos <= 5)"


def _expanded(hits, files, store):
    return context.expand(hits, files, store).select("query_id", "file_path", "chunk_index", "score", F.col("pos").cast("int").alias("pos"))


@query(_EXPAND.lstrip(), "hits", "words", "store", "first_hits", "by_keyword")
def file_expand_keyword(spark, d):
    h = _merged(spark, d)
    return _expanded(h, context.files_by_keyword(h, context.keyword_files(h, fx.words(spark))), _store(spark, d))


@query(_EXPAND.lstrip(), "hits", "store", "first_hits", "by_diversity")
def file_expand_diverse(spark, d):
    h = _merged(spark, d)
    return _expanded(h, context.files_by_diversity(h), _store(spark, d))


_BROAD = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r, b DESC, file_path) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, chunk_index) AS r, max(score) OVER (PARTITION BY query_id, file_path) AS b FROM h0) WHERE r <= 2"


@query(f"SELECT query_id, file_path, chunk_index, CAST(pos AS INT) AS pos FROM ({_BROAD}) WHERE pos <= 40", "hits", "first_hits")
def broad_context(spark, d):
    return context.broad_context(_merged(spark, d)).select("query_id", "file_path", "chunk_index", "pos")


_SYSTEM = "SELECT file_path FROM (SELECT CASE doc_id % 6 WHEN 0 THEN '/a/node_modules/' WHEN 1 THEN '/a/.git/' WHEN 2 THEN '/a/QDRANT_DATA/' WHEN 3 THEN '/a/.github/' ELSE '/a/' END || doc_id AS file_path FROM documents)"


@query(f"SELECT * FROM ({_SYSTEM}) WHERE NOT regexp_matches(file_path, '{fixed.SYSTEM_PATH}', 'i')")
def system_path_filter(spark, d):
    i = F.col("doc_id")
    folder = F.when(i % 6 == 0, "/a/node_modules/").when(i % 6 == 1, "/a/.git/").when(i % 6 == 2, "/a/QDRANT_DATA/").when(i % 6 == 3, "/a/.github/").otherwise("/a/")
    return context.without_system_files(fx.table(spark, d, "documents", F.concat(folder, i.cast("string")).alias("file_path")))


@query(f"SELECT query_id, source_rank, file_path, chunk_index FROM (SELECT *, bool_or(on_) OVER (PARTITION BY query_id) AS any_ FROM (SELECT h.*, len(list_filter(entities, lambda k: contains({WHERE}, k))) > 0 AS on_ FROM hits h JOIN words USING (query_id))) WHERE on_ OR NOT any_", "hits", "words")
def entity_context_filter(spark, d):
    return context.about_entities(fx.hits(spark, d), fx.words(spark)).select("query_id", "source_rank", "file_path", "chunk_index")


@query(f"SELECT query_id, string_agg('[Source ' || pos || ': ' || file_path || ']' || chr(10) || text || chr(10), chr(10) ORDER BY pos) AS context FROM ({_BROAD}) WHERE pos <= 40 GROUP BY 1", "hits", "first_hits")
def format_context(spark, d):
    return context.formatted(context.broad_context(_merged(spark, d)))


@query(f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, file_path) AS INT) AS n, file_path FROM (SELECT query_id, file_path, min(pos) AS p FROM ({_BROAD}) WHERE pos <= 40 GROUP BY ALL)", "hits", "first_hits")
def ordered_sources(spark, d):
    return context.ordered_sources(context.broad_context(_merged(spark, d)))


_ROW, _NOTE = (x.replace("'", "''") for x in (fixed.NOTHING_ROW, fixed.DISCLAIMER))


@query(f"SELECT query_id, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(answer, E'\\n'), lambda s: NOT (starts_with(trim(s), '|') AND regexp_matches(s, '{_ROW}', 'i'))), E'\\n'), '{_NOTE}', '', 'is'), '\\s+$', '') AS answer FROM answers", "answers")
def clean_answer(spark, d):
    return fx.values(spark, fx.ANSWERS, "answer").select("query_id", c.clean_answer(F.col("answer")).alias("answer"))


_STATS = "count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status IN {}) AS pending, CAST(coalesce(sum(chunk_count) FILTER (status = 'indexed'), 0) AS BIGINT) AS total_chunks FROM files"


@query("SELECT " + _STATS.format("('pending')"), "files")
def catalog_stats(spark, d):
    return catalog.stats(fx.catalog(spark, d))


@query("SELECT *, round(100 * (indexed + errors) / total, 1) AS progress_pct, round(100 * indexed / (indexed + errors), 1) AS success_pct FROM (SELECT " + _STATS.format("('pending', 'processing')") + ")", "files")
def dashboard_stats(spark, d):
    return diagnostics.shares(catalog.stats(fx.catalog(spark, d), stuck_is_pending=True))


@query("SELECT status, count(*) AS n FROM files GROUP BY 1", "files")
def status_counts(spark, d):
    return diagnostics.status_counts(fx.catalog(spark, d))


@query("SELECT DISTINCT status FROM files", "files")
def distinct_status(spark, d):
    return fx.catalog(spark, d).select("status").distinct()


@query("SELECT error, n, round(100 * n / sum(n) OVER (), 4) AS pct FROM (SELECT error, count(*) AS n FROM files WHERE status = 'error' GROUP BY 1) ORDER BY n DESC, error NULLS FIRST LIMIT 20", "files")
def error_topn_pct(spark, d):
    return diagnostics.error_top(fx.catalog(spark, d))


@query("SELECT error, CAST(r AS INT) AS r, file_path FROM (SELECT error, file_path, row_number() OVER (PARTITION BY error ORDER BY file_path) AS r FROM files WHERE status = 'error') WHERE r <= 3", "files")
def error_samples(spark, d):
    return diagnostics.error_samples(fx.catalog(spark, d))


@query("SELECT substr(error, 1, 20) AS prefix, count(*) AS n FROM files WHERE status = 'error' GROUP BY 1 ORDER BY n DESC, prefix NULLS FIRST LIMIT 10", "files")
def error_prefix(spark, d):
    return diagnostics.error_prefixes(fx.catalog(spark, d), 20)


@query("SELECT CASE WHEN error ILIKE '%No such file%' THEN 'not downloaded' WHEN error ILIKE '%Failed to transcribe audio%' THEN 'audio' WHEN error ILIKE '%extract MSG%' THEN 'msg' ELSE 'other' END AS category, count(*) AS n FROM files WHERE status = 'error' GROUP BY 1", "files")
def error_category(spark, d):
    return diagnostics.error_categories(fx.catalog(spark, d), [("not downloaded", ["%No such file%"]), ("audio", ["%Failed to transcribe audio%"]), ("msg", ["%extract MSG%"])], "other")


def _rules(rules: list, empty: str, otherwise: str) -> str:
    said = lambda k, r: f"'{k}: ' || coalesce(nullif(trim(regexp_extract(error, '{r[0]}', 1)), ''), 'unknown reason')" if r else f"'{k}'"
    cases = " ".join("WHEN " + " OR ".join([f"contains(error, '{x}')" for x in a] + [f"contains(lower(error), '{x}')" for x in b]) + f" THEN {said(k, r)}" for k, a, b, *r in rules)
    return f"CASE WHEN coalesce(error, '') = '' THEN '{empty}' {cases} ELSE {otherwise} END"


@query(f"SELECT {_rules(fixed.ERROR_RULES, 'NULL/empty error', 'substr(error, 1, 80)')} AS category, count(*) AS n FROM files WHERE status = 'error' GROUP BY 1 ORDER BY n DESC, category LIMIT 10", "files")
def error_taxonomy(spark, d):
    return diagnostics.error_taxonomy(fx.catalog(spark, d), fixed.ERROR_RULES, "NULL/empty error")


_WORDS5 = r"'Other: ' || array_to_string(regexp_split_to_array(trim(error), '\s+')[1:5], ' ') || '...'"


@query(f"SELECT {_rules(fixed.EXTRACTION_RULES, 'Empty/NULL error message', _WORDS5)} AS category, count(*) AS n FROM files WHERE status = 'error' GROUP BY 1 ORDER BY n DESC, category LIMIT 10", "files")
def error_extraction_taxonomy(spark, d):
    return diagnostics.error_taxonomy(fx.catalog(spark, d), fixed.EXTRACTION_RULES, "Empty/NULL error message", words=5)


@query(f"SELECT CASE WHEN indexed_at IS NULL THEN 'Never processed' WHEN indexed_at > {fx.NOW - 3600} THEN 'Last hour' WHEN indexed_at > {fx.NOW - 86400} THEN 'Last day' ELSE 'Older' END AS timerange, count(*) AS n FROM files WHERE status = 'error' GROUP BY 1", "files")
def recency_buckets(spark, d):
    return diagnostics.recency(fx.catalog(spark, d), fx.NOW)


@query("SELECT file_path, indexed_at, error FROM files WHERE status = 'error' ORDER BY indexed_at DESC NULLS LAST, file_path LIMIT 20", "files")
def recent_errors(spark, d):
    return diagnostics.latest(fx.catalog(spark, d), 20, "error").select("file_path", "indexed_at", "error")


@query("SELECT file_path, status FROM files ORDER BY indexed_at DESC NULLS LAST, file_path LIMIT 10 OFFSET 25", "files")
def limit_offset(spark, d):
    return diagnostics.latest(fx.catalog(spark, d), 10, skip=25).select("file_path", "status")


@query("SELECT count(*) FILTER (status = 'pending' AND has) AS pending_with_error, count(*) FILTER (status = 'indexed' AND has) AS indexed_with_error, count(*) FILTER (status = 'error' AND has) AS errors_with_text, count(*) FILTER (status = 'error' AND NOT has) AS errors_without_text, count(*) FILTER (status = 'error' AND indexed_at IS NULL) AS errors_never_indexed, count(*) FILTER (status = 'error' AND indexed_at IS NOT NULL) AS errors_once_indexed FROM (SELECT *, coalesce(error, '') <> '' AS has FROM files)", "files")
def consistency_counts(spark, d):
    return diagnostics.consistency(fx.catalog(spark, d))


@query("SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(in_catalog, -1) AS in_catalog, coalesce(in_store, -1) AS in_store FROM (SELECT file_path, chunk_count AS in_catalog FROM files WHERE status = 'indexed') a FULL JOIN (SELECT '/orders/' || l_orderkey || '.msg' AS file_path, count(*) AS in_store FROM lineitem GROUP BY 1) b ON a.file_path = b.file_path WHERE in_catalog IS DISTINCT FROM in_store", "files")
def store_drift(spark, d):
    return diagnostics.drift(fx.catalog(spark, d), fx.table(spark, d, "lineitem", F.format_string("/orders/%d.msg", "l_orderkey").alias("file_path"))).fillna(-1)


_SNAP = "SELECT CAST(epoch(o_orderdate) AS BIGINT) // 2592000 AS t, count(*) FILTER (o_orderstatus = 'F') AS indexed, count(*) FILTER (o_orderstatus = 'O') AS errors, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1"


@query(f"SELECT t, indexed, errors, pending, CAST(d_t AS DOUBLE) AS d_t, CAST(d_indexed AS DOUBLE) AS d_indexed, CAST(d_errors AS DOUBLE) AS d_errors, round(rate, 6) AS rate, round(CASE WHEN rate > 0 THEN pending / rate / 3600 END, 6) AS eta_hours FROM (SELECT *, (d_indexed + d_errors) / d_t AS rate FROM (SELECT *, t - lag(t) OVER w AS d_t, indexed - lag(indexed) OVER w AS d_indexed, errors - lag(errors) OVER w AS d_errors FROM ({_SNAP}) WINDOW w AS (ORDER BY t)))")
def snapshot_rate_eta(spark, d):
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    t = F.floor(F.unix_timestamp("o_orderdate") / 2592000).cast("long")
    snaps = fx.table(spark, d, "orders", "o_orderdate", "o_orderstatus").groupBy(t.alias("t")).agg(of("F").alias("indexed"), of("O").alias("errors"), of("P").alias("pending"))
    out = catalog.snapshots_rate(snaps)
    out = out.withColumns({x: F.col(x).cast("double") for x in ("d_t", "d_indexed", "d_errors")})
    return out.withColumns({"rate": F.round("rate", 6), "eta_hours": F.round("eta_hours", 6)})


_OTHER = ["%No such file%", "%no such file%", "%Failed to transcribe audio%"]


@query("SELECT file_path, error FROM files WHERE status = 'error' AND " + " AND ".join(f"error NOT LIKE '{x}'" for x in _OTHER) + " ORDER BY file_path LIMIT 10", "files")
def other_errors(spark, d):
    return diagnostics.errors_like(fx.catalog(spark, d), unlike=_OTHER, n=10).select("file_path", "error")


@query("SELECT file_path, error FROM files WHERE status = 'error' AND error LIKE '%Failed to transcribe audio%' ORDER BY file_path LIMIT 5", "files")
def audio_errors(spark, d):
    return diagnostics.errors_like(fx.catalog(spark, d), ["%Failed to transcribe audio%"], n=5).select("file_path", "error")


@query("SELECT CASE WHEN error LIKE '%No such file%' OR error LIKE '%no such file%' THEN 'not downloaded' WHEN error LIKE '%Failed to transcribe audio%' THEN 'audio' ELSE 'other' END AS kind, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM files WHERE status = 'error' GROUP BY 1", "files")
def error_breakdown(spark, d):
    return diagnostics.error_shares(fx.catalog(spark, d), {"not downloaded": _OTHER[:2], "audio": _OTHER[2:]}, "other")


@query("SELECT file_path, error FROM files WHERE status = 'error' AND error LIKE '%Failed to transcribe audio%' AND (file_path LIKE '%6.msg' OR file_path LIKE '%26.msg') AND file_path LIKE '%/orders/1%' ORDER BY file_path LIMIT 5", "files")
def find_test_file(spark, d):
    return diagnostics.errors_like(fx.catalog(spark, d), ["%Failed to transcribe audio%"], paths=[["%6.msg", "%26.msg"], ["%/orders/1%"]], n=5).select("file_path", "error")


@query("SELECT file_path, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE error END AS error FROM (SELECT *, coalesce(status = 'error' AND error LIKE '%code page%', false) AS hit FROM files)", "files")
def reset_code_page(spark, d):
    return catalog.reset_errors(fx.catalog(spark, d), F.col("error").like("%code page%")).select("file_path", "status", "error")


@query("SELECT file_path, status FROM files WHERE status <> 'pending'", "files")
def clear_pending(spark, d):
    return catalog.remove_pending(fx.catalog(spark, d)).select("file_path", "status")


@query("SELECT file_path, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM (SELECT file_path, CASE WHEN file_size % 3 = 0 THEN 'processing' ELSE status END AS status FROM files)", "files")
def reset_stuck(spark, d):
    stuck = F.when(F.col("file_size") % 3 == 0, "processing").otherwise(F.col("status"))
    return catalog.reset_stuck(fx.catalog(spark, d).withColumn("status", stuck)).select("file_path", "status")


@query("SELECT * FROM prior WHERE file_path NOT IN (SELECT file_path FROM corpus WHERE file_size % 4 = 0)", "corpus", "prior")
def catalog_remove(spark, d):
    return catalog.remove(fx.prior(spark, d), fx.corpus(spark, d).filter("file_size % 4 = 0"))


_SAMPLED = "sampled AS (SELECT * FROM files WHERE status = 'error' ORDER BY md5(file_path || '7'), file_path LIMIT 200)"
fx.SQL["sampled"] = _SAMPLED


@query("SELECT file_path, error FROM sampled", "files", "sampled")
def error_sample(spark, d):
    return diagnostics.sample(fx.catalog(spark, d), 200, 7).select("file_path", "error")


@query(f"SELECT category, n, CAST(round(n * 10000 / sum(n) OVER ()) AS BIGINT) AS estimate FROM (SELECT {_rules(fixed.ERROR_RULES, 'NULL/empty error', 'substr(error, 1, 80)')} AS category, count(*) AS n FROM sampled GROUP BY 1)", "files", "sampled")
def error_extrapolated(spark, d):
    return diagnostics.extrapolated(diagnostics.sample(fx.catalog(spark, d), 200, 7), 10_000, fixed.ERROR_RULES, "NULL/empty error")


@query("SELECT file_path, upper(nullif(regexp_extract(file_path, '^([A-Za-z]):', 1), '')) AS drive FROM (SELECT ['D:/x/', 'e:y', '/mnt/', 'F:', ''][CAST(doc_id % 5 AS INT) + 1] || doc_id AS file_path FROM documents)")
def drive_letters(spark, d):
    roots = F.array(*map(F.lit, ["D:/x/", "e:y", "/mnt/", "F:", ""]))
    path = F.concat(F.element_at(roots, (F.col("doc_id") % 5 + 1).cast("int")), F.col("doc_id").cast("string"))
    return fx.table(spark, d, "documents", path.alias("file_path")).select("file_path", c.drive_letter(F.col("file_path")).alias("drive"))


@query("SELECT s.file_path, s.chunk_index, CASE WHEN n.file_path IS NULL THEN s.text ELSE 'new' END AS text FROM store s LEFT JOIN (SELECT DISTINCT file_path FROM store WHERE chunk_index = 3) n ON s.file_path = n.file_path WHERE n.file_path IS NULL OR s.chunk_index = 3", "hits", "store")
def vectors_replace(spark, d):
    store = _store(spark, d)
    return vectors.replace_files(store, store.filter("chunk_index = 3").withColumn("text", F.lit("new"))).select("file_path", "chunk_index", "text")


@query("SELECT file_path, chunk_index FROM store WHERE file_path NOT IN (SELECT file_path FROM store WHERE chunk_index = 5)", "hits", "store")
def vectors_delete(spark, d):
    store = _store(spark, d)
    return vectors.delete_files(store, store.filter("chunk_index = 5")).select("file_path", "chunk_index")


@query("SELECT ref, usn, reason, name, is_directory FROM (SELECT CAST(user_id AS BIGINT) AS ref, event_id AS usn, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REASONS.items()) + " ELSE 0 END AS reason, 'file ' || user_id || ' é.txt' AS name, user_id % 7 = 0 AS is_directory FROM events) WHERE usn >= 100")
def journal_decode(spark, d):
    """Journal pages in binary, decoded, from an offset on."""
    from lodestone.sources import journal

    reason = F.coalesce(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("event_type")], F.lit(0)).cast("long")
    rows = fx.table(spark, d, "events", "user_id", "event_id", reason.alias("reason"))
    return journal.since(journal.decoded(_pages(rows)), 100).select(F.col("ref").cast("long").alias("ref"), "usn", "reason", "name", "is_directory")


def _pages(rows):
    """(user_id, event_id, reason) as pages of journal records, one an Arrow batch."""
    import pyarrow as pa

    from lodestone.sources import journal

    def run(batches):
        for b in batches:
            said = b"".join(journal.record(u, 1, e, r, 0x10 if u % 7 == 0 else 0, f"file {u} é.txt") for u, e, r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([said], pa.binary())], names=["content"])

    return rows.mapInArrow(run, "content binary")


@query("SELECT '/u/' || ref || '.txt' AS path FROM (SELECT user_id AS ref, reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM (SELECT *, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in REASONS.items()) + " ELSE 0 END AS reason FROM events) WHERE event_id >= 100 AND user_id % 7 <> 0 AND reason IN (1, 2, 256, 512, 32768)) WHERE r = 1 AND reason <> 512 AND ref IN (SELECT c_custkey FROM customer) AND starts_with('/u/' || ref, '/u/1')")
def journal_scan(spark, d):
    """From binary pages to the paths to look at: from the offset, the last record a file, resolved, under the prefixes."""
    from lodestone.sources import journal

    reason = F.coalesce(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("event_type")], F.lit(0)).cast("long")
    rows = fx.table(spark, d, "events", "user_id", "event_id", reason.alias("reason"))
    paths = fx.table(spark, d, "customer", F.col("c_custkey").cast("decimal(20,0)").alias("ref"), F.format_string("/u/%d.txt", "c_custkey").alias("path"))
    latest = crawl.latest_changes(journal.since(journal.decoded(_pages(rows)), 100))
    return journal.resolved(latest, paths).filter(c.under(F.col("path"), ["/u/1"])).select("path")


@query("SELECT conv_id, trim('Subject: Conversation ' || conv_id || chr(10) || 'From: ' || arg_min(role, turn) || '@example.com' || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY turn)) AS text, NULL::VARCHAR AS error FROM conversations GROUP BY 1")
def mail_extract(spark, d):
    """Conversations as RFC 822 mail, read by the extractor."""
    from lodestone.sources import extract

    g = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    head = F.concat(F.lit("Subject: Conversation "), F.col("conv_id").cast("string"), F.lit("\r\nFrom: "), "role", F.lit("@example.com\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"))
    body = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    files = g.select(F.col("conv_id").cast("string").alias("file_path"), F.lit("msg").alias("file_type"), F.concat(head, body).cast("binary").alias("content"))
    return extract.extract(files).select(F.col("file_path").cast("long").alias("conv_id"), "text", "error")


@query(
    f"""SELECT query_id, CAST(r AS INT) AS rank, file_path, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, chunk_index) AS r FROM
    (SELECT qv.item_id AS query_id, cv.source_file AS file_path, cv.chunk_index, round(sum(cv.w * qv.w), 6) AS score FROM cv JOIN qv USING (bucket) GROUP BY ALL) WHERE score >= 0.3) WHERE r <= 5""",
    "corpus",
    "chunks",
    "cv",
    "qv",
)
def chunk_search(spark, d):
    """What a store of all documents' chunks finds for the benchmark texts."""
    q = embed.hashed_rows(fx.table(spark, d, "benchmark", F.col("item_id").alias("query_id"), "text"), ["query_id"])
    v = embed.hashed_rows(_chunks(spark, d).withColumnRenamed("source_file", "file_path"), ["file_path", "chunk_index"])
    return vectors.sparse_top_k(v, q, ["file_path", "chunk_index"], ["query_id"], 5, 0.3)


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return fx.table(spark, d, "documents", "doc_id", c.content_hash(F.col("text").cast("binary")).alias("content_hash"))


@query("SELECT conv_id, trim('Subject: Conversation ' || conv_id || chr(10) || 'From: ' || arg_min(role, turn) || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY 1")
def email_compose(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), turns.alias("t"))
    body = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return g.select("conv_id", c.email_text({"Subject": F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), "From": F.col("role"), "To": F.lit("")}, body).alias("text"))


@query("SELECT page_id, html AS text, 'utf-8' AS encoding FROM pages")
def html_raw_read(spark, d):
    text, encoding = c.decoded(F.col("html").cast("binary"))
    return fx.table(spark, d, "pages", "page_id", text.alias("text"), encoding.alias("encoding"))


def _engine(spark, d):
    import uuid

    from lodestone.plans.engine import Engine
    from lodestone.sources.config import Config
    from lodestone.sources.config import Query as QueryConfig

    e = Engine(spark, Config(store=f"{fx.shared(spark)}/store-{uuid.uuid4().hex}", query=QueryConfig(score_threshold=0.05)))
    e.put(fx.corpus(spark, d, "text").select("file_path", "text"))
    return e


def _answered(spark, d, question):
    got = _engine(spark, d).ask(question)
    return spark.createDataFrame([(got["answer"], i, s) for i, s in enumerate(got["sources"])], "answer string, n int, source string")


@query()
def ask_focused(spark, d):
    return _answered(spark, d, "What is the order of the ring for the thing")


@query()
def ask_broad(spark, d):
    return _answered(spark, d, "find all and the entire ring")


@query(
    f"""SELECT '/u/' || doc_id AS file_path, count(*) AS chunks, count(*) FILTER (regexp_matches(lower(k.text), '[a-z0-9]')) AS vectors FROM chunks k JOIN corpus c ON k.source_file = c.file_path
    WHERE '/u/' || doc_id IN (SELECT regexp_extract(v, {PARTS}, 3) FROM (SELECT {LINE} AS v FROM events) WHERE regexp_matches(v, {PARTS})) GROUP BY doc_id""",
    "corpus",
    "chunks",
)
def stream_ingest(spark, d):
    """The change log of events as a stream, into a store, and what the store then has."""
    import uuid

    from lodestone.plans.engine import Engine
    from lodestone.sources.config import Config
    from lodestone.streaming import ingest

    at = f"{fx.shared(spark)}/stream-{uuid.uuid4().hex}"
    _log(spark, d).write.text(f"{at}/log")
    known = fx.table(spark, d, "documents", F.format_string("/u/%d", "doc_id").alias("file_path"), F.lit("text").alias("file_type"), "text")
    engine = Engine(spark, Config(store=f"{at}/store"))
    read = lambda paths: known.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    ingest.follow(ingest.changes(spark, f"{at}/log"), read, engine, f"{at}/offsets").awaitTermination()
    n = engine.chunks.read().groupBy("file_path").agg(F.count("*").alias("chunks"))
    return n.join(engine.vectors().groupBy("file_path").agg(F.count("*").alias("vectors")), "file_path", "left").fillna(0, ["vectors"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Chunk the documents, embed the chunks, and search them for one benchmark text."""
    q = embed.hashed_rows(fx.table(spark, d, "benchmark", F.col("item_id").alias("query_id"), "text").filter("query_id = 0"), ["query_id"])
    return vectors.sparse_top_k(embed.hashed_rows(_chunks(spark, d), ["source_file", "chunk_index"]), q, ["source_file", "chunk_index"], ["query_id"], 15)
