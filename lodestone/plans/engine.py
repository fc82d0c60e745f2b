"""Ingest, search and ask over versioned tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import columns as c
from lodestone.operators import answer, catalog, chunk, context, crawl, diagnostics, embed, retrieval, vectors
from lodestone.sources import config as configuration
from lodestone.sources import extract, files, progress

CHUNKS = "file_path string, chunk_index int, text string, file_type string"
SPARSE = "file_path string, chunk_index int, buckets array<int>, weights array<double>"
#: Segments of the store beyond which it is written anew.
SEGMENTS = 16
HIT = ["query_id", "source_rank", "rank", "file_path", "chunk_index", "text", "score", "file_type"]


class Engine:
    """A store of a catalog and of chunks, and the programs over it."""

    def __init__(self, spark: SparkSession, config: configuration.Config | None = None, registry=None, expander=None, answerer=None, volumes=None):
        self.spark, self.config, self.volumes = spark, config or configuration.Config(), volumes
        self.files = catalog.Table(spark, f"{self.config.store}/files", schemas.FILES)
        self.chunks = catalog.Table(spark, f"{self.config.store}/chunks", CHUNKS)
        self.sparse = catalog.Table(spark, f"{self.config.store}/vectors", SPARSE)
        self.registry = registry
        self.expander, self.answerer = expander or answer.PlainExpander(), answerer or answer.ExtractiveAnswerer()

    def ingest(self, paths: list[str] | None = None, file_list: str | None = None, log_path: str | None = None) -> dict:
        """New and changed files are extracted, chunked and stored; then the catalog says so. Counters of the run."""
        began, cfg, explicit = time.time(), self.config, paths is not None
        paths = paths or cfg.scan_paths
        self.progress(phase="scanning", started_at=began, files_queued=0, files_processed=0, files_errors=0)
        known = self.files.read()
        if file_list:
            queued = files.file_list(self.spark, file_list)
        else:
            queued = files.scan(self.spark, paths, known, log_path, cfg.scanner.max_file_size_mb, cfg.scanner.excluded_dirs or None, self.volumes, f"{cfg.store}/journal.json")
            if not explicit:
                more = crawl.pending_resume(known, queued.select(F.col("path").alias("file_path")), cfg.pipeline.type_max_mb)
                queued = queued.unionByName(more.select(F.col("file_path").alias("path"), F.col("file_size").alias("size"), "mtime", "file_type", c.extension(F.col("file_path")).alias("extension")))
        laned = crawl.split_by_cost(queued, cfg.pipeline.type_max_mb).persist()
        todo = laned.filter("lane != 'skipped_size'")
        rows = todo.select(F.col("path").alias("file_path"), F.col("size").alias("file_size"), "mtime")
        self.files.commit(catalog.upsert(known, rows))
        self.progress(phase="processing", files_queued=todo.count())
        got = self.extracted(todo).persist()
        pieces = self.pieces(got.filter("error IS NULL")).persist()
        self._replace(got.select("file_path"), pieces)
        # the catalog follows the store, so a file is indexed only once its chunks are there
        n = got.filter("error IS NULL").join(pieces.groupBy("file_path").agg(F.count("*").alias("n")), "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).alias("n"))
        now = catalog.mark_error(catalog.mark_indexed(self.files.read(), n, time.time()), got.filter("error IS NOT NULL").select("file_path", F.col("error").alias("message")))
        gone = 0
        if not cfg.scanner.skip_cleanup and not file_list and paths:
            lost = crawl.deleted(now, files.walk(self.spark, paths), paths).persist()
            gone = lost.count()
            if gone:
                self._replace(lost, None)
                now = catalog.remove(now, lost)
        self.files.commit(now)
        counts = {r["lane"]: r["count"] for r in laned.groupBy("lane").count().collect()}
        errors = got.filter("error IS NOT NULL").count()
        out = {"scanned": sum(counts.values()), "processed": got.count() - errors, "chunks_created": pieces.count(), "errors": errors, "skipped_size": counts.get("skipped_size", 0), "deleted": gone, "elapsed": time.time() - began}
        for df in (laned, got, pieces):
            df.unpersist()
        self.progress(phase="idle", files_processed=out["processed"], files_errors=errors)
        at = self._progress_path()
        if at:
            progress.write_stats(at, catalog.stats(self.files.read(), stuck_is_pending=True).first().asDict())
        return out

    def extracted(self, todo: DataFrame) -> DataFrame:
        """The texts of the queued files (path, lane): the expensive lane a few files at a time, as its devices are few."""
        cfg, lanes = self.config.pipeline, []
        for lane, slots in (("cpu", None), ("gpu", cfg.gpu_slots)):
            files_ = extract.contents(self.spark, todo.filter(F.col("lane") == lane))
            lanes.append(extract.extract(files_ if slots is None else files_.coalesce(slots), self.registry, cfg.extraction_timeout))
        return lanes[0].unionByName(lanes[1])

    def _progress_path(self) -> str | None:
        """Progress is a small local file beside the store; a store that isn't local has none."""
        return None if "://" in self.config.store else f"{self.config.store}/progress.json"

    def progress(self, **values) -> None:
        if at := self._progress_path():
            progress.write(at, **values)

    def pieces(self, texts: DataFrame) -> DataFrame:
        """The chunks of (file_path, text), whole."""
        out = chunk.chunk(texts, size=self.config.chunking.chunk_size, overlap=self.config.chunking.chunk_overlap)
        return out.select(F.col("source_file").alias("file_path"), "chunk_index", "text", c.file_type(c.extension(F.col("source_file"))).alias("file_type"))

    def put(self, texts: DataFrame) -> int:
        """Texts that are at hand in place of their files' chunks; the store's new version."""
        return self._replace(texts.select("file_path"), self.pieces(texts))

    def replace(self, texts: DataFrame, gone: DataFrame, **properties) -> int:
        """Texts (file_path, text) in place of their files' chunks, and none for the paths that are gone: one version, with properties of its own."""
        return self._replace(texts.select("file_path").unionByName(gone.select("file_path")), self.pieces(texts), **properties)

    def _replace(self, paths: DataFrame, pieces: DataFrame | None, **properties) -> int:
        """New chunks and their vectors in place of those of the paths; only the new ones are embedded, each whole. Of their text 500 characters are kept.

        Vectors are staged first and named by the chunks' version, so one rename publishes both. What was there isn't
        rewritten, until there are SEGMENTS changes.
        """
        paths = paths.select("file_path").distinct().persist()
        vectors_, chunks = None, None
        if pieces is not None:
            vectors_, chunks = embed.hashed_rows(pieces, retrieval.KEY), pieces.withColumn("text", F.substring("text", 1, 500))
        staged = [*self._vectors(), *self.sparse.stage(vectors_, paths)[len(self.sparse.segments()) :]]
        version = self.chunks.change(chunks, paths, vectors=staged, **properties)
        paths.unpersist()
        if len(staged) > SEGMENTS:
            version = self.compact()
        return version

    def _vectors(self) -> list[dict]:
        """The segments of the vectors that belong to the newest chunks."""
        return self.chunks.properties().get("vectors", [])

    def vectors(self) -> DataFrame:
        segments = self._vectors()
        return self.sparse.read(segments) if segments else self.spark.createDataFrame([], SPARSE)

    def compact(self) -> int:
        """The store with one segment; what no version names goes."""
        staged = self.sparse.stage(self.vectors(), None)[-1:]
        version = self.chunks.commit(self.chunks.read(), vectors=staged)
        self.sparse.vacuum(staged)
        self.chunks.vacuum()
        return version

    def hits(self, queries: DataFrame, depth: int, file_type: str | None = None, without: list[str] | None = None) -> DataFrame:
        """Hits of (query_id, source_rank, text): all searches of a stage are one job."""
        store = vectors.matching(self.chunks.read(), {"file_type": file_type} if file_type else None, {"file_type": without} if without else None)
        sparse = self.vectors()
        if file_type or without:
            sparse = sparse.join(store.select(retrieval.KEY), retrieval.KEY, "left_semi")
        asked = embed.hashed_rows(queries.select("query_id", "source_rank", "text"), ["query_id", "source_rank"])
        best = vectors.sparse_top_k(sparse, asked, retrieval.KEY, ["query_id", "source_rank"], depth, self.config.query.score_threshold)
        return best.join(store, retrieval.KEY).select("query_id", "source_rank", *HIT[2:])

    def search(self, query: str, top_k: int | None = None, file_type: str | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("the query is blank")
        k = retrieval.depths(top_k, self.config.query.top_k)["k"]
        out = self.hits(self._queries([query]), k, file_type)
        return out.orderBy("rank").select("file_path", c.basename(F.col("file_path")).alias("file_name"), "chunk_index", "text", F.round("score", 4).alias("score"), "file_type")

    def _queries(self, texts: list[str], first: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(0, first + i, t) for i, t in enumerate(texts)], "query_id long, source_rank int, text string")

    def _small(self, df: DataFrame) -> DataFrame:
        """df worked out once. Only for hits of one question, whose number the depths of its searches bound."""
        return self.spark.createDataFrame(df.collect(), df.schema).coalesce(1)

    def ask(self, question: str, top_k: int | None = None, file_type: str | None = None) -> dict:
        """Answer, sources and the rows that the answer rests on."""
        if not question.strip():
            raise ValueError("the question is blank")
        asked = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        broad = asked.select(c.is_broad(F.col("question"))).first()[0]
        words = self._small(asked.select("query_id", c.all_keywords(F.col("question")).alias("keywords"), c.entities(F.col("question")).alias("entities")))
        if broad:
            texts = [*self.expander.expand_broad(question), question]
            d = retrieval.depths(top_k, self.config.query.top_k, len(texts))
            found = self.hits(self._queries(texts), d["each"], file_type)
            if not file_type:
                found = found.unionByName(self.hits(self._queries(texts, len(texts)), max(d["each"], 15), None, ["msg"]))
            found = retrieval.fuse(found).withColumn("source_rank", F.lit(0))
        else:
            d = retrieval.depths(top_k, self.config.query.top_k)
            expanded = answer.accepted(self.expander.expand(question), question)
            found = self.hits(self._queries([expanded]), d["k"], file_type)
            if expanded != question:
                found = found.unionByName(self.hits(self._queries([question], 1), d["original"], file_type))
            found = self._small(found)
            if not file_type and found.head(1):
                found = found.unionByName(self.hits(self._queries([expanded, question][: 1 + (expanded != question)], 2), d["diverse"], None, ["msg"]))
            found = retrieval.first_seen(found)
        found = context.without_system_files(retrieval.ranked(found).select(HIT))
        found = self._small(found)
        if not broad and found.head(1):
            missing = self._small(retrieval.supplement_queries(retrieval.missing_keywords(found, words), words))
            if missing.head(1):
                numbered = missing.select("query_id", (F.xxhash64("keyword", "n") % (1 << 30)).cast("int").alias("source_rank"), "keyword", F.col("query").alias("text"))
                extra = self.hits(numbered, d["supplement"], file_type).join(numbered.select("source_rank", "keyword"), "source_rank")
                found = retrieval.supplemented(found, extra.select(*HIT, "keyword"))
            found = self._small(retrieval.ranked(retrieval.rerank(found, words)).select(HIT))
        if not found.head(1):
            return {"answer": answer.NOTHING_FOUND, "sources": [], "search_results": []}
        if broad:
            rows = context.broad_context(found)
        else:
            entities = words.first()["entities"]
            preferred = self._small(context.keyword_files(found, words))
            if preferred.head(1):
                most = min(preferred.count(), 10) if entities else 5
                chosen = self._small(context.files_by_keyword(found, preferred, most))
            else:
                chosen = self._small(context.files_by_diversity(found))
            rows = context.expand(found, chosen, self.chunks.read())
            rows = context.without_system_files(rows)
            if entities:
                rows = context.about_entities(rows, words)
        rows = self._small(rows)
        said = self.answerer.answer(question, context.formatted(rows).first()["context"], 32768 if broad else 16384)
        said = self.spark.createDataFrame([(said,)], "a string").select(c.clean_answer(F.col("a"))).first()[0]
        return {
            "answer": said,
            "sources": [r["file_path"] for r in context.ordered_sources(rows).orderBy("n").collect()],
            "search_results": [r.asDict() for r in rows.orderBy("pos").select("file_path", F.round("score", 4).alias("score"), F.substring("text", 1, 200).alias("text_preview"), "file_type").collect()],
        }

    def status(self) -> dict:
        return catalog.stats(self.files.read()).first().asDict() | {"vectors": self.chunks.read().count()}

    def report(self) -> dict:
        """What a dashboard shows: counts and shares, the last file, the last errors."""
        files = self.files.read()
        out = diagnostics.shares(catalog.stats(files, stuck_is_pending=True)).first().asDict() | {"vectors": self.chunks.read().count()}
        last = diagnostics.latest(files, 1, "indexed").first()
        errors = diagnostics.latest(files, 10, "error").select(c.basename(F.col("file_path")).alias("file"), F.substring("error", 1, 120).alias("error"))
        return out | {"last_file": last and last["file_path"], "errors_latest": [r.asDict() for r in errors.collect()]}

    def reset(self) -> None:
        self.chunks.commit(self.spark.createDataFrame([], CHUNKS), vectors=[])
        self.sparse.clear()
        self.files.clear()
