"""Ingest, search, ask, streaming, end to end."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog
from lodestone.plans.engine import CHUNKS, Engine
from lodestone.sources import config
from lodestone.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "jill.txt").write_text("Jill has the email address jill at example and a garden.")
    (docs / "orders.txt").write_text("Order confirmation license key ABC for the software. " * 40)
    (docs / "scan.pdf").write_bytes(b"no such thing")
    return Engine(spark, config.Config(scan_paths=[str(docs)], store=str(tmp_path / "store"), query=config.Query(score_threshold=0.05))), docs


def test_ingest_search_ask(engine):
    e, docs = engine
    run = e.ingest()
    assert (run["scanned"], run["processed"], run["errors"]) == (3, 2, 1)
    assert e.status()["indexed"] == 2 and e.status()["errors"] == 1 and e.status()["vectors"] == run["chunks_created"] > 2
    r = e.report()
    assert r["success_pct"] == 66.7 and r["last_file"].endswith(".txt") and r["errors_latest"][0]["file"] == "scan.pdf"
    assert e.search("email address of jill").first()["file_name"] == "jill.txt"
    got = e.ask("What email address have I used for jill")
    assert got["sources"][0].endswith("jill.txt") and "email" in got["answer"]
    broad = e.ask("find all software license keys")
    assert broad["sources"] and broad["search_results"]
    assert e.ask("zzzz qqqq")["sources"] == []
    with pytest.raises(ValueError):
        e.search("  ")
    before = e.status()["vectors"]
    again = e.ingest()
    assert again["processed"] == 0 and e.status()["vectors"] == before
    (docs / "jill.txt").write_text("Jill moved.")
    (docs / "orders.txt").unlink()
    run = e.ingest()
    assert run["processed"] == 1 and run["deleted"] == 1 and e.status()["vectors"] == 1
    e.reset()
    assert e.status()["total"] == 0


def test_whole_chunk_is_embedded(engine):
    """A word after character 500 of a chunk, outside any overlap, finds it; the store keeps 500 characters."""
    e, docs = engine
    text = " ".join(f"filler{i:03d}" for i in range(70)) + " xylophone"
    assert text.index("xylophone") > 650 and len(text) < 1000
    assert e.put(e.spark.createDataFrame([("/late.txt", text), ("/other.txt", "filler words here")], "file_path string, text string"))
    best = e.search("xylophone").collect()
    assert [r["file_path"] for r in best] == ["/late.txt"] and len(best[0]["text"]) == 500


def test_stream(spark, tmp_path):
    """Chunks and vectors come together: what was streamed is found, what was deleted isn't."""
    e = Engine(spark, config.Config(store=str(tmp_path / "store"), query=config.Query(score_threshold=0.05)))
    log = tmp_path / "log"
    log.mkdir()
    (log / "1").write_text("1|modify|/a.txt\nbroken line\n2|modify|/b.txt\n3|modify|/a.txt\n")
    read = lambda paths: paths.select(F.col("path").alias("file_path"), F.concat(F.lit("text of "), "path").alias("text"))
    run = lambda: ingest.follow(ingest.changes(spark, str(log)), read, e, str(tmp_path / "cp")).awaitTermination()
    run()
    assert e.chunks.read().count() == e.vectors().count() == 2
    assert e.search("b txt").first()["file_path"] == "/b.txt"
    (log / "2").write_text("4|delete|/b.txt\n5|modify|/c.txt\n")
    run()
    assert {r["file_path"] for r in e.chunks.read().collect()} == {r["file_path"] for r in e.vectors().collect()} == {"/a.txt", "/c.txt"}
    version = e.chunks.version()
    run()
    assert e.chunks.version() == version
    e.compact()
    assert len(e.chunks.segments()) == 1 and e.chunks.read().count() == e.vectors().count() == 2 and e.chunks.properties()["batch"] == 1
    assert e.search("c txt").first()["file_path"] == "/c.txt"


def test_interrupted_commit(spark, tmp_path, monkeypatch):
    """A writer that dies between its files leaves the last version as it was; a second writer of a version fails."""
    e = Engine(spark, config.Config(store=str(tmp_path / "store"), query=config.Query(score_threshold=0.05)))
    df = lambda *rows: spark.createDataFrame(rows, "file_path string, text string")
    e.put(df(("/a", "alpha words"), ("/b", "beta words")))
    real = catalog.Table._publish

    def dies(self, *a):
        raise OSError("killed")

    monkeypatch.setattr(catalog.Table, "_publish", dies)
    with pytest.raises(OSError):
        e.put(df(("/a", "gamma words")))
    monkeypatch.setattr(catalog.Table, "_publish", real)
    assert e.search("alpha").first()["file_path"] == "/a" and e.search("gamma words").first()["text"] == "alpha words" and e.chunks.version() == 1
    late = e.chunks._pointer()
    e.put(df(("/a", "delta words")))
    with pytest.raises(catalog.Conflict):
        e.chunks._publish(late, late["segments"], {})
    assert {r["text"] for r in e.chunks.read().collect()} == {"delta words", "beta words"}


def test_http(engine):
    import json
    import threading
    import urllib.error
    import urllib.request

    from lodestone import serve

    e, _ = engine
    e.ingest()
    s = serve.server(e, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, data=body if body is None or isinstance(body, bytes) else json.dumps(body).encode())) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as x:
            return x.code, x.read()

    try:
        status, stats = call("/api/stats")
        stats = json.loads(stats)
        assert status == 200 and (stats["total_files"], stats["indexed"], stats["errors"]) == (3, 2, 1) and stats["ingest"]["phase"] == "idle" and stats["ingest"]["files_processed"] == 2
        status, found = call("/api/search", {"query": "email address of jill", "top_k": 1})
        assert status == 200 and [r["file_name"] for r in json.loads(found)["results"]] == ["jill.txt"]
        status, said = call("/api/chat", {"question": "What email address have I used for jill"})
        assert status == 200 and {"answer", "sources", "search_results"} <= set(json.loads(said))
        assert call("/api/search", {"query": "  "}) == (400, b'{"error": "Empty query"}') and call("/api/chat", b"not json")[0] == 400
        assert call("/api/nothing")[0] == 404 and call("/")[0] == 200 and call("/api/search", {"query": "x", "top_k": "many"})[0] == 500
    finally:
        s.shutdown()


def test_timed():
    import time

    from lodestone.operators import diagnostics

    def broken():
        raise KeyError("x")

    got = diagnostics.timed([("a", lambda: 1), ("b", broken), ("c", lambda: time.sleep(20)), ("d", lambda: 2)], limit=0.5)
    assert [(r["step"], r["state"], r["result"]) for r in got] == [("a", "ok", 1), ("b", "error", None), ("c", "timeout", None)] and "KeyError" in got[1]["error"]


def test_progress(tmp_path):
    from lodestone.sources import progress

    at = str(tmp_path / "p.json")
    assert progress.read(at) == progress.DEFAULTS
    progress.write(at, phase="scanning", files_new=3, own=1)
    progress.write_stats(at, {"total": 9, "total_chunks": 4})
    got = progress.read(at)
    assert (got["phase"], got["files_new"], got["own"], got["db_total"], got["db_chunks"]) == ("scanning", 3, 1, 9, 4) and got["updated_at"]
    (tmp_path / "p.json").write_text("{broken")
    assert progress.read(at) == progress.DEFAULTS
    progress.write(at, phase="scanning")
    assert progress.clear(at)["phase"] == "idle"
    offsets = str(tmp_path / "o.json")
    progress.save_offsets(offsets, "C", {"next_usn": 5})
    progress.save_offsets(offsets, "D", {"next_usn": 7})
    assert progress.load_offsets(offsets) == {"C": {"next_usn": 5}, "D": {"next_usn": 7}}
