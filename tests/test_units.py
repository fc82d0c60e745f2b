"""Chunker, catalog, crawl, extraction, journal, ranking: behaviour on small inputs."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import columns as c
from lodestone.operators import catalog, chunk, context, crawl, diagnostics, embed, retrieval, vectors
from lodestone.sources import config, extract, files, journal

SENTENCE = "The quick brown fox. "


def test_chunk_short_and_blank():
    assert [*chunk.chunks("a short text")] == [(0, 0, "a short text")]
    assert [*chunk.chunks("")] == [*chunk.chunks("   ")] == [*chunk.chunks(None)] == []


def test_chunk_long():
    got = [*chunk.chunks(SENTENCE * 20, 100, 20)]
    assert len(got) > 1 and [g[0] for g in got] == list(range(len(got))) and all(g[2] for g in got)
    with pytest.raises(ValueError):
        [*chunk.chunks("x" * 50, 10, 5)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n,;?!é", max_size=600), st.integers(10, 80))
def test_chunks_cover(text, size):
    got = [*chunk.chunks(text, size, size // 5)]
    assert [g[0] for g in got] == list(range(len(got)))
    assert all(a[1] < b[1] for a, b in zip(got, got[1:]))
    seen = set()
    for _, at, piece in got:
        assert len(piece) <= size or len(text) <= size
        start = text.index(piece, at)
        seen |= set(range(start, start + len(piece)))
    assert all(i in seen or ch.isspace() for i, ch in enumerate(text))


def test_chunk_udtf(spark):
    spark.udtf.register("chunk_text", chunk.ChunkText)
    assert spark.sql("SELECT * FROM chunk_text('hello', 1000, 200)").collect()[0]["text"] == "hello"


def _files(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, file_size long, mtime double, status string, chunk_count long, error string")
    return catalog.aligned(df)


def test_change_matrix(spark):
    known = _files(spark, [("same", 1, 1.0, "indexed", 0, None), ("size", 1, 1.0, "indexed", 0, None), ("time", 1, 1.0, "indexed", 0, None), ("err", 1, 1.0, "error", 0, "x"), ("pend", 1, 1.0, "pending", 0, None)])
    crawled = spark.createDataFrame([("new", 1, 1.0), ("same", 1, 1.0), ("size", 2, 1.0), ("time", 1, 2.0), ("err", 1, 1.0), ("pend", 1, 1.0)], "path string, size long, mtime double")
    assert {r["path"] for r in crawl.changed(crawled, known).collect()} == {"new", "size", "time", "err"}


def test_stats_and_marks(spark):
    known = _files(spark, [("a", 1, 1.0, "indexed", 5, None), ("b", 1, 1.0, "indexed", 3, None), ("c", 1, 1.0, "error", 9, "boom"), ("d", 1, 1.0, "pending", 0, None), ("e", 1, 1.0, "processing", 0, None)])
    assert catalog.stats(known).first().asDict() == {"total": 5, "indexed": 2, "errors": 1, "pending": 1, "total_chunks": 8}
    assert catalog.stats(known, True).first()["pending"] == 2
    assert catalog.reset_stuck(known).filter("status = 'pending'").count() == 2
    again = catalog.reset_errors(known).filter("file_path = 'c'").first()
    assert (again["status"], again["error"]) == ("pending", None)
    up = spark.createDataFrame([("a", 2, 2.0, 1), ("a", 3, 3.0, 2), ("z", 1, 1.0, 1)], "file_path string, file_size long, mtime double, pos int")
    once = catalog.upsert(known, up, "pos")
    assert once.filter("file_path = 'a'").first()["file_size"] == 3 and once.count() == 6
    assert sorted(map(str, catalog.upsert(once, up, "pos").collect())) == sorted(map(str, once.collect()))
    marked = catalog.mark_error(catalog.mark_indexed(known, spark.createDataFrame([("d", 4), ("no", 1)], "file_path string, n long"), 9.0), spark.createDataFrame([("a", "bad")], "file_path string, message string"))
    rows = {r["file_path"]: r for r in marked.collect()}
    assert (rows["d"]["status"], rows["d"]["chunk_count"], rows["d"]["indexed_at"]) == ("indexed", 4, 9.0)
    assert (rows["a"]["status"], rows["a"]["error"], rows["a"]["chunk_count"]) == ("error", "bad", 5) and len(rows) == 5
    assert catalog.remove(known, known.filter("status = 'error'")).count() == 4


def test_table(spark, tmp_path):
    t = catalog.Table(spark, str(tmp_path / "t"), schemas.FILES)
    assert t.read().count() == 0 and t.version() == 0
    t.commit(_files(spark, [("a", 1, 1.0, "indexed", 5, None)]), dim=256)
    old = t.read()
    t.commit(catalog.upsert(t.read(), spark.createDataFrame([("b", 1, 1.0)], "file_path string, file_size long, mtime double")))
    assert t.version() == 2 and t.read().count() == 2 and old.count() == 1 and t.properties()["dim"] == 256 and t.check()
    t.compact(1)
    t.backup(str(tmp_path / "copy"))
    t.vacuum()
    assert t.read().count() == 2 and spark.read.parquet(str(tmp_path / "copy")).count() == 2
    t.clear()
    assert t.read().count() == 0
    t.drop()
    assert t.version() == 0


def test_types(spark):
    df = spark.createDataFrame([(p,) for p in ("a.txt", "b.pdf", "c.mp3", "d.mp4", "e.PNG", "f.docx", "g.xyz", ".hidden", "noext")], "p string")
    assert [r[0] for r in df.select(c.file_type(c.extension(F.col("p")))).collect()] == ["text", "pdf", "audio", "video", "image", "docx", None, None, None]


def test_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.xyz").write_text("no")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.txt").write_text("no")
    none = spark.createDataFrame([], schemas.FILES)
    got = files.scan(spark, [str(tmp_path)], none)
    assert [r["path"].rsplit("/", 1)[1] for r in got.collect()] == ["a.txt"]
    known = catalog.aligned(got.select(F.col("path").alias("file_path"), F.col("size").alias("file_size"), "mtime", F.lit("indexed").alias("status")))
    assert files.scan(spark, [str(tmp_path)], known).count() == 0
    assert files.scan(spark, [], none).count() == 0
    log = tmp_path / "log"
    log.write_text(f"t|modify|{tmp_path}/a.txt\nbroken\nt|modify|{tmp_path}/gone.txt\n")
    assert files.scan(spark, [str(tmp_path)], none, str(log)).count() == 1
    names = tmp_path / "list.lst"
    names.write_text(f"{tmp_path}/a.txt\n\n{tmp_path}/nowhere.txt\n")
    assert files.file_list(spark, str(names)).count() == 1
    names.write_text(f"{tmp_path}/empty.txt\n{tmp_path}\n")
    assert [r["size"] for r in files.file_list(spark, str(names)).collect()] == [0]
    assert files.walk(spark, [str(tmp_path / "nowhere")]).count() == 0
    assert {r["path"].rsplit("/", 1)[1] for r in spark.createDataFrame(files._readable(spark, [str(tmp_path)]), files.FOUND).collect()} >= {"a.txt", "c.txt", "b.xyz"}


def test_only_queued_files_are_opened(spark, tmp_path):
    names = ["a b.txt", "c[1].txt", "e%20.txt", "other.txt"]
    for n in names:
        (tmp_path / n).write_text(n)
    queued = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in [*names[:3], "gone.txt"]], "path string")
    got = {r["file_path"].rsplit("/", 1)[1]: bytes(r["content"]).decode() for r in extract.contents(spark, queued).collect()}
    assert got == {n: n for n in names[:3]}


def test_journal_scan(spark, tmp_path):
    for n in ("a.txt", "b.txt", "old.txt"):
        (tmp_path / n).write_text(n)
    pages, state = tmp_path / "pages", str(tmp_path / "journal.json")
    pages.mkdir()
    (pages / "page-00").write_bytes(journal.record(1, 9, 5, 0x100, 0, "old.txt"))
    (pages / "page-10").write_bytes(journal.record(2, 9, 10, 0x1, 0, "a.txt") + journal.record(3, 9, 11, 0x200, 0, "gone.txt"))
    (pages / "page-20").write_bytes(journal.record(2, 9, 20, 0x2, 0, "a.txt") + journal.record(4, 9, 21, 0x2000, 0, "b.txt"))
    index = spark.createDataFrame([(i, f"{tmp_path}/{n}") for i, n in ((1, "old.txt"), (2, "a.txt"), (3, "gone.txt"), (4, "b.txt"))], "ref long, path string").withColumn("ref", F.col("ref").cast("decimal(20,0)"))
    volume = lambda first: {"d": journal.SavedVolume(spark, str(pages), index, 7, first, 22)}
    none = spark.createDataFrame([], schemas.FILES)
    scan = lambda v: {r["path"].rsplit("/", 1)[1] for r in files.scan(spark, [str(tmp_path)], none, volumes=v, offsets_path=state).collect() if r["path"].endswith(".txt")}
    assert scan(volume(0)) == {"a.txt", "b.txt", "old.txt"}  # no offset yet: a walk, and the offset is saved
    from lodestone.sources import progress

    assert progress.load_offsets(state)["d"]["next_usn"] == 22 and scan(volume(0)) == set()
    progress.save_offsets(state, "d", {"journal_id": 7, "next_usn": 10, "first_usn": 0})
    assert scan(volume(0)) == {"a.txt", "b.txt"}
    progress.save_offsets(state, "d", {"journal_id": 7, "next_usn": 10, "first_usn": 0})
    assert scan(volume(15)) == {"a.txt", "b.txt", "old.txt"}  # the journal has lost records: a walk
    progress.save_offsets(state, "d", {"journal_id": 7, "next_usn": 10, "first_usn": 0})
    log = str(tmp_path / "changes")
    assert files.collect(spark, volume(0), state, log, "t") == 4 and files.collect(spark, volume(0), state, log, "t") == 0
    got = sorted((r["action"], r["path"].rsplit("/", 1)[1]) for r in crawl.change_log(spark.read.text(log)).collect())
    assert got == [("delete", "gone.txt"), ("modify", "a.txt"), ("modify", "a.txt"), ("rename", "b.txt")]


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_extract(spark):
    mail = b"Subject: Hi\r\nFrom: a@example.com\r\nTo: b@example.com\r\n\r\nBody text\r\n"
    rows = [("u", "text", "héllo".encode()), ("l", "text", b"caf\xe9"), ("d", "docx", _docx()), ("bad", "docx", b"x"), ("m", "msg", mail), ("p", "pdf", b"x"), ("q", "what", b"x"), ("blank", "text", b"  ")]
    df = spark.createDataFrame(rows, "file_path string, file_type string, content binary")
    got = {r["file_path"]: r for r in extract.extract(df).collect()}
    assert (got["u"]["text"], got["u"]["metadata"]["encoding"]) == ("héllo", "utf-8")
    assert (got["l"]["text"], got["l"]["metadata"]["encoding"]) == ("café", "latin-1")
    assert got["d"]["text"] == "One\na | b" and got["bad"]["error"] and got["p"]["error"].startswith("ExtractionError: Failed to extract PDF")
    assert got["m"]["text"].startswith("Subject: Hi\nFrom: a@example.com\nTo: b@example.com\n\nBody text")
    assert got["q"]["error"].startswith("No extractor") and got["blank"]["error"] is None
    text, encoding = c.decoded(F.col("content"))
    assert [tuple(r) for r in df.limit(2).select(text, encoding).collect()] == [("héllo", "utf-8"), ("café", "latin-1")]


def _ole(tree: dict) -> bytes:
    """A compound file of nested storages; all streams in mini sectors, each storage's children in one chain of siblings."""
    entries, small = [], b""

    def add(name, value):
        nonlocal small
        at = len(entries)
        entries.append(None)
        if isinstance(value, dict):
            kids = [add(k, v) for k, v in value.items()]
            entries[at] = [name, 1, kids[0] if kids else 0xFFFFFFFF, 0, 0]
            for a, b in zip(kids, kids[1:]):
                entries[a].append(b)
        else:
            entries[at] = [name, 2, 0xFFFFFFFF, len(small) // 64, len(value)]
            small += value + b"\0" * (-len(value) % 64)
        return at

    add("Root Entry", tree)
    entries[0][1] = 5
    mini = [i + 1 for i in range(len(small) // 64)]
    for e in entries:
        if e[1] == 2 and e[4]:
            mini[e[3] + -(-e[4] // 64) - 1] = 0xFFFFFFFE
    blocks = lambda b: -(-len(b) // 512)
    import struct

    table = struct.pack(f"<{len(mini)}I", *mini)
    entries[0][3], entries[0][4] = 0, len(small)
    names = lambda e: e[0].encode("utf-16-le")
    n_small, n_table, n_dir = blocks(small), blocks(table), -(-len(entries) * 128 // 512)
    entries[0][3] = 1 + n_dir + n_table
    directory = b"".join(names(e).ljust(64, b"\0") + struct.pack("<HBB3I", len(names(e)) + 2, e[1], 1, 0xFFFFFFFF, e[5] if len(e) > 5 else 0xFFFFFFFF, e[2]) + b"\0" * 36 + struct.pack("<IQ", e[3], e[4]) for e in entries)
    chain = lambda at, n: [at + i + 1 for i in range(n - 1)] + [0xFFFFFFFE] * (n > 0)
    fat = [0xFFFFFFFD, *chain(1, n_dir), *chain(1 + n_dir, n_table), *chain(1 + n_dir + n_table, n_small)]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 1 + n_dir, n_table, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    pad = lambda b: b + b"\0" * (-len(b) % 512)
    return head + struct.pack("<128I", *fat) + pad(directory) + pad(table) + pad(small)


def test_outlook():
    import struct

    u = lambda s: s.encode("utf-16-le")
    prop = lambda tag, value: struct.pack("<II8s", tag, 6, value)
    when = struct.pack("<Q", (1_300_000_000 + 11_644_473_600) * 10_000_000)
    message = {
        "__properties_version1.0": b"\0" * 32 + prop(0x00390040, when) + prop(0x3FFD0003, struct.pack("<II", 1251, 0)),
        "__substg1.0_0037001F": u("Grüße"), "__substg1.0_0C1A001E": "Иван".encode("cp1251"), "__substg1.0_0E04001F": u("bob"), "__substg1.0_1000001F": u("Body text\r\n") * 30,
        "__attach_version1.0_#00000000": {"__substg1.0_3707001F": u("note.txt"), "__substg1.0_37010102": b"inside the note", "__properties_version1.0": b"\0" * 8},
        "__attach_version1.0_#00000001": {"__substg1.0_3704001F": u("x.bin"), "__substg1.0_37010102": b"\0\1"},
        "__attach_version1.0_#00000002": {"__substg1.0_3701000D": {"__substg1.0_0037001F": u("Inner"), "__substg1.0_0C1A001F": u("eve"), "__substg1.0_10130102": b"<p>Hi <b>there</b></p>"}},
    }
    text, meta = extract.email(_ole(message))
    assert text.startswith("Subject: Grüße\nFrom: Иван\nTo: bob\nDate: Sun, 13 Mar 2011 07:06:40 +0000\n\nBody text")
    assert "\n--- Attachment: note.txt ---\ninside the note" in text and text.endswith("\n--- Attachment: unnamed ---\nSubject: Inner\nFrom: eve\nHi there")
    assert (meta["attachment_count"], meta["attachments_processed"], meta["attachment_names"]) == ("3", "2", "note.txt, unnamed")
    for bad in (_ole(message)[:700], _ole({"WordDocument": b"x"}), b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\xff" * 2000, b"just words", b""):
        with pytest.raises(extract.ExtractionError, match="Failed to open MSG"):
            extract.email(bad)


def _pdf(*objects: bytes, tail: bytes = b"trailer << /Root 1 0 R >>") -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + tail


def test_pdf():
    import zlib

    stream = lambda head, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    one = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w\\366rld) Tj 0 -14 Td [(spa) -20 (ced) -300 (out)] TJ ET BT /F2 9 Tf 1 0 0 1 72 600 Tm <00010002000300040009> Tj ET")
    six = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 9 0 R >> "
    head = b"6 0 7 %d " % len(six)
    inner, first = head + six + b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [228 /adieresis 39 /quoteright] >> >>", len(head)
    data = _pdf(
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R 4 0 R 10 0 R] /Resources << /Font << /F1 7 0 R /F2 6 0 R >> /XObject << /X 11 0 R >> >> >>",
        b"<< /Type /Page /Contents [5 0 R] >>",
        b"<< /Type /Page /Contents 8 0 R >>",
        stream(b"/Filter /FlateDecode", one),
        b"null",
        b"null",
        stream(b"/Filter /ASCIIHexDecode", b"BT /F1 9 Tf (page two) Tj T* (it's \xe4) Tj ET /X Do".hex().encode() + b">"),
        stream(b"", cmap),
        b"<< /Type /Page >>",
        stream(b"/Type /XObject /Subtype /Form", b"BT /F1 9 Tf (in a form) Tj ET"),
        stream(b"/Type /ObjStm /N 2 /First %d" % first, inner),
    ).replace(b"6 0 obj\nnull\nendobj\n7 0 obj\nnull\nendobj\n", b"")
    text, meta = extract.pdf(data)
    assert text == "Hello (big) wörld\nspaced out\nЖabc\n\npage two\nit’s ä\nin a form" and meta == {"page_count": "2", "ocr_used": "False"}
    assert extract.pdf(_pdf(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [2 0 R] >>"))[0] == ""
    for bad in (b"", b"no pdf", _pdf(b"<< >>", tail=b"trailer << /Root 1 0 R /Encrypt 2 0 R >>"), _pdf(b"<< /Type /Page /Contents 2 0 R >>", stream(b"/Filter /FlateDecode", b"xx"))):
        with pytest.raises(extract.ExtractionError, match="Failed to extract PDF"):
            extract.pdf(bad)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 600), st.binary(min_size=1, max_size=8))
def test_broken_files_never_hang(at, junk):
    whole = _pdf(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Length 30 >>\nstream\nBT (some text) Tj ET            \nendstream")
    message = _ole({"__substg1.0_0037001F": b"a\0" * 300, "s": {"t": b"x" * 100}})
    for f, data in ((extract.pdf, whole), (extract.email, message)):
        try:
            f(data[:at] + junk + data[at + len(junk) :])
        except extract.ExtractionError:
            pass


def test_extraction_timeout(spark):
    import time

    def slow(content):
        time.sleep(30)

    df = spark.createDataFrame([("/a", "text", b"x"), ("/b", "slow", b"x")], "file_path string, file_type string, content binary")
    began = time.time()
    got = {r["file_path"]: r["error"] for r in extract.extract(df, {"text": extract.text, "slow": slow}, timeout=1).collect()}
    assert got == {"/a": None, "/b": "Extraction timed out after 1s: /b"} and time.time() - began < 25


def test_journal(spark):
    big = (1 << 64) - 5
    data = journal.record(big, 1, 10, 0x100, 0, "é.txt") + journal.record(7, 1, 11, 0x80000000, 0x10, "dir") + b"\0" * 8
    df = spark.createDataFrame([(bytearray(data),), (None,)], "content binary")
    rows = journal.decoded(df).orderBy("usn").collect()
    assert [(int(r["ref"]), r["usn"], r["reason"], r["name"], r["is_directory"]) for r in rows] == [(big, 10, 0x100, "é.txt", False), (7, 11, 0x80000000, "dir", True)]
    assert crawl.latest_changes(journal.decoded(df)).count() == 1
    assert journal.since(journal.decoded(df), 11).count() == 1
    assert journal.continuous({"journal_id": 1, "next_usn": 5}, {"journal_id": 1, "first_usn": 3}) and not journal.continuous({"journal_id": 1, "next_usn": 2}, {"journal_id": 1, "first_usn": 3})
    paths = spark.createDataFrame([(7, "\\\\?\\D:\\x")], "ref long, path string").withColumn("ref", F.col("ref").cast("decimal(20,0)"))
    assert journal.resolved(journal.decoded(df), paths).first()["path"] == "D:\\x"


def test_config(tmp_path):
    assert config.load().chunking.chunk_size == 1000
    p = tmp_path / "c.json"
    p.write_text('{"chunking": {"chunk_size": 500, "nonsense": 1}, "pipeline": {"type_max_mb": {"pdf": 7}}, "unknown": 3}')
    got = config.load(str(p))
    assert (got.chunking.chunk_size, got.chunking.chunk_overlap, got.pipeline.type_max_mb["pdf"], got.pipeline.type_max_mb["text"]) == (500, 200, 7, 100)


def test_embedders_agree(spark):
    df = spark.createDataFrame([(0, "Hello hello world"), (1, "")], "id long, text string")
    dense = embed.HashedEmbedder().embed(["Hello hello world"])[0]
    sparse = {r["bucket"]: r["w"] for r in embed.hashed(df, ["id"]).collect()}
    assert {i: round(v, 9) for i, v in enumerate(dense) if v} == {b: round(w, 9) for b, w in sparse.items()}
    assert embed.embed(df, embed.HashedEmbedder()).count() == 2


def test_vectors(spark):
    df = spark.createDataFrame([("a", 0, "x", "t", [1.0, 0.0]), ("a", 1, "y", "t", [0.0, 1.0]), ("b", 0, "z", None, [1.0, 1.0])], schemas.VECTORS)
    assert [r["file_path"] for r in vectors.top_k(df, [1.0, 0.0], 2, ["file_path", "chunk_index"]).collect()] == ["a", "b"]
    assert vectors.matching(df, None, {"file_type": ["t"]}).count() == 1
    new = spark.createDataFrame([("a", 0, "n", "t", [1.0, 0.0])], schemas.VECTORS)
    once = vectors.replace_files(df, new)
    assert once.count() == 2 and vectors.replace_files(once, new).count() == 2
    assert vectors.delete_files(df, df.filter("file_path = 'a'")).count() == 1
    assert vectors.file_chunks(df, df.select("file_path"), 1).count() == 2


def test_more_keywords_never_lower(spark):
    hits = spark.createDataFrame([(0, 0, 1, "/f", 0, "jill went", 0.5, "text")], "query_id long, source_rank int, rank int, file_path string, chunk_index int, text string, score double, file_type string")
    words = lambda k, e: spark.createDataFrame([(0, k, e)], "query_id long, keywords array<string>, entities array<string>")
    a = retrieval.rerank(hits, words(["jill"], [])).first()["score"]
    b = retrieval.rerank(hits, words(["jill", "went"], ["jill"])).first()["score"]
    assert a == 0.58 and b == 0.88
    assert retrieval.depths(0) == {"k": 10, "original": 5, "diverse": 15, "broad": 60, "each": 60, "supplement": 30}
    assert retrieval.supplement_queries(retrieval.missing_keywords(hits, words(["zed"], [])), words(["zed"], [])).count() == 4
    extra = hits.withColumn("file_path", F.lit("/zed")).withColumn("keyword", F.lit("zed"))
    assert retrieval.supplemented(hits, extra).count() == 2
    assert context.without_system_files(hits.withColumn("file_path", F.lit("/x/.git/y"))).count() == 0


def test_answer_compat(spark):
    df = spark.createDataFrame([("| Name | x |",)], "a string")
    assert df.select(c.clean_answer(F.col("a"))).first()[0] == "| Name | x |"
    assert df.select(c.clean_answer(F.col("a"), compat=True)).first()[0] == ""


def test_samples(spark):
    df = _files(spark, [(f"f{i}", 1, 1.0, "error", 0, "PDF broken" if i % 2 else "") for i in range(20)])
    from lodestone.functions import fixed

    s = diagnostics.sample(df, 10, 1)
    assert s.count() == 10
    assert diagnostics.extrapolated(s, 20, fixed.ERROR_RULES, "none").agg(F.sum("estimate")).first()[0] == 20


def test_reason_is_named(spark):
    """What was wrong with a message stays in its category."""
    from lodestone.functions import fixed

    df = _files(spark, [(str(i), 1, 1.0, "error", 0, e) for i, e in enumerate(["Failed to open MSG: a.msg: bad header ", "Failed to open MSG at all", "x.msg: Unknown code page 950"])])
    got = {r["category"] for r in diagnostics.error_taxonomy(df, fixed.ERROR_RULES, "none").collect()}
    assert got == {"Failed to open MSG: bad header", "Failed to open MSG: unknown reason", "Unknown code page (corrupt .msg encoding)"}


def test_errors_like(spark):
    df = _files(spark, [("a.mp3", 1, 1.0, "error", 0, "Failed to transcribe audio: x"), ("b.wav", 1, 1.0, "error", 0, "No such file"), ("c", 1, 1.0, "error", 0, None), ("d", 1, 1.0, "indexed", 0, "Failed to transcribe audio")])
    names = lambda **k: [r["file_path"] for r in diagnostics.errors_like(df, **k).collect()]
    assert names(like=["%transcribe%"]) == ["a.mp3"] and names(unlike=["%transcribe%"]) == ["b.wav"] and names(paths=[["%.mp3", "%.wav"], ["a%"]]) == ["a.mp3"]
    assert len(names()) == 3


def test_programs(monkeypatch):
    """Programs stand in for recognition: what they print is the text, and what they can't do is an error."""
    import struct
    import sys

    from lodestone.sources import programs

    py = lambda code: [sys.executable, "-c", code, "{in}", "{out}"]
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    assert programs.image(py("import sys; print(' text of', len(open(sys.argv[1], 'rb').read()))"))(png) == ("text of 24", {"image_size": "640x480"})
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + b"x" * 9
    assert programs.picture_size(jpeg) == {"image_size": "32x16"} and programs.picture_size(b"GIF") == {} and programs.picture_size(b"\xff\xd8") == {}
    speech = programs.audio(py("import sys; print(open(sys.argv[1]).read().upper()); print('end')"))
    assert speech(b"hello") == ("HELLO end", {})
    assert programs.video(speech, py("import sys; open(sys.argv[2], 'w').write('sound of ' + open(sys.argv[1]).read())"))(b"film") == ("SOUND OF FILM end", {"source_type": "video"})
    for bad in (py("import sys; sys.exit('no such codec')"), ["/no/such/program"]):
        with pytest.raises(programs.ProgramError):
            programs.image(bad)(b"x")
    with pytest.raises(programs.ProgramError, match="made no file"):
        programs.video(speech, py("pass"))(b"x")
    assert programs.found(lambda n: None, lambda n: None) == {}
    assert set(programs.found(lambda n: f"/bin/{n}", lambda n: None)) == {"image", "audio", "video"}
    lazy = {"text": "lodestone.sources.extract:text"}
    assert extract.resolved(lazy, "text")(b"x") == ("x", {"encoding": "utf-8"}) and callable(lazy["text"])


def test_chat_model(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lodestone.operators import answer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"message": {"content": "1. first query\n- `second query`\nx"}}).encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    m = answer.ChatModel(f"http://127.0.0.1:{s.server_address[1]}/api/chat", "some-model")
    try:
        assert m.expand_broad("all orders") == ["first query", "second query"] and m.answer("who?", "[Source 1: a]", 16384).startswith("1. first")
        assert asked[-1]["options"] == {"num_ctx": 16384} and "[Source 1: a]" in asked[-1]["messages"][0]["content"]
    finally:
        s.shutdown()
        s.server_close()
    assert m.expand("a question") == "a question" and m.expand_broad("a question") == ["a question"]
    reply = "1. order confirmation\n2) \"serial number\"\n• x\n   plain words  "
    want = spark.createDataFrame([(reply,)], "r string").select(c.expansion_lines(F.col("r"))).first()[0]
    assert answer.lines(reply) == want
