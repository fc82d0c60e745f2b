"""Text of files by type. A file that can't be read gives an error, never a failed job."""

from __future__ import annotations

import importlib
import io
import signal
import struct
import threading
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import columns as c
from lodestone.sources import mail, programs
from lodestone.sources import pdf as pages

#: Paths of one listing: that many file names are on the driver at once.
PATHS = 4096


class ExtractionError(Exception):
    pass


class ExtractionTimeout(BaseException):
    """Not an Exception, so that no reader takes it for a fault of its own."""


@contextmanager
def limited(seconds: float | None):
    """Ends what runs inside after so many seconds, with ExtractionTimeout. In a thread beside the main one there is no limit."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise ExtractionTimeout

    was = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, was)


Extractor = Callable[[bytes], tuple[str, dict[str, str]]]


def text(content: bytes) -> tuple[str, dict[str, str]]:
    """UTF-8, or else Latin-1. Mark-up stays as it is."""
    try:
        return content.decode("utf-8"), {"encoding": "utf-8"}
    except UnicodeDecodeError:
        return content.decode("latin-1"), {"encoding": "latin-1"}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(content: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs that aren't blank, a line each, then table rows with their cells between bars."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ExtractionError(f"Failed to open DOCX: {e}") from e
    said = lambda el: "".join(t.text or "" for t in el.iter(f"{_W}t"))
    lines = [s for p in body.findall(f"{_W}p") if (s := said(p)).strip()]
    n = len(lines)
    for row in body.iter(f"{_W}tr"):
        cells = [s for cell in row.findall(f"{_W}tc") if (s := said(cell).strip())]
        if cells:
            lines.append(" | ".join(cells))
    return "\n".join(lines), {"paragraph_count": str(n)}


def pdf(content: bytes) -> tuple[str, dict[str, str]]:
    """The text layer, page by page."""
    try:
        return pages.read(content)
    except (ValueError, zlib.error, RecursionError) as e:
        raise ExtractionError(f"Failed to extract PDF: {e}") from e


def email(content: bytes) -> tuple[str, dict[str, str]]:
    """Mail: header lines, the body, and attachments by their own type. What is no mail is an error, not text."""

    def inner(name: str, data: bytes) -> str | None:
        kind = next((k for k, exts in _types().items() if any(name.lower().endswith(e) for e in exts)), None)
        try:
            return resolved(REGISTRY, kind)(data)[0]
        except Exception:  # noqa: BLE001  an attachment that can't be read doesn't take its mail along
            return None

    try:
        return mail.read(content, inner)
    except (ValueError, struct.error, LookupError) as e:
        raise ExtractionError(f"Failed to open MSG: {e}") from e


def _types() -> dict[str, list[str]]:
    from lodestone.functions import fixed

    return fixed.EXTENSIONS


def absent(kind: str) -> Extractor:
    """Stands in for a model or a library that isn't here."""

    def run(content: bytes) -> tuple[str, dict[str, str]]:
        raise ExtractionError(f"{kind} extraction needs a plug-in: register one in lodestone.sources.extract.REGISTRY")

    return run


#: An extractor for each type; others can be put in their place, also by name ("module:function"), which a worker loads with its first file.
REGISTRY: dict[str, Extractor | str] = {"text": text, "pdf": pdf, "docx": docx, "msg": email} | {k: absent(k) for k in ("image", "audio", "video")} | programs.found()


def resolved(registry: dict[str, Extractor | str], kind: str) -> Extractor:
    """The extractor of a type, loaded once where only its name is known."""
    f = registry[kind]
    if isinstance(f, str):
        module, _, name = f.partition(":")
        f = registry[kind] = getattr(importlib.import_module(module), name)
    return f


def extract(contents: DataFrame, registry: dict[str, Extractor] | None = None, timeout: float | None = 300) -> DataFrame:
    """file_path, file_type, text, metadata, error of (file_path, file_type, content); a file that takes over timeout seconds is an error."""
    known = REGISTRY if registry is None else registry

    def one(path: str | None, kind: str | None, content: bytes | None) -> tuple[str | None, dict, str | None]:
        if kind not in known:
            return None, {}, f"No extractor for type: {kind}"
        try:
            with limited(timeout):
                said, meta = resolved(known, kind)(content or b"")
            return said, meta | {"file_type": kind}, None
        except ExtractionTimeout:
            return None, {}, f"Extraction timed out after {timeout}s: {path}"
        except Exception as e:  # noqa: BLE001  one file's fault is its own
            return None, {}, f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, kind, content = (b.column(i).to_pylist() for i in range(3))
            out = [one(p, k, x) for p, k, x in zip(path, kind, content, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(kind, pa.string()), pa.array([o[0] for o in out], pa.string()), pa.array([list(o[1].items()) for o in out], pa.map_(pa.string(), pa.string())), pa.array([o[2] for o in out], pa.string())], names=["file_path", "file_type", "text", "metadata", "error"])

    return contents.select("file_path", "file_type", "content").mapInArrow(run, schemas.EXTRACTED)


def contents(spark: SparkSession, queued: DataFrame) -> DataFrame:
    """file_path, file_type, content of the queued files (path) alone: what isn't queued isn't opened. Files that are gone by now fall out."""
    from lodestone.sources import files

    names = (r["path"] for r in queued.select("path").distinct().toLocalIterator())
    out = spark.createDataFrame([], "file_path string, content binary")
    while some := [p for p in islice(names, PATHS) if files.exists(spark, p)]:
        df = spark.read.format("binaryFile").load([*map(files.escaped, some)])
        out = out.unionByName(df.select(files.plain_path(F.col("path")).alias("file_path"), "content"))
    return out.withColumn("file_type", c.file_type(c.extension(F.col("file_path"))))
