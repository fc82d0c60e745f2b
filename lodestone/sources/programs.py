"""Extractors that hand a file to a program: recognition of text in pictures, of speech in sound, and sound out of video."""

from __future__ import annotations

import importlib.util
import os
import shutil
import struct
import subprocess
import tempfile
from collections.abc import Callable

#: The sound that recognition of speech is given.
SOUND = ["-acodec", "pcm_s16le", "-ac", "1", "-ar", "16000"]


class ProgramError(ValueError):
    pass


def run(argv: list[str], content: bytes, suffix: str = "", out: str | None = None) -> bytes:
    """What a program prints, or writes to a file of the suffix ``out``. {in} and {out} in argv stand for the files; the folder goes with its task."""
    with tempfile.TemporaryDirectory() as d:
        given, made = os.path.join(d, f"given{suffix}"), os.path.join(d, f"made{out or ''}")
        with open(given, "wb") as f:
            f.write(content)
        try:
            got = subprocess.run([a.replace("{in}", given).replace("{out}", made) for a in argv], capture_output=True, check=False)
        except OSError as e:
            raise ProgramError(f"{argv[0]} can't be run: {e}") from e
        if got.returncode:
            raise ProgramError(f"{os.path.basename(argv[0])} failed: {got.stderr.decode('utf-8', 'replace').strip()[-300:]}")
        if out is None:
            return got.stdout
        if not os.path.exists(made):
            raise ProgramError(f"{os.path.basename(argv[0])} failed: it made no file")
        with open(made, "rb") as f:
            return f.read()


def picture_size(content: bytes) -> dict[str, str]:
    """The size of PNG, BMP and JPEG pictures, as their headers say; nothing for others."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return {"image_size": "{}x{}".format(*struct.unpack_from(">II", content, 16))}
    if content[:2] == b"BM" and len(content) >= 26:
        return {"image_size": "{}x{}".format(*map(abs, struct.unpack_from("<ii", content, 18)))}
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], struct.unpack_from(">H", content, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", content, at + 5)
            return {"image_size": f"{width}x{height}"}
        at += 2 + size
    return {}


def image(argv: list[str]) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """Text in pictures: what the program prints. A picture without text is no error."""
    return lambda content: (run(argv, content).decode("utf-8", "replace").strip(), picture_size(content))


def audio(argv: list[str], suffix: str = ".wav") -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """Speech as text: the program's lines, joined by spaces."""
    return lambda content: (" ".join(run(argv, content, suffix).decode("utf-8", "replace").split("\n")).strip(), {})


def video(speech: Callable[[bytes], tuple[str, dict[str, str]]], argv: list[str]) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """A video's sound, which the program writes, as text."""

    def extract(content: bytes) -> tuple[str, dict[str, str]]:
        said, meta = speech(run(argv, content, out=".wav"))
        return said, meta | {"source_type": "video"}

    return extract


def whisper(model: str = "large-v3", device: str = "auto", language: str | None = None) -> Callable[[bytes], tuple[str, dict[str, str]]]:
    """Speech as text by the faster_whisper library; its model is loaded by the first file of a worker."""
    held: list = []

    def extract(content: bytes) -> tuple[str, dict[str, str]]:
        import io

        if not held:
            from faster_whisper import WhisperModel

            held.append(WhisperModel(model, device=device))
        segments, info = held[0].transcribe(io.BytesIO(content), language=language, beam_size=5, vad_filter=True)
        return " ".join(s.text.strip() for s in segments), {"language": str(info.language), "duration": str(round(info.duration, 1))}

    return extract


def found(which: Callable[[str], str | None] = shutil.which, has: Callable[[str], object] = importlib.util.find_spec) -> dict[str, Callable[[bytes], tuple[str, dict[str, str]]]]:
    """The extractors for what this machine has."""
    out = {}
    if at := which("tesseract"):
        out["image"] = image([at, "{in}", "stdout"])
    if has("faster_whisper"):
        out["audio"] = whisper()
    elif at := which("whisper-cli"):
        out["audio"] = audio([at, "-nt", "-np", "-f", "{in}"])
    if "audio" in out and (at := which("ffmpeg")):
        out["video"] = video(out["audio"], [at, "-y", "-i", "{in}", *SOUND, "{out}"])
    return out
