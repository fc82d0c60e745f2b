"""Mail: Outlook's messages and RFC 822 text, with their attachments."""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Callable
from email import message_from_bytes, policy
from email.utils import format_datetime
from html.parser import HTMLParser

from lodestone.sources import ole

#: Text of an attachment of this name and content, or None.
Inner = Callable[[str, bytes], str | None]
#: Tried in this order where a message's own code page fails.
ENCODINGS = ["utf-8", "cp1252", "shift_jis", "gb2312", "euc_kr", "cp950", "latin-1"]
CODE_PAGES = {65001: "utf-8", 20127: "ascii", 28591: "latin-1", 932: "shift_jis", 936: "gbk", 949: "euc_kr", 950: "cp950", 20866: "koi8-r"}
#: Property tags.
SUBJECT, SENDER, SENDER_ADDRESS, REPRESENTED, TO, CC, BODY, HTML, SENT, RECEIVED = "0037", "0C1A", "0C1F", "0042", "0E04", "0E03", "1000", "1013", "0039", "0E06"
LONG_NAME, SHORT_NAME, DATA, EMBEDDED = "3707", "3704", "37010102", "3701000D"


class _Plain(HTMLParser):
    """The text of mark-up, a line for each block."""

    def __init__(self):
        super().__init__()
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "head")
        if tag in ("p", "br", "div", "tr", "li", "h1", "h2", "h3"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in ("script", "style", "head")))

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def plain(html: str) -> str:
    p = _Plain()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


class _Message:
    """A message's storage: the streams below a prefix."""

    def __init__(self, streams: dict[str, bytes], prefix: str, header: int):
        self.streams, self.prefix = streams, prefix
        raw = streams.get(f"{prefix}__properties_version1.0", b"")
        self.fixed = {struct.unpack_from("<I", raw, at)[0]: raw[at + 8 : at + 16] for at in range(header, len(raw) - 15, 16)}
        page = next((struct.unpack("<I", self.fixed[t][:4])[0] for t in (0x3FFD0003, 0x3FDE0003) if t in self.fixed), None)
        named = CODE_PAGES.get(page, f"cp{page}") if page else None
        self.encodings = [*([named] if named else []), *ENCODINGS]

    def decoded(self, raw: bytes) -> str:
        for e in self.encodings:
            try:
                return raw.decode(e)
            except (UnicodeDecodeError, LookupError):
                continue
        return raw.decode("latin-1")

    def text(self, *tags: str) -> str:
        """The first of the string properties that isn't empty."""
        for tag in tags:
            if (raw := self.streams.get(f"{self.prefix}__substg1.0_{tag}001F")) is not None:
                said = raw.decode("utf-16-le", "replace")
            else:
                said = self.decoded(self.streams.get(f"{self.prefix}__substg1.0_{tag}001E", b""))
            if said := said.rstrip("\0"):
                return said
        return ""

    def date(self) -> str:
        for tag in (SENT, RECEIVED):
            if raw := self.fixed.get(int(tag, 16) << 16 | 0x40):
                ticks = struct.unpack("<Q", raw)[0]
                try:
                    return format_datetime(datetime.datetime(1601, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(microseconds=ticks // 10))
                except OverflowError:
                    continue
        return self.text(SENT)

    def body(self) -> str:
        if said := self.text(BODY):
            return said
        raw = self.streams.get(f"{self.prefix}__substg1.0_{HTML}0102")
        return plain(self.decoded(raw)) if raw else plain(self.text(HTML))

    def sender(self) -> str:
        return self.text(SENDER, REPRESENTED, SENDER_ADDRESS)

    def attachments(self) -> list[str]:
        found = {m[0] for p in self.streams if p.startswith(self.prefix) and (m := re.match(r"__attach_version1\.0_#[0-9A-F]+/", p[len(self.prefix) :]))}
        return [self.prefix + x for x in sorted(found)]


def _joined(head: dict[str, str], body: str, attached: list[tuple[str, str]], total: int) -> tuple[str, dict[str, str]]:
    parts = [f"{k}: {v}" for k, v in head.items() if v] + [""] + ([body] if body.strip() else [])
    parts += [f"\n--- Attachment: {name} ---\n{said}" for name, said in attached]
    names = [name for name, _ in attached]
    meta = {"subject": head["Subject"], "sender": head["From"], "date": head["Date"], "attachment_count": str(total), "attachments_processed": str(len(names))}
    return "\n".join(parts).strip(), meta | ({"attachment_names": ", ".join(names)} if names else {})


def outlook(content: bytes, inner: Inner) -> tuple[str, dict[str, str]]:
    """Header lines, the body, and attachments by their own type; a message inside has its subject, sender and body."""
    streams = ole.streams(content)
    if not any("__substg1.0_" in p or "__properties_version1.0" in p for p in streams):
        raise ole.CompoundError("no message in this compound file")
    m = _Message(streams, "", 32)
    head = {"Subject": m.text(SUBJECT), "From": m.sender(), "To": m.text(TO), "CC": m.text(CC), "Date": m.date()}
    attached, places = [], m.attachments()
    for at in places:
        a = _Message(streams, at, 8)
        name, data = a.text(LONG_NAME, SHORT_NAME), streams.get(f"{at}__substg1.0_{DATA}")
        inside = f"{at}__substg1.0_{EMBEDDED}/"
        if any(p.startswith(inside) for p in streams):
            e = _Message(streams, inside, 24)
            said = "\n".join(x for x in (f"Subject: {e.text(SUBJECT)}" * bool(e.text(SUBJECT)), f"From: {e.sender()}" * bool(e.sender()), e.body()) if x).strip()
        else:
            said = inner(name, data) if name and data else None
        if said:
            attached.append((name or "unnamed", said))
    return _joined(head, m.body(), attached, len(places))


def rfc822(content: bytes, inner: Inner) -> tuple[str, dict[str, str]]:
    """The same of RFC 822 mail."""
    msg = message_from_bytes(content, policy=policy.default)
    part = msg.get_body(("plain", "html"))
    body = part.get_content() if part is not None else ""
    attached, total = [], 0
    for a in msg.iter_attachments():
        total += 1
        name = a.get_filename() or ""
        if a.get_content_type() == "message/rfc822":
            said = rfc822(bytes(a.get_payload(0)), inner)[0]
        else:
            said = inner(name, a.get_payload(decode=True) or b"") if name else None
        if said:
            attached.append((name or "unnamed", said))
    return _joined({k: str(msg[k] or "") for k in ("Subject", "From", "To", "CC", "Date")}, body, attached, total)


def read(content: bytes, inner: Inner) -> tuple[str, dict[str, str]]:
    """By what the content is, whatever its name; what is neither raises ValueError."""
    if content.startswith(ole.SIGNATURE):
        return outlook(content, inner)
    if re.match(rb"\s*[!-9;-~]+:[ \t]", content) and b"\0" not in content[:4096]:
        return rfc822(content.lstrip(), inner)
    raise ValueError("neither an Outlook message nor RFC 822 mail")
