"""BPE encoding as a streaming transducer, and decoding as a byte-to-text state machine.

The encoding of a prefix never depends on what follows, except through its last tokens. With ``last[i]`` the last token
of the encoding of the first i symbols, that encoding is the one of the first ``i - len(last[i])`` symbols, then
``last[i]``; a token can follow another just if merging the two tokens' symbols gives back these two. So one pass finds
``last`` symbol by symbol. No token is longer than ``lookahead`` symbols, which follows from the merge list, so whatever
comes next continues one of the last ``lookahead`` boundaries: the tokens on which these all agree are stable, and are
emitted. Memory is the window of boundaries that are still open. A word that fits in a window has no boundary to give up
before its end: there the same transitions are followed from the left, the longest token first, and boundaries from which
none leads on are left for good, which gives the same tokens in fewer steps.

Every piece of round_trip_digests() and encode() is encoded so. Packing, whose ids are the tokenizers library's, gives new
pieces to the library's model, and parts many texts at once by tables of characters. Texts are taken in windows that end at white space, normalised and split as the vocabulary
file says; no piece crosses white space, so what a worker has encoded is kept by whole stretches between white space, in
a cache of fixed size. Beside the text, encode_stream() and decoded() hold a window. Null text counts as empty and has no
ids; text that spells a special token becomes that token, as in the tokenizers library. Repeated rows give repeated rows
and ties don't occur: a text has one encoding. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import per_batch

#: Entries of each of the two generations of an encoder's cache: when the young one is full, it becomes the old one. Pairs of tokens whose order is known.
CACHED, PAIRS = 350_000, 250_000
#: Entries of a generation, and symbols of a piece, where new pieces go to the library's model.
FEWER, SHORT = 150_000, 128
#: Ids that are decoded at once; characters, about, that are encoded at once.
STEP, WINDOW = 1 << 16, 1 << 16
#: Ids have so many bits; NONE is above every rank.
BITS, MASK, NONE = 20, (1 << 20) - 1, 1 << 60
#: White space of the tokenizers library's patterns.
WHITE = regex.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Transducer:
    """Words, as strings of symbols, to token ids."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        merges = [tuple(m) for m in merges]
        #: For a pair of ids the rank of its merge, then the id that it makes, in one number.
        self.table = {vocab[a] << BITS | vocab[b]: i << BITS | vocab[a + b] for i, (a, b) in enumerate(merges)}
        self.lookahead = self.sufficient_lookahead(merges)
        self.first = {t: i for t, i in vocab.items() if len(t) == 1}
        self.last = {t[0]: i for t, i in vocab.items() if suffix and t[1:] == suffix} or self.first
        self.parts = {i: self.symbols(t) for t, i in vocab.items()}
        self.follows: dict[int, bool] = {}
        #: The most symbols of a token by its first four; a token of fewer symbols needs none.
        self.reach: dict[str, int] = {}
        for t in vocab:
            body = t[: -len(suffix)] if suffix and t.endswith(suffix) else t
            if len(body) >= 4:
                self.reach[body[:4]] = max(len(body), self.reach.get(body[:4], 0))

    @staticmethod
    def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
        """Symbols of the longest token that the merge list can build: the boundaries that may still be continued."""
        n: dict[str, int] = {}
        for a, b in merges:
            n[a + b] = n.get(a, 1) + n.get(b, 1)
        return max(n.values(), default=1)

    def symbols(self, token: str) -> list[int]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*map(self.first.get, body[:-1]), self.last.get(body[-1])]
        return [*map(self.first.get, token)]

    def merged(self, ids: list[int]) -> list[int]:
        """The merge list applied as it is defined: the pair of lowest rank first, from the left."""
        get = self.table.get
        found = [get(a << BITS | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) != NONE:
            i = found.index(best)
            ids[i] = best & MASK
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << BITS | ids[i], NONE)
            if i < len(found):
                found[i] = get(ids[i] << BITS | ids[i + 1], NONE)
        return ids

    def fits(self, before: int, token: int) -> bool:
        """Whether token can follow before; -1 starts the word."""
        key = before + 1 << BITS | token
        if (found := self.follows.get(key)) is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            if before < 0:
                found = self.merged([*self.parts[token]]) == [token]
            else:
                found = self.merged(self.parts[before] + self.parts[token]) == [before, token]
            self.follows[key] = found
        return found

    def whole(self, word: str) -> list[int]:
        """The tokens of a word by the merge list."""
        return self.merged([*map(self.first.__getitem__, word[:-1]), self.last[word[-1]]])

    def stream(self, word: str) -> Iterator[int]:
        """The tokens of a word, each as soon as it is stable."""
        look, n = self.lookahead, len(word)
        if n <= 4 * look:
            yield from self._window(word)
            return
        get, fits, suffix = self.vocab.get, self.fits, self.suffix
        base, last, size = 0, [-1], [0]  # last[i - base] is the last token of the first i symbols, of size[i - base] symbols
        for i in range(1, n + 1):
            end = suffix if i == n else ""
            for k in range(min(look, i - base), 0, -1):
                token = get(word[i - k : i] + end)
                if token is not None and fits(last[i - k - base], token):
                    last.append(token)
                    size.append(k)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at symbol {i}")
            if i - base >= 4 * look and i < n:
                open_ = {*range(i - look + 1, i + 1)}  # boundaries that a token may continue
                while len(open_) > 1:
                    at = max(open_)
                    open_.discard(at)
                    open_.add(at - size[at - base])
                stable = open_.pop()
                if stable > base:
                    yield from self._path(last, size, stable - base)
                    last, size, base = last[stable - base :], [0, *size[stable - base + 1 :]], stable
        yield from self._path(last, size, n - base)

    def _window(self, word: str) -> list[int]:
        """The tokens of a word that fits in the window."""
        get, known, suffix, n = self.vocab.get, self.follows.get, self.suffix, len(word)
        reach = self.reach.get
        out, taken, dead, before, at, k = [], [], set(), -1, 0, n
        while at < n:
            if k > 3:
                k = min(k, reach(word[at : at + 4], 3))
            while k:
                end = at + k
                if end not in dead:
                    token = get(word[at:end]) if end < n else get(word[at:] + suffix)
                    if token is not None:
                        on = known(before + 1 << BITS | token)
                        if self.fits(before, token) if on is None else on:
                            break
                k -= 1
            if k:
                taken.append((before, at, k))
                out.append(token)
                before, at, k = token, end, n - end
            elif taken:  # no token leads on from here
                dead.add(at)
                before, at, k = taken.pop()
                out.pop()
                k -= 1
            else:
                raise ValueError("the vocabulary lacks a symbol of this word")
        return out

    @staticmethod
    def _path(last: list[int], size: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


def little(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


#: str.split() also parts at these, which are not white space here.
ODD = "\x1c\x1d\x1e\x1f"
#: Kinds of characters: letters, numbers and the rest as the split pattern has them; what stands beside a character of no kind isn't parted.
NO_KIND, BLANK, LETTER, NUMBER, REST, APOSTROPHE = range(6)


def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each of the first 2^16 characters, with white space as a space, and its kind."""
    chars = [chr(i) for i in range(0xFFFF) if not 0xD800 <= i < 0xE000]
    lower, kind = np.arange(1 << 16, dtype=np.uint32), np.full(1 << 16, NO_KIND, dtype=np.uint8)
    text = "".join(chars)
    for k, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (REST, r"[^\s\p{L}\p{N}]"), (BLANK, WHITE.pattern[:-1])):
        kind[[ord(c) for c in regex.findall(pattern, text)]] = k
    kind[ord("'")] = APOSTROPHE
    lower[kind == BLANK] = 0x20
    for c in chars:
        if (low := c.lower()) != c:
            lower[ord(c)] = ord(low) if len(low) == 1 and ord(low) < 0xFFFF else ord(c)
            if lower[ord(c)] == ord(c):
                kind[ord(c)] = NO_KIND
    return lower, kind[lower]


def parting_kinds() -> np.ndarray:
    """Whether the split pattern always parts two kinds that follow each other: at kind of the first * 8 + kind of the second."""
    out = np.zeros((8, 8), dtype=bool)
    out[NUMBER, [NO_KIND, LETTER, NUMBER, REST, APOSTROPHE]] = out[[NO_KIND, LETTER, NUMBER, REST, APOSTROPHE], NUMBER] = True
    out[LETTER, [REST, APOSTROPHE]] = out[REST, LETTER] = True  # an apostrophe may begin a piece with the letters after it
    return out.ravel()


class Encoder:
    """The encoding of a tokenizers file with NFC, white space, lower case, a split pattern and byte-level symbols."""

    def __init__(self, path: str, direct: bool = False):
        """direct: pieces of up to SHORT symbols by the tokenizers library's model, many at once, not through the transducer; the ids are the same."""
        self.model = Tokenizer(Tokenizer.from_file(path).model) if direct else None
        self.tables = (*character_tables(), parting_kinds()) if direct else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or spec["decoder"]:
            raise ValueError("this file has steps that are not supported")
        self.path, self.pattern = path, regex.compile(split["pattern"]["Regex"])
        self._transducer = None if direct else self._made(model)
        self.byte = dict(enumerate(byte_symbols()))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = {s[:2] for s in self.special}
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        #: Ids of pieces, and of stretches between white space; a piece is a stretch with that piece alone.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Pieces that went through the transducer; the others were in the cache.
        self.streamed = 0

    @staticmethod
    def _made(model: dict) -> Transducer:
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return Transducer(model["vocab"], merges, model["end_of_word_suffix"] or "")

    @property
    def transducer(self) -> Transducer:
        """Read when a piece needs it: with the library's model only longer ones do."""
        if self._transducer is None:
            with open(self.path, encoding="utf-8") as f:
                self._transducer = self._made(json.load(f)["model"])
        return self._transducer

    def _keep(self, s: str, ids: bytes) -> bytes:
        if len(s) <= 64:
            if len(self.known) >= CACHED:
                self.old, self.known = self.known, {}
            self.known[s] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if (found := self.known.get(piece)) is None and (found := self.old.get(piece)) is None:
            symbols, t = self._symbols(piece), self.transducer
            self.streamed += 1
            found = self._keep(piece, little(t._window(symbols) if len(symbols) <= 4 * t.lookahead else t.stream(symbols)))
        return found

    def _symbols(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8", "replace").decode("latin-1").translate(self.byte)

    def _stretch(self, s: str) -> bytes:
        if (found := self.old.get(s)) is not None:
            return self._keep(s, found)
        pieces = self._pieces(s)
        return self._piece(s) if pieces == [s] else self._keep(s, b"".join(map(self._piece, pieces)))

    def _pieces(self, s: str) -> list[str]:
        low = s.replace("Σ", "σ").lower()
        if low.isalpha():  # a run of letters is one piece
            return [low]
        head, last = low[:-1], low[-1]
        if last in ",.;:!?" and head.isalpha():
            return [head, last]
        return self.pattern.findall(low)

    def _stretches(self, of: Iterable[str]) -> dict[str, bytes]:
        """Ids of stretches that aren't in the young cache; their new pieces go to the model in one call."""
        if len(self.known) >= FEWER:
            self.old, self.known = self.known, {}
        out, several, ids, new, symbols = {}, [], {}, [], []
        known, old = self.known, self.old.get
        for s in of:
            if (found := old(s)) is not None:
                out[s] = known[s] = found
            elif s.isascii() and s.isalpha() and s.islower() and len(s) <= SHORT:
                new.append(s)
                symbols.append(s)
            else:
                several.append((s, self._pieces(s)))
        for _, pieces in several:
            for p in pieces:
                if p in ids:
                    continue
                if (found := known.get(p) or old(p)) is None:
                    as_symbols = self._symbols(p)
                    if len(as_symbols) <= SHORT:
                        new.append(p)
                        symbols.append(as_symbols)
                    else:
                        found = self._piece(p)
                ids[p] = found
        if new:
            e = self.model.encode(symbols, is_pretokenized=True, add_special_tokens=False)
            made, at = little(e.ids), 0
            for p, to in zip(new, (4 * np.searchsorted(e.word_ids, np.arange(len(new)), "right")).tolist(), strict=True):
                ids[p] = out[p] = found = made[at:to]
                at = to
                if len(p) <= 64:
                    known[p] = found
        for s, pieces in several:
            out[s] = found = b"".join(map(ids.__getitem__, pieces))
            if len(s) <= 64:
                known[s] = found
        return out

    def parted(self, texts: list[str]) -> list[str]:
        """Texts in lower case, with spaces where the split pattern parts them in any case, so that fewer unlike stretches are left."""
        lower, kinds, parts = self.tables
        at = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        short = np.minimum(at, 0xFFFF).astype(np.uint16)
        low, kind = lower[short], kinds[short]
        far = np.flatnonzero(at >= 0xFFFF)
        low[far] = at[far]
        low[np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1] = 0x0A  # the only ones: white space is spaces now
        cuts = np.flatnonzero(parts[kind[:-1] << 3 | kind[1:]])
        out = np.empty(len(low) + len(cuts), dtype="<u4")
        to = np.ones(len(out), dtype=bool)
        to[cuts + np.arange(1, len(cuts) + 1)] = False
        out[to], out[~to] = low, 0x20
        return out.tobytes().decode("utf-32-le", "surrogatepass").split("\n")

    def _together(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that need no normalisation beyond parted()."""
        parts = [t.split() for t in self.parted(texts)]
        get, missing = self.known.get, {}
        found = [[*map(get, p)] for p in parts]
        gaps = [[i for i, x in enumerate(f) if x is None] for f in found]
        for p, g in zip(parts, gaps, strict=True):
            missing.update((p[i], None) for i in g)
        made = self._stretches(missing) if missing else {}
        for f, p, g in zip(found, parts, gaps, strict=True):
            for i in g:
                f[i] = made[p[i]]
        return [b"".join(f) for f in found]

    def encode_many(self, texts: Iterable[str | None]) -> list[bytes]:
        """All ids of each text, of many texts at once if the model is the library's."""
        out, at, size = [], [], 0
        for k, text in enumerate(texts):
            text = text or ""
            if not self.model or len(text) > WINDOW or any(c in text for c in ODD) or self.specials and any(m in text for m in self.marks) or not unicodedata.is_normalized("NFC", text):
                out.append(self.encode(text))
                continue
            out.append(text)  # until _fill() puts its ids there
            at.append(k)
            size += len(text)
            if size > 4 * WINDOW:
                self._fill(out, at)
                at, size = [], 0
        self._fill(out, at)
        return out

    def _fill(self, out: list, at: list[int]) -> None:
        for k, ids in zip(at, self._together([out[k] for k in at]) if at else [], strict=True):
            out[k] = ids

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        odd = any(c in text for c in ODD)
        if self.model and not odd:
            return self._together([text])[0]
        parts = [x for x in WHITE.split(text) if x] if odd else text.split()
        found = [*map(self.known.get, parts)]
        if None in found:
            new = {s: None for s, x in zip(parts, found, strict=True) if x is None}
            made = self._stretches(new) if self.model else {s: self._stretch(s) for s in new}
            found = [made[s] if x is None else x for s, x in zip(parts, found, strict=True)]
        return b"".join(found)

    def encode_stream(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a window of the text at a time."""
        at, n = 0, len(text or "")
        while at < n:
            end = min(n, at + WINDOW)
            if end < n:  # on to the next space: what is normalised or matched ends there
                end = text.find(" ", end)
                end = n if end < 0 else end
            part = text[at:end] if end - at < n else text
            at = end
            if not any(m in part for m in self.marks) or not self.specials.search(part):
                yield self._plain(part)
                continue
            for k, p in enumerate(self.specials.split(part)):
                yield little([self.special[p]]) if k % 2 else self._plain(p)

    def encode(self, text: str | None) -> bytes:
        """All ids of a text."""
        return b"".join(self.encode_stream(text))


class Decoder:
    """Ids to text, a step at a time: tokens as the file writes them, parted by a space, through a UTF-8 state machine."""

    def __init__(self, names: list[bytes]):
        self.names, self.state, self.first = names, codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        data = b" ".join(map(self.names.__getitem__, ids.tolist()))
        if len(ids) and not self.first:
            data = b" " + data
        self.first = self.first and not len(ids)
        return self.state.decode(data, final)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, direct: bool = False) -> Encoder:
    """One encoder for each file, kind and worker."""
    if (path, direct) not in _encoders:
        _encoders[path, direct] = Encoder(path, direct)
    return _encoders[path, direct]


def decoded(names: list[bytes], ids: bytes | Iterable[bytes]) -> Iterator[str]:
    """The text of ids, given whole or in parts, a step at a time."""
    d = Decoder(names)
    for part in [ids] if isinstance(ids, bytes) else ids:
        values = np.frombuffer(part, dtype="<u4")
        for at in range(0, len(values), STEP):
            yield d.feed(values[at : at + STEP])
    yield d.feed(np.zeros(0, dtype="<u4"), final=True)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit), n_tokens."""

    def f(rows: dict) -> dict:
        ids = [encoder(path).encode(t) for t in rows["text"]]
        return {"id": rows["id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    return per_batch(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id long, ids binary, n_tokens long", f)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """id, text of (id, ids)."""

    def f(rows: dict) -> dict:
        return {"id": rows["id"], "text": ["".join(decoded(encoder(path).names, x or b"")) for x in rows["ids"]]}

    return per_batch(encoded.select("id", "ids"), "id long, text string", f)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode: n_tokens and the digests of the ids and of the decoded text."""

    def f(rows: dict) -> dict:
        e, out = encoder(path), {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256")}
        for text in rows["text"]:
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

            def through(parts: Iterator[bytes]) -> Iterator[bytes]:
                nonlocal n
                for part in parts:
                    n += len(part) // 4
                    ids_hash.update(part)  # noqa: B023
                    yield part

            for piece in decoded(e.names, through(e.encode_stream(text))):
                text_hash.update(piece.encode())
            for k, v in zip(out, (n, ids_hash.hexdigest(), text_hash.hexdigest()), strict=True):
                out[k].append(v)
        return {id_col: rows["id"]} | out

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_batch(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, f)
