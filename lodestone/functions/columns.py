"""Column functions over paths, questions, texts and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import fixed


def extension(path: Column) -> Column:
    """The last suffix of a path's name, in lower case, or ""."""
    return F.lower(F.regexp_extract(path, r"[^./\\](\.[^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def file_type(ext: Column) -> Column:
    """The first type that lists the extension; null if none does."""
    out, low = F.lit(None).cast("string"), F.lower(ext)
    for kind, known in reversed(fixed.EXTENSIONS.items()):
        out = F.when(low.isin(known), kind).otherwise(out)
    return out


def too_large(kind: Column, size: Column, limits: dict[str, int] | None = None, otherwise_mb: int = fixed.GLOBAL_MAX_MB) -> Column:
    """Whether a file is over its type's limit; the limit itself is allowed."""
    limits = fixed.TYPE_MAX_MB if limits is None else limits
    most = F.lit(otherwise_mb * 2**20).cast("long")
    for name, mb in limits.items():
        most = F.when(kind == name, F.lit(mb * 2**20).cast("long")).otherwise(most)
    return size > most


def under(path: Column, prefixes: list[str]) -> Column:
    """Plain string prefixes, so /a is one of /ab as well."""
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def in_excluded_dir(path: Column, names: list[str] | None = None) -> Column:
    names = [n.lower() for n in (fixed.EXCLUDED_DIRS if names is None else names)]
    return F.exists(F.split(F.lower(path), r"[\\/]"), lambda part: part.isin(names))


def translate_path(path: Column, path_map: dict[str, str]) -> Column:
    """Container prefix to host prefix, the longest container prefix first."""
    out = path
    for inside, host in sorted(path_map.items(), key=lambda kv: len(kv[0])):
        rest = F.ltrim(F.substring(path, len(inside) + 1, 1 << 30), F.lit("/\\"))
        if "\\" in host:
            rest = F.replace(rest, F.lit("/"), F.lit("\\"))
        if host and host[-1] not in "/\\":
            host += "\\" if "\\" in host else "/"
        out = F.when(path.startswith(inside), F.concat(F.lit(host), rest)).otherwise(out)
    return out


def reverse_path(path: Column, path_map: dict[str, str]) -> Column:
    """Host prefix to container prefix, separators alike, the longest host prefix first."""
    flat, out = F.replace(path, F.lit("\\"), F.lit("/")), path
    for inside, host in sorted(path_map.items(), key=lambda kv: len(kv[1])):
        host = host.replace("\\", "/").rstrip("/")
        rest = F.ltrim(F.substring(flat, len(host) + 1, 1 << 30), F.lit("/"))
        out = F.when(flat.startswith(host), F.concat(F.lit(inside.rstrip("/") + "/"), rest)).otherwise(out)
    return out


def drive_letter(path: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(path, r"^([A-Za-z]):", 1), F.lit("")))


def is_broad(question: Column) -> Column:
    return question.rlike("(?i)" + fixed.BROAD)


def keywords(question: Column) -> Column:
    """Words of a question that aren't stop words, in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(question), F.lit(fixed.KEYWORD), 0)
    return F.filter(found, lambda w: ~w.isin(fixed.STOP_WORDS) & (F.length(w) > 1))


def _name(word: Column) -> Column:
    return F.regexp_replace(F.rtrim(F.lower(word), F.lit("'")), "'s$", "")


def entities(question: Column) -> Column:
    """Names that a question asks about, in order of the three patterns, each once."""
    after = F.flatten(F.transform(F.regexp_extract_all(question, F.lit("(?i)" + fixed.AFTER_PREPOSITION), 1), lambda x: F.split(F.btrim(x), r"\s+")))
    owner = F.regexp_extract_all(question, F.lit("(?i)" + fixed.POSSESSIVE), 1)
    pairs = F.arrays_zip(F.regexp_extract_all(question, F.lit("(?i)" + fixed.POSSESSIVE_S), 1).alias("w"), F.regexp_extract_all(question, F.lit("(?i)" + fixed.POSSESSIVE_S), 2).alias("n"))
    named = F.filter(pairs, lambda p: F.lower(p["n"]).isin(fixed.ATTRIBUTE_NOUNS) & ~F.concat(F.lower(p["w"]), F.lit("s")).isin(fixed.COMMON_WORDS_S))
    found = F.transform(F.concat(after, owner, F.transform(named, lambda p: p["w"])), _name)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(fixed.STOP_WORDS) & (F.length(w) > 1)))


def all_keywords(question: Column) -> Column:
    """Keywords, then the entities that aren't among them."""
    k = keywords(question)
    return F.concat(k, F.array_except(entities(question), k))


def expansion_lines(text: Column, most: int = 8) -> Column:
    """Queries of a model's answer: numbering, bullets and quotes off, over 5 and under 500 characters."""
    bare = F.transform(F.split(text, r"\R"), lambda s: F.trim(F.btrim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^\d+[.)]\s*", ""), r"^[-*•]\s*", ""), F.lit("\"'`"))))
    return F.slice(F.filter(bare, lambda s: (F.length(s) > 5) & (F.length(s) < 500)), 1, most)


def searchable(text: Column, path: Column) -> Column:
    return F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(path, F.lit(""))))


def contained(where: Column, words: Column) -> Column:
    """How many of the words, repeats counted, are substrings."""
    return F.size(F.filter(words, lambda w: F.contains(where, w)))


def is_system_path(path: Column) -> Column:
    return path.rlike("(?i)" + fixed.SYSTEM_PATH)


def clean_answer(text: Column, compat: bool = False) -> Column:
    """A model's answer without table rows that say nothing and without a trailing disclaimer."""
    row, note = (fixed.NOTHING_ROW_COMPAT, fixed.DISCLAIMER_COMPAT) if compat else (fixed.NOTHING_ROW, fixed.DISCLAIMER)
    kept = F.filter(F.split(text, "\n"), lambda s: ~(F.trim(s).startswith("|") & s.rlike("(?i)" + row)))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "(?is)" + note, ""), r"\s+$", "")


def by_rules(error: Column, rules: list, empty: str, words: int | None = None, chars: int | None = None) -> Column:
    """The first rule that holds, with the error's reason if the rule has a pattern for it; else the first words or characters of the error."""
    out = F.when(F.coalesce(error, F.lit("")) == "", empty)
    for category, exact, any_case, *reason in rules:
        hit = F.lit(False)
        for needle in exact:
            hit = hit | F.contains(error, F.lit(needle))
        for needle in any_case:
            hit = hit | F.contains(F.lower(error), F.lit(needle))
        if reason:
            said = F.trim(F.regexp_extract(error, reason[0], 1))
            out = out.when(hit, F.concat(F.lit(f"{category}: "), F.when(said != "", said).otherwise("unknown reason")))
        else:
            out = out.when(hit, category)
    if words:
        return out.otherwise(F.concat(F.lit("Other: "), F.array_join(F.slice(F.split(F.trim(error), r"\s+"), 1, words), " "), F.lit("...")))
    return out.otherwise(F.substring(error, 1, chars or 80))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def decoded(content: Column) -> tuple[Column, Column]:
    """(text, encoding): UTF-8 where the bytes are, else Latin-1, which any bytes are."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")), F.when(utf8, "utf-8").otherwise("latin-1")


def reason_has(reason: Column, *names: str) -> Column:
    mask = 0
    for n in names:
        mask |= fixed.REASON[n]
    return reason.bitwiseAND(F.lit(mask).cast("long")) != 0


def email_text(headers: dict[str, Column], body: Column, attachments: Column | None = None) -> Column:
    """Header lines that have a value, a blank line, the body, then attachments (array of struct name, text)."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in headers.items()]
    parts = F.array(*lines, F.lit(""), F.when(F.coalesce(body, F.lit("")) != "", body))
    if attachments is not None:
        parts = F.concat(parts, F.transform(F.filter(attachments, lambda a: a["text"] != ""), lambda a: F.concat(F.lit("\n--- Attachment: "), F.coalesce(a["name"], F.lit("unnamed")), F.lit(" ---\n"), a["text"])))
    return F.trim(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n"))
