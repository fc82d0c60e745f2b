"""Private data replaced by keyed surrogates, in DataFrame functions alone.

Entities are e-mail addresses, phone and social-security and card and bank-account numbers, IPv4 addresses, secrets
(long hexadecimal strings and well-known key formats) and names after a title. An entity has a canonical form (lower case,
bare digits), so its spellings corefer. Its surrogate follows from a SHA-512 of key, kind, canonical form and attempt:
digits stay digits, letters keep their script and case, separators their place; country codes, a card's first digit and
its check digit's validity, an address's top domain are kept; a name follows its title's gender and script.

Distinct entities get distinct surrogates, none of which is an entity of the corpus: over the distinct entities of the
whole input, those whose surrogate another one has, or that is itself an entity, are counted up to their next attempt,
until none is left. Few are, and only documents that hold one are looked up by a join; Spark broadcasts that table only
where its size allows. Extraction itself needs no join, so a frequent entity is no hot key.

Null text stays null; a text without an entity stays as it is. Repeated rows get equal results. An empty table gives an
empty result. Other columns pass through replace_private() and aren't read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, stored, unused

L = r"\p{L}"
EMAIL = r"[\p{L}\p{N}_%+][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IP = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.]*\d)"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SECRET = r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![\p{L}\p{N}])"
CARD = r"(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{15,16})(?![\d])"
SSN = r"\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
HE, SHE, THEY = r"Mr\.|Herr|Monsieur|Señor|Sr\.|г-н", r"Mrs\.|Ms\.|Frau|Madame|Mme|Señora|Sra\.|г-жа", r"Dr\.|Prof\."
NAME = rf"(?:{HE}|{SHE}|{THEY}) \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
#: Entities start where a word does; the kinds are tried in this order.
ENTITY = r"(?<![\p{L}\p{N}@])(?:" + "|".join((EMAIL, SECRET, IBAN, CARD, SSN, PHONE, IP, NAME)) + ")"

GIVEN = {
    "latin": {"he": "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul".split(), "she": "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula".split(), "they": "Alex Robin Kim Sasha Chris Jamie Toni Sam Jules Andrea Jan Nico Luca Dana Morgan Riley".split()},
    "cyrillic": {"he": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(), "she": "Анна Белла Вера Галина Дарья Елена Ирина Ксения".split(), "they": "Саша Женя Валя Слава Ника Рита Тоня Паша".split()},
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(), "cyrillic": "ба бе бо да де до га го ка ко ла ле ло ма мо на не но ра ре ро са се со та те то ва ви зо ри ли ни".split()}
_LETTERS = {"a-z": "abcdefghijklmnopqrstuvwxyz", "а-я": "абвгдежзиклмнопрстуфхцчшэюя", "α-ω": "αβγδεζηθικλμνξοπρστυφχψω"}
#: The first and last code point of the letters that other scripts' letters are replaced by; some of them where there are many.
_SCRIPTS = {"Han": (0x4E00, 0x4EFF), "Hiragana": (0x3042, 0x3093), "Katakana": (0x30A2, 0x30F3), "Hangul": (0xAC00, 0xACFF), "Arabic": (0x0627, 0x064A), "Hebrew": (0x05D0, 0x05EA), "Devanagari": (0x0905, 0x0939), "Bengali": (0x0985, 0x09B9), "Tamil": (0x0B85, 0x0BB9), "Telugu": (0x0C05, 0x0C39), "Thai": (0x0E01, 0x0E2E), "Armenian": (0x0561, 0x0586), "Georgian": (0x10D0, 0x10F0), "Ethiopic": (0x1200, 0x1246)}
_OTHERS = {name: "".join(filter(str.isalpha, map(chr, range(a, b + 1)))) for name, (a, b) in _SCRIPTS.items()}
#: Attempts after which a surrogate grows by a letter or digit, so that no format runs out of them; attempts that are an error.
WIDE, MOST = 8, 400


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def kind_of(m: Column) -> Column:
    tests = {"secret": SECRET, "iban": IBAN, "card": CARD, "ssn": SSN, "ip": IP, "phone": PHONE}
    out = F.when(m.contains("@"), "email")
    for kind, rx in tests.items():
        out = out.when(m.rlike(f"^(?:{rx})$"), kind)
    return out.otherwise("name")


def canonical(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, r"[^\d+]", "")
    return F.when(kind.isin("phone", "ssn", "card"), digits).when(kind == "iban", F.replace(m, F.lit(" "))).when(kind.isin("secret", "ip"), m).when(kind == "email", F.lower(m)).otherwise(F.lower(m))


def _digest(key: str, kind: Column, what: Column, attempt: Column) -> Column:
    """512 hexadecimal digits."""
    return F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), kind, what, attempt.cast("string"), F.lit(str(i))), 512) for i in range(4)))


def _byte(d: Column, i: Column) -> Column:
    return F.conv(F.substring(d, F.pmod(i, F.lit(256)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, b: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(b, F.lit(len(letters))) + 1, F.lit(1))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _letter(c: Column, b: Column) -> Column:
    """A letter of c's script, in lower case (Latin for scripts that aren't known here); what is no letter or digit stays."""
    out = F.when(c.rlike(r"\p{N}"), _pick("0123456789", b))
    for span, letters in _LETTERS.items():
        out = out.when(c.rlike(f"[{span}]"), _pick(letters, b))
    out = out.when(c.rlike(r"\p{IsCyrillic}"), _pick(_LETTERS["а-я"], b)).when(c.rlike(r"\p{IsGreek}"), _pick(_LETTERS["α-ω"], b))
    for script, letters in _OTHERS.items():
        out = out.when(c.rlike(rf"(?=\p{{L}})\p{{Is{script}}}"), _pick(letters, b))
    return out.when(c.rlike(r"\p{L}"), _pick(_LETTERS["a-z"], b)).otherwise(c)


def _mapped(s: Column, d: Column) -> Column:
    return F.array_join(F.transform(_chars(s), lambda c, i: _letter(c, _byte(d, i))), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    doubled = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _numbers(canon: Column, kind: Column, d: Column) -> Column:
    """Digits for digits: a country code and a card's first digit stay, no group starts with 0 or 1 where phones don't."""
    kept = F.when(canon.startswith("+1"), 2).when(canon.startswith("+"), 3).when(kind == "card", 1).otherwise(0)
    new = F.transform(_chars(canon), lambda c, i: F.when(i < kept, c).when((kind == "phone") & ((i == kept) | (i == kept + 3)), _pick("23456789", _byte(d, i))).when((kind == "ssn") & (i == 0), _pick("12345678", _byte(d, i))).when(c == "+", c).otherwise(_pick("0123456789", _byte(d, i))))

    def checked(s: Column) -> Column:
        head = F.substring(s, F.lit(1), F.length(s) - 1)
        return F.when((kind == "card") & (_luhn(canon) == 0), let(_luhn(F.concat(head, F.lit("0"))), lambda r: F.concat(head, F.pmod(10 - r, F.lit(10)).cast("string")))).otherwise(s)

    return let(F.array_join(new, ""), checked)


def _names(key: str, canon: Column, attempt: Column) -> Column:
    """Title, then given names by gender and script, then a surname from syllables; each word by itself, so parts of a name corefer."""
    words = F.split(canon, " ")
    title = F.element_at(words, 1)
    gender = F.when(title.rlike(f"^(?i:{SHE})$"), "she").when(title.rlike(f"^(?i:{HE})$"), "he").otherwise("they")
    pools = F.create_map(*(F.lit(x) for s, by in GIVEN.items() for g, names in by.items() for x in (f"{s} {g}", "|".join(names))))
    syllables = F.create_map(*(F.lit(x) for s, names in SYLLABLES.items() for x in (s, "|".join(names))))

    def word(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

        def build(d: Column) -> Column:
            given = let(F.split(F.element_at(pools, F.concat_ws(" ", script, gender)), r"\|"), lambda p: F.element_at(p, F.pmod(_byte(d, F.lit(0)), F.size(p)) + 1))
            parts = let(F.split(F.element_at(syllables, script), r"\|"), lambda p: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: F.element_at(p, F.pmod(_byte(d, j), F.size(p)) + 1)), ""))
            return F.when(i + 1 < F.size(words) - 1, given).otherwise(F.initcap(parts))

        return let(_digest(key, F.lit("name"), F.concat_ws("|", w, F.when(i + 1 < F.size(words) - 1, gender).otherwise("")), attempt), build)

    return F.concat_ws(" ", title, F.array_join(F.transform(F.slice(words, 2, 8), word), " "))


def core(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate's canonical form. After WIDE attempts it gets longer, by one letter or digit more for each WIDE of them."""
    whole = _digest(key, kind, canon, attempt)
    more = F.when(attempt >= WIDE, F.sequence(F.lit(1), (attempt / WIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
    longer = lambda letters: let(whole, lambda d: F.array_join(F.transform(more, lambda i: _pick(letters, _byte(d, i + 200))), ""))
    letters_, digits = longer(_LETTERS["a-z"]), longer("0123456789")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(let(whole, lambda d: _mapped(local, d)), letters_, F.lit("@"), let(_digest(key, F.lit("domain"), domain, F.lit(0)), lambda d: _mapped(name, d)), top)
    ip = let(whole, lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_byte(d, i), F.lit(254)) + 1).cast("string")), "."))
    hexed = let(whole, lambda d: F.array_join(F.transform(_chars(canon), lambda c, i: _pick("0123456789abcdef", _byte(d, i))), ""))
    mixed = let(whole, lambda d: F.array_join(F.transform(_chars(canon), lambda c, i: F.when(i < 4, c).when(c.rlike("[A-Z]"), F.upper(_letter(F.lower(c), _byte(d, i)))).otherwise(_letter(c, _byte(d, i)))), ""))
    secret = F.when(canon.rlike("^[0-9a-f]+$"), hexed).when(canon.rlike("^[0-9A-F]+$"), F.upper(hexed)).otherwise(mixed)
    iban = let(whole, lambda d: F.array_join(F.transform(_chars(canon), lambda c, i: F.when(i < 2, c).otherwise(F.upper(_letter(F.lower(c), _byte(d, i))))), ""))
    numbers = let(whole, lambda d: _numbers(canon, kind, d))
    # an address of four numbers can't get longer: it gets one more
    ip = F.concat(ip, F.when(attempt >= WIDE, F.concat(F.lit("."), digits)).otherwise(""))
    return F.when(kind == "email", email).when(kind.isin("phone", "ssn", "card"), F.concat(numbers, digits)).when(kind == "ip", ip).when(kind == "secret", F.concat(secret, digits)).when(kind == "iban", F.concat(iban, digits)).otherwise(F.concat(_names(key, canon, attempt), letters_))


def render(kind: Column, m: Column, new: Column) -> Column:
    """The surrogate as the entity was written: its separators, its case."""

    def placed(keep: str) -> Column:
        at = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), keep, ""))
        own = F.length(F.regexp_replace(m, keep, ""))
        return F.concat(F.array_join(F.transform(_chars(m), lambda c, i: F.when(c.rlike(keep), c).otherwise(F.substring(new, at(i), F.lit(1)))), ""), F.substring(new, own + 1, F.length(new)))

    cased = F.array_join(F.transform(_chars(m), lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(new, i + 1, F.lit(1)))).otherwise(F.substring(new, i + 1, F.lit(1)))), "")
    cased = F.concat(cased, F.substring(new, F.size(_chars(m)) + 1, F.length(new)))
    name = F.concat_ws(" ", F.substring_index(m, " ", 1), F.substring(new, F.length(F.substring_index(new, " ", 1)) + 2, F.length(new)))
    return F.when(kind.isin("phone", "ssn", "card"), placed(r"[^\d+]")).when(kind == "iban", placed(" ")).when(kind == "email", cased).when(kind == "name", name).otherwise(new)


def entities(text: Column) -> Column:
    """The entities of a text as written, in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY), 0)


def distinct_entities(docs: DataFrame, text_col: str) -> DataFrame:
    """kind, canon of all documents."""
    m = docs.select(F.explode(entities(F.col(text_col))).alias("m"))
    m = m.select("m", kind_of(F.col("m")).alias("kind"))
    return m.select("kind", canonical(F.col("kind"), F.col("m")).alias("canon")).distinct()


def attempts(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the entities whose first surrogate is taken; the rest have attempt 0."""
    now = cut(found.withColumn("attempt", F.lit(0)).withColumn("new", core(key, F.col("kind"), F.col("canon"), F.col("attempt"))))
    for _ in range(MOST):
        twins = now.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1")
        late = now.join(twins, ["kind", "new"]).filter("canon != first").select("kind", "canon")
        real = now.join(now.select("kind", F.col("canon").alias("new")), ["kind", "new"], "left_semi").select("kind", "canon")
        again = cut(late.unionByName(real).distinct().withColumn("more", F.lit(1)))
        if not again.head(1):
            return now.filter("attempt > 0").select("kind", "canon", "attempt")
        now = now.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("new", "more")
        now = cut(now.withColumn("new", core(key, F.col("kind"), F.col("canon"), F.col("attempt"))))
    raise RuntimeError(f"entities without a surrogate of their own after {MOST} attempts")


def _replaced(docs: DataFrame, key: str, id_col: str, text_col: str) -> tuple[DataFrame, Column, list[str]]:
    """(docs with text replaced and more columns, the number of entities, the names of the columns to drop); no name clashes with one of docs."""
    row, found, held = (unused(docs, x) for x in ("row", "found", "held"))
    taken = stored(attempts(distinct_entities(docs, text_col), key))
    hits = docs.select(F.col(id_col).alias("id"), F.explode(entities(F.col(text_col))).alias("m"))
    hits = hits.select("id", kind_of(F.col("m")).alias("kind"), "m").select("id", "kind", canonical(F.col("kind"), F.col("m")).alias("canon"))
    entry = F.struct(F.concat_ws(" ", "kind", "canon").alias("key"), F.col("attempt").alias("value"))
    over = stored(hits.join(taken, ["kind", "canon"]).groupBy(F.col("id").alias(row)).agg(F.map_from_entries(F.collect_set(entry)).alias(held)))

    def replaced(m: Column) -> Column:
        def by_canon(k: Column, canon: Column) -> Column:
            attempt = F.coalesce(F.col(held)[F.concat_ws(" ", k, canon)], F.lit(0))
            return let(core(key, k, canon, attempt), lambda new: render(k, m, new))

        return let(kind_of(m), lambda k: let(canonical(k, m), lambda canon: by_canon(k, canon)))

    text = F.col(text_col)
    pieces = F.split(text, ENTITY, -1)
    woven = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(found)), F.transform(found, replaced), lambda piece, new: F.concat(piece, new)), ""), F.element_at(pieces, -1))
    out = docs.join(over, docs[id_col].eqNullSafe(over[row]), "left").withColumn(found, entities(text))
    out = out.withColumn(text_col, F.when(F.size(found) > 0, woven).otherwise(text))
    return out, F.greatest(F.size(found), F.lit(0)), [row, found, held]


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text replaced, and n_entities, which takes the place of a column of that name."""
    out, n, names = _replaced(docs, key, id_col, text_col)
    return out.withColumn("n_entities", n).drop(*names)


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text replaced; all columns stay."""
    return _replaced(docs, key, id_col, text_col)[0].select(docs.columns)
