"""Each operator against a brute-force version, an exact round trip or held-out labels."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, components, exact_dedup, html_extract, packing, pii, ppm, quality, queries, simhash, suffix_dedup, topk
from lodestone.llm.common import keyed
from tests.conftest import cells

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
#: Nulls, empty texts, ties, repeated rows, near copies, a long text, clashing columns.
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = ["", None, " \t\n", "a", "the  quick\tbrown fox", "the quick brown fox", "The quick brown fox", "a a a a a a a a", LONG, LONG + " end", "é ü ß 中文 😀", "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*enumerate(TEXTS), (4, TEXTS[4]), (100, TEXTS[5])]
    df = spark.createDataFrame(rows, DOCS)
    extra = [n for n in ("id", "row", "fp", "keep", "size", "n", "word", "span", "kind", "u", "v", "sequence_id", "component_id")]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(extra)))


def slow_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t or ""))


def test_exact_parts_combine():
    data = bytes(random.Random(1).randbytes(1000)) + b"\0\0"
    assert exact_dedup.fingerprint(data, 7) == exact_dedup.fingerprint(data, 1 << 16) != exact_dedup.fingerprint(data[:-1])


def test_exact_groups(odd, monkeypatch):
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(exact_dedup, "fingerprint", lambda data, chunk=0: (len(data) % 2, 7))
        got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(odd).collect()]
        groups = defaultdict(list)
        rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in odd.collect()]
        for i, t in rows:
            groups[t].append(i)
        want = [(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
        if not collide:
            assert sorted(got) == sorted(want)
        else:  # one fingerprint for unlike texts: the chunks tell them apart
            assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
    assert exact_dedup.exact_dedup(odd).columns == odd.columns
    assert exact_dedup.exact_groups(odd.limit(0)).count() == exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_exact_dedup_repeated_ids(spark, odd):
    """A text of a repeated id isn't lost, and of rows that agree in all one stays."""
    rows = [(1, "a b c"), (2, "a b c"), (2, "only here"), (1, "a b c"), (None, "only here"), (None, "no id"), (None, "no id"), (3, ""), (4, None), (5, "a  b c")]
    got = [(r["doc_id"], r["text"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(1, "a b c"), (2, "only here"), (None, "no id"), (3, "")], key=str)
    got = exact_dedup.exact_dedup(odd).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in odd.collect()]
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in got) == sorted(set(norm))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def slow_print(t, n):
    w = slow_words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_gray_index():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flip = np.uint64(1) << rng.integers(0, 64, (600, 2)).astype(np.uint64)
    values = np.unique(base[rng.integers(0, 20, 600)] ^ flip[:, 0] ^ flip[:, 1])
    for d in (0, 1, 2, 5):
        got = {(int(a), int(b)) for q, r in simhash.GrayIndex(values).near(values, d, most=1000) for a, b in zip(q, r)}
        assert got == {(i, j) for i in range(len(values)) for j in range(len(values)) if bin(int(values[i] ^ values[j])).count("1") <= d}


def test_near_groups(spark, odd, monkeypatch):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(120)) for _ in range(6)]
    texts = TEXTS[:8] + [re.sub(r"\w+", lambda m: m[0] if rng.random() > 0.004 else "zz", b) for b in base for _ in range(12)]
    df = spark.createDataFrame([*enumerate(texts)], DOCS)
    prints = [slow_print(t, 3) for t in texts]
    label = [*range(len(texts))]
    for _ in texts:
        label = [min(label[j] for j in range(len(texts)) if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in range(len(texts))]
    for block in (1024, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_groups(df).collect()}
        assert got == {i: (prints[i], label[i]) for i in range(len(texts))}
    assert simhash.near_groups(odd).count() == odd.count() and simhash.near_groups(odd.limit(0)).count() == 0


def test_similar_groups(spark, odd):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(8)]
    texts = [" ".join(b) for b in base]
    for b in base:
        near, far = b[:], b[:]
        near[50] = near[150] = "changed"
        for i in range(0, 200, 12):
            far[i] = "other"
        texts += [" ".join(near), " ".join(far)]
    df = spark.createDataFrame([*enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert got == {8 + 2 * i: i for i in range(8)} or got == {k: v for i in range(8) for k, v in ((8 + 2 * i, i), (i, i)) if k in got}
    kept = {r["doc_id"] for r in simhash.near_dedup(df).collect()}
    assert kept == set(range(len(texts))) - {8 + 2 * i for i in range(8)}
    assert simhash.near_dedup(odd).columns == odd.columns
    assert simhash.near_dedup(odd.limit(0)).count() == simhash.similar_groups(odd.limit(0)).count() == 0


def test_near_dedup_repeated_ids(spark):
    """A text of a repeated id is neither lost nor hides a link."""
    rng = random.Random(9)
    x, y, z = (" ".join(f"w{rng.randrange(900)}" for _ in range(300)) for _ in range(3))
    rows = [(1, x), (2, x), (2, y), (2, y), (3, y + " end"), (None, z), (None, z), (4, None), (5, " ")]
    got = [(r["doc_id"], r["text"]) for r in simhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(1, x), (2, y), (None, z), (4, None)], key=str)


def jaccard_groups(texts):
    """The least row reachable by links of Jaccard 0.8 over word shingles of five."""
    sets = [{*zip(*(slow_words(t)[k:] for k in range(5)), strict=False)} or {tuple(slow_words(t))} for t in texts]
    label = [*range(len(texts))]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        was = label[:]
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
        if was == label:
            break
    return label


def test_similar_pairs_maps():
    """Maps rule out unlike sets before whole sets are moved, and never a pair that has the similarity."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 9, 100, 511, 512, 513, 1500):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for part in (1.0, 0.95, 0.9, 0.89, 0.85, 0.7, 0.5, 0.0):
            for m in (n, max(1, n * 9 // 10), n + n // 6):
                kept = x[: int(part * n)]
                y = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, max(0, m - len(kept)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
                both = len(np.intersect1d(x, y))
                may = simhash.maps_allow(simhash.set_map(x), simhash.set_map(y), 0.8)
                assert simhash.sets_agree(x.tobytes(), y.tobytes(), 0.8) == (both >= 0.8 * (len(x) + len(y) - both))
                assert may or not simhash.sets_agree(x.tobytes(), y.tobytes(), 0.8)
                assert not (may and n >= 100 and part <= 0.7)


def test_sharing_pairs_by_rare_shingles(spark):
    """Texts that share a passage of a few rows, too rare for a sample to tell, meet in their own rare shingles only."""
    passage, own = (lambda k: " ".join(f"s{k}w{i}" for i in range(40))), (lambda k: " ".join(f"r{k}x{i}" for i in range(40)))
    rows = [(k, f"{passage(k // 6)} {own(k)}") for k in range(18_000)]
    rows += [(20_000 + k, rows[k][1] + " tail") for k in range(9)]
    docs = keyed(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    nodes = docs.select("row", "print", F.col("id").alias("node"), F.col("id").alias("root"))
    pairs = {(r["a"], r["b"]) for r in simhash.sharing_pairs(docs.drop("id"), nodes, 5, 0.8).collect()}
    assert {(20_000 + k, k) for k in range(9)} <= pairs and len(pairs) < 4500  # of 45,000 that share a passage


def test_similar_in_families(spark):
    """Unlike copies of one text, each with a near copy of its own: none is hidden by the others."""
    rng, texts = random.Random(5), []
    word = lambda: f"word{rng.randrange(3000)}"
    for _ in range(3):
        base = [word() for _ in range(250)]
        for _ in range(40):
            copy = [w if rng.random() > rng.uniform(0.02, 0.1) else word() for w in base]
            other = copy[:]
            for at in rng.sample(range(250), 4):
                other[at] = word()
            texts += [" ".join(copy), " ".join(other)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame([*enumerate(texts)], DOCS)).collect()}
    label = jaccard_groups(texts)
    assert len(set(label)) > 30 and [got.get(i, i) for i in range(len(texts))] == label


def test_shared_counts():
    rng = np.random.default_rng(4)
    for most in (5, 300, 100_000):
        left, right = ([np.unique(rng.integers(0, most, k)).astype(np.uint64) for k in rng.integers(1, 120, n)] for n in (70, 90))
        left[0] = right[0] = np.unique(np.concatenate(left))
        got = simhash.shared_counts(left, right)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert not simhash.shared_counts([np.array([1], dtype=np.uint64)], [np.array([2], dtype=np.uint64)]).any()


@pytest.mark.parametrize("block", [1024, 16])
def test_crowds_make_no_pairs(spark, monkeypatch, block):
    """A large family of copies, most of them unlike and of several lengths: it goes as rows of crowds, whose number isn't the square of the family's, and no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, texts = random.Random(6), []
    base = [f"base{i}" for i in range(150)]
    for k in range(240):
        copy = [w if rng.random() > 0.04 * (k % 3) else f"own{k}x{rng.randrange(99)}" for w in base[: rng.choice((150, 150, 110))]]
        texts.append(" ".join(copy) + f" end{k}")
    texts += [t + " tail" for t in texts[::10]]
    df = spark.createDataFrame([*enumerate(texts)], DOCS)
    docs = keyed(df, "doc_id", "text")
    nodes = docs.select("row", "print", F.col("id").alias("node"), F.col("id").alias("root"))
    made = simhash.sharing_pairs(docs.drop("id"), nodes, 5, 0.8)
    assert made.count() < 2 * len(texts)  # 2,614 pairs have the bounds on size and place
    crowds = made.filter("root is not null").toDF("crowd", "node", "root")
    links = [(r["u"], r["v"]) for r in simhash.crowd_links(docs.drop("id"), nodes.selectExpr("*", "1 as copies"), crowds, 5, 0.8).collect()]
    label = jaccard_groups(texts)
    assert links and all(label[a] == label[b] for a, b in links)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    assert len(set(label)) > 30 and [got.get(i, i) for i in range(len(texts))] == label


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 7)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(i, [float(x) for x in np.round(np.random.default_rng(i % 9).normal(size=6), 1)]) for i in range(60)]
    rows += [(110 + i, [float(i), -1.0]) for i in range(4)] + [(130, [2.0]), (140, [])]  # other lengths meet among themselves
    rows += [(150 + i, [1e15, -3e14 * i, 2.0, 0.0, 1e18 * (i - 1), -1e17 * i]) for i in range(3)]  # scores that leave the range of long
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(3, rows[3][1]), (20, [9.0] * 6)]  # a row twice, and an id with two vectors
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    good = [(i, [max(topk.LEAST, min(topk.MOST, math.floor(64 * x))) for x in v]) for i, v in rows]
    asked = {}
    for i, v in good:
        if i % 10 == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda v: (len(v), v))
    dot = lambda a, b: max(topk.LEAST, min(topk.MOST, sum(x * y for x, y in zip(a, b))))
    for k, lists in ((5, 2), (80, 3)):
        got = defaultdict(list)
        for r in topk.top_k(df, df.filter("vec_id % 10 = 0"), k=k, lists=lists).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        want = {i: [(j, -s) for s, j in sorted((-dot(q, x), j) for j, x in good if j != i and len(x) == len(q))[:k]] for i, q in asked.items()}
        assert got == {i: x for i, x in want.items() if x}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_threshold_saves_products():
    """With the cutoff, rows that are too short in a list aren't multiplied, and nothing is missed."""
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(500, 16)) * rng.choice([1, 8, 60], 500)[:, None]).astype(np.int64)
    q, q_ids, r_ids = rows[:9] + 1, np.arange(9) + 1000, np.arange(500)
    scores = q @ rows.T
    cutoff = np.sort(scores, axis=1)[:, -5]
    i, j, made = topk.phase_two(q, q_ids, rows, r_ids, 2, cutoff)
    assert {*zip(*np.nonzero(scores >= cutoff[:, None]))} <= {*zip(i, j)}
    assert made < 0.6 * 2 * scores.size and len(i) < 0.5 * scores.size and (topk.resolved(q, rows, i, j) == scores[i, j]).all()


def test_best_fit():
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 2047) for _ in range(500)), reverse=True)
    where, left = packing.best_fit(lengths, 2048)
    want, rooms = [], []
    for n in lengths:
        fits = [(r, s) for s, r in enumerate(rooms) if r >= n]
        s = min(fits)[1] if fits else len(rooms)
        if s == len(rooms):
            rooms.append(2048)
        rooms[s] -= n
        want.append(n)
    assert sorted(rooms) == sorted(left)
    pieces = packing.pack_shard(lengths, 2048)
    assert sorted((i, a, b) for i, a, b, _ in pieces)[0][0] == 0 and sum(b - a for _, a, b, _ in pieces) == sum(lengths)
    used = Counter()
    for _, a, b, s in pieces:
        used[s] += b - a
    assert max(used.values()) <= 2048 and len(used) == -(-sum(lengths) // 2048)


def test_pack(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20)
    docs = odd.dropDuplicates(["doc_id"])
    packed = packing.pack(docs, PATH).collect()
    tok = Tokenizer.from_file(PATH)
    want = {r["doc_id"]: tok.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    got, places = defaultdict(dict), defaultdict(list)
    for r in packed:
        got[r["doc_id"]][r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["length"] == len(got[r["doc_id"]][r["start"]])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum((p for _, p in sorted(x.items())), []) for i, x in got.items()} == want
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    assert all(len(r["ids"]) == 4 * 2048 for r in packing.sequences(packing.pack(docs, PATH)).collect())
    short = packing.pack_digests(docs, PATH).collect()
    full = {r["doc_id"]: np.array(want[r["doc_id"]], "<u4") for r in docs.collect()}
    assert all(r["ids_crc32"] == zlib.crc32(full[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in short)
    assert packing.pack_digests(docs.limit(0), PATH).count() == 0


def test_packed_digests(spark):
    """Digests are those of pack()'s pieces, so rests of just over half a window fill their sequences as well."""
    docs = spark.createDataFrame([(i, "the " * 1100) for i in range(40)], DOCS)
    full, short = packing.pack(docs, PATH).collect(), packing.pack_digests(docs, PATH).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"])
    assert sorted((*key(r), zlib.crc32(r["ids"])) for r in full) == sorted((*key(r), r["ids_crc32"]) for r in short)
    assert sum(r["length"] for r in short) > 0.9 * 2048 * len({r["sequence_id"] for r in short})


@pytest.mark.parametrize("window", [1 << 16, 7])
def test_bpe(spark, odd, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    tok, e, rng = Tokenizer.from_file(PATH), bpe.encoder(PATH), random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzäéßçñ Σςİ'’.,!?-_0123½²中文дя́​\x1c\x85 \t\n😀ABC"
    for k in range(1500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        if k % 7 == 0:
            s += " <|endoftext|>x<|startoftext|> "
        if k % 11 == 0:
            s = "".join(rng.choice("thea") for _ in range(600))
        if k % 13 == 0:
            s = rng.choice(["ab", "!", "a", "é", "he"]) * rng.randint(1, 300)
        ids = tok.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(e.encode(s), "<u4").tolist() == ids and bpe.encoder(PATH, direct=True).encode(s) == e.encode(s)
        assert "".join(bpe.decoded(e.names, e.encode(s))) == tok.decode(ids, skip_special_tokens=False)
    for r, t in zip(bpe.round_trip_digests(odd, PATH).collect(), odd.collect()):
        ids = np.array(tok.encode(t["text"] or "", add_special_tokens=False).ids, "<u4")
        text = tok.decode(ids.tolist(), skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.decode(bpe.encode(odd, PATH), PATH).count() == odd.count()
    assert bpe.round_trip_digests(odd.limit(0), PATH).count() == bpe.encode(odd.limit(0), PATH).count() == 0


def test_bpe_many_at_once(monkeypatch):
    """Packing's way: pieces by the library's model, many texts in one call, which no piece of ordinary length leaves for the transducer."""
    tok, e, rng = Tokenizer.from_file(PATH), bpe.Encoder(PATH, direct=True), random.Random(8)
    parts = ["the", "Word", "İ", "Σ", "é", "e\u0301", "\u0301", "'s", "'Ve", "o'clock", "''s", "('t", "12", "½", "Ⅷ", "“", "—", "...", "),", "_", " ", "  ", "\n", "\x85", "\xa0", "\x1c", "\x00", "\ufffe", "\uffff", "😀", "𐐀", "中文", "नमस्ते", "<|endoftext|>", " " + "q" * 70 + " "]
    texts = [None, "", "\n", *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000))]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for few in (150_000, 50):  # with generations that change at every call
        monkeypatch.setattr(bpe, "FEWER", few)
        monkeypatch.setattr(bpe, "WINDOW", 1 << 10)
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode_many(texts)] == want
    assert e.streamed == 0 and e._transducer is None
    assert np.frombuffer(e.encode_many(["x" * 5000])[0], "<u4").tolist() == tok.encode("x" * 5000, add_special_tokens=False).ids and e.streamed == 1


def test_bpe_method(sf):
    """Every piece that isn't in the cache goes through the transducer, whatever its length, and emits before its end."""
    import pyarrow.parquet as pq

    e = bpe.Encoder(PATH)
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    pieces = {p for t in texts if t for s in unicodedata.normalize("NFC", t).split() for p in e.pattern.findall(s.replace("Σ", "σ").lower())}
    for t in texts:
        e.encode(t)
    assert e.streamed >= len(pieces) > 1000
    word, seen = "thequickbrownfox" * 200, []

    class Watched(str):
        def __getitem__(self, at):
            seen.append(at.stop if isinstance(at, slice) else at)
            return str.__getitem__(self, at)

    first = next(e.transducer.stream(Watched(word)))
    assert first == np.frombuffer(e.encode(word), "<u4")[0] and max(seen) <= 5 * e.transducer.lookahead < len(word)


PAGE = """<html><head><title>t</title><style>a>b</style></head><body><header><h1>Site</h1></header><ul class=menu><li>a<li>b</ul>{}
<div class="comments"><p>bad</div><form>q</form><!-- c --><p hidden>no</p><footer>f</footer></body>"""


def test_html(spark):
    body = '<div id="content-12"><p>One &amp; two<br>three  <b>x</b>y<p>Four</div><table><tr><td>1<td>2<tr><td>3</table><p title="a>b">last &lt;b&gt; 5 < 6'
    article = "<article><h1>Head</h1><p><b>A.<br><p>B</p><aside>no</aside></article><p>outside</p>"
    # without an article, what every page of a host has goes
    hosts = [(i, f"http://h.example.com/{i}", f"<div class=x><p>always the same</p></div><div class=y><p>only here {i} {i * 7}</p></div>") for i in range(10, 18)]
    rows = [(0, "http://a.example.com/", PAGE.format(body)), (1, None, PAGE.format(article)), (2, "u", None), (3, "http://b.example.com", ""), (3, "http://b.example.com", "")]
    df = spark.createDataFrame(rows + hosts, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[0] == "One & two three xy\n\nFour\n\n1\n\n2\n\n3\n\nlast <b> 5 < 6"
    assert got[1] == "Head\n\nA.\n\nB" and got[2] == got[3] == ""
    assert all(got[i] == f"only here {i} {i * 7}" for i in range(10, 18))
    assert html_extract.extract(df).count() == len(rows) + 8 and html_extract.extract(df.limit(0)).count() == 0


def slow_tree(pages):
    """node: (pages, importance) of one host's distinct pages, by the definitions."""
    parsed = [html_extract.parse(h) for h in {h for h in pages}]
    out = {}
    for node in {e for p in parsed for e, _ in p.nodes}:
        on = [p for p in parsed if node in dict(p.nodes)]
        m = len(on)
        styles = Counter(dict(p.nodes)[node] for p in on)
        blocks = Counter(t for p in on for t in {t for t, path, *_ in p.blocks if node in path})
        entropy = lambda weights: -sum(w * math.log(w) for w in weights)
        presentation = entropy(n / m for n in styles.values()) / math.log(m) if m > 1 else 1.0
        # a block on n pages has the entropy of n equal shares; what it tells is one less that over all pages
        content = 1 - sum(entropy([1 / n] * n) for n in blocks.values()) / len(blocks) / math.log(m) if m > 1 and blocks else 1.0
        noise = sum(node in p.noise for p in on) / m
        beside = sum(p.main()[1] and not any(node in b[1] for b in p.main()[0]) for p in on) / m
        out[node] = (m, (0.1 * presentation + 0.9 * max(0.0, content)) * (1 - noise) * (1 - 0.75 * beside))
    return out


def test_style_tree(spark):
    rng = random.Random(3)
    word = lambda: f"word{rng.randrange(90)}"
    one = lambda i: f"<nav>{word()}</nav><div class=top><p>same for all</p></div>" + (f"<article><h1>{word()}</h1><p>{word()}</p><div class=box>in each</div></article>" if i % 3 else "") + f"<div class=c{i % 2}{'x' * (i % 2)}><p>{word()} {i % 5}</p></div>"
    pages = [one(i) for i in range(30)]
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages + pages[:9] * 4)], "page_id long, url string, html string")
    got = {r["node"]: (r["pages"], r["importance"]) for r in html_extract.style_tree(df).collect()}
    want = slow_tree(pages)
    assert got.keys() == want.keys() and all(got[n][0] == want[n][0] and got[n][1] == pytest.approx(want[n][1]) for n in want)


def test_rare_template_in_a_large_host(spark):
    """A template on few of a host's pages goes as it would in a small host; their other text, and that of the other pages, stays."""
    page = lambda i, extra="": f"<body><article><p>Text {i} of its own, told at some length {i * 7}</p>{extra}</article></body>"
    box = "<section class=box><p>Read on here</p></section>"
    rows = [(i, "http://a.org/x", page(i, box if i < 5 else "")) for i in range(900)] + [(1000 + i, "http://b.org/x", page(i, box if i < 5 else "")) for i in range(9)]
    rows += [(2000, "http://a.org/y", rows[0][2])]  # a copy
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i] == f"Text {n} of its own, told at some length {n * 7}" for i, n in ((r[0], r[0] % 1000) for r in rows))


def test_tree_decides(spark, sf):
    """The tree judges inside and around the article; copies of a page aren't a template; no page loses all of its text."""
    from collections import Counter as Count

    article = lambda i, extra: f"<body><div class=skin><p>Skin of the site {i % 2}</p></div><article><p>Unique {i} text of some length, told at length {i}</p>{extra}</article></body>"
    rows = [(i, "http://a.org/x", article(i, "<div class=box><p>Read on here</p></div>")) for i in range(8)]
    rows += [(100 + i, "http://b.org/x", "<p>one</p><div><p>two</p></div>") for i in range(6)]  # copies alone
    rows += [(200 + i, None, f"<p>page {i // 40}</p>") for i in range(200)]
    rows += [(500 + i, "http://c.org/", f"<article><h1>Head {i}</h1><p>The same long story with many words in each copy</p></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Unique {i} text of some length, told at length {i}" for i in range(8))
    assert all(got[100 + i] == "one\n\ntwo" for i in range(6)) and all(got[200 + i] == f"page {i // 40}" for i in range(200))
    assert all(got[500 + i].endswith("in each copy") for i in range(9))
    # on the given pages it is the tree that takes out menus, adverts and the like: the share of such blocks that it names
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    low = {r["host"]: {*r["low"]} for r in html_extract.low_nodes(html_extract.style_tree(pages)).collect()}
    by = Count()
    for r in pages.select(html_extract.host("url").alias("h"), "html").collect():
        for b in html_extract.parse(r["html"]).blocks:
            by[b[2], not low.get(r["h"], set()).isdisjoint(b[1])] += 1
    assert by[True, True] > 0 and by[False, True] == 0


def slow_ppm(train, texts, order):
    count = defaultdict(Counter)
    stream = lambda t: b"\n" * order + " ".join(slow_words(t)).encode() + b"\n"
    for t in train:
        x = stream(t)
        for i in range(order, len(x)):
            for k in range(order + 1):
                count[x[i - k : i]][x[i]] += 1
    out = []
    for t in texts:
        x, total = stream(t), 0.0
        for i in range(order, len(x)):
            gone, p = set(), 1.0
            for k in range(order, -1, -1):
                if not (seen := count.get(x[i - k : i])):
                    continue
                left = {s: n for s, n in seen.items() if s not in gone}
                if x[i] in left:
                    p *= (2 * left[x[i]] - 1) / (2 * sum(left.values()))
                    break
                if left:
                    p *= len(left) / (2 * sum(left.values()))
                gone |= set(seen)
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        out.append(total)
    return out


def test_ppm(spark, odd, monkeypatch):
    """Against the definition; small blocks and many parts, so that every step deals its rows out."""
    rng = random.Random(7)
    train = ["".join(rng.choice("ab cÉ") for _ in range(rng.randint(0, 60))) for _ in range(30)] + ["", None]
    rest = ["".join(rng.choice("abcd xÉ") for _ in range(rng.randint(0, 60))) for _ in range(20)] + ["", None, "zzzz", "zz top " * 400]
    df = spark.createDataFrame([*enumerate(train + rest)], DOCS)
    words = Counter(w for t in train for w in slow_words(t))
    n, v = sum(words.values()) + len(train), len(words) + 1
    for order, block, part in ((0, 100, 50), (2, 1 << 20, 300), (4, 60, 200), (5, 500, 100), (5, 1 << 20, 1 << 20)):
        monkeypatch.setattr(ppm, "BLOCK", block)
        monkeypatch.setattr(ppm, "PART", part)
        monkeypatch.setattr(ppm, "STEP", min(256, block))
        got = {r["doc_id"]: r for r in ppm.lm_scores(df, F.col("doc_id") < len(train), order=order).collect()}
        for i, (t, s) in enumerate(zip(train + rest, slow_ppm(train, train + rest, order))):
            w, r = slow_words(t), got[i]
            base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(x in words for x in w) + 1, n)
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(s)
    assert ppm.lm_scores(odd, F.lit(True), order=3).count() == odd.count()
    assert ppm.lm_scores(odd.limit(0), F.lit(True)).count() == 0


def test_ppm_untrained(spark, odd):
    got = ppm.lm_scores(odd, F.lit(None).cast("boolean")).collect()
    assert len(got) == odd.count() and {(r["train_tokens"], r["n_known"], r["base_score"]) for r in got} == {(0, 0, 0.0)}
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[0] == by[1] == pytest.approx(-math.log10(256)) and by[3] == pytest.approx(-2 * math.log10(256))


def test_ppm_sums_to_one():
    """The trie's probabilities after a context add up to one, whatever has been seen."""
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.choice([97, 98, 99], (300, 3)), rng.integers(0, 256, (40, 3))]).astype(np.uint64) @ np.array([1 << 16, 1 << 8, 1], dtype=np.uint64)
    trie = ppm.Trie(ppm.levels(*ppm.add_up(keys, np.ones(len(keys), dtype=np.int64)), range(3)))
    for context in (0x6161, 0x6200, 0x0000, int(keys[-1] >> 8), int(keys[-1] & 0xFF)):
        assert (10 ** trie.log10(np.arange(256, dtype=np.uint64) | np.uint64(context << 8))).sum() == pytest.approx(1)


def test_quality(spark, sf, odd):
    got = queries.QUERIES["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.8  # some seventy labels to learn from
    w, x, s = quality.features("a b b c!")
    m = quality.fit([(w, x, s), quality.features("zz ##")], np.array([1.0, 0.0]), epochs=3)
    i, v = m.row(w, x, s)
    pairs = sum(float(m.v[a] @ m.v[b]) * p * q for n, (a, p) in enumerate(zip(i, v)) for b, q in [*zip(i, v)][n + 1 :])
    assert m.logit(i, v) == pytest.approx(m.w0 + float(m.w[i] @ v) + pairs)
    assert m.logits([(i, v), m.row(*quality.features(""))])[0] == pytest.approx(m.logit(i, v))
    assert quality.scores(odd.limit(0), m).count() == quality.keep_good(odd.limit(0), m).count() == 0
    rows = spark.createDataFrame([(1, "good words here"), (1, "other words"), (2, "## bad"), (3, "x")], DOCS)
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (9, 1)], "doc_id long, quality int")
    once, again = (quality.train(x, marks) for x in (rows, rows.orderBy(F.desc("text"))))
    assert (once.w == again.w).all() and once.mean.shape == again.mean.shape and quality.scores(rows, once).filter("score > 0 AND score < 1").count() == 4
    assert quality.scores(odd, m).count() == odd.count() and quality.keep_good(odd, m).columns == odd.columns
    none = quality.train(odd, odd.select("doc_id", F.lit(1).alias("quality")).limit(0))
    assert quality.scores(odd, none).filter("score < 0 OR score > 1").count() == 0


def slow_repeats(texts, n):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if count[r[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("group", [256, 8])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 700)
    rng = np.random.default_rng(8)
    make = lambda s, n: "".join(rng.choice([*s], n))
    base = [make("abcdé ", 900) for _ in range(4)]
    texts = ["", None, "x" * 399, "x" * 400, "x" * 401, "ab" * 700, *base, base[0][:500] + "Q" + base[0][500:], "zz" + base[1][100:600] + "yy", base[2], base[2], base[3][:399], base[3][450:] + base[3][:420]]
    texts += [make("xyz", 30) + base[0][200:620] + make("xyz", int(rng.integers(0, 90))) for _ in range(30)]
    df = spark.createDataFrame([*enumerate(texts), (3, "x" * 400)], DOCS).withColumn("row", F.lit(1))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == sorted((i, *x) for i, x in zip([*range(len(texts)), 3], slow_repeats([*texts, "x" * 400], 400)))
    assert all(r["text"] == bytes(r["kept"]).decode("utf-8", "replace") for r in suffix_dedup.remove_repeats(df).collect())
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_private(spark, odd):
    rows = [(1, "Mail Foo.Bar19@Mail5.example.com or foo.bar19@mail5.example.com, call +1 (523) 555-1055 or +1 523-555-1055."), (2, "ip 13.149.130.89 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"### 4785380592391139$$$ 4111-1111-1111-1111 4111 1111 1111 1111"), (5, "SSN 123-45-6789, Mr. John Smith met Mrs. Smith and г-жа Иванова. GB82 WEST 1234 5698 7654 32 éau.12@mail.example.org."), (6, "clean text 1.5 12:30 2024-01-01 1,000,000")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(df, "key").collect()}
    for old in ("foo.bar19", "Foo.Bar19", "523", "13.149.130.89", "24be64439e", "4785380592391139", "4111-1111", "123-45-6789", "John", "Smith", "Иванова", "WEST 1234", "éau"):
        assert not any(old in t for t in got.values()), old
    assert got[6] == rows[3][1]
    mails = re.findall(r"[\w.]+@[\w.]+[a-z]", got[1])
    assert mails[0].lower() == mails[1] and mails[0][0].isupper()  # one entity, two spellings
    phones = re.findall(r"\+1[ (\d)-]+\d", got[1])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and re.match(r"\+1 \(\d{3}\) \d{3}-\d{4}$", phones[0])
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[2])
    digits = [int(x) for x in re.sub(r"\D", "", cards[0])]
    assert re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1]) and sum(sum(divmod(2 * x, 10)) if i % 2 == 0 else x for i, x in enumerate(digits)) % 10 == 0
    assert re.search(r"Mr\. \w+ (\w+) met Mrs\. \1 and г-жа [А-Я]", got[5])
    assert {r["doc_id"]: r["text"] for r in pii.surrogates(df, "key").collect()} == got
    assert {r["doc_id"]: r["text"] for r in pii.surrogates(df, "other").collect()}[1] != got[1]
    assert pii.replace_private(odd, "k").columns == odd.columns
    assert sorted(map(str, pii.replace_private(odd, "k").collect())) == sorted(map(str, odd.collect()))


def test_private_distinct(spark, monkeypatch):
    """Few surrogates for many entities: each keeps one of its own, and none is an entity."""
    real = pii.core

    def narrow(key, kind, canon, attempt):
        n = F.pmod(F.xxhash64(canon, attempt, F.lit(key)), F.lit(300))
        return F.concat(F.lit("+1"), F.lpad(n.cast("string"), 10, "5"))

    monkeypatch.setattr(pii, "core", narrow)
    df = spark.createDataFrame([(i, f"call +1 (555) 555-5{i:03d} now") for i in range(100)], DOCS)
    texts = [r["text"] for r in pii.surrogates(df, "k").collect()]
    old = {r["text"] for r in df.collect()}
    assert len(set(texts)) == 100 and not old & set(texts) and real is not narrow


def test_private_ends(spark):
    """Letters of any script are replaced, and a format that runs out of surrogates gets longer ones."""
    mails = ["王伟@例子.中国", "محمد@مثال.com", "한글@b.kr", "ひらがな@b.jp", "დავით@b.ge", "_@a.com", *(f"+@{c}.com" for c in "abcdefghijklmnopqrstuvwxyz")]
    df = spark.createDataFrame([*enumerate(mails)], DOCS)
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(df, "k").collect()}
    assert len(set(got.values())) == len(mails) and not set(got.values()) & set(mails)
    for i, m in enumerate(mails[:5]):
        local, new = m.split("@")[0], got[i].split("@")[0]
        assert len(local) == len(new) and local != new
        same = lambda a, b: unicodedata.name(a).split()[0] == unicodedata.name(b).split()[0]
        assert all(same(a, b) for a, b in zip(local, new))


def test_private_names(spark, odd):
    """Columns that are named like the operator's own come through; repeated rows are alike; an empty table stays empty."""
    names = ["_id", "_found", "_attempts", "n_entities", "row", "found", "held", "m", "canon"]
    df = spark.createDataFrame([(1, "call +1 (555) 234-5678"), (1, "call +1 (555) 234-5678"), (None, "x a@b.org"), (2, None)], DOCS)
    df = df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    got = pii.replace_private(df, "k")
    assert got.columns == df.columns and got.count() == 4 and all(tuple(r)[2:] == tuple(range(len(names))) for r in got.collect())
    texts = {r["text"] for r in got.collect()}
    assert len(texts) == 3 and None in texts and not {"call +1 (555) 234-5678", "x a@b.org"} & texts
    assert pii.surrogates(df, "k").filter("doc_id = 1").first()["n_entities"] == 1
    assert pii.surrogates(odd.limit(0), "k").count() == pii.replace_private(odd.limit(0), "k").count() == 0


def test_private_brute_force(spark, sf):
    """Over the given documents: the same entities as a plain search finds, nothing else changed, one surrogate an entity and one entity a surrogate, format for format."""
    import regex

    find = regex.compile(pii.ENTITY)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    new = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.surrogates(docs, "k").collect()}
    canon = lambda m: re.sub(r"[^\d+]", "", m) if re.fullmatch(r"[\d+ ().-]+", m) and m.count(".") != 3 else m.lower()
    of, seen = {}, set()
    assert new.keys() == old.keys()
    for i, text in old.items():
        at, now = 0, new[i][0]
        found = [*find.finditer(text or "")]
        assert new[i][1] == len(found) and (found or now == text)
        ends = [m.end() for m in found]
        for k, m in enumerate(found):
            gap = text[ends[k - 1] if k else 0 : m.start()]
            assert now.startswith(gap, at)
            at += len(gap)
            own_length = regex.fullmatch(pii.IP, m[0]) or regex.fullmatch(pii.NAME, m[0])
            made = find.match(now, at)[0] if own_length else now[at : at + len(m[0])]
            at += len(made)
            seen.add(canon(m[0]))
            assert of.setdefault(canon(m[0]), canon(made)) == canon(made)
            if not own_length:
                shape = lambda t: ["d" if x.isdigit() else "l" if x.isalpha() else x for x in t]
                assert shape(made) == shape(m[0]) or regex.search("[0-9a-fA-F]{32}", m[0])
        assert now is None or not found or now[at:] == text[ends[-1] :]
    assert len(of) > 10 and len({*of.values()}) == len(of) and not seen & {*of.values()}
