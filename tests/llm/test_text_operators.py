"""Operators over document texts, held against plain Python on small tables with nulls, copies and long texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

pytest.importorskip("obsframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from obsframe.llm import components, decontaminate, mixing, simhash, simple8b, substrings, token_counts, work  # noqa: E402
from obsframe.llm.encoding import PieceEncoder, default_tokenizer, encoder  # noqa: E402

#: With extra columns whose names operators use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, start int, row string"


def make_docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, None if t is None else len(t), "x", 7, "w") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "é", "Äpfel", "日本", "X"]
    passage = [rng.choice(words) for _ in range(60)]
    out = [None, "", " \t\n", "the", "The the THE the", "the " * 90, "the " * 57 + "of " * 30, "a b " * 40, "a b " * 33 + "c"]
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([3, 19, 20, 21, 50, 300]))]
        if rng.random() < 0.4:
            at, n = rng.randrange(len(t)), rng.randrange(15, 60)
            t[at:at] = passage[:n] if rng.random() < 0.5 else passage[-n:]
        out.append((" " if rng.random() < 0.7 else "\n ").join(t))
    out += [out[12], out[13], out[13].replace("w1", "w2"), out[14] + " tail", " ".join(rng.choice(words) for _ in range(30_000))]
    return out


def test_encoder_equals_library(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    odd = [*texts, "don't\u00a0 stop  \n\n x\x1c y\x85z ½²3₂ ﬁ <|endoftext|> 's", "a" * 5000, " "]
    ids, sizes = encoder(default_tokenizer()).encode(odd)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_encoder_equals_library_on_white_space_and_marks():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(default_tokenizer()), random.Random(13)
    signs = [" ", " ", " ", "\n", "\t", "\u00a0", "\u0085", "\x1f", "a", "the", "Don't", "'s", "'", ",", "...", "12", "½", "é", "x" * 30, "<|", "|>", "_"]
    texts = ["".join(rng.choices(signs, weights if rng.random() < 0.5 else None, k=rng.randrange(12))) for weights in ([9] * 4 + [1] * 18, [1] * 22) for _ in range(6000)]
    ids, sizes = encoder(default_tokenizer()).encode(texts)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_operators_meet_added_tokens(spark, texts):
    """Token tables and lengths are those of the tokenizer file as it is, nothing but add_special_tokens changed."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    odd = [*texts[:20], "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>日", "<|endoftext |>"]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert [64, 220, 50256, 275] in want
    docs = make_docs(spark, odd)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in simple8b.token_table(docs).collect()}
    assert got == {i: (len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for i, w in enumerate(want)}
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs)).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in sums} == {n: list(map(len, want)).count(n) for n in map(len, want)}


def test_length_histogram(spark, texts):
    sizes = PieceEncoder(default_tokenizer()).encode(texts)[1].tolist()
    sums = token_counts.suffix_sums(token_counts.length_histogram(make_docs(spark, texts))).cache()
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert r["n_docs"] == sizes.count(n)
        assert r["docs_ge"] == sum(s >= n for s in sizes) and r["tokens_ge"] == sum(s for s in sizes if s >= n)
        assert r["docs_le"] == sum(s <= n for s in sizes) and r["truncated_total"] == sum(min(s, n) for s in sizes)
    limits = [0, 1, 17, 512, 10**6]
    assert {r["limit_tokens"]: r["total"] for r in token_counts.truncated_totals(sums, limits).collect()} == {n: sum(min(s, n) for s in sizes) for n in limits}
    q = {r["probability"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.0, 0.5, 1.0]).collect()}
    assert q[0.5] == sorted(sizes)[(len(sizes) + 1) // 2 - 1] and q[1.0] == max(sizes)
    assert token_counts.suffix_sums(token_counts.length_histogram(make_docs(spark, []))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 119, 120, 4095, 4096, 4097, 20_000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(n, top):
    v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True)
    v[n // 3 : n // 2] = 0
    words, offsets = simple8b.encode(v)
    assert np.array_equal(simple8b.decode(words, offsets, n), v)


def test_token_files(spark, texts):
    ids = [*range(len(texts) - 3), 5, 5, None]
    docs = make_docs(spark, texts, ids).repartition(4)
    plain = PieceEncoder(default_tokenizer())
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    got = simple8b.read_tokens(simple8b.write_tokens(docs, simple8b.new_path(spark, "tokens")), with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids"][-1]) == (start, len(r["ids"]), 2)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    want = sorted([*map(int, plain.encode([t])[0]), 2] for _, t in rows)
    assert sorted(r["ids"] for r in got) == want
    assert simple8b.token_table(make_docs(spark, [])).count() == 0


def test_mixing(spark, texts):
    texts = texts[:-1]  # sizes vary less without the very long text
    docs = make_docs(spark, texts * 20, range(20 * len(texts)))
    docs = docs.withColumns({"source_key": F.lit(1), "name": F.lit(2), "rate": F.lit(3), "copy": F.lit(4), "u": F.lit(5), "n": F.lit(6)})
    got = mixing.mix_sources(docs.withColumn("mix_key", F.lit(7)), weights={"s0": 3.0, "s1": 1.0, None: 0.5}, total=10**6, seed=4)
    assert got.columns == [*docs.columns, "mix_rate", "mix_copy", "mix_key"]
    rows = got.collect()
    assert {r["source"] for r in rows} <= {"s0", "s1", None}
    size = lambda s: sum(len(r["text"] or "") + 1 for r in rows if r["source"] == s)
    assert size("s0") / size("s1") == pytest.approx(3, rel=0.25)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs.repartition(7), weights={"s0": 3.0, "s1": 1.0, None: 0.5}, total=10**6, seed=4).collect()))
    assert mixing.mix_sources(make_docs(spark, [])).count() == 0
    small, mixing.BROADCAST_BYTES = mixing.BROADCAST_BYTES, 0
    try:
        salted = mixing.mix_sources(docs, weights={"s0": 3.0, "s1": 1.0, None: 0.5}, total=10**6, seed=4).collect()
    finally:
        mixing.BROADCAST_BYTES = small
    assert sorted(map(repr, rows)) == sorted(map(repr, salted))


def brute_poisson(u, rate):
    """How many k have a cumulative probability below u, summed term by term from logarithms."""
    n, l, c = 0, -rate, math.exp(-rate)
    while c < u and n < rate + 12 * rate**0.5 + 30:
        n += 1
        l += math.log(rate) - math.log(n)
        c += math.exp(l)
    return n


def test_poisson_inverse(spark):
    rates = (0.0, 0.3, 4.0, 150.0, 2000.0, 3e6)
    table = mixing.distributions(spark.createDataFrame([(str(r), r) for r in rates], "source_key string, rate double"))
    u = mixing.uniform(F.col("id").cast("string"))
    drawn = spark.range(4000).crossJoin(table).select("rate", "id", u.alias("u"), mixing.poisson_inverse(u, F.col("low"), F.col("cdf"), F.col("steps")).alias("n")).toPandas()
    for rate in rates:
        n = drawn[drawn["rate"] == rate]
        assert len(n) == 4000 and n["n"].mean() == pytest.approx(rate, abs=4 * (rate / 4000) ** 0.5 + 1e-9)
        assert rate == 0 or n["n"].var() == pytest.approx(rate, rel=0.12)
        if 0 < rate < 1e4:
            assert [brute_poisson(u, rate) for u in n["u"][:500]] == n["n"][:500].tolist()


@pytest.mark.parametrize("most", [mixing.BROADCAST_BYTES, 0])
def test_mixing_of_rows_without_an_id_of_their_own(spark, most, monkeypatch):
    """Rows with null or repeated ids, equal ones too, draw one by one, and are spread over partitions."""
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", most)
    monkeypatch.setattr(mixing, "PIECE", 100)
    text = "t" * 9
    rows = [(None, text, "a", i % 2) for i in range(3000)] + [(7, text, "a", 0)] * 3000 + [(i, text, "a", 0) for i in range(100, 1100)] + [(None, None, None, None)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(4)
    mixed = mixing.mix_sources(docs, weights={"a": 1.0, None: 0.1})
    got = mixed.collect()
    for own in (lambda r: r["doc_id"] is None and r["text"], lambda r: r["doc_id"] == 7, lambda r: (r["doc_id"] or 0) >= 100, lambda r: r["text"] is None):
        mine = [r for r in got if own(r)]
        n = sum(1 for r in rows if own(dict(zip(("doc_id", "text", "source", "extra"), r, strict=True))))
        rate = mine[0]["mix_rate"]
        assert len(mine) == pytest.approx(n * rate, abs=4 * (n * rate) ** 0.5)
        first = sum(r["mix_copy"] == 0 for r in mine)  # rows drawn at least once
        assert first == pytest.approx(n * (1 - math.exp(-rate)), abs=4 * (n * math.exp(-rate) * (1 - math.exp(-rate))) ** 0.5)
    assert len({r["mix_key"] for r in got}) == len(got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs.repartition(9), weights={"a": 1.0, None: 0.1}).collect()))
    sizes = [len(p) for p in mixed.rdd.glom().collect()]
    assert max(sizes) < 0.6 * len(got)


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, found = low(text), set(), set()
    for item, t in items:
        w = low(t)
        n = min(window, len(w))
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("item_chars", [10**6, 60])
def test_decontamination(spark, texts, item_chars):
    items = [(1, " ".join(texts[30].split()[:14])), (2, "The, OF w1"), (3, None), (10, ""), (4, "the the the the the the the the the the the"), (5, "w7"), (6, " ".join(texts[31].split()[2:13])), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    items += [(8, items[0][1]), (9, items[0][1].upper())]
    docs = [*texts, items[0][1] + " and " + items[6][1], "x THE of W1 y", "Ä the of w1é w7"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.contamination(make_docs(spark, docs), bench, item_chars=item_chars)).collect()}
    for i, t in enumerate(docs):
        n, hit, found = brute_hits(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), (i, t)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_decontaminate_text(spark):
    passage = " ".join(f"q{i}" for i in range(25))
    clean = "Clean  text,\nkept as it is."
    long = " ".join(f"z{i}" for i in range(80))
    docs = make_docs(spark, [clean, None, passage, f"{long} {passage}, {long}", ""])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(got) == {0, 1, 3, 4} and got[0]["text"] == clean and got[1]["text"] is None
    assert got[3]["text"] == f"{long} , {long}" and got[3]["n_chars"] == len(got[3]["text"])
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 5


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in zip(ids, fps, strict=True):
        for b, y in zip(ids, fps, strict=True):
            if a < b and (x ^ y).bit_count() <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [components.SMALL, 0])
def test_simhash(spark, texts, small, monkeypatch):
    monkeypatch.setattr(components.connected_components, "__defaults__", (small,))
    near = [texts[-1].replace("w33 ", "w34 ", k) for k in range(1, 12)]
    docs = [*texts, *near]
    got = simhash.near_duplicates(make_docs(spark, docs)).collect()
    fps = [brute_fingerprint(t) for t in docs]
    want = brute_components(list(range(len(docs))), fps, 2)
    assert {r["doc_id"]: r["fp"][0] % 2**64 for r in got} == dict(enumerate(fps))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(docs) - 8
    assert simhash.near_duplicates(make_docs(spark, [])).count() == 0


def test_simhash_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(400):
        x = rng.choice(fps)
        for _ in range(rng.choice([1, 2, 2, 3])):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    rows = spark.createDataFrame([(i, 5, [x]) for i, x in enumerate(signed)], "node long, n long, fp array<long>")
    want = brute_components(list(range(len(fps))), fps, 2)
    for chunk in (2048, 3):
        for small in (10**6, 0):
            parts = dict(components.connected_components(simhash.links(rows, 2, chunk=chunk), small).collect())
            assert {i: parts.get(i, i) for i in range(len(fps))} == want


def test_keep_one(spark, texts):
    base = texts[-1].split()[:400]
    near = [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in (30, 90, 200)]
    docs = make_docs(spark, [*texts[20:40], *near, None, None, "short one"], [*range(24), None, None])
    got = sorted((r["doc_id"] for r in simhash.keep_one(docs).collect()), key=lambda x: (x is None, x))
    assert got == [*range(21), 23, None, None]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """An id with several texts joins their groups; rows without an id have a fingerprint and no component."""
    rng = random.Random(21)
    a, b, c = (" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(500)) for _ in range(80)) for _ in range(3))
    docs = make_docs(spark, [a, a + " end", b, c, c, b, None, None, ""], [5, 6, 6, 7, 8, None, 9, None, 10])
    for settings in ({"similarity": 0.8, "words": 5, "lanes": 8}, {"similarity": 0.8, "words": 5, "lanes": 8, "id_col": "doc_id"}):
        got = simhash.near_duplicates(docs, **settings).collect()
        assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (5, 5), (6, 5), (6, 5), (7, 7), (8, 7), (9, 9), (10, 9)]
    got = simhash.near_duplicates(docs, radius=0).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got if r["doc_id"] in (7, 8, 9, 10, None)) == [(0, 0), (0, 0), (7, 7), (8, 7), (9, 9), (10, 9)]
    assert [r["component_id"] for r in got if r["doc_id"] == 6] == [6, 6]
    kept = simhash.keep_one(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 5, 7, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def brute_repeats(rows, window=20):
    first, out = {}, {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(split):
        words, gone = split[i], set()
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k : k + window]), (i, k)) != (i, k):
                gone |= set(range(k, k + window))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substrings(spark, texts, monkeypatch):
    rng = random.Random(8)
    runs = [" ".join(rng.choice("ab") for _ in range(200)) for _ in range(6)] + [" ".join(rng.choice(["a", "a", "a", "a", "b"]) for _ in range(300)) for _ in range(6)]
    docs = [*texts, *runs, " ".join(runs[0].split()[30:90] + texts[40].split()[:25] + runs[3].split()[10:31])]
    want = brute_repeats(list(enumerate(docs)))
    for size in (substrings.CHUNK_BYTES, 700):
        monkeypatch.setattr(substrings._described.__globals__["by_bytes"], "__defaults__", (size,))
        monkeypatch.setattr(substrings, "CHUNK_BYTES", size)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(make_docs(spark, docs).repartition(3)).collect()}
        assert got == want
    assert substrings.remove_repeats(make_docs(spark, [])).count() == 0
    twice = substrings.remove_repeats(make_docs(spark, [texts[20], texts[20], texts[21]], [4, 4, None]), with_text=True).collect()
    assert [r["n_removed"] for r in twice if r["doc_id"] == 4] == [0, 0]


@pytest.mark.parametrize("chunk", [2048, 6])
def test_verified_near_duplicates(spark, chunk, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 300]))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            t = list(base)
            for _ in range(rng.choice([1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append(" ".join(t))
    docs += [docs[0], docs[0].upper(), "a b", "a b", "", None, "a " * 50, "a " * 60]

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()

    sets, root = [shingles(t) for t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            same = not sets[a] and not sets[b]
            if same or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    monkeypatch.setattr(simhash, "WIDE_CHUNK", chunk)
    got = simhash.near_duplicates(make_docs(spark, docs), words=5, lanes=8, radius=105, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(docs))}


def shingle_sets(docs, words=5):
    out = []
    for t in docs:
        w = (t or "").lower().split()
        k = min(words, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    return out


def jaccard_components(docs, similarity=0.8):
    """The least row of each row's component, all pairs compared."""
    sets, root = shingle_sets(docs), list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def test_every_candidate_is_verified(spark, monkeypatch):
    """A link whose rows have many closer rows of other groups that lack the similarity, in one chunk and across some."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    line, rest = [rng.choice(words) for _ in range(25)], [rng.choice(words) for _ in range(150)]
    docs = [" ".join(line + rest), " ".join(line * 5 + rest)]  # alike as sets, not by fingerprints that count repeats
    for k in range(40):
        t = line + rest
        t[30 + 3 * k : 50 + 3 * k] = [rng.choice(words) for _ in range(20)]
        docs.append(" ".join(t))
    want = jaccard_components(docs)
    assert want[1] == 0 and len(set(want.values())) > 5
    for chunk in (4096, 5):
        monkeypatch.setattr(simhash, "WIDE_CHUNK", chunk)
        monkeypatch.setattr(simhash, "SET_CHUNK", chunk, raising=False)
        got = simhash.near_duplicates(make_docs(spark, docs), words=5, lanes=8, radius=250, similarity=0.8).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_equal_fingerprints_are_verified(spark):
    """Texts that one repeated line dominates have equal fingerprints, but share few shingles."""
    rng = random.Random(22)
    line = [f"w{rng.randrange(5000)}" for _ in range(7)]
    docs = [" ".join(line * 50 + [f"w{rng.randrange(5000)}" for _ in range(30)]) for _ in range(3)] + ["", None]
    docs.append(docs[1].upper())
    assert simhash.fingerprint(docs[0].encode(), 5, 8)[0] == simhash.fingerprint(docs[1].encode(), 5, 8)[0]
    got = sorted(r["doc_id"] for r in simhash.keep_one(make_docs(spark, docs)).collect())
    assert got == [0, 1, 2, 3]


def test_candidates_lose_no_pair(spark):
    """Pairs just at the similarity in short texts, and texts that differ in how often a line is repeated."""
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(100_000)}"
    docs = []
    for n in [8] * 40 + [16, 2000]:
        t = [word() for _ in range(n)]
        docs += [" ".join(t), " ".join([*t, *[word() for _ in range(max((n - 4) // 4, 1))]])]
    line = [word() for _ in range(20)]
    rest = [word() for _ in range(300)]
    docs += [" ".join(line + rest), " ".join(line * 100 + rest)]
    got = sorted(r["doc_id"] for r in simhash.keep_one(make_docs(spark, docs)).collect())
    assert got == list(range(0, len(docs), 2))


@pytest.mark.parametrize("item_chars", [10**6, 400, 100, 15])
def test_decontaminate_in_groups_of_items(spark, item_chars):
    """Overlapping hits and coverage do not depend on how items are dealt into groups, or cut into pieces."""
    q = [f"q{i}" for i in range(60)]
    clean = [f"z{i}" for i in range(80)]
    bench = [(i, " ".join(q[5 * i : 5 * i + 10])) for i in range(9)] + [(20, "short item"), (21, " ".join(clean[20:75])), (22, None), (22, "")]
    docs = [clean[:19] + q[:15] + clean[:19], q[:10] + clean[:11] + q[30:45], clean[:9] + q[3:36] + clean[:19] * 3, q[:10] + clean[:14] + q[40:50] + clean[:15], None, ["a"] * 40 + clean[50:70], ["a"] * 9 + ["short", "item"] + ["b"] * 9, ["short"]]
    docs = make_docs(spark, [None if d is None else " ".join(d) for d in docs], [0, 1, 2, 3, 4, 5, 6, 6])
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(docs, items, item_chars=item_chars).collect())
    a = " ".join
    want = [(0, a(clean[:19]) + "  " + a(clean[:19])), (2, a(clean[:9] + q[3:5]) + "  " + a([q[35], *clean[:19], *clean[:19], *clean[:19]]))]
    want += [(3, " " + a(clean[:14]) + "  " + a(clean[:15])), (4, None), (5, a(["a"] * 40) + " "), (6, a(["a"] * 9) + "  " + a(["b"] * 9)), (6, "short")]
    assert got == want
    assert decontaminate.decontaminate(docs.limit(0), items, item_chars=item_chars).count() == 0


def test_span_limit(spark):
    """Hits shorter than the limit stay, as long ones go; whole short items go at any length."""
    clean, passage = [f"z{i}" for i in range(60)], [f"q{i}" for i in range(30)]
    docs = make_docs(spark, [" ".join(clean + passage[:n] + clean) for n in (9, 12, 19, 20, 25)] + [" ".join(clean + ["tiny", "one"] + clean)])
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, "tiny one")], "item_id long, text string")
    left = {r["doc_id"]: len((r["text"] or "").split()) - 120 for r in decontaminate.decontaminate(docs, bench, span_limit=20).collect()}
    assert left == {0: 9, 1: 12, 2: 19, 3: 0, 4: 0, 5: 0}
    left = {r["doc_id"]: len((r["text"] or "").split()) - 120 for r in decontaminate.decontaminate(docs, bench).collect()}
    assert left == {0: 9, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench, coverage_limit=0.1).collect()} == {0, 1, 5}


def passages(seed=11):
    """Texts with a passage in every one, whole copies, runs of one word, and passages that only some share."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    common, other = [rng.choice(words) for _ in range(70)], [rng.choice(words) for _ in range(200)]
    out = []
    for i in range(90):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        t[len(t) // 2 : len(t) // 2] = common[i % 7 :]
        if i % 3 == 0:
            a = rng.randrange(150)
            t += other[a : a + 45] + ["same"] * (20 + i)
        out.append(" ".join(t))
    return [*out, out[5], out[6], None, ""]


@pytest.mark.parametrize("chunk, ranges", [(4_000_000, 1024), (600, 1024), (600, 4)])
def test_repeats_with_a_passage_in_every_document(spark, monkeypatch, chunk, ranges):
    """Equal windows of many chunks meet range by range, then across ranges."""
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substrings, "CHUNK_RANGE", ranges)
    docs = passages()
    want = brute_repeats(list(enumerate(docs)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(make_docs(spark, docs).repartition(5)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 5000


def test_repeats_under_forced_collisions(spark, monkeypatch):
    """Windows, and words, that differ but have equal hashes are told apart by their words."""
    docs = passages()
    want = brute_repeats(list(enumerate(docs)))
    read = lambda: {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(make_docs(spark, docs).repartition(5)).collect()}
    strong = []
    changes = substrings._changes
    monkeypatch.setattr(substrings, "_changes", lambda *a: strong.append(a[5]) or changes(*a))
    assert read() == want and strong == [False]

    def weak(codes, starts, window=20):
        return codes[starts] % np.uint64(50), np.zeros(len(starts), np.uint64)

    with monkeypatch.context() as m:
        m.setattr(substrings, "window_hashes", weak)
        assert read() == want and strong == [False, False, True]

    word_codes = substrings._word_codes

    def few_codes(texts):
        codes, mark, begin = word_codes(texts)
        return codes % np.uint64(3), mark, begin

    monkeypatch.setattr(substrings, "_word_codes", few_codes)
    assert read() == want and strong[-1] is True


def test_exchanges_follow_stored_bytes(spark, tmp_path, monkeypatch):
    docs = make_docs(spark, [f"word{i % 7} other{i % 50} " * 20 for i in range(300)])
    assert work.stored_bytes(docs) == 0  # no files
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    size = sum(p.stat().st_size for p in (tmp_path / "docs").glob("*.parquet"))
    assert work.stored_bytes(stored) == work.stored_bytes(stored.select("doc_id").where("doc_id > 5")) == size
    least = work.partitions(spark)
    assert work.partitions(spark, size) == least and work.partitions(spark, work.TASK_BYTES * (least + 4) + 1) == least + 5
    rows = lambda: [sorted(map(tuple, f.collect()), key=str) for f in (simple8b.token_table(stored), mixing.mix_sources(stored), simhash.near_duplicates(stored), substrings.remove_repeats(stored))]
    before = rows()
    monkeypatch.setattr(work, "TASK_BYTES", 4000)
    assert work.partitions(spark, size) > least
    assert rows() == before
