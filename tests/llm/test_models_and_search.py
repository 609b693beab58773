"""Learned scores, neighbour search and URL rules on small tables."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("obsframe.llm")
from pyspark.sql import functions as F  # noqa: E402

from obsframe.llm import neighbours, quality, toxicity, urls  # noqa: E402
from obsframe.llm.queries import URL_RULES  # noqa: E402


def corpus(spark, n=900):
    rng = np.random.default_rng(2)
    words = np.array([f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"])
    docs, labels = [], []
    for i in range(n):
        t, toxic, good = list(rng.choice(words, rng.integers(20, 90))), i % 9 == 0, i % 5 != 0
        if toxic:
            t[3:3] = ["vileword", "Vilething"]
        if not good:
            t = [w + "###" for w in t]
        docs.append((i, " ".join(t), "en", "s"))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "no id", None, None), (0, "again vileword", None, None)]
    labels += [(None, 1, 1), (n + 7, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] not in (0, None)}
    bad, good = [score[i] for i in range(1, 900) if i % 9 == 0], [score[i] for i in range(900) if i % 9]
    assert np.mean(np.array(bad) >= 0.5) > 0.95 and np.mean(np.array(good) < 0.5) > 0.98
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert {900, 901, None} <= kept and 9 not in kept and toxicity.drop_toxic(docs, model).columns == docs.columns
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert np.array_equal(again.codes, model.codes) and np.allclose(again.weights, model.weights)
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_non_negative_risk_survives_a_small_sample():
    rng = np.random.default_rng(0)
    row = lambda bad: np.append(rng.integers(10, 60, 15), [1] if bad else []).astype(np.uint32)
    model = toxicity.train([row(True) for _ in range(40)], [row(i % 5 == 0) for i in range(200)], 0.2)
    weights = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    assert max(weights, key=weights.get) == 1 and model.bias < 0


def brute_risk(z, n_p, prior):
    """The parts of the risk, summed example by example."""
    loss = lambda v, y: float(np.log1p(np.exp(-y * v)))
    p, u = z[:n_p], z[n_p:]
    plus = prior * sum(loss(v, 1) for v in p) / len(p)
    return plus, sum(loss(v, -1) for v in u) / len(u) - prior * sum(loss(v, -1) for v in p) / len(p)


def test_risk_and_its_gradient():
    """The estimator and both kinds of steps against sums over examples and difference quotients."""
    rng = np.random.default_rng(5)
    signs = set()
    for shift in (-3, 0, 3):
        for prior in (0.1, 0.5, 0.9):
            z = rng.normal(size=12)
            z[:5] += shift
            plus, minus, g = toxicity.risk(z, 5, prior, 0.3)
            assert (plus, minus) == pytest.approx(brute_risk(z, 5, prior))
            signs.add(minus < 0)
            for k in range(len(z)):
                h = np.zeros(len(z))
                h[k] = 1e-5
                up, down = brute_risk(z + h, 5, prior), brute_risk(z - h, 5, prior)
                want = (up[0] - down[0] - 0.3 * (up[1] - down[1])) / 2e-5 if minus < 0 else (sum(up) - sum(down)) / 2e-5
                assert g[k] == pytest.approx(want, abs=1e-8)
    assert signs == {True, False}


def test_toxicity_scores_by_hand(spark):
    """Scores of the operator are those of the model's sums over distinct words and beginnings, text by text."""
    docs, labels = corpus(spark, 300)
    docs = docs.unionByName(spark.createDataFrame([(2000, "vileword " + "bal " * 50_000, None, "x"), (2001, "é 日本 vileword", None, "y")], docs.schema))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.codes.tolist(), model.weights.tolist(), strict=True))
    text = {(r["doc_id"], r["text"]): r["text"] for r in docs.collect()}
    rows = docs.select("doc_id", "text").collect()
    scores = toxicity.score_documents(docs, model).collect()
    got, want = [], []
    for r in rows:
        words = set(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text[r["doc_id"], r["text"]] or "").encode().lower()))
        z = model.bias + sum(weight.get(zlib.crc32(w), 0.0) for w in words) + sum(weight.get(zlib.crc32(w) ^ 0x5BD1E995, 0.0) for w in {w[:4] for w in words})
        want.append((repr(r["doc_id"]), round(1 / (1 + np.exp(-min(30, max(-30, z)))), 9)))
    got = [(repr(r["doc_id"]), round(r["score"], 9)) for r in scores]
    assert sorted(got) == sorted(want)


def test_all_documents_with_labels(spark):
    """Labels on all documents but a few change no sample of unlabelled text."""
    docs, labels = corpus(spark, 300)
    more = labels.unionByName(docs.where("doc_id > 5").join(labels, "doc_id", "left_anti").selectExpr("doc_id", "1 as quality", "null as toxic"))
    a, b = toxicity.fit(docs, labels, prior=0.1), toxicity.fit(docs, more, prior=0.1)
    assert np.array_equal(a.codes, b.codes) and np.allclose(a.weights, b.weights)


def test_empty_tables(spark):
    docs, labels = corpus(spark, 60)
    for fit, score in ((toxicity.fit, toxicity.score_documents), (quality.fit, quality.score_documents)):
        for d, n in ((docs.limit(0), 0), (docs, docs.count())):
            for y in (labels, labels.limit(0)):
                assert score(d, fit(docs.limit(0), y)).count() == n and score(d, fit(docs, y)).count() == n
    assert toxicity.drop_toxic(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_quality(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] not in (0, None)}
    out = [i for i in range(1, 900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.3) == (i % 5 != 0) for i in out]) > 0.98
    empty = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_documents(docs, empty).collect()} == {0.5}


def test_flat_trees_follow_each_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.95
    for i in range(5):
        z = model.bias
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            z += leaf[node - len(f)]
        assert model.scores(x)[i] == pytest.approx(1 / (1 + np.exp(-z)))


def brute_nearest(ids, vectors, k=5):
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % 50 == 0:
            s = vectors @ v / (np.sqrt((vectors**2).sum(axis=1)) * np.sqrt((v**2).sum()))
            out[q] = sorted((-x, i) for x, i in zip(s.tolist(), ids, strict=True) if i != q)[:k]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[200:600] = v[7] + rng.normal(size=(400, 16)).astype(np.float32) * 0.01  # a hot cluster
    v[600:700] = v[50]  # equal vectors, queries among them
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [1.0] * 3, 0), (5200, [None] + [1.0] * 15, 0), (5250, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (50, v[50].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    want = brute_nearest(list(range(1500)), v.astype(float))
    for hot in (neighbours.HOT, 20):
        monkeypatch.setattr(neighbours, "HOT", hot)
        got = neighbours.nearest(df, F.col("id") % 50 == 0).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert set(by) == set(want) and all(len(x) == 5 for x in by.values())
        recall = np.mean([i in {x for x, _ in by[q]} for q, top in want.items() for _, i in top])
        assert recall >= 0.9
        for q, top in by.items():
            for i, s in top:
                assert s == pytest.approx(float(v[q].astype(float) @ v[i].astype(float) / np.linalg.norm(v[q].astype(float)) / np.linalg.norm(v[i].astype(float))), abs=1e-12)
        assert [i for i, _ in by[50]] == [600, 601, 602, 603, 604]
    assert neighbours.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 40])
def test_neighbours_of_few_rows(spark, n):
    """As many as there are, up to k, with the settings of the query; no bucket need hold them."""
    v = np.random.default_rng(n).normal(size=(n, 64))
    v[0] *= -1e3
    df = spark.createDataFrame([(50 * i if i < 2 else 50 * i + 1, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    ids = [50 * i if i < 2 else 50 * i + 1 for i in range(n)]
    got = neighbours.nearest(df, F.col("id") % 50 == 0).collect()
    want = brute_nearest(ids, v)
    for q in want:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, min(5, n - 1) + 1))
        if n <= 6:
            assert [m[1] for m in mine] == [i for _, i in want[q]]
        for _, i, s in mine:
            a, b = v[ids.index(q)], v[ids.index(i)]
            assert s == pytest.approx(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), abs=1e-14)


def test_neighbours_of_an_isolated_query_and_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(8)
    near = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.01
    rows = [(i + 1, x.tolist()) for i, x in enumerate(near)] + [(0, (-near[0]).tolist()), (1, rng.normal(size=16).tolist())] + [(2, (near[1] * (j + 1)).tolist()) for j in range(8)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id").isin(0, 1, 2)).collect()
    for q in (0, 1, 2):
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and len({m[1] for m in mine} - {q}) == 5
    best = {}
    for i, x in rows:  # an id counts by its nearest vector
        cosine = float(np.dot(x, rows[300][1]) / np.linalg.norm(x) / np.linalg.norm(rows[300][1]))
        best[i] = max(cosine, best.get(i, -1)) if i else -2
    want = sorted(best, key=lambda i: -best[i])[:5]
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 0)
    assert [m[1] for m in mine] == want and [m[2] for m in mine] == pytest.approx([best[i] for i in want], abs=1e-12)


def test_urls(spark):
    pages = [
        (1, "http://Example.com/en/x", "allow", None), (2, "https://a.b.EXAMPLE.com/en/", "block", "example.com/en/"), (3, "http://www.example.com/en/1?x#y", "allow", "www.example.com/en/"),
        (4, "http://x.net/es/1", "block", "net/es/"), (5, "http://x.net/ES/1", "allow", None), (6, None, "allow", None), (7, "no scheme/en/", "allow", None), (8, "http://mycom/", "allow", None),
        (9, "http://com/", "allow", "com/"), (10, "http://www.example.com?x=/en/", "allow", None), (11, "a://b.net/fr/://c.com/en/", "block", "net/fr/"), (12, "http://x.org/", "allow", None), (4, "http://x.net/es/1", "block", "net/es/"), (None, "http://", "allow", None),
    ]
    pages[0] = (1, "http://Example.com/en/x", "block", "example.com/en/")
    df = spark.createDataFrame([p[:2] + ("z",) for p in pages], "page_id long, url string, rule string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = urls.judge_urls(df, rules).collect()
    assert sorted((repr(r["page_id"]), r["verdict"], repr(r["rule"])) for r in got) == sorted((repr(p[0]), p[2], repr(p[3])) for p in pages)
    many = rules.unionByName(spark.range(3000).selectExpr("concat('h', id, '.org') as host", "'/' as path", "'block' as verdict"))
    assert {r["verdict"] for r in urls.judge_urls(spark.createDataFrame([(1, "http://a.h7.org/q")], "page_id long, url string"), many).collect()} == {"block"}
    long = "x." * 20_000
    odd = spark.createDataFrame([(1, f"http://{long}example.com/en/{'y/' * 20_000}"), (2, f"http://{long}org/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urls.judge_urls(odd, rules).collect()} == {1: "example.com/en/", 2: None}
    small, urls.BROADCAST_BYTES, urls.BROADCAST_BLOCKS = (urls.BROADCAST_BYTES, urls.BROADCAST_BLOCKS), 0, 0
    try:
        again = urls.judge_urls(df, rules).collect()
    finally:
        urls.BROADCAST_BYTES, urls.BROADCAST_BLOCKS = small
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert urls.judge_urls(df, rules.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0
    assert urls.judge_urls(df.limit(0), rules).count() == 0
