"""The pipeline's stages against plain versions, and the entry module with and without the subpackage."""

import os
import subprocess
import sys
import zlib

import numpy as np
import pytest

pytest.importorskip("obsframe.llm")
import corpus_pipeline  # noqa: E402
from obsframe.llm.decontaminate import normalised_words  # noqa: E402
from obsframe.llm.encoding import PieceEncoder, default_tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: clean texts, toxic ones, copies and near copies, a benchmark passage, nulls and an extra column."""
    rng = np.random.default_rng(6)
    words = np.array([f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "lmnrst"])
    texts = [list(rng.choice(words, rng.integers(40, 160))) for _ in range(400)]
    passage = " ".join(rng.choice(words, 20))
    toxic = set(range(0, 400, 8))
    for i in toxic:
        texts[i][5:5] = ["vileword", "vileness"]
    docs = [(i, " ".join(t), "en", f"s{i % 4}") for i, t in enumerate(texts)]
    docs += [(500, docs[1][1], "en", "s1"), (501, docs[1][1].replace(" ", " extra ", 1), "en", "s2")]
    docs += [(502, f"{docs[2][1]} start {passage} end {docs[3][1]}", "en", "s3"), (503, passage, "en", "s3"), (504, None, None, None), (505, "", "en", None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, None if d[1] is None else len(d[1]), "x") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 400) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, toxic, passage


def test_stages(spark, folder):
    path, docs, toxic, passage = folder
    now = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, path).collect(), stage(spark, now, path).schema)
        seen[name] = now.collect()
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert toxic - {0} & ids("toxicity") == set() or len(toxic & ids("toxicity")) <= 2
    assert ids("toxicity") >= {i for i in range(400) if i not in toxic} | {500, 501, 504, 505}
    # 500 and 501 repeat 1; 504 and 505 have no words and are one group
    assert ids("toxicity") - ids("near_duplicates") == {500, 501, 505}
    assert ids("near_duplicates") - ids("decontamination") == {503}
    assert not any(" ".join(normalised_words(passage)[i] .decode() for i in range(10)) in (r["text"] or "") for r in seen["decontamination"])
    before, after = ({r["doc_id"]: r for r in seen[n]} for n in ("near_duplicates", "decontamination"))
    assert all(after[i]["text"] == before[i]["text"] for i in after if i != 502)
    assert after[502]["text"] == before[502]["text"].replace(passage, "") and after[502]["n_chars"] == len(after[502]["text"])
    mixed = {(r["doc_id"], r["text"]) for r in seen["mixing"]}
    assert mixed <= {(i, r["text"]) for i, r in after.items()} and len(seen["mixing"]) > 0.7 * len(after)
    encoder = PieceEncoder(default_tokenizer())
    want = sorted((r["doc_id"], zlib.crc32(np.append(encoder.encode([r["text"]])[0], 2).astype("<u4").tobytes())) for r in seen["mixing"])
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in seen["token_ids"]) == want
    start = 0
    for r in sorted(seen["token_ids"], key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    for name in list(seen)[:3]:
        assert set(corpus_pipeline.COLUMNS) <= set(seen[name][0].asDict())
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, seen["token_ids"]))


def test_empty_tables(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_and_bare_tables(spark, folder, tmp_path):
    """Texts of a million words, of one word without an end, of one word repeated; labels and items that are empty."""
    path, *_ = folder
    rng = np.random.default_rng(9)
    words = np.array([f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "lmnrst"])
    docs = [(1, " ".join(rng.choice(words, 400_000)), "en", "s0", 1), (2, "x" * 1_000_000, "en", "s0", 1), (3, "same " * 300_000, "en", "s0", 1), (4, "a plain text", None, None, None)]
    docs += [(5, docs[0][1] + " end", "en", "s0", 1), (None, "no id", "en", "s0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet").select(corpus_pipeline.COLUMNS)
    left = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), now.schema)
        left.append(sorted((r["doc_id"] or 0, len(r["text"])) for r in now.collect()))
    sizes = sorted((d[0] or 0, len(d[1])) for d in docs)
    assert left[0] == sizes and left[1] == left[2] == [s for s in sizes if s[0] != 5]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {None, 1, 2, 3, 4}


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("__spark_entry__.py",):
        (tmp_path / name).symlink_to(os.path.join(root, name))
    (tmp_path / "obsframe").mkdir()
    for name in os.listdir(os.path.join(root, "obsframe")):
        if name not in ("llm", "__pycache__"):
            (tmp_path / "obsframe" / name).symlink_to(os.path.join(root, "obsframe", name))
    # an empty stand-in shadows nothing: the subpackage must simply be absent
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
