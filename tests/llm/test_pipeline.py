"""The pipeline's stages, each held against a brute-force version on its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from fjordlake.llm import bpe_codec, toxicity

from .test_operators import WORDS, contamination_brute, corpus, near_brute, substring_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(9)
    rows = [(k, t) for k, t in enumerate(corpus(5, 60))]
    for k in range(len(rows), 300):
        w = [r.choice(WORDS) for _ in range(r.randint(20, 90))]
        if k % 4 == 0:
            w[5] = w[9] = "vile"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 0, int("vile" in (t or ""))) for k, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, rows[100][1]), (2, rows[101][1])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        rows = [(k, r.text) for k, r in sorted(before.items())]
        if name == "toxicity":
            wrong = [k for k, t in rows if (k not in after) != ("vile" in (t or ""))]
            assert len(wrong) < 0.05 * len(rows)
        elif name == "near_dedup":
            assert set(after) == {k for k, _, _, kept in near_brute(rows) if kept}
        elif name == "substring_dedup":
            want = {x[0]: x[4] if x[2] else before[x[0]].text for x in substring_brute(rows)}
            assert {k: r.text for k, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            gone = {i for i, _, _, _, bad in contamination_brute(rows, items) if bad}
            assert gone and set(after) == set(before) - gone
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(after[k].lang == before[k].lang for k in after)
        else:
            assert set(after) == set(before) and all(r.restored and r.n_tokens == len(r.ids) for r in after.values())
            lib = Tokenizer.from_file(bpe_codec.tokenizer_path())
            assert all(after[k].ids == lib.encode(t or "", add_special_tokens=False).ids for k, t in rows)


def test_stages_on_odd_rows(spark, folder):
    """Null and equal ids, null, empty and repeated texts; and empty tables."""
    p = " ".join(WORDS[:70])
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    rows = [(1, p), (5, " ".join(WORDS[100:160]) + " " + p), (5, "short text here"), (5, None), (6, p), (6, p), (7, ""), (None, p), (None, None), (8, bench[0].text), (8, "clean"), (None, bench[0].text), (9, p + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, mark string")
    got = {}
    for name, stage in pipeline.STAGES:
        if name != "near_dedup":
            assert stage(spark, docs.limit(0), folder).count() == 0
        got[name] = stage(spark, docs, folder)
        if name != pipeline.STAGES[-1][0]:
            assert got[name].columns == docs.columns
    texts = lambda name: Counter((r.doc_id, r.text) for r in got[name].collect())
    assert texts("toxicity") == Counter(rows)
    group = {k: first for k, _, first, _ in near_brute([(k, t) for k, (_, t) in enumerate(rows)])}
    least = {g: min((rows[k][0] for k in group if group[k] == g and rows[k][0] is not None), default=None) for g in set(group.values())}
    assert texts("near_dedup") == Counter(r for k, r in enumerate(rows) if r[0] is None or r[0] == least[group[k]])
    assert texts("substring_dedup") == Counter((i, x[4] if x[2] else t) for (i, t), x in zip(rows, substring_brute(rows), strict=True))
    bad = contamination_brute(rows, [tuple(r) for r in bench])
    assert texts("decontaminate") == Counter(r for r, x in zip(rows, bad, strict=True) if r[0] is None or not x[4])
    assert (8, "clean") in texts("decontaminate") and (8, bench[0].text) not in texts("decontaminate")
    assert Counter(r.doc_id for r in got["bpe_codec"].collect()) == Counter(i for i, _ in rows)


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert Counter(out.columns) == Counter(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "restored", "ids"])
    assert 100 < out.count() < 300 and out.select(F.countDistinct("doc_id")).first()[0] == out.count()
    assert toxicity.THRESHOLD == 0.3
