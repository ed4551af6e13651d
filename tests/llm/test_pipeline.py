"""The pipeline stage by stage against brute force on a small table."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lorequery.llm import secret_scan, simhash
from tests.llm.test_operators import _components, _fingerprint


def test_pipeline(spark, tmp_path):
    r = np.random.default_rng(4)
    parts = {"en": ["the", "tion", "er", "an", "ing", "ou"], "fr": ["les", "é", "eux", "ou", "ai", "ré"]}
    rows = []
    for i in range(240):
        lang = "fr" if i % 5 == 0 else "en"
        text = " ".join("".join(r.choice(parts[lang], r.integers(1, 4))) for _ in range(60))
        if i % 6 == 0:
            text += f" {['moron', 'scum', 'idiot'][i % 3]} again."
        if i % 10 == 1:
            text += f' token = "{"".join(r.choice(list("0123456789abcdef"), 40))}"'
        rows.append((i, text, lang, "s", len(text)))
    rows += [(300 + i, rows[1][1], "en", "s", 1) for i in range(20)] + [(400, None, "en", "s", None), (401, "12345 ###", None, "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        ids[name] = {x.doc_id: x.text for x in docs.collect()}
    clean = {i for i in range(240) if i % 6}
    assert len(clean - set(ids["toxicity"])) <= 4 and len(set(ids["toxicity"]) & {i for i in range(240) if i % 6 == 0}) <= 4
    assert set(ids["toxicity"]) - set(ids["language_id"]) == {400, 401}
    before = sorted(ids["language_id"].items())
    roots = _components([i for i, _ in before], [_fingerprint(t) for _, t in before])
    assert set(ids["near_dedup"]) == set(roots) and docs.select("doc_id").distinct().count() == docs.count()
    assert set(ids["secret_scan"]) == set(ids["near_dedup"]) and not any(secret_scan.base_spans(t) for t in ids["secret_scan"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {x.doc_id for x in packed.select("doc_id").collect()} == set(ids["secret_scan"])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
    assert simhash.RADIUS == 3
