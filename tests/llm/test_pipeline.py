from __future__ import annotations

import brute
import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, docs, texts, tmp_path):
    """Every stage against plain versions of what it does to the documents that the one before kept."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in now.collect()]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        got = [tuple(r) for r in now.select("doc_id", *(["text"] if "text" in now.columns else ["length"])).collect()]
        if name == "language_id":
            assert sorted(got, key=repr) == sorted((r for r in rows if any(c.isalpha() for c in r[1] or "")), key=repr)
        elif name == "near_dedup":
            keys = sorted(set(kept), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
            plain = brute.near([(i, t) for i, (_, t) in enumerate(keys)], 5)
            assert sorted(got, key=repr) == sorted((keys[i] for i, _, root, _ in plain if root == i), key=repr)
        elif name == "substring_dedup":
            want = brute.phrases(kept)
            assert sorted((i, brute.sha(t.encode())) for i, t in got if i is not None) == sorted((w[0], w[3]) for w in want if w[0] is not None)
        else:
            assert sum(n for _, n in got) == sum(len(t.encode().split()) + bool(t.split()) for _, t in kept)
        kept = got


def test_run(spark, docs, none, tmp_path):
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    none.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert out.where(F.col("bin_id").isNotNull()).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
