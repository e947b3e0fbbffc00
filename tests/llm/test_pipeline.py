"""The pipeline stages, each on its own input, and all together."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import corpus

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key string"


def test_stages(spark, tmp_path):
    texts = corpus()
    rows = [(d, t, "en", "s", len(t or ""), "k") for d, t in texts] + [(None, None, None, None, None, None), (30, dict(texts)[30], "en", "s", 1, "k")]
    docs = spark.createDataFrame(rows, COLUMNS)
    bench = spark.createDataFrame([(1, dict(texts)[60])], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    sf = str(tmp_path)

    good = stages["quality_rules"](spark, docs, sf)
    assert good.columns == docs.columns and 10 in {r.doc_id for r in good.collect()} and 3 not in {r.doc_id for r in good.collect()}

    deduped = stages["near_dedup"](spark, docs, sf).collect()
    near = brute.near(texts)
    assert sorted(r.doc_id for r in deduped if r.doc_id is not None) == sorted(d for d, (_, c) in near.items() if c == d)

    left = stages["decontaminate"](spark, docs, sf)
    assert left.columns == docs.columns and {d for d, _ in texts} - {r.doc_id for r in left.collect()} == {60}

    masked = {r.doc_id: r for r in stages["secret_scan"](spark, docs, sf).collect()}
    assert masked[90].n_chars == len(masked[90].text) and "<secret>" in masked[90].text
    assert masked[10].text == dict(texts)[10] and masked[0].text is None

    assert stages["encode"](spark, docs, sf).count() == len(rows)


def test_run(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], COLUMNS.rsplit(",", 1)[0]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, dict(texts)[60])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 10 in got and not got & {0, 1, 2, 3, 30, 60}
    left = brute.near([(d, t) for d, t in texts if d in got])
    assert all(c == d for d, (_, c) in left.items())


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS.rsplit(",", 1)[0]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
