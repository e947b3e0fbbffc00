"""Completeness over a stream, with restarts, late and repeated patches and a replayed batch."""

from __future__ import annotations

import shutil

from mapfold.streaming import ingest

SCHEMA = "map_id long, patch_row int, patch_col int"


def test_two_triggers_a_restart_and_a_replay(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    expected = spark.createDataFrame([(1, 4), (2, 2), (3, 1)], "map_id long, expected long")

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.count_patches(ingest.patch_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), out, state)
        return {r.map_id: (r.patches, r.complete) for r in ingest.complete_maps(spark, out, expected).collect()}

    assert arrive([(1, 0, 0), (1, 0, 256), (2, 0, 0)]) == {1: (2, False), 2: (1, False), 3: (0, False)}
    assert arrive([(1, 0, 0), (1, 256, 0)]) == {1: (3, False), 2: (1, False), 3: (0, False)}  # one again, one new
    before = arrive([(2, 256, 0), (1, 256, 256), (1, 256, 256)])
    assert before == {1: (4, True), 2: (2, True), 3: (0, False)}
    # the last batch is run once more, as after a loss before it was told to be done
    last = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    shutil.rmtree(f"{out}/batch={last.name}")
    for crc in (tmp_path / "state" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    ingest.count_patches(ingest.patch_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), out, state)
    assert {r.map_id: (r.patches, r.complete) for r in ingest.complete_maps(spark, out, expected).collect()} == before
    batch = ingest.completeness(spark.read.parquet(source)).collect()
    assert {r.map_id: r.patches for r in batch} == {1: 4, 2: 2}
