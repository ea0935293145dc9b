import numpy as np

import corpus_pipeline as pipeline
from stratum.llm import mixing
from stratum.llm.common import written

from .common import SF, empty, odd
from .test_near_duplicates import brute
from .test_tokens import PATH


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    now = docs
    for name, stage in pipeline.STAGES:
        before = now
        now = written(stage(spark, before, SF), name)
        seen[name] = (before.collect(), now.collect())
        if name != "packing":
            assert now.columns == docs.columns
    before, after = seen["quality"]
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert np.mean([(d.doc_id in kept) == truth[d.doc_id] for d in before if d.doc_id in truth]) > 0.9
    before, after = seen["near_duplicates"]
    assert {str(r.doc_id) for r in after} == {i for i, _, c in brute(before, 5, 80) if i == c}
    before, after = seen["secrets"]
    assert len(before) == len(after) and not any("token = \"" in r.text and "[SECRET]" not in r.text for r in after)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["mixing"]
    rows = spark.createDataFrame(before)
    want = {r.doc_id: r.copies for r in mixing.copies(rows).collect() if r.copies}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    before, after = seen["packing"]
    from stratum.llm.tokens import encoder
    import pyarrow as pa

    _, at = encoder(PATH).encode(pa.array([r.text for r in before]))
    assert sum(p.length for p in after) == at[-1]
    assert len(seen["packing"][1]) == pipeline.run(spark, SF).count()


def test_odd_tables(spark):
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd(spark), SF)
        assert out.count() > 0
        assert stage(spark, empty(spark), SF).count() == 0
        if name != "packing":
            assert out.columns == odd(spark).columns
    rows = [r.doc_id for r in pipeline.near_duplicate_stage(spark, odd(spark), SF).collect()]
    assert sorted(rows, key=str) == [1, 3, 4, 5, 6, 7, 8, 9, None]
