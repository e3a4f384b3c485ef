import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import mixing, sharding, staging, toxicity


def _marked(rng, n, toxic):
    from conftest import sentence

    words = sentence(rng, n).split()
    for _ in range(4 if toxic else 0):
        words[rng.randrange(n)] = rng.choice(["rotten", "vileness", "hateful"])
    return " ".join(words)


def test_held_out_accuracy(spark):
    import random
    import sys

    sys.path.insert(0, "tests/llm")
    rng = random.Random(2)
    rows = [(i, _marked(rng, 60, i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    truth = {i: y for i, _, y in rows}
    got = toxicity.score_documents(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert 80 < len(held) < 160
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_thresholds_decide():
    import numpy as np

    gains = [np.array(g) for g in ([0, 0, 3, 0], [0, 4, 0, 5], [0, 0, 0, 0], [1, 0, 1, 0], [0, 0, 0, 1], [0, 1, 0, 0])]
    labels = np.array([1, 1, 0, 0, 0, 0])
    threshold, limit = toxicity.calibrated(gains, labels)
    called = [toxicity.evidence(g, threshold) >= limit for g in gains]
    assert called == [True, True, False, False, False, False]
    model = toxicity.Model(b"plain words and more", b" rotten vileness ", threshold, limit)
    for text in (b"plain words", b"rotten vileness in rotten words", b""):
        found = toxicity.evidence(model.gains(text), threshold)
        assert (model.score(text) >= 0.5) == (found >= limit)


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100, 140)] + [(None, 1), (101, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(empty, labels).count() == 0


@pytest.mark.parametrize("table", ["documents", "odd", "empty"])
def test_pipeline_stages(spark, sf_dir, odd, empty, table):
    docs = {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet"), "odd": odd, "empty": empty}[table]
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staging.stage(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        assert out.count() <= n and (name != "mixing" or out.count() == docs.count())
        docs, n = out, out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == n


def test_different_texts_under_one_id_stay(spark, sf_dir):
    text = lambda word: " ".join(f"{word}{i}" for i in range(80))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (5, text("b")), (5, text("c")), (7, text("c") + " end"), (None, text("a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(3, text("a")), (5, text("b")), (5, text("c")), (0, text("a"))])


@pytest.mark.parametrize("piece", [7, sharding.PIECE])
def test_shards_follow_the_mixture(spark, sf_dir, piece):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    due = {r.doc_id: (r.mix_slot, r.mix_hash) for r in mixing.mix(docs).select("doc_id", "mix_slot", "mix_hash").collect()}
    mixed = staging.stage(corpus_pipeline.mix_sources(spark, docs, sf_dir), "mixing")
    assert len(mixed.inputFiles()) > 1
    plain = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}
    found = corpus_pipeline.shard(spark, mixed, sf_dir) if piece == sharding.PIECE else sharding.shard_documents(mixed, ordered=True, piece=piece)
    shards = [sorted((r.slot, r.doc_id) for r in found.collect() if r.shard == k) for k in range(8)]
    assert sum(map(len, shards)) == len(due) == docs.count()
    for k, rows in enumerate(shards):
        assert [slot for slot, _ in rows] == list(range(len(rows)))
        assert [i for _, i in rows] == sorted((i for _, i in rows), key=due.__getitem__)
        assert all(plain[i] == k for _, i in rows)


def test_order_of_rows_that_no_file_holds(spark, odd, odd_rows):
    rows = [(i, f"text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "doc_id").sortWithinPartitions(F.desc("doc_id"))
    due = [r.doc_id for r in docs.collect()]
    got = sharding.shard_documents(docs, ordered=True).collect()
    for k in range(8):
        ids = [r.doc_id for r in sorted((r for r in got if r.shard == k), key=lambda r: r.slot)]
        assert ids == [i for i in due if i in set(ids)]
    got = sharding.shard_documents(odd, ordered=True).collect()
    assert len(got) == len(odd_rows)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))
