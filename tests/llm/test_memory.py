import subprocess
import sys

import pyarrow as pa

import corpus_pipeline
from spanloom.llm import decontaminate, mixing

WORKER = """
import random, re, types
import numpy as np, pyarrow as pa
from spanloom.llm import minhash

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

docs = types.SimpleNamespace(mapInArrow=lambda run, schema: run)
rng = random.Random(4)
batch = pa.record_batch([pa.array(range(4000)), pa.array([" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(4000)])], names=["doc", "text"])
for run in (minhash.signatures(docs), minhash.fingerprints(docs)):
    rows = sum(x.num_rows for x in run(iter([batch.slice(0, 10)])))
    before = mb()
    rows = sum(x.num_rows for x in run(iter([batch])))
    assert rows == 4000
    print(mb() - before)
"""


def test_a_worker_that_is_done_keeps_no_working_memory():
    """Idle workers of near_duplicates stood at 250 MB each while mixing sorted texts beside them."""
    out = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, timeout=300)
    grown = [float(x) for x in out.stdout.split()]
    assert len(grown) == 2 and max(grown) < 20, grown


def test_no_chunk_is_held_while_the_next_is_worked_on(spark, monkeypatch):
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    made = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run))
    decontaminate.clean_documents(docs, items)
    gone, alive = [], []

    class Held(decontaminate.Words):
        def __init__(self, *args, **more):
            alive.append(len(gone))
            super().__init__(*args, **more)

        def __del__(self):
            gone.append(1)

    monkeypatch.setattr(decontaminate, "Words", Held)
    batch = pa.record_batch([pa.array(range(3)), pa.array(["x one two three y", "one two", None])], names=["doc_id", "text"])
    got = [x.to_pylist() for x in made[0](iter([batch] * 4))]
    assert got == [[{"doc_id": 1, "text": "one two"}, {"doc_id": 2, "text": None}]] * 4
    assert alive == [0, 1, 2, 3]


def test_mixing_goes_through_the_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, -1)  # as where the sums are many
    try:
        plan = corpus_pipeline.mix_sources(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, held)
    assert "rangepartitioning" not in plan  # its ranges come from a run of all that stands below
    by_bucket = [line for line in plan.splitlines() if "- Sort [" in line and "__mix_bucket" in line]
    assert len(by_bucket) == 3  # of texts for the window, and of sums for theirs and for the join


def test_files_of_the_mixture_hold_runs_of_slots(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    due = {r.doc_id: (r.mix_slot, r.mix_hash) for r in mixing.mix(docs).select("doc_id", "mix_slot", "mix_hash").collect()}
    parts = corpus_pipeline.mix_sources(spark, docs, sf_dir).select("doc_id").rdd.glom().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and all(parts)
    places = [due[r.doc_id] for rows in parts for r in rows]
    assert places == sorted(places) and len(places) == len(due)
    slots = [{due[r.doc_id][0] for r in rows} for rows in parts]
    assert all(max(a) < min(b) for a, b in zip(slots, slots[1:]))
