from collections import Counter, defaultdict
from fractions import Fraction

from brute import crc

from spanloom.llm import mixing, sharding


def test_shards_hold_all_rows_gapless_and_near_equal(spark, odd, odd_rows):
    got = sharding.shard_documents(odd, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t, _ in odd_rows)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_bytes_are_even_where_documents_are_small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    load = Counter()
    for r in sharding.shard_documents(docs, 8).collect():
        load[r.shard] += r.size
    assert max(load.values()) < 1.05 * min(load.values())


def test_one_key_for_many_texts_is_spread(spark):
    docs = spark.createDataFrame([(7 if i % 3 else i, f"text {i}") for i in range(6000)], "doc_id long, text string")
    got = sharding.shard_documents(docs, 8).collect()
    load, rows = Counter(), Counter()
    for r in got:
        load[r.shard] += r.size
        rows[r.virtual_slot] += 1
    assert max(load.values()) < 1.01 * min(load.values()) and max(rows.values()) < 12


def test_map_versions(spark, tmp_path):
    size = [(i * 37) % 101 + 1 for i in range(256)]
    one = sharding.SlotMap.balanced(size, 8)
    two = one.grow(size)
    moved = [(a, b) for a, b in zip(one.current, two.current, strict=True) if a != b]
    assert moved and {b for _, b in moved} == {8}
    size[0] *= 30
    three = two.rebalance(size)
    assert sum(a != b for a, b in zip(two.current, three.current, strict=True)) < 60
    three.save(spark, f"file://{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"file://{tmp_path}/map").versions == three.versions


def test_empty(spark, empty):
    assert sharding.shard_documents(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_schedule_is_less_than_one_block_off():
    for shares in ([1, 2, 3, 4], [500, 499, 1], [7] * 10, [333, 333, 334]):
        done, period = [0] * len(shares), sum(shares)
        for t, (k, j) in enumerate(mixing.schedule(shares), 1):
            assert j == done[k]
            done[k] += 1
            assert all(abs(d - t * s / period) < 1 for d, s in zip(done, shares, strict=True))
        assert done == shares


def test_thousands_of_sources(spark):
    docs = spark.createDataFrame([(i, "x" * 9, f"s{i % 2500}") for i in range(5000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, block_bytes=10).collect()
    assert sorted(r.mix_slot for r in got) == list(range(5000)) and all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)


def test_phases_use_every_block_once():
    runs = mixing.phases([5, 40, 3, 1000], [Fraction(1), Fraction(2), Fraction(1, 3), Fraction(1)], 100)
    assert [sum(mixing._taken(r, r["live"].index(k)) for r in runs if k in r["live"]) for k in range(4)] == [5, 40, 3, 1000]


def test_mix_keeps_rows_and_order(spark, odd, odd_rows):
    got = mixing.mix(odd, {"hot": 0.5, "c": 0.25}, block_bytes=500, period=50).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(odd_rows)
    slots = defaultdict(set)
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        slots[r.mix_slot].add((r.source, r.mix_block))
    assert all(len(v) == 1 for v in slots.values())
    order = defaultdict(list)
    for r in sorted(got, key=lambda r: r.mix_slot):
        order[r.source].append(r.mix_block)
    assert all(v == sorted(v) for v in order.values())


def test_mix_keeps_the_given_weights_over_many_cycles(spark):
    docs = spark.createDataFrame([(i, "x" * 9, "abc"[i % 3]) for i in range(7200)], "doc_id long, text string, source string")
    for weights in (None, {"a": 1 / 3, "b": 0.6663, "c": 0.0004}, {"a": 2, "b": 4, "c": 1}):
        exact = {s: mixing.exact_weight((weights or dict.fromkeys("abc", 1))[s]) for s in "abc"}
        done = dict.fromkeys("abc", 0)
        got = mixing.mix(docs, weights, block_bytes=10).where("mix_phase = 0").orderBy("mix_slot").collect()
        assert len(got) > 1500
        for t, r in enumerate(got, 1):
            assert r.mix_slot == t - 1 and r.mix_block == done[r.source]
            done[r.source] += 1
            assert all(abs(done[s] - t * exact[s] / sum(exact.values())) < 1 for s in "abc")


def test_pieces_replay_the_schedule():
    shares = mixing.exact_shares([Fraction(1, 3), Fraction(1, 7), Fraction(11, 21), Fraction(1, 10**9)])
    plain = [x for x, _ in zip(mixing.deal(shares, [0] * 4), range(1000))]
    run = mixing.phases([10**4, 10**4, 500, 9], [Fraction(s) for s in shares], 100)[0]
    again = [x for at, end, dealt in run["pieces"] for x, _ in zip(mixing.deal(shares, dealt, at), range(end - at))]
    assert len(run["pieces"]) > 5 and run["length"] == 0 and again == plain[: run["slots"]]
