"""Pfair mixing against its definition."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from measureframe.llm import mixing
from measureframe.llm.mixing import mix, phases, schedule


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 1, "c": 2}, {f"s{i}": 1 + i % 7 for i in range(20)}])
def test_no_source_is_a_whole_block_off(weights):
    slots, total = schedule(weights), sum(weights.values())
    assert len(slots) == total
    done = Counter()
    for now, (s, j) in enumerate(slots, 1):
        assert j == done[s]
        done[s] += 1
        for x, w in weights.items():
            assert abs(done[x] - Fraction(now * w, total)) < 1
    assert done == weights


def test_weights_have_to_be_positive_integers():
    with pytest.raises(ValueError):
        mixing.reduced({"a": 0})


def test_phases_use_up_every_block():
    blocks, weights = {"a": 10, "b": 1, "c": 3}, {"a": 2, "b": 1, "c": 1}
    parts = phases(blocks, weights)
    assert parts[0] == (0, {"a": 0, "b": 0, "c": 0}, {"a": 2, "b": 1, "c": 1}, 1)
    assert parts[-1][2] == {"a": 1}


def table(spark, rng, n=300):
    rows = [(i, rng.choice(["big"] * 6 + ["b", "c", "rare", None]), "x", 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, stream string, slot int")


WEIGHTS = {"big": 3, "b": 2, "c": 1}


@pytest.mark.parametrize("shard", [20_000, 7])
def test_mix_is_whole_and_holds_the_shares(spark, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD_ROWS", shard)
    rows, df = table(spark, random.Random(1))
    got = mix(df, WEIGHTS, block_docs=4).collect()
    assert sorted((r.row.doc_id, r.row.source or "") for r in got) == sorted((i, s or "") for i, s, _, _ in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.stream == (r.row.source if r.row.source in WEIGHTS else "*") and r.epoch == 0
        slots[r.slot].append(r)
    for block in slots.values():
        assert len({(r.stream, r.block) for r in block}) == 1 and sorted(r.place for r in block) == list(range(len(block))) and len(block) <= 4
    order = [slots[k][0].stream for k in sorted(slots)]
    assert [slots[k][0].block for k in sorted(slots) if slots[k][0].stream == "big"] == list(range(order.count("big")))
    # Until the first source runs out, each is within a block of its share.
    total, done, left = 7, Counter(), Counter(order)
    for now, s in enumerate(order, 1):
        done[s] += 1
        for x, w in (WEIGHTS | {"*": 1}).items():
            assert abs(done[x] - Fraction(now * w, total)) < 1
        if done[s] == left[s]:
            break


def test_mix_with_repeats_holds_the_shares_to_the_end(spark):
    rows, df = table(spark, random.Random(2))
    got = mix(df, WEIGHTS, block_docs=4, repeat=True).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.slot].append(r)
    order = [slots[k][0].stream for k in sorted(slots)]
    assert sorted(slots) == list(range(len(order))) and len(order) % 7 == 0
    assert Counter(order) == {s: w * len(order) // 7 for s, w in (WEIGHTS | {"*": 1}).items()}
    assert {r.row.doc_id for r in got} == {r[0] for r in rows}
    for stream in set(order):
        turns = [(slots[k][0].epoch, slots[k][0].block) for k in sorted(slots) if slots[k][0].stream == stream]
        assert turns == sorted(turns) and turns[0] == (0, 0)
    assert max(Counter((r.row.doc_id, r.epoch) for r in got).values()) == 1


def test_mix_of_rows_that_repeat_one_source_and_nothing(spark):
    rows = [(1, None), (1, None), (None, "z")]
    assert mix(spark.createDataFrame(rows, "doc_id bigint, source string"), {}, block_docs=2).count() == 3
    for repeat in (False, True):
        assert mix(spark.createDataFrame([], "doc_id bigint, source string"), WEIGHTS, repeat=repeat).count() == 0


def brute_slots(blocks, weights):
    """Slot by slot: among released blocks the nearest deadline, then the name; period by period, until all blocks are dealt."""
    out, gone, now = {}, dict.fromkeys(blocks, 0), 0
    while left := [s for s in blocks if gone[s] < blocks[s]]:
        own = mixing.reduced({s: weights[s] for s in left})
        total = sum(own.values())
        while all(gone[s] < blocks[s] for s in left):
            nth = dict.fromkeys(left, 0)
            for slot in range(total):
                ready = [s for s in left if nth[s] < own[s] and Fraction(nth[s] * total, own[s]) < slot + 1]
                s = min(ready, key=lambda s: (-(-(nth[s] + 1) * total // own[s]), s))
                if gone[s] + nth[s] < blocks[s]:
                    out[s, gone[s] + nth[s]] = now + slot
                nth[s] += 1
            now += total
            for s in left:
                gone[s] += own[s]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mix_against_slot_by_slot_scheduling(spark, seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 5) for i in range(6)}
    rows = [(i, rng.choice([*weights, "s0", "s0", None])) for i in range(250)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, source string"), weights, block_docs=3).collect()
    sizes = Counter(s or "*" for _, s in rows)
    want = brute_slots({s: -(-n // 3) for s, n in sizes.items()}, mixing.reduced({"*": 1} | weights))
    assert {(r.stream, r.block): r.slot for r in got} == want


def test_two_thousand_sources_of_different_lengths(spark):
    import time

    from pyspark.sql import functions as F

    weights = {f"s{i}": 1 + i % 3 for i in range(2000)}
    df = spark.range(2000).select(F.explode(F.sequence(F.lit(0), (F.col("id") / 20).cast("int"))).alias("k"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    df = df.select(F.monotonically_increasing_id().alias("doc_id"), "source")
    start = time.monotonic()
    rows = mix(df, weights, block_docs=2).select("row.source", "slot", "place").collect()
    assert time.monotonic() - start < 60
    assert len(rows) == df.count() and len({(r.slot, r.place) for r in rows}) == len(rows)


def test_repeats_call_python_once_a_task(spark):
    """Every Python function in a stage has workers of its own, which stay with what they hold."""
    _, df = table(spark, random.Random(2))
    plan = mix(df, WEIGHTS, block_docs=4, repeat=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan
