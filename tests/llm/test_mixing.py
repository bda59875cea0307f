import random

import numpy as np
import pytest

from plumbline.llm.mixing import mix, plan, report

TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id bigint, source string, tokens int"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS pass_no", "2.0 AS share").repartition(3)


def test_shares_repeats_and_reachability(spark):
    rng = random.Random(2)
    spellings = {"big": ["big"], "mid": ["Mid Source", "mid-source", "MID_SOURCE ", "mid_source"], "small": ["small"]}
    rows = [(i, rng.choice(spellings[s]), rng.randint(5, 60)) for i, s in enumerate(["big"] * 2000 + ["mid"] * 300 + ["small"] * 20)]
    rows += [(9001, None, 50), (9002, "other", 50), (9003, "big", 0), (9004, "big", 5000)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid_source", 0.3, 4), ("small", 0.1, 3), ("none", 0.1, 5), (None, 0.1, 1)], TARGETS)
    goals = {r["source"]: r for r in plan(docs(spark, rows), targets, capacity=1000).collect()}
    total = sum(t for _, _, t in rows if t <= 1000)
    assert goals["big"]["demand"] == pytest.approx(0.5 * total)
    assert {s: r["reachable"] for s, r in goals.items()} == {"big": True, "mid_source": True, "small": False, "none": False}
    out = mix(docs(spark, rows), targets, capacity=1000)
    got = out.collect()
    use = {}
    for r in got:
        use.setdefault(r["source"], []).append(r)
        assert 0 <= r["position"] < 1
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    for s in ("big", "mid_source"):
        assert goals[s]["demand"] <= sum(r["tokens"] for r in use[s]) < goals[s]["demand"] + 60
    assert sum(r["tokens"] for r in use["small"]) == 3 * goals["small"]["available"]
    for s, most in (("big", 1), ("mid_source", 4), ("small", 3)):
        times = {}
        for r in use[s]:
            times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert max(times.values()) <= most and max(times.values()) - min(times.values()) <= 1
    assert not {9001, 9002, 9003, 9004} & {r["doc_id"] for r in got}
    shares = {r["source"]: r for r in report(out, plan(docs(spark, rows), targets, capacity=1000)).collect()}
    assert sum(r["reached_share"] for r in shares.values()) == pytest.approx(1)
    assert shares["none"]["tokens"] == 0 and shares["none"]["passes"] == 0 and shares["small"]["passes"] == 3


@pytest.mark.parametrize("ramp", [-1.0, -0.3, 0.0, 0.8, 1.0])
def test_the_schedule_is_followed(spark, ramp):
    rows = [(i, "a" if i % 2 else "b", 10) for i in range(8000)]
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.5, 1)], TARGETS)
    every = mix(docs(spark, rows), targets, {"a": ramp}).toPandas()
    t = np.sort(every[every["source"] == "a"]["position"].to_numpy())
    # The mix is equally dense throughout.
    assert np.histogram(every["position"], bins=5, range=(0, 1))[0] == pytest.approx(len(every) / 5, rel=0.01)
    ramp = ramp - 0.25 * ramp / 0.75  # centred on the mean over both sources
    for at in (0.1, 0.3, 0.5, 0.9):
        expected = (1 - ramp) * at + ramp * at * at  # share of the source's tokens due by then
        assert np.searchsorted(t, at) / len(t) == pytest.approx(expected, abs=2e-3)


def test_buckets_and_partitions_do_not_matter(spark):
    rows = [(i % 500, "a", i % 7) for i in range(1000)]
    targets = spark.createDataFrame([("A", 1.0, 2), ("a", 0.5, 9)], TARGETS)
    one = mix(docs(spark, rows), targets, bucket_documents=10**9).toPandas()
    many = mix(docs(spark, rows).repartition(7), targets, bucket_documents=5).toPandas()
    assert len(one) == len(many) and one["tokens"].sum() == many["tokens"].sum()
    assert set(one["source"]) == {"A"}


def test_empty_and_bad(spark):
    targets = spark.createDataFrame([("a", 1.0, 0), ("b", 0.5, None)], TARGETS)
    assert mix(docs(spark, []), targets).count() == 0
    assert mix(docs(spark, [(1, "a", 5)]), targets).count() == 0
    assert [r["reached_share"] for r in report(mix(docs(spark, []), targets), plan(docs(spark, []), targets)).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="ramp"):
        mix(docs(spark, []), targets, {"a": 2.0})
