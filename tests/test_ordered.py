import random

from pyspark.sql import functions as F

from plumbline.operators.ordered import longest_run, with_position, with_previous, with_running_sum


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, o bigint, v double, on boolean").repartition(5)


def test_blocks_equal_whole_windows(spark):
    rng = random.Random(1)
    rows = []
    for k, n in (("a", 137), ("b", 1), ("c", 64)):
        order = sorted(rng.sample(range(1000), n))
        rows += [(k, o, rng.choice([None, rng.random()]), rng.choice([True, True, False, None])) for o in order]
    df = frame(spark, rows + [(None, 1, 1.0, True), ("a", None, 1.0, True)])
    for block in (1, 7, 50, 10_000):
        prev = {(r["k"], r["o"]): (r["prev_v"], r["prev_o"]) for r in with_previous(df, ["k"], "o", ["v", "o"], block_rows=block).collect()}
        sums = {(r["k"], r["o"]): r["s"] for r in with_running_sum(df, ["k"], "o", {"s": F.coalesce("v", F.lit(0.0))}, block_rows=block).collect()}
        pos = {(r["k"], r["o"]): r["pos"] for r in with_position(df, ["k"], "o", block_rows=block).collect()}
        runs = {r["k"]: r["run"] for r in longest_run(df, ["k"], "o", {"run": F.col("on")}, block_rows=block).collect()}
        assert len(prev) == len(sums) == len(pos) == len(rows) + 2 and prev[None, 1] == (None, None) and pos['a', None] is None and sums[None, 1] is None
        for k in "abc":
            mine = [r for r in rows if r[0] == k]
            total, best, run = 0.0, 0, 0
            for i, (_, o, v, on) in enumerate(mine):
                total += v or 0.0
                run = run + 1 if on else 0
                best = max(best, run)
                assert prev[k, o] == ((mine[i - 1][2], mine[i - 1][1]) if i else (None, None))
                assert abs(sums[k, o] - total) < 1e-9 and pos[k, o] == i
            assert runs[k] == best
