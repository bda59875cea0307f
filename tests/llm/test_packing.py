import random

import pytest

from plumbline.llm.packing import containers, pack, pieces


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, tokens int").selectExpr("*", "'x' AS shard", "1 AS size").repartition(3)


def check(spark, rows, capacity, **kw):
    packed = [r.asDict() for r in pack(table(spark, rows), capacity, **kw).collect()]
    want = [(d, t or 0) for d, t in rows]
    total = {}
    for r in packed:
        total.setdefault(r["container"], 0)
        total[r["container"]] += r["size"]
    assert all(v <= capacity for v in total.values())
    whole = sorted((d for d, t in rows if (t or 0) <= capacity), key=str)
    assert sorted((r["doc_id"] for r in packed if r["doc_id"] in set(whole)), key=str) == whole
    assert sum(r["size"] for r in packed) == sum(t for _, t in want)
    return packed, total


def test_every_item_fits_and_nothing_is_lost(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([rng.randint(1, 60), rng.randint(1, 400), rng.randint(200, 1000), rng.randint(900, 5000)])) for i in range(3000)]
    packed, total = check(spark, rows, 1000)
    used = sum(total.values()) / (1000 * len(total))
    assert used > 0.93
    for shard_items in (200, 1000):
        check(spark, rows, 1000, shard_items=shard_items)


def test_cutting(spark):
    out = {(r["doc_id"], r["piece"]): r["size"] for r in pieces(table(spark, [(1, 2500), (2, 1000), (3, 1001), (4, 0), (5, None)]), 1000).collect()}
    assert out == {(1, 0): 1000, (1, 1): 1000, (1, 2): 500, (2, 0): 1000, (3, 0): 1000, (3, 1): 1, (4, 0): 0, (5, 0): 0}


@pytest.mark.parametrize("size", [1, 250, 333, 500, 501, 1000])
def test_equal_items_fill_containers_by_count(spark, size):
    n = 60
    _, total = check(spark, [(i, size) for i in range(n)], 1000)
    assert len(total) == -(-n // (1000 // size))


def test_repeated_ids_empty_items_and_empty_table(spark):
    check(spark, [(7, 400)] * 9 + [(8, None), (8, 0), (None, 5), (None, 5)], 1000)
    assert pack(table(spark, []), 1000).count() == 0
    out = containers(pack(table(spark, [(1, 10)]), 1000), 1000).collect()
    assert [(r["pieces"], r["tokens"], r["unused"]) for r in out] == [(1, 10, 990)]
