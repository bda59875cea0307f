import importlib.util
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

COMPARED = ("p1_found", "p1_loaded", "p1_reasons", "p3_found", "p3_values", "p5_channels", "p5_converted", "imu_psd", "imu_allan_deviation", "csv_import", "generic_linearity", "generic_hysteresis", "imu_saturation", "imu_sampling_integrity", "dataset_validator", "calibration_evaluation")


def plain(v):
    return None if v is None else ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


def compare(spark, tables, name):
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{tables}/{f}'")
    df = entry.queries()[name](spark, tables)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_catalogue():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for n in (1, 2, 3, 5):
        assert f"p{n}_found" in queries
    if importlib.util.find_spec("plumbline.llm"):
        for n in (4, 6, 7, 8):
            assert f"p{n}_found" in queries


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, tables, name):
    compare(spark, tables, name)


def test_result_columns(spark, tables):
    want = {"p1_found": ["line_id"], "p2_found": ["row_id", "field_name"], "p3_found": ["dataset_id", "slot_no"], "p5_found": ["dataset_id", "field_name"]}
    for name, cols in want.items():
        assert entry.queries()[name](spark, tables).columns == cols


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = entry.entry(spark)
    assert {r["status"] for r in df.select("status").distinct().collect()} <= {"pass", "fail", "not_evaluated"}
