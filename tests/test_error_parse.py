import itertools

import pytest

from plumbline.operators.error_parse import cheapest_parse, cut, headers, parse_issues, shape_of

TYPES = [("duplicate_rows", "warning"), ("empty_dataset", "error")]
HEAD = "dataset_id,issue_id,severity,message,affected_rows,affected_fraction"


def well_formed(shape, fields):
    """Independent check: split at delimiters outside quotes, then look at each field."""
    parts, quoted, part = [], False, ""
    for c in shape:
        if c == "q":
            quoted = not quoted
        if c == "d" and not quoted:
            parts.append(part)
            part = ""
        else:
            part += c
    parts.append(part)
    if quoted or len(parts) != fields:
        return False
    for p in parts:
        p = p.strip("b")
        if "q" not in p:
            continue
        if len(p) < 2 or p[0] != "q" or p[-1] != "q" or "q" in p[1:-1].replace("qq", ""):
            return False
    return True


@pytest.mark.parametrize("fields", [1, 2, 3])
def test_cost_zero_is_well_formed(fields):
    for n in range(6):
        for shape in map("".join, itertools.product("qdx", repeat=n)):
            if "xx" in shape:
                continue
            assert (cheapest_parse(shape, fields)[0] == 0) == well_formed(shape, fields), (shape, fields)


def edited(shape):
    for i in range(len(shape)):
        if shape[i] in "qd":
            yield shape[:i] + shape[i + 1 :]
    for i in range(len(shape) + 1):
        for c in "qd":
            yield shape[:i] + c + shape[i:]


def brute_cost(shape, fields, most):
    layer = {shape}
    for cost in range(most + 1):
        if any(well_formed(s, fields) for s in layer):
            return cost
        layer = {t for s in layer for t in edited(s)}
    return most + 1


@pytest.mark.parametrize("shape", ["xqx", "qxdx", "xdxdx", "", "qxqxdx", "xdqxdx", "qqq", "dq", "xdxqdx"])
@pytest.mark.parametrize("fields", [1, 2, 3])
def test_cost_is_the_least_number_of_edits(shape, fields):
    cost, edits = cheapest_parse(shape, fields)
    assert len(edits) == cost
    assert min(cost, 3) == brute_cost(shape, fields, 2)


def test_shape_and_fields():
    assert shape_of('a b,"c ""d"""', ",")[0] == "xbxdqxbqqxqqq"
    assert cut('1, "a ""b"", c" ,', ",") == ["1", 'a "b", c', ""]


def lines(*texts, file_id=1, head=HEAD):
    rows = [(file_id * 1000, file_id, 1, head)] if head is not None else []
    return rows + [(file_id * 1000 + i + 1, file_id, i + 2, t) for i, t in enumerate(texts)]


def parsed(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "line_id bigint, file_id bigint, line_no int, line_text string")
    if extra:
        df = df.selectExpr("*", "'mine' AS reason", "7 AS note", "1 AS cost")
    types = spark.createDataFrame(TYPES, "issue_id string, default_severity string")
    return {r["line_id"]: r for r in parse_issues(df, types).collect()}


def test_reasons(spark):
    good = "12,duplicate_rows,warning,text,5,0.5"
    bad = {
        "x,duplicate_rows,warning,t,5,0.5": "dataset_id",
        "1,unknown,warning,t,5,0.5": "issue_id",
        "1,duplicate_rows,Warning,t,5,0.5": "severity",
        "1,duplicate_rows,warning,t,5.0,0.5": "affected_rows",
        "1,duplicate_rows,warning,t,5,1.5": "affected_fraction",
        "1,duplicate_rows,warning,t,5,-0.1": "affected_fraction",
        "1,duplicate_rows,warning,t,5": "insert delimiter",
        "1,duplicate_rows,warning,t,5,0.5,9": "delete delimiter",
        '1,duplicate_rows,warning,"t,5,0.5': "quote",
        '1,duplicate_rows,warning,t "x" y,5,0.5': "quote",
        "": "insert delimiter",
    }
    out = parsed(spark, lines(good, good, ' 1 ,duplicate_rows,warning, "a, ""b""" , ,1e-3', *bad))
    assert out[1001]["valid"] and out[1002]["valid"] and out[1001]["affected_rows"] == 5
    assert out[1003]["valid"] and out[1003]["affected_rows"] is None and out[1003]["affected_fraction"] == 1e-3
    for i, (text, why) in enumerate(bad.items()):
        r = out[1004 + i]
        assert not r["valid"] and why in r["reason"], (text, r["reason"])
        assert r["dataset_id"] is None


def test_headers_of_every_kind(spark):
    rows = lines("1|duplicate_rows|info|2", file_id=1, head='﻿"dataset_id"|"issue_id"|severity|affected_rows')
    rows += lines("1;duplicate_rows;info", file_id=2, head="dataset_id;issue_id;severity")
    rows += lines("1\tduplicate_rows\tinfo", file_id=3, head="dataset_id\tissue_id\tseverity")
    rows += lines("1,duplicate_rows", file_id=4, head="dataset_id,issue_id")
    rows += lines("1,duplicate_rows,info", file_id=5, head=None)
    rows += [(9001, None, 2, "1,duplicate_rows,info"), (9002, 1, 3, None), (9003, 1, None, "x")]
    out = parsed(spark, rows)
    assert out[1001]["valid"] and out[2001]["valid"] and out[3001]["valid"]
    assert out[4001]["reason"] == "header has no severity"
    assert out[5001]["reason"] == out[9001]["reason"] == "no header"
    assert out[9002]["reason"] == "no text"
    assert out[9003]["reason"] == "no line number" and not out[9003]["valid"]


def test_long_whole_numbers(spark):
    head = "dataset_id,issue_id,severity,affected_rows"
    out = parsed(spark, lines("1234567890123456789012345,duplicate_rows,info,98765432109876543210", f"1,duplicate_rows,info,{'9' * 39}", "007,duplicate_rows,info,", head=head))
    assert out[1001]["valid"] and str(out[1001]["dataset_id"]) == "1234567890123456789012345" and str(out[1001]["affected_rows"]) == "98765432109876543210"
    assert out[1002]["reason"] == "affected_rows is beyond 38 digits"
    assert out[1003]["valid"] and out[1003]["dataset_id"] == 7 and out[1003]["affected_rows"] is None


def test_clashing_columns_long_lines_and_empty_tables(spark):
    long = "1,duplicate_rows,warning," + "y" * 200_000 + ",5,0.5"
    out = parsed(spark, lines(long, "1,duplicate_rows,warning," + '"' * 3001), extra=True)
    assert out[1001]["valid"] and not out[1002]["valid"] and out[1001]["note"] == 7
    empty = spark.createDataFrame([], "line_id bigint, file_id bigint, line_no int, line_text string")
    types = spark.createDataFrame(TYPES, "issue_id string, default_severity string")
    assert parse_issues(empty, types).count() == 0
    assert headers(empty).count() == 0
