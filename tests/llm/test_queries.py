import re
import unicodedata

import pytest

import __spark_entry__ as entry
from plumbline.llm.text_types import FUNCTIONS
from tests.test_entry import compare


@pytest.mark.parametrize("name", ["p4_found", "p4_rank_error", "p6_invariants", "p7_invariants", "p8_statistics"])
def test_against_sql(spark, tables, name):
    compare(spark, tables, name)


@pytest.mark.parametrize(("name", "columns"), [("p4_found", ["sensor_id", "revision"]), ("p6_found", ["doc_id"]), ("p7_found", ["source"]), ("p8_found", ["doc_id"])])
def test_result_columns(spark, tables, name, columns):
    assert entry.queries()[name](spark, tables).columns == columns


def test_every_text_has_its_share_of_finished_lines(spark, tables):
    """Against brute force: RE2 has no line splitting like this one."""
    rows = {r["doc_id"]: r for r in entry.queries()["p8_types"](spark, tables).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        if text is None:
            assert rows[doc]["terminal_share"] is None
            continue
        plain = re.sub(r"<[a-zA-Z/][^<>]{0,80}>", " ", re.sub(r"(?i)<br\s*/?>|</p>|</li>", "\n", text))
        lines = [x.strip(" ") for x in re.split(r"\r\n|[\n\v\f\r\x85\u2028\u2029]", plain)]
        lines = [x for x in lines if x]
        done = [x for x in lines if ends(x)]
        assert rows[doc]["terminal_share"] == pytest.approx(len(done) / len(lines) if lines else 0, abs=1e-6), text


def ends(line):
    """A sentence's mark with nothing but closing marks, emoji and blanks after it."""
    for c in reversed(line):
        if c in ".!?…":
            return True
        if c not in "\"'”’»)] \t\n\v\f\r" and unicodedata.category(c) != "So":
            return False
    return False


def test_endings_vote():
    assert any("terminal_share" in junk and "terminal_share" in prose for prose, junk in FUNCTIONS.values())
