import random

import numpy as np
import pytest

from plumbline.llm import tokens
from plumbline.llm.text_types import FUNCTIONS, STATISTICS, learn, posterior, statistics, text_types, votes

COMMON = ["the", "a", "and", "to", "of", "it", "is", "in", "for", "was", "that", "this", "on", "but", "not", "have", "we", "as", "very", "at"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "7 AS word_count", "'x' AS plain").repartition(2)


def words(spark):
    return spark.createDataFrame([("en", w) for w in COMMON] + [("en", "The"), ("en", None)], "lang string, word string")


def test_statistics(spark):
    texts = ["The pump is on.\n\nIt was NOT 12 ok", "", None, "   ", "a|b|c", "x" * 300_000, "<b>Hi</b> there<br>you!"]
    out = {r["doc_id"]: r for r in statistics(docs(spark, texts), words(spark)).collect()}
    r = out[0]
    assert (r["word_count"], r["line_count"], r["letter_words"]) == (9, 2, 8)
    assert r["mean_word_length"] == pytest.approx(24 / 9)
    assert r["terminal_share"] == 0.5 and r["symbol_share"] == 0
    assert r["common_share"] == pytest.approx(6 / 8) and r["digit_share"] == pytest.approx(2 / 24)
    assert out[1]["word_count"] == out[3]["word_count"] == 0 and out[2]["absent"] and not out[1]["absent"]
    assert out[4]["symbol_share"] == pytest.approx(2 / 5) and out[4]["separators_per_word"] == 2
    assert out[5]["longest_word"] == 300_000
    assert (out[6]["word_count"], out[6]["line_count"]) == (3, 2)


def test_any_number_of_common_words(spark):
    """A table too large to be sent to the tasks is joined and gives the same."""
    listed = [f"wort{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}{'abcdefghij'[i // 1000 % 10]}{'abcdefghij'[i // 10000]}" for i in range(30_000)] + COMMON
    table = spark.createDataFrame([(w,) for w in listed], "word string")
    texts = ["The pump is on and on", f"{listed[7]} {listed[29_999]} x {listed[7].upper()}", "", None, "<b>the</b> Pump", "The pump is on and on"]
    frame = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[3]), (5, texts[4]), (1, texts[5]), (1, "other"), (None, "the one")], "doc_id bigint, text string")
    rows = lambda limit: sorted((tuple(r) for r in statistics(frame, table, limit).select("doc_id", "absent", *STATISTICS).collect()), key=repr)
    joined = rows(1000)
    assert joined == rows(1 << 22)
    assert {r[0]: r[2 + STATISTICS.index("common_kinds")] for r in joined if r[0] in (2, 5)} == {2: 2, 5: 1}


def test_learning_recovers_hidden_classes():
    rng = np.random.default_rng(1)
    n, accuracy = 20_000, np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    truth = (rng.random(n) > 0.15).astype(int)  # 1 prose
    right = rng.random((n, 5)) < accuracy
    vote = np.where(right, truth[:, None], 1 - truth[:, None])
    vote[rng.random((n, 5)) < 0.3] = -1
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    prior, p = learn(patterns, counts)
    assert prior == pytest.approx(0.15, abs=0.02)
    assert p[:, 0, 0] == pytest.approx(accuracy, abs=0.04)
    assert p[:, 1, 1] == pytest.approx(accuracy, abs=0.02)


def corpus():
    rng = random.Random(3)
    names = "sensor cable manual display battery board firmware probe logger module clamp case".split()
    prose, junk = [], []
    for i in range(300):
        s = [f"The {rng.choice(names)} is in the box and it was not as {rng.choice(['good', 'loud', 'heavy'])} as we have seen, but that is fine for a {rng.choice(names)}." for _ in range(rng.randint(1, 6))]
        text = " ".join(s)
        prose.append([text, text.upper(), text.lower().replace(",", "").replace(".", ""), text.replace(" is", "\nis"), "Good one.", text + "\n- ok\n- fine"][i % 6])
    for i in range(60):
        kind = i % 6
        if kind == 0:
            junk.append("\n".join(f"{rng.choice(names)} | {rng.random():.3f} | {rng.randint(1, 999)}" for _ in range(9)))
        elif kind == 1:
            junk.append("\n".join(f"- {rng.choice(names)} ok" for _ in range(8)))
        elif kind == 2:
            junk.append(" ".join(f"#{rng.choice(names)}" for _ in range(20)))
        elif kind == 3:
            junk.append("".join(rng.choice("0123456789abcdef") for _ in range(400)))
        elif kind == 4:
            junk.append(" ".join("".join(rng.choice("qwrtzpsdfghjklei") for _ in range(rng.randint(2, 11))) for _ in range(25)))
        else:
            junk.append("nice! " * 40)
    return prose, junk


def test_prose_and_junk_are_told_apart(spark):
    prose, junk = corpus()
    out = {r["doc_id"]: r["text_type"] for r in text_types(docs(spark, prose + junk + [None, ""]), words(spark)).collect()}
    assert [i for i in range(len(prose)) if out[i] != "prose"] == []
    wrong = [i for i in range(len(prose), len(prose) + len(junk)) if out[i] != "junk"]
    assert len(wrong) <= 3, [(prose + junk)[i][:60] for i in wrong]
    assert out[len(prose) + len(junk)] is None and out[len(prose) + len(junk) + 1] == "prose"


def test_empty_table_and_learned_table(spark):
    assert text_types(docs(spark, []), words(spark)).count() == 0
    voted = votes(statistics(docs(spark, ["The pump is on."] * 3), words(spark)))
    learned = posterior(voted)[1].collect()
    assert {r["function"] for r in learned} == set(FUNCTIONS)
    none = words(spark).where("false")
    assert votes(statistics(docs(spark, ["The pump is on, and it is fine."]), none)).count() == 1


def test_token_counts(spark):
    import os

    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no tokenizer files")
    texts = ["Hello world", "", None, "<|endoftext|>", "ä" * 5000]
    got = [r[0] for r in docs(spark, texts).coalesce(1).orderBy("doc_id").select(tokens.token_count("text")).collect()]
    enc = tokens.encoder(tokens.VOCABULARY)
    assert got == [0 if not t else len(enc.encode_ordinary(t)) for t in texts]
    assert got[0] == 2 and got[3] > 1
