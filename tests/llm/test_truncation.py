from __future__ import annotations

import random

import pytest

pytest.importorskip("lockgrain.llm")
from lockgrain.llm.truncation import pile_ups, truncated, truncation_rates, trigram_counts, verdicts  # noqa: E402

STARTS = ["The scanner reads every lockfile before the report is written", "A reporter noticed that the parser keeps the parent links", "Please run the scan over all manifests and check the result again", "Version numbers are compared in order of release by the matcher"]
SCHEMA = "doc_id long, source string, text string, row int"


def corpus():
    rng = random.Random(6)
    docs = {}
    for i in range(400):
        docs[i] = (rng.choice("ab"), " ".join(rng.choice(STARTS) + rng.choice([".", "!", "?"]) for _ in range(rng.randint(2, 6))))
    docs[1000] = ("a", STARTS[0] + ". The scanner reads every")
    docs[1001] = ("a", STARTS[1] + ". Please run the scan over all mani")
    docs[1002] = ("a", STARTS[2] + ". A reporter noticed that the…")
    docs[1003] = ("b", STARTS[2] + ". Version numbers are compar\n")
    docs[1004] = ("b", "Look:\n```\nx = 1\ny = ")
    docs[1005] = ("b", STARTS[0] + ". A reporter noti�")
    docs[1006] = ("b", STARTS[2] + ". A reporter noticed that the parser keeps the \x0c \n")
    docs[2000] = ("a", STARTS[0])
    docs[2001] = ("a", STARTS[1] + ".\n\n- " + STARTS[2])
    docs[2002] = ("b", STARTS[1] + ".\n```\nx = 1\n```")
    docs[2003], docs[2004], docs[2005], docs[2006] = ("b", None), ("b", ""), (None, " \n\t "), (None, "...")
    docs[2007] = ("b", "https://docs.example/" + "x" * 20000)
    return docs


def test_cut_texts_are_found(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, s, t, 1) for i, (s, t) in docs.items()], SCHEMA)
    assert {r.doc_id for r in truncated(df).collect()} == {1000, 1001, 1002, 1003, 1004, 1005, 1006}
    rates = {r.source: (r.n_docs, r.n_cut) for r in truncation_rates(df).collect()}
    assert rates["a"][1] == 3 and rates["b"][1] == 4 and rates[None] == (2, 0)
    assert sum(n for n, _ in rates.values()) == len(docs)


def test_repeated_rows_and_empty_table(spark):
    docs = corpus()
    rows = [(i, s, t, 1) for i, (s, t) in docs.items()]
    twice = spark.createDataFrame(rows + rows[-20:], SCHEMA)
    assert {r.doc_id for r in truncated(twice).collect()} == {1000, 1001, 1002, 1003, 1004, 1005, 1006}
    empty = spark.createDataFrame([], SCHEMA)
    assert truncated(empty).collect() == [] and truncation_rates(empty).collect() == []


def test_counts_inside_and_at_ends(spark):
    df = spark.createDataFrame([(1, "a b c d. A b c."), (2, "a b c\n漢字。")], "row long, text string")
    got = {(r.a, r.b, r.c): (r.n, r.at_end) for r in trigram_counts(df).collect()}
    assert got["a", "b", "c"] == (3, 2) and got["b", "c", "d"] == (1, 1) and got["⏎", "漢", "字"] == (1, 1)


def test_pile_ups(spark):
    rows = [(i, "s", "x" * (50 if i < 30 else i)) for i in range(300)] + [(900, None, "y"), (901, "s", None)]
    got = {(r.source, r.unit, r["size"]) for r in pile_ups(spark.createDataFrame(rows, "row long, source string, text string")).collect()}
    assert got == {("s", "chars", 50), ("s", "bytes", 50)}


def test_marks_are_taken_off_the_end_only(spark):
    from lockgrain.llm.truncation import _unmarked

    cases = {"of": "of", "of …": "of", "off...": "off", "x....": "x.", "t [...] \n": "t", "r�…": "r", "… a": "… a", "n\\t": "n\\t", "": "", " \t": ""}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.got for r in df.selectExpr("text", f"{_unmarked('text')} AS got").collect()} == cases


def test_cut_inside_a_long_word(spark):
    url = "https://example.org/" + "abcdefghij/" * 6 + "index"
    texts = [f"see the docs at {url} for more." for _ in range(30)] + [f"see the docs at {url[:50]}", f"see the docs at {url[:12]}", f"see the docs at {url}"]
    df = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    more = {r.row: (r.more3, r.more2) for r in verdicts(df.withColumnRenamed("doc_id", "row")).collect()}
    assert more[30] == (31, 31) and more[31] == (31, 31) and more[32] == (0, 0)
    assert {30, 31} <= {r.doc_id for r in truncated(df).collect()}
