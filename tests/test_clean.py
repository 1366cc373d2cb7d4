"""Cleaning edge rows (C1-C5, C23) against a plain-Python model of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from evtab.operators import clean

COLS = "row_pos long, docid string, verb string, eventid string, _golden boolean, _unit_state string"


def ann(spark, rows):
    return spark.createDataFrame(rows, COLS)


def kept(df):
    return sorted(r.row_pos for r in df.collect())


def test_dedup_first_golden_wins_over_state(spark):
    rows = [(0, "d", "v", "e1", False, "golden"),    # state golden, earlier
            (1, "d", "v", "e1", True, "finalized"),  # flagged golden -> wins
            (2, "d", "v", "e1", True, "golden"),     # later flagged golden
            (3, "d", "w", "e2", False, "finalized")]  # singleton
    assert kept(clean.dedup_golden(ann(spark, rows))) == [1, 3]


def test_dedup_state_golden_when_no_flag(spark):
    rows = [(0, "d", "v", "e1", False, "finalized"), (1, "d", "v", "e1", False, "golden"),
            (2, "d", "v", "e1", False, "golden")]
    assert kept(clean.dedup_golden(ann(spark, rows))) == [1]


def test_dedup_no_golden_errors_or_first(spark):  # C1
    rows = [(0, "d", "v", "e1", False, "finalized"), (1, "d", "v", "e1", False, "finalized")]
    with pytest.raises(Exception, match="golden"):
        clean.dedup_golden(ann(spark, rows)).collect()
    assert kept(clean.dedup_golden(ann(spark, rows), on_missing="first")) == [0]


def test_dedup_null_key_keeps_all(spark):  # C2
    rows = [(0, "d", None, "e1", False, "finalized"), (1, "d", None, "e1", True, "golden")]
    assert kept(clean.dedup_golden(ann(spark, rows))) == [0, 1]


@pytest.mark.parametrize("body,before,verb,after,broken", [
    ("a<x\ny>b", "a<x", "", "\ny>b", False),  # C5: a tag does not cross a newline, so it is text
    ("<>c>zz", "", "zz", "", False),           # C5: a tag has at least one character: all of <>c> is one
    ("a<b>c", "a", "c", "", False),
    ("x<a\u2028b>y", "x", "y", "", False),     # C5: U+2028 inside a tag is matched
    ("<p>one <b>two</b> three</p>", "one", "two", "three", False),
    ("<p>one <b>@@</b> three</p>", "one", "two", "three", True),
    ("", "", "", "", False),
])
def test_flag_broken(spark, body, before, verb, after, broken):
    df = spark.createDataFrame([(before, verb, after, body)], "before string, verb string, after string, bodytext string")
    assert clean.flag_broken(df).first().broken == broken


def test_dedup_prefers_the_first_file(spark):
    """Row positions restart per file: row 2 of the first file comes before row 0 of the second."""
    rows = [(0, 2, "first"), (1, 0, "second")]
    df = spark.createDataFrame(rows, "file_priority int, row_pos long, note string").select(
        "*", F.lit("d").alias("docid"), F.lit("v").alias("verb"), F.lit("e").alias("eventid"),
        F.lit(True).alias("_golden"), F.lit("golden").alias("_unit_state"))
    assert [r.note for r in clean.dedup_golden(df).collect()] == ["first"]


def test_flag_broken_fills_nulls(spark):
    df = spark.createDataFrame([(None, "v", None, "<i>v</i>")], "before string, verb string, after string, bodytext string")
    r = clean.flag_broken(df).first()
    assert r.before == "" and r.after == "" and r.broken is False


def test_assign_split_dev_wins(spark):  # C3
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "docid string")
    plat = spark.createDataFrame([("a",), ("b",)], "docid string")
    dev = spark.createDataFrame([("b",), ("c",)], "docid string")
    got = {r.docid: r.split for r in clean.assign_split(df, plat, dev).collect()}
    assert got == {"a": "test", "b": "dev", "c": "dev"}


def test_binary_label_null_is_zero(spark):  # C4
    df = spark.createDataFrame([("yes_its_anchorable",), ("no",), (None,)], "a string")
    got = [r.label for r in clean.binary_label(df, answer="a").collect()]
    assert got == [1, 0, 0]


def test_semi_anti_membership(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "docid string, x int")
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert sorted(r.docid for r in clean.semi_docs(df, ids).collect()) == ["a"]
    assert sorted(r.docid for r in clean.anti_docs(df, ids).collect()) == ["b", "c"]


def test_value_counts_and_stage_counts(spark):
    raw = ann(spark, [(0, "d", "v", "e1", True, "golden"), (1, "d", "v", "e1", False, "x"),
                      (2, "d", "w", "e2", False, "x")])
    raw = raw.withColumn("before", F.lit("")).withColumn("after", F.lit("")) \
             .withColumn("bodytext", F.when(F.col("row_pos") == 2, "zz").otherwise("v")) \
             .withColumn("split", F.lit("train"))
    dd = clean.dedup_golden(raw)
    cl = clean.drop_broken(clean.flag_broken(dd))
    got = {(r.stage, r.key): r.n_rows for r in clean.stage_counts(raw, dd, cl).collect()}
    assert got == {("raw", ""): 3, ("no_dupl", ""): 2, ("no_broken", ""): 1, ("split", "train"): 1}
    vc = clean.value_counts(raw, "verb").collect()
    assert [(r.verb, r.n) for r in vc] == [("v", 2), ("w", 1)]


def test_clean_annotations_from_csv(spark, tmpdir_path):
    import os

    from evtab.sources.readers import read_annotations
    col = clean.ANSWER_COL
    path = os.path.join(tmpdir_path, "ann.csv")
    with open(path, "w") as f:
        f.write(f"docid,eventid,verb,before,after,bodytext,_golden,_unit_state,{col},{col}:confidence\n")
        f.write("p1,e1,ran,He,fast,<p>He <b>ran</b> fast</p>,false,golden,yes_its_anchorable,0.8\n")
        f.write("p1,e1,ran,He,fast,<p>He <b>ran</b> fast</p>,false,finalized,no,0.6\n")
        f.write("d2,e2,sat,,,<p>zz</p>,false,finalized,no,0.5\n")
        f.write("d3,e3,ate,I,,<p>I ate</p>,false,finalized,,\n")
    raw = read_annotations(spark, [path], ["aq"])
    plat = spark.createDataFrame([("p1",)], "docid string")
    dev = spark.createDataFrame([("d3",)], "docid string")
    out = {r.eventid: r for r in clean.clean_annotations(raw, plat, dev).collect()}
    assert set(out) == {"e1", "e3"}                     # duplicate resolved, broken e2 dropped
    assert (out["e1"].split, out["e1"].label, out["e1"].label_confidence) == ("test", 1, 0.8)
    assert (out["e3"].split, out["e3"].label) == ("dev", 0)
