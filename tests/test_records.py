"""CSV records read in splits against Python's csv; tables without type guesses; positional joins."""

import csv
import os
import random

import pytest

from evtab.operators import compare
from evtab.sources import readers, records


def python_rows(path, sep=","):
    with open(path, newline="") as f:
        text = f.read().replace("\r\n", "\n")        # a line's end; inside quotes the reader keeps it
    return [r for r in csv.reader(text.splitlines(keepends=True), delimiter=sep) if r]


def messy(rng, sep, rows):
    cells = ["a", "", "two words", 'say ""hi""', "line\nbreak", "three\n\nlines\n", "tab\t", "x,y;z", "é", '""']
    out = ["id" + sep + "text" + sep + "note"]
    for i in range(rows):
        row = [str(i).zfill(3)]
        for _ in range(2):
            c = rng.choice(cells)
            plain = "\n" not in c and '"' not in c and sep not in c
            row.append(c if plain and rng.random() < 0.5 else f'"{c}"')
        if rng.random() < 0.2:
            row[1] = 'plain 5" tall'                 # a quote inside a plain cell is a letter
        out.append(sep.join(row))
        if rng.random() < 0.1:
            out.append("")                           # a blank line is no record
    return "\n".join(out) + rng.choice(["", "\n"])


@pytest.mark.parametrize("sep", [",", ";"])
def test_any_split_gives_the_records_of_python(spark, tmpdir_path, sep):
    rng = random.Random(5)
    folder = os.path.join(tmpdir_path, "csv")
    os.makedirs(folder)
    want = []
    for k, name in enumerate(("b.csv", "a.csv", "c.csv")):
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(messy(rng, sep, 60 + 40 * k))
    for name in ("a.csv", "b.csv", "c.csv"):
        want += [tuple(r) for r in python_rows(os.path.join(folder, name), sep)[1:]]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for cut in ("37b", "211b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            df = records.read_table(spark, folder, sep)
            got = [tuple(r[c] for c in ("id", "text", "note")) for r in df.orderBy("row_pos").collect()]
            assert got == want
            parts = spark.read.option("lineSep", "\n").text(folder).rdd.getNumPartitions()
            assert parts > 3 if cut == "37b" else parts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quotes_follow_python():
    for line, sep, want in [('a,"b', ",", True), ('a,"b""', ",", True), ('a,"b"""', ",", False), ('a"b,c', ",", False),
                            ('"a"x"y,"', ",", True), ('"a"x"y,z', ",", False), ('"a";"', ";", True), ("", ",", False)]:
        assert records.ends_inside(line, False, sep) is want
    assert records.ends_inside('end",x', True, ",") is False
    assert records.ends_inside('end"",x', True, ",") is True


def test_ids_stay_text_in_predictions_and_sheets(spark, tmpdir_path):
    p1, p2, p3 = (os.path.join(tmpdir_path, n) for n in ("one.csv", "two.csv", "sheet.csv"))
    with open(p1, "w") as f:
        f.write(",docid,eventid,pred,label\n0,007,12,1,1.0\n1,12,e1,0,NA\n")
    with open(p2, "w") as f:
        f.write(",docid,eventid,pred,prob,label\n0,x12,12,1,0.25,\n")
    rows = {(r.model, r.docid): r for r in readers.read_predictions(spark, {"m": p1, "n": p2}).collect()}
    assert set(rows) == {("m", "007"), ("m", "12"), ("n", "x12")}
    assert rows["m", "007"].label == 1 and rows["m", "12"].label is None and rows["n", "x12"].prob == 0.25
    assert rows["m", "007"].eventid == "12" and rows["m", "007"].prob is None
    with open(p3, "w") as f:
        f.write('docid;eventid;annotation\n007;"e;1";1\n008;e2;\n')
    sheet = readers.read_review(spark, p3).orderBy("row_pos").collect()
    assert [(r.docid, r.eventid, r.annotation) for r in sheet] == [("007", "e;1", 1), ("008", "e2", None)]


def test_sheets_without_keys_are_joined_by_position(spark, tmpdir_path):
    a, b, c = (os.path.join(tmpdir_path, n) for n in ("a.csv", "b.csv", "c.csv"))
    with open(a, "w") as f:
        f.write("docid;text\n" + "".join(f'd{i};"line\n{i}"\n' for i in range(40)))
    with open(b, "w") as f:
        f.write("annotation\n" + "".join(f"{i % 2}\n" for i in range(40)))
    with open(c, "w") as f:
        f.write("annotation\n1\n")
    sheet, marks = readers.read_review(spark, a), readers.read_review(spark, b)
    got = compare.positional_join(sheet, marks).orderBy("row_pos").collect()
    assert [(r.docid, r.annotation) for r in got] == [(f"d{i}", i % 2) for i in range(40)]
    with pytest.raises(Exception, match="different lengths"):
        compare.positional_join(sheet, readers.read_review(spark, c)).collect()
