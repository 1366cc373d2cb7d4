"""The ``col`` data source against whole-file parsing, in ranges of any size."""

import os
import random

import pytest
from pyspark.sql import functions as F

from evtab.sources import col_source, corpus

LANGS = {"alpha": "it", "beta": "es", "gamma": "xx"}
COLUMNS = ["corpus", "docid", "lang", "split", "sent_pos", "tok_pos", "token", "raw_token", "tokenid", "sentid", "eventid"]


def write_files(root):
    rng = random.Random(3)
    for name in LANGS:
        for split in ("train", "test"):
            folder = os.path.join(root, name, split)
            os.makedirs(folder)
            for d in range(4):
                end = rng.choice([b"\n", b"\r\n", b"\r"])
                sents = [end.join("\t".join([rng.choice(["tok", " é ", "中", "x y"]), str(t), str(s), rng.choice(["O", "e1"])])
                                  .encode() for t in range(rng.randint(1, 6))) for s in range(rng.randint(0, 40))]
                body = b"".join(s + end * rng.randint(2, 5) for s in sents)
                if d == 1:
                    body = b"DCT\t2020-01-01" + end + body
                if d == 2:
                    body = end * 3 + b" DCT x" + end + body.replace(b"tok", b"t\xffk", 3)   # a byte that is no UTF-8
                with open(os.path.join(folder, f"d.{d}.col"), "wb") as f:
                    f.write(body)
            with open(os.path.join(folder, "notes.txt"), "w") as f:
                f.write("no corpus")


@pytest.mark.parametrize("size", [1 << 20, 700, 53])
def test_ranges_give_the_rows_of_whole_files(spark, tmpdir_path, size):
    write_files(tmpdir_path)
    files = corpus.read_col_corpus(spark, tmpdir_path, LANGS)
    want = corpus.parse_col(files, keep=("corpus", "docid", "lang", "split")).select(*COLUMNS)
    got = col_source.read_col_tokens(spark, tmpdir_path, LANGS, partition_bytes=size)
    assert got.columns == COLUMNS
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = col_source.read_col_tokens(spark, tmpdir_path, LANGS, langs=["es"], splits=["test"], partition_bytes=size)
    assert one.count() == want.where("lang = 'es' AND split = 'test'").count() > 0


def test_conditions_choose_what_is_listed(tmpdir_path):
    write_files(tmpdir_path)
    r = col_source.ColReader({"root": tmpdir_path, "langs": '{"alpha": "it", "beta": "es"}', "partitionbytes": "100"})
    left = list(r.pushFilters([col_source.EqualTo(("lang",), "es"), col_source.In(("split",), ("test", "dev")),
                               col_source.EqualTo(("line",), "x")]))
    assert [f.attribute for f in left] == [("line",)]
    parts = r.partitions()
    assert [os.path.relpath(p, tmpdir_path) for p in r.listed] == [".", "beta", "beta/test"]
    ranges = [x for p in parts for x in p.ranges]
    assert {(x.corpus, x.split) for x in ranges} == {("beta", "test")} and len(parts) > 4
    assert all(sum(x.end - x.start for x in p.ranges) <= 100 for p in parts)


def test_plan_carries_the_conditions(spark, tmpdir_path):
    write_files(tmpdir_path)
    df = col_source.read_col_tokens(spark, tmpdir_path, LANGS, corpora=["alpha"])
    assert {r.corpus for r in df.select("corpus").distinct().collect()} == {"alpha"}
    assert df.where(F.col("split") == "none").count() == 0
