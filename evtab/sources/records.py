"""Headered CSV files as records in file order, read in splits.

A quoted cell may run over lines, so a line alone does not show whether it
starts a record. Lines are read by Spark's text source, which cuts files into
splits, and a first pass follows the quotes of every split twice: as if it
began at a record, and as if it began inside a quoted cell. What a split makes
of either start is one small row; folded over the splits of a file they tell
where every split really stands and how many records are before it. The second
pass numbers the records from there. Records on one line are parsed where they
are; only lines of longer records are shuffled, to their record.

Quotes count as they do for Python's ``csv``: they open a cell only at its
start, a doubled quote inside stands for one, and what follows a closing quote
belongs to the cell.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

csv.field_size_limit(2 ** 31 - 1)


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that starts ``inside`` a quoted cell, or at a record, ends inside one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find(sep, at) + 1          # a plain cell: quotes in it are letters
                if not at:
                    return False
                continue
            at, inside = at + 1, True
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        at, inside = line.find(sep, at + 1) + 1, False
        if not at:
            return False


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, file, block): lines in order inside every split (``block``: where the split begins)."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"))


def _split_effects(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, start, stop, records): for either start state (inside a cell: 1), the state a split ends in and
    the records that begin in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[list[int]]] = {}
        for batch in batches:
            for line, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for state in seen.setdefault((file, block), [[0, 0], [1, 0]]):
                    state[1] += not state[0]
                    state[0] = int(ends_inside(line, bool(state[0]), sep))
        rows = [(f, b, start, stop, n) for (f, b), both in seen.items() for start, (stop, n) in enumerate(both)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
            names=["file", "block", "start", "stop", "records"])

    return lines.mapInArrow(run, "file string, block long, start long, stop long, records long")


def _split_starts(effects: DataFrame) -> DataFrame:
    """(file, block, inside, before): where every split of a file stands (folded over the file's splits, two rows each)."""
    def fold(table: pa.Table) -> pa.Table:
        step = {(b, s): (stop, n) for b, s, stop, n in zip(
            *(table.column(c).to_pylist() for c in ("block", "start", "stop", "records")), strict=True)}
        blocks = sorted({b for b, _ in step})
        state, records, inside, before = 0, 0, [], []
        for b in blocks:
            inside.append(state == 1)
            before.append(records)
            state, n = step[b, state]
            records += n
        return pa.table({"file": pa.array(table.column("file").to_pylist()[:1] * len(blocks), pa.string()),
                         "block": pa.array(blocks, pa.int64()), "inside": inside,
                         "before": pa.array(before, pa.int64())})

    return effects.groupBy("file").applyInArrow(fold, "file string, block long, inside boolean, before long")


def read_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """(file, record, cells): records of all files under ``path``, numbered from 0 in each file.

    The header is record 0. Blank lines between records are records without
    cells, which are left out. A carriage return before a line's end belongs to
    the line's end outside quotes and to the cell inside.
    """
    lines = _lines(spark, path)
    starts = _split_starts(_split_effects(lines, sep))     # one short row per split

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, record, part = None, False, 0, 0
        for batch in batches:
            out = []
            for line, file, block, inside, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != here:
                    here, state, record, part = (file, block), inside, before - 1, 0
                if state:
                    part += 1
                else:
                    record, part = record + 1, 0
                first, state = not state, ends_inside(line, state, sep)
                whole = first and not state
                cells = _parsed(line, sep) if whole else None
                if not whole or cells:
                    out.append((file, record, block, part, None if whole else line, cells))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                             names=["file", "record", "block", "part", "line", "cells"])

    # the broadcast side has a row per split; a broadcast join keeps the order of the lines
    numbered = lines.join(F.broadcast(starts), ["file", "block"]).select("value", "file", "block", "inside", "before") \
        .mapInArrow(number, "file string, record long, block long, part long, line string, cells array<string>")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [_parsed(t, sep) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cells, pa.list_(pa.string()))],
                                             names=["file", "record", "cells"])

    whole = numbered.where("line IS NULL").select("file", "record", "cells")
    long = numbered.where("line IS NOT NULL").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "line"))).alias("l")) \
        .select("file", "record", F.array_join("l.line", "\n").alias("text"))
    return long.mapInArrow(parse, "file string, record long, cells array<string>").unionByName(whole)


def _parsed(record: str, sep: str) -> list[str]:
    return next(csv.reader([record.removesuffix("\r")], delimiter=sep), [])


def read_table(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """String columns by header, and ``row_pos``: the order of the rows, by file name, then by place in the file.

    Files may have different headers: a column that a file lacks is null in its
    rows, as is a cell that a short row lacks. Columns without a name are left
    out; of two with one name, the first counts. Cells stay as they are written.
    """
    records = read_records(spark, path, sep)
    # one row per file: its header and the rows of the files before it
    per_file = records.groupBy("file").agg(F.max("record").alias("last"), F.min_by("cells", "record").alias("header"))
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.select("file", F.transform("header", lambda c: F.ltrim(c, F.lit("﻿"))).alias("header"),
                               F.coalesce(F.sum(F.col("last") + 1).over(ahead), F.lit(0)).alias("offset"))
    names: list[str] = []
    for row in per_file.select("header").distinct().collect():        # as many as there are different headers
        names += [n for n in row["header"] if n and n not in names]
    rows = records.where("record > 0").join(F.broadcast(per_file), "file")
    place = {n: F.array_position("header", F.lit(n)).cast("int") for n in names}
    return rows.select(*[F.when(place[n] > 0, F.get("cells", place[n] - 1)).alias(n) for n in names],
                       (F.col("offset") + F.col("record")).alias("row_pos"))
