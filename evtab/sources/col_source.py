"""Spark data source ``col``: lines of column-format corpora, read in byte ranges.

``<root>/<corpus>/<split>/<docid>.col``. Partitions are planned by bytes: many
small files share one, a large file is cut. A range owns what begins after the
first blank line at or past its start, up to the first blank line at or past
its end, so no sentence is cut and no file is ever one cell. Conditions on
``corpus``, ``lang``, ``split`` and ``docid`` choose the folders and files that
are listed at all.

Options: ``root``; ``langs``, a JSON object corpus -> language; ``partitionBytes``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from evtab.sources.corpus import LAYOUTS, cells_of, layout_of

SCHEMA = "corpus string, lang string, split string, docid string, start long, sentence long, line_no int, line string, " \
         "ended long"
PARTITION_BYTES = 64 << 20
READ_BYTES = 1 << 20
#: Lines of one batch.
BATCH_LINES = 20_000

_BREAK = re.compile(rb"(?:\r\n|\r|\n)+")
#: White space and a date line before the body.
_HEAD = re.compile(rb"[\s\x1c-\x1f]*(?:DCT[^\r\n]*(?:\r\n|\r|\n)[\s\x1c-\x1f]*)?")
_SPACE = bytes([*range(9, 14), *range(28, 33)])


@dataclass
class Range:
    """Bytes ``start`` to ``end`` of a file (their owner reads on to the blank line that ends them)."""
    path: str
    corpus: str
    lang: str | None
    split: str
    docid: str
    start: int
    end: int
    size: int


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]

    def __init__(self, ranges: list[Range]) -> None:
        super().__init__(0)
        self.ranges = ranges


def _after_blank_line(stream, at: int, size: int) -> int:
    """End of the last pair of line ends in the first run of them that reaches past ``at``; ``size`` where there is none.

    Line ends pair up from a run's start, so an odd one is left to the next sentence."""
    back = at
    while back > 0:                                  # a run of line ends counts from its start
        step = min(back, 64)
        stream.seek(back - step)
        rest = stream.read(step).rstrip(b"\r\n")
        back -= step - len(rest)
        if rest:
            break
    stream.seek(back)
    held, base = b"", back
    while True:
        more = stream.read(READ_BYTES)
        held += more
        for m in _BREAK.finditer(held):
            if m.end() == len(held) and more:        # the run may go on
                break
            if base + m.end() > at and _line_ends(m[0]) >= 2:
                odd = 0 if _line_ends(m[0]) % 2 == 0 else 2 if m[0].endswith(b"\r\n") else 1
                return min(size, base + m.end() - odd)
        if not more:
            return size
        keep = len(held.rstrip(b"\r\n"))
        held, base = held[keep:], base + keep


def _body(stream, size: int) -> tuple[int, int]:
    """Where the body of a file begins, behind white space and a date line, and where white space ends it."""
    read = READ_BYTES
    while True:
        stream.seek(0)
        head = stream.read(min(read, size))
        begin = _HEAD.match(head).end()
        if begin < len(head) or len(head) == size:
            break
        read *= 2
    end = size
    while end > begin:
        back = max(begin, end - READ_BYTES)
        stream.seek(back)
        tail = stream.read(end - back).rstrip(_SPACE)
        if tail:
            return begin, back + len(tail)
        end = back
    return begin, begin


def _line_ends(run: bytes) -> int:
    return len(run.replace(b"\r\n", b"\n"))


class ColReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"]
        self.langs: dict[str, str] = json.loads(options.get("langs", "{}"))
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: dict[str, set[str]] = {}
        self.listed: list[str] = []

    def pushFilters(self, filters):
        for f in filters:
            known = isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in (
                "corpus", "lang", "split", "docid")
            if not known:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = f.attribute[0]
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def _takes(self, name: str, value: str | None) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def _children(self, files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
        self.listed.append(path)
        return sorted(files.get_file_info(fs.FileSelector(path)), key=lambda i: i.path)

    def partitions(self) -> list[Ranges]:
        files, root = fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)
        found = []
        for corpus in self._children(files, root.rstrip("/")):
            lang = self.langs.get(corpus.base_name)
            if corpus.type != fs.FileType.Directory or not self._takes("corpus", corpus.base_name) \
                    or not self._takes("lang", lang):
                continue
            for split in self._children(files, corpus.path):
                if split.type != fs.FileType.Directory or not self._takes("split", split.base_name):
                    continue
                for f in self._children(files, split.path):
                    docid = f.base_name[:-4]
                    if f.type == fs.FileType.File and f.base_name.endswith(".col") and self._takes("docid", docid):
                        found.append(Range(f.path, corpus.base_name, lang, split.base_name, docid, 0, f.size, f.size))
        out: list[Ranges] = []
        held, size = [], 0
        for f in found:
            for start in range(0, max(f.size, 1), self.bytes):
                piece = Range(f.path, f.corpus, f.lang, f.split, f.docid, start, min(f.size, start + self.bytes), f.size)
                if held and size + piece.end - piece.start > self.bytes:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append(piece)
                size += piece.end - piece.start
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root else fs.LocalFileSystem()
        rows: list[tuple] = []
        for r in partition.ranges if partition else []:     # nothing was listed: one task without a partition
            with files.open_input_file(r.path) as stream:
                first, last = _body(stream, r.size)
                begin = first if r.start == 0 else _after_blank_line(stream, max(r.start, first), last)
                end = last if r.end >= last else _after_blank_line(stream, max(r.end, first), last)
                if begin >= end:
                    continue
                stream.seek(begin)
                raw = stream.read(end - begin)
            text = raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
            text = text.lstrip() if begin == first else text
            sentences = (text.rstrip() if end >= last else text).split("\n\n")
            for s, sentence in enumerate(sentences):
                for n, line in enumerate(sentence.split("\n")):
                    if line:
                        rows.append((r.corpus, r.lang, r.split, r.docid, r.start, s, n, line, None))
                if len(rows) >= BATCH_LINES:
                    yield _batch(rows)
                    rows = []
            # how many sentences end in the range: what the later ranges of the file start from
            rows.append((r.corpus, r.lang, r.split, r.docid, r.start, None, None, None, len(sentences) - 1))
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=names)


class ColDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "col"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ColReader:
        return ColReader(dict(self.options))


def read_col_tokens(spark: SparkSession, root: str, corpus_langs: dict[str, str] | None = None,
                    corpora: list[str] | None = None, langs: list[str] | None = None, splits: list[str] | None = None,
                    layouts: dict[str, str] = LAYOUTS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Token rows of a corpus folder, as ``parse_col`` gives them for whole files: (corpus, docid, lang, split, sent_pos,
    tok_pos, token, raw_token, tokenid, sentid, eventid). ``corpora``, ``langs``, ``splits``: what to read of it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ColDataSource)
    df = spark.read.format("col").option("root", root).option("langs", json.dumps(corpus_langs or {})) \
        .option("partitionBytes", partition_bytes).load()
    for name, values in (("corpus", corpora), ("lang", langs), ("split", splits)):
        if values is not None:
            df = df.where(F.col(name).isin(values))
    key = ["corpus", "split", "docid"]
    # one row per range: sentences that end in the ranges before it
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.where("ended IS NOT NULL").select(
        *key, "start", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("_before")).where("start > 0")
    lines = df.where("line IS NOT NULL").join(offsets, [*key, "start"], "left")
    cells = cells_of(F.col("line"), layout_of(F.col("lang"), layouts))
    return lines.select("corpus", "docid", "lang", "split",
                        (F.col("sentence") + F.coalesce("_before", F.lit(0))).cast("int").alias("sent_pos"),
                        F.col("line_no").alias("tok_pos"), *[c.alias(n) for n, c in cells.items()])
