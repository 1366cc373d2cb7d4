"""Language identification by compression.

Each language has a Zstandard dictionary of raw sample text. A text is encoded
with every dictionary; the language whose dictionary gives the fewest bytes is
chosen, and the choice is rejected when the runner-up needs hardly more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"

#: Bounds of the sample that is learned from (the classifier's only bounded part).
MAX_LANGUAGES = 256
SAMPLE_DOCS = 64
SAMPLE_CHARS = 2000
DICTIONARY_BYTES = 32 << 10

#: Whole texts are encoded in blocks of so many bytes, so that a long text is
#: measured against the dictionary throughout and not against its own start.
BLOCK = 2048
LEVEL, FINE_LEVEL = 5, 19
#: A margin below FINE_MARGIN is measured again at FINE_LEVEL; one below
#: MIN_MARGIN is too narrow to decide.
FINE_MARGIN, MIN_MARGIN = 0.01, 0.001

_NO_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str | None) -> bytes:
    """Lower-case letters of a text, other runs as one space (empty: no letter)."""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode() if text else b""


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """One dictionary per language from a bounded sample of labelled rows.

    The MAX_LANGUAGES most frequent labels are learned, each from the
    SAMPLE_DOCS rows with the smallest key hash (SAMPLE_CHARS characters of
    each, joined and cut to DICTIONARY_BYTES at a word). Rows without label or
    text teach nothing; no labelled row gives {}.
    """
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")) \
        .where("l IS NOT NULL AND t IS NOT NULL")
    counts = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    # a hash threshold per label keeps about four times the sample, so only few texts are ranked
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[x for r in counts for x in
                           (F.lit(r["l"]), F.lit(min(1.0, (4.0 * SAMPLE_DOCS + 64) / r["count"])))])
    few = rows.where(place <= share[F.col("l")]).select("l", "k", F.substring("t", 1, SAMPLE_CHARS).alias("t"))
    order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k", "t")
    sample = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS).collect()
    out: dict[str, bytes] = {}
    for row in sorted(sample, key=lambda r: (r["l"], r["n"])):
        got = letters(row["t"])
        if got:
            out[row["l"]] = (out[row["l"]] + b" " + got) if row["l"] in out else got
    return {k: v if len(v) <= DICTIONARY_BYTES else v[:DICTIONARY_BYTES].rpartition(b" ")[0] or v[:DICTIONARY_BYTES]
            for k, v in out.items()}


class Encoder:
    """Sizes of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.quick = [self._quick(zstandard.ZstdCompressionDict(dictionaries[x], dict_type=raw)) for x in self.langs]
        fine = zstandard.ZstdCompressionParameters.from_level(
            FINE_LEVEL, dict_size=DICTIONARY_BYTES, min_match=3,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        self.fine = [zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(dictionaries[x], dict_type=raw), compression_params=fine)
            for x in self.langs]

    @staticmethod
    def _quick(data: zstandard.ZstdCompressionDict) -> zstandard.ZstdCompressor:
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

    @staticmethod
    def margin(sizes: list[int]) -> float:
        if len(sizes) == 1:
            return 1.0
        best, second = sorted(sizes)[:2]
        return (second - best) / second

    def best(self, text: str | None) -> tuple[str, float]:
        """Language and margin; ``und`` and 0 where no letter or no dictionary is there."""
        body = letters(text)
        if not body or not self.langs:
            return UNDETERMINED, 0.0
        blocks = [body[i:i + BLOCK] for i in range(0, len(body), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.quick]
        if self.margin(sizes) < FINE_MARGIN:
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.fine]
        return self.langs[sizes.index(min(sizes))], self.margin(sizes)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
            min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected`` to every row.

    A null text or one without a letter is ``und``, score 0, rejected; a
    margin below ``min_margin`` is rejected but keeps its best language (ties:
    the first by name). Whole texts are read; rows stay in their partition.
    Input columns with the names of the new ones are replaced.
    """
    made = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c.lower() not in made]
    out = T.StructType([docs.schema[c] for c in kept]) \
        .add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())
    names, at = out.fieldNames(), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dictionaries)
        for batch in batches:
            got = [encoder.best(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[0] == UNDETERMINED or g[1] < min_margin for g in got], pa.bool_())], names=names)

    return docs.select(*kept).mapInArrow(run, out)


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls into the held-out fold (a null key is held out)."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(True))
