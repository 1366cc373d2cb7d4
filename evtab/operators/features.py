"""Positional tf-idf features, fitted on train and reused on dev/test.

Everything is a long table ``(row, col, value)``: a sparse matrix row per
sample, cells summed where the reference sums duplicate entries. The fit is
four small tables (text vocabulary with idf, POS vocabulary with idf, block
sizes, kept columns); ``SparseVector`` only appears at the model boundary.

tf-idf (scikit-learn defaults): ``w = tf * (ln((1+n)/(1+df)) + 1)`` on the
top ``max_features`` terms by corpus count (ties: term ascending), divided by
the row's L2 norm over all vocabulary terms (bigrams included when asked).
Column numbers follow the alphabetical order of the kept terms.

Feature blocks, in order: bow_before, bow_after (text vocabulary wide),
word_-L..word_R (text), pos_-L..pos_R (POS). A word outside the vocabulary
adds no cell (nor its POS cell); a POS tag never seen in training adds none.

A vocabulary of the most frequent terms is found by thresholds (``top_terms``):
the long tail of terms is counted where its rows are and never shuffled. Cells
are built from one small record per (row, term): its count, its counts before
and after the verb and the window positions it holds.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from evtab.functions.text import ws_tokens


#: Different terms a task counts at a time, and candidates looked up in one pass.
LOCAL_TERMS, CANDIDATES = 150_000, 200_000


def sorted_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Exact 0-based position of every row in ``order``.

    No single-partition step: a range-partitioned sort numbered inside each
    partition, materialised once with ``checkpoint()`` (so the count pass and
    the numbering pass see the same partitions), then running offsets from the
    per-partition counts (one row per partition)."""
    from pyspark import TaskContext
    from pyspark.sql.types import LongType, StructField, StructType

    from evtab.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark, fallback=_local_fallback(spark))
    schema = StructType(df.schema.fields + [StructField("_pid", LongType()), StructField("_loc", LongType())])

    def number(batches):
        pid = TaskContext.get().partitionId()
        seen = 0
        for pdf in batches:
            pdf["_pid"] = pid
            pdf["_loc"] = range(seen, seen + len(pdf))
            seen += len(pdf)
            yield pdf
    numbered = df.orderBy(*order).mapInPandas(number, schema).checkpoint(eager=True)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_off"))
    return numbered.join(offs, "_pid").withColumn(out, (F.col("_off") + F.col("_loc")).cast("long")) \
        .drop("_pid", "_loc", "_off")


def _local_fallback(spark) -> str | None:
    """A scratch checkpoint folder, only for sessions of one process."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return None
    import tempfile
    return tempfile.mkdtemp(prefix="evtab-ckpt-")


def ngrams(tokens: Column, n_max: int) -> Column:
    """Unigrams, then word n-grams up to ``n_max`` joined by one space."""
    out = tokens
    for n in range(2, n_max + 1):
        grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n),
                            lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
        out = F.concat(out, F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>")))
    return out


def prepare_rows(df: DataFrame, tagger: Callable[[Column], Column], row=("docid", "eventid"),
                 keep: tuple[str, ...] = ("split", "label", "label_confidence")) -> DataFrame:
    """(row, keep..., words, tags, verb_idx): lowercased sentence tokens, the
    lowercased POS tag of every token, and the token index of the verb.

    ``row`` identifies an event: a column, or several as a struct (event ids
    repeat between documents; the default is the event key)."""
    key = F.col(row) if isinstance(row, str) else F.struct(*row)
    keep = [c for c in keep if c in df.columns]
    sent = F.concat_ws(" ", F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("verb"), F.lit("")),
                       F.coalesce(F.col("after"), F.lit("")))
    return df.select(key.alias("row"), *keep, ws_tokens(F.lower(sent)).alias("words"),
                     F.transform(ws_tokens(sent), lambda t: F.lower(tagger(t))).alias("tags"),
                     F.size(ws_tokens(F.coalesce(F.col("before"), F.lit("")))).alias("verb_idx"))


def occurrences(rows: DataFrame, n_max: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per term occurrence: (row, carry..., verb_idx, p, term, tag, uni).

    Unigrams come first (``p`` = token index, ``tag`` its POS tag, ``uni``
    true), then n-grams (no tag). The only shuffle of the feature pipeline
    is here: whole rows are hash-partitioned by ``row``, so every later
    per-row window and aggregate runs inside its partition."""
    carry = [c for c in carry if c in rows.columns]
    r = rows.select("row", *carry, "verb_idx", "words", "tags").repartition("row")
    z = F.arrays_zip(ngrams(F.col("words"), n_max).alias("term"), F.col("tags").alias("tag"))
    o = r.select("row", *carry, "verb_idx", F.size("words").alias("_nw"), F.posexplode(z).alias("p", "z"))
    uni = F.col("p") < F.col("_nw")
    return o.select("row", *carry, "verb_idx", "p", F.col("z.term").alias("term"),
                    F.when(uni, F.col("z.tag")).alias("tag"), uni.alias("uni")).filter(F.col("term").isNotNull())


def _by_row(rows: DataFrame, *columns: Column) -> DataFrame:
    """(row, columns..., _h): rows of one key next to each other in one partition; ``_h`` is the key's hash."""
    return rows.select("row", *columns, F.xxhash64("row").alias("_h")).repartition("_h").sortWithinPartitions("_h", "row")


def _row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[tuple]]]]:
    """Keys and records (without key and hash) of the rows of ``_by_row``, some hundreds of keys at a time."""
    keys: list[pa.Array] = []
    groups: list[list[tuple]] = []
    last = None
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            hashes = part.column(len(part.columns) - 1).to_pylist()
            key = part.column(0)
            for i, (h, record) in enumerate(zip(hashes, zip(*(c.to_pylist() for c in part.columns[1:-1]), strict=True),
                                                strict=True)):
                if last == h and keys[-1][0].as_py() == key[i].as_py():
                    groups[-1].append(record)
                    continue
                if len(groups) >= 256:
                    yield pa.concat_arrays(keys), groups
                    keys, groups = [], []
                keys.append(key.slice(i, 1))
                groups.append([record])
                last = h
    if groups:
        yield pa.concat_arrays(keys), groups


def term_frequency(rows: DataFrame, tokens: str = "words", n_max: int = 1) -> DataFrame:
    """(row, term, tf) from prepared rows (``tokens`` array column).

    Rows are shuffled whole, and the terms of a key are counted together where they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, groups in _row_groups(batches):
            counts = [Counter(t for (words,) in g for t in _terms(words, n_max)) for g in groups]
            at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array((t for c in counts for t in c), pa.string()),
                                              pa.array((n for c in counts for n in c.values()), pa.int64())],
                                             names=["row", "term", "tf"])
    schema = StructType([rows.schema["row"], StructField("term", StringType()), StructField("tf", LongType())])
    return _by_row(rows, F.coalesce(F.array_join(tokens, " "), F.lit(""))).mapInArrow(run, schema)


def term_counts(occ: DataFrame, pos: bool = False) -> DataFrame:
    """(row, term, tf) from occurrences; partition-local (rows are by row)."""
    if pos:
        occ = occ.filter(F.col("tag").isNotNull()).select("row", F.col("tag").alias("term"))
    return occ.groupBy("row", "term").agg(F.count(F.lit(1)).alias("tf"))


def _index_vocab(stats: DataFrame, n_rows: Column | int) -> DataFrame:
    voc = sorted_index(stats, ["term"], "idx")
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    return voc.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def fit_vocab(tf: DataFrame, n_rows: Column | int, max_features: int | None = None) -> DataFrame:
    """(term, idx, df, cf, idf) from training term frequencies."""
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    if max_features is not None:
        stats = stats.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    return _index_vocab(stats, n_rows)


def _terms(words: str, n_max: int) -> list[str]:
    """Word n-grams of words joined by one space."""
    unigrams = words.split(" ") if words else []
    out = list(unigrams)
    for n in range(2, n_max + 1):
        out.extend(map(" ".join, zip(*(unigrams[k:] for k in range(n)))))
    return out


def _local_counts(batches: Iterator[pa.RecordBatch], n_max: int, terms: int) -> Iterator[Counter]:
    """Term counts of a task's rows (one column of joined words), started anew after ``terms`` different ones."""
    counts: Counter = Counter()
    for batch in batches:
        for w in batch.column(0).to_pylist():
            counts.update(_terms(w, n_max))
            if len(counts) >= terms:
                yield counts
                counts = Counter()
    if counts:
        yield counts


def _emitted(rows: DataFrame, n_max: int, pick: Callable[[Counter], list[tuple[str, int]]]) -> DataFrame:
    """(term, n): what ``pick`` chooses of every local count, and a row without term for each of them."""
    limit = LOCAL_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in _local_counts(batches, n_max, limit):
            some = pick(counts)
            yield pa.RecordBatch.from_arrays([pa.array([None, *(t for t, _ in some)], pa.string()),
                                              pa.array([1, *(n for _, n in some)], pa.int64())], names=["term", "n"])
    return rows.mapInArrow(run, "term string, n long")


def term_stats(rows: DataFrame, n_max: int, terms: set[str] | None = None) -> DataFrame:
    """(term, df, cf) of joined words (one string column); of the given terms only, or of all."""
    limit = LOCAL_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        cf: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cf.keys(), pa.string()),
                                               pa.array([df[t] for t in cf], pa.int64()),
                                               pa.array(cf.values(), pa.int64())], names=["term", "df", "cf"])
        for batch in batches:
            for w in batch.column(0).to_pylist():
                every = _terms(w, n_max)
                counts = Counter(every if terms is None else filter(terms.__contains__, every))
                df.update(counts.keys())
                cf.update(counts)
                if len(cf) >= limit:
                    yield out()
                    df.clear()
                    cf.clear()
        if cf:
            yield out()
    return rows.mapInArrow(run, "term string, df long, cf long").groupBy("term") \
        .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def top_terms(rows: DataFrame, n_max: int, limit: int) -> DataFrame:
    """(term, df, cf) of the ``limit`` terms of highest count (ties: term ascending), exactly, by thresholds.

    ``rows``: one string column, a row's words joined by one space. Rows are
    counted where they are. First every local count names its ``limit`` highest
    terms; the ``limit``-th highest sum of these, s, is below no top term. Of m
    local counts, one at least holds s / m of each top term: every local count
    names the terms it holds that often. Sums of these again bound what is
    left, and the terms that can still be among the top are counted in full.
    """
    def nth(sums: DataFrame) -> tuple[int, int]:
        """The ``limit``-th highest sum (0 where there are fewer) and the number of local counts."""
        got = sums.where("term IS NOT NULL").orderBy(F.desc("s")).limit(limit) \
            .agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("c")).first()
        counts = sums.where("term IS NULL").agg(F.sum("s")).first()[0] or 0
        return (got["s"] if got["c"] == limit else 0), counts

    first = _emitted(rows, n_max, lambda c: c.most_common(limit)).groupBy("term").agg(F.sum("n").alias("s"))
    least, parts = nth(first.checkpoint())
    while True:
        share = max(1, least // max(parts, 1))
        named = _emitted(rows, n_max, lambda c, share=share: [(t, n) for t, n in c.items() if n >= share]) \
            .groupBy("term").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("held")).checkpoint()
        bound, now = nth(named)
        if share == 1 or share * now <= least:       # cut into more local counts than before: a lower share
            break
        parts = now
    # a local count that did not name a term holds fewer than ``share`` of it
    able = named.where(F.col("term").isNotNull() & (
        F.col("s") + (F.lit(now) - F.col("held")) * (share - 1) >= F.lit(max(bound, least)))).select("term")
    n_able = able.count()
    if share == 1:                                   # everything was named: sums are counts
        able = named.where("term IS NOT NULL").orderBy(F.desc("s"), F.asc("term")).limit(limit).select("term")
        n_able = min(limit, n_able)
    passes = max(1, -(-n_able // CANDIDATES))
    stats = None
    for k in range(passes):                          # at most about CANDIDATES terms are sent to the tasks at a time
        mine = able.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)
        got = term_stats(rows, n_max, {r["term"] for r in mine.collect()})
        stats = got if stats is None else stats.unionByName(got)
    return stats.orderBy(F.desc("cf"), F.asc("term")).limit(limit)


def tfidf(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row, term, idx, value): L2-normalised tf-idf over vocabulary terms."""
    w = tf.join(vocab.select("term", "idx", "idf"), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row")))
    return w.select("row", "term", "idx", (F.col("w") / norm).alias("value"))


def _held_terms(vocab: DataFrame) -> dict[str, tuple[int, float]] | None:
    """term -> (idx, idf) of a vocabulary that every task can hold, else None."""
    found = vocab.select("term", "idx", "idf").limit(CANDIDATES + 1).toArrow()
    if found.num_rows > CANDIDATES:
        return None
    terms, idx, idf = (found.column(c).to_pylist() for c in ("term", "idx", "idf"))
    return dict(zip(terms, zip(idx, idf, strict=True), strict=True))


@dataclass
class FittedFeatures:
    vocab: DataFrame        # term, idx, df, cf, idf
    pos_vocab: DataFrame    # term, idx, df, cf, idf
    kept: DataFrame | None  # col, fidx
    n_vocab: int
    n_pos: int
    left: int
    right: int
    include_bow: bool
    ngram_max: int

    @property
    def block_offsets(self) -> dict[str, int]:
        v, p, span = self.n_vocab, self.n_pos, self.left + self.right + 1
        offs = {"bow_before": 0, "bow_after": v}
        for k, d in enumerate(range(-self.left, self.right + 1)):
            offs[f"word_{d}"] = 2 * v + k * v
            offs[f"pos_{d}"] = 2 * v + span * v + k * p
        return offs

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.pos_vocab.write.mode("overwrite").parquet(f"{path}/pos_vocab")
        self.kept.write.mode("overwrite").parquet(f"{path}/kept_columns")
        meta = pd.DataFrame([{"n_vocab": self.n_vocab, "n_pos": self.n_pos, "left": self.left, "right": self.right,
                              "include_bow": self.include_bow, "ngram_max": self.ngram_max}])
        self.vocab.sparkSession.createDataFrame(meta).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> FittedFeatures:
        m = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/pos_vocab"),
                   spark.read.parquet(f"{path}/kept_columns"), int(m["n_vocab"]), int(m["n_pos"]),
                   int(m["left"]), int(m["right"]), bool(m["include_bow"]), int(m["ngram_max"]))


class PositionalFeatures:
    """fit / transform / fit_transform over prepared rows (see ``prepare_rows``).

    The fit reads the words of the training rows, first for the vocabularies,
    then for the columns that occur; no value is computed for it. The transform
    keeps one record per (row, vocabulary term) and one per (row, tag), and
    norms are sums over a row's records. Vocabulary joins carry no hint: the
    engine broadcasts a vocabulary whose measured bytes are small and shuffles
    otherwise."""

    def __init__(self, left: int = 2, right: int = 2, include_bow: bool = False,
                 max_features: int | None = 3000, ngram_range: tuple[int, int] = (1, 1)):
        if ngram_range[0] != 1:
            raise ValueError("ngram ranges must start at 1")
        if left + right + 1 > 63:
            raise ValueError("a window has at most 63 positions")
        self.left, self.right, self.include_bow = left, right, include_bow
        self.max_features, self.ngram_max = max_features, ngram_range[1]

    def occurrences(self, rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        return occurrences(rows, self.ngram_max, carry)

    def vocabulary(self, train_rows: DataFrame, n_rows: int) -> DataFrame:
        """(term, idx, df, cf, idf) of the text."""
        words = train_rows.select(F.array_join("words", " "))
        stats = term_stats(words, self.ngram_max) if self.max_features is None else \
            top_terms(words, self.ngram_max, self.max_features)
        return _index_vocab(stats, n_rows)

    def fit(self, train_rows: DataFrame) -> FittedFeatures:
        """Vocabularies and kept columns; ``train_rows`` are read several times."""
        n_rows = train_rows.count()
        vocab = self.vocabulary(train_rows, n_rows)                   # checkpointed by its index
        pos_vocab = _index_vocab(term_stats(train_rows.select(F.array_join("tags", " ")), 1), n_rows)
        fitted = FittedFeatures(vocab, pos_vocab, None, vocab.count(), pos_vocab.count(), self.left, self.right,
                                self.include_bow, self.ngram_max)
        fitted.kept = sorted_index(self._columns(train_rows, fitted), ["col"], "fidx")
        return fitted

    def _word_places(self, rows: DataFrame, carry: list[str]) -> DataFrame:
        """(carry..., verb_idx, p, term, tag): the words of rows with their place."""
        z = F.arrays_zip(F.col("words").alias("term"), F.col("tags").alias("tag"))
        return rows.select(*carry, "verb_idx", F.posexplode(z).alias("p", "z")).select(
            *carry, "verb_idx", "p", F.col("z.term").alias("term"), F.col("z.tag").alias("tag"))

    def _window(self) -> Column:
        """The bit of a word's window position; 0 outside the window."""
        bits = F.array(*[F.lit(1 << k).cast("long") for k in range(self.left + self.right + 1)])
        return F.coalesce(F.get(bits, F.col("p") - F.col("verb_idx") + self.left), F.lit(0).cast("long"))

    def _positions(self, bits: Column) -> Column:
        """Window positions (from 0) whose bit is set."""
        every = F.sequence(F.lit(0), F.lit(self.left + self.right))
        return F.filter(every, lambda k: F.getbit(bits, k) == 1)

    def _text_counts(self, records: list[tuple], known: dict[str, tuple[int, float]]) -> tuple[list[tuple], int]:
        """(term, idx, value, nb, na, bits) of the known terms of a row, and the window bits of all its words."""
        left, span, n_max = self.left, self.left + self.right + 1, self.ngram_max
        acc: dict[str, list[int]] = {}
        for words, verb, *_ in records:
            every = _terms(words, n_max)
            single = words.count(" ") + 1 if words else 0
            for p, t in enumerate(every):
                if t in known:
                    a = acc.setdefault(t, [0, 0, 0, 0])
                    a[0] += 1
                    if p < single and verb is not None:
                        a[1] += p < verb
                        a[2] += p > verb
                        if 0 <= p - verb + left < span:
                            a[3] |= 1 << p - verb + left
        weights = [a[0] * known[t][1] for t, a in acc.items()]
        norm = math.sqrt(math.fsum(w * w for w in weights))
        held = 0
        for a in acc.values():
            held |= a[3]
        return [(t, known[t][0], w / norm, *a[1:]) for (t, a), w in zip(acc.items(), weights, strict=True)], held

    def _tag_counts(self, records: list[tuple], known: dict[str, tuple[int, float]]) -> list[tuple]:
        """(idx, value, bits) of the known tags of a row."""
        left, span = self.left, self.left + self.right + 1
        counts: Counter = Counter()
        bits: Counter = Counter()
        for _, verb, tags in records:
            counts.update(tags or ())
            for k in range(span if verb is not None else 0):
                if 0 <= verb - left + k < len(tags or ()):
                    bits[tags[verb - left + k]] |= 1 << k
        mine = [(t, n * known[t][1]) for t, n in counts.items() if t in known]
        norm = math.sqrt(math.fsum(w * w for _, w in mine))
        return [(known[t][0], w / norm, bits[t]) for t, w in mine]

    def _present(self, rows: DataFrame, fitted: FittedFeatures, terms: dict, tags: dict) -> DataFrame:
        """``_columns`` with vocabularies that tasks hold: every task tells its columns once."""
        v, p, left, span, bow = fitted.n_vocab, fitted.n_pos, self.left, self.left + self.right + 1, self.include_bow

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before: set[str] = set()
            after: set[str] = set()
            near: set[int] = set()
            for batch in batches:
                for words, verb, tagged in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if verb is None:
                        continue
                    words = words.split(" ") if words else []
                    if bow:
                        before.update(words[:max(verb, 0)])
                        after.update(words[max(verb + 1, 0):])
                        if len(before) + len(after) > LOCAL_TERMS:
                            before, after = before & terms.keys(), after & terms.keys()
                    for k in range(span):
                        at = verb - left + k
                        if 0 <= at < len(words) and words[at] in terms:
                            near.add(2 * v + k * v + terms[words[at]][0])
                            tag = (tagged or ())[at] if at < len(tagged or ()) else None
                            if tag in tags:
                                near.add(2 * v + span * v + k * p + tags[tag][0])
            near.update(terms[t][0] for t in before & terms.keys())
            near.update(v + terms[t][0] for t in after & terms.keys())
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64())], names=["col"])
        return rows.select(F.array_join("words", " "), "verb_idx", "tags").mapInArrow(run, "col long").distinct()

    def _columns(self, rows: DataFrame, fitted: FittedFeatures) -> DataFrame:
        """(col): the unpruned columns that some row has a cell in. Presence only: every cell is above zero."""
        terms, known_tags = _held_terms(fitted.vocab), _held_terms(fitted.pos_vocab)
        if terms is not None and known_tags is not None:
            return self._present(rows, fitted, terms, known_tags)
        v, p, span = fitted.n_vocab, fitted.n_pos, self.left + self.right + 1
        d = F.col("p") - F.col("verb_idx")
        words = self._word_places(rows, []).select(
            "term", "tag", self._window().alias("bit"), (d < 0).alias("b"), (d > 0).alias("a"))
        if not self.include_bow:
            words = words.where("bit <> 0")
        tv = fitted.vocab.select("term", F.col("idx").alias("widx"))
        seen = words.join(tv, "term").groupBy("widx").agg(
            F.bit_or("bit").alias("bits"), F.max("b").alias("b"), F.max("a").alias("a"))
        none = F.array().cast("array<long>")
        cols = F.transform(self._positions(F.col("bits")), lambda k: 2 * v + k * v + F.col("widx"))
        if self.include_bow:
            cols = F.concat(cols, F.when(F.col("b"), F.array("widx")).otherwise(none),
                            F.when(F.col("a"), F.array(v + F.col("widx"))).otherwise(none))
        pv = fitted.pos_vocab.select(F.col("term").alias("tag"), F.col("idx").alias("pidx"))
        tags = words.where("bit <> 0").join(tv.select("term"), "term").join(pv, "tag").groupBy("pidx").agg(
            F.bit_or("bit").alias("bits"))
        pos = F.transform(self._positions(F.col("bits")), lambda k: 2 * v + span * v + k * p + F.col("pidx"))
        return seen.select(F.explode(cols.cast("array<long>")).alias("col")).unionByName(
            tags.select(F.explode(pos.cast("array<long>")).alias("col")))

    def term_values(self, rows: DataFrame, vocab: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """One record per (row, vocabulary term): ``idx``, tf-idf ``value``, and of the single word its counts
        ``nb`` before and ``na`` after the verb and its window ``bits``; ``held``: bits of all terms of the row."""
        carry = [c for c in carry if c in rows.columns]
        known = None if carry else _held_terms(vocab)
        if known is not None:
            return self._held_values(rows, known)
        z = ngrams(F.col("words"), self.ngram_max)
        o = rows.select("row", *carry, "verb_idx", F.size("words").alias("_nw"), F.posexplode(z).alias("p", "term"))
        single = F.col("p") < F.col("_nw")
        d = F.col("p") - F.col("verb_idx")
        t = o.join(vocab.select("term", "idx", "idf"), "term").groupBy("row", *carry, "term", "idx", "idf").agg(
            F.count(F.lit(1)).alias("tf"), F.count_if(single & (d < 0)).alias("nb"),
            F.count_if(single & (d > 0)).alias("na"),
            F.bit_or(F.when(single, self._window()).otherwise(F.lit(0).cast("long"))).alias("bits"))
        w = F.col("tf") * F.col("idf")
        per_row = Window.partitionBy("row")
        return t.withColumn("held", F.bit_or("bits").over(per_row)) \
            .withColumn("value", w / F.sqrt(F.sum(w * w).over(per_row)))

    def _held_values(self, rows: DataFrame, known: dict[str, tuple[int, float]]) -> DataFrame:
        """``term_values`` with a vocabulary that tasks hold: rows are shuffled whole, not their terms."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, groups in _row_groups(batches):
                made = [self._text_counts(g, known) for g in groups]
                at = np.repeat(np.arange(len(made)), [len(m) for m, _ in made])
                cells = list(zip(*(x for m, _ in made for x in m), strict=True)) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), *[pa.array(c, k) for c, k in zip(cells, kinds, strict=True)],
                     pa.array([held for m, held in made for _ in m], pa.int64())], names=schema.names)
        schema = StructType([rows.schema["row"], StructField("term", StringType()), StructField("idx", LongType()),
                             StructField("value", DoubleType()), *[StructField(n, LongType()) for n in (
                                 "nb", "na", "bits", "held")]])
        return _by_row(rows, F.coalesce(F.array_join("words", " "), F.lit("")), F.col("verb_idx")).mapInArrow(run, schema)

    def _held_cells(self, rows: DataFrame, fitted: FittedFeatures, terms: dict, tags: dict) -> DataFrame:
        """``raw_cells`` with vocabularies that tasks hold."""
        v, p, span, bow = fitted.n_vocab, fitted.n_pos, self.left + self.right + 1, self.include_bow

        def cells(records: list[tuple]) -> Iterator[tuple[int, float]]:
            found, held = self._text_counts(records, terms)
            for _, idx, value, nb, na, bits in found:
                if bow and nb:
                    yield idx, value * nb
                if bow and na:
                    yield v + idx, value * na
                for k in range(span if bits else 0):
                    if bits >> k & 1:
                        yield 2 * v + k * v + idx, value
            for idx, value, bits in self._tag_counts(records, tags) if held else ():
                for k in range(span):
                    if bits & held & 1 << k:
                        yield 2 * v + span * v + k * p + idx, value

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, groups in _row_groups(batches):
                made = [list(cells(g)) for g in groups]
                at = np.repeat(np.arange(len(made)), [len(m) for m in made])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(at)), pa.array([c for m in made for c, _ in m], pa.int64()),
                     pa.array([x for m in made for _, x in m], pa.float64())], names=schema.names)
        schema = StructType([rows.schema["row"], StructField("col", LongType()), StructField("value", DoubleType())])
        return _by_row(rows, F.coalesce(F.array_join("words", " "), F.lit("")), F.col("verb_idx"), F.col("tags")) \
            .mapInArrow(run, schema)

    def tag_values(self, rows: DataFrame, fitted: FittedFeatures) -> DataFrame:
        """One record per (row, known tag): ``idx``, tf-idf ``value``, window ``bits``."""
        words = self._word_places(rows, ["row"])
        pv = fitted.pos_vocab.select(F.col("term").alias("tag"), "idx", "idf")
        t = words.groupBy("row", "tag").agg(F.count(F.lit(1)).alias("tf"), F.bit_or(self._window()).alias("bits")) \
            .join(pv, "tag")
        w = F.col("tf") * F.col("idf")
        return t.withColumn("value", w / F.sqrt(F.sum(w * w).over(Window.partitionBy("row"))))

    def raw_cells(self, rows: DataFrame, fitted: FittedFeatures, carry: tuple[str, ...] = ()) -> DataFrame:
        """(row, carry..., col, value) before column pruning. ``carry`` columns must be functions of the row."""
        v, p, span = fitted.n_vocab, fitted.n_pos, self.left + self.right + 1
        carry = [c for c in carry if c in rows.columns]
        held = (None, None) if carry else (_held_terms(fitted.vocab), _held_terms(fitted.pos_vocab))
        if None not in held:
            return self._held_cells(rows, fitted, *held)

        def cells(places: Column, col: Callable[[Column], Column]) -> Column:
            return F.transform(places, lambda k: F.struct(col(k).cast("long").alias("col"), F.col("value")))
        terms = self.term_values(rows, fitted.vocab, tuple(carry))
        made = cells(self._positions(F.col("bits")), lambda k: 2 * v + k * v + F.col("idx"))
        if self.include_bow:
            none = F.array().cast("array<struct<col:bigint,value:double>>")
            for n, start in (("nb", 0), ("na", v)):
                one = F.array(F.struct((F.col("idx") + start).cast("long").alias("col"),
                                       (F.col("value") * F.col(n)).alias("value")))
                made = F.concat(made, F.when(F.col(n) > 0, one).otherwise(none))
        words = terms.select("row", *carry, F.explode(made).alias("c"))
        # a position has a POS cell where its word is in the vocabulary
        held = terms.groupBy("row", *carry).agg(F.first("held").alias("held")).where("held <> 0")
        tags = self.tag_values(rows, fitted).where("bits <> 0").join(held, "row").select("row", *carry, F.explode(cells(
            self._positions(F.col("bits").bitwiseAND(F.col("held"))),
            lambda k: 2 * v + span * v + k * p + F.col("idx"))).alias("c"))
        return words.unionByName(tags).select("row", *carry, F.col("c.col").alias("col"), F.col("c.value").alias("value"))

    def text_tfidf(self, rows: DataFrame, vocab: DataFrame) -> DataFrame:
        """(row, term, idx, value) per distinct vocabulary term of a row."""
        return self.term_values(rows, vocab).select("row", "term", "idx", "value")

    def transform(self, rows: DataFrame, fitted: FittedFeatures) -> DataFrame:
        cells = self.raw_cells(rows, fitted)
        return cells.join(fitted.kept, "col").select("row", F.col("fidx").alias("col"), "value")

    def landed(self, rows: DataFrame) -> DataFrame:
        """Prepared rows written once to the checkpoint folder: fit and transform read them several times."""
        from evtab.session import checkpoint_dir
        at = checkpoint_dir(rows.sparkSession, fallback=_local_fallback(rows.sparkSession)).rstrip("/")
        path = f"{at}/evtab-rows-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def fit_transform(self, rows: DataFrame, is_train: Column) -> tuple[FittedFeatures, DataFrame, DataFrame]:
        """Fit on the rows where ``is_train`` holds, transform all rows.
        Returns (fitted, cells, rows as written to the checkpoint folder)."""
        rows = self.landed(rows.withColumn("_train", is_train))
        fitted = self.fit(rows.filter(F.col("_train")))
        return fitted, self.transform(rows, fitted), rows


def feature_shape(rows: DataFrame, fitted: FittedFeatures, by: str = "split") -> DataFrame:
    n_cols = fitted.kept.count()
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(n_cols).cast("long"))


def class_weights(rows: DataFrame, label: str = "label", sample_weight: str | None = None,
                  out: str = "weight") -> DataFrame:
    """Balanced class weight n / (classes x class count), times the sample
    weight when given."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy()   # one row per class: a tiny, bounded window
    cw = counts.select(label, (F.sum("_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("_c"))).alias("__cw"))
    out_df = rows.join(F.broadcast(cw), label)   # one row per class
    w = F.col("__cw") * F.col(sample_weight) if sample_weight else F.col("__cw")
    return out_df.withColumn(out, w).drop("__cw")


def predict_linear(rows: DataFrame, cells: DataFrame, weights: DataFrame, bias: float) -> DataFrame:
    """score = w.x + b over the long cells (rows without cells score b);
    pred = int(score > 0). ``weights``: (col, w)."""
    s = cells.join(weights, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("w")).alias("_s"))
    out = rows.join(s, "row", "left").withColumn("score", F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(bias))
    return out.withColumn("pred", (F.col("score") > 0).cast("int")).drop("_s")
