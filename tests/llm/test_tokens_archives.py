"""BPE against the tokenizers library, WARC archives by round trip."""

import base64
import hashlib
import io
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from evtab.llm import bpe, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", " ", "  ", "\n", "\t", "the", "'s", "'ll", "é", "ß", "1", "23", "½", "Ⅷ", "<|endoftext|>", "\x1c", "\x85",
         " ", "　", "\xa0", "中文", "😀", "aaaa", "!!", "$", "_", "​", "́", "٣", "ing", "I'm",
         "\r\n", "<|endof", "Word,", "x.y"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_agrees_with_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 15))) for _ in range(4000)]
    texts += ["a" * 4000, " " * 2500 + "x", "\n" * 700, "", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000))]
    c = bpe.codec(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = c.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want.ids
        assert c.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_automaton_of_a_tiny_vocabulary():
    vocab = {"a": 0, "b": 1, "ab": 2, "aa": 3, "aab": 4}
    auto = bpe.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b")])
    assert auto.encode_word(b"aaa") == [3, 0]      # the leftmost pair merges first
    assert auto.encode_word(b"aab") == [4]
    assert auto.encode_word(b"aaab") == [3, 2]
    assert auto.encode_word(b"bab") == [1, 2]
    with pytest.raises(ValueError):
        auto.encode_word(b"c")
    with pytest.raises(ValueError):
        bpe.Automaton(vocab, [("aa", "b"), ("a", "a")])


def test_tables_restart_without_changing_results(monkeypatch, library):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 3)
    c = bpe.Codec(PATH)
    text = "one two three four five six one two three, four."
    assert np.frombuffer(c.encode(text), "<u4").tolist() == library.encode(text).ids


def test_encode_decode_rows(spark, library):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 5), (2, None, 6), (3, "", 7), (None, "x " * 30000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_decode(df, PATH, decoded=True).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3]
    for r in got:
        text = {1: "Hello  world", 2: "", 3: "", None: "x " * 30000}[r.doc_id]
        ids = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert bytes(r.token_ids) == ids and r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


PAGES = [(5, "http://a.example/x", "<p>same</p>"), (2, "http://a.example/y", "<p>same</p>"), (9, None, "<p>same</p>"),
         (3, "http://ü.example/a b\r\nc", None), (4, "", ""), (7, "u%20v", "x" * 300_000), (8, "w", "other"),
         (8, "w", "other"), (None, "n", "<p>same</p>"), (None, "n", "lonely")]


def test_archives_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("path", __import__(
        "pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    manifest = warc.write_archives(warc.with_revisits(df), f"file://{tmpdir_path}/out", archive_bytes=2000).cache()
    got = warc.read_archives(manifest, payload=True).collect()
    assert sum(r.records for r in manifest.collect()) == len(PAGES) == len(got)
    first = {"<p>same</p>": 2, "": 3, "x" * 300_000: 7, "other": 8}
    left = sorted(((p, u, h or "") for p, u, h in PAGES), key=str)
    for r in got:
        body = next(h for p, u, h in left if (p, u) == (r.page_id, r.url) and warc.digest(h.encode()) == r.payload_digest)
        left.remove((r.page_id, r.url, body))
        assert r.payload_bytes == len(body.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        lead = first.get(body)
        assert r.refers_to == (None if lead is None or lead == r.page_id else lead)
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        assert bytes(r.payload) == (body.encode() if r.record_type == "response" else b"")
    assert not left
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_smaller_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long one"), (4, "d", "long one")],
                               "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def archive(records, dictionary=b"some words that repeat"):
    zstd = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    lead = struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary
    return lead + b"".join(zstd.compress(r) for r in records)


def test_reader_rejects_what_is_wrong():
    good = warc.build_record(1, "http://a.example", b"payload", None)
    assert [warc.parse_record(r)["payload"] for r in warc.read_frames(io.BytesIO(archive([good, good])))] == [b"payload"] * 2
    packed = zstandard.ZstdCompressor().compress(b"some words that repeat")
    raw = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + archive([good])[8 + 22:]
    assert list(warc.read_frames(io.BytesIO(raw))) == [good]
    for bad in (archive([good])[:-3], archive([good])[8:], archive([good])[:6]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_frames(io.BytesIO(bad)))
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"payload\r\n\r\n", b"payloaD\r\n\r\n"), (b"WARC-Date", b"Date"),
                     (b"\r\nContent-Length: 8", b"\r\nContent-Length: 9"), (b"payload\r\n\r\n", b"payload\r\n"),
                     (b"WARC-Type: response", b"WARC-Type: other")):
        broken = good.replace(old, new)
        if broken == good:
            broken = good[:-1]
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(broken)
