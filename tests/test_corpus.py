"""Column-format files: reading, decoding, parsing, event contexts (C8, C9, C16)."""

import os

import pytest

from pyspark.sql import functions as F

from evtab.operators import corpus
from evtab.sources.corpus import parse_col, read_col_corpus


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_read_col_corpus_decodes_and_filters(spark, tmpdir_path):  # C9
    root = tmpdir_path
    write(f"{root}/TB_FR_col/train/doc1.col", "DCT\t2020\nLe\t1\t1\tO\nchat\t2\t1\te1\n".encode())
    write(f"{root}/TB_FR_col/train/doc2.col", b"Un\t1\t1\tO\r\nbad\xff\t2\t1\te2\r\n")
    write(f"{root}/TB_FR_col/train/notes.txt", b"ignored")
    write(f"{root}/TB_FR_col/test/my.doc.col", b"x\t1\t1\tO\n")
    df = read_col_corpus(spark, root, {"TB_FR_col": "fr"})
    got = {r.docid: (r.split, r.lang, r.text) for r in df.collect()}
    assert set(got) == {"doc1", "doc2", "my.doc"}
    assert got["doc2"][2] == "Un\t1\t1\tO\nbad\t2\t1\te2\n"
    assert got["my.doc"][0] == "test"
    rows = parse_col(df).filter(F.col("docid") == "doc1").orderBy("tok_pos").collect()
    assert [(r.token, r.tokenid, r.sentid, r.eventid) for r in rows] == [("Le", "1", "1", "O"), ("chat", "2", "1", "e1")]


def test_parse_layouts(spark):
    txt_full = "DCT x\n a \t1\ts1\tO\nb\t2\ts1\te1\n\nc\t1\ts2\te2"
    txt_shr = "s1\t1\tuno\tO\ns1\t2\tdos\te5"
    df = spark.createDataFrame([("d1", "it", "train", txt_full), ("d2", "es", "train", txt_shr)],
                               "docid string, lang string, split string, text string")
    rows = parse_col(df).orderBy("docid", "sent_pos", "tok_pos").collect()
    got = [(r.docid, r.sent_pos, r.tok_pos, r.token, r.raw_token, r.sentid, r.eventid) for r in rows]
    assert got == [("d1", 0, 0, "a", "a ", "s1", "O"), ("d1", 0, 1, "b", "b", "s1", "e1"),
                   ("d1", 1, 0, "c", "c", "s2", "e2"),
                   ("d2", 0, 0, "uno", "uno", "s1", "O"), ("d2", 0, 1, "dos", "dos", "s1", "e5")]


def tokens_df(spark):
    rows = []
    sent = ["Il", "a", "mangé", "et", "bu", "hier"]
    ev = ["", "e1", "e1", "", "e2", "e3"]
    pos = ["PRON", "AUX", "VERB", "CCONJ", "VERB", "ADV"]
    for i, (t, e, p) in enumerate(zip(sent, ev, pos)):
        rows.append(("fr", "train", "d", 0, i, t, e, p))
    return spark.createDataFrame(rows, "lang string, split string, docid string, sent_pos int, tok_pos int, "
                                       "token string, eventid string, pos string")


def test_event_contexts_rebuild_sentence(spark):
    out = corpus.event_contexts(tokens_df(spark)).orderBy("tok_pos").collect()
    assert [(r.eventid, r.verb) for r in out] == [("e1", "a"), ("e1", "mangé"), ("e2", "bu")]
    for r in out:
        assert " ".join(x for x in [r.before, r.verb, r.after] if x) == "Il a mangé et bu hier"
        assert r.label is None and r.label_confidence == 1.0


def test_first_mention_keeps_first_token(spark):
    fm = corpus.first_mention(corpus.event_contexts(tokens_df(spark))).orderBy("eventid").collect()
    assert [(r.eventid, r.tok_pos, r.verb) for r in fm] == [("e1", 1, "a"), ("e2", 4, "bu")]


def test_annotate_lexicon_keeps_rows_and_morph(spark):
    toks = tokens_df(spark).drop("pos")
    lex = spark.createDataFrame([("fr", "mangé", "VERB", {"Tense": "Past,Imp", "VerbForm": "Part"}),
                                 ("fr", "mangé", "VERB", {"Tense": "Past,Imp", "VerbForm": "Part"}),
                                 ("fr", "a", "AUX", {"Mood": "Ind"})],
                                "lang string, token string, pos string, morph map<string,string>")
    other = spark.createDataFrame([("fr", "a", "NOUN", {})], lex.schema)
    with pytest.raises(Exception, match="two lexicon entries"):
        corpus.annotate_lexicon(toks, lex.unionByName(other)).collect()
    out = corpus.morph_tags(corpus.annotate_lexicon(toks, lex)).orderBy("tok_pos").collect()
    assert len(out) == 6
    assert [r.pos for r in out] == ["X", "AUX", "VERB", "X", "X", "X"]
    assert (out[2].Tense, out[2].VerbForm, out[2].Mood) == ("Past", "Part", "")
    assert out[1].Mood == "Ind"


def test_annotate_sentences_custom_tagger(spark):
    def tagger(tokens):
        return [("VERB" if t.endswith("é") else "X", {"Tense": "Past"} if t.endswith("é") else {}) for t in tokens]
    out = corpus.annotate_sentences(tokens_df(spark).drop("pos"), tagger).orderBy("tok_pos").collect()
    assert [r.pos for r in out] == ["X", "X", "VERB", "X", "X", "X"]


def test_annotate_sentences_count_check(spark):
    import pytest

    def bad(tokens):
        return [("X", {})]
    with pytest.raises(Exception, match="annotator returned"):
        corpus.annotate_sentences(tokens_df(spark).drop("pos"), bad).collect()


def test_corpus_events_from_files(spark, tmpdir_path):
    root = tmpdir_path
    write(f"{root}/TB_IT_col/train/a.col",
          "DCT\t2001\nIl\t1\ts1\tO\nha\t2\ts1\te1\ndetto\t3\ts1\te1\nciao\t4\ts1\tO\n\nVa\t1\ts2\te2\n".encode())
    files = read_col_corpus(spark, root, {"TB_IT_col": "it"})
    lex = spark.createDataFrame([("it", "ha", "AUX", {"Tense": "Pres"}), ("it", "detto", "VERB", {}),
                                 ("it", "Va", "VERB", {"Mood": "Ind,Imp"})],
                                "lang string, token string, pos string, morph map<string,string>")
    out = corpus.corpus_events(files, lexicon=lex).orderBy("eventid").collect()
    got = [(r.eventid, r.verb, r.pos, r.before, r.after, r.tokenid, r.sentid, r.Tense, r.Mood) for r in out]
    assert got == [("e1", "ha", "AUX", "Il", "detto ciao", "2", "s1", "Pres", ""),
                   ("e2", "Va", "VERB", "", "", "1", "s2", "", "Ind")]
