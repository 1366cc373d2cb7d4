"""Text scalars against Python's own string semantics (property tests)."""

import re

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evtab.functions import text as T

WS_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　"
ALPHABET = st.sampled_from(list("ab`'-LRB()[]<>DCTé") + list(WS_CHARS))


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(expr(F.col("s")).alias("o")).first().o


def many(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", expr(F.col("s")).alias("o")).orderBy("i").collect()]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=40))
def test_ws_tokens_is_python_split(spark, values):
    assert many(spark, T.ws_tokens, values) == [v.split() for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=40))
def test_py_strip_is_python_strip(spark, values):
    assert many(spark, T.py_strip, values) == [v.strip() for v in values]


@pytest.mark.parametrize("given,want", [("`` x ''", '" x "'), ("'''", '"\''), ("-LRB- a -RRB-", "( a )"),
                                        ("````", '""'), ("''''x", '""x')])
def test_normalize_quotes_in_order(spark, given, want):  # C7
    assert one(spark, T.normalize_quotes, given) == want


@pytest.mark.parametrize("given,want", [("DCT 2020\na\tb\n\nc", "a\tb\n\nc"), ("  \n DCT x\nrest", "rest"),
                                        ("a\nDCT mid\nb", "a\nDCT mid\nb"), ("DCT only", "DCT only"),
                                        ("\u3000DCT x\ny", "y")])
def test_strip_header_only_first(spark, given, want):  # C8
    assert one(spark, T.strip_header, given) == want


@pytest.mark.parametrize("given,want", [("<a>b</a>", "b"), ("a<x\ny>b", "a<x\ny>b"), ("<>c>", ""),
                                        ("x<a\u2028b>y", "xy"), ("no tags", "no tags")])
def test_strip_tags(spark, given, want):
    assert one(spark, T.strip_tags, given) == want


def test_mark_target_and_index(spark):  # C6
    df = spark.createDataFrame([("", "v", ""), ("a  b", "v", "c ``d''"), (None, "v", None)],
                               "before string, verb string, after string")
    out = df.select(T.mark_target("before", "verb", "after").alias("m"),
                    T.target_index("before").alias("t"), T.target_index("before", True).alias("tb")).collect()
    assert out[0].m == ["[", "v", "]"] and out[0].t == 0 and out[0].tb == 1
    assert out[1].m == ["a", "b", "[", "v", "]", "c", '"d"'] and out[1].t == 2 and out[1].tb == 3
    assert out[2].m == ["[", "v", "]"] and out[2].t == 0
