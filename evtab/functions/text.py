"""Text scalars as built-in Column expressions (JVM side, whole-stage codegen).

Python's ``str.split()`` / ``re`` and Java regex disagree on whitespace and on
what ``.`` matches; the patterns below are the ones that give Python's answers
on the JVM, kept in one place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) -------------------
# Token replacements, applied in this order.
QUOTE_REPLACEMENTS = [
    ("``", '"'),
    ("''", '"'),
    ("-LRB-", "("),
    ("-RRB-", ")"),
]
# Python whitespace = Unicode White_Space plus the four separators U+001C..U+001F.
WS_CLASS = r"[\s\x1c-\x1f]"
# (?U) turns \s into Unicode White_Space in Java regex.
WS_SPLIT = r"(?U)" + WS_CLASS + "+"
# Markup tag, non-greedy; '.' in Python excludes only '\n', so spell it out.
TAG_PATTERN = "<[^\n]+?>"
# One leading date line: optional whitespace, 'DCT', rest of the line.
DCT_PATTERN = r"(?U)\A" + WS_CLASS + "*DCT[^\n]*?\n"
# The characters of Python's str.strip().
STRIP_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_tokens(c) -> Column:
    """Python ``s.split()``: split on any Unicode whitespace, no empty tokens."""
    return F.filter(F.split(_c(c), WS_SPLIT), lambda x: x != "")


def py_strip(c) -> Column:
    """Python ``s.strip()`` (Unicode whitespace, both ends)."""
    return F.trim(_c(c), F.lit(STRIP_CHARS))


def normalize_quotes(c) -> Column:
    out = _c(c)
    for old, new in QUOTE_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def strip_tags(c) -> Column:
    return F.regexp_replace(_c(c), TAG_PATTERN, "")


def remove_spaces(c) -> Column:
    """Removes U+0020 only, like ``str.replace(' ', '')``."""
    return F.replace(_c(c), F.lit(" "), F.lit(""))


def strip_header(c) -> Column:
    """strip, drop one leading ``DCT...`` line, strip again."""
    text = py_strip(_c(c))
    return F.when(text.startswith("DCT"), py_strip(F.regexp_replace(text, DCT_PATTERN, ""))).otherwise(text)


def mark_target(before, verb, after) -> Column:
    """``f'{left} [ {verb} ] {right}'.split()`` with quotes normalised on the sides."""
    return ws_tokens(F.concat_ws(" ", normalize_quotes(F.coalesce(_c(before), F.lit(""))), F.lit("["),
                                 F.coalesce(_c(verb), F.lit("")), F.lit("]"),
                                 normalize_quotes(F.coalesce(_c(after), F.lit("")))))


def plain_input(before, verb, after) -> Column:
    """``f'{left} {verb} {right}'.split()`` (no brackets)."""
    return ws_tokens(F.concat_ws(" ", normalize_quotes(F.coalesce(_c(before), F.lit(""))),
                                 F.coalesce(_c(verb), F.lit("")),
                                 normalize_quotes(F.coalesce(_c(after), F.lit("")))))


def target_index(before, brackets: bool = False) -> Column:
    """Index of the target word: token count of ``before`` (+1 after '[')."""
    n = F.size(ws_tokens(F.coalesce(_c(before), F.lit(""))))
    return (n + 1) if brackets else n


def tokens_md5(tokens) -> Column:
    """Stable fingerprint of a token array (tokens joined by one space)."""
    return F.md5(F.array_join(_c(tokens), " "))


def label_suffix(c) -> Column:
    """'TGT-1' -> '1'; 'O' -> null."""
    return F.when(_c(c) == "O", F.lit(None).cast("string")).otherwise(F.get(F.split(_c(c), "-"), 1))
