"""Sharding, mixing, page text and the pipeline: laws, brute force, edge rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evtab.llm import htmltext, language, mixing, neardup, shards, toxicity
from evtab.llm.util import landed

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def laws(got, rows, n):
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(200)]
    rows += [(1000 + i, f"copy {i // 4}") for i in range(120)]                 # groups that fit
    rows += [(2000 + i, "hot") for i in range(230)]                            # more than four shards hold
    rows += [(3000, None), (3001, ""), (3002, "é"), (None, "text 1"), (5, "text 5")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    got = shards.balanced_shards(df, 11).collect()
    laws(got, rows, 11)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    where = defaultdict(set)
    text = dict(rows)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(where[f"copy {k}"]) == 1 for k in range(30))
    assert len(where["hot"]) <= math.ceil(230 / (555 // 11)) + 1
    again = shards.balanced_shards(df.repartition(5), 11).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert shards.balanced_shards(df.limit(0), 3).count() == 0


def test_every_document_in_groups(spark):
    rows = [(i, f"t{i // 2}") for i in range(60)] + [(100 + i, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shards.balanced_shards(df, 7).collect()
    laws(got, rows, 7)


def test_propagation_moves_to_the_majority(spark):
    cells = spark.createDataFrame([(b"a", 0, 5), (b"a", 1, 2), (b"a", 2, 1), (b"b", 1, 1), (b"b", 2, 1)],
                                  "g binary, at int, n long")
    got = {(bytes(r.g), r["at"]): r.n for r in shards.propagate(cells, F.lit(10), 3).collect()}
    assert got[b"a", 0] == 8 and sum(v for (g, _), v in got.items() if g == b"b") == 2 and len(got) == 2
    tight = {(bytes(r.g), r["at"]): r.n for r in shards.propagate(cells, F.lit(6), 3).collect()}
    load = Counter()
    for (_, s), n in tight.items():
        load[s] += n
    assert max(load.values()) <= 6 and sum(load.values()) == 10 and tight[b"a", 0] == 6


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {k: i % 3 + 1 for i, k in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[k] for k in full)
        each = sum(w[k] for k in names if k not in full)
        t = {k: 3.0 * sizes[k] if k in full else rest * w[k] / each for k in names}
        over = {k for k in names if k not in full and t[k] > 3 * sizes[k] + 1e-9}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 3, None: 40, "é": 500, "Z": 0},
                                   {"x": 7}, {"a": 1, "b": 5000, "c": 1, "d": 1, "e": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_hypergeometric(spark):
    n = 4000
    df = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    for total, good, draws in ((30, 10, 12), (5, 5, 2), (9, 0, 4), (12, 7, 12), (40, 39, 20)):
        k = mixing.hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"),
                                  F.col("u"))
        got = Counter(r.k for r in df.select(k.alias("k")).collect())
        whole = math.comb(total, draws)
        for x in range(min(good, draws) + 1):
            p = math.comb(good, x) * math.comb(total - good, draws - x) / whole if draws - x <= total - good else 0
            assert abs(got[x] / n - p) < 0.002
    big = df.select(mixing.hypergeometric(F.lit(10 ** 9), F.lit(3 * 10 ** 8), F.lit(5 * 10 ** 8), F.lit(0.5)).alias("k"))
    assert abs(big.first().k - 1.5 * 10 ** 8) < 10_000


def test_split_tree(spark):
    quotas = {"a": 1000, "b": 17, "c": 1, None: 300, "d": 0}
    df = spark.createDataFrame(list(quotas.items()), "source string, blocks long")
    got = mixing.split_tree(df, 6).collect()
    per_shard, per_source = Counter(), Counter()
    for r in got:
        per_shard[r.shard] += r.blocks
        per_source[r.source] += r.blocks
    assert dict(per_source) == {k: v for k, v in quotas.items() if v}
    assert sorted(per_shard) == list(range(6)) and max(per_shard.values()) - min(per_shard.values()) <= 1
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: r.shard):
        assert r.first == ends[r.source]
        ends[r.source] += r.blocks
    assert mixing.split_tree(df.limit(0), 4).count() == 0
    assert abs([r.blocks for r in got if r.source == "a"][0] - 1000 / 6) < 40


def mix_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"s{i % 5}" if i % 3 else "s0", " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(300)]
    rows += [(400, None, "a\tb\nc  d\x0be"), (401, "s9", "lonely words"), (402, "s9", None), (403, "", "   "),
             (404, "s1", "w " * 5000), (404, "s1", "w " * 5000), (None, "s2", "no id")]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows],
                                       "doc_id long, source string, text string, n_chars long, bucket string")


def test_mix(spark):
    rows, df = mix_rows(spark)
    documents, blocks = mixing.mix(df, block_words=100, shards=4)
    docs, drawn = documents.collect(), blocks.collect()
    words = lambda t: len(WORD.findall(t)) if t else 0
    assert Counter((r.doc_id, r.source, r.size) for r in docs) == Counter((i, s, words(t)) for i, s, t in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in docs:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + r.part
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5 + 1e-6
        assert {r.source_size for r in docs if r.source == s} == {sizes[s]}
    by = Counter()
    for r in drawn:
        by[r.source] += r.words
    assert by == Counter({k: v for k, v in taken.items() if v})
    per_shard = defaultdict(list)
    for r in drawn:
        per_shard[r.shard].append(r.position)
    assert len(per_shard) == 4 and all(sorted(v) == list(range(len(v))) for v in per_shard.values())
    assert max(map(len, per_shard.values())) - min(map(len, per_shard.values())) <= 1
    assert len({(r.source, r.block, r["pass"]) for r in drawn}) == len(drawn)
    again, _ = mixing.mix(df.repartition(5), block_words=100, shards=4)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, docs))
    shown = mixing.with_shards(documents, blocks).collect()
    assert len(shown) == len(docs)
    assert all(len(r.shards) == (r.passes + (r.part > 0) if r.taken else 0) for r in shown)


def test_mixed_documents(spark):
    rows, df = mix_rows(spark)
    df = df.where("doc_id <> 404")                       # no repeated rows: counts are exact
    documents, _ = mixing.mix(df, block_words=100, shards=4)
    taken = {(r.doc_id, r.source): (r.passes, r.part, r.size) for r in documents.collect()}
    out = mixing.mixed(df, block_words=100, shards=4)
    assert out.columns == df.columns
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id, r.source].append(r.text)
    texts = {(i, s): t for i, s, t in rows}
    for k, (passes, part, size) in taken.items():
        if k[0] is None:
            continue
        want = [texts[k]] * passes if size else []
        if part:
            want.append(texts[k] if part == size else " ".join(WORD.findall(texts[k])[:part]))
        assert sorted(got[k]) == sorted(want)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", " ")], "doc_id long, source string, text string")
    documents, blocks = mixing.mix(df)
    assert {(r.size, r.source_size, r.target, r.taken) for r in documents.collect()} == {(0, 0, 0.0, 0)}
    assert blocks.count() == 0
    documents, blocks = mixing.mix(df.limit(0))
    assert documents.count() == 0 and blocks.count() == 0


def page(body, head="<title>t</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("source,want", [
    (None, ""), ("", ""), ("plain < text &amp; more", "plain < text & more"),
    (page("<nav><a>x</a></nav><article><h1>T &lt;1&gt;</h1><p><b>a\n b&nbsp;c<br>d<p>e</p></article><footer>f"),
     "T <1>\na b c d\ne"),
    (page('<div class="ad">buy</div><main><p>one</p><aside>two</aside><ul><li>three<li>four</ul></main>'),
     "one\nthree\nfour"),
    (page('<div class="wrap sidebar-left"><article><p>kept</p><div id="comments"><article>no</article></div>'
          '<form>no<select><option>no</select></form><p>end</article></div>'), "kept\nend"),
    (page('<article><p>a</p><section class="reader-comments"><p>no</p></section><!-- <p>no --><script>"</p>no"</script>'
          '<p>b<sup>2</sup></p></article>'), "a\nb2"),
    (page("<p>loose</p></div></article><p>ends<table><tr><td>c</td><td>d</td></tr></table>"), "loose\nends\nc\nd"),
    (page("<article>bare <em>text</em>&amp;lt;"), "bare text&lt;"),
])
def test_page_text(source, want):
    assert htmltext.extract_part([source])[0][0] == want


@pytest.mark.parametrize(("source", "want"), [
    ("<article><datalist><option value=a><option value=b></datalist><p>main text here</p></article>", "main text here"),
    ("<article><button>Buy<p>one</p><p>two</p></article>", "Buy\none\ntwo"),
    ("<article><p>see <button>Buy</button> this</p></article>", "see this"),
    ("<article><p>a<button><div>Buy</div></button>b</p></article>", "ab"),
    ('<article class="post comments-open"><p>all of it</p></article>', "all of it"),
    ('<article><div class="share-price">12 Euro</div><div class="notice-board">news</div><p>x</p></article>',
     "12 Euro\nnews\nx"),
    ('<article><div class="share-buttons">Tweet</div><div class="ad-slot-2">Buy</div><div id=siteFooter>c</div><p>x</p>'
     '<div class="comments-list">nice</div></article>', "x"),
    ("<p data-x=it's>one</p><p>two's three</p>", "one\ntwo's three"),
    ('<p title="a>hello</p><p>there</p>', "hello\nthere"),
    ("<p>one<p>two<ul><li>three<li>four</ul>five<table><tr><td>six<td>seven<tr><td>eight</table>",
     "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight"),
    ("<p>a < b &amp; c &lt;d&gt; <3</p></div></span><p>e", "a < b & c <d> <3\ne"),
    ("<head><title>t<p>no title end</p>", "t\nno title end"),
    ("<title>gone</title><p>kept</p><script>var a = '<p>no</p>'</script><p>more</p><textarea>t</textarea>", "kept\nmore"),
    ("<!-- <p>no</p> --><p>yes<!----> it is</p><?php x ?><![CDATA[ y ]]><p>end", "yes it is\nend"),
    ("<form><article><p>whole page in a form</p></article></form>", "whole page in a form"),
    ("<P CLASS=x/>Up<BR/>down</P>", "Up down"),
    ('<article><p>one <span class="ad">Buy</span> two</p></article>', "one\ntwo"),
    ("<p a='1' b = \"2>3\" c=4>x</p><p =x>y</p><p / >z", "x\ny\nz"),
])
def test_markup_as_browsers_read_it(source, want):
    assert htmltext.extract_part([source])[0][0] == want


@pytest.mark.parametrize("source", ["<script ", '<p a="x ', "<div>", "<span class=ad>", "</div>", "<b><div></b>", "<!--", "<p>",
                                    "<td><div><ul><li>", "<button>", "</td>", "<li>", "<title>", "<select><option>", "&amp",
                                    "<a b='", "<form><nav>", "<", "</", "<textarea></title>", "<x y=z"])
def test_broken_markup_is_read_in_linear_time(source):
    times = []
    for n in (50_000, 500_000):
        text = "<p>begin</p>" + source * (n // len(source)) + "<p>end"
        start = time.perf_counter()
        htmltext.parse(text)
        times.append(time.perf_counter() - start)
    assert times[1] < 2.0


def site(n, own="own"):
    return [page(f"<div><p>Home About Contact today now here</p></div><div><p>{own}{i} "
                 + " ".join(f"w{i}x{j}" for j in range(30))
                 + "</p><p>a sentence that all the pages hold inside</p></div><div>All rights of this site are reserved</div>")
            for i in range(n)]


def test_repeated_containers_go_without_any_markup():
    for i, (text, left) in enumerate(htmltext.extract_part(site(5))):
        assert text.startswith(f"own{i} ") and text.endswith("inside") and "reserved" not in text and left > 60
    two = htmltext.extract_part(site(2))
    assert all("reserved" in t for t, _ in two)          # two pages prove nothing


def test_copies_keep_their_article():
    same = page("<article><p>" + " ".join(f"v{j}" for j in range(50)) + "</p></article>")
    assert {t for t, _ in htmltext.extract_part([same] * 6)} == {" ".join(f"v{j}" for j in range(50))}
    bare = page("<div>" + " ".join(f"v{j}" for j in range(50)) + "</div>")
    assert {t for t, _ in htmltext.extract_part([bare] * 6)} == {" ".join(f"v{j}" for j in range(50))}


def test_repeated_substrings_by_brute_force():
    rng = np.random.default_rng(9)
    page_of = np.sort(rng.integers(0, 6, 400))
    tokens = rng.integers(0, 3, 400)
    got = htmltext.repeated(tokens, page_of, 5, 3)
    grams = defaultdict(set)
    inside = [i for i in range(396) if page_of[i] == page_of[i + 4]]
    for i in inside:
        grams[tuple(tokens[i:i + 5])].add(page_of[i])
    want = np.zeros(400, dtype=bool)
    for i in inside:
        if len(grams[tuple(tokens[i:i + 5])]) >= 3:
            want[i:i + 5] = True
    assert (got == want).all() and 0 < want.sum() < 400


def test_extract_rows(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "PART_PAGES", 4)
    rows = [(i, "http://A.example/x", h, "h") for i, h in enumerate(site(12))]
    rows += [(50, None, None, "h"), (None, "no url", "<p>x</p>", "h"), (51, "http://b", "<p>" + "y " * 200_000, "h"),
             (51, "http://b", "<p>z", "h"), (52, "http://b/q", "", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = htmltext.extract(df).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.n_chars): r.text for r in got}
    assert by[50, 0] == "" and by[52, 0] == "" and by[51, 399_999].startswith("y y") and by[None, 1] == "x"
    assert all(r.text.startswith(f"own{r.page_id} ") for r in got if r.page_id is not None and r.page_id < 12)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_a_split_host_gives_what_one_array_gives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    note = [" ".join(f"n{k}x{j}" for j in range(9)) for k in range(6)]
    holds = [set(rng.choice(120, 2 + 2 * k, replace=False).tolist()) for k in range(6)]     # 2 to 12 pages hold a note
    rows = [(i, "http://a.example/x", page(
        f"<div><p>own{i} " + " ".join(f"w{i}x{j}" for j in range(60)) + "</p></div>"
        + "".join(f"<div>{n}</div>" for n, at in zip(note, holds, strict=True) if i in at))) for i in range(120)]
    want = {i: r for (i, _, _), r in zip(rows, htmltext.extract_part([r[2] for r in rows]), strict=True)}
    assert all(note[0] in want[i][0] for i in holds[0]) and not any(n in t for t, _ in want.values() for n in note[1:])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (512, 40, 3):                        # 1, 3 and 40 parts
        monkeypatch.setattr(htmltext, "PART_PAGES", size)
        assert {r.page_id: (r.text, r.repeated_chars) for r in htmltext.extract(df).collect()} == want


def test_first_lists_that_confuse_all_substrings_change_nothing(spark, monkeypatch):
    note = " ".join(f"n{j}" for j in range(9))
    rows = [(i, "http://a.example/x", page(f"<div><p>own{i} " + " ".join(f"w{i}x{j}" for j in range(40)) + "</p></div>"
                                           + f"<div>{note}</div>" * (i in (3, 30, 31)) + "<div>two of a</div>" * (i < 2)))
            for i in range(40)]
    want = {i: r for (i, _, _), r in zip(rows, htmltext.extract_part([r[2] for r in rows]), strict=True)}
    assert not any(note in t for t, _ in want.values()) and sum(n > 0 for _, n in want.values()) == 3
    monkeypatch.setattr(htmltext, "PART_PAGES", 5)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bits in (24, 1, -8):                         # -8: all substrings look equal
        monkeypatch.setattr(htmltext, "LIST_BITS", bits)
        assert {r.page_id: (r.text, r.repeated_chars) for r in htmltext.extract(df).collect()} == want


def test_what_a_split_host_shuffles_is_small():
    pages = [(i, "http://a.example/x", page("<nav class='a b c'>" + "<a href='/x/y/z'>home</a>" * 20 + "</nav><div><p>"
              + " ".join(f"w{i * 7919 % 1000}x{j}" for j in range(300)) + "</p></div>")) for i in range(512)]
    batch = pa.table({"host": ["a"] * 512, "part": [0] * 512, "parts": [26] * 512, "page_id": [p[0] for p in pages],
                      "url": [p[1] for p in pages], "html": [p[2] for p in pages]}).to_batches()
    records = pa.Table.from_batches(htmltext.parsed_records(iter(batch)))
    part = htmltext.recorded_part(records)
    assert [b.text for p in part.pages for b in p.blocks] == [b.text for p in pages for b in htmltext.parse(p[2]).blocks]
    lists = htmltext.list_part(records)
    n = len(set(htmltext.starts(part)[1].tolist()))
    assert n > 100_000 and sum(len(c.as_py()) for k in ("hashes", "pages") for c in lists.column(k)) < 2.5 * n


def test_articles_of_the_test_pages(spark):
    import html
    df = spark.read.parquet(f"{SF}/pages.parquet")
    truth = {r.page_id: r.html for r in df.collect()}
    tidy = lambda s: " ".join(html.unescape(re.sub(r"<[^>]+>", " ", s)).split())
    for r in htmltext.extract(df).collect():
        inner = re.search(r"<article>(.*)</article>", truth[r.page_id], re.S)[1]
        assert r.text == "\n".join(x for x in map(tidy, re.split(r"<p>|<h1>", inner)) if x)


def test_pipeline(spark):
    """Each stage against its operator's rule on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = landed(stage(spark, docs, SF), f"test-{name}")
        kept.append((name, docs, out))
        docs = out
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = kept
    assert [n for n, _, _ in kept] == ["toxicity", "language", "neardup", "mixing", "tokens"]
    for _, before, after in kept[:-1]:
        assert after.columns == before.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~language.held_out(F.col("doc_id"), 5, 0))
    weights = toxicity.train(toxicity.sample(a, labels))
    assert ids(b) == ids(toxicity.score(a, weights).where("predicted = 0"))
    letters = [r.doc_id for r in b.collect() if language.letters(r.text)]
    assert set(ids(c)) <= set(letters) and len(ids(c)) > 0.95 * len(letters)
    sets = {r.doc_id: frozenset(neardup.shingles(r.text, neardup.WordHash()).tolist()) for r in c.collect()}
    left, order = set(ids(d)), sorted(sets)
    for x in order:                                       # what stays is pairwise different, what goes has a twin
        near = [y for y in order if y != x and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
        assert (x in left) if not near or x < min(near) else True
        if x in left:
            assert not [y for y in near if y in left]
        else:
            assert near
    words = Counter()
    for r in e.collect():
        words[r.source] += len(WORD.findall(r.text))
    sizes = Counter()
    for r in d.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    want = brute_targets(dict(sizes))
    assert all(abs(words[s] - want[s]) <= 1 for s in sizes)
    digests = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in e.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in f.collect()) == digests
    assert "token_ids" in f.columns
