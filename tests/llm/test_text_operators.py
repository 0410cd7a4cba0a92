"""op6, op7, op9 and op10: round trips, held-out accuracy, brute force and edge cases."""

import html
import re

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from logloom.llm import chat, html_text, language, pieces, queries

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  two  blanks ", "plain words here", "a▁b ▁", "x\n\n y\t", "日本語 😀 é", "\x00\x01\x7f ", "a" * 5000, "w " * 30_000]


# --- pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.default_model(), 1.0)


def test_round_trip_of_any_text(spark):
    frame = spark.createDataFrame([(i, t, [1], 2) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids array<int>, n_pieces int")
    got = {r.doc_id: r for r in pieces.encode(frame).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i].lossless is (None if text is None else True)
        assert (got[i].ids is None) == (text is None)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame)).collect()}
    assert back == dict(enumerate(TEXTS))
    assert got[1].ids == [] and pieces.encode(frame.limit(0)).count() == 0


def test_draws_depend_on_the_row_key_only(spark, vocab):
    text = "reproducible segmentations of several words"
    rows = [(i % 3, text) for i in range(30)]
    few = spark.createDataFrame(rows, "doc_id bigint, text string")
    once = {(r.doc_id, tuple(r.ids)) for r in pieces.encode(few.repartition(7)).collect()}
    again = {(r.doc_id, tuple(r.ids)) for r in pieces.encode(few.coalesce(1)).collect()}
    assert once == again and len(once) == 3 and len({ids for _, ids in once}) > 1
    assert {(r.doc_id, tuple(r.ids)) for r in pieces.encode(few, seed=5).collect()} != once
    nulls = spark.createDataFrame([(None, text), (None, text)], "doc_id bigint, text string")
    assert len({tuple(r.ids) for r in pieces.encode(nulls).collect()}) == 1


def test_chunks_do_not_change_draws(vocab):
    texts = ["some words " * 50, None, "", "y " * 300]
    keys = [3, 4, 5, 6]
    whole = list(pieces.encode_texts(vocab, texts, keys))
    small = list(pieces.encode_texts(vocab, texts, keys, chunk=17))
    assert [None if x is None else x.tolist() for x in whole] == [None if x is None else x.tolist() for x in small]


def test_sampled_shares_follow_the_lattice(vocab):
    """All segmentations of a short word, weighted by hand, against many draws."""
    word = "▁the"
    cuts = []

    def walk(at, ids, weight):
        if at == len(word):
            cuts.append((tuple(ids), weight))
        for end in range(at + 1, len(word) + 1):
            found = [i for i, raw in enumerate(vocab.bytes_of) if raw == word[at:end].replace("▁", " ").encode() and vocab.weight[i] > 0]
            for i in found:
                walk(end, [*ids, i], weight * vocab.weight[i])

    walk(0, [], 1.0)
    total = sum(w for _, w in cuts)
    draws = 20_000
    counts = {}
    for ids in pieces.encode_texts(vocab, ["the"] * draws, [int(k) for k in np.arange(draws) * 7919 + 1]):
        counts[tuple(ids.tolist())] = counts.get(tuple(ids.tolist()), 0) + 1
    assert set(counts) <= {ids for ids, _ in cuts}
    for ids, weight in cuts:
        share = weight / total
        assert abs(counts.get(ids, 0) / draws - share) < 4 * (share * (1 - share) / draws) ** 0.5 + 1e-4


# --- language


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 0")
    return language.train(docs, "doc_id", "text", "lang")


def test_text_alone_on_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 1")
    found = language.identify(docs, model, text_col="text").select("lang", "text", "language.text_lang").collect()
    long_enough = [r for r in found if len(r.text) >= 40]
    assert sum(r.lang == r.text_lang for r in long_enough) >= 0.98 * len(long_enough)


def test_evidence_is_fused(spark, model):
    german = "der die und einer nicht mit sich auf von das für ist " * 3
    rows = [(1, german, "de", "de.example.org")] * 30 + [(2, "xq", None, "de.example.org"), (3, "xq", "fr", "fr.example.org"), (4, german, "fr", "fr.example.org")]
    frame = spark.createDataFrame(rows, "id bigint, text string, declared string, host string")
    got = {r.id: r.language for r in language.identify(frame, model, text_col="text", declared=F.col("declared"), host=F.col("host")).collect()}
    assert got[1].lang == "de" and got[1].accepted
    assert got[2].lang == "de"  # its host's other rows decide
    assert got[4].lang == "de"  # the text outweighs one declaration


def test_language_edge_cases(spark, model):
    frame = spark.createDataFrame(
        [(1, None, None, None), (2, "", "xx-unknown", ""), (3, "123 456 !!", "en", None), (4, "the and of that with", "EN-us", "h"), (4, "the and of that with", "EN-us", "h")],
        "id bigint, text string, declared string, host string")
    got = language.identify(frame, model, text_col="text", declared=F.col("declared"), host=F.col("host"), out="found")
    assert got.columns == [*frame.columns, "found"]
    rows = got.collect()
    assert len(rows) == 5
    assert all(not r.found.accepted and r.found.text_lang is None for r in rows if r.id < 4)
    assert all(r.found.accepted and r.found.lang == "en" and r.found.declared == "en" for r in rows if r.id == 4)
    few = language.identify(frame, model, text_col="text", host=F.col("host"), out="found", max_hosts=0)
    assert few.count() == 5
    assert language.identify(frame.limit(0), model, text_col="text").count() == 0
    none = language.train(frame.limit(0), "id", "text", "declared")
    assert not language.identify(frame, none, text_col="text").filter("language.accepted").count()


def test_table_in_one_language(spark):
    rows = [(i, f"the words of row {i} are plain", "en", "web") for i in range(40)] + [(40, "12 34 !", "en", "web"), (41, None, "en", "web")]
    frame = spark.createDataFrame(rows, "id bigint, text string, declared string, host string")
    alone = language.train(frame, "id", "text", "declared")
    assert alone.languages == ("en",)
    found = language.identify(frame, alone, text_col="text", declared=F.col("declared"), host=F.col("host")).collect()
    for r in found:
        want = ("en", "en", True) if r.id < 40 else ("en", None, False)
        assert (r.language.lang, r.language.text_lang, r.language.accepted) == want


def test_rare_language_beside_a_common_one(spark):
    # 6 of 60,006 rows, 0.01 %
    common = spark.range(60000).select("id", F.concat(F.lit("the words of this row are plain "), "id").alias("text"), F.lit("en").alias("label"))
    rare = spark.createDataFrame([(100000 + i, f"žluťoučký kůň příliš úpěl ďábelské ódy {i}", "cs") for i in range(6)], common.schema)
    rows = common.unionByName(rare)
    both = language.train(rows, "id", "text", "label")
    assert both.languages == ("cs", "en")
    found = language.identify(rows.filter("id < 50 or id >= 100000"), both, text_col="text").collect()
    assert all(r.language.accepted and r.language.text_lang == r.label for r in found) and len(found) == 56


def test_page_evidence(spark):
    rows = [("https://user@Blog.Example.org:8080/fr/1?x=2", "<!doctype html><HTML class=a lang='fr-CA'><script>var x='<p>';</script><p>Bonjour&amp;</p>")]
    frame = spark.createDataFrame(rows, "url string, html string")
    r = frame.select(
        language.host_of(F.col("url")).alias("host"), language.address_language(F.col("url")).alias("address"),
        language.markup_language(F.col("html")).alias("markup"), language.markup_text(F.col("html")).alias("text")).first()
    assert (r.host, r.address, r.markup, r.text.strip()) == ("blog.example.org", "fr", "fr-CA", "Bonjour")


# --- chat


def test_rotation_against_the_oracle(spark):
    ok, message = compare(spark, connect(SF), "op9", queries.op9, chat.ORACLE, SF)
    assert ok, message


def test_rotation_of_several_speakers(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "bob", None), (1, 3, " ann ", "bye"), (2, 0, "system", "alone"),
            (None, 0, None, "who"), (3, 0, "ann", "same"), (3, 0, "ann", "same")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, position int")
    segments = chat.rotate(frame)
    prompts = {(r.conv_id, r.perspective): r for r in chat.assemble(segments).collect()}
    assert set(prompts) == {(1, "ann"), (1, "bob"), (None, "unknown"), (3, "ann")}
    bob = prompts[1, "bob"]
    assert bob.prompt == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n"
                          "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=ann\nbye<|im_end|>\n")
    ann = prompts[1, "ann"]
    assert [ann.prompt[s.start:s.end] for s in ann.trained] == ["hi<|im_end|>\n", "bye<|im_end|>\n"]
    assert len(prompts[3, "ann"].trained) == 2
    assert chat.rotate(frame.limit(0)).count() == 0


def test_places_across_blocks(spark):
    frame = spark.range(5000).selectExpr(
        "1 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS role", "repeat('x', CAST(id % 7 AS INT)) AS text")
    rows = sorted(chat.rotate(frame).filter("perspective = 'a'").collect(), key=lambda r: r.position)
    at = 0
    for k, r in enumerate(rows):
        assert (r.position, r.turn, r.start, r.end) == (k + 1, k, at, at + len(r.segment))
        at = r.end


# --- pages


def test_main_text_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"<(p|/p|br|h1|/h1)>", " ", inner))
        want[r.page_id] = " ".join(html.unescape(inner).split())
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just some words without any tags in this page at all, but enough of them", "just some words without any tags in this page at all, but enough of them"),
    ("<article><p>One &amp; two&nbsp;three</p><p>four<b>fi</b>ve</article>", "One & two three fourfive"),
    ("<article><header><h1>Title</h1></header><p>Body</p><footer>Tags</footer><div class='comments'><p>First!</p></div></article>", "Title Body"),
    ("<nav><a>Home</a></nav><main><p>Text<script>var x = '</p>';</script> here</p></main><aside>More</aside>", "Text here"),
    ("<article><p>a<!-- <p>no</p> -->b</p><form><p>Mail</p></form><style>p{}</style></article>", "ab"),
    ("<div class='cookie-notice'>We use cookies</div><article><p>x < y & z</p></article>", "x < y & z"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "one two c1 c2"),
    ("<article><p title='a > b'>quoted</p></article", "quoted"),
    ("<html><head><title>T</title><body><article>plain", "plain"),
    ("<div class='no-sidebar has-header'><article>x y</article></div>", "x y"),
    ("<article>H<math>2</math>O</article>", "H2O"),
    ("<article>A<noscript>img text</noscript>B<object>film</object></article>", "Aimg textBfilm"),
    ("<body><noscript>Enable scripts</noscript><article>x</article>", "x"),
    ("<div class='site-footer'>(c)</div><article class='post'><div class='article-header'><h1>T</h1></div><p>b</p>"
     "<ol class='comment-list'><li>c</li></ol><article class='user-comment'>d</article></article>", "T b"),
    ("hello", "hello"),
    ("<ul><li><a>Home</a><li><a>News</a></ul><h1>Title here</h1><p>" + "word " * 40 + "</p><p>short line</p><p>" + "more " * 30
     + "</p><div>Follow us</div><ul><li><a>A</a><li><a>B</a></ul><p>All rights reserved</p>",
     "Title here " + "word " * 40 + "short line " + "more " * 29 + "more"),
])
def test_pages_by_hand(page, text):
    assert html_text.main_text(page, html_text.fit_tree(html_text.LABELLED)) == text


def test_tree_is_learned_from_the_table():
    rows = html_text.LABELLED
    tree = html_text.fit_tree(rows)
    assert sum(html_text.decide(tree, r[:-1]) == r[-1] for r in rows) >= 0.97 * len(rows)
    held = [r for k, r in enumerate(rows) if k % 4 == 0]
    part = html_text.fit_tree([r for k, r in enumerate(rows) if k % 4])
    assert sum(html_text.decide(part, r[:-1]) == r[-1] for r in held) >= 0.8 * len(held)
    assert html_text.fit_tree([(1.0, 1), (2.0, 1)]) == 1


def test_neighbours_decide_where_no_region_is_marked():
    tree = html_text.fit_tree(html_text.LABELLED)

    def used(node):
        return set() if isinstance(node, int) else {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert used(tree) & {"words_before", "density_before", "words_after", "density_after"}
    prose, links = (40.0, 0.0), (2.0, 1.0)
    line = (3.0, 0.0)
    assert html_text.decide(tree, (*line, *prose, *prose, 1.0, 0.0)) == 1
    assert html_text.decide(tree, (*line, *links, *links, 1.0, 0.0)) == 0
    # a marked article stays whole and a marked frame goes whole, whatever the figures
    rng = np.random.default_rng(2)
    for _ in range(3000):
        row = [float(rng.choice([0, 1, 2, 5, 9, 14, 30, 400])) if k % 2 == 0 else float(rng.choice([0, 0.2, 0.35, 0.6, 1])) for k in range(6)]
        heading = float(rng.integers(2))
        assert html_text.decide(tree, (*row, 2.0, heading)) == 1 and html_text.decide(tree, (*row, 0.0, heading)) == 0


def test_page_edge_cases(spark):
    frame = spark.createDataFrame(
        [(1, "u", "<article>x</article>", "t"), (1, "u", "<article>x</article>", "t"), (None, None, None, "t"),
         (2, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>", "t"), (3, "u", "<" * 20_000, "t")],
        "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extract(frame).collect())
    assert got[:3] == [(0, 0), (1, 1), (1, 1)] and got[3] == (2, 20_000 * 5 - 1)
    assert html_text.extract(frame.limit(0)).count() == 0


def test_a_hot_conversation_is_dealt_by_block_without_a_broadcast(spark):
    turns = spark.createDataFrame([(1, n, "user" if n % 2 else "bot", "x") for n in range(5000)], "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = chat.rotate(turns)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(conv#" in plan and out.count() == 10_000
        windows = [line for line in plan.splitlines() if "hashpartitioning(conv" in line and "block" in line]
        assert windows
        ends = out.filter("perspective = 'bot'").orderBy("position").select("start", "end").collect()
        assert all(a["end"] == b["start"] for a, b in zip(ends, ends[1:]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
