"""Block labeller, quality votes, language evidence and the pipeline."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tapeloom.llm import html_text, language_id, mixing, quality_votes
from tapeloom.llm.queries import GROUPS, JUDGED, LEAKS, MIX_OTHER, MIX_WEIGHTS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labeller(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


HANDMADE = [
    ("", ""),
    ("just text", None),
    ("<script>x<p>no</p></script><style>p{}</style><!-- <p>no</p> -->", ""),
    (
        '<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav><article><h1>A  title</h1>\n<p>First&nbsp;part &amp; <b>bold</b>\n text<br>here.<p>Second one.</article>'
        "<footer><p>&copy; us</p></footer></body></html>",
        "A title\nFirst part & bold text here.\nSecond one.",
    ),
    (
        '<html><body><header><p>Site name here</p></header><div class="cookie-notice"><p>We use cookies on this site.</p></div><main><article><h2>Head</h2><p>The long paragraph of the story goes on and on.</p>'
        '<div class="ad">Buy now, it is cheap!</div><p>And another paragraph ends it.</p></article></main><section id="comments"><div class="comment"><p>Nice story, thanks a lot!</p></div></section>'
        '<aside class="sidebar"><p>Other stories to read.</p></aside><form><p>Your mail address</p></form></body></html>',
        "Head\nThe long paragraph of the story goes on and on.\nAnd another paragraph ends it.",
    ),
]


def test_handmade_pages(labeller):
    for page, want in HANDMADE:
        got = html_text.main_text([page], labeller)[0]
        if want is not None:
            assert got == want


READ_WHOLE = [
    *[(f"<article><p>a</p><{raw}-x>b</{raw}-x><p>c</p></article>", ["a", "b", "c"]) for raw in ("script", "style", "template", "iframe", "title", "textarea", "svg")],
    ("<p>a</p><title-bar>x</title-bar><p>b</p>", ["a", "x", "b"]),
    ("<!-->a<!--->b<!-- c -->d<!-- e --!>f", ["abdf"]),
    ("<p title=it's>q</p><p>r's</p>", ["q", "r's"]),
    ("<noscript><p>n</p></noscript>m", ["n", "m"]),
    ("<script>a<b</script >c<script/x>d</script\n>e", ["ce"]),
    ("<p a='>' b=\">\">x</p><p c=\"open>y</p>", ["x", "y"]),
    ("<script data-x='a>b'>no</script>yes<style>p>q</style>", ["yes"]),
]


@pytest.mark.parametrize(("page", "want"), READ_WHOLE)
def test_blocks_keep_the_rest_of_the_page(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


#: Labelled by hand; their class names are in no list of the library.
FOREIGN = [
    (
        '<html><body><ul class="zeile-oben"><li><a href="/">Start</a></li><li><a href="/a">Archiv</a></li><li><a href="/k">Kontakt</a></li></ul>'
        '<div class="blatt"><h1>Der lange Sommer</h1><p>Im Tal blieb das Wasser lange aus, und die Leute warteten auf Regen.</p>'
        "<p>Am Abend kamen endlich Wolken, die sich über den Hügeln sammelten und nicht mehr gingen.</p></div>"
        '<div class="zeile-unten"><p>© 2024 Talbote</p></div></body></html>',
        "Der lange Sommer\nIm Tal blieb das Wasser lange aus, und die Leute warteten auf Regen.\n"
        "Am Abend kamen endlich Wolken, die sich über den Hügeln sammelten und nicht mehr gingen.",
    ),
    (
        '<html><body><nav class="q1"><a href="/">Home</a> <a href="/x">World</a></nav><article class="q2"><h2>Bridge reopens</h2>'
        "<p>The old bridge was opened again on Monday after two years of work.</p><p>Drivers had waited for it since the flood, and many came to see it.</p></article>"
        '<footer class="q3"><p>© 2023 The Daily</p></footer></body></html>',
        "Bridge reopens\nThe old bridge was opened again on Monday after two years of work.\nDrivers had waited for it since the flood, and many came to see it.",
    ),
]


@pytest.mark.parametrize(("page", "want"), FOREIGN)
def test_hand_labelled_pages_with_foreign_names(labeller, page, want):
    assert html_text.main_text([page], labeller)[0] == want


def test_labels_of_pages_it_was_not_trained_on(spark, labeller):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right = total = 0
    for page in pages:
        leaves = html_text.blocks(page)
        scores = labeller.content([html_text.vectors(leaves)])[0]
        right += sum((s >= 0.5) == html_text.marked(b) for b, s in zip(leaves, scores, strict=True))
        total += len(leaves)
    assert right / total > 0.999


def test_one_page_scores_the_same_in_any_batch(labeller):
    leaves = [html_text.vectors(html_text.blocks(p)) for p, _ in HANDMADE]
    for alone, x in zip(leaves, labeller.content(leaves), strict=True):
        assert np.allclose(labeller.content([alone])[0], x, atol=1e-5)


def test_extract_keeps_columns_nulls_and_repeats(spark, labeller):
    rows = [(1, HANDMADE[3][0], "mine", "k1"), (2, None, "mine", "k2"), (2, None, "mine", "k2"), (3, "<article><p>" + "very long words " * 40000 + "</p></article>", "", "k3")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string, key string"), labeller)
    assert got.columns == ["page_id", "key", "text", "n_chars"]
    rows = sorted(map(tuple, got.collect()))
    assert rows[0] == (1, "k1", HANDMADE[3][1], len(HANDMADE[3][1])) and rows[1] == rows[2] == (2, "k2", "", 0)
    assert rows[3][3] == len("very long words " * 40000) - 1
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_votes_on_held_out_rows(spark):
    got = QUERIES["op2_quality_votes"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    test = both[both.held_out]
    assert len(got) == 1000 and (test.predicted == test.quality).mean() >= 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.itertuples())


def test_votes_with_nulls_and_without_labels(spark):
    docs = spark.createDataFrame([(1, "good words here", 9.0), (2, None, 1.0), (None, "", 2.0), (3, "BAD!! BAD!! BAD!!", 3.0), (3, "BAD!! BAD!! BAD!!", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None), (77, 1)], "doc_id long, label int")
    votes = quality_votes.fit(docs, labels)
    got = quality_votes.score(docs, votes).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (1, 3)} == {1: 1, 3: 0}
    none = quality_votes.score(docs, quality_votes.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_votes.score(docs.limit(0), votes).count() == 0


def test_block_products_find_the_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, quality_votes.DIMS), np.float32)
    votes = quality_votes.Votes(rng.standard_normal((quality_votes.DIMS, 8)).astype(np.float32), np.zeros((0, 8), np.float32), (rng.random(300) < 0.5).astype(float), 0.5)
    votes = quality_votes.Votes(votes.axes, votes.latent(x), votes.labels, 0.5)
    for row, got in zip(x[:20], votes.scores(x[:20]), strict=True):
        near = votes.vectors @ votes.latent(row[None])[0]
        best = np.argsort(-near)[: quality_votes.NEIGHBOURS]
        w = np.clip(near[best], 0, 1).astype(float) ** 8
        assert got == pytest.approx((w * votes.labels[best]).sum() / w.sum(), abs=1e-4)


def test_language_evidence(spark):
    train = [("the house and the dog and the cat", "en"), ("das haus und der hund und die katze", "de")] * 5
    languages, model = language_id.train(spark.createDataFrame([*train, (None, "en"), ("x", None)], "text string, lang string"))
    assert languages == ["de", "en"]
    rows = [
        (1, "the cat and the house", False, "en", "com", "a.com", "a.com", "k"),
        (2, "<p class='der die das'>the dog</p>", True, None, "com", "a.com", "b.a.com", "k"),
        (3, "und die katze " * 3000, False, "en", None, None, None, "k"),
        (4, None, False, "de", "com", "a.com", "a.com", "k"),
        (5, "", False, None, None, None, "a.com", "k"),
        (5, "", False, "xx", None, None, "a.com", "k"),
    ]
    frame = spark.createDataFrame(rows, "id long, text string, markup boolean, declared string, suffix string, domain string, host string, language string")
    got = {r.id: r for r in language_id.identify(frame, languages, model).collect()}
    assert [got[i].language for i in (1, 2, 3)] == ["en", "en", "de"] and len(got) == 5
    assert got[4].text_language is None and all(0.5 <= r.probability <= 1 for r in got.values())
    assert language_id.identify(frame.limit(0), languages, model).count() == 0
    none = language_id.identify(frame, *language_id.train(spark.createDataFrame([], "text string, lang string"))).collect()
    assert {r.language for r in none} == {"und"}


@pytest.mark.parametrize(
    "within, wanted",
    [
        ('<svg width="1"/>', []),
        ('<svg data-a="x>y" />', []),
        ("<svg><title>icon</title><text>no</text></svg>", []),
        ("<svg><path d='M0'/>", []),
        ("<svg viewBox=0><text>no", []),
        ("<math/>", []),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>", ["Let x=2 hold."]),
        ("<object data=a.swf><p>instead</p></object>", ["instead"]),
        ("<object data=a.swf>", []),
        ("<select><option>one<option>two</select>", ["one", "two"]),
        ("<select name=a>", []),
        ("<script>no</script><textarea>no</textarea>", []),
    ],
)
def test_blocks_after_drawings_formulas_and_objects_are_kept(within, wanted):
    page = f"<body><article><p>Before.</p>{within}<p>After one.</p><div>After two.</div></article></body>"
    assert [b.text for b in html_text.blocks(page)] == ["Before.", *wanted, "After one.", "After two."]


def test_pipeline_matches_brute_force(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    con.execute("CREATE TABLE good AS WITH " + JUDGED.format(view="documents") + " SELECT doc_id, text FROM judged WHERE kept")
    con.execute("CREATE TABLE one AS WITH RECURSIVE " + GROUPS.format(view="good", words=5, last=4, percent=80) + " SELECT good.* FROM good JOIN groups USING (doc_id) WHERE doc_id = component_id")
    con.execute("CREATE TABLE clean AS WITH " + LEAKS.format(view="one") + " SELECT * FROM one WHERE doc_id NOT IN (SELECT doc_id FROM leaks)")
    ids = [d for (d,) in con.execute("SELECT doc_id FROM clean").fetchall()]
    assert 0 < len(ids) < con.execute("SELECT count(*) FROM one").fetchone()[0] < con.execute("SELECT count(*) FROM good").fetchone()[0]
    # the mixture's plan has a brute-force test of its own; here it says in which order tokens are written
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixture = mixing.mixed(docs.where(docs.doc_id.isin(ids)), MIX_WEIGHTS, other=MIX_OTHER, every_source=True).collect()
    assert [r.doc_id for r in mixture] != sorted(ids) == sorted(r.doc_id for r in mixture)
    tokenizer, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in mixture:
        got = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
        start += len(got)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == want


def test_pipeline_on_empty_and_odd_tables(spark):
    odd = [(1, None, None, None, None), (None, "", "en", "src0", 0), (2, "short", "en", None, 5), (2, "short", "en", None, 5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, step in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = step(spark, docs, SF)
            assert docs.count() == 0, name
            assert docs.columns == columns or name == "token_files"


def test_new_hosts_have_the_share_of_their_domain(spark):
    german = "der und die das nicht mit von ist auch eine"
    texts = spark.createDataFrame([("de", german)] * 5 + [("en", "the and of to in is that it for was")] * 5, "lang string, text string")
    languages, model = language_id.train(texts)
    rows = [(i, german, False, None, "de", "zeitung.de", f"h{i}.zeitung.de") for i in range(30)]
    rows += [(100 + i, "the and of to in is that it", False, None, "de", "other.de", "x.other.de") for i in range(30)]
    rows += [(200, None, False, None, "de", "zeitung.de", "new.zeitung.de"), (201, None, False, None, "de", "zeitung.de", None), (202, "½ Ⅷ", False, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, markup boolean, declared string, suffix string, domain string, host string")
    got = {r.doc_id: r for r in language_id.identify(table, languages, model).collect()}
    assert got[200].language == got[201].language == "de" and min(got[200].probability, got[201].probability) > 0.8
    assert got[202].text_language is None


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    held = docs.selectExpr("*", "crc32(cast(doc_id AS string)) % 4 = 1 AS held")
    languages, model = language_id.train(held.where("NOT held"))
    rows = held.where("held AND n_chars > 200").selectExpr(
        "doc_id", "text", "false AS markup", "cast(null AS string) AS declared", "cast(null AS string) AS suffix", "cast(null AS string) AS domain", "cast(null AS string) AS host", "lang"
    )
    got = language_id.identify(rows, languages, model).collect()
    assert len(got) > 100 and np.mean([r.language == r.lang for r in got]) > 0.97


def test_votes_count_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(1, "good text")] * 50 + [(2, "bad stuff"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, label int")
    votes = quality_votes.fit(docs, labels)
    assert sorted(votes.labels.tolist()) == [0, 1]
