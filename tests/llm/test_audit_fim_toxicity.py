"""Source audit, fill-in-the-middle and toxicity against plain versions and small cases."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tapeloom.llm import fill_in_middle, source_audit, toxicity
from tapeloom.llm.audit_queries import AUDIT

DOCS = "doc_id long, text string, lang string, source string"


# ── 11 ───────────────────────────────────────────────────────────────────────


def _audited(rows, least, top=10):
    """The audit in plain Python."""
    terms = [(i, la or "", so or "", re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))) for i, (_, t, la, so) in enumerate(rows)]
    out = []
    for lang in {t[1] for t in terms}:
        mine = [t for t in terms if t[1] == lang]
        df = Counter(w for t in mine for w in set(t[3]))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = {s: Counter(w for t in mine if t[2] == s for w in t[3] if w in set(kept)) for s in {t[2] for t in mine}}
        whole = sum(count.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in count.items():
            pair = [("pair", o, sum(f(p(c, w), p(d, w)) for w in kept)) for o, d in count.items() if o != s]
            term = [("term", w, f(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, size in ((pair, None), (term, top)):
                for rank, (kind, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:size], 1):
                    out.append((lang, s, kind, item, value, rank))
    return sorted(out)


def _audit_rows():
    rng = np.random.default_rng(3)
    words = ["the", "The,", "of", "don't", "Été", "été.", "x1y", "a-b", "ß", "  ", " nb", "42", "q\u0000r"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30))), str(rng.choice(["en", "de"])), str(rng.choice(["s1", "s2", "s3"]))) for i in range(60)]
    rows += [(60, None, "en", "empty"), (61, "", None, None), (61, "", None, None), (None, "the the", "en", None), (62, "only here", "xx", "lone")]
    return rows + rows[:3]


@pytest.mark.parametrize("least", [1, 10])
def test_audit_matches_plain_version(spark, least, monkeypatch):
    rows = _audit_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", value int").repartition(3)
    want = _audited(rows, least)
    for words, entries in ((3_000_000, 1_000_000), (40, 15)):  # whole, and in small blocks
        monkeypatch.setattr(source_audit, "BLOCK_WORDS", words)
        monkeypatch.setattr(source_audit, "BLOCK_ENTRIES", entries)
        monkeypatch.setattr(source_audit, "GROUP_ENTRIES", entries)
        monkeypatch.setattr(source_audit, "SOURCE_BLOCK", 2 if entries == 15 else 64)
        got = source_audit.audit(docs, min_docs=least).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == want


def test_audit_matches_its_sql(spark):
    rows = [(i, t, la, so) for i, (_, t, la, so) in enumerate(_audit_rows()) if t is None or "\0" not in t]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    want = con.sql("WITH " + AUDIT.format(view="documents", least=10) + " SELECT lang, source, part, item, value, rank FROM audit").fetchall()
    got = source_audit.audit(spark.createDataFrame(rows, DOCS)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], DOCS)).collect() == []
    one = spark.createDataFrame([(1, None, None, None)], DOCS)
    assert source_audit.audit(one).collect() == []


def test_documents_of_rare_chunks_are_told_apart(spark):
    # ten documents reach a term only together, by chunks that each few of them have
    rows = [(i, f"(Word{i % 5}) word.{i}", "en", f"s{i % 2}") for i in range(9)]
    assert source_audit.term_counts(spark.createDataFrame(rows, DOCS)).collect() == []
    kept = source_audit.term_counts(spark.createDataFrame([*rows, (9, "WORD!", "en", "s0")], DOCS)).collect()
    assert {r.term for r in kept} == {"word"} and kept[0].total == 19


# ── 13 ───────────────────────────────────────────────────────────────────────


def _cut(doc, text, seed=1):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    head, mid, tail = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(head), len(mid), f"<S>{tail}<P>{head}<M>{mid}"
    return len(w), "psm", len(head), len(mid), f"<P>{head}<S>{tail}<M>{mid}"


def test_cuts_match_plain_version_and_restore(spark):
    rng = np.random.default_rng(5)
    signs = list("abcXYZ  \n.<>P1éß\U0001f600\u0000")
    texts = ["".join(rng.choice(signs, rng.integers(0, 200))) for _ in range(300)]
    texts += [None, "", "a", "<P>", "x<S", "S>y<", "<<M>>", "word " * 60_000, "same", "same"]
    rows = [(i if i % 50 else None, t, "kept", "old") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, key string").repartition(3)
    cut = fill_in_middle.transform(docs)
    assert cut.columns == ["doc_id", "key", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = cut.withColumn("text", fill_in_middle.restored(cut["output"], cut["form"])).collect()
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=repr)
    assert got == sorted(((d, t or "", *_cut(d, t)) for d, t, _, _ in rows), key=repr)
    assert {r.form for r in back} == {"plain", "psm", "spm"} and {r.key for r in back} == {"old"}


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 100, 4097):
        offsets = np.concatenate([[0], np.cumsum(rng.integers(1, 9, n))])
        lanes = fill_in_middle.SkipList(offsets)
        assert [lanes.seek(r) for r in range(n + 1)] == offsets.tolist()
        assert n < 100 or len(lanes.lanes) > 2
        with pytest.raises(IndexError):
            lanes.seek(n + 1)


def test_no_rows_to_cut(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = fill_in_middle.transform(spark.createDataFrame([("ab cd",)], "doc string"), doc="doc", text="doc")
    assert only.columns == ["n", "form", "prefix_chars", "middle_chars", "output"] and only.first().n == 3


# ── 12 ───────────────────────────────────────────────────────────────────────

CLEAN = "the quick study of rivers and stones shows that water finds its own level in every valley"
PLAIN = ["you are an idiot and a worthless clown", "such a stupid idiot wrote this trash", "worthless trash from a clown"]
MASKED = ["you are an 1d10t and a w0rthl3ss cl0wn", "such a s t u p i d i.d.i.o.t wrote this tr@sh", "worthlessss trrrash from a clooown"]


def _decoder():
    texts = [CLEAN, *PLAIN] * 5
    return toxicity.Decoder(toxicity.costs(toxicity.trigram_counts(texts).astype(float)))


def test_channel_is_undone():
    d = _decoder()
    for masked, plain in zip(("1d10t", "$tup1d", "tr@sh", "clooown", "i.d.i.o.t", "w-o-r-t-h-l-e-s-s", "cl0wn!!"), "idiot stupid trash clown idiot worthless clown".split()):
        assert d.words(masked) == (plain,), masked
    assert d.decode("s t u p i d") == ("stupid",)
    assert d.restore("what s t u p i d 1d10t, really") == "what stupid idiot really"
    # what the channel cannot have touched stays
    for plain in ("Rivers,", "don't", "level", "Été!", "2024", "3.14", ""):
        assert d.words(plain) == tuple(re.findall(r"[^\W\d_]+", plain.lower()))
    assert d.restore(CLEAN) == CLEAN


def test_viterbi_finds_the_cheapest_reading():
    # against all readings of short spans of letters and look-alikes, which only swaps and breaks can explain
    d = _decoder()
    cost = np.array(d.costs)

    def price(reading, channel):
        at, total = 0, channel
        for c in " ".join(reading.split()) + " ":
            k = 0 if c == " " else toxicity._code(c)
            if k or at & 63:
                total += cost[at << 6 | k]
            at = (at << 6 | k) & 4095 if k or at & 63 else at
        return total

    for span in ("id1ot", "tr4sh", "c1own", "w0r1d"):
        options = [("", 0.0)]
        for c in span:
            step = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SWAP) for x in toxicity.LOOK_ALIKES[c]] + [(" ", toxicity.BREAK_INSIDE)]
            options = [(a + b, x + y) for a, x in options for b, y in step]
        best = min(options, key=lambda o: price(*o))
        assert " ".join(d.decode(span)) == " ".join(best[0].split())


def test_masked_toxic_texts_score_like_plain_ones(spark):
    rows = [(i, CLEAN if i % 3 else PLAIN[i % 9 // 3] + " " + CLEAN) for i in range(240)]
    rows += [(300 + i, m + " " + CLEAN) for i, m in enumerate(MASKED)] + [(400, None), (401, ""), (402, CLEAN), (402, CLEAN), (None, CLEAN)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(5, None), (None, 1)], "doc_id long, label int")
    scorer = toxicity.fit(docs.drop("score"), labels)
    got = {}
    for r in toxicity.score(docs, scorer).collect():
        assert got.setdefault(r.doc_id, r.predicted) == r.predicted and 0 <= r.score <= 1
    assert all(got[i] == (i % 3 == 0) for i in range(240))
    assert [got[300 + i] for i in range(3)] == [1, 1, 1]
    assert [got[i] for i in (400, 401, 402, None)] == [0, 0, 0, 0]
    restored = toxicity.restore(docs.where("doc_id = 300"), np.frombuffer(scorer.model, np.float32)).first()
    assert restored.restored == PLAIN[0] + " " + CLEAN and restored.score == 7


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    only = spark.createDataFrame([(1, 0)], "doc_id long, label int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, only)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), only)).collect() == []


def test_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.selectExpr("doc_id", "toxic AS label")
    held = toxicity.held_out(labels["doc_id"])
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs.select("doc_id", "text"), labels.where(~held)))
    rows = scored.join(labels.where(held), "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.label == 0]) < 0.02
    assert np.mean([r.predicted for r in rows if r.label == 1]) > 0.6
