import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeloom.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 65535)), min_size=1, max_size=1500))
def test_matrix_answers_like_the_list(values):
    m = tf.WaveletMatrix.build(np.array(values))
    assert m.ids().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1}:
        assert m.access(i) == values[i]
    for v in {values[0], values[-1], 1, 65535}:
        places = [i for i, x in enumerate(values) if x == v]
        assert m.count(v) == len(places)
        assert m.rank(v, len(values) // 3) == sum(x == v for x in values[: len(values) // 3])
        assert m.occurrences(v)[:50] == places[:50]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_words_are_encoded_like_whole_texts(text):
    check(text)


TEXTS = [
    "", " ", "Hello, world's end. don't 'tis ''s 123 a1b2", "<|endoftext|> x<|startoftext|>y", "É é ÀÉß ŒUF œ ﬁ", "a\x85b\xa0c　d",
    "µg ª º ½ ² ſ K İ İ", "日本語 テキスト 🙂👍🏽 a🙂b", "a\x00b\x1cc\x1fd", "Σας ΟΔΟΣ", "THE,!! AND!! x%%% y### | z",
]


@pytest.mark.parametrize("text", TEXTS)
def test_odd_texts_are_encoded_like_whole_texts(text):
    check(text)


_tokenizer = Tokenizer.from_file(PATH)
_words = tf.WordEncoder(PATH, limit=300)


def check(text):
    want = _tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_words.encode(text.encode()), "<u2").tolist() == want


def test_round_trip_with_nulls_repeats_and_order(spark, tmp_path):
    rows = [(i * 7 % 50, f"word{i} and more {i}", "x") for i in range(50)]
    rows += [(3, None, "n"), (None, "no id", "n"), (3, "", "e"), (5, "same row", "r"), (5, "same row", "r"), (60, "long " * 5000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    path = f"file://{tmp_path}/shards"
    tf.write(docs, path, PATH, shard_tokens=64)
    got = sorted(map(tuple, tf.read_documents(spark, path).collect()), key=lambda x: x[1])
    want, start = [], 0
    for key, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0], (x[1] or "").encode())):
        ids = [*_tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    one = tf.read_shards(spark, path).orderBy("part", "seq").first()
    m = tf.WaveletMatrix(one.n_tokens, one.zeros, one.planes, one.ranks)
    assert m.count(2) >= len(one.doc_ids) and m.select(2, 0) == m.ids().tolist().index(2)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    tf.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tf.read_documents(spark, path).count() == 0


def test_pipeline_lets_go_of_words_with_the_task(monkeypatch):
    import pyarrow as pa

    import corpus_pipeline

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"one two", b"three"], pa.binary())], ["doc", "text"])
    monkeypatch.setattr(tf.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(tf, "_encoders", {})
    kept = list(tf._pack(PATH, 1000, 2)([batch]))
    assert list(tf._encoders) == [PATH]
    assert list(tf._pack(PATH, 1000, 2, keep_words=False)([batch])) == kept
    assert not tf._encoders

    asked = {}
    monkeypatch.setattr(corpus_pipeline, "shared_path", lambda spark: "somewhere")
    monkeypatch.setattr(corpus_pipeline.mixing, "placed", lambda docs, *a, **k: docs)
    monkeypatch.setattr(tf, "write", lambda *a, **k: asked.update(k))
    monkeypatch.setattr(tf, "read_documents", lambda spark, path: path)
    corpus_pipeline.token_ids(None, None, "")
    assert asked["keep_words"] is False


def test_new_pieces_go_to_the_model_many_at_a_time(monkeypatch):
    encoder, asked = tf.WordEncoder(PATH), []
    monkeypatch.setattr(tf, "PIECES_AT_ONCE", 4)
    pieces = encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda some: asked.append(len(some)) or pieces(some))
    texts = ["One two, three. four", " two\n\nfive six's  ", "", "ÀÉß seven seven!", "Señor </w> eight </W>x", "日本 <|endoftext|> nine"]
    want = [_tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_many([t.encode() for t in texts])] == want
    assert max(asked) == 4 and len(asked) == -(-sum(asked) // 4)
    encoder.ends[:] = False  # a model without ends of words
    encoder.words = tf._Recent(3)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_many([t.encode() for t in texts])] == want
