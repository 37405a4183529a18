import random

import numpy as np
import pytest

from tapeloom.llm import near_duplicates as nd


def brute(rows, words, percent):
    def shingle(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [shingle(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and sets[j] and 100 * same >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for n in [1, 2, 5, 6, 7, 8, 9, 12, 20, 33, 60, 150, 700, 3000]:
        for _ in range(40 if n < 200 else 6):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
            drop = int(rng.integers(0, max(1, int(n * (100 - percent) / 100)) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 64, int(rng.integers(0, drop + 2)), np.uint64)]))
            same = len(np.intersect1d(a, b))
            if len(b) and nd._linked(same, len(a), len(b), percent) and same < max(len(a), len(b)):
                assert len(np.intersect1d(nd.signatures(a, percent), nd.signatures(b, percent)))


def test_bands_hold_every_linked_pair_of_sizes():
    for percent in (30, 50, 80, 85, 99):
        rows = nd.bands(percent, 3000)
        for y in range(1, 300):
            for x in range(-(-percent * y // 100), y):
                assert any(a <= x and y <= b for a, b in rows), (percent, x, y)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["It", "IT", "é", "É"]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 8, 15, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    texts += ["", None, " \n\t", "one", "ONE", "a b c d", "A b  c d", texts[0] + " " + "x y " * 3000, texts[0] + " " + "x y " * 3001]
    rng.shuffle(texts)
    return [(1000 - i if i % 3 else 3 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words,percent", [(4, 85), (1, 60)])
def test_groups_match_brute_force(spark, words, percent):
    rows = corpus(words)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, n int").repartition(5)
    got = nd.groups(docs, words=words, percent=percent).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, words, percent))


def test_keep_first_keeps_one_of_each_group(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "p"), (3, a + " tail", "q"), (3, a + " tail", "q"), (9, b, "r"), (None, b + " z", "s"), (1, "", "t"), (2, "", "u"), (2, None, "v"), (None, "alone here", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = nd.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(x.row for x in got.collect()) == ["q", "r", "t", "u", "v", "w"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.groups(empty).count() == 0 and nd.keep_first(empty).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(bytes([i // 200, i % 200]), bytes([(i + 1) // 200, (i + 1) % 200])) for i in range(300)], "a binary, b binary")
    assert nd.components(links).select("root").distinct().count() == 1
