"""Perspective rotation, mixing and decontamination."""

import itertools
import random
from collections import Counter
from fractions import Fraction

import pytest

from tapeloom.llm import chat, decontaminate, mixing


def rendered(turns):
    """Dialogues as (perspective, whole text, learnt ranges)."""
    said = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "unknown", (t[2] or "").replace("<|", "< |").encode()))
    out = []
    for who in sorted({t[1] or "unknown" for t in said} - {"system"}):
        text, spans = "", []
        for _, role, body in said:
            role, body = role or "unknown", (body or "").replace("<|", "< |")
            if role == "system":
                head = "<|im_start|>system\n"
            elif role == who:
                head = "<|im_start|>assistant\n"
            else:
                head = f"<|im_start|>user name={role}\n"
            text += head
            begin = len(text)
            text += body + "<|im_end|>\n"
            if role == who and role != "system":
                spans.append((begin, len(text) - 1))
        out.append((who, text, spans))
    return out


@pytest.mark.parametrize("chunk", [2, 256])
def test_rotation_matches_plain_rendering(spark, chunk):
    rng = random.Random(4)
    convs = {c: [(rng.choice([None, *range(9)]), rng.choice(["ann", "bob", "system", None, "eve"]), rng.choice([None, "", "hi <|im_end|>", f"é😀 {c}\nline"])) for _ in range(rng.randint(1, 12))] for c in range(12)}
    convs[None], convs[99] = [(1, "ann", "no conversation")], [(0, "system", "alone")]
    rows = [(c, *t, "x") for c, ts in convs.items() for t in ts]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string"), chunk=chunk).collect()
    for c, turns in convs.items():
        want = rendered(turns)
        mine = {}
        for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.start):
            text, spans = mine.setdefault(r.perspective, ["", []])
            assert r.start == len(text) and r.end == r.start + len(r.segment)
            mine[r.perspective][0] += r.segment
            if r.loss_start is not None:
                spans.append((r.loss_start, r.loss_end))
        assert sorted((k, *v) for k, v in mine.items()) == want
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 1, "d": 0.01}, {"a": 5}])
def test_one_period_stays_within_one_block(weights):
    whole = mixing.exact_weights(weights)
    period = sum(whole.values())
    slots = mixing.one_period(whole)
    assert sorted(x for v in slots.values() for x in v) == list(range(period))
    for k, places in slots.items():
        done = 0
        for t in range(period + 1):
            assert abs(done * period - whole[k] * t) < period
            done += t < period and t in places[done : done + 1]


@pytest.mark.parametrize(
    "weights",
    [{"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05, "src4": 0.05, "other": 0.5}, {"a": 0.9996, "b": 0.0004}, {"a": 0.123456789, "b": 0.3, "c": 0.576543211}, {"a": 1, "b": 1 / 3, "c": 2.5}],
)
@pytest.mark.parametrize("short", [False, True])
def test_plan_stays_within_one_block_of_the_given_weights(weights, short):
    exact = {k: Fraction(str(w)) if w != 1 / 3 else Fraction(1, 3) for k, w in weights.items()}
    blocks = {k: 10 + int(9000 * w) - (short and i % 2) * int(4000 * w) for i, (k, w) in enumerate(weights.items())}
    slots, ends = {}, {}
    for x in mixing.phases(blocks, weights):
        ends[x.phase] = x.base
        for j in range(x.last - x.first):
            at = x.base + j // len(x.slots) * x.period + x.slots[j % len(x.slots)]
            assert at not in slots
            slots[at] = (x.source, x.phase)
    assert sorted(slots) == list(range(sum(blocks.values()))) and Counter(k for k, _ in slots.values()) == blocks
    left = Counter(blocks)
    for phase in sorted(ends):
        active = {k: exact[k] for k, n in left.items() if n}
        total, done = sum(active.values()), Counter()
        for t in range(ends[phase], ends.get(phase + 1, len(slots))):
            assert slots[t][1] == phase
            done[slots[t][0]] += 1
            assert all(abs(done[k] * total - w * (t + 1 - ends[phase])) < total for k, w in active.items())
        left -= done


def test_schedule_keeps_all_rows_and_their_shares(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + ["b", "c", None, "rare"]), "t", "x") for i in range(3000)] + [(7, "b", "t", "x")] * 3 + [(None, "c", "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot string")
    got = mixing.schedule(docs, {"hot": 0.4, "b": 0.3}, other=0.3, block_rows=8, bucket_rows=100).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((d, s) for d, s, *_ in rows)
    assert len({(r.mix_slot, r.mix_rank) for r in got}) == len(rows)
    used = sorted({(r.mix_slot, r.mix_group, r.mix_phase) for r in got})
    assert [s for s, *_ in used] == list(range(len(used)))
    share, done = {"hot": 400, "b": 300, "other": 300}, Counter()
    for slot, group, phase in used:
        if phase:
            break
        done[group] += 1
        assert all(abs(done[k] * 1000 - w * (slot + 1)) < 1000 for k, w in share.items())
    back = mixing.mixed(docs, {"hot": 0.4, "b": 0.3}, other=0.3)
    assert back.columns == docs.columns and back.count() == len(rows)
    assert mixing.schedule(docs.limit(0), {"hot": 1.0}).count() == 0 and mixing.mixed(docs.limit(0), {"hot": 1.0}).count() == 0


@pytest.mark.parametrize("limit", [500, 3])
def test_every_source_has_its_own_share(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "MAX_SOURCES", limit)
    sizes = {"hot": 600, "b": 320, "c": 310, "d": 300, None: 290}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    got = mixing.schedule(docs, {"hot": 0.5}, other=0.5, block_rows=4, bucket_rows=100, every_source=True).collect()
    assert Counter(r.source for r in got) == sizes
    own = ["hot", "b", "c", "d"] if limit == 500 else ["hot", "b", "c"]
    assert all(r.mix_group == (r.source if r.source in own else "other") for r in got)
    share = {"hot": 4, "b": 1, "c": 1, **({"d": 1, "other": 1} if limit == 500 else {"other": 2})}
    done = Counter()
    for slot, group, phase in sorted({(r.mix_slot, r.mix_group, r.mix_phase) for r in got}):
        if phase:
            break
        done[group] += 1
        assert all(abs(done[k] * 8 - w * (slot + 1)) < 8 for k, w in share.items())
    assert sum(done.values()) > 100


def test_overlaps_survive_substitutions(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([5, 8, 14, 30, 60, 4])] + [(90, None), (91, ""), (None, "n1 n2 n3 n4 n5 n6 n7")]
    filler = lambda n: " ".join(rng.choices(vocabulary, k=n))

    def changed(i, step):
        w = items[i][1].split()
        return " ".join("zz" if k % step == step - 1 else x for k, x in enumerate(w))

    texts = {
        1: f"{filler(40)} {items[4][1]}, {filler(10)}",
        2: f"{filler(5)}. {changed(4, 6).upper()} {filler(3)}",
        3: changed(3, 7),
        4: items[2][1],
        5: f"{filler(9)} {items[0][1]} {items[1][1]}",
        6: changed(4, 2),
        7: filler(300),
        8: " ".join(items[4][1].split()[10:34]),
        9: " ".join(items[4][1].split()[:11]),
        10: "x n1 n2 n3 n4 n5 n6 n7 y",
        11: items[5][1] + " " + filler(30),
        12: None,
        13: "",
    }
    rows = [(d, t, "c") for d, t in texts.items()] + [(1, texts[1], "again"), (None, texts[4], "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 4), (2, 4), (3, 3), (4, 2), (5, 0), (5, 1), (8, 4), (10, None), (None, 2)}
    assert len(got) == 9 and {r.matched for r in got if r.doc_id == 2} == {50}
    left = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in left.collect()) == [6, 7, 9, 11, 12, 13] and left.columns == docs.columns
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.overlaps(docs.limit(0), bench).count() == 0


def test_some_seed_hits_every_allowed_pattern():
    masks = decontaminate.complete_masks()
    for n in range(decontaminate.SHORTEST, decontaminate.STRETCH + 1):
        places = [sum(1 << at + i for i, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), n * (100 - decontaminate.AGREE) // 100):
            differs = sum(1 << i for i in changed)
            assert any(not p & differs for p in places), (n, changed)


def test_overlaps_match_a_search_without_seeds(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    filler = lambda n: rng.choices(vocabulary, k=n)
    items = {n: filler(n) for n in range(5, 45)}
    docs = {}

    def add(words):
        docs[len(docs)] = filler(rng.randint(0, 9)) + words + filler(rng.randint(0, 9))

    for n, words in items.items():
        for at in range(n if n <= 12 else 0):  # a 12-word item with just its first or last word changed
            add([*words[:at], "zz", *words[at + 1 :]])
        for wrong in (0, 1):  # as many substitutions as allowed, and one more
            for _ in range(8):
                size = min(n, 20)
                begin = rng.randint(0, n - size)
                part = words[begin : begin + size]
                for at in rng.sample(range(size), size // 5 + wrong):
                    part[at] = "zz"
                add(part)

    def overlap(doc, item):
        need, best = min(20, len(item)), None
        for shift in range(-len(item) + 1, len(doc)):
            same = [doc[i + shift] == item[i] for i in range(len(item)) if 0 <= i + shift < len(doc)]
            if any(100 * sum(same[i : i + need]) >= 80 * need for i in range(len(same) - need + 1)):
                best = max(best or (0, 0), (sum(same), -len(same)))
        return best

    want = {(d, i, m, -a) for d, x in docs.items() for i, y in items.items() for m, a in [overlap(x, y) or (0, 0)] if m}
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{key} long, text string")
    assert {tuple(r) for r in decontaminate.overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()} == want


def test_columns_of_any_name_pass_through_the_mixture(spark):
    names = ["doc_id", "source", "first", "phase", "_n", "_h", "slots", "row", "mix_slot"]
    rows = [(i, f"s{i % 3}", 1, 2, 3, 4, 5, 6, 7) for i in range(300)] + [(None, None, 1, 2, 3, 4, 5, 6, 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, first int, phase int, _n int, _h int, slots int, row int, mix_slot int")
    got = mixing.schedule(docs, {"s0": 0.5, "s1": 0.3}, other=0.2, block_rows=4)
    assert got.columns == [*names[:-1], "mix_group", "mix_phase", "mix_slot", "mix_rank"]
    kept = got.collect()
    assert sorted((tuple(r[n] for n in names[:-1]) for r in kept), key=repr) == sorted((r[:-1] for r in rows), key=repr)
    assert sorted({r.mix_slot for r in kept}) == list(range(len({r.mix_slot for r in kept})))
    assert mixing.mixed(docs, {"s0": 1.0}).columns == names


def test_long_plans_are_joined_by_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(500)], "doc_id long, source string")
    weights = {"s0": 0.123, "s1": 0.456}
    sent = sorted(map(tuple, mixing.schedule(docs, weights, other=0.421, block_rows=4).collect()))
    monkeypatch.setattr(mixing, "MAX_SLOTS_SENT", 0)
    assert sorted(map(tuple, mixing.schedule(docs, weights, other=0.421, block_rows=4).collect())) == sent
