import random
import re
from collections import Counter

import numpy as np
import pytest

from meterfold.llm import components, decontamination, embedding_dedup, jaccard_join
from tests.llm import samples

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Forest:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_force(rows):
    sets, forest = [(d, shingles(t)) for d, t, *_ in rows], Forest()
    for k, (d, a) in enumerate(sets):
        for e, b in sets[:k]:
            if d is not None and e is not None and d != e and a and 100 * len(a & b) >= 80 * len(a | b):
                forest.join(d, e)
    return sorted((d is None, d or 0, len(s), forest.find(d) if d is not None else None) for d, s in sets)


def classes(df, **options):
    rows = jaccard_join.classes(df, **options).collect()
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows)


def test_jaccard_classes(spark):
    assert classes(samples.frame(spark)) == brute_force(samples.documents())
    assert jaccard_join.classes(samples.empty(spark)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies_and_shared_passages(spark, seed):
    """Links near the threshold, groups that hang together by one link, and a passage in unlike documents."""
    rng = random.Random(seed)
    rows, passage = [], samples.prose(rng, "xx", 60)
    for family in range(4):
        words = samples.prose(rng, "yy", 60 + 20 * family).split(" ")
        for k in range(14):
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(len(words))] = samples.prose(rng, "xx", 1)
            rows.append((family * 100 + k, " ".join(words), None, None, None))
    rows += [(1000 + k, f"{samples.prose(rng, 'yy', 40)} {passage} {samples.prose(rng, 'yy', 40)}", None, None, None) for k in range(20)]
    rows += [(1100 + k, f"{samples.prose(rng, 'yy', k)} {passage}", None, None, None) for k in range(6)]
    rng.shuffle(rows)
    assert classes(samples.frame(spark, rows), part=3) == brute_force(rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    forest = Forest()
    for a, b in edges:
        if a != b:
            forest.join(a, b)
    nodes = {x for e in edges for x in e}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    assert got == {x: forest.find(x) for x in nodes if forest.find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(150):
        rows.append((k, rng.normal(size=24).tolist(), k % 3))
    center = rng.normal(size=24)
    for k in range(200, 260):  # around the threshold
        rows.append((k, (center + rng.normal(size=24) * rng.choice([0.1, 0.25, 0.35])).tolist(), 1))
    rows += [(300 + k, rows[5][1], 2) for k in range(5)] + [(310, (np.array(rows[5][1]) * 3).tolist(), 2), (311, rows[5][1], 1)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, [None] * 24, 1), (404, [], 1), (405, rows[0][1], None), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0)]
    rows.append((408, [float("inf")] + [1.0] * 23, 1))
    return rows + rows[:2]


@pytest.mark.parametrize("chunk", [4096, 20])
def test_embedding_links(spark, chunk):
    rows = vectors()
    distinct = {r[0]: r for r in rows}
    forest, count = Forest(), Counter()

    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    usable = [(d, np.array(v, float), label) for d, v, label in distinct.values() if good(v, label)]
    for k, (d, v, label) in enumerate(usable):
        for e, w, other in usable[:k]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                forest.join(d, e)
                count[d] += 1
                count[e] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = embedding_dedup.near_duplicates(df.selectExpr("*", "1 AS _v", "2 AS _rep"), chunk=chunk).collect()
    assert sorted(tuple(r) for r in got) == sorted((d, count[d], forest.find(d), forest.find(d) == d) for d in distinct)
    assert 0 < sum(count.values()) < 60 * 59
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_only_crowded_slices_are_dealt_over_chunks(spark):
    """Copies follow the slice, not the label: one dense slice leaves the others of its label whole."""
    near = [("a", 4, k, k, 1, [0, k % 40], b"") for k in range(400)]
    placed = spark.createDataFrame(near, "_label string, _size int, _rep long, _k1 long, _many long, _slices array<long>, _bytes binary")
    got = {r["_rep"]: {(x["place"], x["_chunks"]) for x in r["_dealt"]} for r in embedding_dedup.crowded(placed, 100).collect()}
    assert got == {k: {(0, 4), (1, 4)} for k in range(400)}
    assert embedding_dedup.crowded(placed, 400).count() == 0


@pytest.mark.parametrize("chunk", [30, 100_000])
def test_links_across_slices_of_unequal_size(spark, chunk):
    """A crowded slice asks in a nearly empty one; each link counts once whatever the chunks."""
    rng = np.random.default_rng(11)
    center = rng.normal(size=16)
    v = np.concatenate([center + rng.normal(size=(250, 16)) * 0.05, center + rng.normal(size=(20, 16)) * 0.3, rng.normal(size=(30, 16))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = u @ u.T >= 0.93
    want = linked.sum(1) - 1
    df = spark.createDataFrame([(k, x.tolist(), "one") for k, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, chunk=chunk).collect()}
    assert [got[k]["n_links"] for k in range(300)] == want.tolist()
    forest = Forest()
    for i, j in zip(*np.nonzero(linked)):
        forest.join(int(i), int(j))
    assert all(got[k]["component_id"] == forest.find(k) for k in range(300))


def test_rotation_keeps_distances_and_does_not_depend_on_the_batch():
    v = np.random.default_rng(1).normal(size=(50, 24))
    turned = embedding_dedup.rotated(v, 8)
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(v, axis=1))
    assert (embedding_dedup.rotated(v[7:9], 8) == turned[7:9]).all()


ITEMS = 12


def leaking(seed=6):
    rng = random.Random(seed)
    items = [(k, samples.prose(rng, "xx", rng.randint(12, 50))) for k in range(ITEMS)]
    items += [(50, None), (51, ""), (52, "Two, words!"), (53, items[0][1])]
    rows = [(d, t, lang, s, n) for d, t, lang, s, n in samples.documents() if d is None or d < 200 or d > 206]
    for k in range(ITEMS):
        words = items[k][1].split(" ")
        wrong = list(words)
        wrong[len(words) // 2] = "otherwise"
        for j, body in enumerate([" ".join(words), " ".join(words).upper() + " !", " ".join(wrong), " ".join(words[: len(words) // 2])]):
            rows.append((1000 + 10 * k + j, f"{samples.prose(rng, 'yy', 30)} {body} {samples.prose(rng, 'yy', 30 * (j % 2))}", None, None, None))
    rows += [(2000, items[3][1], None, None, None), (2001, "two words", None, None, None)]
    return rows, items


def leaks(rows, items):
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for item, text in items:
        words = plain(text)
        n = min(5, len(words))
        want = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if n else []
        for d, t, *_ in rows:
            have = plain(t)
            have = [tuple(have[k : k + n]) for k in range(len(have) - n + 1)]
            if not set(want) & set(have):
                continue
            best = 0.0
            for k in range(max(1, len(have) - len(want) + 1)):
                a, b = Counter(have[k : k + len(want)]), Counter(want)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                out[d, item] = best
    return out


@pytest.mark.parametrize("inline", [200_000, 10])
def test_leaks(spark, inline):
    rows, items = leaking()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS _n", "2 AS doc_id")
    df = samples.frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(df, bench, inline=inline).collect()}
    want = leaks(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(want) > 2 * ITEMS


@pytest.mark.parametrize("inline", [200_000, 10])
def test_leaks_in_another_order(spark, inline):
    """Swapped sentences, moved pieces and repeated shingles: no single hit tells where the window lies."""
    rng = random.Random(8)
    items, rows = [], []
    for k in range(8):
        first, second, third = (samples.prose(rng, "xx", n).replace(".", "").split(" ") for n in (rng.randint(20, 45), rng.randint(20, 45), 30))
        items.append((k, " ".join(first + second)))
        items.append((100 + k, " ".join(first + first + third + third)))
        for j, body in enumerate([second + first, second[3:] + first, third + first + third + first, first * 4, third + third + first + first]):
            around = [samples.prose(rng, "yy", n) for n in (25 * (j % 2), rng.choice([0, 12]))]
            rows.append((100 * k + j, f"{around[0]} {' '.join(body)} {around[1]}", None, None, None))
    df = samples.frame(spark, [*rows, rows[0]])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(df, spark.createDataFrame(items, "item_id long, text string"), inline=inline).collect()}
    want = leaks(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {(100 * k, k) for k in range(8)} <= want.keys()


def test_items_without_an_id(spark):
    rng = random.Random(9)
    first, second, third = (samples.prose(rng, "xx", 40) for _ in range(3))
    rows = [(k, f"{samples.prose(rng, 'yy', 20)} {body}", None, None, None) for k, body in enumerate([first, second, third, samples.prose(rng, "yy", 30)])]
    bench = spark.createDataFrame([(None, first), (None, second), (1, third), (1, first), (2, third)], "item_id long, text string")
    df = samples.frame(spark, rows)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()} == {(0, None), (0, 1), (1, None), (2, 1), (2, 2)}
    assert [r["doc_id"] for r in decontamination.clean(df, bench).collect()] == [3]


def test_clean(spark):
    rows, items = leaking()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = samples.frame(spark, rows)
    bad = {d for d, _ in leaks(rows, items)}
    left = decontamination.clean(df, bench)
    assert left.columns == df.columns
    assert Counter(r["doc_id"] for r in left.select("doc_id").collect()) == Counter(d for d, *_ in rows if d not in bad)
    assert decontamination.clean(df, bench.limit(0)).count() == len(rows)
    assert decontamination.leaks(samples.empty(spark), bench).collect() == []


def test_blocks_find_every_fingerprint_within_the_radius():
    """Two fingerprints at most 19 bits apart are at most 4 apart in one of four blocks."""
    rng = random.Random(1)
    masks = set(decontamination.variations(19 // decontamination.BLOCKS))
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 19):
            y ^= 1 << bit
        assert any(((x ^ y) >> 16 * k) & 0xFFFF in masks for k in range(4))
