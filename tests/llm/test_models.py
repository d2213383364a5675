import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterfold.llm import language_id, lm_score
from meterfold.llm.common import remainder
from tests.llm import samples

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + ["</s>"]


def brute_force(rows, learn):
    """(base, score, known) of every row by a walk through dictionaries."""
    taught = [tokens(t) for (d, t, *_), ok in zip(rows, learn) if ok]
    c = Counter(w for t in taught for w in t)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in taught for p in zip(["<s>", *t[:-1]], t))
    states = Counter(x.bit_length() for x in c.values())
    after = Counter(0 if h == "<s>" else c[h].bit_length() for h, _ in pairs)
    out = []
    for _, t, *_ in rows:
        base = score = 0.0
        for h, w in zip(["<s>", *tokens(t)[:-1]], tokens(t)):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1)) if n else 1.0
            k = c[h].bit_length()
            left, strength = (len(taught), max(1, after[0])) if h == "<s>" else (c[h], max(1, after[k] / states[k]) if k else 1.0)
            base += math.log10(p)
            score += math.log10((pairs[h, w] + strength * p) / (left + strength))
        out.append((base, score, sum(c[w] > 0 for w in tokens(t)), len(tokens(t)), n))
    return out


@pytest.mark.parametrize("chunk", [lm_score.CHUNK_TOKENS, 500])
def test_scores_equal_a_walk_through_dictionaries(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK_TOKENS", chunk)
    rows = samples.documents()
    learn = [d is not None and zlib.crc32(str(d).encode()) % 5 != 1 for d, *_ in rows]
    got = lm_score.score(samples.frame(spark).withColumn("learn", remainder("doc_id", 5) != 1)).collect()
    want = sorted(((d is None, d or 0), *w) for (d, *_), w in zip(rows, brute_force(rows, learn)))
    have = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["base_score"], r["score"], r["n_known"], r["n_tokens"], r["train_tokens"]) for r in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[0] == b[0] and a[3:] == b[3:] and np.allclose(a[1:3], b[1:3], rtol=1e-9)


def test_probabilities_of_a_state_add_up_to_one(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(["a b a", "a a b", "c", "b a"])]
    ask = [(100 + k, f"a {w}", None, None, None) for k, w in enumerate(["a", "b", "c", "unknown"])] + [(200, "a", None, None, None)]
    df = samples.frame(spark, rows + ask, clashing=False).withColumn("learn", F.col("doc_id") < 100)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df).collect()}
    known = brute_force(rows + ask, [True] * 4 + [False] * 5)
    assert np.allclose([got[100 + k] for k in range(4)], [x[1] for x in known[4:8]])
    # P(w | a) for every learned word, the end and one unknown word, from pairs of texts that differ in it.
    c = Counter(w for _, t, *_ in rows for w in tokens(t))
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for _, t, *_ in rows for p in zip(["<s>", *tokens(t)[:-1]], tokens(t)))
    for h in ("a", "b"):
        for strength in (1.0, 2.5):
            total = sum((pairs[h, w] + strength * (c[w] + 0.5) / (n + 0.5 * (v + 1))) / (c[h] + strength) for w in [*c, "?"])
            assert math.isclose(total, 1.0)


def automaton(rows, learn, order):
    """States as tuples of words, one walk a text: (score, states visited with P(. | state) as a function)."""
    taught = [["<s>", *tokens(t)] for (d, t, *_), ok in zip(rows, learn) if ok]
    c = {k: Counter(tuple(t[i : i + k]) for t in taught for i in range(len(t) - k + 1)) for k in range(1, order + 1)}
    starts = c[1].pop(("<s>",), 0)
    n, v = sum(c[1].values()), len(c[1])
    strength = {}
    for k in range(1, order):
        own = Counter(x.bit_length() for x in c[k].values())
        after = Counter(0 if g[:-1] == ("<s>",) else c[k][g[:-1]].bit_length() for g in c[k + 1])
        strength[k] = {size: max(1.0, after[size] / own[size]) if own[size] else 1.0 for size in range(64)}
        if k == 1:
            strength[k][0], first = 1.0, max(1.0, after[0])

    def often(h):
        return starts if h == ("<s>",) else c[len(h)][h]

    def weight(h):
        return first if h == ("<s>",) else strength[len(h)][often(h).bit_length()]

    def prob(h, w):
        if not h:
            return (c[1][(w,)] + 0.5) / (n + 0.5 * (v + 1)) if n else 1.0
        return (c[len(h) + 1][(*h, w)] + weight(h) * prob(h[1:], w)) / (often(h) + weight(h))

    scores, states = [], set()
    for _, t, *_ in rows:
        state, score = ("<s>",) if starts and order > 1 else (), 0.0
        for w in tokens(t):
            states.add(state)
            while state and not c[len(state) + 1][(*state, w)]:
                score += math.log10(weight(state) / (often(state) + weight(state)))
                state = state[1:]
            score += math.log10(prob(state, w))
            state = (*state, w) if state or c[1][(w,)] else ()
            state = state[len(state) - order + 1 :] if len(state) >= order else state
        scores.append(score)
    words = [w for (w,) in c[1]]
    return scores, {h: sum(prob(h, w) for w in [*words, "an unknown word"]) for h in states}


@pytest.mark.parametrize(("order", "chunk", "piece"), [(1, 500, 1024), (2, 500, 7), (3, 2_000_000, 1024), (3, 500, 7), (4, 800, 5)])
def test_a_carried_state_of_any_order(spark, monkeypatch, order, chunk, piece):
    monkeypatch.setattr(lm_score, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lm_score, "PIECE", piece)
    rows = [r for r in samples.documents() if r[0] is not None and r[0] != 207]
    rows += [(300 + k, rows[k][1], None, None, None) for k in range(20)]
    learn = [zlib.crc32(str(d).encode()) % 5 != 1 for d, *_ in rows]
    got = lm_score.score(samples.frame(spark, rows).withColumn("learn", remainder("doc_id", 5) != 1), order=order).collect()
    want, sums = automaton(rows, learn, order)
    have = sorted((r["doc_id"], r["score"]) for r in got)
    assert np.allclose([x for _, x in have], [x for _, x in sorted(zip([d for d, *_ in rows], want))], rtol=1e-9)
    assert all(math.isclose(x, 1.0, rel_tol=1e-9) for x in sums.values())
    if order == 2:
        assert np.allclose(want, [x[1] for x in brute_force(rows, learn)], rtol=1e-9)


def test_nothing_to_learn_from(spark):
    df = samples.frame(spark).withColumn("learn", F.lit(None).cast("boolean"))
    assert {(r["base_score"], r["train_tokens"], r["n_known"]) for r in lm_score.score(df).collect()} == {(0.0, 0, 0)}
    assert lm_score.score(samples.empty(spark).withColumn("learn", F.lit(True))).collect() == []


def labelled(n=240):
    rng = random.Random(5)
    return [(k, samples.prose(rng, lang, rng.randint(3, 40)), lang, None, None) for k in range(n) for lang in [["xx", "yy"][k % 2]]]


def test_language_identification_on_held_out_rows(spark):
    rows = labelled() + [(1000 + k, t, lang, s, n) for k, (_, t, lang, s, n) in enumerate(samples.documents())]
    df = samples.frame(spark, rows)
    model = language_id.fit(df.filter(remainder("doc_id", 3) != 1), per_language=40, landmarks=20)
    assert model.languages == ["xx", "yy"]
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    held = [r for r in rows if r[0] < 240 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[d]["lang_pred"] == lang for d, _, lang, *_ in held) >= 0.99 * len(held)
    for d, t, *_ in rows:
        lettered = any(ch.isalpha() for ch in t or "")
        assert (got[d]["lang_pred"] == "und") == (not lettered)
        assert 0 <= got[d]["score"] <= 1 and (lettered or got[d]["score"] == 0)
    assert language_id.predict(samples.empty(spark), model).collect() == []
    kept = language_id.predict(df, model, keep=True).select("given.*")
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_labels_and_ids_do_not_matter_for_a_prediction(spark):
    df = samples.frame(spark, labelled(60))
    model = language_id.fit(df, per_language=20, landmarks=10)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, model).collect()}
    changed = df.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 7)
    assert {r["doc_id"] - 7: (r["lang_pred"], r["score"]) for r in language_id.predict(changed, model).collect()} == plain


def test_no_labels(spark):
    model = language_id.fit(samples.frame(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.predict(samples.frame(spark), model).collect()} == {"und"}


def test_scoring_equals_the_kernel(spark):
    """The folded matrix gives what landmarks, features and regression give step by step."""
    rows = labelled(40)
    model = language_id.fit(samples.frame(spark, rows), per_language=20, landmarks=10, most_grams=10_000)
    scorer = language_id.Scorer(model)
    for _, text, *_ in rows[:10]:
        points, at = language_id.lowered(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        found = np.isin(model.grams, language_id.gram_set(np.append(points, np.uint32(0))))
        want = found.astype(np.float32) @ model.weights / np.sqrt(found.sum())
        assert np.allclose(scorer.scores(points, at)[0][0], want, atol=1e-4)


def test_many_languages_and_a_script_of_many_letters(spark):
    """80 languages are all learned, the rarest too, and thousands of different letters count."""
    rng = random.Random(9)
    rows = []
    for k in range(80):
        letters = [chr(c) for c in rng.sample(range(ord("a"), ord("z") + 1), 8)]
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(25)]
        rows += [(100 * k + j, " ".join(rng.choices(words, k=30)), f"l{k:02}", None, None) for j in range(60 if k < 3 else 12)]
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows += [(9000 + j, "".join(rng.choices(han[:1500], k=400)), "zh", None, None) for j in range(20)]
    rows += [(9100 + j, "".join(rng.choices(han[1500:], k=400)), "zy", None, None) for j in range(20)]
    df = samples.frame(spark, rows)
    model = language_id.fit(df.filter(remainder("doc_id", 3) != 1))
    assert len(model.languages) == 82
    assert len({int(g & np.uint64((1 << 21) - 1)) for g in model.grams}) > 254
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()}
    held = [(d, lang) for d, _, lang, *_ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(got[d] == lang for d, lang in held) >= 0.95 * len(held)
    assert all(got[d] == lang for d, lang in held if lang in ("zh", "zy"))


def test_one_id_on_many_rows_and_texts_of_one_batch(spark):
    """The sample stays bounded, and a text's score does not depend on its neighbours in the batch."""
    rows = [(7, t, lang, s, n) for _, t, lang, s, n in labelled(120)]
    model = language_id.fit(samples.frame(spark, rows), per_language=20, landmarks=10)
    assert model.languages == ["xx", "yy"]
    scorer = language_id.Scorer(model)

    def scores(texts):
        data = [t.encode() for t in texts]
        offsets = np.cumsum([0, *(len(x) for x in data)])
        return scorer.scores(*language_id.lowered(np.frombuffer(b"".join(data), np.uint8), offsets))[0]

    texts = [t for _, t, *_ in rows[:12]] + ["", "ba", "7"]
    assert np.allclose(scores(texts), np.concatenate([scores([t]) for t in texts]), atol=1e-5)
