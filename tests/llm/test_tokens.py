import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterfold.llm import packing, token_counts
from meterfold.llm.common import byte_slices
from tests.llm import samples

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LETTERS = "abcdefghistreonTH'svelmdr  \n\t\x0b\xa0!?.,0129éüß漢字🙂́Ⅷ²ǅ"


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def prefixes(texts):
    counter = token_counts.TextCounter.of(PATH)
    for _, data, offsets in byte_slices(pa.array(texts)):
        counts, at = counter.rows(data, offsets)
        yield from (counts[a:b].tolist() for a, b in zip(at[:-1], at[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS, max_size=25), min_size=1, max_size=4))
def test_counts_of_all_prefixes_equal_the_library(texts):
    for text, got in zip(texts, prefixes(texts)):
        assert got == [len(ids(text[:k])) for k in range(1, len(text) + 1)]


def test_special_strings_contractions_and_long_pieces():
    texts = ["  <|endoftext|> a", "x <|endoftext|><|endoftext|>", "<|endof", "we've don't 'rest  'll", "a" * 300 + " " * 70 + "b", "", None]
    for text, got in zip(texts, prefixes(texts)):
        text = text or ""
        assert got == [len(ids(text[:k])) for k in range(1, len(text) + 1)]


def test_thousands_of_special_strings():
    text = "<|endoftext|> a" * 5000
    (got,) = prefixes([text])
    assert len(got) == len(text) and got[-1] == len(ids(text))
    assert [got[k - 1] for k in (1, 13, 14, 15, 28, 30)] == [len(ids(text[:k])) for k in (1, 13, 14, 15, 28, 30)]


def test_the_leftmost_of_two_special_strings(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.add_special_tokens(["<|end|>", "<|end|>more"])
    other.save(str(tmp_path / "two.json"))
    counter = token_counts.TextCounter(str(tmp_path / "two.json"))
    for text in ("a<|end|>b<|endoftext|>c", "<|endoftext|><|end|>x<|end|>", "q <|end|>mox"):
        want = [len(other.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        for _, data, offsets in byte_slices(pa.array([text])):
            assert counter.rows(data, offsets)[0].tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    encoder = packing.TextEncoder.of(PATH)
    got = [x.tolist() for _, data, offsets in byte_slices(pa.array(texts)) for x in encoder.rows(data, offsets)]
    assert got == [ids(t) for t in texts]


def test_token_counts(spark):
    rows = token_counts.over_limit(token_counts.token_counts(samples.frame(spark), PATH, budgets=(7,), tables=True), 7).collect()
    texts = [(r[0], r[1] or "") for r in samples.documents()]
    want = sorted((d is None, d or 0, len(t.encode()), len(ids(t))) for d, t in texts)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    by_id = dict(texts)
    for r in rows:
        text = by_id[r["doc_id"]]
        if len(text) > 400:
            continue
        assert r["over_limit"] == (r["n_tokens"] > 7)
        fits = [k for k in range(len(text) + 1) if len(ids(text[:k])) <= 7]
        assert r["fit_7"] == fits[-1] == token_counts.longest_fit(r["prefix_counts"], 7)
        assert [token_counts.tokens_at(r["prefix_counts"], k) for k in (0, len(text))] == [0, r["n_tokens"]]
    assert token_counts.token_counts(samples.empty(spark), PATH).collect() == []


def check_packed(rows, docs, window=64):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, texts in docs.items():
        want = [np.array(ids(t) + [0], "<u4") for t in texts]
        got = sorted(pieces[doc_id], key=lambda r: (r["start"], r["length"]))
        assert sum(r["length"] for r in got) == sum(map(len, want))
        if len(texts) == 1:
            at = 0
            for r in got:
                assert r["start"] == at and r["doc_tokens"] == len(want[0])
                at += r["length"]
                assert r["ids_crc32"] == zlib.crc32(want[0][r["start"] : at].tobytes())
    total = padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(1, total)


def test_packing(spark):
    rows = packing.pack(samples.frame(spark), PATH, window=64, max_gap=1, per_shard=40).collect()
    docs = defaultdict(list)
    for r in samples.documents():
        docs[r[0]].append(r[1] or "")
    assert check_packed(rows, docs) < 0.03
    assert packing.pack(samples.empty(spark), PATH).collect() == []


def test_packing_of_equal_lengths_leaves_no_gaps():
    got = packing.arranged([700] * 2000, 1024, 8)
    assert sum(1 for s in got if sum(b - a for _, a, b in s) < 1016) <= 10
    assert sorted(x for s in got for x in s)[0] == (0, 0, 700)


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_takes_the_tightest_window(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
    free, plain = [], []
    for k, size in enumerate(sizes):
        fits = [(room, w) for w, room in enumerate(free) if room >= size]
        room, w = min(fits) if fits else (100, len(free))
        if not fits:
            free.append(100)
            plain.append([])
        free[w] -= size
        plain[w].append(k)
    got = packing.best_fit(sizes, 100)
    assert len(got) == len(plain)
    assert sorted(sum(sizes[k] for k in w) for w in got) == sorted(sum(sizes[k] for k in w) for w in plain)
