import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterfold.llm import bpe_codec, fill_in_middle, prefix_trie
from meterfold.llm.common import byte_slices
from tests.llm import samples

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe_codec.Vocabulary(PATH)
LETTERS = "abcdefghistreonTH'svelmdr  \n\t\x0b\xa0!?.,0129éüß漢字🙂́Ⅷ²ǅ"


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def encoded(texts):
    codec = bpe_codec.Codec.of(PATH)
    return [x.tolist() for _, data, offsets in byte_slices(pa.array(texts, pa.string())) for x in codec.encode(data, offsets)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=LETTERS, max_size=40), st.text(max_size=30)), min_size=1, max_size=4))
def test_ids_equal_the_library_and_decode_to_the_text(texts):
    ids = encoded(texts)
    assert ids == [library_ids(t) for t in texts]
    codec = bpe_codec.Codec.of(PATH)
    assert [codec.decode(np.array(x, "<u4")) for x in ids] == texts


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=30))
def test_pieces_of_any_bytes_equal_plain_merging(piece):
    """Merges applied one by one, the lowest rank first, the leftmost of equal ones first."""
    vocabulary = VOCABULARY
    parts = [vocabulary.ids[bytes([b])] for b in piece]
    while True:
        ranked = [(vocabulary.rank[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in vocabulary.rank]
        if not ranked:
            break
        _, k = min(ranked)
        parts[k : k + 2] = [vocabulary.ids[vocabulary.bytes[parts[k]] + vocabulary.bytes[parts[k + 1]]]]
    assert bpe_codec.Codec.of(PATH).encode_piece(piece) == parts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=12))
def test_decoding_of_any_ids_equals_the_library(ids):
    assert bpe_codec.Codec.of(PATH).decode(np.array(ids, "<u4")) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>" * 5000, " <|endoftext|> a<|endof", "a" * 60_000, "ab" * 30_000 + " " * 999, "aaaaaaab" * 500, "don't we've 'rest", "", "\x00é" * 300])
def test_special_strings_and_long_pieces(text):
    texts = [text, "<|endof", "text|>", "", text[::-1]]
    assert encoded(texts) == [library_ids(t) for t in texts]


def test_the_leftmost_of_two_special_strings(tmp_path):
    other = Tokenizer.from_file(PATH)
    other.add_special_tokens(["<|end|>", "<|end|>more"])
    other.save(str(tmp_path / "two.json"))
    codec = bpe_codec.Codec(str(tmp_path / "two.json"))
    for text in ("a<|end|>b<|endoftext|>c", "<|endoftext|><|end|>more<|end|>", "<|end|>mor<|endoftext|"):
        found = [x.tolist() for _, data, offsets in byte_slices(pa.array([text])) for x in codec.encode(data, offsets)]
        assert found == [other.encode(text, add_special_tokens=False).ids]


def test_codec_over_tables(spark):
    rows = bpe_codec.decode(bpe_codec.encode(samples.frame(spark), PATH), PATH).collect()
    want = sorted((str(r[0]), r[1] or "", library_ids(r[1] or "")) for r in samples.documents())
    assert sorted((str(r.doc_id), r.text, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert bpe_codec.decode(bpe_codec.encode(samples.empty(spark), PATH), PATH).collect() == []
    none = spark.createDataFrame([(1, 0, None)], bpe_codec.ENCODED)
    assert bpe_codec.decode(none, PATH).first().text == ""


def cut_by_hand(doc_id, text, rate=90, spm=20):
    """Units one by one, without a regular expression."""
    units = []
    for c in text:
        if c.isascii() and c.isalpha() and units and units[-1][-1].isascii() and units[-1][-1].isalpha():
            units[-1] += c
        else:
            units.append(c)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(2)
    odd = ["<P>", "a<S>b", "<<P", "<", "x<M", "S>y<", "é", "\r\n", "a" * 90_000, "a b" * 40_000, "漢字🙂́ ²", "<P<S<M"]
    more = [(1000 + k, rng.choice(odd) + "".join(rng.choice("ab <PSM>é\n") for _ in range(rng.randint(0, 12))), None, None, None) for k in range(400)]
    rows = samples.documents() + more
    cut = fill_in_middle.transform(samples.frame(spark, rows))
    got = cut.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(
        map(str, ((d, *cut_by_hand(d, t or "")) for d, t, *_ in rows))
    )
    texts = defaultdict(set)
    for d, t, *_ in rows:
        texts[d].add(t or "")
    assert all(r.again in texts[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(samples.empty(spark)).collect() == []


def test_fill_in_middle_rates_and_the_length_of_texts(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some text of eight words, no more.").alias("text"))
    assert {r.form for r in fill_in_middle.transform(docs, rate=100, spm=0).select("form").distinct().collect()} == {"psm"}
    assert {r.form for r in fill_in_middle.transform(docs, rate=0).select("form").distinct().collect()} == {"plain"}
    share = fill_in_middle.transform(docs, rate=50, spm=50).groupBy("form").count().collect()
    assert all(300 < r["count"] < 1200 for r in share)
    text = "ab c, " * 1_000_000
    n, form, a, b, output = fill_in_middle.transformed(text, [3_000_001, 4_000_000, 0, 99], fill_in_middle.tiling(), 90, 20)
    assert (n, form) == (5_000_000, "psm") and output == f"<P>{text[:a]}<S>{text[a + b:]}<M>{text[a : a + b]}"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abZ .é", max_size=60), st.integers(1, 9))
def test_windows_end_the_same_units(text, window):
    tiles = fill_in_middle.tiling()
    assert list(fill_in_middle.unit_ends(text, tiles, window)) == tiles.fullmatch(text).ends(1)


TURN = "conv_id long, turn long, role string, text string"


def nodes_by_hand(turns, again=True):
    """Every prefix of every rebuilt conversation in a dictionary."""
    own = defaultdict(list)
    for conv_id, turn, role, text in turns:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(rows)] for c, rows in own.items()}
    built = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if again else 0
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + rows[h:]) if again else tuple(rows)
    members = defaultdict(list)
    for c, rows in built.items():
        for d in range(len(rows) + 1):
            members[rows[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        own_saving = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [sums[x] for x in children[node]]
        sums[node] = (sum(x[0] for x in below) or 1, own_saving + sum(x[1] for x in below))
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if built[c] == node)
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_rows(turns, again=True, **how):
    found = prefix_trie.sequences(turns)
    nodes = prefix_trie.trie(prefix_trie.rebuilt(found) if again else found, **how)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in nodes.select(*columns).collect()), key=str)


def conversations(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for c in range(-10, n):
        if rng.random() < 0.1:
            continue
        length = rng.choice([1, 2, 3, 5, 9, 12])
        for t in range(length):
            odd = rng.random()
            text = None if odd < 0.05 else "" if odd < 0.1 else rng.choice(["hello", "hé", "ok"]) if t else "hello"
            rows.append((c * (1 if seed else 10**15), None if odd > 0.97 else t, rng.choice(["user", None, ""]) if odd < 0.2 else "user", text))
    rows += [(c, t, "user", f"turn {t}") for c in range(1000, 1060) for t in range(20)]  # equal conversations
    rows += [(7, 1, "user", "a tie"), (7, 1, "user", "another tie"), (7, 1, "user", "a tie"), (7, 1, "bot", "x" * 3000), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,per_partition", [(0, 7), (1, 50_000), (2, 3)])
def test_trie_equals_brute_force_at_any_partitioning(spark, seed, per_partition):
    rows = conversations(seed)
    turns = spark.createDataFrame(rows, TURN).withColumns({c: F.lit("extra") for c in ("key", "class", "pid", "node", "n", "ends", "base")}).repartition(3)
    assert trie_rows(turns, per_partition=per_partition) == nodes_by_hand(rows)


def test_trie_of_long_and_of_few_conversations(spark):
    long = [(1, t, "u", f"word {t % 7}") for t in range(3000)] + [(2, t, "u", f"word {t % 7}") for t in range(2500)] + [(3, 0, "u", "alone")]
    assert trie_rows(spark.createDataFrame(long, TURN), again=False, per_partition=1) == nodes_by_hand(long, again=False)
    assert trie_rows(spark.createDataFrame([], TURN)) == []
    # Conversation 6 keeps nothing of its own and has nothing to begin with: the root alone.
    short = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert trie_rows(spark.createDataFrame([(short, 0, "u", "x")], TURN)) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_hot_classes_stream_through_their_digest(spark):
    members = spark.range(-3000, 5000).select(F.col("id").alias("conv_id"), F.lit(b"k" * 16).alias("class"))
    got = prefix_trie.ends_digests(members).collect()
    assert [r.ends for r in got] == [hashlib.sha256(",".join(map(str, range(-3000, 5000))).encode()).hexdigest()]
