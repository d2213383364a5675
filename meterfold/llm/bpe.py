"""Byte-level BPE of the public tokenizers: pieces, ids and exact counts of every prefix.

``Pieces`` cuts a batch of texts into the vocabulary's pre-token pieces with array
operations; equal pieces are found by hash, so each distinct piece is encoded once per
worker. ``PrefixCounter`` is the prefix dynamic program over one piece.
"""

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import tiktoken

from meterfold.llm.common import mix, numbers, powers, spans_hashed

# Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions that are pieces of their own.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Pieces remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 400_000

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE_SPACE] = SPACE
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Starts of the pieces of code points; ``breaks`` are the starts of texts (sorted, in range).

    A piece is a run of letters, numbers or other signs with at most one blank before it; a
    run of white space leaves its last character to what follows; a contraction stands alone
    where a piece begins with its apostrophe.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    begins = np.zeros(n, bool)  # of runs
    begins[1:] = kind[1:] != kind[:-1]
    begins[0] = True
    begins[breaks] = True
    ends = np.zeros(n, bool)  # last of a text
    ends[breaks[1:] - 1] = True
    ends[-1] = True
    white = kind == SPACE
    last_white = np.zeros(n, bool)  # last of a white run that something follows
    last_white[:-1] = white[:-1] & ~white[1:]
    last_white &= ~ends
    blank = points == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (last_white & blank)[:-1]
    starts = (begins & ~after_blank) | last_white
    for text in CONTRACTIONS:
        size = len(text)
        at = np.flatnonzero(points[: n - size + 1] == ord("'"))
        at = at[starts[at] & begins[at]]
        for k, c in enumerate(text[1:], 1):
            at = at[points[at + k] == ord(c)]
        if len(at) and len(breaks) > 1:
            at = at[np.searchsorted(breaks, at, "right") == np.searchsorted(breaks, at + size - 1, "right")]
        starts[at + 1] = False
        after = at + size
        after = after[after < n]
        starts[after] = True
    return np.flatnonzero(starts)


class Pieces:
    """Values of pieces, remembered by hash. ``value`` maps a list of piece strings to a list of arrays."""

    def __init__(self, value: Callable[[list[str]], list[bytes]], width: int):
        self.value, self.width, self.known = value, width, {}

    def of(self, data: bytes, breaks: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, list[bytes]]:
        """(text, starts of pieces with the end, number of each piece's distinct value, values)."""
        text = data.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, breaks[breaks < len(points)])
        bounds = np.append(starts, len(points))
        keys = spans_hashed(points.astype(np.uint64) * _SPREAD + _SEED, bounds[:-1], bounds[1:])
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known = {}
        names = distinct.tolist()
        values = list(map(self.known.get, names))
        missing = [k for k, v in enumerate(values) if v is None]
        if missing:
            found = self.value([text[bounds[w] : bounds[w + 1]] for w in where[missing].tolist()])
            for k, v in zip(missing, found):
                values[k] = self.known[names[k]] = v
        return text, bounds, which, values

    def joined(self, which: np.ndarray, values: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
        """The values of all pieces in order as one array, and how many each piece has."""
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        flat = np.frombuffer(b"".join(values), kind)
        at = np.cumsum(sizes) - sizes
        per_piece = sizes[which]
        begin = np.cumsum(per_piece) - per_piece
        total = int(per_piece.sum())
        return flat[np.repeat(at[which] - begin, per_piece) + np.arange(total)], per_piece


_SPREAD, _SEED = numbers(2, 5) | np.uint64(1)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_vocabulary(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Ids of the byte strings, and the special strings, of a byte-level BPE file.

    Ids of merged tokens rise with the rank of their merge, so they serve as ranks too.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ids = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if all(c in alphabet for c in s)}
    return ids, [t["content"] for t in spec["added_tokens"]]


def piece_encoder(ids: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Merges one piece, whatever it holds."""
    return tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ids, special_tokens={}).encode_ordinary


class TokenTable:
    """Ids of byte strings by hash, for arrays of hashes."""

    BITS = 20

    def __init__(self, ids: dict[bytes, int]):
        names = list(ids)
        self.keys = np.array([hash_bytes(b) for b in names], np.uint64)
        self.ids = np.array([ids[b] for b in names], np.int64)
        self.tables = []
        rest = np.arange(len(names))
        shift = 64 - self.BITS
        while len(rest):
            slots = (self.keys[rest] << np.uint64(13 * len(self.tables))) >> np.uint64(shift)
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slots] = rest
            self.tables.append(table)
            rest = rest[table[slots] != rest]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        flat = hashes.ravel()
        out = np.full(len(flat), -1, np.int64)
        at = None  # where a slot is taken by another key, which alone can hide one in the next table
        for k, table in enumerate(self.tables):
            row = table[(flat << np.uint64(13 * k)) >> np.uint64(64 - self.BITS)]
            taken = np.flatnonzero(row >= 0)
            row = row[taken]
            hit = self.keys[row] == flat[taken]
            out[taken[hit] if at is None else at[taken[hit]]] = self.ids[row[hit]]
            rest = taken[~hit]
            if not len(rest):
                break
            at = rest if at is None else at[rest]
            flat = flat[rest]
        return out.reshape(hashes.shape)


_BYTES = numbers(256, 23)


def hash_bytes(b: bytes) -> int:
    n = _BYTES[np.frombuffer(b, np.uint8)]
    return int(spans_hashed(n, np.zeros(1, np.int64), np.full(1, len(b)))[0])


class PrefixCounter:
    """Exact token counts of every prefix of pieces.

    The encoding of a prefix ends with one token; without it, the encoding of a shorter prefix
    is left. So the last tokens of all prefixes follow from left to right: a token that ends at
    i is the last one if the two tokens at its seam stay apart when they are encoded together.
    Pieces of equal length go through the program side by side.
    """

    SEAMS = 20  # bits of the table of known seams
    LONGEST = 48  # bytes of the pieces that are handled side by side

    def __init__(self, path: str):
        self.ids, self.special = byte_vocabulary(path)
        self.bytes = {i: b for b, i in self.ids.items()}
        self.encode = tiktoken.Encoding("bytes", pat_str=r"(?s).+", mergeable_ranks=self.ids, special_tokens={})._encode_single_piece
        self.table = TokenTable(self.ids)
        self.sizes = sorted({len(b) for b in self.ids})
        self.seams = np.full(1 << self.SEAMS, -1, np.int64)

    def seam(self, a: int, b: int) -> bool:
        """Whether tokens a and b (a = -1: the start) stand side by side in an encoding."""
        return self.encode(self.bytes.get(a, b"") + self.bytes[b]) == ([a, b] if a >= 0 else [b])

    def apart(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        pair = (before + 1 << 20) | token
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(64 - self.SEAMS)).astype(np.int64)
        known = self.seams[slot]
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            distinct, which = np.unique(pair[new], return_inverse=True)
            found = np.fromiter((self.seam((p >> 20) - 1, p & 0xFFFFF) for p in distinct.tolist()), np.int64, len(distinct))
            known[new] = self.seams[slot[new]] = pair[new] * 2 + found[which]
        return (known & 1).astype(bool)

    def equal_length(self, data: np.ndarray) -> np.ndarray:
        """Counts for the pieces in the rows of a matrix of bytes, after each byte."""
        rows, n = data.shape
        up, down = powers(n)
        total = np.zeros((rows, n + 1), np.uint64)
        np.cumsum(_BYTES[data] * up[:-1], axis=1, out=total[:, 1:])
        sizes = [s for s in self.sizes if s <= n]
        tokens = {s: self.table(mix((total[:, s:] - total[:, : n + 1 - s]) * down[: n + 1 - s])) for s in sizes}
        last = np.full((rows, n + 1), -1, np.int64)
        count = np.zeros((rows, n + 1), np.uint32)
        for i in range(1, n + 1):
            open_rows = np.arange(rows)
            for s in reversed(sizes):
                if s > i:
                    continue
                token = tokens[s][open_rows, i - s]
                at = np.flatnonzero(token >= 0)
                if not len(at):
                    continue
                hit = open_rows[at]
                # A prefix that no encoding reaches (inside a character) has count 0 and no last token.
                reached = (count[hit, i - s] > 0) | (s == i)
                ok = np.zeros(len(at), bool)
                ok[reached] = self.apart(last[hit[reached], i - s], token[at[reached]])
                last[hit[ok], i] = token[at[ok]]
                count[hit[ok], i] = count[hit[ok], i - s] + 1
                open_rows = np.delete(open_rows, at[ok])
                if not len(open_rows):
                    break
        return count[:, 1:]

    def counts(self, pieces: list[str]) -> list[np.ndarray]:
        """For each piece the number of tokens of piece[:1], piece[:2], ..., the whole piece."""
        data = [p.encode("utf-8") for p in pieces]
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(data):
            by_size.setdefault(len(b), []).append(k)
        out: list[np.ndarray] = [None] * len(pieces)
        for size, members in by_size.items():
            step = max(1, 200_000 // size)
            for part in (members[k : k + step] for k in range(0, len(members), step)):
                matrix = np.frombuffer(b"".join([data[k] for k in part]), np.uint8).reshape(len(part), size)
                counted = self.equal_length(matrix) if size <= self.LONGEST else np.stack([self.long(data[k]) for k in part])
                ends = np.ones(matrix.shape, bool)  # of characters
                ends[:, :-1] = matrix[:, 1:] & 0xC0 != 0x80
                if ends.all():
                    for k, row in zip(part, counted):
                        out[k] = row
                else:
                    for k, row, end in zip(part, counted, ends):
                        out[k] = row[end]
        return out

    def long(self, data: bytes) -> np.ndarray:
        """The same program over one long piece; only tokens that end there are tried."""
        n = len(data)
        last, count = [-1] * (n + 1), np.zeros(n + 1, np.uint32)
        known: dict[tuple[int, int], bool] = {}
        for i in range(1, n + 1):
            for s in reversed(self.sizes):
                token = self.ids.get(data[i - s : i]) if s <= i else None
                if token is None or (s < i and not count[i - s]):
                    continue
                pair = (last[i - s], token)
                if pair not in known:
                    known[pair] = self.seam(*pair)
                if known[pair]:
                    last[i], count[i] = token, count[i - s] + 1
                    break
        return count[1:]
