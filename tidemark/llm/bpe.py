"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of a word. A proposal is what exact merging gives if every
token is and every adjacent pair of tokens is *compatible*: merging the pair's symbols alone leaves
a border between the two. All pairs of a batch are tested together, as array operations; only words
with an incompatible pair are merged exactly. Words are remembered in a bounded table.

Reads tokenizer files of the ``tokenizers`` library whose model is BPE with a word-end suffix, whose
normaliser is NFC, white space and lower case and which split words before mapping bytes to
characters. Results equal the library's ``encode(add_special_tokens=False)`` and
``decode(skip_special_tokens=False)``.

Rules for odd rows: a null text is empty; an empty text has no ids and decodes to an empty text;
a long text is encoded in pieces cut at white space, whole; equal rows get equal ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm.common import slices

#: Entries of the table of known pieces, and bytes of text that are cut into pieces at once.
KNOWN, SPAN = 300_000, 1 << 20
NEVER = int(np.iinfo(np.int64).max)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class Bpe:
    """One tokenizer file, its words and its rules for merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not self.suffix or kinds != ["NFC", "Replace", "Lowercase"] or not splitter["invert"]:
            raise ValueError(f"{path} is not a BPE tokenizer of the kind described above")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on their surroundings")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")")
        self.library = Tokenizer.from_file(path)  # only its normaliser and word splitter are used, on rare letters
        self.words_of = regex.compile(splitter["pattern"]["Regex"]).findall
        self.to_characters = {b: c for b, c in enumerate(byte_characters())}
        self.longest = max(map(len, self.vocab))
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.tokens = np.array([b""] * size, dtype=object)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token if isinstance(token, bytes) else token.encode()
        self.token_list = self.tokens.tolist()

        self.pair_rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.rank[z] >= 0 or max(self.rank[x], self.rank[y]) >= r:
                raise ValueError("a token has two merges, or a merge comes before its parts")
            self.pair_rank[x, y] = r
            self.made.append(z)
            self.rank[z], self.left[z], self.right[z] = r, x, y
        # how far a token can reach that does not end a word, by its first characters
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            if not token.endswith(self.suffix):
                self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        keys = np.array([x << 32 | y for x, y in self.pair_rank], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.whole = np.zeros(size, dtype=np.int8)  # 0 unknown, 1 merges to itself, -1 does not
        self.known, self.older, self.known_words = {}, {}, {}

    # -- exact ------------------------------------------------------------------------------

    def symbols(self, characters: str) -> list[int]:
        return [*(self.vocab[c] for c in characters[:-1]), self.vocab[characters[-1] + self.suffix]]

    def merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        if len(ids) > 24:
            return self.merged_by_heap(ids)
        # of few symbols the best pair is found sooner by looking at all
        get, made = self.pair_rank.get, self.made
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i:i + 2] = [z := made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], z), NEVER)
            if i < len(ranks):
                ranks[i] = get((z, ids[i + 1]), NEVER)
        return ids

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        n, get, made = len(ids), self.pair_rank.get, self.made
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get((ids[i], ids[j])) != r:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for h, j in ((before[i], i), (i, k)):
                if h >= 0 and j < n and (r := get((ids[h], ids[j]))) is not None:
                    heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    # -- speculative ------------------------------------------------------------------------

    def proposal(self, characters: str) -> list[int]:
        """Greedy longest match."""
        vocab, reach, n, out, i = self.vocab, self.reach, len(characters), [], 0
        while i < n:
            if n - i < self.longest and (token := vocab.get(characters[i:] + self.suffix)) is not None:
                out.append(token)
                break
            for j in range(min(n - 1, i + reach.get(characters[i:i + 3], 2)), i, -1):
                if (token := vocab.get(characters[i:j])) is not None:
                    out.append(token)
                    i = j
                    break
        return out

    def self_merging(self, tokens: np.ndarray) -> np.ndarray:
        for t in np.unique(tokens[self.whole[tokens] == 0]).tolist():
            parts = [t]
            while (k := next((i for i, p in enumerate(parts) if self.rank[p] >= 0), None)) is not None:
                parts[k:k + 1] = [int(self.left[parts[k]]), int(self.right[parts[k]])]
            self.whole[t] = 1 if self.merged(parts) == [t] else -1
        return self.whole[tokens] == 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between the tokens ``a`` and ``b``, for each pair.

        The merges next to the border are undone from the last to the first. Between two of them
        the border lies between two known pieces; if those could be merged, and earlier than the
        merge that was undone, exact merging would have closed the border.
        """
        a, b = a.copy(), b.copy()
        good, limit, live = np.ones(len(a), dtype=bool), np.full(len(a), NEVER), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            closes = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            good[live[closes]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~closes & (np.maximum(rx, ry) >= 0)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            left = rx > ry  # of two merges of one rank the left one comes first, so it is undone last
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
            limit[live] = np.where(left, rx, ry + 1)
        return good

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, each given as the characters of its bytes."""
        proposals = [self.proposal(w) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        failed = np.zeros(len(words), dtype=bool)
        failed[word[~self.self_merging(flat)]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, at = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed[word[inner[~good[at]]]] = True
        ends = np.cumsum(sizes)
        return [np.array(self.merged(self.symbols(words[k])) if bad else flat[e - n:e], dtype="<u4")
                for k, (bad, e, n) in enumerate(zip(failed.tolist(), ends.tolist(), sizes.tolist(), strict=True))]

    # -- texts ------------------------------------------------------------------------------

    def words(self, piece: bytes) -> list[str]:
        """Words of a text, as characters that stand for bytes."""
        text = piece.decode("utf-8", "replace")
        if text and max(text) >= "\u0250":  # beyond Latin, classes of characters depend on the Unicode version
            spans = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [w for w, _ in spans]
        found = self.words_of(text.lower())
        if text.isascii() and text.isprintable():
            return found
        return [w.encode().decode("latin-1").translate(self.to_characters) for w in found]

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of pieces that are free of special tokens."""
        words = [self.words(p) for p in pieces]
        ids = self.known_words
        new = list(set().union(*words).difference(ids))
        if len(ids) + len(new) > KNOWN:
            self.known_words = ids = {w: ids[w] for w in set().union(*words).intersection(ids)}
        if new:
            ids.update(zip(new, map(np.ndarray.tobytes, self.encode_words(new)), strict=True))
        return {p: b"".join([ids[w] for w in ws]) for p, ws in zip(pieces, words, strict=True)}

    def cut(self, text: bytes) -> Iterator[list[bytes] | bytes]:
        """Lists of pieces without white space, and the packed ids of special tokens between them."""
        for k, span in enumerate(self.special_at.split(text)):
            if k % 2:
                yield self.special[span].to_bytes(4, "little")
                continue
            start = 0
            while start < len(span):
                end = span.find(b" ", start + SPAN)
                end = len(span) if end < 0 else end
                yield span[start:end].split()
                start = end

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        known, older = self.known, self.older
        parts = [list(self.cut(text)) for text in texts]
        new = set().union(*(pieces for own in parts for pieces in own if isinstance(pieces, list))).difference(known)
        known.update({p: older[p] for p in new if p in older})
        missing = [p for p in new if p not in known]
        if missing:
            known.update(self.learn(missing))
        get = known.__getitem__
        out = [b"".join([p if isinstance(p, bytes) else b"".join(map(get, p)) for p in own]) for own in parts]
        if len(known) > KNOWN:
            self.older, self.known = known, {}
        return out

    def decode(self, packed: bytes) -> bytes:
        return b" ".join(map(self.token_list.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _with(df: DataFrame, keep: tuple[str, ...], column: str, fn, output: str, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """``keep`` and ``output``, made from ``column`` batch by batch."""
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(output, kind)])
    names, width = [f.name for f in schema.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = pa.array(fn([x or b"" for x in b.column(width).cast(pa.binary()).to_pylist()]), pa.binary()).cast(arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], made], names=names)

    return df.select(*keep, column).mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), output: str = "ids") -> DataFrame:
    """The columns ``keep`` and the ids of ``text``, packed as little-endian 32-bit integers.

    ``tokenizer`` is the file's path, the same on every machine.
    """
    return _with(df, keep, text, lambda texts: load(tokenizer).encode(texts), output, T.BinaryType(), pa.binary())


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), output: str = "text") -> DataFrame:
    """The columns ``keep`` and the text of packed ids."""
    return _with(df, keep, ids, lambda packed: [load(tokenizer).decode(p) for p in packed], output, T.StringType(), pa.string())


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The columns ``keep``, the packed ids of ``text`` and the text decoded from them; one worker a task does both, so one vocabulary is loaded."""
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    names, width = [f.name for f in schema.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in slices(batches):
            packed = bpe.encode([x or b"" for x in b.column(width).cast(pa.binary()).to_pylist()])
            back = pa.array([bpe.decode(p) for p in packed], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(packed, pa.binary()), back], names=names)

    return df.select(*keep, text).mapInArrow(run, schema)
