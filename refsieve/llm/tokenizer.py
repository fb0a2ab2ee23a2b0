"""Encoding with a public byte-level BPE vocabulary: speculate and verify.

Texts are cut into words by the vocabulary's pattern. For the words that a task has not met yet, greedy longest match
proposes tokens for all words at once, and every adjacent pair of proposed tokens is checked for compatibility: the two
tokens must be what BPE makes of their joined bytes. A word whose pairs are all compatible is encoded right; only words
with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers before it starts over; bounds memory alone, results are the same.
MEMO_WORDS = 300_000
#: Characters of a batch of texts that is handled at once.
BATCH_CHARS = 2_000_000

# Fixed value: the pattern that cuts texts into words for this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and lookup tables of a byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        chars = _byte_chars()
        self.bytes_of: dict[int, bytes] = {}
        for token, k in model["vocab"].items():
            if all(c in chars for c in token):
                self.bytes_of[k] = bytes(chars[c] for c in token)
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        n = max(vocab.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank = np.full(n, -1, np.int64)  # rank of the merge that makes a token; -1: a byte
        for rank, (a, b) in enumerate(pairs):
            made = vocab[a + b]
            self.pair[vocab[a], vocab[b]] = (rank, made)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], rank
        self.byte_id = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        code = np.fromiter((a * n + b for a, b in self.pair), np.int64, len(self.pair))
        order = np.argsort(code)
        self.n, self.codes = n, code[order]
        self.code_rank = np.fromiter((r for r, _ in self.pair.values()), np.int64, len(self.pair))[order]
        # Only tokens that BPE can make are proposed; hashes of the tokens by length.
        usable = {k: v for k, v in self.bytes_of.items() if self.rank[k] >= 0 or len(v) == 1}
        self.longest = max(map(len, usable.values()))
        self.size = np.zeros(n, np.int64)
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, self.longest + 1):
            ids = np.array([k for k, v in usable.items() if len(v) == size], np.int64)
            if len(ids):
                flat = np.frombuffer(b"".join(usable[k] for k in ids), np.uint8).reshape(-1, size)
                h = np.zeros(len(ids), np.uint64)
                for col in range(size):
                    h = h * _BASE + (flat[:, col].astype(np.uint64) + _ONE)
                order = np.argsort(h)
                self.by_len[size] = (h[order], ids[order])
                self.size[ids] = size
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(k, b"") for k in range(n)), np.uint8)
        self.offset = np.r_[0, np.cumsum([len(self.bytes_of.get(k, b"")) for k in range(n)])]
        self.known: dict[int, bool] = {}

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between two adjacent tokens, for many pairs at once.

        The border of (a, b) is lost if, while both sides are built, a merge across it comes before the merge that
        makes the side's next part. Both sides are taken apart from the last merge to the first: at each step the pair
        at the border must have no merge of a rank below that of the part taken apart last.
        """
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            code = x * self.n + y
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[at] == code, self.code_rank[at], np.iinfo(np.int64).max)
            lost = rank < limit[open_]
            good[open_[lost]] = False
            rx, ry = self.rank[x], self.rank[y]
            end = (rx < 0) & (ry < 0)
            later_left = rx > ry  # equal parts: merges run from left to right, the left one is there first
            keep = ~lost & ~end
            o, left = open_[keep], later_left[keep]
            ol, orr = o[left], o[~left]
            limit[ol], limit[orr] = self.rank[a[ol]], self.rank[b[orr]] + 1
            a[ol], b[orr] = self.right[a[ol]], self.left[b[orr]]
            open_ = o
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the adjacent pair of the lowest rank, the leftmost of equals, until none is left."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pair[p][0], k, p) for k in range(n - 1) if (p := (ids[k], ids[k + 1])) in self.pair]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != p[0] or nxt >= n or ids[nxt] != p[1]:
                continue
            ids[k], ids[nxt] = self.pair[p][1], -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < n and (q := (ids[at], ids[after[at]])) in self.pair:
                    heapq.heappush(heap, (self.pair[q][0], at, q))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of tokens of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        total, ends = len(data), np.cumsum(sizes)
        starts = ends - sizes
        room = np.repeat(ends, sizes) - np.arange(total)
        best = self.byte_id[data]
        prefix = np.zeros(total, np.uint64)
        for size in range(1, min(self.longest, int(sizes.max(initial=0))) + 1):
            fits = np.flatnonzero(room >= size)
            prefix[fits] = prefix[fits] * _BASE + (data[fits + size - 1].astype(np.uint64) + _ONE)
            if size > 1 and size in self.by_len:
                hashes, ids = self.by_len[size]
                h = prefix[fits]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                best[fits[hit]] = ids[at[hit]]
        step = self.size[best]
        # walk all words at once
        where, word, token = [], [], []
        alive, pos = np.flatnonzero(sizes > 0), starts[sizes > 0]
        while len(alive):
            where.append(pos), word.append(alive), token.append(best[pos])
            pos = pos + step[pos]
            more = pos < ends[alive]
            alive, pos = alive[more], pos[more]
        pos, word, token = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (where, word, token))
        order = np.argsort(pos, kind="stable")
        pos, word, token = pos[order], word[order], token[order]
        bad = np.zeros(len(words), bool)
        same = word[1:] == word[:-1]
        ok = np.ones(len(same), bool)
        pairs, back = np.unique(token[:-1][same] * self.n + token[1:][same], return_inverse=True)
        ok[same] = self.compatible(pairs // self.n, pairs % self.n)[back] if len(pairs) else True
        bad[word[1:][~ok]] = True
        # a hash may lie: proposed tokens must have the bytes of the word
        span = self.size[token]
        at = np.repeat(pos - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
        src = np.repeat(self.offset[token] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
        wrong = data[at] != self.flat[src]
        if wrong.any():
            bad[np.repeat(word, span)[wrong]] = True
        counts = np.bincount(word, minlength=len(words))
        if bad.any():
            redo = {int(k): self.merge(words[k]) for k in np.flatnonzero(bad)}
            parts = np.split(token, np.cumsum(counts)[:-1])
            for k, ids in redo.items():
                parts[k], counts[k] = np.array(ids, np.int64), len(ids)
            token = np.concatenate(parts)
        return token, counts


_BASE, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """A vocabulary, read once per process."""
    return Vocabulary(path)


class Encoder:
    """Encodes texts, remembering words already met."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        self.vocab, self.memo_words = vocabulary(path), memo_words
        self.cut = regex.compile(PATTERN)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text; none for null and empty texts."""
        if len(self.index) > self.memo_words:
            self._clear()
        index = self.index
        known = len(index)
        split = [self.cut.findall(t) if t else [] for t in texts]
        codes = np.fromiter((index.setdefault(w, len(index)) for ws in split for w in ws), np.int64)
        new = list(index)[known:] if len(index) > known else []
        if new:
            token, count = self.vocab.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            self.tokens, self.counts = np.r_[self.tokens, token.astype(np.int32)], np.r_[self.counts, count]
        starts = np.cumsum(self.counts) - self.counts
        size = self.counts[codes] if len(codes) else np.empty(0, np.int64)
        shift = np.cumsum(size) - size
        at = np.repeat(starts[codes] - shift, size) + np.arange(size.sum()) if len(codes) else np.empty(0, np.int64)
        words = np.fromiter(map(len, split), np.int64, len(split))
        bounds = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(words)]]
        return self.tokens[at], np.diff(bounds)


def _blocks(texts: pa.ChunkedArray | pa.Array) -> Iterator[list[str | None]]:
    block, chars = [], 0
    for t in texts.to_pylist():
        block.append(t)
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _spread(docs: DataFrame) -> DataFrame:
    """Small inputs come in few splits: texts are spread over the cores before the costly step."""
    want = docs.sparkSession.sparkContext.defaultParallelism * 2
    return docs.repartition(want) if docs.rdd.getNumPartitions() < want else docs


def encode_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids): every text as the list of its ids, without special tokens; ``counts_only`` gives (id, tokens) instead.

    Null and empty texts give an empty list (0 tokens). Strings that look like control tokens are ordinary text.
    Repeated rows give repeated results; ``keep`` names further columns to carry. Nothing but one batch of texts and a
    bounded memo of words is held by a task.
    """
    path = path or default_vocabulary()
    carried = [id, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(len(carried))):
                ids, counts = encoder.encode(block)
                cols = [batch.column(k).slice(at, len(block)) for k in range(len(carried))]
                at += len(block)
                if counts_only:
                    out = pa.array(counts, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, out], names=[*carried, name])

    name = "tokens" if counts_only else "ids"
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return _spread(rows).mapInArrow(run, f"{kinds}, {name} {'bigint' if counts_only else 'array<int>'}")
