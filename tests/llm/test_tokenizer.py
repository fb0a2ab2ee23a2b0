"""Encoding against public implementations and by exact round trip."""

import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import refsieve.llm.tokenizer as tk

ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
PUBLIC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
ENC = tk.Encoder(tk.default_vocabulary())
TEXTS = ["", "Hello  world", "<|endoftext|> x", "résumé é 😅👩‍⚕️ 日本語", "a" * 5000, "   \n\t \r\n x ", "it's we'll don't", "�\x00\x01", "12345678901234567890 ===----===", "ab" * 3000 + " zzz"]


def encode(texts):
    ids, counts = ENC.encode(texts)
    return [list(map(int, x)) for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_texts():
    assert encode(TEXTS) == [PUBLIC.encode_ordinary(t) for t in TEXTS]
    assert encode([None, "", None]) == [[], [], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    out = encode(["x", *texts])
    assert out[1:] == [PUBLIC.encode_ordinary(t) for t in texts]
    assert [b"".join(ENC.vocab.bytes_of[i] for i in x).decode() for x in out[1:]] == texts


def test_speculation_is_verified():
    rng = np.random.default_rng(0)
    pieces = list(ENC.vocab.bytes_of.values())
    words = [b"".join(pieces[k] for k in rng.integers(0, len(pieces), rng.integers(1, 6))) for _ in range(3000)]
    ids, counts = ENC.vocab.encode_words(words)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [ENC.vocab.merge(w) for w in words]


def test_memo_may_be_dropped():
    e = tk.Encoder(tk.default_vocabulary(), memo_words=3)
    for t in TEXTS * 2:
        assert list(e.encode([t])[0]) == PUBLIC.encode_ordinary(t)


@pytest.mark.parametrize("counts", [False, True])
def test_frame(spark, counts):
    rows = [(k, t, "s", 1) for k, t in enumerate([*TEXTS, None])] + [(0, "", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, tokens int")
    out = tk.encode_documents(df, counts_only=counts)
    got = sorted((r[0], r[1] if counts else list(r[1])) for r in out.collect())
    want = [PUBLIC.encode_ordinary(t or "") for _, t, _, _ in rows]
    assert got == sorted((k, len(w) if counts else w) for (k, *_), w in zip(rows, want, strict=True))
    assert tk.encode_documents(df.limit(0), counts_only=counts).count() == 0
