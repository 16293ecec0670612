"""Token counts against the tokenizer's own pattern."""

from __future__ import annotations

import base64

import pytest

from weftline.llm.tokens import count_tokens, vocabulary_path, with_token_counts

P = pytest.importorskip("public_tokenizers")


def test_counts(spark):
    import tiktoken

    path = vocabulary_path()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Hello, it's fine", "  two   blanks \n\n", "größe 12345 ñandú", "x" * 20_000, "<|endoftext|> is text", "a\t\tb\r\n", "don't  \n  we'll "]
    for t in texts:
        assert count_tokens(t, path) == len(enc.encode_ordinary(t))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, text string")
    got = {r.id: r.n_tokens for r in with_token_counts(df, "text", ["id"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)} | {99: 0}
