"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is a ``.tiktoken`` rank file; its path on the driver is a parameter. Where none is given, the
installed ``public_tokenizers`` package or the folder in ``$PUBLIC_TOKENIZERS`` provides it. Its content, of a
size that the file fixes, is sent to the executors, which need no file of their own.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the public 50k byte-pair vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def _encoding(ranks: bytes):  # noqa: ANN202
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    with open(path, "rb") as f:
        return _encoding(f.read())


#: Encoders of this worker by the digest of their vocabulary.
_BUILT: dict[str, object] = {}


def _built(digest: str, ranks: bytes):  # noqa: ANN202
    """This worker's encoder of a vocabulary, made once; found by import, so that tasks share it."""
    if digest not in _BUILT:
        _BUILT[digest] = _encoding(ranks)
    return _BUILT[digest]


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text; 0 for an empty one."""
    return len(encoder(path).encode_ordinary(text))


def with_token_counts(docs: DataFrame, text: str, keep: list[str], path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``keep`` columns and the number of tokens of each text; a null text has 0. Only numbers leave the pass."""
    with open(path or vocabulary_path(), "rb") as f:
        ranks = f.read()
    digest = hashlib.sha256(ranks).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _built(digest, sent.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if (t := x.as_py()) else 0 for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], [*keep, out])

    return docs.select(*keep, F.col(text)).mapInArrow(run, f"{kinds}, `{out}` bigint")
