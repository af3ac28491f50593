"""Token counts by a public tokenizer, read from a file given by its path."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that parts text before the merges of a rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Function that counts the tokens of texts, by the kind of file; loaded once per worker."""
    if path in _loaded:
        return _loaded[path]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        run = lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    elif path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        run = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    else:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        run = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    _loaded[path] = run
    return run


def count(texts: list[str | None], path: str = DEFAULT) -> list[int]:
    """Number of tokens of each text; NULL has none. The file's ending tells its kind."""
    return _counter(path)([x or "" for x in texts])


def token_count(text: Column | str, path: str = DEFAULT) -> Column:
    """Column of token counts."""

    def run(texts: pd.Series) -> pd.Series:
        out: list[int] = []
        values = texts.tolist()
        for i in range(0, len(values), 256):
            out += count(values[i : i + 256], path)
        return pd.Series(out, index=texts.index, dtype="int64")

    return F.pandas_udf(run, "bigint").asNondeterministic()(text)
