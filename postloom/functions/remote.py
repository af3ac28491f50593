"""Plug-ins that call a model: contexts for chunks and vectors over HTTP."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import model_context

ASK = "In one short sentence, say what this passage of business mail is about and where it belongs: who wrote to whom, when, what kind of paper, which reference numbers. Answer with that sentence alone."
# Details given in a prompt, in this order, where known.
DETAILS = (("from", "From"), ("to", "To"), ("date", "Date"), ("subject", "Subject"), ("filename", "Filename"), ("parser", "Parser"), ("parserVersion", "Parser version"))
EXCERPT = 1500


def context_prompt(meta: Column, text: Column) -> Column:
    """Prompt for a chunk: the request, its known details one per line, the excerpt."""
    known = [F.when(F.coalesce(meta[k], F.lit("")) != "", F.concat(F.lit(f"{label}: "), meta[k])) for k, label in DETAILS]
    return F.concat_ws("\n", F.lit(ASK), *known, F.lit("Excerpt:"), F.substring(text, 1, EXCERPT))


class ModelContext:
    """Contexts from a caller's completion; cached by (chunk, tool, version), empty replies too."""

    tool = "model-context"

    def __init__(self, complete: Callable[[str], str], version: str = "1"):
        self.complete, self.version = complete, version

    def answer(self, prompts: DataFrame) -> DataFrame:
        """(chunk_id, fallback, prompt) -> (chunk_id, context)."""
        complete = self.complete

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"chunk_id": b["chunk_id"], "fallback": b["fallback"], "reply": [complete(p) for p in b["prompt"]]})

        told = prompts.select("chunk_id", "fallback", "prompt").mapInPandas(run, "chunk_id string, fallback string, reply string")
        return told.select("chunk_id", model_context(F.col("reply"), F.col("fallback")).alias("context"))


class HttpEmbedder:
    """Vectors from an endpoint that takes ``{model, input}`` and returns ``{data: [{index, embedding}]}``.

    Batches follow each other; 429, 5xx and network failures are tried again up to ``retries``
    times after 250 ms doubled each time, or after Retry-After, 30 s at most; other failures end
    the job at once. A wrong number of rows or dimension is an error. Use as an engine's ``embed``.
    """

    def __init__(self, url: str, model: str, dim: int, key: str | None = None, batch: int = 64, retries: int = 5, sleep: Callable[[float], None] = time.sleep):
        self.url, self.model, self.dim, self.key = url.rstrip("/") + "/embeddings", model, dim, key
        self.batch, self.retries, self.sleep = max(1, min(batch, 2048)), max(0, retries), sleep

    def __call__(self, text: Column | str) -> Column:
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(self.embed(texts.fillna("").tolist()), index=texts.index)

        return F.pandas_udf(run, "array<double>").asNondeterministic()(text)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for i in range(0, len(texts), self.batch) for v in self._some(texts[i : i + self.batch])]

    def wait(self, attempt: int, after: str | None) -> float:
        """Seconds before the next attempt."""
        try:
            asked = float(after) if after is not None else -1.0
        except ValueError:
            asked = -1.0
        return min(30.0, asked if asked >= 0 else 0.25 * 2**attempt)

    def _some(self, texts: list[str]) -> list[list[float]]:
        head = {"content-type": "application/json"} | ({"authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps({"model": self.model, "input": texts, "encoding_format": "float"}).encode()
        for attempt in range(self.retries + 1):
            after = None
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, head)) as reply:
                    rows = json.load(reply).get("data")
                break
            except urllib.error.HTTPError as x:
                if (x.code != 429 and x.code < 500) or attempt == self.retries:
                    raise RuntimeError(f"embedding failed with status {x.code} after {attempt + 1} attempts: {x.read()[:200]!r}") from x
                after = x.headers.get("Retry-After")
            except urllib.error.URLError as x:
                if attempt == self.retries:
                    raise RuntimeError(f"embedding failed after {attempt + 1} attempts: {x.reason}") from x
            self.sleep(self.wait(attempt, after))
        if not isinstance(rows, list) or len(rows) != len(texts):
            raise RuntimeError(f"embedding returned {len(rows) if isinstance(rows, list) else 'no'} rows for {len(texts)} texts")
        out = [r.get("embedding") for r in sorted(rows, key=lambda r: r.get("index", 0))]
        if any(not isinstance(v, list) or len(v) != self.dim for v in out):
            raise RuntimeError(f"embedding has another dimension than {self.dim}")
        return [[float(x) for x in v] for v in out]
