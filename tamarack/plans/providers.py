"""Models behind an interface: what calls them is a column, and an offline stand-in gives the same answer every time."""

from __future__ import annotations

import json
import re
import time
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def generate(self, prompts: list[str], task: str) -> list[str | None]:
        """Replies to prompts of a task: rewrite, tool, decompose, hyde, answer, judge or again."""
        ...

    def grade(self, docs: DataFrame) -> Column:
        """Grade from 0 to 1 of each found chunk (columns of the docs, text_distance among them)."""
        ...


class Offline:
    """Embeddings of hashed words, replies out of the prompt's text, grades by shared words: the same every time.

    A question is rewritten to itself, cut into its sentences that ask, and answered by the first line of what was found.
    """

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h >> 16 & 1 else -1
        return out.tolist()

    def generate(self, prompts: list[str], task: str = "answer") -> list[str | None]:
        if task == "decompose":
            cut = ([p for p in re.split(r"(?<=[?])\s+", t) if p.strip()] for t in prompts)
            return [json.dumps({"sub_questions": c}, ensure_ascii=False) for c in cut]
        if task in ("answer", "again"):  # the first line that isn't the mark of a source
            return [next((x for x in (t or "").split("\n") if x.strip() and not x.startswith("[")), "") for t in prompts]
        if task == "rewrite":
            return [(t or "").strip() for t in prompts]
        return [None] * len(prompts)

    def grade(self, docs: DataFrame) -> Column:
        """Any word in common is enough to be relevant; more of them rank higher."""
        shared = F.lit(1.0) - F.coalesce(F.col("text_distance"), F.lit(1.0))
        return F.when(shared > 0, F.lit(0.5) + shared / 2).otherwise(0.0)


class Patient:
    """A provider that waits and asks again where the service is overloaded or can't be reached; other errors pass at once."""

    #: Parts of such errors' texts.
    PASSING = ("503", "unavailable", "429", "exhausted", "clientconnector", "dns", "timed out", "connectionerror")

    def __init__(self, inner: Provider, attempts: int = 3, first_wait: float = 1.0):
        self.inner, self.attempts, self.first_wait = inner, attempts, first_wait

    def _ask(self, call, *args):
        for n in range(self.attempts):
            try:
                return call(*args)
            except Exception as e:
                if n + 1 == self.attempts or not any(x in str(e).lower() for x in self.PASSING):
                    raise
                time.sleep(self.first_wait * 2**n)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._ask(self.inner.embed, texts)

    def generate(self, prompts: list[str], task: str = "answer") -> list[str | None]:
        return self._ask(self.inner.generate, prompts, task)

    def grade(self, docs: DataFrame) -> Column:
        return self.inner.grade(docs)


def generated(rows: DataFrame, provider: Provider, prompt: Column, out: str, task: str) -> DataFrame:
    """Adds the provider's replies; rows with a null prompt aren't sent and have a null reply."""
    carried = [c for c in rows.columns if c != out]
    source = rows.select(*carried, prompt.alias("__prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(len(carried)).to_pylist()
            asked = [i for i, p in enumerate(prompts) if p is not None]
            replies: list[str | None] = [None] * len(prompts)
            for i, r in zip(asked, provider.generate([prompts[i] for i in asked], task)):
                replies[i] = r
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array(replies, pa.string())], names=[*carried, out])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(out, T.StringType())]))


def embedded(rows: DataFrame, provider: Provider, text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds embeddings; equal texts are sent once, blank ones have an empty vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"__text": f["__text"], out: provider.embed(f["__text"].tolist())})

    own = rows.select(F.col(text).alias("__text")).where(F.length(F.trim(text)) > 0).distinct()
    vectors = own.mapInPandas(run, f"__text string, `{out}` array<float>")
    return rows.join(vectors, F.col(text) == F.col("__text"), "left").drop("__text").withColumn(out, F.coalesce(out, F.array().cast("array<float>")))


def index_of(rows: DataFrame, provider: Provider, key: str = "id", text: str = "content", out: str = "embedding") -> DataFrame:
    """(key, embedding) of each row with a text that isn't blank, text by text: for tables too large to gather equal texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], out: provider.embed(f["__text"].tolist())})

    own = rows.select(key, F.col(text).alias("__text")).where(F.length(F.trim("__text")) > 0)
    return own.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, `{out}` array<float>")
