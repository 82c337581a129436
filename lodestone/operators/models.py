"""Models as pluggable functions, with offline stand-ins."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.chunks import enrich

Complete = Callable[[list[str]], list[str]]
Embed = Callable[[list[str]], np.ndarray]


def embed_texts(rows: DataFrame, embed: Embed, text: str = "stable_text", batch: int = 64) -> DataFrame:
    """``rows`` with ``embedding`` from a model that is called on ``batch`` texts at a time in the workers."""
    if batch < 1:
        raise ValueError("batch must be at least 1")

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = [np.asarray(embed(texts.iloc[i : i + batch].tolist()), np.float32) for i in range(0, len(texts), batch)]
            yield pd.Series([list(v) for part in found for v in part])

    return rows.withColumn("embedding", run(F.coalesce(F.col(text), F.lit(""))))


class Embedded(NamedTuple):
    """A provider's reply: vectors with the place of their text in the call, in any order, and the tokens that it counted."""

    vectors: list[tuple[int, list[float]]]
    tokens: int


def embed_with_usage(rows: DataFrame, provider: Callable[[list[str]], Embedded], text: str = "stable_text", batch: int = 64) -> DataFrame:
    """``rows`` with ``embedding`` and ``embedding_tokens`` from a provider that is called on ``batch`` texts at a time in the workers.

    Vectors are put back to their texts by their place. A call's tokens stand at its first row, so sums over rows are those of
    the calls. A reply without a vector for each text is an error, and so is a table without rows.
    """
    if batch < 1:
        raise ValueError("batch must be at least 1")
    if rows.isEmpty():
        raise ValueError("texts must not be empty")

    @F.pandas_udf("embedding array<float>, tokens long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            vectors, tokens = [], []
            for i in range(0, len(texts), batch):
                some = texts.iloc[i : i + batch].tolist()
                reply = provider(some)
                placed = dict(reply.vectors)
                if sorted(placed) != list(range(len(some))):
                    raise ValueError(f"{len(some)} texts, but vectors for places {sorted(placed)}")
                vectors += [placed[k] for k in range(len(some))]
                tokens += [reply.tokens] + [0] * (len(some) - 1)
            yield pd.DataFrame({"embedding": vectors, "tokens": tokens})

    made = rows.withColumn("__made", run(F.coalesce(F.col(text), F.lit(""))))
    return made.withColumns({"embedding": F.col("__made.embedding"), "embedding_tokens": F.col("__made.tokens")}).drop("__made")


def hash_vectors(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors of hashed word counts: the offline stand-in for an embedding model."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in zip(out, texts, strict=True):
        places = [zlib.crc32(w.encode()) % dimension for w in re.findall(r"\w+", text.lower())]
        row += np.bincount(places, minlength=dimension)[:dimension] if places else 0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def complete(rows: DataFrame, model: Complete, prompt: str = "user", out: str = "answer", batch: int = 8) -> DataFrame:
    """``rows`` with the model's answer to each prompt, ``batch`` prompts a call in the workers; null where a call fails or a prompt is null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            found: list[str | None] = []
            for i in range(0, len(prompts), batch):
                some = prompts.iloc[i : i + batch]
                asked = some[some.notna()].tolist()
                try:
                    answers = iter(model(asked)) if asked else iter(())
                    found += [next(answers, None) if here else None for here in some.notna()]
                except Exception:  # noqa: BLE001  one failing call must not stop the others
                    found += [None] * len(some)
            yield pd.Series(found, dtype=object)

    return rows.withColumn(out, run(F.col(prompt)))


def complete_structured(rows: DataFrame, model: Complete, schema: str, prompt: str = "user", out: str = "answer", batch: int = 8) -> DataFrame:
    """``rows`` with the model's JSON answer as a struct of the DDL ``schema``, null where it is no such JSON, and the prompt's estimated tokens.

    Text around the outermost braces is left out, as models like to add some.
    """
    made = complete(rows.withColumn(f"{out}_tokens", T.token_estimate(F.col(prompt))), model, prompt, "__json", batch)
    body = F.regexp_extract("__json", "(?s)\\{.*\\}", 0)
    fields = F.from_json(body, f"struct<{schema}>" if not schema.startswith("struct<") else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__none"})
    whole = F.col("__json").isNotNull() & F.try_parse_json(body).isNotNull() & (body != "")
    return made.withColumn(out, F.when(whole, fields)).drop("__json")


def enrich_by_model(chunks: DataFrame, model: Complete, text: str = "stable_text", batch: int = 8, width: int = 400) -> DataFrame:
    """``chunks`` with ``title, summary, tags`` from a model that answers a prompt of ``batch`` numbered texts with a JSON array.

    The prompt shows the first ``width`` characters of each text. An item missing in the answer
    gives empty values; where a call or its JSON fails, the values are those of the rules.
    """

    @F.pandas_udf("title string, summary string, tags array<string>, made boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for i in range(0, len(texts), batch):
                some = texts.iloc[i : i + batch].fillna("").tolist()
                try:
                    items = json.loads(model(["\n".join(f"[{n}] {t[:width]}" for n, t in enumerate(some))])[0])
                    items = [item if isinstance(item, dict) else {} for item in items][: len(some)]
                    items += [{}] * (len(some) - len(items))
                    rows += [(str(x.get("title") or ""), str(x.get("summary") or ""), [str(t) for t in x.get("tags") or []], True) for x in items]
                except Exception:  # noqa: BLE001  the rules stand in
                    rows += [(None, None, None, False)] * len(some)
            yield pd.DataFrame(rows, columns=["title", "summary", "tags", "made"])

    ruled = enrich(chunks, text).withColumn("__model", run(F.col(text)))
    chosen = {c: F.when(F.col("__model.made"), F.col(f"__model.{c}")).otherwise(F.col(c)) for c in ("title", "summary", "tags")}
    return ruled.withColumns(chosen).drop("__model")


def answer_quality(rows: DataFrame) -> DataFrame:
    """Lexical stand-ins for judged answer quality on ``query, answer, expected, context``: shares of terms found."""

    def share(a: Column, b: Column) -> Column:
        x, y = F.array_distinct(T.terms(a)), F.array_distinct(T.terms(b))
        return F.round(F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0)), 6)

    return rows.withColumns(
        {
            "faithfulness": share(F.col("answer"), F.col("context")),
            "answer_relevancy": share(F.col("query"), F.col("answer")),
            "context_recall": share(F.col("expected"), F.col("context")),
        }
    )
