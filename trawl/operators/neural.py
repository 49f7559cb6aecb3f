"""Scoring by models that the caller brings, in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import clipped, stripped_entities_first

#: Characters of a document and of a query that a model sees.
DOCUMENT_CHARS, QUERY_CHARS = 2000, 1200
Scorer = Callable[[list[tuple[str, str]]], list[float]]
Encoder = Callable[[list[str]], list[list[float]]]


def token_overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """A scorer without a model: the Jaccard similarity of the lower-case words."""

    def one(query: str, doc: str) -> float:
        a, b = set(query.lower().split()), set(doc.lower().split())
        return len(a & b) / len(a | b) if a | b else 0.0

    return [one(q, d) for q, d in pairs]


def score_pairs(run: DataFrame, queries: DataFrame, corpus: DataFrame, scorer: Scorer = token_overlap, batch: int = 64) -> DataFrame:
    """domain, query_id, doc_id, score for the run's pairs whose texts are there."""
    texts = corpus.select("domain", "doc_id", clipped(F.col("text"), DOCUMENT_CHARS).alias("d"))
    asked = queries.select("domain", "query_id", clipped(stripped_entities_first(F.col("text")), QUERY_CHARS).alias("q"))
    pairs = run.select("domain", "query_id", "doc_id").join(asked, ["domain", "query_id"]).join(texts, ["domain", "doc_id"])
    schema = pairs.drop("d", "q").select("domain", "query_id", "doc_id", F.lit(0.0).alias("score")).schema

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = list(zip(b["q"], b["d"], strict=True))
            values = [s for at in range(0, len(both), batch) for s in scorer(both[at : at + batch])]
            yield b[["domain", "query_id", "doc_id"]].assign(score=pd.Series(values, index=b.index, dtype="float64"))

    return pairs.mapInPandas(apply, schema)


def encode(rows: DataFrame, encoder: Encoder, key: str, batch: int = 64) -> DataFrame:
    """domain, ``key`` and the vector v of each text."""
    texts = rows.select("domain", key, F.coalesce("text", F.lit("")).alias("text"))
    schema = texts.select("domain", key, F.array(F.lit(0.0).cast("float")).alias("v")).schema

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            all_texts = b["text"].tolist()
            yield b[["domain", key]].assign(v=[v for at in range(0, len(all_texts), batch) for v in encoder(all_texts[at : at + batch])])

    return texts.mapInPandas(apply, schema)
