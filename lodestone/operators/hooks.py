"""User functions in batches: one hook for model calls and embedders, and a data source of user code."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.operators.rerank import rescored

REPLY = "struct<text:string,input_tokens:int,output_tokens:int,error:string>"
EMBEDDERS: dict[str, tuple[Callable[[list[str]], list[list[float]]], int]] = {}
STEPS: dict[str, Callable[..., DataFrame]] = {}


def ai_map(df: DataFrame, prompt: str, ask: Callable[[list[str]], list[dict]], batch: int = 32) -> DataFrame:
    """df with reply, a struct(text, input_tokens, output_tokens, error): ask gets up to ``batch`` prompts at a time and
    returns a dict for each.  Null prompts are not asked; if a call raises, its rows hold the exception's name."""

    @F.pandas_udf(REPLY)
    def replies(prompts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([(None, None, None, None)] * len(prompts), columns=["text", "input_tokens", "output_tokens", "error"], dtype=object)
        at = [i for i, p in enumerate(prompts) if p is not None]
        for k in range(0, len(at), batch):
            own = at[k : k + batch]
            try:
                got = ask([prompts.iloc[i] for i in own])
            except Exception as e:  # one call's failure is its rows' error, not the job's
                got = [{"error": type(e).__name__}] * len(own)
            for i, g in zip(own, got, strict=True):
                out.iloc[i] = [g.get(c) for c in out.columns]
        return out.astype({"input_tokens": "Int32", "output_tokens": "Int32"})

    return df.withColumn("reply", replies(F.col(prompt)))


def register_embedder(name: str, embed: Callable[[list[str]], list[list[float]]], dims: int) -> None:
    EMBEDDERS[name] = (embed, dims)


def embedded(df: DataFrame, text: str, embedder: str, batch: int = 64) -> DataFrame:
    """df with vector array<double> of the registered embedder, in batches; null texts have none, and a vector of
    another length than declared fails the job."""
    embed, dims = EMBEDDERS[embedder]

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(at), batch):
                for i, v in zip(at[k : k + batch], embed([texts.iloc[i] for i in at[k : k + batch]]), strict=True):
                    if len(v) != dims:
                        raise ValueError(f"{embedder} gave {len(v)} numbers, not {dims}")
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return df.withColumn("vector", vectors(F.col(text)))


def cross_scored(hits: DataFrame, score: Callable[[list[tuple[str, str]]], list[float]], k: int = 5, batch: int = 32) -> DataFrame:
    """hits(query, rank, score, question, text) ordered anew by a model of pairs, the k best of each query: it gets up to ``batch``
    (question, text) at a time and gives a number for each.  Pairs with a null are not asked and come last, as do those that
    get no finite number; ties keep their prior order, and prior_rank and prior_score stay."""

    @F.pandas_udf("double")
    def scores(questions: pd.Series, texts: pd.Series) -> pd.Series:
        out: list[float | None] = [None] * len(texts)
        at = [i for i, (q, t) in enumerate(zip(questions, texts, strict=True)) if q is not None and t is not None]
        for n in range(0, len(at), batch):
            own = at[n : n + batch]
            for i, v in zip(own, score([(questions.iloc[i], texts.iloc[i]) for i in own]), strict=True):
                out[i] = float(v) if v is not None and math.isfinite(v) else None
        return pd.Series(out, dtype="Float64")

    return rescored(hits, scores(F.col("question"), F.col("text")), k)


def strategy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers a step, a function of a DataFrame and keyword settings, for ``run_steps``."""
    STEPS[f.__name__] = f
    return f


def run_steps(df: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """df through the named steps with their settings, in order; an unknown name is refused before any runs."""
    if missing := [n for n, _ in steps if n not in STEPS]:
        raise ValueError(f"no step is named {', '.join(missing)}")
    for name, options in steps:
        df = df.transform(STEPS[name], **options)
    return df


class Listed(InputPartition):
    def __init__(self, index: int, parts: int):
        self.index, self.parts = index, parts


class UserSource(DataSource):
    """A document source of user code: a subclass sets ``documents``, a function (index, parts) that yields the
    (doc_id, text) of one part; registered with spark.dataSource.register and read by its class name."""

    documents: Callable[[int, int], Iterator[tuple[str, str]]]

    @classmethod
    def name(cls) -> str:
        return cls.__name__

    def schema(self) -> str:
        return "doc_id string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(type(self).documents, int(self.options.get("parts", "4")))


class _Reader(DataSourceReader):
    def __init__(self, documents: Callable, parts: int):
        self.documents, self.parts = documents, parts

    def partitions(self) -> list[InputPartition]:
        return [Listed(k, self.parts) for k in range(self.parts)]

    def read(self, partition: Listed) -> Iterator[tuple[str, str]]:
        yield from self.documents(partition.index, partition.parts)
