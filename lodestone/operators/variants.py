"""Pipelines of named stages, run once for each recipe and input, and their comparison.

A stage's output has an address: a hash of what it read, its name and its settings.  Variants that begin alike thus share
the stored tables of their common stages, within one comparison and with earlier ones under the same root."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.retrieve import totals
from lodestone.sources import published

LOG = "variant string, position int, stage string, address string, status string, n_rows long"


@dataclass(frozen=True)
class Stage:
    """run(table, **settings) gives the stage's table; settings are what JSON can hold, and all that the result depends on."""

    name: str
    run: Callable[..., DataFrame]
    settings: dict = field(default_factory=dict)


def address(before: str, stage: Stage) -> str:
    return hashlib.sha256(json.dumps([before, stage.name, stage.settings], sort_keys=True).encode()).hexdigest()[:16]


def run_variants(spark: SparkSession, root: str, source: DataFrame, version: str, variants: dict[str, list[Stage]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(each variant's last table, log) of pipelines over a source of this version.

    log has a row for each stage of each variant: run where it was computed, cached where its table stood already, with the
    number of its rows.  A table counts once it is whole, so a run that fails is taken up where it stopped."""
    out, log, rows = {}, [], {}
    for variant, stages in variants.items():
        at, df = hashlib.sha256(version.encode()).hexdigest()[:16], source
        for k, stage in enumerate(stages):
            at = address(at, stage)
            folder = f"{root}/{stage.name}-{at}"
            held = published.exists(spark, f"{folder}/_SUCCESS")
            if not held:
                stage.run(df, **stage.settings).write.mode("overwrite").parquet(folder)
            df = spark.read.parquet(folder)
            rows[folder] = rows[folder] if folder in rows else df.count()
            log.append((variant, k, stage.name, at, "cached" if held else "run", rows[folder]))
        out[variant] = df
    return out, spark.createDataFrame(log, LOG)


def compared(evaluations: dict[str, DataFrame]) -> DataFrame:
    """variant, the totals of its rows(found, rank), and best: the greatest hit rate and then mean reciprocal rank, ties
    all best, none where nothing was found."""
    every = None
    for variant, rows in evaluations.items():
        part = rows.agg(*totals()).select(F.lit(variant).alias("variant"), "*")
        every = part if every is None else every.unionByName(part)
    top = every.agg(F.max(F.struct("hit_rate", "mrr")).alias("top"))  # one row
    best = (F.col("top.hit_rate") == F.col("hit_rate")) & (F.col("top.mrr") == F.col("mrr")) & (F.col("hit_rate") > 0)
    return every.crossJoin(F.broadcast(top)).withColumn("best", F.coalesce(best, F.lit(False))).drop("top")


def question_changes(evaluations: dict[str, DataFrame]) -> DataFrame:
    """query, found_by, missed_by: the variants, in name order, that found the answer and those that did not, of the questions
    on which they differ."""
    every = None
    for variant, rows in evaluations.items():
        part = rows.select("query", F.lit(variant).alias("variant"), F.coalesce("found", F.lit(False)).alias("found"))
        every = part if every is None else every.unionByName(part)
    sides = every.groupBy("query").agg(F.array_sort(F.collect_list(F.when(F.col("found"), F.col("variant")))).alias("found_by"), F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("variant")))).alias("missed_by"))
    return sides.where((F.size("found_by") > 0) & (F.size("missed_by") > 0))
