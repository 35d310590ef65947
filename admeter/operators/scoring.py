"""Totals, averages and verdict rules for scored replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import half_even
from .responses import ANALYSIS_CRITERIA, RECOMMENDATION_CRITERIA

# The overall recommendation score leaves instruction adherence out.
AVERAGED_CRITERIA = tuple(c for c in RECOMMENDATION_CRITERIA if c != "instruction_adherence")


def _points(scores: str, names) -> list[Column]:
    return [F.coalesce(F.col(f"{scores}.{n}").cast("bigint"), F.lit(0)) for n in names]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def score_analyses(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Fill ``scores`` with the five points (missing is 0), ``total`` and ``overall``.

    The total is always summed here; a total in the reply is not used.
    """
    points = _points(scores, ANALYSIS_CRITERIA)
    total = _sum(points)
    named = [p.alias(n) for p, n in zip(points, ANALYSIS_CRITERIA)]
    return df.withColumn(scores, F.struct(
        *named, total.alias("total"), half_even(total / F.lit(float(len(points)))).alias("overall")))


def score_recommendations(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Fill ``scores`` with eight points (missing is 0) and their unrounded mean ``Overall``."""
    points = _points(scores, AVERAGED_CRITERIA)
    named = [p.alias(n) for p, n in zip(points, AVERAGED_CRITERIA)]
    return df.withColumn(scores, F.struct(
        *named, (_sum(points) / F.lit(float(len(points)))).alias("Overall")))


def _lowest(columns: list[Column]) -> Column:
    return F.least(*columns)


def analysis_verdict(df: DataFrame, scores: str = "scores", verdict: str = "verdict") -> DataFrame:
    """Add ``verdict_rule`` and ``verdict_matches``: any point ≤ 2 rejects, all ≥ 4 accept, else revise."""
    low = _lowest(_points(scores, ANALYSIS_CRITERIA))
    rule = F.when(low <= 2, "reject").when(low >= 4, "accept").otherwise("revise")
    return df.withColumns({"verdict_rule": rule, "verdict_matches": F.col(verdict).eqNullSafe(rule)})


def recommendation_verdict(df: DataFrame, scores: str = "scores", verdict: str = "verdict") -> DataFrame:
    """Add ``verdict_rule`` and ``verdict_matches``: all 3 accept, any 1 (or none) rejects, else revise."""
    low = _lowest(_points(scores, RECOMMENDATION_CRITERIA))
    rule = F.when(low >= 3, "accept").when(low <= 1, "reject").otherwise("revise")
    return df.withColumns({"verdict_rule": rule, "verdict_matches": F.col(verdict).eqNullSafe(rule)})
