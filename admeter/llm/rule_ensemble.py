"""A quality classifier made of a sparse ensemble of rules over statistics of a text.

1. ``statistics`` measures each whole text once: sizes, shares of kinds of characters, repeats.  Nothing else is an input of a
   score, neither labels nor language, source or id.
2. ``fit`` grows a forest of shallow trees (Spark ML) on labelled rows, and takes every path from a root to a node as a
   rule: a conjunction of comparisons.  A lasso logistic regression (Spark ML, L1 only) on the rules' truth values
   leaves a weight to few of them.
3. ``RuleEnsemble.score`` is one Spark column: the logistic function of the intercept and the weights of the rules that hold.
   Scoring runs in the JVM beside the statistics, without a model on the executors.

The trees and weights are fitted on at most about ``TRAINING_ROWS`` labelled rows, chosen by a hash of the id, of all of them
that the caller gives; all rows are measured and scored.

Fixed meaning of edge cases: null and empty texts have statistics of 0 and get the score of those; rows without an id are
scored and never learnt from; a document whose label rows disagree, or say neither 0 nor 1, is not learnt from; with rows of
one class only, or none, the score of every text is the share of 1 (0.5 without rows); repeated rows are each scored, and
learnt from, as they are; an empty table gives an empty result; input columns named as the output are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import log
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, Words, mixed, saved, small_batches, without

#: Labelled rows that the model is fitted on, about; trees, their depth and least rows of a node; strength of the lasso and its steps.
TRAINING_ROWS, TREES, DEPTH, LEAST_ROWS, PENALTY, STEPS = 200_000, 24, 3, 5, 0.0005, 100
#: Words of a window that counts as repeated when its text holds it again.
WINDOW = 5
STATISTICS = (
    "n_words", "n_chars", "word_length", "longest_word", "capitals", "digits", "marks", "bars", "exclamations", "commas", "ends", "not_ascii",
    "distinct_words", "commonest_word", "same_as_before", "repeated_windows", "repeated_lines", "line_words")
CAPITAL_LETTERS, SMALL_LETTERS, DIGITS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*<>@\\^_~"
NOT_ASCII = bytes(range(128, 256))

_hashes = WordHashes()


def measured(texts: list[str | None]) -> pa.Array:
    """A struct of ``STATISTICS`` per text; shares are of words unless named otherwise."""
    raw = [t.encode() if t else b"" for t in texts]
    words = Words(raw, _hashes)
    n = words.count
    per_word = lambda x: np.asarray(x, np.float64) / np.maximum(n, 1)
    size = np.array([len(r) for r in raw], np.float64)
    chars = np.array([len(t) if t else 0 for t in texts], np.float64)
    of = lambda kind: np.array([len(r) - len(r.translate(None, kind)) for r in raw], np.float64)
    capitals, small = of(CAPITAL_LETTERS), of(SMALL_LETTERS)
    split = [r.split() for r in raw]
    lines = [[line for line in r.split(b"\n") if line.strip()] for r in raw]
    n_lines = np.array([len(x) for x in lines])
    own = mixed(words.text.astype(np.uint64) + np.uint64(1))
    _, at, times = np.unique(words.hash + own, return_index=True, return_counts=True)
    distinct, commonest = np.zeros(len(n)), np.zeros(len(n))
    np.add.at(distinct, words.text[at], 1)
    np.maximum.at(commonest, words.text[at], times)
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.place[1:] > 0)) + 1
    windows = words.windows(WINDOW)
    starts = np.flatnonzero(words.left[:len(windows)] >= WINDOW)
    _, group, times = np.unique(windows[starts] + own[starts], return_inverse=True, return_counts=True)
    again = np.bincount(words.text[starts[times[group] > 1]], minlength=len(n))
    letters = [sum(map(len, w)) for w in split]
    columns = (
        n, chars, per_word(letters), [max(map(len, w), default=0) for w in split], capitals / np.maximum(capitals + small, 1),
        of(DIGITS) / np.maximum(size, 1), per_word(of(MARKS)), per_word([r.count(b"|") for r in raw]), per_word([r.count(b"!") for r in raw]),
        per_word([r.count(b",") for r in raw]), per_word([r.count(b".") + r.count(b"?") for r in raw]), of(NOT_ASCII) / np.maximum(size, 1),
        per_word(distinct), per_word(commonest), per_word(np.bincount(words.text[same], minlength=len(n))), per_word(again),
        np.array([len(x) - len(set(x)) for x in lines]) / np.maximum(n_lines, 1), n / np.maximum(n_lines, 1))
    return pa.StructArray.from_arrays([pa.array(np.asarray(c, np.float64)) for c in columns], list(STATISTICS))


def statistics(df: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``df`` with a struct of ``STATISTICS``."""
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<" + ", ".join(f"{s}: double" for s in STATISTICS) + ">")
    def measure(texts: pa.Array) -> pa.Array:
        return measured(texts.to_pylist())

    return without(df, out).withColumn(out, measure(df[text].cast("string")))


@dataclass(frozen=True, order=True)
class Rule:
    """A conjunction: ``above`` and ``upto`` hold (number of a statistic, threshold)."""

    above: tuple[tuple[int, float], ...] = ()
    upto: tuple[tuple[int, float], ...] = ()

    def narrowed(self, statistic: int, threshold: float, above: bool) -> Rule:
        """This rule and one more comparison; of two of a kind the stricter one stays."""
        low, high = dict(self.above), dict(self.upto)
        side, stricter = (low, max) if above else (high, min)
        side[statistic] = stricter(side.get(statistic, threshold), threshold)
        return Rule(tuple(sorted(low.items())), tuple(sorted(high.items())))

    def column(self, out: str = "statistics") -> Column:
        value = lambda i: F.col(f"{out}.{STATISTICS[i]}")
        return reduce(and_, [value(i) > t for i, t in self.above] + [value(i) <= t for i, t in self.upto])

    def __str__(self) -> str:
        return " and ".join([f"{STATISTICS[i]} > {t:g}" for i, t in self.above] + [f"{STATISTICS[i]} <= {t:g}" for i, t in self.upto])


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, out: str = "statistics") -> Column:
        """Probability of label 1, from the struct ``out``."""
        weights = [F.when(rule.column(out), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        total = reduce(lambda a, b: a + b, weights, F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        strongest = sorted(self.rules, key=lambda r: -abs(r[1]))
        return "\n".join([f"{self.intercept:+.3f}"] + [f"{w:+.3f} if {r}" for r, w in strongest])


COMPARISON = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def paths(tree: str) -> set[Rule]:
    """The rules of a tree in Spark's indented text form, one for each node below the root."""
    found, open_rules = set(), []
    for line in tree.splitlines():
        m = COMPARISON.match(line)
        if not m:
            continue
        depth, statistic, threshold, above = len(m[1]), int(m[3]), float(m[5]), m[4] == ">"
        while open_rules and open_rules[-1][0] >= depth:
            open_rules.pop()
        rule = (open_rules[-1][1] if open_rules else Rule()).narrowed(statistic, threshold, above)
        open_rules.append((depth, rule))
        if not (rule.above and not rule.upto and len(rule.above) == 1):  # its opposite is a rule too
            found.add(rule)
    return found


def fit(labelled: DataFrame, label: str = "label", out: str = "statistics", seed: int = 7) -> RuleEnsemble:
    """The ensemble of rows with the struct ``out`` and a ``label`` of 0 or 1."""
    count = {r[label]: r["n"] for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(count.get(0, 0), count.get(1, 0)) == 0:
        share = count.get(1, 0) / sum(count.values()) if count else 0.5
        edge = min(max(share, 1e-9), 1 - 1e-9)
        return RuleEnsemble((), log(edge / (1 - edge)))
    label_column = F.col(label).cast("double").alias("label")
    rows = saved(labelled.select(label_column, out), "rule-rows")
    vectors = rows.select("label", array_to_vector(F.array(*[F.col(f"{out}.{s}") for s in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted(set().union(*[paths(tree.toDebugString) for tree in forest.trees]))
    if not rules:
        share = count[1] / (count[0] + count[1])
        return RuleEnsemble((), log(share / (1 - share)))
    truth = rows.select("label", array_to_vector(F.array(*[r.column(out).cast("double") for r in rules])).alias("features"))
    truth = saved(truth, "rule-truth")
    model = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=STEPS).fit(truth)
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w != 0]
    return RuleEnsemble(tuple(kept), float(model.intercept))


def held_out(key: Column) -> Column:
    """Whether the crc32 of an id, as text, is a multiple of 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def labelled(measures: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", out: str = "statistics") -> DataFrame:
    """(label, ``out``) of the rows of ``measures`` that have one undisputed label, at most about ``TRAINING_ROWS`` by a hash of the id."""
    q = F.col(quality)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("l_key")).agg(F.min(q).alias("label"), F.max(q).alias("other"))
    known = known.where((F.col("label") == F.col("other")) & F.col("label").isin(0, 1)).drop("other")
    rows = saved(measures.join(known, F.col(key) == F.col("l_key")).select("label", F.col(key).alias("key"), out), "rule-labelled")
    share = TRAINING_ROWS / max(rows.count(), 1)
    chosen = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return chosen.select("label", out)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) of all ``docs``, learnt from the labels of rows that are not held out."""
    measures = saved(statistics(docs.select(F.col(key), F.col(text)), text).select(key, "statistics"), "rule-statistics")
    model = fit(labelled(measures.where(~held_out(F.col(key))), labels, key))
    scored = measures.select(F.col(key), held_out(F.col(key)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
