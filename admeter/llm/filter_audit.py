"""How filters interact: what each removes, for every order in which they can be applied, by decision diagrams.

1. ``failures`` finds the filters that each whole text fails, in tasks; a text is a copy if a smaller id has the same
   text anywhere in the table, found by the smallest id of each 128-bit text hash.
2. ``counted`` counts documents by part and failure mask, with their labels: a few rows per part, however large the table.
3. ``audit`` builds one diagram per part, in a task of Spark's: an ordered decision diagram over the filters whose ends are
   the counts of masks, equal nodes shared.  A node's weight is the number of documents that reach it.  The orders
   are visited so that each differs from the one before in two neighbours (plain changes), and the diagram follows by one
   swap of adjacent levels.  The path on which every filter passes gives the steps: the weight of the failing branch is what
   a filter removes, the weight of the passing one what is kept.  A filter that stands last removes what only it
   would have caught.

Fixed meaning of edge cases: a null text is empty; a null part is the empty string; a document is good (toxic) if any of its
label rows says so, and labels without a document don't count; documents without an id are no copies and
have no labels; rows that share an id and a text are not copies of each other, and each row is counted; a table
without rows has no parts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Least words, least percentage of distinct words, greatest percentage of capitals, and symbols that fail a text.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
CAPITAL_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filters, in the order of the mask's bits.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def mask_of(text: str) -> int:
    """The filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # of bytes: at \x20 and \x09-\x0D only
    fails = (len(words) < WORDS, 100 * len(set(words)) < DISTINCT * len(words),
             100 * (len(raw) - len(raw.translate(None, CAPITAL_LETTERS))) > CAPITALS * len(text),
             len(raw) != len(raw.translate(None, SYMBOLS)))
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def failures(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask, n): rows of ``df`` by id, part and the filters that they fail.

    No join here is on a text alone: a third of all rows may be copies, but only one id of them is the smallest.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<mask: int, hash: binary>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = [t or "" for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([mask_of(t) for t in rows], pa.int32()), pa.array([hashlib.sha256(t.encode()).digest()[:16] for t in rows], pa.binary())],
            ["mask", "hash"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                     measured(F.col(text).cast("string")).alias("m"))
    rows = saved(rows.groupBy("id", "part", "m.mask", "m.hash").agg(F.count(F.lit(1)).alias("n")), "filter-masks")
    first = rows.where("id IS NOT NULL").groupBy(F.col("hash").alias("f_hash")).agg(F.min("id").alias("f_id"))
    both = rows.join(first, (F.col("id") == F.col("f_id")) & (F.col("hash") == F.col("f_hash")), "left")
    copy = F.when(F.col("id").isNotNull() & F.col("f_id").isNull(), COPY).otherwise(0)
    return both.select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"), "n")


def counted(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, docs, good, toxic) of rows (id, part, mask, n)."""
    said = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(f"l_{name}")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("l_id")).agg(said("quality"), said("toxic"))
    both = rows.join(known, F.col("id") == F.col("l_id"), "left")
    where = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("docs"), where("l_quality").alias("good"), where("l_toxic").alias("toxic"))


class Diagram:
    """An ordered decision diagram from failure masks to weights.

    A node is (level, passing node, failing node), an end is a weight; equal nodes are one object's number in ``unique``.
    """

    def __init__(self, weights: dict[int, tuple[int, ...]], size: int):
        self.size, self.zero = size, (0,) * len(next(iter(weights.values())))
        self.unique: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.weight: list[tuple[int, ...]] = []
        self.root = self.built(weights, 0, 0)

    def number(self, node: tuple, weight: tuple[int, ...]) -> int:
        found = self.unique.get(node)
        if found is None:
            found = self.unique[node] = len(self.nodes)
            self.nodes.append(node)
            self.weight.append(weight)
        return found

    def node(self, level: int, passing: int, failing: int) -> int:
        return self.number((level, passing, failing), tuple(map(sum, zip(self.weight[passing], self.weight[failing]))))

    def built(self, weights: dict[int, tuple[int, ...]], level: int, mask: int) -> int:
        if level == self.size:
            weight = weights.get(mask, self.zero)
            return self.number(("end", weight), weight)
        return self.node(level, self.built(weights, level + 1, mask), self.built(weights, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the filters at ``level`` and the next one; only nodes of these two levels and above are made anew."""
        done: dict[int, int] = {}

        def moved(at: int) -> int:
            if at not in done:
                here, passing, failing = self.nodes[at]
                if here < level:
                    done[at] = self.node(here, moved(passing), moved(failing))
                else:
                    (_, pp, pf), (_, fp, ff) = self.nodes[passing], self.nodes[failing]
                    done[at] = self.node(level, self.node(level + 1, pp, fp), self.node(level + 1, pf, ff))
            return done[at]

        self.root = moved(self.root)

    def steps(self) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Weights kept and removed at each level of the path on which every filter passes."""
        at = self.root
        for _ in range(self.size):
            _, at, failing = self.nodes[at]
            yield self.weight[at], self.weight[failing]


def plain_changes(size: int) -> Iterator[int]:
    """Places whose exchange with the next one visits all orders, each once."""
    if size < 2:
        return
    down, up = range(size - 2, -1, -1), range(size - 1)
    inner = plain_changes(size - 1)
    while True:
        yield from down
        step = next(inner, None)
        if step is None:
            return
        yield step + 1
        yield from up
        step = next(inner, None)
        if step is None:
            return
        yield step


def interactions(masks: pd.DataFrame, filters: str) -> pd.DataFrame:
    """All orders and steps of one part, from its rows (mask, docs, good, toxic)."""
    weights = {int(m): (int(d), int(g), int(t)) for m, d, g, t in zip(masks["mask"], masks["docs"], masks["good"], masks["toxic"])}
    failing = [sum(w[0] for m, w in weights.items() if m >> i & 1) for i in range(len(filters))]
    diagram, order = Diagram(weights, len(filters)), list(range(len(filters)))
    rows, alone, shares = [], [0] * len(filters), [0] * len(filters)

    def read() -> None:
        name = "".join(filters[i] for i in order)
        for step, (i, (kept, removed)) in enumerate(zip(order, diagram.steps()), 1):
            rows.append((name, step, i, kept[0], removed[0], failing[i] - removed[0], removed[1], removed[2]))
            shares[i] += removed[0]
            if step == len(order):
                alone[i] = removed[0]

    read()
    for at in plain_changes(len(filters)):
        diagram.swap(at)
        order[at], order[at + 1] = order[at + 1], order[at]
        read()
    out = pd.DataFrame(rows, columns=["filter_order", "step", "i", "kept", "removed", "redundant", "good_lost", "toxic_lost"])
    return out.assign(unique_fails=np.array(alone)[out["i"]], shapley=np.array(shares)[out["i"]], filter=[filters[i] for i in out["i"]])


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step, filter, ``COUNTS``) from rows (part, mask, docs, good, toxic), one for each mask of a part."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", filter string"
    names = [c.split()[0] for c in schema.split(", ")]

    def one_part(rows: pd.DataFrame) -> pd.DataFrame:
        return interactions(rows, filters).assign(part=rows["part"].iloc[0])[names]

    return masks.groupBy("part").applyInPandas(one_part, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    return audit(saved(counted(failures(docs), labels), "filter-counts"))
