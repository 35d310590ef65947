"""Mixing of sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in a fixed pseudo-random order, are cut into blocks of ``BLOCK_CHARS`` characters; a
longer document takes as many blocks as it fills.  The weights become whole numbers of slots in a round of
``ROUND`` slots (largest remainders, one at least).  Within a round, block ``i`` of a source with ``k``
slots is released at ``floor(i ROUND / k)`` and due at ``ceil((i + 1) ROUND / k)``; each slot goes to
the released block that is due first.  As the shares sum to one, every block meets its window, so at any
slot a source has had less than one block more or less than its share.  The schedule repeats with each
round, hence it is computed once, for one round, and a document finds its slot from its block number alone.

All documents stay.  Once a source has run out, its slots are empty and the others go on by the same schedule;
``in_mix`` tells the part before that, where the weights hold.

Fixed meaning of edge cases: null sources are one source; null texts have no characters; rows that share an id
are ordered by their text, and repeated rows are all kept; an empty table gives an empty result; in ``mix`` the columns
``block``, ``slot`` and ``in_mix`` replace input columns of these names.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, without

#: Characters of a block, slots of a round (more if there are more than a quarter as many sources), rows of a bucket.
BLOCK_CHARS, ROUND, BUCKET_ROWS = 10_000, 1000, 2000


def placed(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``df`` with struct ``_at``: the source, the order within it, and the characters before the row.

    A source may hold most of the rows, so its running sum is taken in two steps: within buckets of the
    order, then over the buckets' totals.
    """
    digits = max(0, ceil(log(max(1, df.select(key).count() / BUCKET_ROWS), 16)))
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    at = F.struct(F.col(source).cast("string").alias("source"), order.alias("order"), F.substring(order, 1, digits).alias("bucket"),
                  F.xxhash64(F.col(text)).alias("tie"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars"))
    rows = df.withColumn("_at", at)
    totals = rows.groupBy("_at.source", "_at.bucket").agg(F.sum("_at.chars").alias("chars"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.struct("source", "bucket", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("before")).alias("_total"))
    within = Window.partitionBy("_at.source", "_at.bucket").orderBy("_at.order", F.col(key), "_at.tie").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum("_at.chars").over(within), F.lit(0)))
    both = own.join(totals, F.col("_at.source").eqNullSafe(F.col("_total.source")) & (F.col("_at.bucket") == F.col("_total.bucket")))
    return both.withColumn("_at", F.col("_at").withField("before", F.col("_own") + F.col("_total.before"))).drop("_own", "_total")


def schedule(df: DataFrame, source: str, text: str, weights: dict[str, float] | None) -> DataFrame:
    """One row per source: ``source``, ``k``, ``slots`` (the slots of a round that it has), ``round`` and its ``blocks``.

    Without ``weights``, a source's weight is the square root of its characters.  The arrays below have an
    entry for each source or slot; they don't grow with the rows.
    """
    sizes = df.groupBy(F.col(source).cast("string").alias("source")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("chars"))
    if weights is None:
        weight = F.sqrt(F.greatest("chars", F.lit(1)).cast("double"))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(given[F.coalesce("source", F.lit(""))], F.lit(0.0)).cast("double")
    # one row with all sources, in the order of their names
    one = sizes.select("source", "chars", weight.alias("weight")).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("source", "chars", "weight"))).alias("s")).where(F.size("s") > 0)
    one = one.withColumn("round", F.greatest(F.lit(ROUND), 4 * F.size("s"))).withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["weight"]))
    whole = F.transform("s", lambda x: F.greatest(F.floor((F.col("round") - F.size("s")) * x["weight"] / F.col("total")), F.lit(0)).cast("int") + 1)
    rest = F.transform("s", lambda x, i: F.struct(
        (-((F.col("round") - F.size("s")) * x["weight"] / F.col("total") - F.get("whole", i) + 1)).alias("less"), i.alias("i")))
    one = one.withColumn("whole", whole).withColumn("rest", F.array_sort(rest))
    missing = F.col("round") - F.aggregate("whole", F.lit(0), lambda a, x: a + x)
    one = one.withColumn("extra", F.transform(F.slice("rest", F.lit(1), missing), lambda x: x["i"]))
    one = one.withColumn("k", F.transform("whole", lambda n, i: n + F.when(F.array_contains("extra", i), 1).otherwise(0)))

    def due(done: Column, k: Column) -> Column:  # of a source's next block: (deadline, number of the source)
        return F.ceil((done + 1) * F.col("round") / k)

    def step(state: Column, slot: Column) -> Column:
        waiting = F.transform(F.col("k"), lambda k, i: F.when(
            (F.get(state["done"], i) < k) & (F.floor(F.get(state["done"], i) * F.col("round") / k) <= slot),
            F.struct(due(F.get(state["done"], i), k).alias("due"), i.alias("i"))))
        pick = F.array_min(waiting)["i"]
        return F.struct(
            F.transform(state["done"], lambda n, i: n + F.when(i == pick, 1).otherwise(0)).alias("done"),
            F.concat(state["turns"], F.array(pick)).alias("turns"))

    start = F.struct(F.transform("k", lambda k: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("turns"))
    one = one.withColumn("turns", F.aggregate(F.sequence(F.lit(0), F.col("round") - 1), start, step, lambda state: state["turns"]))
    each = one.select("round", "k", "turns", F.posexplode("s").alias("i", "x"))
    slots = F.filter(F.sequence(F.lit(0), F.col("round") - 1), lambda t: F.get("turns", t) == F.col("i"))
    return each.select("x.source", F.get("k", F.col("i")).alias("k"), slots.alias("slots"), "round",
                       F.ceil(F.col("x.chars") / BLOCK_CHARS).alias("blocks"))


def slot_of(block: Column, k: Column, slots: Column, round_: Column) -> Column:
    return (F.floor(block / k) * round_ + F.get(slots, (block % k).cast("int"))).cast("bigint")


def mix(df: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``df`` with ``block``, ``slot`` and ``in_mix``; ordered by (slot, md5 of the key) it is the mix."""
    for name in ("block", "slot", "in_mix"):
        df = without(df, name)
    plan = saved(schedule(df, source, text, weights), "mixing-schedule")  # its size is known when the join is planned
    last = slot_of(F.col("blocks") - 1, F.col("k"), F.col("slots"), F.col("round"))
    ends = F.min(F.when(F.col("blocks") > 0, last)).over(Window.partitionBy("round"))  # one round length, a row per source
    plan = plan.withColumn("_ends", ends).select(F.struct("source", "k", "slots", "round", "_ends").alias("_plan"))
    both = placed(df, key, source, text).join(plan, F.col("_at.source").eqNullSafe(F.col("_plan.source")))
    block = F.floor(F.col("_at.before") / BLOCK_CHARS).cast("bigint")
    both = both.withColumn("block", block).withColumn(
        "slot", slot_of(F.col("block"), F.col("_plan.k"), F.col("_plan.slots"), F.col("_plan.round")))
    return both.withColumn("in_mix", F.coalesce(F.col("slot") <= F.col("_plan._ends"), F.lit(True))).drop("_at", "_plan")


def mixed_order(df: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source", text: str = "text",
                slot: str = "mix_slot", active: str = "in_mix") -> DataFrame:
    """The rows and columns of ``df`` in the order of the mix, over partitions that follow each other, with two columns more:
    ``slot``, whose ascending order is the mix wherever the rows are written and read, and ``active``, whether the
    weights still hold there.  Input columns of these two names are replaced, all others come back, whatever their names."""
    own = [c for c in df.columns if c.lower() not in (slot.lower(), active.lower())]
    packed = df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in own]).alias("_row"))
    of = lambda name: f"_row.`{name}`"
    order = [F.col("slot"), F.md5(F.coalesce(F.col(of(key)).cast("string"), F.lit("")))]
    found = mix(packed, weights, of(key), of(source), of(text)).repartitionByRange(*order).sortWithinPartitions(*order)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in own], F.col("slot").alias(slot), F.col("in_mix").alias(active))
