"""Exact top-k search by vector-approximation files.

Vectors are whole numbers, floor(1024 x) of each component, and scores inner products.

1. ``candidates`` writes the exact vectors, equal ones once with the smallest ids of the rows that have them, so a vector
   that a third of all rows share is one candidate.
2. ``approximated`` writes the approximation beside them: blocks of up to ``BLOCK`` vectors with each component as one of 256
   cells between the block's least and greatest value, a byte a component.
3. The queries meet the cells in groups of ``GROUP_BYTES`` of query vectors.  A first scan keeps each query's k best lower bounds
   of a task; the k-th best of all tasks is a score that the k-th result reaches.  A second scan returns the (query,
   vector) pairs whose upper bound reaches it.  Only cells are read, and nothing is shuffled but these few pairs.
4. Exact vectors are read in the order of the bounds: first for each query's k pairs with the best upper bounds, then for those
   pairs whose upper bound reaches the k-th exact score of the first ones.  Then the k-th result is certain.

Fixed meaning of edge cases: vectors that are null or hold a null or non-finite component take no part, nor do
components that overflow when multiplied by 1024, nor rows without an id; vectors are compared with those of the same length,
empty ones score 0 with each other; large components are multiplied in whole numbers, and a score beyond a long is the nearest
long; a row is no candidate of queries with its own id; rows that share an id are candidates each, repeated ones too, and
queries that share an id are ranked together, each row with its own scores; ties go to the smaller id; other columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Vectors of a block, bytes of the queries that meet all cells in one pass, queries compared with a block at once.
BLOCK, GROUP_BYTES, QUERIES_AT_ONCE = 4096, 16_000_000, 256
CELLS = 256
#: Sums of doubles are exact below ``EXACT``; beyond, bounds are widened by this share of the greatest possible sum.
EXACT, SLACK = 2.0 ** 52, 2.0 ** -44
LONG = 2 ** 63


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors of whole numbers, as doubles."""
    infinite = F.lit(float("inf"))
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: x * 1024)
    # beyond 2**53 a double is whole, and floor would make it a long
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x))
    rows = df.select(F.col(key).cast("bigint").alias("id"), scaled.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < infinite)))
    return rows.select("id", whole.alias("v"))


def candidates(df: DataFrame, k: int) -> DataFrame:
    """(vec, v, ids, times, only): the different vectors of (id, v), with the k + 1 smallest ids, how often each of them has it (k at most),
    and the id if there is one only."""
    counted = df.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    order = Window.partitionBy("v").orderBy("id")
    first = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    rows = first.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    return rows.select(F.monotonically_increasing_id().alias("vec"), "v", F.col("m.id").alias("ids"), F.col("m.n").alias("times"),
                       F.when(F.size("m") == 1, F.col("m")[0]["id"]).alias("only"))


def matrices(batch: pa.RecordBatch, vector: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length in a batch."""
    column = batch.column(vector)
    lengths = np.diff(column.offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def approximated(exact: DataFrame) -> DataFrame:
    """Blocks of cells of vectors of one length: dim, vecs, alone, only, cells, low and step per component."""
    schema = "dim int, vecs binary, alone binary, only binary, cells binary, low binary, step binary"

    def row(vecs: np.ndarray, only: np.ndarray, alone: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        low, high = v.min(axis=0), v.max(axis=0)
        step = np.where(high / 2 - low / 2 < EXACT / 4, np.floor(np.minimum(high - low, EXACT) / CELLS) + 1, high / (CELLS - 1) - low / (CELLS - 1))
        cells = np.clip(np.floor(v / step - low / step) if (step > EXACT / CELLS).any() else (v - low) // step, 0, CELLS - 1).astype(np.uint8)
        data = [x.tobytes() for x in (vecs, alone, only, cells, low, step)]
        return pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], [c.split()[0] for c in schema.split(", ")])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            vecs, only = batch.column(0).to_numpy(), batch.column(1)
            alone, only = only.is_valid().to_numpy(zero_copy_only=False), only.fill_null(0).to_numpy()
            for at, v in matrices(batch, 2):
                rows = held.setdefault(v.shape[1], [])
                rows.append((vecs[at], only[at], alone[at], v))
                if sum(len(r[0]) for r in rows) >= BLOCK:
                    whole = [np.concatenate(c) for c in zip(*rows)]
                    full = len(whole[0]) // BLOCK * BLOCK
                    for start in range(0, full, BLOCK):
                        yield row(*(c[start:start + BLOCK] for c in whole))
                    held[v.shape[1]] = [tuple(c[full:] for c in whole)]
        for rows in held.values():
            whole = [np.concatenate(c) for c in zip(*rows)]
            if len(whole[0]):
                yield row(*whole)

    return exact.select("vec", "only", "v").mapInArrow(build, schema)


@dataclass
class Queries:
    """Queries of one length: their numbers in the group, ids and vectors, and scores that their k-th results reach."""

    number: np.ndarray
    ids: np.ndarray
    v: np.ndarray
    reached: np.ndarray


def bounds(q: Queries, part: slice, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a block, and lower and upper bounds of their scores for some queries; a query's own row has none."""
    vecs, alone, only = (np.frombuffer(row[n], kind) for n, kind in (("vecs", np.int64), ("alone", np.bool_), ("only", np.int64)))
    cells = np.frombuffer(row["cells"], np.uint8).reshape(len(vecs), -1).astype(np.float64)
    low, step = np.frombuffer(row["low"]), np.frombuffer(row["step"])
    below = low + cells * step
    above = below + np.where(step < EXACT / CELLS, step - 1, step)
    v = q.v[part]
    plus, minus = np.maximum(v, 0), np.minimum(v, 0)
    with np.errstate(all="ignore"):
        lower, upper = plus @ below.T + minus @ above.T, plus @ above.T + minus @ below.T
        size = np.abs(v).max(axis=1, initial=0) * max(np.abs(below).max(initial=0), np.abs(above).max(initial=0)) * max(v.shape[1], 1)
        wide = np.where(size < EXACT, 0, size * SLACK)[:, None]
        lower, upper = np.nan_to_num(lower - wide, nan=-np.inf, neginf=-np.inf, posinf=np.inf), np.nan_to_num(upper + wide, nan=np.inf, neginf=-np.inf, posinf=np.inf)
    lower[~np.isfinite(wide[:, 0])], upper[~np.isfinite(wide[:, 0])] = -np.inf, np.inf
    own = alone[None, :] & (only[None, :] == q.ids[part][:, None])
    lower[own] = upper[own] = -np.inf
    return vecs, lower, upper


def parts(size: int) -> Iterator[slice]:
    return (slice(i, i + QUERIES_AT_ONCE) for i in range(0, size, QUERIES_AT_ONCE))


def lower_bounds(cells: DataFrame, group: dict[int, Queries], k: int) -> DataFrame:
    """(query, lower): each query's k best lower bounds of a task."""
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: np.full((len(q.ids), k), -np.inf) for dim, q in group.items()}
        for batch in batches:
            for row in batch.to_pylist():
                if (q := group.get(row["dim"])) is not None:
                    for part in parts(len(q.ids)):
                        both = np.concatenate([best[row["dim"]][part], bounds(q, part, row)[1]], axis=1)
                        best[row["dim"]][part] = np.partition(both, -k, axis=1)[:, -k:]
        for dim, lower in best.items():
            at, place = np.nonzero(lower > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(group[dim].number[at], pa.int32()), pa.array(lower[at, place])], ["query", "lower"])

    return cells.mapInArrow(scan, "query int, lower double")


def near(cells: DataFrame, group: dict[int, Queries]) -> DataFrame:
    """(query, vec, upper) of the pairs whose upper bound reaches what the query's k-th result reaches."""
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if (q := group.get(row["dim"])) is not None:
                    for part in parts(len(q.ids)):
                        vecs, _, upper = bounds(q, part, row)
                        at, place = np.nonzero((upper >= q.reached[part][:, None]) & (upper > -np.inf))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(q.number[part][at], pa.int32()), pa.array(vecs[place]), pa.array(upper[at, place])], ["query", "vec", "upper"])

    return cells.mapInArrow(scan, "query int, vec bigint, upper double")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, exact inner products as longs."""
    size = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(q.shape[1], 1)
    if size < EXACT:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    exact = (sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q.tolist(), v.tolist()))
    return np.array([min(max(s, -LONG), LONG - 1) for s in exact], np.int64)


def scored(pairs: DataFrame, exact: DataFrame, group: dict[int, Queries]) -> DataFrame:
    """(query, query_id, vec, score, ids, times): pairs (query, vec) with the exact vectors read."""
    place = {int(n): (dim, i) for dim, q in group.items() for i, n in enumerate(q.number)}

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, score = batch.column(0).to_numpy(), np.empty(batch.num_rows, np.int64)
            ids = np.empty(batch.num_rows, np.int64)
            for at, v in matrices(batch, 2):
                q = group[v.shape[1]]
                rows = [place[n][1] for n in number[at].tolist()]
                score[at], ids[at] = products(q.v[rows], v), q.ids[rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids), batch.column(1), pa.array(score), batch.column(3), batch.column(4)], ["query", "query_id", "vec", "score", "ids", "times"])

    joined = pairs.join(exact, "vec").select("query", "vec", "v", "ids", "times")
    return joined.mapInArrow(read, "query int, query_id bigint, vec bigint, score bigint, ids array<bigint>, times array<bigint>")


def kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(query, ``value``): the k-th greatest, for queries that have k."""
    order = Window.partitionBy("query").orderBy(F.desc(value))
    ranked = rows.select("query", value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") == k).drop("rank")


def one_group(rows: list, exact: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): at least the k best of each query of a group, rows (id, v)."""
    group = {}
    for dim in sorted({len(r["v"]) for r in rows}):
        chosen = [(i, r) for i, r in enumerate(rows) if len(r["v"]) == dim]
        group[dim] = Queries(np.array([i for i, _ in chosen]), np.array([r["id"] for _, r in chosen], np.int64),
                             np.array([r["v"] for _, r in chosen], np.float64).reshape(len(chosen), dim), np.full(len(chosen), -np.inf))
    reached = {r["query"]: r["lower"] for r in kth(lower_bounds(cells, group, k), "lower", k).collect()}  # a row per query of the group
    for q in group.values():
        q.reached = np.array([reached.get(int(n), -np.inf) for n in q.number])
    order = Window.partitionBy("query").orderBy(F.desc("upper"), "vec")
    pairs = saved(near(cells, group), "top-k-pairs")
    best = saved(pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "top-k-best")
    first = saved(scored(best.select("query", "vec"), exact, group), "top-k-first")
    last = best.where(F.col("place") == k).select(F.col("query").alias("l_query"), F.col("upper").alias("l_upper"), F.col("vec").alias("l_vec"))
    # a row per query of the group, whose size GROUP_BYTES bounds; a query may have many pairs, which no task should gather
    known = F.broadcast(last.join(kth(first, "score", k), F.col("query") == F.col("l_query")).select("l_query", "l_upper", "l_vec", F.col("score").cast("double").alias("k_score")))
    further = (F.col("upper") < F.col("l_upper")) | (F.col("upper") == F.col("l_upper")) & (F.col("vec") > F.col("l_vec"))
    # a score as a double may be above it by half a unit in the last place, but bounds beyond EXACT are wider
    rest = pairs.join(known, F.col("query") == F.col("l_query")).where((F.col("upper") >= F.col("k_score")) & further).select("query", "vec")
    found = first.unionByName(scored(rest, exact, group))
    each = found.select("query_id", "score", F.explode(F.arrays_zip("ids", "times")).alias("m")).where(F.col("m.ids") != F.col("query_id"))
    return each.select("query_id", F.col("m.ids").alias("vec_id"), "score", F.explode(F.array_repeat(F.lit(0), F.col("m.times").cast("int")))).drop("col")


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best other vectors of each query."""
    exact = saved(candidates(usable(vectors, key, vector), k), "top-k-vectors")
    cells = saved(approximated(exact), "top-k-cells")
    asked = usable(queries, key, vector)
    size = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    groups = max(1, -(-size * 8 // GROUP_BYTES))
    asked = saved(asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")), "top-k-queries")
    found = None
    for n in range(groups):
        rows = asked.where(F.col("part") == n).select("id", "v").collect()  # GROUP_BYTES in the mean
        one = one_group(rows, exact, cells, k)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
