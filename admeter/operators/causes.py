"""The nearest earlier set of each set of words: exact, by bit maps of the sets.

A bit map has a bit for each remainder of the hashes of a set's words, set if an odd number of them has it.  Two maps differ in no more
bits than the sets differ in words, so two sets whose maps differ in more than Jaccard similarity allows are not alike; what
is left is compared word by word.  Sets are dealt by size: those that may be alike are of one class or of two that follow each other.  A
group's sets are cut into ``PARTS`` parts at most, and each two parts of such classes meet in a task; a set is so sent a bounded
number of times, as a map of some twelve bits a word.  Maps are compared folded to about a bit for each word of the two sets, and
whole where that does not tell them apart.  The comparisons of a large group still grow with the square of its sets.

Only the smallest candidates of a set are compared word by word: the first, and if it is not alike the next sixteen, and so on until
each set has its answer or no candidate left.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..llm.common import WordHashes, saved

#: Groups up to this many sets are joined as they are.
SMALL = 32
#: Sets of a part of a group, about, and parts at most.
PART_SETS, PARTS = 16_384, 8
#: Sets that are compared with so many others at a time: what comes of it stays in a core's cache.
CHUNK, TILE = 64, 2048
#: Candidates of a task that are gathered before only the smallest are kept.
GATHERED = 1 << 21
#: Longest map, in words of 64 bits.
MAP_WORDS = 3 << 12

_hashes = WordHashes()


def size_classes(least: float) -> list[int]:
    """Least sizes of classes; sets that are alike are of one class or of two that follow each other."""
    sizes = [1]
    while sizes[-1] < 1 << 40:
        sizes.append(int(sizes[-1] / max(least, 1e-9) * (1 + 1e-9)) + 1)
    return sizes


def map_words(size: int) -> int:
    """Words of the maps of sets of up to ``size`` words, and of those alike: six bits a word or more, in a number that can be folded by 2, 3 and 4."""
    most = 3
    while 64 * most < 6 * size and most < MAP_WORDS:
        most *= 2
    return most


def bit_map(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def dealt(one: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, class, i, j, left, hash, first, after, asked, n, map): sets (keys, hash, first, after, asked, parts, stems) once for each task."""
    sizes = size_classes(least)
    kept = [*keys, "hash", "first", "after", "asked"]
    schema = one.select(*kept).schema

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, klass, left_part, right_part, left, size, maps = ([] for _ in range(7))
            parts, own = batch.column("parts").to_pylist(), batch.column("hash").to_pylist()
            for r, text in enumerate(batch.column("stems").cast(pa.binary()).to_pylist()):
                hashes = _hashes.of(text)
                n, k = len(hashes), parts[r]
                c, p = bisect_right(sizes, n) - 1, int.from_bytes(own[r][:4], "big") % k
                for at, tasks in ((c, [(p, j, True) for j in range(k)] + [(i, p, False) for i in range(p)]), (c - 1, [(i, p, False) for i in range(k)])):
                    if at >= 0:
                        data = bit_map(hashes, 64 * map_words(sizes[at + 1])).tobytes()
                        for i, j, is_left in tasks:
                            row.append(r)
                            klass.append(at)
                            left_part.append(i)
                            right_part.append(j)
                            left.append(is_left)
                            size.append(n)
                            maps.append(data)
            taken = batch.select(kept).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, *(pa.array(x, pa.int32()) for x in (klass, left_part, right_part, size)), pa.array(left, pa.bool_()), pa.array(maps, pa.binary())],
                [*kept, "class", "i", "j", "n", "left", "map"])

    for name in ("class", "i", "j", "n"):
        schema = schema.add(name, T.IntegerType())
    schema = schema.add("left", T.BooleanType()).add("map", T.BinaryType())
    return one.select(*kept, "parts", "stems").mapInArrow(explode, schema)


def smallest(s: np.ndarray, t: np.ndarray, rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (s, t) those in which t is one of the ``most`` of smallest rank for its s, and those that tie with the last of them."""
    order = np.lexsort((rank[t], s))
    s, t = s[order], t[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    count = np.diff(np.append(start, len(s)))
    last = np.repeat(rank[t[start + np.minimum(count, most) - 1]] if len(s) else start, count)
    keep = rank[t] <= last
    return s[keep], t[keep]


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """Maps (a row for each word) as the shorter maps of ``to`` words; ``to`` divides their length."""
    return np.ascontiguousarray(np.bitwise_xor.reduce(words.reshape(-1, to, words.shape[1]), axis=0))


def close(maps: dict[int, np.ndarray], n: np.ndarray, a: np.ndarray, b: np.ndarray, allowed: float) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of the sets ``a`` and ``b`` those whose maps differ in no more bits than alike sets do in words."""
    total = int(n[a].max() + n[b].max())
    whole = max(maps)
    used = next((w for w in sorted(maps) if 64 * w >= total), whole)
    words, limit = maps[used], total * allowed + 1e-6
    differ = np.zeros((len(a), len(b)), np.uint16 if used < 1 << 10 else np.int32)
    both, bits, three = np.empty(differ.shape, np.uint64), np.empty(differ.shape, np.uint8), np.empty(differ.shape, np.uint8)
    for at in range(0, used, 3):  # three words differ in 192 bits at most, which fit a byte
        for i, w in enumerate(words[at:at + 3]):
            np.bitwise_xor(w[a][:, None], w[b][None, :], out=both)
            np.bitwise_count(both, out=bits if i else three)
            if i:
                np.add(three, bits, out=three)
        np.add(differ, three, out=differ)
    x, y = np.divmod(np.flatnonzero(differ <= min(int(limit), 64 * used)), len(b))
    of, x, y = differ[x, y], a[x], b[y]
    ok = of <= (n[x] + n[y]) * allowed + 1e-6
    x, y = x[ok], y[ok]
    if used < whole and len(x):
        words, of = maps[whole], np.zeros(len(x), np.int64)
        for w in words:
            of += np.bitwise_count(w[x] ^ w[y])
        ok = of <= (n[x] + n[y]) * allowed + 1e-6
        x, y = x[ok], y[ok]
    return x, y


def candidates(dealt_sets: DataFrame, one: DataFrame, keys: list[str], least: float, most: int) -> DataFrame:
    """(keys, hash, other_hash, other): per task and asked set its ``most`` smallest candidates that come before it and after ``after``."""
    allowed = (1 - least) / (1 + least)
    schema = one.select(*keys, "hash", F.col("hash").alias("other_hash"), F.col("first").alias("other")).schema

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table["n"].to_numpy()
        order = np.argsort(n, kind="stable")
        table, n = table.take(pa.array(order)), n[order]
        left = table["left"].to_numpy(zero_copy_only=False)
        asked = table["asked"].to_numpy(zero_copy_only=False)
        both = pa.chunked_array([*table["first"].chunks, *table["after"].chunks]).combine_chunks()
        ranks = pc.rank(both, sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy().astype(np.int64)
        rank, after = ranks[:len(n)], np.where(table["after"].is_null().to_numpy(zero_copy_only=False), -1, ranks[len(n):])
        words = np.ascontiguousarray(np.frombuffer(b"".join(table["map"].to_pylist()), np.uint64).reshape(len(n), -1).T)
        maps = {w: folded(words, w) for w in (len(words) // 4, len(words) // 3, len(words) // 2, len(words)) if w and len(words) % w == 0}
        inside = table["i"][0].as_py() == table["j"][0].as_py()
        right = np.arange(len(n)) if inside else np.flatnonzero(~left)
        found_s, found_t, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        # a pair of which neither is asked needs no answer
        for lefts, others in ((np.flatnonzero(left & asked), right), (np.flatnonzero(left & ~asked), right[asked[right]])):
            sizes = n[others]
            for start in range(0, len(lefts), CHUNK):
                a = lefts[start:start + CHUNK]
                low, high = np.searchsorted(sizes, n[a[0]] * least * (1 - 1e-9), "left"), np.searchsorted(sizes, n[a[-1]] / max(least, 1e-9) * (1 + 1e-9), "right")
                near = others[max(low, np.searchsorted(others, a[0], "right") if inside else 0):high]
                for at in range(0, len(near), TILE):
                    x, y = close(maps, n, a, near[at:at + TILE], allowed)
                    if inside:
                        new = ~left[y] | (x < y)
                        x, y = x[new], y[new]
                    s, t = np.where(rank[x] > rank[y], x, y), np.where(rank[x] > rank[y], y, x)
                    ok = (rank[s] > rank[t]) & asked[s] & (rank[t] > after[s])
                    s, t = smallest(s[ok], t[ok], rank, most)
                    found_s.append(s)
                    found_t.append(t)
                    held += len(s)
                    if held > GATHERED:
                        s, t = smallest(np.concatenate(found_s), np.concatenate(found_t), rank, most)
                        found_s, found_t, held = [s], [t], 0
        s, t = smallest(np.concatenate(found_s), np.concatenate(found_t), rank, most)
        s, t = pa.array(s), pa.array(t)
        return pa.table([*(table[k].take(s) for k in [*keys, "hash"]), table["hash"].take(t), table["first"].take(t)], [*keys, "hash", "other_hash", "other"])

    return dealt_sets.groupBy(*keys, "class", "i", "j").applyInArrow(find, schema)


def compared(pairs: DataFrame, one: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs (keys, hash, other_hash, other) with their ``likeness`` and whether they are ``alike``, word by word."""
    a = one.select(*keys, "hash", F.col("stems").alias("_a"))
    b = one.select(*keys, F.col("hash").alias("other_hash"), F.col("stems").alias("_b"))
    held = pairs.join(a, [*keys, "hash"]).join(b, [*keys, "other_hash"])
    held = held.withColumns({"_a": F.split("_a", " "), "_b": F.split("_b", " ")}).withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    likeness = F.col("_both") / (F.size("_a") + F.size("_b") - F.col("_both"))
    return held.withColumn("likeness", likeness).withColumn("alike", (F.col("_both") > 0) & (F.col("likeness") >= least)).drop("_a", "_b", "_both")


def nearest(one: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, hash, of STRUCT<other, likeness>): for each set the smallest ``first`` of a set of its group that is alike and comes before it.

    ``one`` has a row for each different set: ``keys, hash, first, stems`` (different words, joined by a space).
    """
    best = F.min(F.when(F.col("alike"), F.struct("other", "likeness"))).alias("of")
    counts = saved(one.groupBy(*keys).agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > 1), "causes-groups")
    few = one.join(counts.filter(F.col("sets") <= SMALL), keys, "left_semi").select(*keys, "hash", "first")
    others = few.select(*keys, F.col("hash").alias("other_hash"), F.col("first").alias("other"))
    found = saved(compared(few.join(others, keys).filter(F.col("other") < F.col("first")).drop("first"), one, keys, least)
                  .groupBy(*keys, "hash").agg(best).filter(F.col("of").isNotNull()), "causes-few")
    parts = F.least(F.ceil(F.col("sets") / PART_SETS), F.lit(PARTS)).cast("int")
    large = one.join(counts.filter(F.col("sets") > SMALL).select(*keys, parts.alias("parts")), keys)
    pending, most = None, 1
    while pending is None or not pending.isEmpty():
        if pending is None:
            state = large.withColumns({"after": F.lit(None).cast(one.schema["first"].dataType), "asked": F.lit(True)})
        else:
            state = large.join(pending.withColumn("asked", F.lit(True)), [*keys, "hash"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        near = saved(candidates(dealt(state, keys, least), one, keys, least, most), "causes-candidates")
        place = F.rank().over(W.partitionBy(*keys, "hash").orderBy("other"))
        pairs = near.withColumn("place", place).filter(F.col("place") <= most).drop("place").distinct()
        held = saved(compared(pairs, one, keys, least).groupBy(*keys, "hash").agg(
            best, F.max("other").alias("after"), F.count(F.lit(1)).alias("tried")), "causes-held")
        found = found.unionByName(held.filter(F.col("of").isNotNull()).select(*keys, "hash", "of"))
        pending, most = held.filter(F.col("of").isNull() & (F.col("tried") >= most)).select(*keys, "hash", "after"), most * 16
    return found
