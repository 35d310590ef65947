"""Ranked lexical search of all documents, term at a time with limited accumulators.

1. ``postings`` reads each whole text once and writes, for each task's documents, blocks of postings of the terms asked for:
   (document, term, occurrences), beside every document's length.  Lengths and document frequencies are summed over
   all blocks.
2. ``search`` reads the blocks with up to ``BLOCK_DOCS`` documents at a time.  The impact of each posting is computed once
   per block.  Each item then takes its terms from the rarest on.  Every document of a term's list gets an accumulator,
   until what the terms to come can add at most (the sum of their greatest impacts in the block) is less than
   the k-th best partial score: no document without an accumulator can then be among the k best.  From there on
   the lists only update accumulators that exist, exactly.
3. A block leaves its k best documents per item; the best k of them all, by ``row_number``, are exact.

The items are a stated set that may be large: they are dealt to groups whose texts have ``GROUP_BYTES`` on average, and
each group's terms, the only thing that every task holds, meet all documents in a pass of their own.

Fixed meaning of edge cases: null texts have no terms; an item without terms, or whose terms no document holds, has no rows;
each different (id, text) of the items is an item, repeated ones count once; rows of documents that share an id are documents of
their own, and those without an id come last among equal scores; empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Scores in whole numbers, saturation and length normalisation.
SCALE, ONE, K1, FLAT, SLOPE = 1_000_000_000, 1000, 12, 100 - 25, 25
#: Documents whose accumulators a task holds; bytes of the items' texts that meet the documents in one pass.
BLOCK_DOCS, GROUP_BYTES = 16_384, 8_000_000
#: ASCII letters and digits, and all bytes of other characters, belong to terms; A-Z become lower case, the rest are blanks.
FOLDED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
BLOCK = "ids binary, named binary, lengths binary, docs binary, terms binary, times binary, held array<int>, frequencies array<int>, with_terms bigint, total bigint"


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLDED).split() if text else []


class Block:
    """Postings of some documents, in order of (document, term)."""

    def __init__(self) -> None:
        self.parts: dict[str, list[np.ndarray]] = {n: [] for n in ("ids", "named", "lengths", "docs", "terms", "times")}
        self.size = 0

    def add(self, **arrays: np.ndarray) -> None:
        arrays["docs"] = arrays["docs"] + self.size
        self.size += len(arrays["ids"])
        for name, values in arrays.items():
            self.parts[name].append(values)

    def __getitem__(self, name: str) -> np.ndarray:
        kinds = {"ids": np.int64, "named": np.bool_, "lengths": np.int64}
        return np.concatenate([np.empty(0, kinds.get(name, np.int32)), *self.parts[name]])

    def row(self) -> pa.RecordBatch:
        held, frequencies = np.unique(self["terms"], return_counts=True)
        lengths = self["lengths"]
        data = {n: pa.array([self[n].tobytes()], pa.binary()) for n in self.parts}
        data |= {n: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for n, x in (("held", held), ("frequencies", frequencies))}
        data |= {n: pa.array([int(x)], pa.int64()) for n, x in (("with_terms", np.count_nonzero(lengths)), ("total", lengths.sum()))}
        return pa.RecordBatch.from_pydict({n.split()[0]: data[n.split()[0]] for n in BLOCK.split(", ")})


def postings(docs: DataFrame, terms: list[bytes], key: str, text: str) -> DataFrame:
    """Blocks of postings of ``terms``; a term's number is its place in the list."""
    small_batches(docs.sparkSession)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        block = Block()
        for batch in batches:
            ids = batch.column(0)
            lengths, found = [], []
            for i, value in enumerate(batch.column(1)):
                words = terms_of(value.as_py())
                lengths.append(len(words))
                numbers = np.fromiter((n for n in map(number.get, words) if n is not None), np.int64)
                found.append(numbers + i * len(terms))
            both, times = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            block.add(ids=ids.fill_null(0).to_numpy(zero_copy_only=False), named=ids.is_valid().to_numpy(zero_copy_only=False), lengths=np.array(lengths, np.int64),
                      docs=(both // max(len(terms), 1)).astype(np.int32), terms=(both % max(len(terms), 1)).astype(np.int32), times=times.astype(np.int32))
            if block.size >= BLOCK_DOCS:
                yield block.row()
                block = Block()
        if block.size:
            yield block.row()

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(build, BLOCK)


class Weights:
    """What all blocks share: the number of documents, their terms, and each term's weight."""

    def __init__(self, documents: int, total: int, frequencies: np.ndarray):
        self.documents, self.total, self.frequencies = documents, total, frequencies
        self.weight = np.array([floor(ONE * log((2 * documents + 2) / (2 * n + 1))) for n in frequencies.tolist()], np.int64)

    def impacts(self, block: Block) -> np.ndarray:
        """What each posting adds to a score that holds its term once."""
        norm = np.array([FLAT + SLOPE * n * self.documents // self.total for n in block["lengths"].tolist()], np.int64)
        times = block["times"].astype(np.int64)
        return self.weight[block["terms"]] * (SCALE * times // (ONE * times + K1 * norm[block["docs"]]))


def kth_best(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def ranked(item: list[tuple[int, int]], lists: dict[int, tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators of one item, as (documents, scores); ``item`` has (term, occurrences) from the rarest term on."""
    item = [(t, n) for t, n in item if t in lists]
    bounds = [n * int(lists[t][1].max()) for t, n in item]
    rest = sum(bounds)
    scores, held = np.zeros(size, np.int64), np.zeros(size, bool)
    at = 0
    while at < len(item) and (rest > 0 and rest >= kth_best(scores[held], k)):
        term, n = item[at]
        docs, impact = lists[term]
        scores[docs] += n * impact
        held[docs] = True
        rest -= bounds[at]
        at += 1
    survivors = np.flatnonzero(held)
    partial = scores[survivors]
    for term, n in item[at:]:
        docs, impact = lists[term]
        place = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
        partial = partial + np.where(docs[place] == survivors, n * impact[place], 0)
    return survivors, partial


def best(block: Block, shared: Weights, items: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(item, ids, named, scores) of each item's k best documents of a block."""
    terms, docs, impact = block["terms"], block["docs"], shared.impacts(block)
    order = np.argsort(terms, kind="stable")
    held, first = np.unique(terms[order], return_index=True)
    lists = {int(t): (docs[o], impact[o]) for t, o in zip(held, np.split(order, first[1:]))}
    ids, named = block["ids"], block["named"]
    for i, item in enumerate(items):
        found, scores = ranked(item, lists, block.size, k)
        near = (scores > 0) & (scores >= kth_best(scores, k))
        found, scores = found[near], scores[near]
        top = np.lexsort((ids[found], ~named[found], -scores))[:k]
        yield i, ids[found[top]], named[found[top]], scores[top]


def one_pass(docs: DataFrame, group: list[tuple[int | None, str]], k: int, key: str, text: str) -> DataFrame:
    """(item, item_id, doc_id, score): the k best documents of each block, for the items of a group."""
    counts = [Counter(terms_of(t)) for _, t in group]
    terms = sorted({t for c in counts for t in c})
    number = {t: i for i, t in enumerate(terms)}
    blocks = saved(postings(docs, terms, key, text), "postings")
    whole = blocks.agg(F.sum("with_terms").alias("documents"), F.sum("total").alias("total")).first()
    frequencies = np.zeros(len(terms), np.int64)
    pairs = blocks.select(F.explode(F.arrays_zip("held", "frequencies")).alias("x")).groupBy("x.held").agg(F.sum("x.frequencies").alias("n"))
    for term, n in pairs.collect():  # a row per term of the group at most
        frequencies[term] = n
    shared = Weights(whole["documents"] or 0, max(whole["total"] or 0, 1), frequencies)
    items = [sorted(((number[t], n) for t, n in c.items() if frequencies[number[t]]), key=lambda x: (frequencies[x[0]], x[0])) for c in counts]
    names = [i for i, _ in group]

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: Block) -> pa.RecordBatch:
            columns: tuple[list, ...] = ([], [], [], [])
            for i, ids, named, scores in best(block, shared, items, k):
                columns[0].extend([i] * len(ids))
                columns[1].extend([names[i]] * len(ids))
                columns[2].extend(x if known else None for x, known in zip(ids.tolist(), named.tolist()))
                columns[3].extend(scores.tolist())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

        block = Block()
        for batch in batches:
            for row in batch.to_pylist():
                arrays = {n: np.frombuffer(row[n], kind) for n, kind in (("ids", np.int64), ("named", np.bool_), ("lengths", np.int64), ("docs", np.int32), ("terms", np.int32), ("times", np.int32))}
                if block.size and block.size + len(arrays["ids"]) > BLOCK_DOCS:
                    yield out(block)
                    block = Block()
                block.add(**arrays)
        if block.size:
            yield out(block)

    packed = blocks.select("ids", "named", "lengths", "docs", "terms", "times")
    tasks = max(1, -(-shared.documents // BLOCK_DOCS))
    return packed.coalesce(tasks).mapInArrow(scored, "item bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    asked = items.select(F.col(item_key).cast("bigint").alias("id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    asked = saved(asked.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int")), "search-items")
    found = None
    for n in range(groups):
        group = sorted(((r["id"], r["text"]) for r in asked.where(F.col("part") == n).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        one = one_pass(docs, group, k, key, text).withColumn("part", F.lit(n))
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
