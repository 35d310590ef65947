"""Removal of word sequences that stand twice or more in the corpus, by difference-cover anchors.

A window is ``size`` words of one text.  Every word covered by a window whose words also start anywhere else is removed.

1. Anchors: windows of ``size - period + 1`` words, hashed only at places whose remainder modulo the period is in a
   difference cover.  For any two places there is an offset below the period that takes both to cover places, so two
   equal windows always share an anchor at the same offset, though a quarter of the places are hashed.
2. Extension: windows around an anchor that is found twice are hashed whole (96 bits) and counted.
3. The windows found twice cover the words to remove.

What is found twice within a task is settled there, and one row stands for it in the shuffle; so a passage that a third
of all texts share sends one row per task, and no task gathers its places.  Rows carry a 62-bit hash of their text, which
copies share; what comes back per text is bounded by the text.  The texts themselves are shuffled once.

Fixed meaning of edge cases: a null text has no words; texts shorter than a window lose nothing; two equal rows are two
texts, and remove each other's windows; words are cut at ASCII white space and compared unchanged; an empty table
gives an empty result; input columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, Words, as_bytes, mixed, packed, repeats, signed, small_batches, unpacked

WINDOW = 35
#: Perfect difference covers: each remainder is a difference of two members.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
#: Anchors have at least so many words, or two thirds of a window.
ANCHOR_WORDS = 15
#: Hashes that a task gathers before it sends them on.
GATHERED = 1 << 20

_hashes = WordHashes()


def period_for(size: int) -> int:
    """The longest period that leaves anchors long enough."""
    return max([p for p in COVERS if size - p + 1 >= min(ANCHOR_WORDS, -(-2 * size // 3))], default=1)


def anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in all words of the batch) and hashes of the anchors."""
    period = period_for(size)
    length = size - period + 1
    found = words.windows(length)
    on = np.zeros(period, bool)
    on[list(COVERS.get(period, (0,)))] = True
    at = np.flatnonzero(on[words.place[:len(found)] % period] & (words.left[:len(found)] >= length))
    return at, found[at]


def gathered(batches: Iterable[pa.RecordBatch], arrays: Callable, rows: Callable) -> Iterator[pa.RecordBatch]:
    """Collect the arrays of batches, and turn them into rows whenever enough have come together."""
    held: list[tuple] = []
    for batch in batches:
        found = arrays(batch)
        if len(found[0]):
            held.append(found)
        if sum(len(x[0]) for x in held) >= GATHERED:
            yield from rows(*map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield from rows(*map(np.concatenate, zip(*held)))


def labelled(row: np.ndarray, many: np.ndarray | bool, sure: bool) -> np.ndarray:
    """The number of a text with two flags: found again within the task; settled there."""
    return row << np.int64(2) | np.int64(2 * sure) | np.asarray(many, np.int64)


def again(sent: DataFrame, *order: Column) -> DataFrame:
    """The rows whose hash (and what ``order`` says) other rows have too, or that a task has settled, with their flags."""
    # the explicit repartition keeps what is computed from the packed columns out of the shuffle
    dealt = sent.repartition("hash").withColumns({"many": F.col("label").bitwiseAND(1), "sure": F.col("label").bitwiseAND(2) > 0, "row": F.shiftright("label", 2)})
    equal = Window.partitionBy("hash")
    if order:
        equal = equal.orderBy(*order).rangeBetween(Window.currentRow, Window.currentRow)
    return dealt.withColumns({"n": F.count(F.lit(1)).over(equal), "any": F.max("many").over(equal)}).where("sure OR any = 1 OR n > 1")


def shared_anchors(docs: DataFrame, size: int, text: str) -> DataFrame:
    """(row, own, others): per text, the hashes of its anchors that stand elsewhere.

    ``others`` were found again within a task; so as not to meet in one place, they are sent disguised by the number of their text.
    """
    def arrays(batch: pa.RecordBatch) -> tuple:
        words = Words(as_bytes(batch.column(1)), _hashes)
        at, found = anchors(words, size)
        return found, batch.column(0).to_numpy()[words.text[at]]

    def rows(found: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, many, more = repeats(found)
        more = more[np.unique(np.stack([found[more].view(np.int64), row[more]]), axis=1, return_index=True)[1]]  # copies of a text say it once
        yield pa.RecordBatch.from_arrays([signed(found[one]), signed(labelled(row[one], many, False))], ["hash", "label"])
        yield pa.RecordBatch.from_arrays([signed(disguised(found[more], row[more])), signed(labelled(row[more], True, True))], ["hash", "label"])

    sent = docs.select("row", text).mapInArrow(lambda b: gathered(b, arrays, rows), "hash bigint, label bigint")
    return again(sent).groupBy("row").agg(
        F.collect_list(F.when(~F.col("sure"), F.col("hash"))).alias("own"), F.collect_list(F.when(F.col("sure"), F.col("hash"))).alias("others"))


def disguised(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Its own inverse."""
    return value ^ mixed(row.astype(np.uint64))


def windows_near(place: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Places of the windows that hold an anchor at one of the given places, at an offset below the period."""
    edge = np.zeros(n_words + 1, np.int32)
    first, last = np.maximum(place - period_for(size) + 1, 0), np.minimum(place, n_words - size)
    some = last >= first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some] + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def repeated_windows(docs: DataFrame, size: int, text: str) -> DataFrame:
    """(row, spans): per text, runs of windows that also start elsewhere, as place + 2**32 length."""
    near = docs.join(shared_anchors(docs, size, text), "row")
    at_column = {n: near.columns.index(n) for n in ("row", text, "own", "others")}

    def arrays(batch: pa.RecordBatch) -> tuple:
        row = batch.column(at_column["row"]).to_numpy()
        own, others = batch.column(at_column["own"]), batch.column(at_column["others"])
        words = Words(as_bytes(batch.column(at_column[text])), _hashes)
        at, found = anchors(words, size)
        borders = np.searchsorted(at, np.append(words.start, len(words.hash)))
        picked = [np.empty(0, np.int64)]
        for i in np.flatnonzero(words.count >= size).tolist():
            lists = [np.array(x[i].values, np.int64).view(np.uint64) for x in (own, others)]
            known = np.append(lists[0], disguised(lists[1], row[i:i + 1]))
            mine = slice(borders[i], borders[i + 1])
            place = at[mine][np.isin(found[mine], known)] - words.start[i]
            picked.append(words.start[i] + windows_near(place, int(words.count[i]), size))
        where = np.concatenate(picked)
        if not len(where):
            return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        second = (words.windows(size, 0xC2B2AE3D27D4EB4F)[where] >> np.uint64(33)).astype(np.int64)
        return words.windows(size)[where], second, row[words.text[where]], words.place[where]

    def rows(first: np.ndarray, second: np.ndarray, row: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, many, more = repeats(first, second)
        yield table(first[one], labelled(row[one], many, False), second[one] << 32 | place[one])
        more = more[np.lexsort((place[more], row[more]))]  # runs of places that need no word from other tasks
        if len(more):
            new = np.append(True, (row[more][1:] != row[more][:-1]) | (place[more][1:] - place[more][:-1] > 1))
            start, end = more[new], more[np.append(np.flatnonzero(new)[1:], len(more)) - 1]
            length = place[end] - place[start] + 1
            yield table(disguised(first[start], row[start] + place[start]), labelled(row[start], True, True), length << 32 | place[start])

    def table(first: np.ndarray, label: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([signed(first), signed(label), signed(at)], ["hash", "label", "at"])

    sent = near.mapInArrow(lambda b: gathered(b, arrays, rows), "hash bigint, label bigint, at bigint")
    place = F.col("at").bitwiseAND(2 ** 32 - 1)
    span = F.when(F.col("sure"), F.col("at")).otherwise(place.bitwiseOR(2 ** 32))
    return again(sent, F.shiftright("at", 32)).groupBy("row").agg(F.collect_list(span).alias("spans"))


def covered(spans: pa.Scalar, n_words: int, size: int) -> np.ndarray:
    """Which of the words the windows cover."""
    edge = np.zeros(n_words + 1, np.int32)
    if spans.is_valid:
        span = np.array(spans.values, np.int64)
        place = span & (2 ** 32 - 1)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + (span >> 32) + size - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def joined(df: DataFrame, size: int, text: str) -> DataFrame:
    """Each text with its spans.  Both joins inside read the same columns, so that the texts' shuffle is reused."""
    small_batches(df.sparkSession)
    docs = df.withColumn("row", F.shiftright(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2))
    return docs.join(repeated_windows(docs, size, text), "row", "left")


def digests(df: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, ``n_words``, ``n_removed`` and the sha256 of the kept words joined by a space."""
    found = joined(df.select(F.col(key), F.col(text).cast("string").alias(text)), size, text)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for t, spans in zip(as_bytes(batch.column(1)), batch.column(2)):
                words = (t or b"").split()
                gone = covered(spans, len(words), size)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                [key, "n_words", "n_removed", "kept_sha256"])

    kind = dict(df.select(key).dtypes)[key]
    return found.select(key, text, "spans").mapInArrow(digest, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the words that are gone; white space before a kept word stays."""
    words, parts, at, skipped = text.split(), [], 0, False
    for word, removed in zip(words, gone.tolist()):
        start = text.index(word, at)
        end = start + len(word)
        if not removed:
            parts.append(text[at if parts else start if skipped else 0:end])
        skipped |= removed
        at = end
    parts.append(b"" if not parts else text[at:])
    return b"".join(parts)


def removed(df: DataFrame, size: int = WINDOW, text: str = "text") -> DataFrame:
    """``df`` with repeated windows cut out of its texts; texts without any stay as they are."""
    found = joined(packed(df, text), size, "_text")

    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(as_bytes(texts), spans):
            gone = covered(s, len((t or b"").split()), size) if s.is_valid else None
            out.append(t if gone is None or not gone.any() else cut(t, gone))
        return pa.array(out, pa.binary()).cast(pa.string())

    return unpacked(found, df.columns, text, kept("_text", "spans"))
