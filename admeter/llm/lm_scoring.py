"""Cross-entropy difference of two matched language models.

The target model is trained on the target texts, the background model on all texts.  They share one vocabulary (every
word of all texts), one set of bigrams (every pair that follows each other) and one smoothing:
``p(w | v) = MIX c(v, w) / c(v) + (1 - MIX) p(w)``, or ``p(w)`` where the model knows nothing after ``v``, and ``p(w)`` a
smoothed share of ``w`` alone.  A text is scored by what the other texts say: its own counts are taken out of both models first, so
that no text is expected because it was counted.  Its score is the mean over its words of background loss less target loss,
in nats: the higher, the closer to the target.

No word or bigram is left out, and no model is collected or broadcast; the counts stay in tables that grow with the texts:

1. ``blocks`` cuts the texts into blocks of some ``BLOCK_WORDS`` words: the different words of a block, as 64-bit hashes, and
   each text as numbers of them.
2. ``asked`` counts the words and bigrams of a block, also within target texts, and sends them to ranges of their hashes,
   ``RANGES`` at most for a block.  A word or bigram is one entry for each block, however often it stands there, so none is hot.
3. ``exchanged`` sums each range and sends the sums back to the blocks that asked, in the order in which they asked.  Where more
   than ``MERGED`` blocks ask, groups of them are summed first, and ask as one for ``RANGES`` narrower ranges each, and
   so on: neither the rows of a block nor what a task holds grow with the texts.
4. ``scored`` puts the sums of a block together and takes the mean of both losses over each of its texts.

Words are compared by 64-bit hashes, bigrams by a 64-bit hash of both words' hashes.

Fixed meaning of edge cases: null texts, and texts without words, have no tokens, null losses and a null score; a key
with several labels is a target if one of them says so; without (other) target texts the target model is uniform; repeated
rows count and are scored each, so a copy is expected from its copies; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, mixed, saved, small_batches

#: Share of a bigram's own estimate, and pseudo-count of a word.
MIX, PSEUDO = 0.7, 0.1
#: Words and texts after which a block ends, and words for each range of hashes.  They change no result.
BLOCK_WORDS, BLOCK_TEXTS, RANGE_WORDS = 3 << 19, 1 << 16, 1 << 20
#: Ranges of hashes that one block or group of blocks sends rows to, at most, and blocks that are summed at once.
RANGES, MERGED = 1 << 12, 1 << 10
#: Stands before the first word of a text; no word holds a space.
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))
WORDS, BIGRAMS, TEXTS, TARGETS = 0, 1, 2, 3


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as compressed planes of bytes after their width and count."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    planes = np.ascontiguousarray(x.ravel().astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return struct.pack("<BQ", kind.itemsize, x.size) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width, size = struct.unpack_from("<BQ", raw)
    planes = pa.decompress(raw[9:], decompressed_size=width * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).view(f"u{width}").ravel()


def blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, keys, lengths, ids, words, size) of ``docs`` (key, text): the texts' keys and lengths, their words as numbers, the different words,
    and how many words stand there."""
    key = docs.schema[0].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        texts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            start = 0
            for i, text in enumerate(as_bytes(batch.column(1)), 1):
                texts.append(hashes.of((text or b"").lower()))
                size += len(texts[-1])
                if size >= BLOCK_WORDS or len(texts) >= BLOCK_TEXTS:
                    yield row(number, [*keys, batch.column(0).slice(start, i - start)], texts)
                    number, keys, texts, size, start = number + 1, [], [], 0, i
            keys.append(batch.column(0).slice(start))
        if texts:
            yield row(number, keys, texts)

    def row(number: int, keys: list[pa.Array], texts: list[np.ndarray]) -> pa.RecordBatch:
        words, ids, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get low numbers, which take less room
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        each = pa.concat_arrays(keys)
        binaries = [packed(np.array([len(t) for t in texts])), packed(rank[ids]), packed(words[order])]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each), *[pa.array([x], pa.binary()) for x in binaries], pa.array([len(ids)], pa.int64())],
            ["block", "keys", "lengths", "ids", "words", "size"])

    return docs.mapInArrow(cut, f"block bigint, keys array<{key}>, lengths binary, ids binary, words binary, size bigint")


class Block:
    """The words and bigrams of a block: hashes of the different ones, and which stands where."""

    def __init__(self, lengths: bytes, ids: bytes, words: bytes):
        self.lengths, self.ids, known = unpacked(lengths).astype(np.int64), unpacked(ids).astype(np.int32), unpacked(words).astype(np.uint64)
        self.size = len(known)
        self.words = np.append(known, START)
        self.before = np.append(np.int32(self.size), self.ids[:-1])[:len(self.ids)]
        self.starts = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        self.before[self.starts] = self.size
        codes, self.at = np.unique(self.before.astype(np.int64) * max(1, self.size) + self.ids, return_inverse=True)
        self.first, self.second = np.divmod(codes, max(1, self.size))
        self.bigrams = mixed(mixed(self.words[self.first]) + self.words[self.second])

    def counts(self, among: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each word, how often it stands in all texts and in those ``among`` them, and how often before another; so for bigrams."""
        own = np.repeat(among, self.lengths)
        count = lambda x, size: [np.bincount(x, minlength=size), np.bincount(x[own], minlength=size)]
        return count(self.ids, self.size + 1) + count(self.before, self.size + 1), count(self.at, len(self.bigrams))


def bits_of(n: int) -> int:
    """Bits that number ``n`` ranges."""
    return max(0, int(n) - 1).bit_length()


def dealt(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """The range, by its leading ``bits``, of each run of sorted hashes, and the run."""
    each = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    first = np.flatnonzero(np.append(True, each[1:] != each[:-1])) if len(each) else np.empty(0, np.int64)
    return each[first].astype(np.int64), [slice(a, b) for a, b in zip(first, np.append(first[1:], len(each)))]


QUESTIONS = "bucket bigint, kind int, block bigint, hashes binary, counts binary"
ANSWERS = "block bigint, kind int, bucket bigint, counts binary, words bigint, n bigint, target_n bigint"


def question(kind: int, number: int, hashes: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of ``QUESTIONS``: sorted hashes and their counts, by ranges."""
    ranges, runs = dealt(hashes, bits)
    return pa.RecordBatch.from_arrays(
        [pa.array(ranges, pa.int64()), pa.array([kind] * len(runs), pa.int32()), pa.array([number] * len(runs), pa.int64()),
         pa.array([packed(np.diff(hashes[r], prepend=np.uint64(0))) for r in runs], pa.binary()), pa.array([packed(counts[:, r]) for r in runs], pa.binary())],
        [c.split()[0] for c in QUESTIONS.split(", ")])


def asked(state: DataFrame, bits: int) -> DataFrame:
    """``QUESTIONS`` of blocks and the places of their target texts."""
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, lengths, ids, words, targets = (c[r].as_py() for c in batch.columns)
                block = Block(lengths, ids, words)
                among = np.zeros(len(block.lengths), bool)
                among[targets or []] = True
                for kind, hashes, counts in zip((WORDS, BIGRAMS), (block.words, block.bigrams), block.counts(among)):
                    order = np.argsort(hashes, kind="stable")
                    yield question(kind, number, hashes[order], np.stack(counts)[:, order], bits)

    return state.select("block", "lengths", "ids", "words", "targets").mapInArrow(ask, QUESTIONS)


class Summed:
    """The different hashes of one kind that several blocks ask for, and the sums of their counts."""

    def __init__(self, table: pa.Table, kind: int):
        self.kind, rows = kind, 4 if kind == WORDS else 2
        part = table.filter(pa.array((k == kind for k in table["kind"].to_pylist()), pa.bool_()))
        self.blocks, self.buckets = part["block"].to_pylist(), part["bucket"].to_pylist()
        hashes = [np.cumsum(unpacked(h), dtype=np.uint64) for h in part["hashes"].to_pylist()]
        counts = [unpacked(c).reshape(rows, -1) for c in part["counts"].to_pylist()]
        self.hashes, self.at = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True)
        each = np.concatenate([np.empty((rows, 0), np.int64), *counts], axis=1)
        self.sums = np.stack([np.bincount(self.at, weights=n, minlength=len(self.hashes)) for n in each]).astype(np.int64)
        self.ends = np.cumsum([len(h) for h in hashes])
        self.sizes = [len(h) for h in hashes]

    def answers(self, sums: np.ndarray, totals: tuple[int, int, int]) -> Iterator[tuple]:
        """Rows of ``ANSWERS``, from sums by different hash; the first row has the totals."""
        for i, (block, bucket, end, size) in enumerate(zip(self.blocks, self.buckets, self.ends, self.sizes)):
            yield (block, self.kind, bucket, packed(sums[:, self.at[end - size:end]]), *(totals if i == 0 else (0, 0, 0)))


def answer_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in ANSWERS.split(", ")])


def answered(questions: DataFrame) -> DataFrame:
    """``ANSWERS``: the sums over all blocks of what each asked for, with the different words of a range and their count in all
    texts and in target texts."""
    def answer(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for kind in (WORDS, BIGRAMS):
            one = Summed(table, kind)
            totals = (int((one.hashes != START).sum()), int(one.sums[0].sum()), int(one.sums[1].sum())) if kind == WORDS else (0, 0, 0)
            rows += one.answers(one.sums, totals)
        return answer_table(rows)

    return questions.groupBy("bucket").applyInArrow(answer, ANSWERS)


def exchanged(questions: DataFrame, askers: int, bits: int, wanted: int) -> DataFrame:
    """``ANSWERS`` to questions by ranges of ``bits``, from so many blocks; sums are made in ranges of ``wanted`` bits where groups of blocks are summed first."""
    if askers <= MERGED:
        return answered(questions)
    groups, finer = -(-askers // MERGED), max(bits, min(wanted, bits + bits_of(RANGES)))
    dealt_out = questions.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        rows = [question(one.kind, part, one.hashes, one.sums, finer) for one in (Summed(table, WORDS), Summed(table, BIGRAMS))]
        return pa.Table.from_batches(rows)

    merged = saved(dealt_out.groupBy("part", "bucket").applyInArrow(merge, QUESTIONS), "lm-merged")
    above = saved(exchanged(merged, groups, finer, wanted), "lm-sums")

    def spread(table: pa.Table) -> pa.Table:
        own = table.filter(pa.array((h is not None for h in table["hashes"].to_pylist()), pa.bool_()))
        back = table.filter(pa.array((h is None for h in table["hashes"].to_pylist()), pa.bool_())).sort_by("fine")
        totals = tuple(sum(back[c].to_pylist()) for c in ("words", "n", "target_n"))
        rows: list[tuple] = []
        for kind in (WORDS, BIGRAMS):
            one = Summed(own, kind)
            counts = [unpacked(c).reshape(len(one.sums), -1) for k, c in zip(back["kind"].to_pylist(), back["counts"].to_pylist()) if k == kind]
            rows += one.answers(np.concatenate(counts, axis=1) if counts else one.sums, totals if kind == WORDS else (0, 0, 0))
        return answer_table(rows)

    sent = above.select(F.col("block").alias("part"), F.shiftright("bucket", finer - bits).alias("bucket"), F.col("bucket").alias("fine"), "kind", "counts", "words", "n", "target_n")
    nothing = F.lit(0).cast("bigint")
    own = dealt_out.select("part", "bucket", nothing.alias("fine"), "kind", "counts", nothing.alias("words"), nothing.alias("n"), nothing.alias("target_n"), "block", "hashes")
    both = own.unionByName(sent.withColumns({"block": F.lit(None).cast("bigint"), "hashes": F.lit(None).cast("binary")}))
    return both.groupBy("part", "bucket").applyInArrow(spread, ANSWERS)


def own_counts(text: np.ndarray, what: np.ndarray) -> np.ndarray:
    """At each place, how often its text holds what stands there."""
    _, at, times = np.unique(text * (int(what.max(initial=0)) + 1) + what, return_inverse=True, return_counts=True)
    return times[at]


def scored(state: DataFrame, targets: DataFrame, answers: DataFrame, blocks: int, key: str) -> DataFrame:
    """A row for each text of the blocks."""
    words, n, target_n = (x or 0 for x in answers.agg(F.sum("words"), F.sum("n"), F.sum("target_n")).first())
    kind = state.schema["keys"].dataType.elementType.simpleString()
    absent = {"bucket": "bigint", "keys": f"array<{kind}>", "counts": "binary", "ids": "binary", "words": "binary", "targets": "array<int>"}

    def row(df: DataFrame, kind: Column, **columns: Column) -> DataFrame:
        return df.select("block", kind.cast("int").alias("kind"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in absent.items()])

    rows = row(state, F.lit(TEXTS), keys=F.col("keys"), counts=F.col("lengths"), ids=F.col("ids"), words=F.col("words")).unionByName(
        row(answers, F.col("kind"), bucket=F.col("bucket"), counts=F.col("counts"))).unionByName(row(targets, F.lit(TARGETS), targets=F.col("targets")))

    def finish(table: pa.Table) -> pa.Table:
        kinds, bucket, raw = (table[c].to_pylist() for c in ("kind", "bucket", "counts"))
        at = kinds.index(TEXTS)
        block = Block(raw[at], table["ids"][at].as_py(), table["words"][at].as_py())

        def sums(kind: int, hashes: np.ndarray, height: int) -> np.ndarray:
            parts = [i for _, i in sorted((bucket[i], i) for i, k in enumerate(kinds) if k == kind)]
            out = np.zeros((height, len(hashes)), np.int64)
            out[:, np.argsort(hashes, kind="stable")] = np.concatenate([unpacked(raw[i]).reshape(height, -1) for i in parts] or [out], axis=1)
            return out

        alone, pairs = sums(WORDS, block.words, 4), sums(BIGRAMS, block.bigrams, 2)
        tokens = block.lengths
        target = np.zeros(len(tokens), bool)
        target[[i for r, k in enumerate(kinds) if k == TARGETS for i in table["targets"][r].as_py()]] = True
        text = np.repeat(np.arange(len(tokens)), tokens)
        own_word, own_before, own_pair = (own_counts(text, x) for x in (block.ids, block.before, block.at))
        losses = np.full((2, len(tokens)), np.nan)
        for i, (total, counted) in enumerate(((n, np.ones(len(text), bool)), (target_n, target[text]))):
            context = alone[2 + i, block.before] - own_before * counted
            share = np.divide(MIX * (pairs[i, block.at] - own_pair * counted), context, out=np.zeros(len(context)), where=context > 0)
            left = np.where(context > 0, 1 - MIX, 1.0)
            rest = total - tokens[text] * counted
            loss = -np.log(share + left * (alone[i, block.ids] - own_word * counted + PSEUDO) / (rest + PSEUDO * words))
            if len(block.starts):
                losses[i, tokens > 0] = np.add.reduceat(loss, block.starts) / tokens[tokens > 0]
        none = tokens == 0
        columns = [pa.array(x, pa.float64(), mask=none) for x in (*losses, losses[0] - losses[1])]
        keys = table["keys"].chunk(0) if table["keys"].num_chunks == 1 else pa.concat_arrays(table["keys"].chunks)
        return pa.table([keys[at].values, pa.array(tokens), *columns], [key, "n_tokens", "background_loss", "target_loss", "score"])

    # by ranges of their numbers, tasks get equal shares of blocks
    tasks = max(1, -(-blocks // 2), min(blocks, int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartitionByRange(tasks, "block").groupBy("block").applyInArrow(
        finish, f"`{key}` {kind}, n_tokens bigint, background_loss double, target_loss double, score double")


def score(df: DataFrame, labels: DataFrame, target: str = "quality = 1 AND toxic = 0", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, ``n_tokens``, ``background_loss``, ``target_loss`` and ``score``.

    Target texts are those that ``labels`` (key and labels) names by the condition ``target``.
    """
    spark = df.sparkSession
    small_batches(spark)
    state = saved(blocks(df.select(F.col(key), F.col(text).cast("string").alias("text"))), "lm-blocks")
    total, askers = (x or 0 for x in state.agg(F.sum("size"), F.count(F.lit(1))).first())
    wanted = bits_of(max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_WORDS))
    bits = min(wanted, bits_of(RANGES))
    good = labels.where(target).select(F.col(key).alias("_key")).distinct()
    places = state.select("block", F.posexplode("keys").alias("place", "_own"))
    # labels grow with the texts, so they are never broadcast
    targets = places.join(good.hint("merge"), F.col("_own") == F.col("_key"), "left_semi").groupBy("block").agg(F.collect_list("place").alias("targets"))
    targets = saved(targets, "lm-targets")
    questions = asked(state.join(targets, "block", "left"), bits)
    if askers > MERGED:
        questions = saved(questions, "lm-questions")
    answers = saved(exchanged(questions, askers, bits, wanted), "lm-counts")
    return scored(state, targets, answers, askers, key)
