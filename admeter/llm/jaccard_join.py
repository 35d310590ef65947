"""N-gram Jaccard join: documents whose sets of word shingles are alike, by signature trees.

A document's set holds its distinct shingles of ``k`` words, A-Z in lower case (with fewer words, the whole sequence as
one).  Two documents link when ``100 |both| >= percent |either|``.  The result is exact up to hashes: 64 bits of a shingle, 61 of a
text, 128 of a set.

1. A fixed share of all shingles, chosen by their hash, is counted over all texts.  A document that links to another
   misses at most ``(100 - percent) %`` of its own shingles there, so if more than that of its counted shingles
   stand in no other text, it has no partner and is done.
2. Of the documents left, those with equal sets become one.  The shingles of a set are dealt by their hash into so many parts that
   two linked sets of its size differ in one shingle at most in some part; each part into ``PIECES``, and a part without one of
   its pieces is a key, which the two then have in common.  As a key stands for several shingles, sets that share a
   passage but not most of the text seldom meet.  Star edges from these keys give groups that contain all links.
3. In each group a signature tree is traversed against itself.  Groups too large for a task are cut into blocks with
   a few members that all blocks have; then what is not connected to a group's largest part meets all sets of its group that are
   of about its size.  For that the sets of a size class are cut into parts, and each two parts meet in a task.
4. Components of the links; equal sets share theirs.

No pairs are listed within a group: a tree gives the links that connect it, one less than its sets at most.

Fixed meaning of edge cases: null and empty texts, and texts without words, have empty sets and link with nothing; rows
that share an id are one document for the components; rows without an id get no component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, Words, as_bytes, mixed, repeats, saved, signed, small_batches
from .components import HOT, components, in_parts, part_of
from .signature_tree import links
from .substring_dedup import disguised, gathered

#: Shingles of a document that are counted in step 1: the first at least, in the mean, and a share of (4/3) of what it may miss.
SAMPLED = 48
#: Tokens of the sets in one task of step 3, and members that all blocks of a large group have.
TASK_TOKENS, PIVOTS = 1 << 20, 32
#: Tokens that a set counts for at least when a class is cut into parts: a task has so few small sets.
PART_LEAST = 64
#: Pieces of a part of a set.
PIECES = 4

_hashes = WordHashes()


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words([t.lower() if t else t for t in texts], _hashes)  # bytes: only A-Z change
    whole = words.windows(k)
    sets = []
    for start, n in zip(words.start.tolist(), words.count.tolist()):
        if n >= k:
            sets.append(np.unique(whole[start:start + n - k + 1]))
        elif n:
            sets.append(np.array([xxhash.xxh3_64_intdigest(words.hash[start:start + n].tobytes(), seed=n)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def missable(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` that a linked set may lack."""
    return n * (100 - percent) // 100


def sample_limit(n: int, percent: int) -> int:
    """Hashes up to this are counted for a set of ``n``; it never grows with ``n``."""
    share = min(1.0, max(SAMPLED / max(n, 1), (100 - percent) / 100 * 4 / 3))
    return min(2 ** 64 - 1, int(share * 2 ** 64))


def shared_counts(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(row, shared): per text, how many of its counted shingles other texts have.

    As in ``substring_dedup``, what two texts of a task share is settled there.
    """
    def arrays(batch: pa.RecordBatch) -> tuple:
        row, tokens, labels = batch.column(0).to_numpy(), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for r, s in zip(row, shingle_sets(as_bytes(batch.column(1)), k)):
            sent = s[s <= np.uint64(sample_limit(len(s), percent))]
            counts = sent <= np.uint64(sample_limit(len(s) * 100 // percent, percent))  # what its largest partner sends too
            tokens.append(sent)
            labels.append(r << np.int64(3) | counts.astype(np.int64) << np.int64(2))
        return np.concatenate(tokens), np.concatenate(labels)

    def rows(token: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((label, token))
        token, label = token[order], label[order]
        new = np.append(True, (token[1:] != token[:-1]) | (label[1:] != label[:-1]))
        token, label = token[new], label[new]  # copies of a text say it once
        one, many, more = repeats(token)
        yield pa.RecordBatch.from_arrays([signed(token[one]), signed(label[one] | many)], ["token", "label"])
        yield pa.RecordBatch.from_arrays([signed(disguised(token[more], label[more])), signed(label[more] | 3)], ["token", "label"])

    sent = docs.select("row", "text").mapInArrow(lambda b: gathered(b, arrays, rows), "token bigint, label bigint")
    label = F.col("label")
    dealt = sent.repartition("token").withColumns({
        "row": F.shiftright(label, 3), "counts": label.bitwiseAND(4), "sure": label.bitwiseAND(2) > 0, "many": label.bitwiseAND(1)})
    equal = Window.partitionBy("token")
    seen = dealt.withColumns({"low": F.min("row").over(equal), "high": F.max("row").over(equal), "any": F.max("many").over(equal)})
    return seen.where("counts > 0 AND (sure OR any = 1 OR low <> high)").groupBy("row").agg(F.count(F.lit(1)).alias("shared"))


def document_sets(docs: DataFrame, shared: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, low, high, tokens): size and 128-bit hash of each set; its shingles if it may have a partner."""
    joined = docs.join(shared, "row", "left").select("id", "text", F.coalesce("shared", F.lit(0)).alias("shared"))
    schema = "id bigint, n bigint, low bigint, high bigint, tokens binary"

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, low, high, tokens = [], [], [], []
            for s, found in zip(shingle_sets(as_bytes(batch.column(1)), k), batch.column(2).to_pylist()):
                counted = int((s <= np.uint64(sample_limit(len(s) * 100 // percent, percent))).sum())
                data = s.tobytes()
                a, b = np.frombuffer(xxhash.xxh3_128_digest(data), np.int64)
                n.append(len(s))
                low.append(int(a))
                high.append(int(b))
                tokens.append(data if len(s) and found >= counted - missable(len(s), percent) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, low, high)), pa.array(tokens, pa.binary())], ["id", "n", "low", "high", "tokens"])

    return saved(joined.mapInArrow(build, schema), "jaccard-sets")


@cache
def size_classes(percent: int) -> list[int]:
    """Least sizes of classes; sets that link are of one class or of two that follow each other."""
    sizes = [1]
    while sizes[-1] < 1 << 40:
        sizes.append(sizes[-1] * 100 // percent + 1)
    return sizes


def parts_for(sizes: list[int], smaller: int, percent: int) -> tuple[int, int]:
    """Parts for links whose smaller set is of a class, and in how many of these linked sets differ in one shingle at most; (0, 0) if only equal
    sets link."""
    differing = (sizes[smaller + 1] - 1) * (100 - percent) // percent
    parts = (differing // 2 + 1) * 11 // 10 if differing else 0
    return parts, parts - differing // 2 if differing else 0


def keys_of(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set, such that two different sets that link have one in common.

    A key that stands for no shingle is common to many sets.  It is sent only by sets in which so many parts have such keys that
    all parts nearly alike in another set may be among them.
    """
    sizes = size_classes(percent)
    own = bisect_right(sizes, len(tokens)) - 1
    out = [np.empty(0, np.uint64)]
    for smaller in range(max(own - 1, 0), own + 1):
        parts, alike = parts_for(sizes, smaller, percent)
        if not parts:
            continue
        seed = np.uint64((2 * smaller + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        spread = mixed(tokens + seed)
        place = (spread % np.uint64(parts * PIECES)).astype(np.int64)
        total, count = np.zeros(parts * PIECES, np.uint64), np.bincount(place, minlength=parts * PIECES).reshape(parts, PIECES)
        np.add.at(total, place, mixed(spread ^ seed))
        total = total.reshape(parts, PIECES)
        rest, filled = total.sum(axis=1, keepdims=True) - total, count.sum(axis=1, keepdims=True) > count
        key = mixed(mixed(rest.ravel() + np.arange(parts * PIECES, dtype=np.uint64)) + seed)
        out.append(key if (~filled.all(axis=1)).sum() >= alike else key[filled.ravel()])
    return np.concatenate(out)


def set_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(id, key): the keys of sets (id, tokens)."""
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(np.frombuffer(t, np.uint64), percent) for t in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(ids), signed(np.concatenate([np.empty(0, np.uint64), *keys]))], ["id", "key"])

    return sets.select("id", "tokens").mapInArrow(explode, "id bigint, key bigint")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, a, sets): keys that several sets have, the smallest of them and their number."""
    return keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count(F.lit(1)).alias("sets")).where("a <> last").drop("last")


def candidate_groups(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, component): groups of sets that contain all links.

    The smallest set of a key is its centre; keys of many sets are joined in parts.  A set goes to the least of its centres, and the others of them go there too, once
    for all sets, so that near copies with many keys don't each have an edge for every centre.
    """
    parts = F.ceil(F.col("sets") / HOT).cast("int")
    hot = shared.where(F.col("sets") > HOT).select("key", parts.alias("parts"))  # one for HOT rows of keys at most
    dealt = keys.join(F.broadcast(hot), "key", "left").withColumn("part", part_of(F.col("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    centres = in_parts(shared.select("key", "a", parts.alias("parts")), F.col("parts")).drop("parts")
    stars = dealt.join(centres, ["key", "part"]).where("id <> a").select("id", "a").distinct()
    near = stars.withColumn("least", F.min("a").over(Window.partitionBy("id")))
    edges = near.select(F.col("least").alias("a"), F.col("id").alias("b")).union(near.where("a <> least").select("least", "a"))
    return components(edges.distinct())


def linked(groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of sets (g, part, side, node, label, tokens): one tree per (g, part), or one per side; a part may hold several groups ``component``."""
    def find(table: pa.Table) -> pa.Table:
        held: dict[int, list[int]] = {}
        for i, c in enumerate(table["component"].to_pylist()):
            held.setdefault(c, []).append(i)
        node, label, side, tokens = (table[c].to_pylist() for c in ("node", "label", "side", "tokens"))
        a, b = [], []
        for members in held.values():
            if len(members) > 1:
                sets = [np.frombuffer(tokens[i], np.uint64) for i in members]
                for x, y in links(sets, percent, [label[i] for i in members], [side[i] for i in members]):
                    a.append(node[members[x]])
                    b.append(node[members[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return saved(groups.groupBy("g", "part").applyInArrow(find, "a bigint, b bigint"), "jaccard-links")


def all_links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the links of all sets (id, n, tokens)."""
    with Scratch(sets.sparkSession) as scratch:
        keys = saved(set_keys(sets, percent), "jaccard-keys")
        shared = saved(shared_keys(keys), "jaccard-shared-keys")
        groups = candidate_groups(keys, shared)
        members = scratch.kept(sets.join(groups, sets.id == groups.node).select("node", "component", "n", "tokens"), "jaccard-members")
    sizes = members.groupBy("component").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members"))
    parts = max(1, -(-(sizes.agg(F.sum("total")).first()[0] or 0) // TASK_TOKENS))
    large = saved(sizes.where(F.col("total") > 2 * TASK_TOKENS).select(
        "component", F.ceil(F.col("total") / TASK_TOKENS).cast("int").alias("blocks"), "members"), "jaccard-large")
    number = F.abs(F.xxhash64("node") % 1_000_003)
    held = ["component", F.lit(0).alias("side"), "node", F.col("node").alias("label"), "tokens"]
    small = members.join(large, "component", "left_anti").select(
        F.lit(-1).cast("bigint").alias("g"), F.pmod(F.xxhash64("component"), F.lit(parts)).alias("part"), *held)
    split = members.join(large, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<bigint>")
    pivot = F.pmod(number, F.col("members")) < PIVOTS
    blocks = split.withColumn("part", F.explode(F.when(pivot, everywhere).otherwise(F.array("own"))))
    edges = linked(small.union(blocks.select(F.col("component").alias("g"), "part", *held)), percent)
    found = components(edges)
    if large.isEmpty():
        return found
    # what the blocks left apart: every set outside the largest part of its group
    state = saved(split.join(found.select("node", F.col("component").alias("label")), "node", "left").select(
        "node", "component", "n", "tokens", F.coalesce("label", "node").alias("label")), "jaccard-state")
    counts = state.groupBy("component", "label").agg(F.count(F.lit(1)).alias("size"))
    main = counts.groupBy("component").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    if state.join(main, "component").where("label <> main").isEmpty():
        return found
    return components(edges.union(linked(meetings(state.join(main, "component"), percent), percent)))


def meetings(state: DataFrame, percent: int) -> DataFrame:
    """(g, part, component, side, node, label, tokens): tasks in which every set outside the main part of its group meets all sets that it may link with.

    Sets that link are of one size class or of two that follow each other.  In a group, the sets of a class that are outside are cut into
    parts, and so are those of the main part; each two parts of such classes meet in a task if one of them is outside.  So a set goes to
    as many tasks as its class and the two next to it have parts, however many keys it shares.
    """
    least = size_classes(percent)[:256]
    klass = F.size(F.filter(F.array(*[F.lit(x) for x in least]), lambda x: x <= F.col("n"))) - 1
    sets = state.withColumns({"class": klass, "out": F.col("label") != F.col("main")})
    needed = lambda of: F.ceil(F.sum(F.when(of, F.greatest("n", F.lit(PART_LEAST))).otherwise(0)) / (2 * TASK_TOKENS)).cast("int")
    parts = saved(sets.groupBy("component", "class").agg(needed(F.col("out")).alias("outs"), needed(~F.col("out")).alias("mains")), "jaccard-parts")
    near = parts
    for name, step in (("next", 1), ("last", -1)):
        of = parts.select("component", (F.col("class") - step).alias("class"), F.struct("outs", (F.col("outs") + F.col("mains")).alias("all")).alias(name))
        near = near.join(of, ["component", "class"], "left")
    own = F.when(F.col("out"), part_of(F.col("node"), F.col("outs"))).otherwise(F.col("outs") + part_of(F.col("node"), F.col("mains")))

    def met(total: Column, outs: Column, task) -> Column:
        """A task for each of a class's parts that a set's part meets; none if there is no such class."""
        there = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(there, lambda j: F.col("out") | (j < outs)), task)

    def task(low: Column, up: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(low.alias("low"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), side.alias("side"))

    k, p = F.col("class"), F.col("own")
    tasks = F.concat(met(F.col("outs") + F.col("mains"), F.col("outs"), lambda j: task(k, 0, F.least(p, j), F.greatest(p, j), (p > j).cast("int"))),
                     met(F.col("next.all"), F.col("next.outs"), lambda j: task(k, 1, p, j, F.lit(0))),
                     met(F.col("last.all"), F.col("last.outs"), lambda j: task(k - 1, 1, j, p, F.lit(1))))
    dealt = sets.join(near, ["component", "class"]).withColumn("own", own).withColumn("task", F.explode(tasks))
    return dealt.select(F.lit(-2).cast("bigint").alias("g"), F.xxhash64("component", "task.low", "task.up", "task.i", "task.j").alias("part"),
                        "component", F.col("task.side").alias("side"), "node", "label", "tokens")


def join(df: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, ``n_shingles`` and ``component_id``, the smallest key reachable by links."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("row", F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 3))
    sets = document_sets(docs, saved(shared_counts(docs, k, percent), "jaccard-shared"), k, percent)
    full = sets.where("n > 0 AND id IS NOT NULL")
    with Scratch(df.sparkSession) as scratch:  # keys and groups take more room than what comes of them
        same = saved(full.groupBy("low", "high").agg(F.min("id").alias("node")), "jaccard-same")
        one = full.where("tokens IS NOT NULL").join(same, ["low", "high"]).where("id = node").dropDuplicates(["id", "low", "high"]).select("id", "n", "tokens")
        one = saved(one, "jaccard-one")
        found = all_links(one, percent)
        named = scratch.kept(same.join(found, "node", "left").select("low", "high", F.coalesce("component", "node").alias("component_id")), "jaccard-components")
    linkable = F.col("n") > 0
    result = sets.select("id", "n", "low", "high").join(named, ["low", "high"], "left")
    return result.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                         F.when(linkable & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def deduplicated(df: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without those whose component has a smaller key; rows without a key stay."""
    found = join(df, k, percent, key, text)
    gone = saved(found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_gone")).distinct(), "jaccard-gone")
    return df.join(gone, df[key] == F.col("_gone"), "left_anti")
