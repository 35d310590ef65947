"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables."""

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from admeter.llm import (byte_bpe, jaccard_join, license_scan, lm_scoring, mixing, packed_ids, quality_rules,
                         substring_dedup, top_k, signature_tree)
from admeter.llm.common import CLEANED, saved

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    docs = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(40)]
    docs += [" ".join([*(word() for _ in range(20)), *passage, *(word() for _ in range(9))]) for _ in range(6)]
    base = [word() for _ in range(300)]
    for _ in range(12):  # near copies
        copy = list(base)
        for at in rng.sample(range(300), rng.randint(0, 6)):
            copy[at] = word()
        docs.append(" ".join(copy))
    docs += [None, "", "  \n ", "one", "one", "One", "two words", "x " * 30_000, " ".join(base), "é Ünï\n\nçode \x0b end"]
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}" if i % 5 else None, 0, 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, texts, nothing):
    size = 35
    words = {i: split(t) for i, t in texts}
    count = Counter(tuple(w[p:p + size]) for w in words.values() for p in range(len(w) - size + 1))
    for row in substring_dedup.digests(docs).collect():
        w = words[row.doc_id]
        gone = {q for p in range(len(w) - size + 1) if count[tuple(w[p:p + size])] > 1 for q in range(p, p + size)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert (row.n_words, row.n_removed, row.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    cut = substring_dedup.removed(docs)
    assert "doc_id" in cut.columns and {r.doc_id for r in cut.collect()} == set(words)
    assert next(r.text for r in cut.collect() if r.doc_id == 58) is None
    assert substring_dedup.digests(nothing).count() == 0


@pytest.mark.parametrize("tokens", [1 << 20, 200])
def test_jaccard_join(docs, texts, nothing, tokens, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TASK_TOKENS", tokens)
    sets = {}
    for i, t in texts:
        w = [x.lower() for x in split(t)]
        sets[i] = {tuple(w[p:p + 4]) for p in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if tokens:
            break
    again = True
    while again:
        again = False
        for a in sets:
            if label[label[a]] != label[a]:
                label[a], again = label[label[a]], True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, 4, 85).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    if tokens > 200:
        assert jaccard_join.join(nothing, 4, 85).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_jaccard_keys(percent):
    """Two sets that link share a key, whatever their sizes; sets with a tenth of their shingles in common hardly do."""
    rng = np.random.default_rng(percent)
    fresh = lambda n: rng.integers(0, 2 ** 63, n, dtype=np.uint64)
    keys = lambda s: set(jaccard_join.keys_of(np.unique(s), percent).tolist())
    linked = apart = 0
    for _ in range(600):
        n = int(rng.choice([1, 2, 3, 5, 8, 13, 30, 90, 250]))
        both, a, b = fresh(n), fresh(rng.integers(0, n + 1)), fresh(rng.integers(0, n + 1))
        a, b = a[:rng.integers(0, len(a) + 1) // 3], b[:rng.integers(0, len(b) + 1) // 3]
        if len(a) + len(b) and 100 * n >= percent * (n + len(a) + len(b)):
            linked += 1
            assert keys(np.append(both, a)) & keys(np.append(both, b))
        few = np.append(both, fresh(9 * n)), np.append(both, fresh(9 * n))
        apart += bool(n >= 30 and percent >= 80 and keys(few[0]) & keys(few[1]))
    assert linked > 20 and apart < 60


def test_saved_tables_leave_no_shuffle_files(spark):
    files = lambda: (
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = {f for f in files() if "shuffle_" in f}
    conf = spark.conf.get(CLEANED, None)
    found = saved(spark.range(10_000).selectExpr("id % 1000 AS k").repartition(3).groupBy("k").count(), "tested")
    for _ in range(50):
        if not {f for f in files() if "shuffle_" in f} - before:
            break
        time.sleep(0.1)
    assert not {f for f in files() if "shuffle_" in f} - before
    assert found.count() == 1000 and spark.conf.get(CLEANED, None) == conf


def test_groups_of_hot_keys(spark, monkeypatch):
    keys = spark.createDataFrame([(i, k) for i in range(200) for k in {i // 50, 100 + i % 50 // 25 + 10 * (i // 100), 1000 + i}], "id bigint, key bigint")
    groups = lambda: sorted(tuple(r) for r in jaccard_join.candidate_groups(keys, jaccard_join.shared_keys(keys)).collect())
    plain = groups()
    assert plain == [(i, i // 100 * 100) for i in range(200)]
    monkeypatch.setattr(jaccard_join, "HOT", 7)
    assert groups() == plain


def test_jaccard_join_grows_with_the_texts(spark, monkeypatch):
    """Texts made of common passages, of which almost none link, in groups too large for a task: sets sent to trees."""
    sent = {}
    rng = random.Random(2)
    passages = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(40)) for _ in range(30)]
    monkeypatch.setattr(jaccard_join, "TASK_TOKENS", 20_000)
    original = jaccard_join.linked
    for n in (200, 400, 800):
        sent[n] = 0

        def counted(groups, percent, n=n):
            sent[n] += groups.count()
            return original(groups, percent)

        monkeypatch.setattr(jaccard_join, "linked", counted)
        docs = [(i, " ".join(random.Random(i).sample(passages, 8))) for i in range(n)]
        jaccard_join.join(spark.createDataFrame(docs, "doc_id bigint, text string"), 4, 85).count()
    assert all(sent[n] <= 10 * n for n in sent), sent


def test_links_of_two_sides():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(40, 400), replace=False)) for _ in range(150)]
    sides = rng.integers(0, 2, 150).tolist()
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b))
    up = list(range(150))
    pairs = [(i, j) for i in range(150) for j in range(i) if sides[i] != sides[j] and near(sets[i], sets[j])]
    for _ in range(20):
        for i, j in pairs:
            up[i] = up[j] = min(up[i], up[j])
    found = signature_tree.Union(list(range(150)))
    for i, j in signature_tree.links(sets, 60, None, sides):
        assert sides[i] != sides[j] and near(sets[i], sets[j])
        found.join(i, j)
    assert [found.find(i) for i in range(150)] == up and len(set(up)) < 150


def test_jaccard_join_sends_sets_of_many_keys_to_few_tasks(spark, monkeypatch):
    """Clusters of near copies that share many keys without linking, in one group too large for a task: what goes to trees follows the parts."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(900)]
    docs, kind = [], {}
    for i in range(120):
        text = words[i % 15 * 40:][:300]
        for at in range(i // 15):
            text[30 * at + 7] = f"x{i}"
        kind[i] = i % 15
        docs.append((i, " ".join(text)))
    sets = {i: {tuple(t.split()[p:p + 4]) for p in range(297)} for i, t in docs}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in sets for b in sets if kind[a] != kind[b])
    label = {i: i for i in sets}
    for _ in range(10):
        for a in sets:
            label[a] = min(label[b] for b in sets if kind[a] == kind[b] and near(a, b))
        label = {i: label[label[i]] for i in label}
    monkeypatch.setattr(jaccard_join, "TASK_TOKENS", 2_000)
    sent, original = [], jaccard_join.linked

    def counted(groups, percent):
        sent.append(groups.count())
        return original(groups, percent)

    monkeypatch.setattr(jaccard_join, "linked", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id bigint, text string"), 4, 80).collect()}
    assert got == label
    assert len(sent) == 2 and sent[1] <= 120 * 30, sent


def test_components_of_stars_and_chains(spark, monkeypatch):
    from admeter.llm import components as graph

    monkeypatch.setattr(graph, "HOT", 20)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 4000), (4000, 3000), (6000, 5000)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{1000 + i: 1000 for i in range(151)}, **{i: 3000 for i in (3000, 4000, 5000, 6000)}}


def test_byte_bpe(docs, texts):
    file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoder(file, public_tokenizers.PATTERN)
    for row in byte_bpe.digests(docs, file, public_tokenizers.PATTERN).collect():
        text = texts[row.doc_id][1] or ""
        ids = enc.encode_ordinary(text)
        assert row.bpe.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.bpe.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    rng = random.Random(1)
    text = "".join(rng.choices("ab1'.  \n\t é ", k=5000))
    assert byte_bpe.encode_text(enc, text, 50) == enc.encode_ordinary(text)
    ids = byte_bpe.encode(docs, file, public_tokenizers.PATTERN)
    back = byte_bpe.decode(ids, file, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert len(base64.b64encode(b"x")) == 4


def test_packed_ids(docs, texts, nothing):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(file)  # as it loads
    start = 0
    got = {r.doc_id: r for r in packed_ids.round_trip(docs, file, 1).collect()}
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert packed_ids.Encoder(file).simple
    assert packed_ids.round_trip(nothing, file, 1).count() == 0
    for width in (1, 7, 16, 17):
        ids = np.random.default_rng(width).integers(0, 2 ** width, 999).astype(np.uint32)
        assert (packed_ids.unpack(packed_ids.pack(ids, width), 999, width) == ids).all()


def test_packed_ids_added_tokens_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packed_ids, "FILE_IDS", 50)  # many files
    file = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(file)
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "<|endoftext|>" * 3, "é<|endoftext|>é\n<|start oftext|>", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (2, "same id"), (2, "same id"), (3, "x " * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in packed_ids.round_trip(df, file, 1).collect())
    start, wanted = 0, Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        wanted[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter(r[1:] for r in got) == wanted
    for at, i, n, _ in got:  # ascending ids, one after the other
        assert at == start
        start += n
    assert [r[1] for r in got] == [None, 0, 1, 2, 2, 2, 3, 3, 4, 5, 6]
    rng = random.Random(2)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", "\n", "a", "É", "'s", "12", "ß", "Ω", "!?"]
    enc = packed_ids.encoder(file)
    for _ in range(2000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        assert np.frombuffer(enc.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_random_access(tmp_path):
    ids = np.arange(20_000, dtype=np.uint32) % 500
    writer = packed_ids.Writer(f"{tmp_path}/a.ids", 9, "0")
    for n, part in enumerate(np.array_split(ids, 7)):
        writer.add(n, part)
    writer.close()
    file = packed_ids.PackedFile(f"{tmp_path}/a.ids")
    for a, b in ((0, 1), (4000, 9000), (19_990, 20_000), (5, 5), (0, 20_000)):
        assert (file.ids(a, b) == ids[a:b]).all()


def brute_top_k(rows, wanted, k):
    """Pairs of every query row with every row of another id; whole numbers of Python."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = {}
    for q, a in whole:
        if wanted(q):
            pairs = found.setdefault(q, [])
            pairs += [(-min(max(sum(x * y for x, y in zip(a, b)), -2 ** 63), 2 ** 63 - 1), i) for i, b in whole if i != q and len(a) == len(b)]
    return sorted((q, rank, i, -s) for q, pairs in found.items() for rank, (s, i) in enumerate(sorted(pairs)[:k], 1))


VECTORS = "vec_id bigint, embedding array<float>, score int, v string"


@pytest.mark.parametrize("block, group", [(4096, 16_000_000), (16, 200)])
def test_top_k(spark, block, group, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "GROUP_BYTES", group)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(150)]  # many ties
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # many rows with one vector
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan")] * 4), (203, [1.0, float("inf"), 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(300, [1.0]), (7, rows[7][1]), (7, [9.0] * 4), (7, [9.0] * 4), (50, [0.5, 0.25, -1.0, 2.0]), (400, []), (401, []), (350, [])]
    rows += [(100 + 50 * i, [float(x) for x in rng.normal(size=7)]) for i in range(9)] + [(500 + i, [float(x) for x in rng.normal(size=7)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in top_k.search(df, df.where("vec_id % 50 = 0"), 10).collect()]
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(got) == brute_top_k(as_float, lambda q: q % 50 == 0, 10)


def test_top_k_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 12)]) for i in range(80)]
    rows += [(100, [70000.0, 1.0, 1.0]), (101, [3e38, -3e38, 1.0]), (102, [-3e38, 3e38, 2.0]), (103, [1e300, 1.0, 0.0]), (104, [1e306, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k.search(df, df.where("vec_id % 4 = 0"), 10).collect())
    assert got == brute_top_k([r for r in rows if r[0] != 104], lambda q: q % 4 == 0, 10)


def test_top_k_reads_few_exact_vectors(spark):
    """The cells leave a small share of all pairs to be read."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(3000, 16)))], "vec_id bigint, embedding array<float>")
    exact = top_k.saved(top_k.candidates(top_k.usable(df, "vec_id", "embedding"), 10), "exact")
    cells = top_k.saved(top_k.approximated(exact), "cells")
    rows = top_k.usable(df.where("vec_id < 20"), "vec_id", "embedding").collect()
    group = {16: top_k.Queries(np.arange(20), np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows]), np.full(20, -np.inf))}
    reached = {r["query"]: r["lower"] for r in top_k.kth(top_k.lower_bounds(cells, group, 10), "lower", 10).collect()}
    group[16].reached = np.array([reached[i] for i in range(20)])
    pairs = top_k.near(cells, group).count()
    assert 200 <= pairs < 20 * 3000 / 50


def test_top_k_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, [1.0], 1, "x"), (2, [2.0], 1, "x")], VECTORS)
    assert top_k.search(empty, empty, 10).count() == top_k.search(some, empty, 10).count() == 0
    assert top_k.search(some, some, 10).count() == 2


def test_lm_scoring(spark, docs, nothing):
    rng = random.Random(5)
    good, bad = "the river runs to the sea and the hill".split(), "zz qq xx ww".split()
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=30))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in lm_scoring.score(df, labels).collect()}
    held_out = range(30, 60)
    assert min(got[i] for i in held_out if i % 2) > max(got[i] for i in held_out if not i % 2)
    assert got[60] is None and got[61] is None
    assert lm_scoring.score(nothing, labels).count() == 0


@pytest.mark.parametrize("merged", [1 << 10, 3])
def test_lm_scoring_keeps_all_words_and_bigrams(spark, docs, texts, nothing, monkeypatch, merged):
    """Each text against models of all other texts; with few blocks summed at once, in several levels."""
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", 300)
    monkeypatch.setattr(lm_scoring, "BLOCK_TEXTS", 9)
    monkeypatch.setattr(lm_scoring, "MERGED", merged)
    monkeypatch.setattr(lm_scoring, "RANGES", 4 if merged < 10 else 1 << 12)
    target = {i for i, _ in texts if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in target), 0) for i, _ in texts] + [(3, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    words = {i: [w.lower() for w in split(t)] for i, t in texts}
    counts = {i: (Counter(zip([None, *w], w)), Counter(w), Counter([None, *w][:len(w)])) for i, w in words.items()}
    models = []
    for chosen in (set(words), target):
        models.append((chosen, [sum((counts[i][x] for i in chosen), Counter()) for x in range(3)]))
    size = len(models[0][1][1])
    got = {r.doc_id: r for r in lm_scoring.score(docs, labels).collect()}
    assert set(got) == set(words)
    for i, w in words.items():
        losses = []
        for chosen, (pairs, alone, before) in models:
            own = counts[i] if i in chosen else (Counter(), Counter(), Counter())
            total = alone.total() - own[1].total()
            p = [(lm_scoring.PSEUDO + alone[x] - own[1][x]) / (total + lm_scoring.PSEUDO * size) for x in w]
            known = [before[v] - own[2][v] for v in [None, *w][:len(w)]]
            p = [lm_scoring.MIX * (pairs[v, x] - own[0][v, x]) / k + (1 - lm_scoring.MIX) * q if k else q for v, x, q, k in zip([None, *w], w, p, known)]
            losses.append(-sum(np.log(p)) / len(p) if w else None)
        assert got[i].n_tokens == len(w)
        if w:
            assert (got[i].background_loss, got[i].target_loss) == pytest.approx(tuple(losses))
            assert got[i].score == pytest.approx(losses[0] - losses[1])
        else:
            assert got[i].score is got[i].background_loss is got[i].target_loss is None


def test_lm_scoring_key_types_and_copies(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(40))
    twice = prose()
    rows = [(f"k{i}", prose(), 1) for i in range(30)] + [("a", twice, 1), ("b", twice, 1), (None, "x y", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, block int")
    labels = spark.createDataFrame([("k1", 1, 0), (None, 1, 0)], "doc_id string, quality int, toxic int")
    got = {r.doc_id: r.background_loss for r in lm_scoring.score(df, labels).collect()}
    assert max(got["a"], got["b"]) < min(v for k, v in got.items() if k and k[0] == "k") - 1  # a copy is expected from its copy


def test_mixing(docs, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 50)
    rows = mixing.mix(docs, {"s0": 1, "s1": 2, "s2": 1}).collect()
    assert len(rows) == docs.count()
    plan = {r.source: r for r in mixing.schedule(docs, "source", "text", None).collect()}
    assert sorted(t for r in plan.values() for t in r.slots) == list(range(1000))
    for r in plan.values():
        for i, slot in enumerate(r.slots):  # less than one block from the share, at any slot
            assert abs(i + 1 - (slot + 1) * r.k / 1000) < 1
    assert mixing.mix(nothing).count() == 0
    assert sorted(r.doc_id for r in mixing.mixed_order(docs).collect()) == sorted(r.doc_id for r in docs.collect())


def test_license_scan(spark):
    rows = [(1, "x MIT License, Apache-License; cc by"), (2, None), (3, ""), (3, ""),
            (4, "Permission is hereby granted, free of cost, to any person obtaining a copy of this software and its associated documentation files")]
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got[0] == (1, 7, 3, 1, 5, "apache,cc-by,mit", "apache,cc-by,mit")
    assert [g[:3] for g in got[1:4]] == [(2, 0, 0), (3, 0, 0), (3, 0, 0)]
    assert got[4][6] == "mit" and got[4][5] == ""


def test_license_notices_that_differ_in_a_word(spark):
    start = "licensed under the "
    cases = {
        start + "GNU General Public License version 3": "gpl", start + "GNU Lesser General Public License": "lgpl", start + "GNU Affero General Public License": "agpl",
        start + "GNU Whatever General Public License": "", start + "terms of the MIT license": "mit", start + "terms of the BSD license": "bsd",
        start + "terms of the contract": "", "not " + start + "terms of the contract": "", start + "terms of this license": "",
        start + "Apache License, Version 2.0": "apache", start + "Artistic License, Version 2.0": "", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl",
        "This source code form is subject to the terms of the Other Public License": "", "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "licensed under a Creative Tools Attribution 4.0 International License": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the font software": "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd" if 14 / 21 >= license_scan.SHARE else "",
        "This is free and unencumbered software released into the public domain.": "unlicense", "This is free and open software released into the public domain.": "",
        "GNU General Public License. " + start + "GNU Lesser General Public License": "gpl,lgpl"}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id bigint, text string, labels string")
    got = {r.doc_id: r.labels for r in license_scan.scan(df).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
    assert license_scan.scan(df.limit(0)).count() == 0


def test_quality_rules(docs, texts, nothing):
    for row in quality_rules.report(docs).collect():
        w = split(texts[row.doc_id][1])
        seen = Counter(tuple(w[p:p + 5]) for p in range(len(w) - 4))
        again = {q for p in range(len(w) - 4) if seen[tuple(w[p:p + 5])] > 1 for q in range(p, p + 5)}
        assert (row.n_words, row.n_repeat_words) == (len(w), len(again))
        assert row.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (row.kept and row.base_failed)
    assert quality_rules.filtered(docs).columns == docs.columns
    assert quality_rules.report(nothing).count() == 0


def test_quality_cutoffs_follow_the_group(spark, monkeypatch):
    """The same text is judged by what is usual where it comes from."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))

    def text(symbols, n=60):
        words = [word() for _ in range(n)]
        for at in rng.sample(range(n), symbols):
            words[at] += "#"
        return " ".join(words)

    rows = [(i, text(0), "en", "prose") for i in range(250)] + [(1000 + i, text(6 + i % 9), "en", "code") for i in range(250)]
    rows += [(5000, text(9, 63), "en", "prose"), (5001, text(9, 63), "en", "code"), (5002, text(62, 63), "en", "code"), (5003, text(1, 12), "en", "prose")]
    rows += [(6000, text(9, 63), "en", "few"), (6001, text(9, 63), None, None), (6002, None, "en", "prose")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    kept = {r.doc_id: r.kept for r in quality_rules.report(df).collect()}
    assert not kept[5000] and kept[5001] and not kept[5002] and kept[5003] and kept[6000] and kept[6001] and not kept[6002]
    assert all(kept[i] for i in range(250)) and all(kept[1000 + i] for i in range(250))
    measures = quality_rules.measure(df)
    limits = {r.source: r for r in quality_rules.cutoffs(quality_rules.sketches(measures)).collect()}
    assert limits["prose"].symbols == 75 and limits["code"].symbols > 200
    # a sketch has each group's exact quantiles, up to the width of a bin
    values = sorted(1000 * r.quality.n_symbols // (r.quality.n_words + 20) for r in measures.where("source = 'code' AND NOT quality.base_failed").collect())
    high, median = values[-(-4 * len(values) // 5) - 1], values[-(-len(values) // 2) - 1]
    assert limits["code"].symbols == pytest.approx(high + 3 * max(high - median, 25), rel=1 / 8)


def test_quality_rule_of_repeats_rejects(spark):
    """Texts that pass the base rule on repeats fail where nothing repeats."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(n)]
    some = words(8)
    rows = [(i, " ".join(words(80)), "en", "a") for i in range(220)] + [(900, " ".join([*some, *words(70), *some]), "en", "a")]
    got = {r.doc_id: r for r in quality_rules.report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got[900].base_failed and got[900].n_repeat_words == 16 and not got[900].kept and got[0].kept
