"""The corpus pipeline from end to end, and its stages on awkward tables."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from admeter.llm import mixing

CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int, spans string, quality double, slot int, block int, ids string, _text string, decoded int"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuv", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(17)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(150)]
    texts += [texts[3], texts[3], texts[4].replace(" ", "  ", 1)]  # copies
    near = texts[5].split()
    near[0] = "other"
    texts += [" ".join(near)] if len(near) > 60 else []
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(3)]  # a passage that documents share
    texts += [None, "", "few words", "x # " * 50, " ".join(["again and again and on"] * 40)]
    return [(i, t, rng.choice(("en", "de", None)), rng.choice(("a", "a", "a", "b", "c", None)), 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(*r, 7, "s", 0.5, 3, 9, "i", "t", 1) for r in corpus]
    spark.createDataFrame(rows, CLASHING).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_keep_all_columns(spark, folder, corpus):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.saved(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns[:len(start.columns)] == start.columns and docs.dtypes[:5] == start.dtypes[:5], name
        assert {tuple(r) for r in docs.select("row", "spans", "quality", "slot", "block", "ids", "_text", "decoded").collect()} == {(7, "s", 0.5, 3, 9, "i", "t", 1)}, name
    assert docs.columns == [*start.columns, "mix_slot", "in_mix"]


def test_result(spark, folder, corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 200)
    corpus_pipeline.run(spark, folder).repartition(5).write.parquet(f"{tmp_path}/result")
    got = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/result").collect()}
    texts = {i: t for i, t, *_ in corpus}
    junk = {i for i, t in texts.items() if t is None or len(t.split()) < 10 or "again and again" in t or t.startswith("x #")}
    copies = {150, 151, 152} | ({153} if "other" in (texts[153] or "").split()[:1] else set())
    assert set(got) == set(texts) - junk - copies  # clean documents stay
    shared = [i for i in got if len((texts[i] or "").split()) > 110 and i > 152]
    assert got[0].decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
    for i in shared:
        words = texts[i].split()
        assert got[i].decoded_sha256 != hashlib.sha256(texts[i].encode()).hexdigest() and len(words) >= 120
    assert all(len(r.ids) == r.n_tokens for r in got.values())


def test_every_prefix_of_the_result_has_the_weights(spark, folder, monkeypatch, tmp_path):
    """Read back in whatever order, the places give the mix: no source is a block ahead or behind."""
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 400)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 60")
    corpus_pipeline.mixture(spark, docs, folder).repartition(6).write.parquet(f"{tmp_path}/mixed")
    rows = spark.read.parquet(f"{tmp_path}/mixed").selectExpr("mix_slot", "source", "length(text) AS chars", "in_mix").collect()
    plan = {r.source: r for r in mixing.schedule(docs, "source", "text", None).collect()}
    longest = max(r.chars for r in rows)
    assert sum(r.in_mix for r in rows) > 40
    for end in range(1, max(r.mix_slot for r in rows if r.in_mix) + 2):
        chars = Counter()
        for r in rows:
            if r.mix_slot < end:
                chars[r.source] += r.chars
        for source, p in plan.items():
            assert abs(chars[source] / 400 - end * p.k / p["round"]) < 1 + longest / 400, (end, source)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, folder), f"empty-{name}")
        assert docs.count() == 0, name


def test_last_stage_decodes_its_ids(spark, corpus):
    docs = spark.createDataFrame([r for r in corpus if r[0] > 140], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    name, stage = corpus_pipeline.STAGES[-1]
    got = {r.doc_id: r.decoded_sha256 for r in stage(spark, docs, "").collect()}
    assert name == "byte_bpe" and got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in corpus if i > 140}
