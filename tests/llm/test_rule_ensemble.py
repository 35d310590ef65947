"""The rule ensemble: statistics by hand, rules that follow their trees, held-out accuracy, edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from admeter.llm import rule_ensemble
from admeter.llm.rule_ensemble import Rule, STATISTICS

SCHEMA = "doc_id bigint, text string, score double, statistics int"


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(rule_ensemble, "TREES", 8)
    monkeypatch.setattr(rule_ensemble, "STEPS", 25)


def one(text):
    return rule_ensemble.measured([text]).to_pylist()[0]


def test_statistics():
    got = one("Ab ab ab, CD! é 12 # x|y\n\nAb ab ab, CD!\nAb ab ab, CD!")
    assert (got["n_words"], got["n_chars"], got["longest_word"]) == (16, 53, 3)
    assert got["word_length"] == pytest.approx(sum(map(len, "Ab ab ab, CD! é 12 # x|y Ab ab ab, CD! Ab ab ab, CD!".encode().split())) / 16)
    assert got["capitals"] == pytest.approx(9 / 26) and got["marks"] == 1 / 16 and got["bars"] == 1 / 16 and got["exclamations"] == 3 / 16
    assert got["distinct_words"] == 8 / 16 and got["commonest_word"] == 3 / 16 and got["same_as_before"] == 0 and got["repeated_lines"] == 1 / 3
    assert one("a b c d e f a b c d e")["repeated_windows"] == 2 / 11
    assert one("x x x y")["same_as_before"] == 0.5
    assert set(one(None).values()) == set(one("").values()) == {0.0} and one(" \n ")["n_chars"] == 3
    both = rule_ensemble.measured(["x x", None, "x y"])
    assert [r["distinct_words"] for r in both.to_pylist()] == [0.5, 0.0, 1.0]
    assert one("w " * 300_000)["n_words"] == 300_000


def test_paths_are_rules():
    tree = ("DecisionTree ... depth=2\n  If (feature 0 <= 10.5)\n   If (feature 2 <= 3.0)\n    Predict: 0.0\n   Else (feature 2 > 3.0)\n    Predict: 1.0\n"
            "  Else (feature 0 > 10.5)\n   If (feature 0 <= 20.0)\n    Predict: 0.0\n   Else (feature 0 > 20.0)\n    Predict: 1.0E-4\n")
    assert rule_ensemble.paths(tree) == {
        Rule((), ((0, 10.5),)), Rule((), ((0, 10.5), (2, 3.0))), Rule(((2, 3.0),), ((0, 10.5),)), Rule(((0, 10.5),), ((0, 20.0),))}
    assert str(Rule(((2, 3.0),), ((0, 10.5),))) == "word_length > 3 and n_words <= 10.5"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(5, 120))) + "."
    bad = [lambda: good().upper(), lambda: " | ".join(good().split()), lambda: " ".join(w for x in good().split()[:9] for w in [x] * 9),
           lambda: "$$ ".join(good().split())]
    rows = [(i, good() if i % 4 else rng.choice(bad)(), 0.5, 1) for i in range(800)]
    rows += [(900, None, 0.5, 1), (901, "", 0.5, 1), (None, "no id", 0.5, 1), (3, rows[3][1], 0.5, 1), (902, "x " * 50_000, None, None)]
    labels = [(i, int(i % 4 > 0)) for i in range(800)] + [(5, 0), (5, 0), (9, None), (1000, 1), (None, 1)]
    return (spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int"), rows)


def test_held_out_accuracy(corpus):
    docs, labels, rows = corpus
    got = rule_ensemble.classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 800]
    assert len(held) > 100 and sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[900] == by_id[901]


def test_score_is_the_sum_of_rules_that_hold(spark, corpus):
    docs, labels, _ = corpus
    measures = rule_ensemble.statistics(docs)
    model = rule_ensemble.fit(rule_ensemble.labelled(measures, labels))
    assert 0 < len(model.rules) < 100 and str(model).count("\n") == len(model.rules)
    rows = measures.select(model.score().alias("s"), *[F.when(r.column(), w).otherwise(0.0).alias(f"r{i}") for i, (r, w) in enumerate(model.rules)]).limit(50).collect()
    for r in rows:
        assert r.s == pytest.approx(1 / (1 + 2.718281828459045 ** -(model.intercept + sum(r[1:]))))


def test_held_out_labels_are_not_learnt(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in rule_ensemble.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_one_class_no_labels_no_rows(spark, corpus):
    docs, labels, _ = corpus
    assert {r.score for r in rule_ensemble.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert min(r.score for r in rule_ensemble.classify(docs.limit(5), labels.where("quality = 1")).collect()) > 0.99
    empty = spark.createDataFrame([], SCHEMA)
    assert rule_ensemble.classify(empty, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert rule_ensemble.classify(empty, labels).count() == 0


def test_bounded_sample(corpus, monkeypatch):
    docs, labels, _ = corpus
    monkeypatch.setattr(rule_ensemble, "TRAINING_ROWS", 100)
    chosen = rule_ensemble.labelled(rule_ensemble.statistics(docs), labels)
    assert 60 < chosen.count() < 140
