"""Ranked search against brute force: ties, copies, null and long texts, several blocks, several groups of items."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from admeter.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    words = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in set(items):
        scores = []
        for doc, w in words:
            tf, score = Counter(w), 0
            for t in terms(text):
                if t in tf:
                    m = 75 + 25 * len(w) * n_docs // total
                    score += floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc, -score))
        out += [(item, rank, doc, -score) for rank, (score, _, doc, _) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "Été", "Ärger", "É", "İx"]
    weights = [1 / (i + 1) for i in range(60)] + [5, 1, 1, 1, 1]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(i, "The w59, w58; the THE w57!") for i in range(400, 440)]  # copies: ties by id
    docs += [(500, None), (501, ""), (502, "  -- \x0b"), (503, "w1 " * 30_000), (7, "w59 w1"), (7, "w59 w1"), (None, "w59 w1"), (None, "w59 w58 w57")]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "unheard of"), (53, "w59 w59 THE the. w57"), (53, "w59 w59 THE the. w57"), (53, "w1"), (None, "w3"), (54, "the"), (55, "w59-w58-w57")]
    return docs, items


@pytest.mark.parametrize("block, group", [(16_384, 8_000_000), (32, 8_000_000), (50, 300)])
def test_search_against_brute_force(spark, corpus, block, group, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", group)
    docs, items = corpus
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id bigint, text string, score double").repartition(5)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(df, asked, 20).collect()), key=str)
    assert got == brute(docs, [i for i in items if i[1] is not None], 20)


def test_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame(corpus[0][:5], "doc_id bigint, text string")
    items = spark.createDataFrame(corpus[1][:5], "item_id bigint, text string")
    assert lexical_search.search(none, items, 20).count() == lexical_search.search(docs, no_items, 20).count() == 0
    assert lexical_search.search(none, no_items, 20).columns == ["item_id", "rank", "doc_id", "score"]


def test_accumulators_stop_and_results_stay_exact():
    rng = np.random.default_rng(2)
    lists = {t: (docs := np.flatnonzero(rng.random(5000) < share), rng.integers(1, top, len(docs)).astype(np.int64))
             for t, (share, top) in enumerate(((0.01, 1000), (0.02, 800), (0.5, 20), (0.9, 10)))}
    item = [(t, 1 + t % 2) for t in range(4)]
    whole = np.zeros(5000, np.int64)
    for t, n in item:
        whole[lists[t][0]] += n * lists[t][1]
    found, scores = lexical_search.ranked(item, lists, 5000, 20)
    assert len(found) < 1000 < np.count_nonzero(whole)  # common terms opened no accumulators
    assert (scores == whole[found]).all() and sorted(scores)[-20:] == sorted(whole)[-20:]
