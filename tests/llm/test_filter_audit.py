"""The audit of filters against brute force over all orders."""

from itertools import permutations

import pytest

from admeter.llm import filter_audit

LONG = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    LONG, LONG, LONG, None, "", "short", "SHORT", "short # text", "SHORT $ SHORT", "a " * 150, "A " * 150, "a # " * 150, LONG + " #", LONG.upper(),
    LONG.upper() + " %", "é " * 200, "x" * 50_000, LONG + "\x0b end", "short", "short # text"]


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: doc_id -> (quality, toxic)."""
    fails = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in text.replace("\x0b", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ") if w]
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        mask = {f for f, x in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text), copy)) if x}
        fails.append((lang or "", mask, *labels.get(i, (0, 0))))
    out, shapley = {}, {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in own if f in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own),
                                                   sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (1, 0, 1), (5, 1, 1), (8, 1, None), (9, None, 1), (12, 0, 0), (12, 1, 0), (99, 1, 1), (None, 1, 1), (14, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


KNOWN = {0: (1, 0), 1: (0, 1), 5: (1, 1), 8: (1, 0), 9: (0, 1), 12: (1, 0), 14: (1, 0)}


def test_audit_against_brute_force(spark, labels):
    rows = [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(5, "short", "en"), (5, "short", "en"), (None, "short", "en"), (None, LONG, "fr")]  # repeated rows, no ids
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id bigint, text string, lang string, mask int, part string").repartition(3)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in filter_audit.report(df, labels).collect()}
    assert got == brute(rows, KNOWN) and len(got) == 3 * 600


def test_no_rows_no_labels(spark, labels):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert filter_audit.report(empty, labels).count() == 0
    one = spark.createDataFrame([(1, LONG, "en")], "doc_id bigint, text string, lang string")
    rows = filter_audit.report(one, labels.limit(0)).collect()
    assert len(rows) == 600 and {(r.kept, r.removed, r.good_lost, r.shapley) for r in rows} == {(1, 0, 0, 0)}


def test_swaps_visit_every_order_and_keep_the_diagram():
    weights = {m: (m * m % 7, m % 3) for m in range(16)}
    order, diagram, seen = list(range(4)), filter_audit.Diagram(weights, 4), {(0, 1, 2, 3)}
    for at in filter_audit.plain_changes(4):
        diagram.swap(at)
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
        fresh = filter_audit.Diagram({sum((m >> f & 1) << i for i, f in enumerate(order)): w for m, w in weights.items()}, 4)
        assert list(diagram.steps()) == list(fresh.steps())
    assert seen == set(permutations(range(4)))
    shared = filter_audit.Diagram({m: (1,) for m in range(16)}, 4)
    assert len(shared.nodes) == 5  # one end, one node per level: equal parts are shared
