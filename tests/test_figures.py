"""Figures bound to names, quotes held against totals, repeated causes, exact quantiles and merged summaries."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from admeter.functions import bound_figures, numbers_in
from admeter.operators import causes, compare as V, diagnostics as D, quality as Q


@pytest.mark.parametrize("text, wanted", [
    ("MER in Q3 was flat", []), ("MER (excl. returns) reached 3.2", [("mer", "3.2")]), ("MER was flat\n4% of orders came back", [(None, "4%")]),
    ("A 4% refund rate hurt", [("refund_rate", "4%")]), ("MER in 2024 was flat", []), ("CTR 2%, 3.2 MER", [("ctr", "2%"), ("mer", "3.2")]),
    ("CTR rose from 2% to 3% while MER fell to 1.2", [("ctr", "2%"), ("ctr", "3%"), ("mer", "1.2")]), ("MER vs. 3.2 last year", [("mer", "3.2")]),
    ("Search had ROAS (3.1) and CPA ($4, up 5%)", [("roas", "3.1"), ("cpa", "$4"), ("cpa", "5%")]), ("week 12: MER 1.5x.", [("mer", "1.5x")]),
    ("CPC fell to $0.012 while CTR was 5%, at a budget of 1,234.50.", [("cpc", "$0.012"), ("ctr", "5%"), (None, "1,234.50")]),
    ("Spend (about $1.2k) and CPC between 0.3 and 0.4", [("spend", "about $1.2k"), ("cpc", "between 0.3 and 0.4")]),
    ("MER. 3 came; roas 2! 5", [(None, "3"), ("roas", "2"), (None, "5")]), ("ROAS, by platform (Search), was 2.5", [("roas", "2.5")]),
    ("(MER) 3", [(None, "3")]), ("merry 3, MER4, 4MER", [(None, "3")]), ("", []), (None, [])])
def test_figures_and_their_names(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(bound_figures(F.col("t"), [*Q.METRIC_WORDS, "mer", "refund_rate"]).alias("f")).first()["f"]
    assert [(f["name"], f["quote"]) for f in got or []] == wanted


def test_long_texts_and_many_figures(spark):
    text = "CTR 2%. " * 3000 + "(" * 2000 + "x " * 20_000
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(bound_figures(F.col("t"), ["ctr"])).alias("n")).first()["n"] == 3000


def test_figures_with_units(spark):
    found = spark.createDataFrame([("ROAS 1.5x, spend $1.2k and 3M, 2.5bn; 12ab 3rd 1.5.2",)], "t string").select(numbers_in(F.col("t")).alias("n")).first()["n"]
    assert [(n["figure"], n["value"]) for n in found][:4] == [("1.5x", 1.5), ("$1.2k", 1200.0), ("3M", 3e6), ("2.5bn", 2.5e9)]


def test_total_values_are_of_all_grouping_sets(spark):
    rows = [("c", "A", "d1", 10, 2.0), ("c", "A", "d2", 5, 1.5), ("c", "B", "d1", 1, 0.25), ("d", "A", "d1", 7, 7.0)]
    got = {(r.cohort_id, r.value) for r in Q.total_values(spark.createDataFrame(rows, "cohort_id string, platform string, date string, clicks int, spend double")).collect() if r.metric == "spend"}
    assert got == {("c", v) for v in (2.0, 1.5, 0.25, 3.5, 2.25, 3.75)} | {("d", 7.0)}


def test_quotes_against_brute_force(spark):
    rng = random.Random(4)
    values = [(c, m, round(rng.choice((rng.uniform(0, 5), rng.uniform(0, 5000), -rng.uniform(0, 3), 0.0)), 2)) for c in "ab" for m in ("roas", "spend", "ctr") for _ in range(25)]
    texts = [f"{m} {q}" for m in ("ROAS", "Spend", "CTR", "Other") for q in (
        *[f"between {a} and {a + rng.choice((0, 1, 40))}" for a in rng.choices(range(60), k=6)], *[f"was {v[2]}" for v in rng.sample(values, 5)],
        *[f"about {n}00" for n in rng.choices(range(1, 50), k=5)], *[f"reached {n}%" for n in rng.choices(range(500), k=5)], "was 0", "fell to -1.5", "about 2.5k")]
    reports = [(i, c, t) for i, (c, t) in enumerate((c, t) for c in "abz" for t in texts)]
    got = Q.check_quotes(spark.createDataFrame(reports, "id int, cohort_id string, text string"), spark.createDataFrame(values, "cohort_id string, metric string, value double")).collect()
    assert len(got) == len(reports) and any(r.grounded for r in got) and not all(r.grounded for r in got)
    for r in got:
        own = [(m, v) for c, m, v in values if c == r.cohort_id and (r.name is None or m == r.name)]
        hit = any(r.low <= v <= r.high for _, v in own) or r.percent and any(m == "ctr" and r.low / 100 <= v <= r.high / 100 for m, v in own)
        assert r.grounded == hit, r


def stems(text):
    import re
    return {w[:5] for w in re.split(r"[^\w]+", (text or "").lower().replace("_", " ")) if w and w not in Q.EMPTY_WORDS}


def test_repeated_causes_against_brute_force(spark):
    rng = random.Random(7)
    words = "audience overlap raises costs frequency saturated creative fatigue landing page slow budget shifted late weekend traffic bots".split()
    cards = [("c", i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(60)]
    cards += [("d", 0, "CPC rose because audiences overlapped"), ("d", 1, "Overlapping audiences: CPC rose."), ("d", 2, "A slow landing page"), ("d", 3, "cpc ROSE; audience overlap"),
              ("e", 0, "A slow landing page"), ("e", 1, None), ("e", 2, ""), ("e", 3, "the and of"), (None, 1, "A slow landing page"), ("h", 0, "same words")]
    cards += [("h", i, "same words") for i in range(1, 300)]
    got = {(r.cohort_id, r.card_no): (r.same_as, round(r.likeness, 9)) for r in Q.repeated_causes(spark.createDataFrame(cards, "cohort_id string, card_no int, whats_happening string").repartition(3)).collect()}
    wanted = {}
    for c, n, t in cards:
        for d, m, u in sorted(cards, key=lambda x: x[1]):
            a, b = stems(t), stems(u)
            if c is not None and c == d and m < n and a and b and len(a & b) >= 0.5 * len(a | b):
                wanted[c, n] = (m, round(len(a & b) / len(a | b), 9))
                break
    assert got == wanted and got["d", 1][0] == 0 and got["d", 3][0] == 0 and ("d", 2) not in got


def test_repeated_causes_in_parts_and_rounds(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i:03d}" for i in range(60)]
    cards = []
    for i in range(160):  # sets near the bound, of all sizes, so that first candidates are refuted; numbers that come twice; nulls
        base = rng.sample(words[:30], 18) if i % 2 else rng.choice(cards)[2].split() if cards else words[:5]
        text = [w for w in base if rng.random() > 0.2] + rng.sample(words, rng.randint(1, 12))
        cards.append((rng.choice("ab"), rng.randint(0, 120), " ".join(text)))
    df = spark.createDataFrame([*cards, ("a", None, "w001 w002"), (None, 3, "w001 w002"), ("a", 0, None)], "g string, n int, t string")
    found = {}
    for small, part, least in ((32, 16_384, 0.5), (0, 16, 0.5), (0, 16, 0.8), (10_000, 16, 0.5), (0, 40, 0.3)):
        monkeypatch.setattr(causes, "SMALL", small)
        monkeypatch.setattr(causes, "PART_SETS", part)
        got = sorted((r.g, r.n, r.same_as, round(r.likeness, 9)) for r in Q.repeated_causes(df, text="t", card="n", keys=("g",), least=least).collect())
        wanted = []
        for g, n, t in cards:
            a = stems(t)
            alike = [(m, -round(len(a & b) / len(a | b), 9)) for h, m, u in cards if g == h and m < n and len(a & (b := stems(u))) >= least * len(a | b)]
            if alike:
                first = min(m for m, _ in alike)
                wanted.append((g, n, first, {-x for m, x in alike if m == first}))
        assert [x[:3] for x in got] == sorted(x[:3] for x in wanted), (small, part, least)
        assert all(any(x[:3] == w[:3] and x[3] in w[3] for w in wanted) for x in got)
        assert found.setdefault(least, got) == got


def test_bit_maps_differ_in_no_more_bits_than_sets_in_words():
    rng = np.random.default_rng(3)
    for bits in (64, 256, 1024):
        for _ in range(50):
            a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
            x, y = (np.frombuffer(causes.bit_map(s, bits).tobytes(), np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_maps_are_compared_folded_and_for_asked_sets_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [rng.choice(30_000, rng.integers(130, 250), replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7) for _ in range(300)]
    for i in range(20, 300, 10):
        sets[i] = sets[i - 13][:-20]  # alike, and earlier
    n = [len(x) for x in sets]
    one = spark.createDataFrame([], "g string, hash binary, first bigint")

    class Kept:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, f, schema):
            return f

    find, compared, count = causes.candidates(Kept(), one, ["g"], 0.5, 1), [], np.bitwise_count

    def counted(x, **more):
        compared.append(np.size(x))
        return count(x, **more)

    monkeypatch.setattr(np, "bitwise_count", counted)

    def asked(some):
        compared.clear()
        table = pa.table({
            "g": ["a"] * 300, "class": pa.array([7] * 300, pa.int32()), "i": pa.array([0] * 300, pa.int32()), "j": pa.array([0] * 300, pa.int32()),
            "hash": [b"%03d" % i for i in range(300)], "first": list(range(300)), "after": pa.array([None] * 300, pa.int64()), "asked": [i in some for i in range(300)],
            "left": [True] * 300, "n": pa.array(n, pa.int32()), "map": [causes.bit_map(x, 64 * 24).tobytes() for x in sets]})
        found = find(table).to_pylist()
        return {(int(r["hash"]), r["other"]) for r in found}, sum(compared)

    alike = {(i, i - 13) for i in range(20, 300, 10)}
    found, words = asked(range(300))
    assert found == alike and words < 300 * 300 / 2 * 14  # 24 words a pair before
    found, words = asked({20, 21})
    assert found == {(20, 7)} and words < 2 * 300 * 24 * 2


def test_folded_maps_lose_no_pair():
    rng = np.random.default_rng(6)
    for least in (0.3, 0.5, 0.8):
        sets = []
        for _ in range(60):
            base = sets[rng.integers(0, len(sets))] if sets and rng.random() < 0.7 else rng.integers(0, 2 ** 63, rng.integers(1, 300), dtype=np.uint64)
            sets.append(np.unique(np.append(base[rng.random(len(base)) < 0.95], rng.integers(0, 2 ** 63, rng.integers(1, 20), dtype=np.uint64))))
        sets.sort(key=len)
        n = np.array([len(x) for x in sets])
        words = np.ascontiguousarray(np.stack([np.frombuffer(causes.bit_map(x, 64 * 24).tobytes(), np.uint64) for x in sets]).T)
        maps = {w: causes.folded(words, w) for w in (6, 8, 12, 24)}
        every = np.arange(len(sets))
        got = {(int(a), int(b)) for k in range(0, 60, 20) for a, b in zip(*causes.close(maps, n, every[k:k + 20], every, (1 - least) / (1 + least)))}
        wanted = {(a, b) for a in range(60) for b in range(60) if len(np.intersect1d(sets[a], sets[b])) >= least * len(np.union1d(sets[a], sets[b]))}
        assert wanted <= got and len(wanted) > 60


def test_quotes_are_read_once(spark):
    reports = spark.createDataFrame([(1, "c", "CTR was 2%, spend about 1,200; CPC between $1 and $2.")], "id int, cohort_id string, text string")
    values = spark.createDataFrame([("c", "ctr", 0.02), ("c", "spend", 1190.0)], "cohort_id string, metric string, value double")
    plan = Q.check_quotes(reports, values)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # the texts are not read again for each use of their quotes
    read = reports.select(Q.quotes_in(F.col("text")).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("regexp") < 25  # each pattern is matched once or twice a quote, not once per use


def test_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice((None, 0.0, rng.uniform(-3, 3), rng.uniform(0, 1e7), 2.5)), float(rng.randint(0, 3))) for g in ("a", "b", None) for _ in range(rng.randint(1, 200))] + [("n", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    asked = {"low": ("x", 0.25), "high": ("x", 0.75), "mid": ("y", 0.5), "least": ("x", 0.0), "most": ("x", 1.0)}
    got = {r["g"]: r for r in D.exact_quantiles(df, asked, by="g").collect()}
    for g in {r[0] for r in rows}:
        for name, (column, q) in asked.items():
            values = sorted(v for r in rows if r[0] == g and (v := r[1 if column == "x" else 2]) is not None)
            wanted = values[max(math.ceil(q * len(values)), 1) - 1] if values else None
            assert got[g][name] == wanted, (g, name)
    assert D.with_thresholds(df, asked, cohort="g").count() == len(rows)


def test_merged_summaries_equal_the_full_mean(spark):
    rng = random.Random(5)
    names = V.metrics_of("analysis")
    rows = [(f"c{rng.randint(0, 2)}", f"v{rng.randint(0, 2)}", *[rng.choice((None, 1.0, 2.25, 3.0, 4.8)) for _ in names]) for _ in range(300)]
    df = spark.createDataFrame(rows, "cohort_id string, version string, " + ", ".join(f"{n} double" for n in names))
    parts = [spark.createDataFrame(rows[i::4], df.schema) for i in range(4)]
    rng.shuffle(parts)
    state = V.summary_state(parts[0], "analysis")
    for part in parts[1:]:
        state = V.merge_states(V.summary_state(part, "analysis"), state)
    key = lambda r: (r["cohort_id"], r["version"])
    got, wanted = sorted(V.summary_of_state(state, "analysis").collect(), key=key), sorted(V.version_summary(df, "analysis").collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in wanted]
    for a, b in zip(got, wanted):
        assert all(a[n] == (b[n] if b[n] is None else pytest.approx(b[n], abs=1e-12)) for n in names)
    assert V.summary_of_state(state, "analysis", last_n=1).count() == 3
