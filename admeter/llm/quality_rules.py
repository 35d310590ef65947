"""Quality rules whose cutoffs follow the data of each language and source.

1. ``measure`` counts words, symbols, repeated lines and repeated words of each text.
2. ``sketches`` turns four ratios, in thousandths, into mergeable quantile sketches: counts of log-linear
   bins (exact below 64, then 32 bins for each power of two), so quantiles are off by 1/32 at most, any
   two sketches merge by adding counts, and the result depends neither on order nor on retries.
3. ``cutoffs`` reads the median and a high quantile (``HIGH``) from the sketch of each (language, source), or from the merged
   sketch of the language, then of everything, where fewer than ``MIN_DOCS`` documents were counted.  A cutoff is
   the high quantile plus ``SPREADS`` times its distance from the median, which counts as the least spread in ``RULES`` at
   least.  No cutoff is fixed: a group that is full of symbols or repeats has a higher one than a group without.
4. ``judge`` joins the cutoffs to the documents.

Fixed meaning of edge cases: a null text has no words and fails; null languages and sources are groups of
their own; repeated rows count each; in a group without documents that pass the base rules there is nothing left to judge;
an empty table gives an empty result; an input column with the name of the output struct is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, Words, mixed, saved, small_batches, without

#: The base rules.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Documents that a group's own sketch must have counted; the high quantile as a fraction, and how many spreads above it are kept.
MIN_DOCS, HIGH, SPREADS = 200, (4, 5), 3
#: Ratio: numerator, denominator, what is added to the denominator so that one symbol or line of a short text weighs little, and the
#: least spread, in thousandths.
RULES = {
    "symbols": ("n_symbols", "n_words", 20, 25),
    "dup_lines": ("n_dup_lines", "n_lines", 5, 50),
    "repeats": ("n_repeat_words", "n_words", 20, 45),
    "word_length": ("word_chars", "n_words", 0, 800),
}
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"

_hashes = WordHashes()


def repeat_words(words: Words) -> np.ndarray:
    """Per text, the words in windows of ``WINDOW`` words that are found twice or more in the text."""
    windows = words.windows(WINDOW)
    at = np.flatnonzero(words.left[:len(windows)] >= WINDOW)
    own = mixed(words.text[at].astype(np.uint64) + np.uint64(1))
    _, group, count = np.unique(windows[at] + own, return_inverse=True, return_counts=True)
    found = at[count[group] > 1]
    edge = np.zeros(len(words.hash) + 1, np.int32)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    return np.bincount(words.text, weights=np.cumsum(edge)[:-1] > 0, minlength=len(words.count)).astype(np.int64)


def measured(texts: list[str | None]) -> pa.Array:
    raw = [t.encode() if t else b"" for t in texts]
    words = Words(raw, _hashes)
    chars = [len(t) - sum(map(t.count, " \t\n\v\f\r")) if t else 0 for t in texts]
    symbols = [sum(map(t.count, SYMBOLS)) for t in raw]
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in raw]
    columns = [words.count, chars, symbols, [len(x) for x in lines], [len(x) - len(set(x)) for x in lines], repeat_words(words)]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], [m.split()[0] for m in MEASURES.split(", ")])


def measure(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``df`` with a struct of measures, also of ``base_failed``."""
    small_batches(df.sparkSession)

    @F.arrow_udf(f"struct<{MEASURES.replace(' bigint', ': bigint')}>")
    def counts(texts: pa.Array) -> pa.Array:
        return measured(texts.to_pylist())

    kept = without(df, out)
    q = F.col(out)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"])
    return kept.withColumn(out, counts(df[text].cast("string"))).withColumn(out, q.withField("base_failed", failed))


def ratio(q: Column, rule: str) -> Column:
    """In thousandths, rounded down; 0 where there is nothing to divide by."""
    above, below, more, _ = RULES[rule]
    return F.when(q[below] > 0, F.floor(1000 * q[above] / (q[below] + more))).otherwise(F.lit(0)).cast("bigint")


def bin_of(value: Column) -> Column:
    """The least value of the bin of a value: itself below 64, else its six leading bits."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def sketches(measures: DataFrame, lang: str = "lang", source: str = "source", out: str = "quality") -> DataFrame:
    """Rows (lang, source, rule, bin, n) over the documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(r).alias("rule"), bin_of(ratio(F.col(out), r)).alias("bin")) for r in RULES])
    rows = measures.where(~F.col(f"{out}.base_failed")).select(
        F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.explode(each).alias("x"))
    return rows.groupBy("lang", "source", "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches by ``keys`` and rule; the count, the median and the high quantile of each."""
    merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "rule")
    running = merged.withColumns({"upto": F.sum("n").over(part.orderBy("bin")), "docs": F.sum("n").over(part)})
    return running.groupBy(*keys, "rule").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(2 * F.col("upto") >= F.col("docs"), F.col("bin"))).alias("median"),
        F.min(F.when(HIGH[1] * F.col("upto") >= HIGH[0] * F.col("docs"), F.col("bin"))).alias("high"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with a cutoff for each rule."""
    own, language, whole = (quantiles(sketch, k) for k in (["lang", "source"], ["lang"], []))
    names = ("docs", "median", "high")
    language = language.select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), *[F.col(c).alias(f"l_{c}") for c in names])
    whole = whole.select(F.col("rule").alias("w_rule"), *[F.col(c).alias(f"w_{c}") for c in names])
    both = own.join(language, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(
        whole, F.col("rule") == F.col("w_rule"))

    def chosen(name: str) -> Column:
        return F.when(F.col("docs") >= MIN_DOCS, F.col(name)).when(F.col("l_docs") >= MIN_DOCS, F.col(f"l_{name}")).otherwise(F.col(f"w_{name}"))

    def cutoff(least: int) -> Column:
        return chosen("high") + SPREADS * F.greatest(chosen("high") - chosen("median"), F.lit(least))

    return both.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rule") == r, cutoff(least))).alias(r) for r, (_, _, _, least) in RULES.items()])


def judge(measures: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", out: str = "quality") -> DataFrame:
    """``measures`` with ``kept`` in the struct: base rules passed, and no ratio above its group's cutoff."""
    side = limits.select(F.struct("lang", "source", *RULES).alias("_limits"))
    found = measures.join(side, F.col(lang).eqNullSafe(F.col("_limits.lang")) & F.col(source).eqNullSafe(F.col("_limits.source")), "left")
    q, passed = F.col(out), ~F.col(f"{out}.base_failed")
    for r in RULES:
        passed &= F.coalesce(ratio(q, r) <= F.col(f"_limits.{r}"), F.lit(True))
    return found.withColumn(out, q.withField("kept", passed)).drop("_limits")


def apply(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` with the struct ``quality``.  The narrow measures are written once for the sketches, and the cutoffs, a row
    per group, so that their size is known when the join is planned; the texts are measured again for the verdict
    instead of being written."""
    measures = measure(df, text)
    narrow = saved(measures.select(F.col(lang).alias("lang"), F.col(source).alias("source"), "quality"), "quality-measures")
    return judge(measures, saved(cutoffs(sketches(narrow)), "quality-cutoffs"), lang, source)


def filtered(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that pass, with its columns, whatever their names."""
    rows = df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("_row"))
    judged = apply(rows, "_row.text", "_row.lang", "_row.source").where(F.col("quality.kept"))
    return judged.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def report(df: DataFrame) -> DataFrame:
    """Measures and verdict of every document, without its text.  The narrow measures are written once."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    measures = saved(measure(df).select("doc_id", "lang", "source", "quality"), "quality-measures")
    judged = judge(measures, saved(cutoffs(sketches(measures)), "quality-cutoffs"))
    return judged.select("doc_id", *[f"quality.{n}" for n in names])
