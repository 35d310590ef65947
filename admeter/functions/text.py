"""Text helpers used by the reply checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A figure as reports write it: optional sign and $, thousands separators, decimals, and what it is counted in.  A figure glued to
# a letter ("Q4", "B2B") is not taken.  Possessive, so that no figure is taken for a part of itself.
AMOUNT = r"-?\$?(?:\d{1,3}(?:,\d{3})++|\d++)(?:\.\d++)?+(?:%|(?i:x|k|m|bn)(?![A-Za-z0-9_]))?+"
FIGURE = rf"(?<![A-Za-z0-9_.,]){AMOUNT}(?![A-Za-z0-9_])"
# --- fixed values: words around figures ---------------------------------------
MULTIPLIERS = {"k": 1e3, "m": 1e6, "bn": 1e9}
APPROXIMATE = ("about", "around", "roughly", "nearly", "almost", "approximately", "circa")
# A number after such a word names a time or a place in a list, it is no figure.
DATED = ("week", "day", "month", "quarter", "step", "card", "page", "top", "phase")
YEAR_WORDS = ("in", "since", "during", "of", "by", "until", "from", "to", "for", "year", "fy", "q1", "q2", "q3", "q4")
ABBREVIATIONS = ("vs", "approx", "excl", "incl", "avg", "no", "e\\.g", "i\\.e")
# ------------------------------------------------------------------------------


# Word edges that also hold next to accented letters, unlike \\b.
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"


def join_regex_words(words) -> str:
    """A case-insensitive pattern matching any of the words as whole words.

    A look at the first letter comes first: it rules out most positions of a
    long text at once.
    """
    first = "".join(sorted({c for w in words for c in (w[0].lower(), w[0].upper())}))
    return rf"(?=[{first}]){WORD_START}(?i:{'|'.join(words)}){WORD_END}"


def count_words(col: Column, words) -> Column:
    """How often any of ``words`` occurs in a text, as whole words."""
    return F.coalesce(F.regexp_count(col, F.lit(join_regex_words(words))), F.lit(0)).cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def unit_of(figure: Column) -> Column:
    """What a quoted figure is counted in: "%", "x", "k", "m", "bn", else "$" or ""."""
    suffix = F.lower(F.regexp_extract(figure, r"(%|[xX]|[kKmM]|[bB][nN])$", 1))
    return let(suffix, lambda s: F.when(s != "", s).when(figure.contains("$"), "$").otherwise(""))


def times_of(unit: Column) -> Column:
    times = F.lit(1.0)
    for name, value in MULTIPLIERS.items():
        times = F.when(unit == name, value).otherwise(times)
    return times


def value_of(figure: Column) -> Column:
    """The number that a quoted figure stands for; percentages as they are written."""
    return F.regexp_replace(figure, r"[$,%xXkKmMbBnN]", "").try_cast("double") * let(unit_of(figure), times_of)


def numbers_in(col: Column) -> Column:
    """Figures quoted in a text: ``ARRAY<STRUCT<figure, value, percent>>``."""
    found = F.regexp_extract_all(col, F.lit(FIGURE), 0)
    return F.transform(found, lambda t: F.struct(t.alias("figure"), value_of(t).alias("value"), t.endswith("%").alias("percent")))


def clauses(col: Column) -> Column:
    """A lower-case text cut where a sentence, a line or a semicolon ends, but not within brackets, numbers and abbreviations."""
    # a look at the character first: only before a full stop is it asked what stands before it
    ends = rf"(?:[!?;\n\r]|(?=\.)(?<!\b(?:{'|'.join(ABBREVIATIONS)}))\.(?!\d))(?![^()\n]{{0,80}}\))"
    return F.split(F.lower(col), ends)


def bound_figures(col: Column, names) -> Column:
    """Figures with the name that each is a figure of: ``ARRAY<STRUCT<clause, name, quote>>``.

    ``names`` are the names that figures may be bound to, as they are written; a space in them stands for an underscore too.  Each
    clause is read as a short list of tokens: names, quotes (figures, ranges and approximate figures), commas and brackets, and
    folded from front to back.  A figure goes to the last name before it; to the name that follows directly ("a 4% refund rate")
    if no name waits for one; within brackets to a name within them first.  After a comma a name that has its figure is done.
    Names of times ("Q3", "in 2024", "week 12") are no figures.
    """
    spelled = sorted({n.lower().replace("_", " ") for n in names}, key=len, reverse=True)
    name = join_regex_words([n.replace(" ", "[ _]") for n in spelled])
    dated = (rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{'|'.join(YEAR_WORDS)})\s++(?:19|20)\d\d|(?:{'|'.join(DATED)})\s++\d++)(?![\d%]|[.,]\d)")
    span = rf"(?<![\p{{L}}\p{{N}}_])between\s++{AMOUNT}\s++and\s++{AMOUNT}|(?<![A-Za-z0-9_.,]){AMOUNT}\s?[–—]\s?{AMOUNT}"
    about = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(APPROXIMATE)})\s++{AMOUNT}"
    quote = rf"(?:{span}|{about}|{FIGURE})"
    # each of them starts with a sign or where a word does: one look rules out all places within words
    tokens = rf"(?:(?=[-$\d(),])|{WORD_START})(?:{dated}|{quote}(?:\s++{name})?+|{name}|[(),])"
    starts = rf"^(?:{span}|{about}|{AMOUNT})"
    text = F.lit(None).cast("string")
    one = F.struct(text.alias("name"), text.alias("quote"))
    start = F.struct(text.alias("outer"), F.lit(False).alias("used"), text.alias("inner"), F.lit(False).alias("within"),
                     F.filter(F.array(one), lambda _: F.lit(False)).alias("out"))

    # step by step, so that each pattern is matched once a token: what an expression names twice is computed twice
    def parts(found: Column) -> Column:
        timed = F.transform(found, lambda t: F.struct(t.alias("token"), t.rlike(rf"^(?:{dated})$").alias("timed")))
        matched = F.transform(timed, lambda t: F.struct(
            t["token"].alias("token"), F.when(~t["timed"], F.regexp_extract(t["token"], starts, 0)).alias("figure"),
            F.when(~t["timed"] & t["token"].rlike(rf"{name}$"), F.regexp_replace(F.trim(F.regexp_replace(t["token"], starts, "")), "[ _]+", "_")).alias("word")))
        return F.transform(matched, lambda t: F.struct(t["token"].alias("token"), F.when(t["figure"] != "", t["figure"]).alias("figure"), t["word"].alias("word")))

    def read(state: Column, one: Column) -> Column:
        token, figure, word = one["token"], one["figure"], one["word"]
        within, waiting = state["within"], state["outer"].isNotNull() & ~state["used"]
        follows = figure.isNotNull() & word.isNotNull() & (within | ~waiting)
        owner = F.when(follows, word).when(within, F.coalesce(state["inner"], state["outer"])).otherwise(state["outer"])
        named = word.isNotNull()
        comma, opens, closes = token == ",", token == "(", token == ")"
        return F.struct(
            F.when(named & ~within, word).when(comma & ~within & state["used"], text).otherwise(state["outer"]).alias("outer"),
            F.when(within, state["used"]).when(named, follows).when(comma, F.lit(False)).when(figure.isNotNull() & state["outer"].isNotNull(), F.lit(True))
            .otherwise(state["used"]).alias("used"),
            F.when(opens | closes, text).when(named & within, word).otherwise(state["inner"]).alias("inner"),
            F.when(opens, F.lit(True)).when(closes, F.lit(False)).otherwise(within).alias("within"),
            F.when(figure.isNotNull(), F.array_append(state["out"], F.struct(owner.alias("name"), figure.alias("quote")))).otherwise(state["out"]).alias("out"))

    def fold(clause: Column, place: Column) -> Column:
        found = F.aggregate(parts(F.regexp_extract_all(clause, F.lit(tokens), 0)), start, read, lambda state: state["out"])
        return F.transform(found, lambda f: F.struct(place.alias("clause"), f["name"].alias("name"), f["quote"].alias("quote")))

    return F.flatten(F.transform(clauses(col), fold))
