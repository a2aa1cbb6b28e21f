"""Operator 5: quality rules as one Spark projection.

Method. A threshold table (a rule is a name, a ratio of two measures and its
bounds) is compiled into one projection of built-in functions: lengths, symbols,
stop words, lines and repeats of the whole text. No user function, no shuffle.

Defined cases: a null text counts as empty; an empty text has all measures 0 and
fails the base rule of 20 words; a ratio over 0 words is 0; texts of any length
are measured whole; repeated rows are judged alike; other columns pass untouched
(measures come in one struct column, so names cannot clash inside the projection).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serion.llm.storage import free_name

#: Words that running prose of the corpus languages cannot avoid (fixed values).
STOP_WORDS = (
    "the of and to in is was for that with it as on by at this are be from or an a not "
    "der die das und in von zu mit den ist nicht ein eine auf für dem sich des im als "
    "de la le et les des en un une du que qui dans est pour par sur au pas avec "
    "de la el y en que los se del las un por con no una su para es al lo como"
).split()

#: Marks that may stand around a stop word.
MARKS = ".,;:!?()'\"«»„“”"

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8


class Rule(NamedTuple):
    """Keeps a text if low <= measure / per <= high; None: no bound."""

    name: str
    measure: str
    per: str
    low: float | None
    high: float | None


#: The threshold table. Every bound is far from what prose of any language shows.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.1),
    Rule("stop words per word", "n_stop_words", "n_words", 0.04, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _repeat_words(n: Column, words: Column) -> Column:
    """Words inside windows of REPEAT_WINDOW words that the text has twice or more."""
    w = REPEAT_WINDOW
    hashes = F.transform(words, lambda x: F.xxhash64(x))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - (w - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(w)]))

    # starts of repeated windows: sort (hash, start), keep those equal to a neighbour
    def starts(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def kept(sorted_pairs: Column) -> Column:
            m = F.size(sorted_pairs)

            def same(i: Column) -> Column:
                here = F.element_at(sorted_pairs, i + 1)["h"]
                before = (i > 0) & (F.element_at(sorted_pairs, F.greatest(i, F.lit(1)))["h"] == here)
                after = (i + 1 < m) & (F.element_at(sorted_pairs, F.least(i + 2, m))["h"] == here)
                return before | after

            return F.sort_array(F.transform(F.filter(sorted_pairs, lambda x, i: same(i)), lambda x: x["i"]))

        return _let(pairs, kept)

    # each start covers the words up to the next start, w at most; the last one covers w
    def covered(s: Column) -> Column:
        m = F.size(s)
        steps = F.transform(s, lambda x, i: F.when(i + 1 == m, F.lit(w)).otherwise(F.least(F.lit(w), F.element_at(s, F.least(i + 2, m)) - x)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(starts(h), covered))

    return F.when(n < 2 * 1 + w - 1, F.lit(0)).otherwise(_let(_let(hashes, windows), counted))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def measures(text: Column) -> Column:
    """One struct of all measures of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column, lines: Column) -> Column:
        n = F.size(w)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(n, w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.trim(F.lower(x), F.lit(MARKS)).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(_words(text), lambda w: _let(lines, lambda x: of_words(w, x)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    kept = F.lit(True)
    for r in rules:
        ratio = F.when(m[r.per] > 0, m[r.measure] / m[r.per]).otherwise(F.lit(0.0))
        if r.low is not None:
            kept = kept & (ratio >= r.low)
        if r.high is not None:
            kept = kept & (ratio <= r.high)
    return kept


def with_quality(df: DataFrame, *, text_col: str = "text", out: str = "quality") -> DataFrame:
    """df and a struct column ``out``: the measures, base_failed and kept."""
    # one expression from text to verdict: a filter on it, pushed to the scan, measures each text once
    judged = _let(measures(F.col(text_col)), lambda m: F.struct(*[m[n].alias(n) for n in MEASURES], base_failed(m).alias("base_failed"), (~base_failed(m) & compile_rules(m)).alias("kept")))
    return df.withColumn(out, judged)


def keep_good(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Rows of df that the rules keep; the columns stay as they were."""
    name = free_name(df, "quality")
    return with_quality(df, text_col=text_col, out=name).where(F.col(name)["kept"]).drop(name)
