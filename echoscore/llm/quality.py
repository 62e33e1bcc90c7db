"""Document quality rules: a threshold table compiled into column expressions.

Measures of a text (words are runs of bytes other than space and \\t \\n \\v \\f \\r; lines are cut at \\n and count
if they hold a word) come from nested array functions inside the row, so there is no shuffle, no user function, and a hot
source or a very long text costs only its own length. Rules compare integers: ``100 * part`` with ``percent * whole``.

NULL and empty texts have no words: all measures are 0, ``base_failed`` is true. Rows are neither merged nor lost,
whatever their ids; other columns pass through ``filtered`` unchanged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for on was with as it be at by this from or an are "
    "le la les de des et un une en du que est pour dans qui par sur avec pas ce "
    "der die das und zu den von mit ist im nicht ein eine auf es sich als auch "
    "el los las y a con por una se del al lo no su como"
).split()


class Rule(NamedTuple):
    """Keep when ``low`` <= 100 * part / whole <= ``high``; without ``whole`` the bounds are counts."""

    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None


BASE = (
    Rule("too_short", "n_words", low=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=50),
)
RULES = (
    *BASE,
    Rule("word_length", "word_chars", "n_words", low=250, high=1400),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("exclamations", "n_exclamations", "n_words", high=30),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=45),
)


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with the value bound as a lambda's variable, the element of an array of one. It is evaluated once
    per row, wherever the optimiser moves the expression; a column that a filter is pushed through would not be."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _repeated(grams: Column) -> Column:
    """Words covered by windows of three whose hash occurs twice or more, from the array of window hashes.

    Hashes sorted together with their places put equal windows side by side; the places of windows with an
    equal neighbour, in order again, each cover three words minus what the next one covers too.
    """
    last = F.size(grams) - 1

    def covered(pairs: Column) -> Column:
        same = lambda a, b: F.get(pairs, a)["h"] == F.get(pairs, b)["h"]
        kept = F.filter(pairs, lambda p, k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(k, F.least(k + 1, last))))
        return F.array_sort(F.transform(kept, lambda p: p["i"]))

    def total(places: Column) -> Column:
        step = lambda acc, place: F.struct(
            (acc["n"] + F.least(F.lit(3), place + 3 - acc["end"])).alias("n"), (place + 3).alias("end")
        )
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), step, lambda acc: acc["n"])

    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _once(_once(pairs, covered), total)


def _repeat_words(words: Column) -> Column:
    three = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    grams = F.when(F.size(words) > 2, F.transform(F.slice(words, F.lit(1), F.size(words) - 2), three)).otherwise(F.array().cast("array<bigint>"))
    return _once(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _repeated(g)).otherwise(0))


def measures(text: Column) -> Column:
    """Struct of all measures (long) of a text."""
    text = F.coalesce(text, F.lit(""))
    length_without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))

    def of(words: Column, lines: Column) -> Column:
        found = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(text, BLANK, "")),
            "n_symbols": length_without(SYMBOLS),
            "n_exclamations": length_without("!"),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
            "n_repeat_words": _repeat_words(words),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in found.items()])

    words = F.array_remove(F.split(text, BLANK), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return _once(words, lambda w: _once(lines, lambda x: of(w, x)))


def failed(rule: Rule, found: Column) -> Column:
    """True where the measures break the rule."""
    part, whole = found[rule.part], F.lit(1)
    if rule.whole:
        part, whole = part * 100, found[rule.whole]
    broken = F.lit(False)
    if rule.low is not None:
        broken = broken | (part < whole * rule.low)
    if rule.high is not None:
        broken = broken | (part > whole * rule.high)
    return broken


def any_failed(rules: tuple[Rule, ...], found: Column) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | failed(rule, found)
    return out


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures plus ``base_failed``, ``kept`` and the names of all ``broken`` rules; ``row`` holds the input's columns."""
    found = F.col("found")
    names = F.array(*[F.when(failed(r, found), F.lit(r.name)) for r in rules])
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(whole.alias("row"), measures(F.col(f"`{text}`")).alias("found")).select(
        "row", "found.*", any_failed(BASE, found).alias("base_failed"), (~any_failed(rules, found)).alias("kept"),
        F.filter(names, lambda n: n.isNotNull()).alias("broken"),
    )


def filtered(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that break no rule, with the columns of ``df``."""
    return df.where(_once(measures(F.col(f"`{text}`")), lambda found: ~any_failed(rules, found)))
