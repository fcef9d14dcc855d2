"""Quality rules: a table of thresholds compiled into one Spark projection.

No user functions: words, lines and windows are arrays made by built-in functions. ``let`` binds
an array to a lambda variable, so that it is made once however often it is used.

A document fails the base rules if it has fewer than 50 words, or if over half of its words lie
in 3-word windows that occur twice or more in it. It is kept if it passes these and every row of
``RULES``. A metric that does not apply to a document is null and passes. The ratio of stop words
to words applies from ``STOP_WORDS_FROM`` words on, and only to texts in a language of
``STOP_WORDS``: by the label in ``lang`` if there is one, and by script (over half of the letters
in another script than theirs, which is Latin, is another language). Shorter texts, tables above
all, may well have no stop word; ``QUALITY_SQL`` keeps them as well.

Edge cases: a null or empty text has no words, so it fails. A text without a newline is one line.
The result has one row for each row; order and repeated rows do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import WORD, with_results

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of some languages, in lower case.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "zu", "den", "von", "ein"],
    "fr": ["le", "la", "de", "et", "les", "des", "est", "en", "un", "que"],
    "es": ["el", "de", "que", "y", "los", "se", "en", "una", "del", "las"],
}
STOP_WORDS_FROM = 200
#: A text with this ratio is in a listed language: its script is not looked at.
STOP_WORDS_PLAIN = 0.05
NO_LABEL = ["", "und"]


@dataclass(frozen=True)
class Rule:
    """Reject where the metric is under ``least`` or over ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("short words", "mean_word_length", least=1.5),
    Rule("long words", "mean_word_length", most=25),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("repeated lines", "dup_line_ratio", most=0.70),
    Rule("stop words", "stop_word_ratio", least=0.005),
)
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def repeated_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more: the windows with their places are
    sorted, and each is compared with its neighbours."""
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        hit = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]), x["i"]))
        hit = F.filter(hit, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

    return F.when(n >= 3, let(F.array_sort(windows), places)).otherwise(F.lit(0))


def listed(text: Column, lang: Column | None) -> Column:
    """Is the text in a language that ``STOP_WORDS`` has, as far as label and script tell?"""
    letters, latin = (F.length(F.regexp_replace(text, x, "")) for x in (r"\P{L}+", r"\P{IsLatin}+"))
    out = 2 * latin >= letters
    if lang is None:
        return out
    label = F.lower(F.regexp_extract(F.coalesce(lang.cast("string"), F.lit("")), "^[A-Za-z]*", 0))
    return label.isin(*NO_LABEL, *STOP_WORDS) & out


def metrics(text: Column, lang: Column | None = None) -> Column:
    """A struct of the base columns and of the metrics that the rules name."""
    text = F.coalesce(text, F.lit(""))
    chars, symbols = (F.length(text) - F.length(F.translate(text, x, "")) for x in (SPACES, SYMBOLS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    stops = sorted({w for own in STOP_WORDS.values() for w in own})
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        found = F.size(F.filter(w, lambda x: F.lower(x).isin(*stops)))
        return F.struct(n.alias("n"), repeated_words(w, n).alias("repeated"), ratio(found, n).alias("stops"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    def all_of(c: Column) -> Column:
        w, x = c["words"], c["lines"]
        word_chars = F.length(text) - c["blank"]
        base = (w["n"], word_chars, c["symbols"], x["dup"], w["repeated"])
        failed = (w["n"] < 50) | (100 * w["repeated"].cast("bigint") > 50 * w["n"].cast("bigint"))
        return F.struct(
            *(v.cast("bigint").alias(k) for k, v in zip(BASE_COLUMNS, base)),
            failed.alias("base_failed"),
            ratio(word_chars, w["n"]).alias("mean_word_length"),
            ratio(c["symbols"], word_chars).alias("symbol_ratio"),
            ratio(x["dup"], x["n"]).alias("dup_line_ratio"),
            F.when((w["n"] >= STOP_WORDS_FROM) & ((w["stops"] >= STOP_WORDS_PLAIN) | listed(text, lang)), w["stops"]).alias("stop_word_ratio"),
        )

    parts = F.struct(let(words_of(text), of_words).alias("words"), let(lines, of_lines).alias("lines"), chars.alias("blank"), symbols.alias("symbols"))
    return let(parts, all_of)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The base rules and the threshold table as one expression over a struct of metrics. What
    does not apply (null) passes."""
    out = ~m["base_failed"]
    for rule in rules:
        if rule.least is not None:
            out = out & F.coalesce(m[rule.metric] >= rule.least, F.lit(True))
        if rule.most is not None:
            out = out & F.coalesce(m[rule.metric] <= rule.most, F.lit(True))
    return out


def _label(docs: DataFrame, lang_col: str) -> Column | None:
    return F.col(lang_col) if lang_col in docs.columns else None


def rated(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input columns with the base columns, the rules' metrics and ``kept``."""
    names = [*BASE_COLUMNS, *dict.fromkeys(r.metric for r in rules)]
    keep = [c for c in with_results(docs, [*names, "kept", "_m"])]
    out = docs.select(*(F.col(f"`{c}`") for c in keep), metrics(F.col(text_col), _label(docs, lang_col)).alias("_m"))
    return out.select(*(F.col(f"`{c}`") for c in keep), *(F.col("_m")[n].alias(n) for n in names), verdict(F.col("_m"), rules).alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that are kept, with their own columns. The whole verdict is one predicate, so the
    metrics are worked out once, in the filter."""
    return docs.where(let(metrics(F.col(text_col), _label(docs, lang_col)), lambda m: verdict(m, rules)))
