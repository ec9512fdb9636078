"""Quality rules: a threshold table compiled into one projection.

A rule names a measure of the text and the range that it must lie in. `measures` builds every measure
from built-in functions only, `verdict` folds the table into one boolean column. There is no shuffle:
each row is judged from its own text.

Null or empty texts have no words and fail the base rule; repeated rows are judged alike; a null id stays; other columns
of the input are never looked at; an empty table gives no rows. A text of any length is judged whole: no rule rejects it for
being long, and its windows are sorted once. A measure right at a threshold passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import let, words_of

#: Frequent function words by language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "as", "with", "at", "be", "this", "from", "or", "by", "an", "not", "have", "has", "but", "his", "they", "which", "you", "were", "her", "all", "she", "there", "would", "their", "we", "him", "been", "had", "he", "i"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "dans", "pour", "par", "pas", "sur", "au", "aux", "avec", "ce", "il", "elle", "ne", "se", "son", "sa", "plus", "ou", "mais", "sont", "nous", "vous", "ont"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "im", "des", "ein", "eine", "als", "für", "auf", "nicht", "dem", "es", "sich", "auch", "an", "er", "sie", "so", "aus", "bei", "nach", "wird", "sind", "einer", "wie", "oder", "ich", "wir"],
    "es": ["el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "es", "se", "por", "con", "para", "no", "al", "lo", "su", "como", "más", "o", "pero", "sus", "le", "ya", "este", "sí", "ha", "son", "muy", "sin", "sobre", "me"],
}

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; None leaves that side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word unless the name says lines.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_words_per_word", 0.03, None),
    Rule("dup_lines_per_line", None, 0.5),
    Rule("bullet_lines_per_line", None, 0.9),
    Rule("ellipsis_lines_per_line", None, 0.3),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of so many words that occurs twice or more, the first included.

    Windows are told apart by a 64-bit hash. Texts without a repeated window, nearly all, stop after one
    distinct; others sort (hash, position) once, so long texts cost n log n.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = let(
            pairs,
            lambda s: F.transform(
                s,
                lambda e, i: F.when(
                    (F.when(i > 0, F.get(s, i - 1)["h"]) == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"]
                ),
            ),
        )
        at = F.sort_array(F.filter(marked, lambda p: p.isNotNull()))
        spans = let(at, lambda a: F.transform(a, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(a, i + 1) - p, F.lit(window)))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x)

    none = F.lit(0).cast("long")
    return F.when(
        F.size(words) > window,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))),
    ).otherwise(none)


def measures(text: Column) -> Column:
    """A struct of every measure of a text: counts as longs, ratios as doubles (0 where undefined)."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    count = lambda c: c.cast("long")

    def from_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, r"[ \x09-\x0D]+", "")) > 0)
        stripped = reduce(lambda t, c: F.replace(t, F.lit(c)), " \t\n\v\f\r", text)

        def from_lines(ln: Column) -> Column:
            n, n_lines, chars, symbols = count(F.size(w)), count(F.size(ln)), count(F.length(stripped)), count(F.regexp_count(text, F.lit(SYMBOLS)))
            dup = n_lines - F.size(F.array_distinct(ln))
            stop = count(F.size(F.filter(w, lambda x: x.isin(stops))))
            bullets = F.size(F.filter(ln, lambda x: x.rlike(r"^\s*[-*•]")))
            dots = F.size(F.filter(ln, lambda x: x.rlike("(\\.\\.\\.|…)\\s*$")))
            return F.struct(
                n.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dup.alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"), n_lines.alias("n_lines"), stop.alias("n_stop_words"),
                ratio(chars, n).alias("mean_word_chars"), ratio(symbols, n).alias("symbols_per_word"),
                ratio(stop, n).alias("stop_words_per_word"), ratio(dup, n_lines).alias("dup_lines_per_line"),
                ratio(bullets, n_lines).alias("bullet_lines_per_line"), ratio(dots, n_lines).alias("ellipsis_lines_per_line"),
            )

        return let(lines, from_lines)

    return let(words_of(text), from_words)


def base_failed(m: Column) -> Column:
    """Under 20 words, or over 30 % of the words in repeated windows."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The base rule and every rule of the table, as one boolean."""
    ok = ~base_failed(m)
    for rule in rules:
        if rule.low is not None:
            ok = ok & (m[rule.measure] >= rule.low)
        if rule.high is not None:
            ok = ok & (m[rule.measure] <= rule.high)
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: its id, the measures, base_failed and kept."""
    m = F.col("m")
    return docs.select(F.col(id_col), measures(F.col(text_col)).alias("m")).select(
        id_col, "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        base_failed(m).alias("base_failed"), verdict(m, rules).alias("kept"),
        "m.n_lines", "m.n_stop_words",
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs whose text passes, with all their columns."""
    return docs.where(let(measures(F.col(text_col)), lambda m: verdict(m, rules)))
