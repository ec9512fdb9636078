"""Text normalisation for Hindi and Gujarati, as column expressions.

Each function takes and returns a column and works on whole texts inside generated code; only compatibility
case folding needs Python, as Spark has no function for it.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces that become a plain one, and characters of no width that go.
ODD_SPACES, NO_WIDTH = "\u00a0\u2009\u202f", "\u200b\ufeff"

#: What stands for a danda in recognised text.
DANDA, DANDA_LOOKALIKES = "।", "|Il1॥"

#: Dialogue markers and sentence ends by language.
SENTENCE_ENDS = {"hi": ["।", "?", "!", "।।", ")", "]", "}"], "gu": ["।", ".", "?", "!", "।।", ")", "]", "}"]}
PUNCTUATION_ENDS = {"hi": ["।", "?", "!", ":", ")", "]", "}"], "gu": ["।", ".", "?", "!", ":", ")", "]", "}"]}
STOP_PREFIXES = {"hi": ["प्रश्न:", "प्रश्न :", "उत्तर:", "उत्तर :"], "gu": ["શ્રોતા:", "પૂજ્ય ગુરુદેવશ્રી:", "મુમુક્ષુ:", "શંકા:", "પ્રશ્ન:"]}
ANSWER_PREFIXES = {"hi": ["उत्तर:", "उत्तर :"], "gu": ["સમાધાન:", "ઉત્તર:"]}

#: Stop words of the mixed analyzer.
STOP_WORDS = (
    "और या है हैं का की के को में से पर तक साथ बिना अपने अपना अपनी".split()
    + ["के लिए"]
    + "અને કે છે નો ની ના ને માં થી પર માટે સુધી સાથે વિના પોતાના પોતાની પોતાનો".split()
)

#: Nasal letters and the letters they assimilate to.
NASALS = {
    "hi": {"न": "तथदधनसशहयवलरचछजझकखगघ", "ण": "टठडढण", "म": "पफबभम", "ङ": "कखगघ", "ञ": "चछजझ"},
    "gu": {"ન": "તથદધનસશચજઝકખગઘ", "મ": "પફબભમ", "ણ": "ટઠડઢણ"},
}
VIRAMA = {"hi": "्", "gu": "્"}
ANUSVARA = {"hi": "ं", "gu": "ં"}

TOKEN = r"([\p{L}\p{M}\p{N}]+)"


def repair_spaces(text: Column) -> Column:
    return F.translate(text, ODD_SPACES + NO_WIDTH, " " * len(ODD_SPACES))


def repair_dandas(text: Column) -> Column:
    return F.translate(text, DANDA_LOOKALIKES, DANDA * len(DANDA_LOOKALIKES))


def tighten_punctuation(text: Column) -> Column:
    """No space after an opening mark, before a closing one, or before a run of dots."""
    text = F.regexp_replace(text, r"(?U)([(\[{'\"])\s+", "$1")
    text = F.regexp_replace(text, r"(?U)\s+([।.,?!:;)\]}'\"])", "$1")
    return F.regexp_replace(text, r"(?U)\s+(\.{2,})", "$1")


def replace_typos(text: Column, typos: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), typos, text)


def repair_dialogue(text: Column, language: str) -> Column:
    """Writes dialogue markers in full and joins lines that no marker starts."""
    if language == "gu":
        text = F.regexp_replace(text, "મુમુ[^:]*ષુ[^:]*:", "મુમુક્ષુ:")
        starts = STOP_PREFIXES["gu"] + ANSWER_PREFIXES["gu"]
    else:
        text = F.regexp_replace(F.regexp_replace(text, "प्रश[्न]*:", "प्रश्न:"), "उत्त[र]*:", "उत्तर:")
        starts = ["प्रश्न:", "उत्तर:"]
    return F.regexp_replace(text, "\n(?!" + "|".join(starts) + ")", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, language: str, typos: list[tuple[str, str]] = ()) -> Column:
    """The whole chain; null becomes the empty text."""
    text = tighten_punctuation(repair_dandas(repair_spaces(F.coalesce(text, F.lit("")))))
    return squeeze(repair_dialogue(replace_typos(text, list(typos)), language))


def clean_markdown(text: Column) -> Column:
    return strip(F.regexp_replace(repair_spaces(text), " +", " "))


def strip_headers(text: Column, patterns: list[str]) -> Column:
    """Takes each pattern out once where it occurs, then the spaces around what is left."""
    return reduce(strip_once, patterns, text)


def strip_once(text: Column, pattern: str) -> Column:
    start = F.regexp_instr(text, F.lit(pattern))
    found = F.regexp_substr(text, F.lit(pattern))
    rest = F.concat(F.substr(text, F.lit(1), start - 1), F.substr(text, start + F.length(found)))
    return F.when(text.rlike(pattern), strip(rest)).otherwise(text)


def fold_nasals(text: Column, language: str) -> Column:
    """A nasal letter joined to one of its own class becomes the anusvara; both letters are consumed."""
    rules = NASALS[language]
    groups = [f"{n}{VIRAMA[language]}([{letters}])" for n, letters in rules.items()]
    return F.regexp_replace(text, "|".join(groups), ANUSVARA[language] + "".join(f"${k + 1}" for k in range(len(groups))))


def fold_nasals_strict_gu(text: Column) -> Column:
    """Gujarati folding with the two Devanagari slips of the original table: one pair, and one anusvara."""
    text = F.regexp_replace(text, "न्छ", "ंछ")
    return fold_nasals(text, "gu")


def fold_nasals_mixed(text: Column) -> Column:
    return fold_nasals(fold_nasals(text, "hi"), "gu")


def nfkc_casefold(text: Column) -> Column:
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()))

    return fold(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def without_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Tokens as (position, token), so that phrases see the gaps that stop words leave."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("position"), w.alias("token")))
    return F.filter(placed, lambda p: ~p["token"].isin(list(stop)))


def is_english(text: Column, share: float = 0.7) -> Column:
    """Enough of the characters other than spaces are ASCII letters."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    shown = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.coalesce((shown > 0) & (letters >= share * shown), F.lit(False))


def is_running_head(text: Column, position: Column, patterns: list[str]) -> Column:
    """A page's header or footer: short and full of digits, or as the patterns say."""
    digits = F.regexp_count(text, F.lit("[0-9०-९]"))
    n = F.length(text)
    by_pattern = reduce(lambda a, p: a | text.rlike(p), patterns, F.lit(False))
    return ((position == 0) & (n < 35) & (digits > 2)) | ((n > 0) & (n < 20) & (digits >= 0.3 * n)) | by_pattern


def is_header_line(text: Column, centered: Column, patterns: list[str], most: int = 10) -> Column:
    return reduce(lambda a, p: a | text.rlike(p), patterns, centered & (F.length(strip(text)) <= most))
