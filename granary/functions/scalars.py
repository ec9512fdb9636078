"""Scalar functions: identities, dates, names, scores and small parsers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of addresses in the UUID standard.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

#: Language names and codes, and the text column of each language.
LANGUAGE_CODES = {"hindi": "hi", "gujarati": "gu"}
TEXT_FIELDS = {
    "hi": "text_content_hindi", "sa": "text_content_sanskrit", "gu": "text_content_gujarati", "pa": "text_content_punjabi",
    "bn": "text_content_bengali", "ta": "text_content_tamil", "te": "text_content_telugu", "ml": "text_content_malayalam",
    "kn": "text_content_kannada", "or": "text_content_oriya", "mr": "text_content_marathi",
}

#: Kinds of verses, and headings that a verse may have.
VERSE = r"(?i)^(Shlok|Gatha|Kalash|Sutra|Chhand)\s+(\d+)(?:-(\d+))?"
SECTIONS = ["Translation", "Meaning", "Teeka", "Bhavarth", "Sanskrit Teeka"]
PAGE_HEADING = r"(?i)^Page\s+Number\s*-?\s*(\d+)$"


def uuid5_url(path: Column) -> Column:
    """The version 5 UUID of a path in the namespace of addresses."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(path, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def pages_checksum(path: Column, pages: Column) -> Column:
    """Of a path and its valid pages in order; empty without a path or a valid page."""
    valid = F.array_sort(F.filter(F.coalesce(pages, F.array().cast("array<int>")), lambda p: p > 0))
    text = F.concat(path, F.lit(":"), F.array_join(F.transform(valid, lambda p: p.cast("string")), ","))
    return F.when(F.coalesce(path, F.lit("")).eqNullSafe("") | (F.size(valid) == 0), F.lit("")).otherwise(F.sha2(text, 256))


def map_checksum(config: Column) -> Column:
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config)))), 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def display_path(path: Column) -> Column:
    """The last two parts of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def language_code(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(name)), name)


def text_field(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TEXT_FIELDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.lit(TEXT_FIELDS["hi"]))


def chunk_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("dd-MM-yyyy")))


def metadata_date(text: Column) -> Column:
    """Day-first dates become ISO; all else stays."""
    return F.coalesce(F.date_format(chunk_date(text), "yyyy-MM-dd"), text)


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")


def year_bounds(start: Column, end: Column) -> Column:
    return F.struct(F.make_date(start, F.lit(1), F.lit(1)).alias("first"), F.make_date(end, F.lit(12), F.lit(31)).alias("last"))


def verse_heading(text: Column) -> Column:
    """(type, start, end) of a verse heading, or null."""
    start = F.regexp_extract(text, VERSE, 2).try_cast("int")
    end = F.regexp_extract(text, VERSE, 3).try_cast("int")
    return F.when(text.rlike(VERSE), F.struct(F.initcap(F.regexp_extract(text, VERSE, 1)).alias("type"), start.alias("start_num"), F.coalesce(end, start).alias("end_num")))


def page_heading(text: Column) -> Column:
    return F.regexp_extract(text, PAGE_HEADING, 1).try_cast("int")


def checked_section(name: Column) -> Column:
    """The name, or an error if no verse may have such a section."""
    wrong = F.raise_error(F.concat(F.lit("Invalid section heading: "), name))
    return F.when(name.isin(SECTIONS) | name.rlike(PAGE_HEADING), name).otherwise(wrong.cast("string"))


def log_escape(query: Column) -> Column:
    return F.translate(query, ",\"\n\r", ";' ")


def elapsed(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def cost(pages: Column, engine: Column, rate: float = 0.13) -> Column:
    return F.format_string("%.2f", F.when(engine == "cloud", pages * F.lit(rate)).otherwise(F.lit(0.0)))


def english_suffix(text: Column, cursor: Column) -> Column:
    return F.regexp_extract(F.substr(text, F.lit(1), cursor), "([A-Za-z]+)$", 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def is_private_ip(ip: Column) -> Column:
    """Own and malformed addresses too."""
    parts = F.split(ip, r"\.")
    n = F.transform(parts, lambda p: p.try_cast("int"))
    inside = (F.get(n, F.lit(0)) == 10) | ((F.get(n, F.lit(0)) == 172) & F.get(n, F.lit(1)).between(16, 31)) | ((F.get(n, F.lit(0)) == 192) & (F.get(n, F.lit(1)) == 168))
    return F.coalesce(ip.isin("localhost", "127.0.0.1", "::1", "unknown") | (F.size(parts) != 4) | F.exists(n, lambda x: x.isNull()) | inside, F.lit(True))


def is_lexical_query(query: Column, exact: Column | None = None, excluded: Column | None = None) -> Column:
    """Short and without punctuation; an exact match or excluded words always go to the lexical side."""
    plain = ~query.rlike(r"[!-/:-@\[-`{-~।॥]") & (F.size(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")) < 4)
    if exact is not None:
        plain = plain | exact
    if excluded is not None:
        plain = plain | (F.size(excluded) > 0)
    return plain


def page_links(total: int, current: int) -> list[int | None]:
    """Pages to show in a pager: all up to 7; else the first and last two and the current one's neighbours, None for a gap."""
    if total <= 7:
        return list(range(1, total + 1))
    shown = sorted({p for p in (1, 2, current - 1, current, current + 1, total - 1, total) if 1 <= p <= total})
    return [x for a, b in zip(shown, [*shown[1:], shown[-1] + 1], strict=True) for x in ([a] if b - a <= 1 else [a, None])]
