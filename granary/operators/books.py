"""Marked-up books: headings and paragraphs to nested verses and prose, and from there to chunks.

Books are small and independent, so each is parsed where it is read: the markup is turned into elements with regular
expressions, and one pass over the elements deals them to the part and subheading each belongs to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from granary.functions.scalars import PAGE_HEADING, SECTIONS, VERSE

BOOK = (
    "verses array<struct<seq_num:int,verse:string,type:string,type_start_num:int,type_end_num:int,translation:string,language:string,meaning:string,"
    "teeka:array<string>,bhavarth:array<string>,page_num:int,adhikar:string>>,"
    "prose_sections array<struct<seq_num:int,heading:string,content:array<string>,"
    "subsections:array<struct<seq_num:int,heading:string,content:array<string>,page_num:int,adhikar:string>>,page_num:int,adhikar:string>>"
)


_SPACES = {0xA0: " ", 0x2009: " ", 0x202F: " ", 0x200B: None, 0xFEFF: None}


def clean(text: str) -> str:
    if not text.isascii():
        text = text.translate(_SPACES)
    return (re.sub(" +", " ", text) if "  " in text else text).strip()


_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_EMPHASIS = re.compile(r"(\*\*|__|\*|`)(\S(?:.*?\S)?)\1")
_BULLET, _NUMBER, _QUOTE = re.compile(r"[-*+] "), re.compile(r"\d+\. "), re.compile(r"> ?")


def _block(lines: list[str]) -> tuple[str, str]:
    if all(x[:1] == ">" for x in lines):
        tag, mark = "blockquote", _QUOTE
    elif all(map(_BULLET.match, lines)):
        tag, mark = "ul", _BULLET
    elif all(map(_NUMBER.match, lines)):
        tag, mark = "ol", _NUMBER
    else:
        return "p", "\n".join(lines)
    return tag, "\n".join(x[mark.match(x).end() :] for x in lines)


def _blocks(markdown: str) -> Iterator[tuple[str, str]]:
    lines: list[str] = []
    for line in markdown.split("\n"):
        heading = _HEADING.match(line) if line[:1] == "#" else None
        if not heading and line.strip():
            lines.append(line.rstrip())
            continue
        if lines:
            yield _block(lines)
            lines = []
        if heading:
            yield f"h{len(heading[1])}", heading[2]
    if lines:
        yield _block(lines)


def elements(markdown: str) -> Iterator[tuple[str, str]]:
    """(tag, text) of the blocks of a text: headings, paragraphs, lists and quotes."""
    for tag, text in _blocks(markdown):
        yield tag, _EMPHASIS.sub(r"\2", text) if "*" in text or "_" in text or "`" in text else text


def html_elements(html: Column) -> Column:
    """(tag, text) of the headings and paragraphs of a page, by built-in functions."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<(h[1-3]|p)\b[^>]*>.*?</\1>"), F.lit(0))
    tag = lambda x: F.regexp_extract(x, "^<(h[1-3]|p)", 1)
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), " +", " "))
    return F.transform(found, lambda x: F.struct(tag(x).alias("tag"), text(x).alias("text")))


#: Elements that hold the text of a verse's section.
TEXTUAL = ("p", "ul", "ol", "blockquote")


@dataclass
class Part:
    """What stands below a heading of level 1 or 2: the elements before its first heading of level 3, and below each of these."""

    tag: str
    title: str
    adhikar: str | None
    start: list[tuple[str, str]] = field(default_factory=list)
    subs: list[tuple[str, list[tuple[str, str]]]] = field(default_factory=list)


def outline(markdown: str) -> Iterator[Part]:
    """The parts of a book in order, in one pass; what stands before the first belongs to none. adhikar: the last heading of level 1."""
    part, adhikar = None, None
    for tag, text in elements(markdown):
        text = clean(text)
        if tag in ("h1", "h2"):
            if part:
                yield part
            adhikar = text if tag == "h1" else adhikar
            part = Part(tag, text, adhikar)
        elif part and tag == "h3":
            part.subs.append((text, []))
        elif part:
            (part.subs[-1][1] if part.subs else part.start).append((tag, text))
    if part:
        yield part


_PAGE, _VERSE = re.compile(PAGE_HEADING), re.compile(VERSE)


def _page(title: str) -> int | None:
    found = _PAGE.match(title)
    return int(found[1]) if found else None


def _texts(rows: list[tuple[str, str]], tags: tuple[str, ...]) -> list[str]:
    return [text for tag, text in rows if tag in tags and text]


def _verse(found: re.Match, part: Part) -> dict:
    fields: dict[str, list[str]] = {}
    for name, rows in part.subs:
        if name not in SECTIONS and _page(name) is None:
            raise ValueError(f"{name!r} is no section of a verse")
        fields[name] = _texts(rows, TEXTUAL)
    pages = [p for name in fields if (p := _page(name)) is not None]
    one = lambda name: clean("\n".join(fields.get(name, [])))
    first = int(found[2])
    return {
        "verse": clean("\n".join(_texts(part.start, ("p",)))), "type": found[1].capitalize(), "type_start_num": first, "type_end_num": int(found[3] or first),
        "translation": one("Translation"), "language": "Hindi", "meaning": one("Meaning"), "teeka": fields.get("Teeka", []), "bhavarth": fields.get("Bhavarth", []), "page_num": pages[0] if pages else None,
    }


def _prose(part: Part) -> dict | None:
    content, subs, page = _texts(part.start, ("p",)), [], None
    for head, rows in part.subs:
        number, texts = _page(head), _texts(rows, ("p",))
        if number is not None:
            # What stands below a page's number belongs to the section itself.
            page = number
            content += texts
        elif texts:
            subs.append({"heading": head, "content": texts, "page_num": None, "adhikar": part.adhikar})
    return {"heading": part.title, "content": content, "subsections": subs, "page_num": page} if content or subs else None


def parse_book(markdown: str) -> dict:
    """Verses and prose sections under one shared numbering; a heading of level 1 counts for all that follows."""
    book: dict[str, list[dict]] = {"verses": [], "prose_sections": []}
    seq = 1
    for part in outline(markdown):
        if part.tag == "h1":
            continue
        found = _VERSE.match(part.title)
        one = _verse(found, part) if found else _prose(part)
        if one is None:
            continue
        book["verses" if found else "prose_sections"].append(one | {"seq_num": seq, "adhikar": part.adhikar})
        for place, sub in enumerate(one.get("subsections", ()), seq + 1):
            sub["seq_num"] = place
        seq += 1 + len(one.get("subsections", ()))
    return book


def parse_books(markdown) -> Column:
    """A struct of a book's verses and prose sections."""
    shape = to_arrow_type(StructType.fromDDL(BOOK))

    @F.arrow_udf(BOOK)
    def run(texts: pa.Array) -> pa.Array:
        # Each book is turned into Arrow at once, so the objects of one book are there at a time.
        return pa.concat_arrays([pa.array([parse_book(m.as_py() or "")], shape) for m in texts] or [pa.array([], shape)])

    return run(markdown)


def verse_by_number(verses: Column, seq: Column) -> Column:
    return F.get(F.filter(verses, lambda v: v["seq_num"] == seq), F.lit(0))


def prose_by_number(sections: Column, seq: Column) -> Column:
    """(seq_num, heading, content, parent_seq_num, parent_heading): a section, or a subsection with its parent."""
    shape = lambda s, p: F.struct(s["seq_num"].alias("seq_num"), s["heading"].alias("heading"), s["content"].alias("content"), (p["seq_num"] if p is not None else F.lit(None).cast("int")).alias("parent_seq_num"), (p["heading"] if p is not None else F.lit(None).cast("string")).alias("parent_heading"))
    own = F.transform(F.filter(sections, lambda s: s["seq_num"] == seq), lambda s: shape(s, None))
    below = F.flatten(F.transform(sections, lambda p: F.transform(F.filter(p["subsections"], lambda s: s["seq_num"] == seq), lambda s: shape(s, p))))
    return F.coalesce(F.get(own, F.lit(0)), F.get(below, F.lit(0)))


def _verse_parts(v: Column) -> Column:
    """The fields of a verse as chunks; array fields keep the place of their elements."""

    def part(name: str, text: Column, at: Column | None = None) -> Column:
        chunk_id = F.concat_ws("_", "granth_id", F.concat(F.lit("v"), v["seq_num"]), F.lit(name), *([at.cast("string")] if at is not None else []))
        return F.struct(chunk_id.alias("chunk_id"), F.concat_ws("_", F.lit(name), v["seq_num"].cast("string")).alias("paragraph_id"), v["page_num"].alias("page_num"), v["adhikar"].alias("adhikar"), text.alias("text"), F.lit(at is not None).alias("embed"))

    many = lambda name: F.transform(v[name], lambda x, i: part(name, x, i))
    return F.flatten(F.array_compact(F.array(F.array(*[part(name, v[name]) for name in ("verse", "translation", "meaning")]), many("teeka"), many("bhavarth"))))


def _prose_parts(s: Column) -> Column:
    """The paragraphs of a section and its subsections as chunks; a subsection without a page has its parent's."""

    def parts(of: Column, place: Column, page: Column) -> Column:
        def part(text: Column, i: Column) -> Column:
            chunk_id = F.concat_ws("_", F.col("granth_id"), place, F.lit("content"), i.cast("string"))
            paragraph_id = F.concat_ws("_", F.lit("prose"), of["seq_num"].cast("string"), F.lit("content"), i.cast("string"))
            return F.struct(chunk_id.alias("chunk_id"), paragraph_id.alias("paragraph_id"), page.alias("page_num"), of["adhikar"].alias("adhikar"), text.alias("text"), F.lit(True).alias("embed"))

        return F.transform(of["content"], part)

    own = F.concat(F.lit("p"), s["seq_num"])
    below = F.transform(s["subsections"], lambda u: parts(u, F.concat(own, F.lit("_sub"), u["seq_num"]), F.coalesce(u["page_num"], s["page_num"])))
    return F.flatten(F.array_compact(F.array(parts(s, own, s["page_num"]), F.flatten(F.array_compact(below)))))


def _chunks(items: DataFrame, parts: Column) -> DataFrame:
    rows = items.select("granth_id", F.explode(parts).alias("p")).select("granth_id", "p.*").where(F.trim("text") != "")
    return rows.select("chunk_id", "granth_id", "paragraph_id", "page_num", "adhikar", "text", "embed")


def verse_chunks(books: DataFrame) -> DataFrame:
    """One row per non-blank field of a verse; array fields keep the place of their elements. books: granth_id, verses."""
    return _chunks(books.select("granth_id", F.explode("verses").alias("v")), _verse_parts(F.col("v")))


def prose_chunks(books: DataFrame) -> DataFrame:
    """One row per non-blank paragraph of a section or subsection; a subsection without a page has its parent's."""
    return _chunks(books.select("granth_id", F.explode("prose_sections").alias("s")), _prose_parts(F.col("s")))


def book_chunks(books: DataFrame) -> DataFrame:
    """The chunks of both kinds; the books are gone through once."""
    verses = F.transform("verses", lambda v: F.struct(v.alias("v"), F.get("prose_sections", F.lit(-1)).alias("s")))
    prose = F.transform("prose_sections", lambda s: F.struct(F.get("verses", F.lit(-1)).alias("v"), s.alias("s")))
    items = books.select("granth_id", F.explode(F.flatten(F.array_compact(F.array(verses, prose)))).alias("x")).select("granth_id", "x.*")
    return _chunks(items, F.when(F.col("v").isNotNull(), _verse_parts(F.col("v"))).otherwise(_prose_parts(F.col("s"))))
