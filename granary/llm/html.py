"""Main text of web pages by consensus of each host.

1. Each page is parsed leniently and its containers are scored by the plain text of their blocks, links
   discounted; the best one, or the article or main element around it, votes for its path: tags with
   classes, numbers generalised.
2. Votes are summed per host and path in Spark, and each host's path with most votes wins (ties: the
   smaller path).
3. Every page is read again and the blocks under its host's winning path are its text; a page without
   that path uses its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by tag,
role and class, wherever they stand. A class or id tells of them if it has one of their words and none beyond what names
parts of a page: "notice-bar" does, "notice-of-award" does not. Forms and elements named so that hold most of a page's plain
text, and no article or main element stands outside of them, are its frame and not a part of it (comments, adverts and menus
never are); what they hold is judged for itself.

Parsing takes time and memory in proportion to the page, however its tags nest or are left open: a tag, comment or script
without an end reaches to the page's end, as in browsers. Very long pages are read whole, one at a time. Null or
empty pages have empty texts; a page with a null or odd address belongs to the host ""; repeated rows are extracted each
and vote each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import Scratch, broadcast_if_small

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video button select option textarea input nav header footer aside menu dialog head title".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes")}
FORMS = frozenset("form fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table td th ul ol dl div section article main".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())

#: Words of class names and ids that mark what is never main text, those that may also name a page's frame,
#: and those that name parts of a page beside them.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs footer foot sidebar sidenav aside rail "
    "comment comments commentlist disqus reply replies cookie cookies consent gdpr newsletter subscribe subscription signup login pagination pager skip".split()
)
FRAME_WORDS = frozenset(
    "promo promos promotion banner header masthead topbar widget widgets related recommended recommendations share sharing social notice notices alert popup modal overlay search searchform".split()
)
PART_WORDS = frozenset(
    "area article articles bar block blocks body bottom box btn button buttons card cards col column container content count desktop element field fixed form global group holder icon icons image images info inline inner item items "
    "label large latest left link links list main message mini mobile module more msg news outer page pages pane panel popular post posts primary region right row section secondary site slot small sticky stories story "
    "tab tabs text thread title toggle top trending unit user view wrap wrapper zone".split()
)

#: Prefixes of names that tell of a page's layout, not of the element's own kind.
LAYOUT_PREFIXES = ("has-", "no-", "with-", "without-", "is-", "has_", "no_", "with_")

#: A start or end tag from its "<" on. A quote opens a value only behind "=". No part gives back what it took, so a tag is read once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+'|(?=.|\Z)))*+)(>?)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_NUMBER = re.compile(r"\d+")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMENTS = re.compile(r"\bcomments?\b")

HARD, NEVER, FRAME = 3, 2, 1
LONG_PATH = 4096


def told_by(name: str) -> int:
    """What a class or id says of its element: NEVER, FRAME or 0."""
    words = _WORD.findall(name)
    if name.startswith(LAYOUT_PREFIXES) or not all(w in NEVER_WORDS or w in FRAME_WORDS or w in PART_WORDS for w in words):
        return 0
    return NEVER if any(w in NEVER_WORDS for w in words) else FRAME if any(w in FRAME_WORDS for w in words) else 0


class Tag:
    """A start tag: its name, its step in a path, whether what it holds is left out."""

    __slots__ = ("name", "step", "left_out", "inline", "void")

    def __init__(self, name: str, attributes: str):
        self.name = name = name.lower()
        self.void = name in VOID or attributes.endswith("/") and not attributes.endswith("=/") and name not in SCOPES
        self.inline = name in INLINE
        self.step, self.left_out = name, HARD if name in SKIPPED else FRAME if name in FORMS else 0
        if not attributes.strip(" /\n\t\r"):
            return
        found = {}
        for m in _ATTR.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = found.get("class", "").lower().split()
        self.step = ".".join([name, *sorted({_NUMBER.sub("#", c) for c in names})])
        if not self.inline and name not in ("html", "body", "article", "main"):
            self.left_out = max([self.left_out, *map(told_by, names + found.get("id", "").lower().split())])
        if name == "article" and _COMMENTS.search(" ".join(names)):
            self.left_out = max(self.left_out, NEVER)
        if found.get("role", "").lower() in SKIPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
            self.left_out = HARD


class Tags(dict):
    """Tags by spelling, the short ones kept."""

    def of(self, name: str, attributes: str) -> Tag:
        key = name, attributes
        if (tag := self.get(key)) is None:
            tag = Tag(name, attributes)
            if len(attributes) < 300:
                if len(self) > 20_000:
                    self.clear()
                self[key] = tag
        return tag


class Node:
    """An open block element. place: a hash of its path; frame: the innermost element around it, itself included, that may be left out."""

    __slots__ = ("name", "step", "parent", "place", "inside", "hard", "frame", "outer", "never", "plain", "kept", "meant", "score", "under", "inlines")

    def __init__(self, name: str, step: str, left_out: int, parent: Node | None, target: int | None):
        self.name, self.step, self.parent, self.score, self.under, self.inlines = name, step, parent, 0.0, None, []
        self.place = xxhash.xxh3_64_intdigest(step, seed=parent.place if parent else 0)
        self.inside = self.place == target or bool(parent and parent.inside)
        self.hard = left_out == HARD or bool(parent and parent.hard)
        self.meant = name in ("article", "main") or bool(parent and parent.meant)
        self.outer = self.frame = parent.frame if parent else None
        if left_out in (NEVER, FRAME):
            self.frame, self.never, self.plain, self.kept = self, left_out == NEVER, 0, False


_tags = Tags()
Block = tuple[Node, str, int]


def place_of(path: str) -> int:
    """The hash of a path, from its steps or as it is written in a long path's stead."""
    if path.startswith("#") and not path.startswith("#root"):
        return int(path[1:])
    place = 0
    for step in path.split(" "):
        place = xxhash.xxh3_64_intdigest(step, seed=place)
    return place


def path_of(node: Node) -> str:
    steps, at = [], node
    while at is not None:
        steps.append(at.step)
        at = at.parent
    path = " ".join(reversed(steps))
    return path if len(path) <= LONG_PATH else f"#{node.place}"


def parsed(html: str, target: int | None) -> tuple[list[Block], list[Node]]:
    """(container, text, characters in links) of all blocks that are not surely left out, in page order; the elements that may be."""
    stack, out, frames, buffer, open_names = [Node("#root", "#root", 0, None, target)], [], [], [], Counter()
    links = hidden = linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append((stack[-1], text, linked))
            buffer.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not hidden and not stack[-1].hard:
            if "&" in text:
                text = unescape(text)
            buffer.append(text)
            if links:
                linked += len(text)

    def forget(inlines: list[tuple[str, bool]]) -> None:
        nonlocal links, hidden
        for name, hard in inlines:
            links -= name == "a"
            hidden -= hard

    def close(to: int) -> None:
        for gone in stack[to:]:
            open_names[gone.name] -= 1
            forget(gone.inlines)
        del stack[to:]

    def start(tag: Tag) -> None:
        nonlocal links, hidden
        name = tag.name
        if tag.void:
            if name in ("br", "hr") and not stack[-1].hard and not hidden:
                buffer.append(" ")
        elif tag.inline:
            stack[-1].inlines.append((name, tag.left_out == HARD))
            links += name == "a"
            hidden += tag.left_out == HARD
        else:
            flush()
            ends = CLOSED_BY.get(name) or (("p",) if name in CLOSES_P else ())
            if any(open_names[e] for e in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        close(k)
                        if name != "tr":
                            break
                    elif stack[k].name in SCOPES and (name != "tr" or stack[k].name == "table"):
                        break
            stack.append(node := Node(name, tag.step, tag.left_out, stack[-1], target))
            open_names[name] += 1
            if node.frame is node:
                frames.append(node)

    def end(name: str) -> None:
        if name in INLINE:
            own = stack[-1].inlines
            if any(n == name for n, _ in own[-32:]):
                k = max(k for k in range(max(0, len(own) - 32), len(own)) if own[k][0] == name)
                forget(own[k:])
                del own[k:]
            return
        flush()
        if open_names[name]:
            k = len(stack) - 1
            while stack[k].name != name:
                k -= 1
            close(k)

    at = begin = 0
    while (at := html.find("<", at)) >= 0:
        kind = html[at + 1 : at + 2]
        if kind in ("!", "?") or kind == "/" and not html[at + 2 : at + 3].isalpha():
            add(html[begin:at])
            closed = html.find("-->", at + 2) + 2 if html.startswith("<!--", at) else html.find(">", at)
            at = begin = closed + 1 if closed > 1 else len(html)
            continue
        m = _TAG.match(html, at)
        if not m:
            at += 1
            continue
        add(html[begin:at])
        at = begin = m.end()
        if not m[4]:
            break
        if m[1]:
            end(m[2].lower())
            continue
        tag = _tags.of(m[2], m[3])
        if tag.name in RAW:
            raw = RAW[tag.name].search(html, at)
            at = begin = raw.start() if raw else len(html)
            continue
        start(tag)
    add(html[begin:])
    flush()
    return out, frames


def blocks(html: str, target: int | None = None) -> list[Block]:
    """(container, text, characters in links) of the blocks that may be main text, in page order."""
    out, frames = parsed(html, target)
    if not frames:
        return out
    total, meant = 0, False
    for node, text, linked in out:
        frame = node.frame
        if frame is None:
            meant = meant or node.meant
            total += len(text) - linked
        else:
            frame.plain += len(text) - linked
    # Elements come after those around them, so sums go outwards in reverse and verdicts inwards.
    for frame in reversed(frames):
        if not frame.never:
            if frame.outer is None:
                total += frame.plain
            else:
                frame.outer.plain += frame.plain
    for frame in frames:
        frame.kept = not frame.never and not meant and 2 * frame.plain > total and (frame.outer is None or frame.outer.kept)
    return [b for b in out if b[0].frame is None or b[0].frame.kept]


def best(found: list[Block]) -> Node | None:
    """The container with most text, or the article or main element around it."""
    top = None
    for node, text, linked in found:
        if linked * 2 > len(text):
            continue
        holder = node if node.name in SCOPES else node.parent or node
        for weight in (1.0, 0.5):
            if holder is None or holder.name == "#root" and weight < 1:
                break
            holder.score += weight * (len(text) - linked)
            if top is None or holder.score > top.score:
                top = holder
            holder = holder.parent
    for wanted in ("article", "main"):
        node = top
        while node is not None:
            if node.name == wanted:
                return node
            node = node.parent
    return top


def is_under(node: Node, top: Node) -> bool:
    """True if top is around the node or the node itself; answers stay with the nodes, so asking for all takes a step for each."""
    way = []
    while node is not None and node.under is None and node is not top:
        way.append(node)
        node = node.parent
    answer = node is top or node is not None and bool(node.under)
    for x in way:
        x.under = answer
    return answer


def main_text(html: str, path: str | None) -> str:
    """Texts of the blocks under the path, or under the page's own best container if it has none."""
    found = blocks(html, place_of(path) if path is not None else None)
    texts = [t for n, t, _ in found if n.inside]
    if not texts and (top := best(found)) is not None:
        texts = [t for n, t, _ in found if is_under(n, top)]
    return " ".join(texts)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _votes(batches):
    for batch in batches:
        paths = []
        for html in batch.column("html").to_pylist():
            top = best(blocks(html)) if html else None
            paths.append(path_of(top) if top else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], names=["host", "path"])


def _texts(batches):
    for batch in batches:
        texts = [main_text(h, p) if h else "" for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winner. A host of any size is summed map-side; only counts are shuffled."""
    votes = pages.select(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), F.col("html")).mapInArrow(_votes, "host string, path string")
    counts = votes.where("path IS NOT NULL").groupBy("host", "path").count()
    return counts.groupBy("host").agg(F.min_by("path", F.struct((-F.col("count")).alias("c"), "path")).alias("path"))


def extract(spark: SparkSession, pages: DataFrame, small: int = 200_000) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars. Up to `small` hosts are broadcast, more are joined by host."""
    winners = Scratch(spark).table(winning_paths(pages), "winners")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))
    told = rows.join(broadcast_if_small(winners, small), "host", "left").select("page_id", "url", "html", "path")
    return told.mapInArrow(_texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
