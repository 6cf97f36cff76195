"""Sections and chunks of documents.

What only moves text around is built in (fixed windows, neighbour context, templates).
Rules that walk a document with a state (sections, sentence packing, table rows, pages)
run in Arrow-batched functions from a text to an array of structs, so a document is one
unit of work and nothing is shuffled; arrays are exploded with their position after.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.models import Generator, generation
from siltstone.functions.text import STOP_WORDS
from siltstone.functions.vectorised import vectorised

#: Sizes of the two levels of chunks, in characters, with their overlaps, and the least content.
PARENT, PARENT_OVERLAP = 3500, 350
CHILD, CHILD_OVERLAP = 1000, 250
LEAST = 60
#: Sentences on each side that a topic window has, and the similarity below which a topic ends.
TOPIC_WINDOW, TOPIC_CHANGE = 4, 0.20
DASHES = 3

#: Heading patterns in the order they are tried, a fixed list. Identifiers in brackets are tags of requirements.
HEADINGS = [
    r"^\d+(\.\d+){1,5}\s+(?:[A-Z]|\[)",
    r"^\[(?:SWS|SRS|RS|ECUC|TPS|CP|AP|ASWS|TR|EXP|MOD|SRLG|PRS|CONC|BSW|FUNC|COM|SPEC)_[A-Za-z0-9_]+\]",
    r"^#{1,6}\s+(.+)$",
    r"^\d+\.\s+([A-Z].+)$",
    r"^([A-Z][A-Za-z ]{2,40}):$",
    r"^([A-Z][A-Z\s]{4,49})$",
    r"^\[TABLE \d+\]$",
    r"^\[Table \d+\]$",
    r"^\[IMAGE \d+\]$",
    r"^\[DIAGRAM \d+\]$",
]
_HEADINGS = [re.compile(p) for p in HEADINGS]
_PAGE = re.compile(r"^\[Page\s+(\d+)\s*\|\s*type=(\w+)\]$")
_NUMBERED = re.compile(r"^\d+((?:\.\d+)*)\.?\s+\S")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TERM = re.compile(r"\b\w\w+\b")
_RULE = re.compile(r"^[-\s|+]+$")
_STOPS = frozenset(STOP_WORDS)


def fixed_windows(text: Column, size: int = 400, step: int = 340) -> Column:
    """Stripped slices of size characters, step apart, without blank ones; a shorter text is one chunk."""
    body = T.strip(F.coalesce(text, F.lit("")))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(step)), lambda at: T.strip(F.substr(body, at + 1, F.lit(size))))
    return F.filter(F.when(F.length(body) < size, F.array(body)).otherwise(cut), lambda c: c != "")


def page_of(digits: str) -> int | None:
    """The number of a page; None for digits that no page is counted by."""
    digits = digits.lstrip("0") or "0"
    return int(digits) if len(digits) <= 10 and int(digits) < 2**31 else None


def section_kind(title: str) -> str:
    """table, image or diagram for a marker of one, else text."""
    low = title.lower()
    if low.startswith("[table "):
        return "table"
    return next((k for k in ("image", "diagram") if re.fullmatch(rf"\[{k} \d+\]", low)), "text")


def heading_level(line: str, numbered: bool = False) -> int | None:
    """The level of a line that is a heading, else None; numbered headings may count their dots."""
    if len(line) >= 200 or not any(p.match(line) for p in _HEADINGS):
        return None
    if line.startswith("#"):
        return len(line) - len(line.lstrip("#"))
    if section_kind(line) != "text":
        return 4
    if numbered and (m := _NUMBERED.match(line)):
        return m[1].count(".") + 1
    return 1 if line.isupper() else 2


class Section(NamedTuple):
    title: str
    content: str
    level: int
    page_number: int | None
    kind: str
    hierarchy: list[str]


def split_sections(text: str, first: str = "Introduction", numbered: bool = False) -> list[Section]:
    """Sections by heading lines, with the titles above each and the page its heading is on.

    What stands before the first heading has the title first and no page; a section
    without content is left out but still heads those below it. A text without any
    content is one section named Document.
    """
    found: list[Section] = []
    trail: list[tuple[str, int]] = [(first, 0)]
    body: list[str] = []
    page: int | None = None
    own: int | None = None

    def finish() -> None:
        content = "".join(body).strip()
        if content:
            title, level = trail[-1]
            found.append(Section(title, content, level, own, section_kind(title), [t for t, _ in trail if t]))

    for line in text.split("\n"):
        bare = line.strip()
        tag = _PAGE.match(bare)
        level = heading_level(bare, numbered) if bare and not tag else None
        if tag:
            page = page_of(tag[1])
        elif level is None:
            body.append(line + "\n" if bare else "\n")
        else:
            finish()
            while len(trail) > 1 and trail[-1][1] >= level:
                trail.pop()
            trail.append((bare.strip("#: ").strip(), level))
            body, own = [], page
    finish()
    return found or [Section("Document", text, 0, None, "text", ["Document"])]


def split_sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _SENTENCE.split(text)) if s]


def split_long(sentence: str, most: int) -> list[str]:
    """Words packed greedily into pieces of at most most characters; a longer word stays whole."""
    if len(sentence) <= most:
        return [sentence]
    pieces: list[str] = []
    for word in sentence.split():
        if pieces and len(pieces[-1]) + 1 + len(word) <= most:
            pieces[-1] += " " + word
        else:
            pieces.append(word)
    return pieces


def topic_starts(sentences: list[str]) -> set[int]:
    """Sentences at which the topic changes: windows of neighbours, weighed by tf-idf, have little in common.

    A window differs from the one before by a sentence that enters and one that leaves,
    so counts, squares and products are carried on from window to window.
    """
    n, w = len(sentences), TOPIC_WINDOW
    if n < 2 * w + 1:
        return {0}
    bags = [Counter(t for t in _TERM.findall(s.lower()) if t not in _STOPS) for s in sentences]
    # how many windows hold a term: those around its sentences, each once
    held: dict[str, int] = {}
    reach: dict[str, int] = {}
    for k, bag in enumerate(bags):
        low, high = max(0, k - w), min(n - 1, k + w)
        for t in bag:
            held[t] = held.get(t, 0) + high - max(low - 1, reach.get(t, -1))
            reach[t] = high
    square = {t: (math.log((1 + n) / (1 + df)) + 1) ** 2 for t, df in held.items()}
    now: dict[str, int] = {}
    for bag in bags[: w + 1]:
        for t, c in bag.items():
            now[t] = now.get(t, 0) + c
    size = sum(square[t] * c * c for t, c in now.items())
    filled = sum(now.values())
    starts = {0}
    none: Counter = Counter()
    for k in range(1, n):
        new, old = bags[k + w] if k + w < n else none, bags[k - w - 1] if k > w else none
        product, after = size, size
        step = dict(new)
        for t, c in old.items():
            step[t] = step.get(t, 0) - c
        for t, c in step.items():
            if c:
                have, weight = now.get(t, 0), square[t] * c
                product += weight * have
                after += weight * (2 * have + c)
                now[t] = have + c
                filled += c
        if not filled or size <= 0 or product < TOPIC_CHANGE * math.sqrt(size * max(after, 0.0)):
            starts.add(k)
        size = after if filled else 0.0
    return starts


@dataclass
class Piece:
    text: str
    start: int
    sentences: int
    kind: str = "text"

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def pack_sentences(sentences: list[str], size: int, overlap: int, topics: bool = True) -> list[Piece]:
    """Chunks of whole sentences up to size characters.

    A chunk that is full is followed by one that begins with its last sentences, as
    many as fit the overlap; a chunk that ends where a topic does (if it has LEAST
    characters) is followed by one without overlap.
    """
    starts = topic_starts(sentences) if topics else set()
    out: list[Piece] = []
    held: list[str] = []
    length = begin = at = 0

    def flush() -> None:
        text = " ".join(held).strip()
        if text:
            out.append(Piece(text, begin, len(split_sentences(text))))

    for k, sentence in enumerate(sentences):
        if held and length + len(sentence) > size:
            flush()
            kept, room = len(held), overlap
            while kept and len(held[kept - 1]) <= room:
                kept -= 1
                room -= len(held[kept])
            held = held[kept:]
            length = overlap - room
            begin = at - length
        elif held and k in starts and length >= LEAST:
            flush()
            held, length, begin = [], 0, at
        held.append(sentence)
        at += len(sentence) + 1
        length += len(sentence) + 1
    flush()
    return out


def table_rows(text: str, title: str, size: int) -> list[Piece]:
    """Chunks of whole rows; every one has the title and the header, with its rule of dashes if there is one."""
    rows = [r for r in text.splitlines() if r.strip()]
    if not rows:
        return []
    ruled = len(rows) > 1 and bool(_RULE.match(rows[1])) and rows[1].count("-") >= DASHES
    header, body = rows[: 1 + ruled], rows[1 + ruled :]
    head = "\n".join(header)

    def piece(part: list[str], start: int) -> Piece:
        content = "\n".join([head, *part]).strip()
        return Piece(f"[{title}]\n{content}" if title else content, start, len(part) + len(header), "table")

    if not body or len(text.strip()) <= size:
        return [piece(body, 0)]
    groups: list[list[str]] = [[]]
    length = len(head) + 1
    for row in body:
        if groups[-1] and length + len(row) + 1 > size:
            groups.append([])
            length = len(head) + 1
        groups[-1].append(row)
        length += len(row) + 1
    out, start = [], 0
    for group in groups:
        out.append(piece(group, start))
        start += len(out[-1].text) + 1
    return out


def chunk(text: str, title: str = "", kind: str = "text", size: int = CHILD, overlap: int = CHILD_OVERLAP, atomic: bool = False) -> list[Piece]:
    """Chunks of a section; one with less than LEAST characters has none, or is one itself if atomic."""
    if len(text.strip()) < LEAST:
        return [Piece(text.strip(), 0, 1, kind)] if atomic and text.strip() else []
    if kind == "table":
        return table_rows(text, title, size)
    parts = [p for s in split_sentences(text) for p in split_long(s, size)]
    return [Piece(p.text, p.start, p.sentences, kind) for p in pack_sentences(parts, size, overlap)]


def page_aware(text: str, size: int = 12_000, carry: int = 5, tail: int = 2000) -> list[tuple[str, list[int]]]:
    """Chunks of whole pages marked [Page n] up to size characters, each beginning with the end of the one before.

    The carried end is the last carry pieces between full stops, or the last tail
    characters if there are no more pieces than that. A text without marks is one block
    without a page, whatever it begins with; a mark with digits that no page is counted by stays in the text, but names no page.
    """
    out: list[tuple[str, list[int]]] = []
    held, pages = "", []
    marked = "[Page " in text
    for part in text.split("[Page ")[1:] if marked else [text]:
        number = re.match(r"(\d+)", part) if marked else None
        block = f"[Page {part}" if number else part
        if held and len(held) + len(block) > size:
            out.append((held.strip(), pages))
            pieces = held.split(".")
            held = ".".join(pieces[-carry:]) if len(pieces) > carry else held[-tail:]
            pages = pages[-1:]
        held += block
        if number and page_of(number[1]) is not None:
            pages = [*pages, page_of(number[1])]
    if held.strip():
        out.append((held.strip(), pages))
    return out


_SECTION = "array<struct<title:string,content:string,level:int,page_number:int,kind:string,hierarchy:array<string>>>"
_CHUNK = "array<struct<title:string,hierarchy:array<string>,page_number:int,kind:string,text:string,start_char:int,end_char:int,sentence_count:int,section:int>>"
_PAGED = "array<struct<text:string,pages:array<int>>>"


@vectorised(_SECTION)
def sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [s._asdict() for s in split_sections(t or "")])


@vectorised(_SECTION)
def smart_sections(text: pd.Series) -> pd.Series:
    """Sections with the level of numbered headings by their dots, and Document before the first heading."""
    return text.map(lambda t: [s._asdict() for s in split_sections(t or "", "Document", numbered=True)])


@vectorised("array<int>")
def topics(text: pd.Series) -> pd.Series:
    """The numbers of the sentences at which the topic changes."""
    return text.map(lambda t: sorted(topic_starts(split_sentences(t or ""))))


@vectorised(_PAGED)
def page_chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"text": c, "pages": p} for c, p in page_aware(t or "")] if t else [])


def _chunker(size: int, overlap: int):
    @vectorised(_CHUNK)
    def chunks(text: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[dict]:
            return [
                {"title": s.title, "hierarchy": s.hierarchy, "page_number": s.page_number, "kind": p.kind, "text": p.text, "start_char": p.start, "end_char": p.end, "sentence_count": p.sentences, "section": k}
                for k, s in enumerate(split_sections(t or ""))
                for p in chunk(s.content, s.title, s.kind, size, overlap)
            ]

        return text.map(of)

    return chunks


def parents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each parent chunk: key, parent_index, parent_id and what the chunk is.

    Ids are name-based, of the document's key, the section's place, the start and the
    first 64 characters; the section's place keeps equal beginnings in two sections apart.
    """
    rows = docs.select(key, F.posexplode(_chunker(PARENT, PARENT_OVERLAP)(F.col(text))).alias("parent_index", "_c")).select(key, "parent_index", "_c.*")
    name = F.concat_ws("_", F.col(key).cast("string"), "section", "start_char", F.substring("text", 1, 64))
    return rows.select("*", F.size(T.words(F.col("text"))).alias("word_count"), T.uuid5(name).alias("parent_id"))


def children(parent_rows: DataFrame, key: str) -> DataFrame:
    """A row for each child chunk of each parent, with parent_id and child_index."""

    @vectorised("array<struct<text:string,start_char:int,end_char:int,sentence_count:int>>")
    def split(text: pd.Series, title: pd.Series, kind: pd.Series) -> pd.Series:
        of = lambda t, name, k: [{"text": p.text, "start_char": p.start, "end_char": p.end, "sentence_count": p.sentences} for p in chunk(_without_title(t, name, k), name, k)]
        return pd.Series([of(*x) for x in zip(text, title, kind, strict=True)])

    kept = [key, "parent_id", "parent_index", "title", "hierarchy", "page_number", "kind"]
    rows = parent_rows.select(*kept, F.posexplode(split("text", "title", "kind")).alias("child_index", "_c")).select(*kept, "child_index", "_c.*")
    return rows.withColumn("word_count", F.size(T.words(F.col("text"))))


def _without_title(text: str, title: str, kind: str) -> str:
    """A table parent's text without the title line, so that its header is found again."""
    head = f"[{title}]\n"
    return text[len(head) :] if kind == "table" and title and text.startswith(head) else text


def enrich(child_rows: DataFrame, key: str, filename: Column, neighbours: int = 3) -> DataFrame:
    """child_rows with enriched_text: document, section and neighbouring sentences of the same section above the text."""
    order = Window.partitionBy(key).orderBy("parent_index", "child_index")
    same = lambda shift: shift("title").over(order) == F.col("title")
    ahead = F.slice(T.sentences(F.lead("text").over(order)), 1, neighbours)
    last = lambda s: F.when(F.size(s) <= neighbours, s).otherwise(F.slice(s, -neighbours, neighbours))
    before = F.when(same(F.lag), F.concat(F.array_join(last(T.sentences(F.lag("text").over(order))), " "), F.lit("...")))
    after = F.when(same(F.lead), F.concat(F.lit("..."), F.array_join(ahead, " ")))
    rows = child_rows.withColumns({"_before": before, "_after": after})
    context = F.concat_ws(" | ", "_before", "_after")
    section = F.array_join(F.filter("hierarchy", lambda h: h != ""), " > ")
    blank = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", F.lit(other)).otherwise(c)
    text = F.format_string("Document: %s\nSection: %s\nContext: %s\n\n%s", filename, blank(section, "—"), blank(context, "start of section"), F.col("text"))
    return rows.withColumn("enriched_text", text).drop("_before", "_after")


def page_blocks(text: Column) -> Column:
    """The pages of a text marked by [Page n | type=t] lines: array of (page, kind, body)."""
    tag = r"(?m)^\[Page\s+(\d+)\s*\|\s*type=(\w+)\]\s*$"
    number = F.regexp_extract_all(text, F.lit(tag), F.lit(1))
    kind = F.regexp_extract_all(text, F.lit(tag), F.lit(2))
    bodies = F.split(text, tag, -1)
    return F.transform(number, lambda n, k: F.struct(n.cast("int").alias("page"), F.get(kind, k).alias("kind"), T.strip(F.get(bodies, k + 1)).alias("body")))


def enough(text: Column, least: int = LEAST) -> Column:
    """Whether a text has enough content to be a chunk."""
    return F.length(T.strip(F.coalesce(text, F.lit("")))) >= least


def model_context(text: Column, build: Callable[[], Generator], template: Column, cut: int = 1500) -> Column:
    """A chunk under what a model says of its first cut characters; under the template where it says nothing."""
    said = generation(F.concat(F.lit("Say in one or two sentences what this passage is about.\nContext: "), T.cut(F.coalesce(text, F.lit("")), cut)), build)["reply"]
    return F.coalesce(F.concat(F.nullif(T.strip(said), F.lit("")), F.lit("\n\n"), text), F.concat(template, text))
