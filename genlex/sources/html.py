"""Parsers of pages, as Arrow batches over an html column. Only here is a Python worker needed: the context of an element is a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genlex.functions import values as V

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element: tag, classes, children (elements and strings), parent."""

    def __init__(self, tag: str, classes: tuple[str, ...] = (), parent: Node | None = None):
        self.tag, self.classes, self.parent, self.children = tag, classes, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def find_all(self, tag: str, cls: str | None = None) -> list[Node]:
        return [n for n in self.walk() if n.tag == tag and (cls is None or cls in n.classes)]

    def elements_before(self) -> list[Node]:
        """Sibling elements before this one, nearest first."""
        own = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        return own[: own.index(self)][::-1] if self in own else []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, tuple((dict(attrs).get("class") or "").split()), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    return b.root


def pages_to_rows(pages: DataFrame, html_col: str, extract: Callable[[Node], list[tuple]], schema: str, keep: str) -> DataFrame:
    """Rows that ``extract`` finds in each page, with the page's ``keep`` column first. Null pages give nothing."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in f"{keep} x, {schema}".split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(k, *row) for k, h in zip(pdf[keep], pdf[html_col], strict=True) if h for row in extract(parse(h))], columns=names)

    return pages.select(keep, html_col).where(F.col(html_col).isNotNull()).mapInPandas(run, f"{keep} {kinds[keep]}, {schema}")


def _third_cells(root: Node) -> list[tuple]:
    return [(cells[2].text(),) for t in root.find_all("table") for r in t.find_all("tr")[1:] if len(cells := r.find_all("td")) > 2]


def demonyms(pages: DataFrame, html_col: str, keep: str) -> DataFrame:
    """``(keep, demonym)``: of every table without its first row the third cell, up to the first ``(``, one row per comma-separated entry.

    Only the cells' texts come out of Python; cutting and splitting are column expressions.
    """
    cells = pages_to_rows(pages, html_col, _third_cells, "cell string", keep)
    trimmed = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    entries = F.split(trimmed(F.substring_index(trimmed(F.col("cell")), "(", 1)), ",")
    return cells.select(keep, F.explode(entries).alias("demonym")).select(keep, trimmed(F.col("demonym")).alias("demonym"))


def section_nouns(sections: tuple[str, ...] = ()) -> Callable[[Node], list[tuple]]:
    """Links of paragraphs that have a bold *Noms*, under the chosen h2 headings (all if none is chosen), as (position, noun)."""

    def extract(root: Node) -> list[tuple]:
        out, active = [], False
        for n in root.walk():
            if n.tag == "h2":
                active = not sections or n.text().strip() in sections
            elif n.tag == "p" and active and any("noms" in b.text().lower() for b in n.find_all("b")):
                out += [(len(out) + k, a.text().strip()) for k, a in enumerate(n.find_all("a")) if a.text().strip()]
        return out

    return extract


def animals(root: Node) -> list[tuple]:
    """First word of the first cell (its link, if any) of every row of a wikitable, as (position, animal)."""
    out = []
    for table in root.find_all("table", "wikitable"):
        for row in table.find_all("tr")[1:]:
            cell = next(iter(row.find_all("td")), None)
            link = next(iter(cell.find_all("a")), None) if cell else None
            words = (link or cell).text().split() if cell else []
            if words:
                out.append((len(out), words[0]))
    return out


def animal_names(rows: DataFrame) -> DataFrame:
    """Without ``humain`` (its first occurrence), cut before the first ``aboiement``, distinct, in French collation order. ``rows``: (pos, animal)."""
    stop = rows.where("animal = 'aboiement'").agg(F.min("pos").alias("stop"))
    human = rows.where("animal = 'humain'").agg(F.min("pos").alias("human"))
    kept = rows.join(F.broadcast(stop)).join(F.broadcast(human))  # one row each
    kept = kept.where((F.col("pos") < F.coalesce("stop", F.lit(2**31 - 1))) & (F.col("pos") != F.coalesce("human", F.lit(-1))))
    return kept.select("animal").distinct().orderBy(F.collate("animal", "fr"))


def without_words(rows: DataFrame, word_col: str, excluded: DataFrame) -> DataFrame:
    """First-seen distinct words that are not excluded."""
    bad = excluded.select(F.col(excluded.columns[0]).alias(word_col)).distinct()
    return rows.groupBy(word_col).agg(F.min("pos").alias("pos")).join(bad, word_col, "left_anti")


def context(definition: Node, cls: str, levels: int = 3) -> str | None:
    """Text of the nearest element with a class: the definition itself, siblings before it, then the same one level up, ``levels`` times."""
    at: Node | None = definition
    for _ in range(levels):
        if at is None or at.tag == "root":
            return None
        for n in (at, *at.elements_before()):
            if cls in n.classes:
                return n.text()
        at = at.parent
    return None


def definitions(root: Node) -> list[tuple]:
    """(position, definition, bracket_text, indicator, domain, phrase) of each distinct definition span; missing context is ``""``."""
    out, seen = [], set()
    for n in root.find_all("span", "tlf_cdefinition"):
        t = n.text()
        t = (t[:-2] if t[-1:] == ":" and t[-2:-1].isspace() else t).strip()
        if t not in seen:
            seen.add(t)
            out.append((len(out), t, *[context(n, c) or "" for c in V.CONTEXT_CLASSES.values()]))
    return out
