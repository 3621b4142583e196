"""Song and ranking pages as rows: Arrow batches through the standard library's HTML parser."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.extract import version_type

# Fixed values of the pages.
NUMBER, ARTIST_ROW, CARD = r"曲番号\s*:\s*(\d+)", "歌手名", ("data-testid", "card-information")
VIDEO_TITLE = re.compile(r"\[ミュージックビデオ観放題\](.+)／(.+)-楽曲検索 \| [^|]*", re.S)
CATALOG_HEAD = re.compile(r"(\d+)件\((\d+)-(\d+)件目表示\)")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "place")

    def __init__(self, tag: str, attrs: dict, up: Node | None) -> None:
        self.tag, self.attrs, self.kids, self.up, self.place = tag, attrs, [], up, None

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.kids)
        return "".join(out)

    def all(self, *tags: str) -> list[Node]:
        """Elements below, in page order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node is not self and (not tags or node.tag in tags):
                out.append(node)
            todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
        return out

    def after(self, kid: Node) -> Iterator[Node]:
        """Elements that follow a child."""
        if self.place is None:
            self.place = {id(k): i for i, k in enumerate(self.kids)}
        beside = (self.kids[i] for i in range(self.place[id(kid)] + 1, len(self.kids)))
        return (k for k in beside if not isinstance(k, str))

    def within(self, tag: str) -> Node | None:
        node = self
        while node is not None and node.tag != tag:
            node = node.up
        return node


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = self.now = Node("", {}, None)
        self.open: Counter = Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.kids.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.now.kids.append(Node(tag, dict(attrs), self.now))

    def handle_endtag(self, tag: str) -> None:
        # counted, so that an end tag without its element costs nothing on a deep page
        while self.open[tag]:
            self.open[self.now.tag] -= 1
            self.now, was = self.now.up, self.now.tag
            if was == tag:
                break

    def handle_data(self, data: str) -> None:
        self.now.kids.append(data)


def tree(page: str | None) -> Node:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    return reader.top


def recording(page: Node) -> dict:
    """The first record of a piece of music in the page's embedded JSON; what isn't JSON is passed over."""
    for script in page.all("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            held = json.loads(script.text())
            for record in held.get("@graph", [held]):
                if record.get("@type") == "MusicRecording":
                    return record
        except (ValueError, AttributeError, TypeError):
            continue
    return {}


def names(artist) -> str:
    """One name, or several joined; blank ones go."""
    several = artist if isinstance(artist, list) else [artist]
    found = [x["name"].strip() for x in several if isinstance(x, dict) and isinstance(x.get("name"), str)]
    return "、".join(x for x in found if x)


def song_of(page: str | None, device: str) -> dict:
    """{title, artist, variants}: from embedded JSON, else the title of a video page, else heading and table."""
    top = tree(page)
    record = recording(top)
    first = lambda tag: next((x.text().strip() for x in top.all(tag)), "")
    video = VIDEO_TITLE.fullmatch(first("title"))
    row = next((x.within("tr") for x in top.all("th") if x.text().strip() == ARTIST_ROW), None)
    cell = next((x.text().strip() for x in row.all("td")), "") if row else ""
    name = record.get("name")
    if name is not None and not isinstance(name, str):
        raise ValueError("the record's name is no text")
    title = (name or "").strip() or (video[1].strip() if video else "") or first("h1")
    artist = names(record.get("byArtist")) or (video[2].strip() if video else "") or cell
    variants: dict[str, str] = {}
    for card in top.all("div"):
        if card.attrs.get(CARD[0]) != CARD[1]:
            continue
        text = " ".join(card.text().split())
        number = re.search(NUMBER, text)
        label = next((x.text().strip() for x in card.all("p")), "")
        if device in text and number and label:
            variants.setdefault(number[1], label)
    return {"title": title or None, "artist": artist or None, "variants": [{"number": n, "label": x} for n, x in variants.items()]}


def song_or_fault(page: str | None, device: str) -> dict:
    """song_of(), or why this page can't be read; one bad page is no reason to lose the others."""
    try:
        return {**song_of(page, device), "bad": None}
    except (ValueError, TypeError, AttributeError, AssertionError, RecursionError) as e:
        return {"title": None, "artist": None, "variants": [], "bad": f"unreadable page: {e}"[:200]}


def song_pages(pages: DataFrame, device: str, url_pattern: str) -> DataFrame:
    """(url, page_id, title, artist, variants, fault) of song pages (url, html); fault says why a page has no song."""
    kind = "title string, artist string, variants array<struct<number: string, label: string>>, bad string"
    read = F.pandas_udf(lambda html: pd.DataFrame([song_or_fault(x, device) for x in html], columns=["title", "artist", "variants", "bad"]), kind)
    read = read.asNondeterministic()  # or else a filter on what was read is moved down and reads each page once more
    page_id = F.nullif(F.regexp_extract("url", url_pattern, 1), F.lit(""))
    rows = pages.select("url", page_id.alias("page_id"), read("html").alias("s")).select("url", "page_id", "s.*")
    fault = F.when(F.col("page_id").isNull(), "no song address").when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("title").isNull() | F.col("artist").isNull(), "no title or artist")
    typed = F.transform("variants", lambda v: F.struct(F.concat(F.lit("song-"), "page_id", F.lit("-"), v["number"]).alias("variant_id"), v["number"].alias("number"), v["label"].alias("label"), version_type(v["label"], F.col("title")).alias("version_type")))
    return rows.withColumns({"variants": typed, "fault": fault}).drop("bad")


def section_links(page: str | Node | None, heading: str, path: str) -> list[str]:
    """Distinct paths that fit, in order of text, from a matching second-level heading to the next one among its siblings."""
    head, fits, out = re.compile(heading), re.compile(path), set()
    for node in (top := page if isinstance(page, Node) else tree(page)).all("h2"):
        if not head.search(" ".join(node.text().split())):
            continue
        for other in (node.up or top).after(node):
            if other.tag == "h2":
                break
            out |= {re.split("[?#]", a.attrs.get("href", ""), maxsplit=1)[0] for a in other.all("a")}
    return sorted(x for x in out if fits.fullmatch(x))


def links_under(page: str | Node | None, ids: list[str], path: str) -> dict[str, list[str]]:
    """For each element id the distinct paths below it that fit, in order of text; an empty list where there is no such element."""
    fits, found = re.compile(path), {x: set() for x in ids}
    for node in (page if isinstance(page, Node) else tree(page)).all():
        if node.attrs.get("id") in found:
            found[node.attrs["id"]] |= {re.split("[?#]", a.attrs.get("href", ""), maxsplit=1)[0] for a in node.all("a")}
    return {k: sorted(x for x in v if fits.fullmatch(x)) for k, v in found.items()}


def catalog_page(page: str | Node | None, path: str) -> dict:
    """{total, first, last, links} of the last heading that says so, links in page order; zeros if there is none."""
    fits, found = re.compile(path), {"total": 0, "first": 0, "last": 0, "links": []}
    for node in (page if isinstance(page, Node) else tree(page)).all("h2"):
        said = CATALOG_HEAD.fullmatch("".join(node.text().split()))
        if said:
            section = node.within("section")
            links = [re.split("[?#]", a.attrs.get("href", ""), maxsplit=1)[0] for a in section.all("a")] if section else []
            found = {"total": int(said[1]), "first": int(said[2]), "last": int(said[3]), "links": list(dict.fromkeys(x for x in links if fits.fullmatch(x)))}
    return found


def with_section_links(pages: DataFrame, sections: dict[str, str], path: str) -> DataFrame:
    """(url, section, link) for pages (url, html) and sections named with the pattern of their heading."""
    def each(page: str | None) -> list[dict]:
        top = tree(page)  # one for all sections
        return [{"section": k, "link": x} for k, h in sections.items() for x in section_links(top, h, path)]

    read = F.pandas_udf(lambda html: pd.Series([each(p) for p in html]), "array<struct<section: string, link: string>>")
    return pages.select("url", F.explode(read("html")).alias("s")).select("url", "s.*")


def with_links_under(pages: DataFrame, ids: list[str], path: str) -> DataFrame:
    """(url, id, links) for pages (url, html) and each element id."""
    read = F.pandas_udf(lambda html: pd.Series([[{"id": k, "links": v} for k, v in links_under(p, ids, path).items()] for p in html]), "array<struct<id: string, links: array<string>>>")
    return pages.select("url", F.explode(read("html")).alias("s")).select("url", "s.*")


def with_catalog_page(pages: DataFrame, path: str) -> DataFrame:
    """(url, total, first, last, links) for pages (url, html)."""
    read = F.pandas_udf(lambda html: pd.DataFrame([catalog_page(p, path) for p in html], columns=["total", "first", "last", "links"]), "total long, first long, last long, links array<string>")
    return pages.select("url", read("html").alias("s")).select("url", "s.*")


def embedded_names(html: Column, key: str) -> Column:
    """Distinct names in order, under `key` in embedded JSON, escaped or plain; escapes are decoded where they can be."""
    decoded = lambda x: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), x, F.lit('"}')), "$.v"), x)
    escaped = F.transform(F.regexp_extract_all(html, F.lit(rf'\\"{key}\\":\\"(.*?)\\"'), F.lit(1)), decoded)
    plain = F.transform(F.regexp_extract_all(html, F.lit(rf'"{key}":"(.*?)"'), F.lit(1)), decoded)
    return F.array_sort(F.filter(F.array_distinct(F.concat(escaped, plain)), lambda x: x != ""))


NO_LINKS = "songs declared, none linked"


def source_rows(page: str | None, parser: str | None, sections: dict[str, str], path: str, ids: list[str]) -> list[tuple]:
    """(section, link, fault) of one source page, by its parser, from one tree; a page that can't be read is one row with its fault."""
    try:
        top = tree(page)
        if parser == "annual":
            return [(name, link, None) for name, heading in sections.items() for link in section_links(top, heading, path)]
        if parser == "lists":
            return [(name, link, None) for name, links in links_under(top, ids, path).items() for link in links]
        if parser == "artist-catalog":
            found = catalog_page(top, path)
            if found["total"] > 0 and not found["links"]:
                return [("artist", None, NO_LINKS)]
            return [("artist", link, None) for link in found["links"]]
    except (ValueError, TypeError, AttributeError, AssertionError, RecursionError) as e:
        return [(None, None, f"unreadable page: {e}"[:200])]
    return [(None, None, "unknown parser")]


class SourceReader:
    """Table function: the rows of one page after another, sent back in Arrow batches."""

    def eval(self, html: str, parser: str, settings: str):
        asked = self.asked = getattr(self, "asked", None) or json.loads(settings)  # the same for all pages
        yield from source_rows(html, parser, asked["sections"], asked["path"], asked["ids"])


def dispatched(pages: DataFrame, sections: dict[str, str], path: str, ids: list[str]) -> DataFrame:
    """(id, section, link, fault) of source pages (id, url, parser, html) by their parser, in one pass: each page is read once.

    A page that declares songs but has no links, that can't be read, or whose parser isn't known, is at fault.
    """
    read = F.udtf(SourceReader, returnType="section string, link string, fault string", useArrow=True)
    settings = F.lit(json.dumps({"sections": sections, "path": path, "ids": ids}))
    rows = pages.select("id", "parser", "html")
    return rows.lateralJoin(read(F.col("html").outer(), F.col("parser").outer(), settings)).select("id", "section", "link", "fault")
