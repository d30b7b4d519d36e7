"""Messages read from channel pages, and titles, links and paragraphs from any page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from askbook.shipping import ship

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PREFIX = "tgme_widget_message"


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = (attrs.get("class") or "").split()

    def walk(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def having(self, name: str, tag: str | None = None) -> list[Element]:
        return [e for e in self.walk() if name in e.classes and (tag is None or e.tag == tag)]

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                yield from c.strings()

    def text(self, between: str = "\n") -> str:
        return between.join(s for s in (x.strip() for x in self.strings()) if s)


class Tree(HTMLParser):
    """Elements of a page; an end tag closes up to its start, one without start is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Element:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


def views(text: str, compat: bool) -> int | None:
    """1.2K as 1200, 3M as 3000000; compat reads K as three zeros with the point dropped, and no M."""
    bare = text.replace(" ", "").replace(",", "")
    if compat:
        bare = bare.replace("K", "000").replace(".", "")
        return int(bare) if bare.isdigit() else None
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([KkMm]?)", bare)
    return round(float(m[1]) * {"": 1, "k": 1000, "m": 1_000_000}[m[2].lower()]) if m else None


def messages_of(html: str | None, compat: bool = False) -> list[dict]:
    """The posts of a channel page. A quoted parent's text inside a reply is not the post's own."""
    out = []
    for wrap in tree(html).having(f"{PREFIX}_wrap"):
        post = next(iter(wrap.having(PREFIX)), None)
        ids = (post.attrs.get("data-post") or "").split("/") if post else []
        if len(ids) != 2 or not ids[1].isdigit():
            continue
        when = next((e for e in post.walk() if e.tag == "time"), None)
        reply = next(iter(post.having(f"{PREFIX}_reply", "a")), None)
        target = re.search(r"/(\d+)\s*$", (reply.attrs.get("href") or "").rstrip("/")) if reply else None
        own = next((e for e in post.having(f"{PREFIX}_text") if "js-message_reply_text" not in e.classes), None)
        seen = next(iter(post.having(f"{PREFIX}_views")), None)
        out.append({
            "message_id": int(ids[1]), "posted_at": when.attrs.get("datetime") if when else None, "message_text": own.text() if own else None,
            "photos_count": len(post.having(f"{PREFIX}_photo_wrap")), "views": views(seen.text(""), compat) if seen else None, "reply_to": int(target[1]) if target else None,
        })
    return out


MESSAGES = "channel string, message_id bigint, posted_at string, message_text string, photos_count int, views bigint, reply_to bigint"


def parse_messages(pages: DataFrame, compat: bool = False) -> DataFrame:
    """Messages of pages (channel, html). Spark has no parser of HTML, so batches of pages go through Python."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"channel": c, **m} for c, h in zip(f["channel"], f["html"]) for m in messages_of(h, compat)]
            kinds = {"message_id": "Int64", "photos_count": "Int32", "views": "Int64", "reply_to": "Int64"}
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MESSAGES.split(", ")]).astype(kinds)

    ship(pages.sparkSession)
    return pages.select("channel", "html").mapInPandas(run, MESSAGES)


def terminated(html: str | None) -> str:
    """The page with each ampersand escaped that begins no reference ended by a semicolon, so that the parser leaves it and what follows as they are."""
    return re.sub(r"&(#\d+;|#[xX][0-9a-fA-F]+;|\w+;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html or "")


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, title, links and paragraphs of pages (page_id, html). Only references ended by a semicolon are read: a title cut at "&amp" keeps these letters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, h in zip(f["page_id"], f["html"]):
                every = list(tree(terminated(h)).walk())
                title = next((e.text(" ") for e in every if e.tag == "title"), None)
                rows.append((i, title, [e.attrs["href"] for e in every if e.tag == "a" and e.attrs.get("href")], sum(e.tag == "p" for e in every)))
            yield pd.DataFrame(rows, columns=["page_id", "title", "links", "paragraphs"])

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, title string, links array<string>, paragraphs int")


def read_channel_pages(fetch, channels: DataFrame, max_pages: int) -> DataFrame:
    """channel, page, html by an injected fetch(channel, before): pages backwards until there are no more, each channel in a task of its own."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["channel"]:
                before = None
                for n in range(max_pages):
                    html = fetch(c, before)
                    if html is None:
                        break
                    yield pd.DataFrame({"channel": [c], "page": [n], "html": [html]})
                    m = re.search(r'data-before="(\d+)"', html) or re.search(r'<link rel="prev" href="/s/[^/]+/\?before=(\d+)"', html)
                    if not m:
                        break
                    before = int(m[1])

    ship(channels.sparkSession)
    return channels.select("channel").mapInPandas(run, "channel string, page int, html string")


def probe_links(listings: DataFrame, check) -> DataFrame:
    """id, alive by an injected check(url) giving (status, body); an error of it keeps the listing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for u in f["url"]:
                try:
                    status, body = check(u)
                    out.append(status < 400 and len(body) >= 5000 and PREFIX in body)
                except OSError:
                    out.append(True)
            yield pd.DataFrame({"id": f["id"], "alive": out})

    ship(listings.sparkSession)
    return listings.select("id", "url").mapInPandas(run, "id string, alive boolean")
