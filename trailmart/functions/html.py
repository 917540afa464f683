"""Visible text and links of HTML, with the standard library's parser over Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = frozenset({"style", "script", "head", "title", "meta"})
SEPARATOR = " [SEP] "


class VisibleText(HTMLParser):
    def __init__(self, rich: bool = False):
        super().__init__(convert_charrefs=True)
        self.rich, self.hidden, self.buttons = rich, 0, 0
        self.parts: list[str] = []
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN and tag != "meta"
        self.buttons += tag == "button"
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        self.buttons = max(0, self.buttons - (tag == "button"))

    def handle_data(self, data):
        text = data.strip()
        if text and not self.hidden:
            self.parts.append(f"[button] {text} [button_]" if self.rich and self.buttons else text)


def visible_text(html: str, rich: bool = False) -> str:
    parser = VisibleText(rich)
    parser.feed(html)
    parser.close()
    return SEPARATOR.join(parser.parts)


@F.pandas_udf(T.StringType())
def html_text(values: pd.Series) -> pd.Series:
    """The visible text, parts joined by [SEP]. Null stays null; broken markup is read as far as it goes."""
    return values.map(visible_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_links(values: pd.Series) -> pd.Series:
    def links(html: str) -> list[str]:
        parser = VisibleText()
        parser.feed(html)
        return parser.links

    return values.map(links, na_action="ignore")


class Page(VisibleText):
    """What a product page states: title, price, options of its selections, and marked features."""

    def __init__(self):
        super().__init__()
        self.title, self.price, self.features, self.options = "", "", [], {}
        self.open: list[str] = []
        self.kinds: list[str] = []
        self.name = ""

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        a = dict(attrs)
        named = " ".join(filter(None, (a.get("class"), a.get("id"), a.get("itemprop")))).lower()
        if tag == "select":
            self.name = (a.get("name") or "").strip().strip(":")
        kind = "title" if tag == "h1" else "option" if tag == "option" else "price" if "price" in named else "feature" if tag == "li" else ""
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.open.append(tag)
            self.kinds.append(kind or (self.kinds[-1] if self.kinds else ""))

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        while self.open and tag in self.open:
            self.kinds.pop()
            if self.open.pop() == tag:
                break

    def handle_data(self, data):
        super().handle_data(data)
        text, kind = " ".join(data.split()), self.kinds[-1] if self.kinds else ""
        if not text:
            return
        if kind == "title":
            self.title = self.title or text
        elif kind == "price":
            self.price = self.price or text
        elif kind == "feature":
            self.features.append(text)
        elif kind == "option" and "select" not in text.lower():
            self.options.setdefault(self.name, []).append(text)


def page_of(html: str) -> dict:
    page = Page()
    page.feed(html)
    page.close()
    return {"title": page.title, "price": page.price, "features": page.features, "options": page.options}


def html_products(df, key: str, html: str):
    """(key, title, price, features, options) of product pages; one map over the rows. Null gives empty fields."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for rows in batches:
            found = [page_of(h or "") for h in rows[html]]
            yield pd.DataFrame({key: rows[key], **{c: [f[c] for f in found] for c in ("title", "price", "features", "options")}})

    return df.select(key, html).mapInPandas(run, f"`{key}` {kind}, title string, price string, features array<string>, options map<string,array<string>>")


def button_of(buttons: dict[str, str], wanted: str) -> str | None:
    """The target of the button whose text is the wanted one but for case and outer space."""
    return {k.strip().casefold(): v for k, v in buttons.items()}.get(wanted.strip().casefold())
