"""The few functions that no column expression gives: Arrow batches, never single rows."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


_DECODE = json.JSONDecoder().raw_decode


def first_object(raw: str | None) -> str | None:
    """The first {...} that is JSON."""
    start = (raw or "").find("{")
    while start >= 0:
        try:
            return raw[start : _DECODE(raw, start)[1]]
        except (json.JSONDecodeError, RecursionError):
            start = raw.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def first_json_object(raw: pd.Series) -> pd.Series:
    return raw.map(first_object)


#: Elements whose text is dropped, and those whose text is kept.
NOISE = frozenset("script style nav header footer aside form iframe noscript svg button template".split())
KEPT = frozenset("h1 h2 h3 h4 p li blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_NAMES = ("cookie", "banner", "advert", "subscribe", "sidebar", "popup", "share", "related", "comment")


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list | None]] = []
        self.blocks: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        dropped = (self.open[-1][1] if self.open else False) or tag in NOISE or any(n in names for n in NOISE_NAMES)
        block = None
        if tag in KEPT and not dropped:
            block = []
            self.blocks.append(block)
        self.open.append((tag, dropped, block))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if self.open and not self.open[-1][1]:
            for _, _, block in self.open:
                if block is not None:
                    block.append(data)


def body_text(html: str | None, most: int = 2500, least: int = 8) -> str:
    """The texts of headings, paragraphs, items and quotes, without navigation and the like."""
    parser = _Blocks()
    parser.feed(html or "")
    parts = [t for b in parser.blocks if len(t := " ".join("".join(b).split())) >= least]
    return " ".join(parts)[:most]


@F.pandas_udf(T.StringType())
def article_text(html: pd.Series) -> pd.Series:
    return html.map(body_text)


def summarise(df, backend, title: str = "title", body: str = "text", topic: str = "topic"):
    """Adds summary, rating, rationale by backend.summarize_and_rate(title, text, topic): any model, a batch at a time."""
    names = df.columns

    def run(it):
        for pdf in it:
            got = [backend.summarize_and_rate(t or "", b or "", k or "") for t, b, k in zip(pdf[title], pdf[body], pdf[topic], strict=True)]
            yield pdf[names].assign(summary=[g["summary"] for g in got], rating=[int(max(1, min(5, g["rating"]))) for g in got], rationale=[g.get("rationale", "") for g in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, summary string, rating int, rationale string")
