"""Links of HTML pages by CSS selectors."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql.functions import udtf

#: A part of a selector without combinators: a tag or *, .class, #id, [name], or [name op 'value'].
_PART = re.compile(r"""\s*(?:(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:'(?P<one>[^']*)'|"(?P<two>[^"]*)"|(?P<bare>[^\]\s]*))\s*)?\])""", re.VERBOSE)
_MATCH = {
    "=": lambda have, want: have == want,
    "*=": lambda have, want: want != "" and want in have,
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(f"{want}-"),
}


def compiled(selector: str) -> list[list]:
    """For each of the selector's alternatives, tests of (tag, attributes), all of which must hold."""
    out = []
    for alternative in re.split(r""",(?=(?:[^'"]|'[^']*'|"[^"]*")*$)""", selector):
        tests, at = [], 0
        alternative = alternative.strip()
        while at < len(alternative):
            m = _PART.match(alternative, at)
            if not m or (at and alternative[at].isspace()):
                raise ValueError(f"not a selector without combinators: {selector!r}")
            at = m.end()
            want = next((v for v in (m["one"], m["two"], m["bare"]) if v is not None), None)
            if m["tag"]:
                tests.append(lambda tag, attrs, t=m["tag"].lower(): t in ("*", tag))
            elif m["cls"]:
                tests.append(lambda tag, attrs, c=m["cls"]: c in (attrs.get("class") or "").split())
            elif m["id"]:
                tests.append(lambda tag, attrs, i=m["id"]: attrs.get("id") == i)
            elif m["op"]:
                tests.append(lambda tag, attrs, n=m["name"].lower(), f=_MATCH[m["op"]], w=want: n in attrs and f(attrs[n] or "", w))
            else:
                tests.append(lambda tag, attrs, n=m["name"].lower(): n in attrs)
        if not tests:
            raise ValueError(f"an empty selector in {selector!r}")
        out.append(tests)
    return out


class _Anchors(HTMLParser):
    """Anchors that match, with the text within them; an anchor within an anchor ends the outer one."""

    def __init__(self, alternatives: list[list]):
        super().__init__()
        self.alternatives, self.found, self.label, self.hidden = alternatives, [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "a":
            self.label = None
            first: dict = {}
            for name, value in attrs:
                first.setdefault(name, value)
            if first.get("href") and any(all(t(tag, first) for t in tests) for tests in self.alternatives):
                self.label = []
                self.found.append((first["href"], self.label))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "a":
            self.label = None

    def handle_data(self, data):
        if self.label is not None and not self.hidden:
            self.label.append(data)


def links(html: str | None, selector: str = "a") -> list[tuple[str, str]]:
    """(href, label) of the page's matching anchors, in order; white space of labels is one space."""
    parser = _Anchors(compiled(selector))
    parser.feed(html or "")
    parser.close()
    return [(href, " ".join(" ".join(label).split())) for href, label in parser.found]


@udtf(returnType="pos int, link string, label string")
class Links:
    """links() as a table function of (html, selector)."""

    def eval(self, html: str, selector: str):
        for pos, (href, label) in enumerate(links(html, selector)):
            yield pos, href, label


#: Selectors of known sites' listings, by a part of the host.
SELECTORS = {
    "atorus.ru": "a[href*='/news/']",
    "ratanews.ru": "a[href*='/news/']",
    "tourdom.ru": "a[href*='/news/']",
    "gazprombank.ru": "a[href*='/press/']",
    "raiffeisen.ru": "a[href*='/about/press/']",
    "finversia.ru": "a[href*='/news/']",
    "kommersant.ru": "a[href*='/doc/']",
    "aeroflot.ru": "a[href*='/news/']",
    "frankrg.com": "a.news-card",
    "banki.ru": "a[href*='/news/'][href*='/lenta/'], a[href*='/news/daytheme/'], a[href*='/news/?'][class*='news']",
    "tbank.ru": "a[href*='/about/news/'], a[href*='/blog/tag/news/']",
    "tinkoff.ru": "a[href*='/about/news/'], a[href*='/blog/tag/news/']",
    "vtb.ru": "a[href*='/about/press/'], a[href*='/personal/investicii/press/']",
}
