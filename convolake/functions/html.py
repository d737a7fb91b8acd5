"""HTML pages to text in one pass: a tokenizer of tags, attributes and
character references, and a small machine that writes the text."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: the start of a comment, a tag with its attributes (a quoted value may hold ``>``), a tag
#: with an unbalanced quote, or a declaration
_TOKEN = re.compile(r"""<!--
    |<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attributes2>[^>]*+)>
    |<[!?/][^>]*+>""", re.DOTALL | re.VERBOSE)
_COMMENT = re.compile("<!--(?P<name>)(?P<name2>)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: elements whose content is text up to their own end tag
_RAW = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.IGNORECASE) for name in ("script", "style", "title", "textarea")}
_BLOCKS = frozenset("p div br ul ol tr table section article header footer nav blockquote pre body html".split())
_HEADINGS = {f"h{n}": "\n" + "#" * n + " " for n in range(1, 7)}
_MARKS = {"b": "**", "strong": "**", "i": "_", "em": "_"}
_BLANKS = " \t\n\x0b\f\r"


def decode(text: str) -> str:
    """Named (with the full table, also the old names without ``;``) and
    numeric character references; a no-break space counts as a blank."""
    return html.unescape(text).replace("\xa0", " ") if "&" in text else text


def attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of each."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), decode("".join(values)))
    return found


def page_text(page: str) -> tuple[str, str]:
    """(text, title) of a page."""
    out: list[str] = []
    title, at, skipping = None, 0, False
    link = None  # (place of its bracket, target)
    last = page.rfind(">")  # no tag ends behind it, so none is looked for there
    while True:
        m = _TOKEN.search(page, at, max(last + 1, at)) or _COMMENT.search(page, max(at, last + 1))
        if not skipping:
            out.append(decode(page[at:m.start() if m else len(page)]))
        if m is None:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            out.append("" if skipping else " ")
            continue
        if not name:
            continue
        closing = bool(m["end"] or m["end2"])
        if name in _RAW and not closing:
            end = _RAW[name].search(page, at)
            content = page[at:end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if name == "title":
                title = decode(content) if title is None else title
            if not skipping:
                out.append(decode(content) if name in ("title", "textarea") else " ")
        elif name == "head":
            skipping = not closing
        elif skipping and not (name == "body" and not closing):
            continue
        elif name == "a":
            if closing and link:
                out.append(f"]({link[1]})")
            elif link:
                out[link[0]] = ""  # never closed
            href = None if closing else attributes(m["attributes"] or m["attributes2"] or "").get("href")
            link = None if href is None else (len(out), href)
            out.append("[" if link else "")
        elif name == "li":
            out.append("" if closing else "\n  * ")
        elif name in _HEADINGS:
            out.append("\n" if closing else _HEADINGS[name])
        elif name in _BLOCKS:
            skipping = False
            out.append("\n")
        else:
            out.append(_MARKS.get(name, ""))
    if link:
        out[link[0]] = ""
    text = re.sub(r"[ \t\r\f]+", " ", "".join(out))
    text = re.sub(r" ?\n[ \n]*", "\n", text)
    return text.strip(_BLANKS), (title or "").strip(_BLANKS)


_PAGE = StructType([StructField("text", StringType()), StructField("title", StringType())])


def page_column(c: Column) -> Column:
    """A struct of ``text`` and ``title``; nulls for a null page."""

    @F.pandas_udf(_PAGE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_text(p) if isinstance(p, str) else (None, None) for p in pages], columns=["text", "title"])

    return parse(c)
