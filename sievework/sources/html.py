"""Visible text of HTML pages."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is not shown.
HIDDEN = {"script", "style", "noscript"}
#: Comments, declarations, and tags with their slash and name; quoted values may hold a closing bracket.
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:"[^"]*"|'[^']*'|[^>"'])*>""", re.S)
#: Elements whose content holds no tags but their own end.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}


def text_of(page: str | None) -> str | None:
    """Runs of text outside of hidden elements, one a line; a page that ends in a hidden element shows no more."""
    if page is None:
        return None
    shown, unseen, at = [], [], 0
    while at < len(page):
        mark = _MARK.search(page, at)
        run = page[at : mark.start() if mark else len(page)]
        if not unseen and (run := unescape(run).strip()):
            shown.append(re.sub("[ \t]+", " ", run))
        if mark is None:
            break
        at, name = mark.end(), (mark["name"] or "").lower()
        if name in HIDDEN and mark["end"]:
            del unseen[-1:]
        elif name in HIDDEN:
            unseen.append(name)
            if name in _RAW:
                close = _RAW[name].search(page, at)
                at = close.start() if close else len(page)
    return "\n".join(shown)


@F.pandas_udf(T.StringType())
def visible(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


def visible_text(pages: DataFrame, key: str, column: str) -> DataFrame:
    """key, visible: text nodes outside of hidden elements, one a line, blanks collapsed."""
    return pages.select(key, visible(F.col(column)).alias("visible"))


def enough_articles(column, least: int = 400):
    """Whether a downloaded code has as many article marks as a whole one."""
    return F.regexp_count(column, F.lit("第[一二三四五六七八九十百千零〇0-9]+条")) >= least
