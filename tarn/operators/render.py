"""Presentation sinks as columns: HTML cards (escaped) and card columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML escapes, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escaped(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(c, F.lit("")))


def info_card(title: Column, body: Column) -> Column:
    return F.concat(F.lit('<div class="card"><h4>'), escaped(title), F.lit("</h4><p>"), escaped(body), F.lit("</p></div>"))


def source_card(title: Column, meta: Column, url: Column) -> Column:
    link = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit('<a href="'), escaped(url), F.lit('">'), escaped(url), F.lit("</a>"))).otherwise("")
    return F.concat(F.lit('<div class="source"><b>'), escaped(title), F.lit("</b><span>"), escaped(meta), F.lit("</span>"), link, F.lit("</div>"))


def card_column(ordinal: Column, columns: int = 3) -> Column:
    return F.pmod(ordinal, F.lit(columns))
