"""Patterns with the semantics of the web scripts whose output is matched.

White space there covers more than Java's ``\\s`` and Spark's ``trim``; word
characters are ASCII only. Every pattern of this package is built on these
constants, so both rules hold everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inside of a character class: all white space, for Java's engine.
WS_INNER = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_INNER}]"
#: The same for engines whose \s lacks the vertical tab.
WS_INNER_RE2 = r"\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_RE2 = f"[{WS_INNER_RE2}]"
#: Tags that are left as they are (HTML's own).
HTML_TAGS = (
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup "
    "data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol "
    "optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strong style "
    "sub summary sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr"
).split()


def trim(c: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def padded(n: Column) -> Column:
    """A number with zeros up to three digits; longer ones stay whole."""
    return F.format_string("%03d", n.cast("long"))
