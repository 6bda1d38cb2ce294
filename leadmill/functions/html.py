"""Column functions that cut html into its parts. None needs a join: parts of a page are arrays in its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadmill.functions.text import bound

#: An item up to its end, the next item or the end of its list.
ITEM = r"(?is)<(?:li|dd)(?:\s[^>]*)?>(.*?)(?:</(?:li|dd|ul|ol|dl)\s*>|(?=<(?:li|dt|dd)[\s>])|\z)"
PAIR = r"(?is)<dt(?:\s[^>]*)?>((?:(?!<dt[\s>]).)*?)(?:</dt\s*>)?\s*<dd(?:\s[^>]*)?>(.*?)(?=</dd|<dt|<dd|</dl|\z)"
#: A label element without markup, and the element that follows it (looked at only, so that it can be a label too).
SIBLINGS = r"(?is)<(span|div|td|th|dt|label)(?:\s[^>]*)?>([^<]*)</\1\s*>(?=\s*<(span|div|td|a|p)(?:\s[^>]*)?>(.*?)</\3\s*>)"
TABLE = r"(?is)<table(?:\s[^>]*)?>(.*?)(?:</table\s*>|\z)"
ROW = r"(?is)<tr(?:\s[^>]*)?>(.*?)(?=</tr|<tr[\s>]|</table|\z)"
CELL = r"(?is)<t[dh](?:\s[^>]*)?>(.*?)(?=</t[dh]|<t[dh][\s>]|\z)"
FORM = r"(?is)<form(?:\s[^>]*)?>.*?(?:</form\s*>|(?=<form[\s>])|\z)"
FIELD = r"""(?i)<(?:input|textarea|select)(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?>"""
META = r"""(?i)<meta\s(?:[^>"']|"[^"]*"|'[^']*')*>"""
JSON_LD = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
LINK = r"""(?is)<a\s((?:[^>"']|"[^"]*"|'[^']*')*)>(.*?)(?=</a[\s>]|<a\s|\z)"""
HEADING = r"(?is)<(h[23])(?:\s[^>]*)?>([^<]*)</\1\s*>"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a group, as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def every_pair(text: Column, pattern: str, a: int, b: int) -> Column:
    """All matches of two groups, as an array of structs a, b."""
    return F.arrays_zip(every(text, pattern, a).alias("a"), every(text, pattern, b).alias("b"))


def attribute(tag: Column, names: str) -> Column:
    """The value of the tag's first attribute of one of the names, empty if none."""
    bare = lambda v: F.when(v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return bound(F.regexp_extract(tag, rf"""(?i)[\s"'](?:{names})\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), bare)


def unescaped(text: Column) -> Column:
    """The commonest character references resolved."""
    return bound(text, lambda t: F.when(F.contains(t, F.lit("&")), resolved(t)).otherwise(t))  # most texts hold none


def resolved(text: Column) -> Column:
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def inner_text(html: Column, between: str = "") -> Column:
    """Text without tags, squeezed and trimmed."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", between)), r"[\s　]{2,}|[\t-\r　]", " "))  # single spaces stay where they are


def outside_scripts(html: Column) -> Column:
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script\s*>", r"(?is)<style[^>]*>.*?</style\s*>", r"(?is)<noscript[^>]*>.*?</noscript\s*>"):
        html = F.regexp_replace(html, pattern, " ")
    return html


def lines(html: Column) -> Column:
    """Lines of the visible text, trimmed; tags end a line."""
    text = F.regexp_replace(outside_scripts(html), r"(?s)<[^>]*>", "\n")
    return F.filter(F.transform(F.split(unescaped(text), r"\n"), lambda x: F.trim(x)), lambda x: x != "")


def meta_content(html: Column, name: str) -> Column:
    """The content of the first meta tag of a name or property, null if none."""
    tag = F.get(F.filter(every(html, META), lambda t: F.lower(attribute(t, "name|property")) == name), F.lit(0))
    return unescaped(attribute(tag, "content"))


def footer_text(html: Column) -> Column:
    """The footer's text; without one, the last fifth of the visible text."""
    last = lambda t: F.trim(F.substring(t, F.floor(F.length(t) * 0.8).cast("int") + 1, F.length(t)))
    tail = bound(inner_text(outside_scripts(html), " "), last)
    part = F.regexp_extract(html, r"(?is)<footer[^>]*>(.*?)(?:</footer\s*>|\z)", 1)
    return F.when(html.rlike(r"(?i)<footer[\s>]"), inner_text(part, " ")).otherwise(tail)
