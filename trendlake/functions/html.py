"""Elements and texts of HTML, as functions of columns. Elements end where their own tags balance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, clean

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: Elements that stand on lines of their own, and named references besides numeric ones.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "middot": "·", "bull": "•", "euro": "€", "pound": "£", "yen": "¥", "deg": "°", "times": "×", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "ntilde": "ñ",
}
_REFERENCE = r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);"


def opening(tag: str = "[A-Za-z][A-Za-z0-9]*", css_class: str | None = None) -> str:
    """Pattern of an element's start tag, whose group is the tag's name."""
    if css_class is None:
        return rf"<({tag})\b{_ATTRIBUTES}>"
    one = "|".join(rf"{q}(?:[^{q}]*\s)?{css_class}(?:\s[^{q}]*)?{q}" for q in "\"'")
    return rf"<({tag})(?=\s[^>]*\bclass\s*=\s*(?:{one}|{css_class}(?=[\s/>]))){_ATTRIBUTES}>"


def visible(page: Column) -> Column:
    """A page without comments, scripts and styles."""
    return F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")


def content(html: Column, start: str) -> Column:
    """What is in the first element whose start tag matches, null where there is none. Tags of the element's name that follow are counted up and down: it ends where the count first is back at none, or with the text."""

    def cut(m: Column) -> Column:
        own = F.concat(F.lit("</?"), m["name"], F.lit(r"\b"))
        parts = F.split(m["rest"], F.concat(F.lit("(?i)(?="), own, F.lit(")")))
        # a tag that stands first is no boundary to split(): an empty part stands before it
        return F.when(F.regexp_like(m["rest"], F.concat(F.lit("(?i)^"), own)), F.concat(F.array(F.lit("")), parts)).otherwise(parts)

    def inner(parts: Column) -> Column:
        step = F.transform(parts, lambda p, i: F.when(i == 0, 1).when(p.startswith("</"), -1).otherwise(1))
        # (count so far, parts that count as inside)
        ended = F.aggregate(step, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("over")), _count)
        return F.array_join(F.slice(parts, F.lit(1), ended["n"]), "")

    def found(h: Column) -> Column:
        m = F.struct(F.regexp_extract(h, f"(?is){start}", 1).alias("name"), F.regexp_extract(h, f"(?is){start}(.*)\\z", 2).alias("rest"))
        return F.when(h.rlike(f"(?is){start}"), bound(m, lambda m: bound(cut(m), inner)))

    # each step is bound to a name, so that none is computed again where the next one reads it twice
    return bound(html, found)


def _count(state: Column, step: Column) -> Column:
    depth = state["depth"] + step
    over = state["over"] | (depth <= 0)
    return F.struct(depth.alias("depth"), F.when(over, state["n"]).otherwise(state["n"] + 1).alias("n"), over.alias("over"))


def contents(page: Column, start: str) -> Column:
    """What is in each element whose start tag matches, in order; one that holds others like it is one of them, as they are."""
    tails = F.filter(F.split(page, f"(?is)(?={start})"), lambda p: p.rlike(f"(?is)^{start}"))
    return F.transform(tails, lambda p: content(p, start))


def attribute(html: Column, name: str) -> Column:
    """The value of an attribute of the tag that html begins with, in quotes of either kind or none; '' where it has none."""
    value = F.regexp_extract(html, rf"(?is)^<[A-Za-z][^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return decoded(F.regexp_replace(value, r"""^["']|["']$""", ""))


def decoded(text: Column) -> Column:
    """text with its character references decoded, once: numeric ones of any script, named ones of NAMED, all others as they are."""
    table = F.create_map(*(F.lit(x) for k, v in (NAMED | {"amp": "&"}).items() for x in (k, v)))

    def one(token: Column) -> Column:
        return F.when(token.startswith("&") & (F.length(token) > 1), bound(token, reference)).otherwise(token)

    def reference(token: Column) -> Column:
        body = F.regexp_extract(token, r"^&#?(.*);$", 1)
        code = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 8), 16, 10)).otherwise(body).try_cast("int")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(token.rlike(r"^&#"), F.coalesce(char, token)).otherwise(F.coalesce(F.try_element_at(table, body), token))

    tokens = lambda t: F.regexp_extract_all(t, F.lit(rf"{_REFERENCE}|[^&]+|&"), F.lit(0))
    return bound(text, lambda t: F.when(t.contains("&"), F.array_join(F.transform(tokens(t), one), "")).otherwise(t))


def text_of(html: Column) -> Column:
    """An element's text: tags of blocks part words, others don't; references decoded, white space single; null if blank."""
    spaced = F.regexp_replace(html, rf"(?i)</?(?:{BLOCKS})\b{_ATTRIBUTES}>", " ")
    return F.nullif(clean(F.replace(decoded(F.regexp_replace(spaced, rf"</?[A-Za-z]{_ATTRIBUTES}>", "")), F.lit(" "), F.lit(" "))), F.lit(""))
