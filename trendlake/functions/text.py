"""Text and URL functions of columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EDITORIAL, ENTITIES, EVENT_TYPES, ID_PATTERNS, SANITIZED, STOP_WORDS, TRACKING

#: Scheme, user, host, port, path, query and fragment of a strict absolute URL.
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^\s/?#@]*)@)?([A-Za-z0-9.\-]+|\[[0-9A-Fa-f:.]+\])(?::(\d*))?(/[^\s?#\"<>\\^`{|}]*)?(\?[^\s#\"<>\\^`{|}]*)?(#[^\s\"<>\\^`{|}]*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def _parameters(query: Column, keep, order: bool, encode: bool) -> Column:
    """The query's parameters that `keep` accepts by decoded name."""

    def decoded(x):
        return F.coalesce(F.try_url_decode(x), x)

    parts = F.filter(F.split(query, "&"), lambda p: keep(decoded(F.substring_index(p, "=", 1))))
    if order:
        numbered = F.transform(parts, lambda p, i: F.struct(decoded(F.substring_index(p, "=", 1)).alias("n"), i.alias("i"), p.alias("p")))
        parts = F.transform(F.array_sort(numbered), lambda s: s["p"])
    if encode:
        again = lambda x: F.replace(F.url_encode(decoded(x)), F.lit("+"), F.lit("%20"))
        parts = F.transform(parts, lambda p: F.concat(again(F.substring_index(p, "=", 1)), F.when(p.contains("="), F.concat(F.lit("="), again(F.substr(p, F.instr(p, "=") + 1)))).otherwise("")))
    return F.array_join(parts, "&")


def bound(value: Column, f) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, '/' for an empty path, parameters without tracking ones, by name, re-encoded; no fragment. What isn't an absolute URL comes back trimmed, a blank as it is."""
    t = F.trim(url)
    scheme, host, port = F.lower(_part(t, 1)), F.lower(_part(t, 3)), _part(t, 4)
    plain = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    user = _part(t, 2)
    query = F.when(F.length(_part(t, 6)) > 1, _parameters(F.substring(_part(t, 6), 2, 1 << 20), lambda n: ~(F.lower(n).startswith("utm_") | F.lower(n).isin(*TRACKING)), True, True)).otherwise("")
    path = F.when(_part(t, 5) == "", "/").otherwise(_part(t, 5))
    out = F.concat(scheme, F.lit("://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(t == "", url).when(t.rlike(_URL), out).otherwise(t)


def sanitized_url(url: Column) -> Column:
    """An http(s) URL without tracking parameters; order, case and fragment stay. Null for others."""
    t = F.trim(url)
    query = F.when(F.length(_part(t, 6)) > 1, _parameters(F.substring(_part(t, 6), 2, 1 << 20), lambda n: ~F.lower(n).isin(*SANITIZED), False, False)).otherwise("")
    user, port = _part(t, 2), _part(t, 4)
    out = F.concat(_part(t, 1), F.lit("://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), _part(t, 3), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), _part(t, 5), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), _part(t, 7))
    return F.when(t.rlike(_URL) & F.lower(_part(t, 1)).isin("http", "https"), out)


def host_of(url: Column) -> Column:
    """Lower-case host without one leading www.; null where there is none."""
    t = F.trim(url)
    return F.when(t.rlike(_URL), F.regexp_replace(F.lower(_part(t, 3)), r"^www\.", ""))


def publisher(url: Column, author: Column) -> Column:
    return F.coalesce(host_of(url), author)


def loose_host(url: Column) -> Column:
    """What follows the scheme, up to a slash, then a colon."""
    return F.substring_index(F.substring_index(F.regexp_replace(url, "^[A-Za-z]+://", ""), "/", 1), ":", 1)


def sql_domain(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:https?://)?(?:www\.)?([^/]+)", 1), F.lit(""))


def external_ids(url: Column, external_id: Column, title: Column, summary: Column, canonical: bool = False) -> Column:
    """A map of the ids that a URL tells (the first kind that fits), an arXiv number in the text, and the source's own id. `canonical`: the URL is so already."""
    u = url if canonical else canonical_url(url)
    arxiv = F.regexp_extract(u, ID_PATTERNS["arxiv"], 1)
    item = F.regexp_extract(u, ID_PATTERNS["hn_item"], 1)
    tweet = F.regexp_extract(u, ID_PATTERNS["tweet"], 2)
    pair = lambda p: F.when(u.rlike(p), F.concat(F.regexp_extract(u, p, 1), F.lit("/"), F.regexp_extract(u, p, 2)))
    said = F.regexp_extract(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))), ID_PATTERNS["said"], 1)
    some = lambda x: F.when(x != "", x)
    entries = F.array(
        F.struct(F.lit("arxiv").alias("k"), F.coalesce(some(arxiv), some(said)).alias("v")),
        F.struct(F.lit("github").alias("k"), pair(ID_PATTERNS["github"]).alias("v")),
        F.struct(F.lit("hf_model").alias("k"), pair(ID_PATTERNS["hf_model"]).alias("v")),
        F.struct(F.lit("hn_item").alias("k"), some(item).alias("v")),
        F.struct(F.lit("tweet").alias("k"), some(tweet).alias("v")),
        F.struct(F.lit("external").alias("k"), F.when(F.trim(external_id) != "", external_id).alias("v")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def normalized_title(title: Column) -> Column:
    """Without one editorial lead, lower-case, runs of other than a-z and 0-9 as one space."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(title), EDITORIAL, "")), "[^a-z0-9]+", " ")), F.lit(""))


def kept_words(said: Column) -> Column:
    """Distinct words of three letters or more that are no stop words, in order."""
    return F.array_distinct(F.filter(said, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def keywords(title: Column, summary: Column) -> Column:
    """kept_words() of a text."""
    return kept_words(words(title, summary))


def _plain(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


def words(title: Column, summary: Column) -> Column:
    """All runs of a-z and 0-9 of a text in small letters, in order; an empty one at either end, where the text has other characters there."""
    return F.split(F.lower(F.concat_ws(" ", title, summary)), "[^a-z0-9]+")


def entities(title: Column, summary: Column, said: Column | None = None) -> Column:
    """(type, value, display) of known names in a text, longest alias first, each once. `said`: the text's words(), if there is a column of them.

    A text is run through once, for the names' first words; it is searched for those names alone that have several words and whose first one it holds.
    """
    longest = sorted(((max(len(_plain(a)) for a in names), -i, kind, value, names) for i, (kind, value, names) in enumerate(ENTITIES)), reverse=True)
    aliases = lambda names, value: [a.split() for a in dict.fromkeys(map(_plain, (*names, value)))]
    every = [a for _, _, _, value, names in longest for a in aliases(names, value)]
    firsts, long = sorted({a[0] for a in every}), sorted({a[0] for a in every if len(a) > 1})
    literals = lambda texts: F.array(*map(F.lit, texts))

    def found(x):
        hit = lambda a: F.array_contains(x["firsts"], a[0]) if len(a) == 1 else x["text"].contains(f" {' '.join(a)} ")
        told = [(reduce(or_, map(hit, aliases(names, value))), kind, value, names[0]) for _, _, kind, value, names in longest]
        return F.array_compact(F.array(*(F.when(h, F.struct(F.lit(kind).alias("type"), F.lit(value).alias("value"), F.lit(name).alias("display"))) for h, kind, value, name in told)))

    def held(said, here):
        text = F.when(F.arrays_overlap(here, literals(long)), F.concat(F.lit(" "), F.array_join(said, " "), F.lit(" "))).otherwise("")
        return F.when(F.size(here) > 0, bound(F.struct(here.alias("firsts"), text.alias("text")), found)).otherwise(F.array().cast("array<struct<type: string, value: string, display: string>>"))

    def of(said):
        return bound(F.array_intersect(said, literals(firsts)), lambda here: held(said, here))

    return of(said) if said is not None else bound(words(title, summary), of)


def event_type(normalized: Column, summary: Column) -> Column:
    """The first type one of whose substrings is in the text. Arrow tasks tell it, as one pass of theirs looks for any number of substrings."""
    some = lambda x: F.when(F.trim(x) != "", F.concat(F.lit(" "), F.trim(x))).otherwise("")
    text = F.lower(F.concat(some(F.coalesce(normalized, F.lit(""))), some(F.coalesce(summary, F.lit("")))))
    return F.arrow_udf(_event_types, "string")(text)


def _event_types(text: pa.Array) -> pa.Array:
    either = lambda parts: "|".join(p.replace(".", r"\.") for p in parts)
    out = np.full(len(text), "UNKNOWN", object)
    rest = np.arange(len(text))
    rest = rest[pc.match_substring_regex(text, either([p for _, parts in EVENT_TYPES for p in parts])).to_numpy(zero_copy_only=False)]
    for name, parts in EVENT_TYPES:
        hit = pc.match_substring_regex(text.take(pa.array(rest)), either(parts)).to_numpy(zero_copy_only=False)
        out[rest[hit]], rest = name, rest[~hit]
    return pa.array(out, pa.string())


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_html(text: Column, between: str = "") -> Column:
    """clean() without tags (`between` in place of each), and with the five basic character references decoded, the ampersand's last."""
    out = F.regexp_replace(text, "<[^>]+>", between)
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(ch))
    return clean(out)


def distinct_ignoring_case(words: Column) -> Column:
    """The first spelling of each word."""
    return F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.array_append(acc, w)))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#\w+"), F.lit(0))


def query_tags(query: Column, either: bool = False) -> Column:
    """Words of a query; with `either`, its alternatives where it has any."""
    words = F.split(F.trim(query), r"\s+")
    return F.when(query.contains(" OR "), F.split(F.trim(query), r"\s+OR\s+")).otherwise(words) if either else words


def relative_time(at: Column, now: Column) -> Column:
    s = F.unix_seconds(now) - F.unix_seconds(at)
    return F.when(at.isNull(), "-").when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
