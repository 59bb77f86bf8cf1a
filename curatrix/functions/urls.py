"""URLs and links of HTML pages."""

from __future__ import annotations

import re
import urllib.parse as up
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import row_by_row

LINKS = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())]))


def slug(url: Column, default: str = "chart") -> Column:
    """The last part of the path that isn't empty."""
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(default))


def query_of(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))


def _pairs(query: Column) -> Column:
    """(key, value) of each part, decoded, in order; blank values stay."""
    parts = F.filter(F.split(query, "&"), lambda s: s != "")
    dec = lambda c: F.try_url_decode(c)
    return F.transform(parts, lambda p: F.struct(dec(F.substring_index(p, "=", 1)).alias("k"), dec(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))


def canonical_query(query: Column) -> Column:
    """Keys in order, the values of a key in order, decoded."""
    return F.array_join(F.transform(F.array_sort(_pairs(query)), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def export_url(url: Column, fmt: str) -> Column:
    """The image address of an embedded chart: the extension swapped, a format parameter where there is none, keys in order."""
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(\.png|\.svg)$", "")
    q = query_of(url)
    with_default = F.when(q.rlike("(^|&)download-format="), _pairs(q)).otherwise(F.concat(_pairs(q), F.array(F.struct(F.lit("download-format").alias("k"), F.lit(fmt).alias("v")))))
    by_key = F.transform(F.array_sort(F.transform(with_default, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"])))
    return F.concat(base, F.lit("." + fmt), F.lit("?"), F.array_join(by_key, "&"))


def chart_filename(url: Column, fmt: str) -> Column:
    """slug-<8 digits of the query's SHA-1>, or slug-base without a query."""
    q = canonical_query(query_of(url))
    tag = F.when(q == "", F.lit("base")).otherwise(F.substring(F.sha1(q.cast("binary")), 1, 8))
    return F.concat(slug(url), F.lit("-"), tag, F.lit("." + fmt))


def absolutize(url: Column, base: str) -> Column:
    return F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def page_number(url: Column, n: Column) -> Column:
    """Sets the page parameter, or takes it out for the first page."""
    q = query_of(url)
    others = F.filter(F.split(q, "&"), lambda p: (p != "") & ~p.rlike("^page(=|$)"))
    parts = F.when(n <= 1, others).otherwise(F.concat(others, F.array(F.concat(F.lit("page="), n.cast("string")))))
    return F.when(F.size(parts) > 0, F.concat(without_query(url), F.lit("?"), F.array_join(parts, "&"))).otherwise(without_query(url))


def api_url(host: str, agency: Column, dataset: Column, start: str | None = None, end: str | None = None, observation: str = "AllDimensions", fmt: str = "csvfilewithlabels") -> Column:
    tail = f"?format={fmt}&dimensionAtObservation={observation}" + (f"&startPeriod={start}" if start else "") + (f"&endPeriod={end}" if end else "")
    return F.format_string(f"{host}/%s,%s/all{tail.replace('%', '%%')}", agency, dataset)


def is_content_url(url: Column, base: str, excluded: list[str]) -> Column:
    """On the site, http(s), none of the excluded path prefixes, no fragment, no file extension."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    ok = url.startswith(base) & url.rlike("^https?://") & ~url.contains("#") & ~path.rlike(r"\.[a-zA-Z0-9]{2,4}$")
    for e in excluded:
        ok = ok & ~path.startswith(e)
    return ok


def source_class(columns: list[Column], patterns: dict[str, str]) -> Column:
    """The class of the first field that has one; within a field the first pattern that fits. The order of fields comes first."""
    def one(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, p in reversed(list(patterns.items())):
            out = F.when(F.lower(c).rlike(p), F.lit(name)).otherwise(out)
        return out

    return F.coalesce(*[one(c) for c in columns])


def attributes(html: Column, tag: str, attribute: str) -> Column:
    """Distinct values of a quoted attribute of a tag, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(html, F.lit(rf'(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*"([^"]*)"'), 1), lambda s: F.trim(s)), lambda s: s != ""))


def addresses(html: Column, host: str) -> Column:
    """Distinct raw and percent-decoded addresses of a host that stand in the page, in order."""
    found = F.regexp_extract_all(html, F.lit(rf"(https?://{re.escape(host)}[^\s\"'<>]*)"), 1)
    return F.array_sort(F.array_distinct(F.concat(found, F.transform(found, lambda u: F.coalesce(F.try_url_decode(u), u)))))


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.href, self.text = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.handle_endtag("a")
            self.href, self.text = dict(attrs).get("href"), []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href:
            self.found.append((self.href, "".join(self.text).strip()))
        if tag == "a":
            self.href = None


@row_by_row(LINKS)
def data_links(page, url):
    """Links to CSV files: those whose text offers one, then those whose address ends so; the first of each address."""
    parser = _Anchors()
    parser.feed(page or "")
    parser.handle_endtag("a")
    out = {}
    for offered in (True, False):
        for href, label in parser.found:
            if re.search(r"download.*\.csv", label, re.I) if offered else re.search(r"\.csv(\?|$)", href, re.I):
                out.setdefault(up.urljoin(url or "", href), label or "CSV")
    return [{"url": u, "label": x} for u, x in out.items()]


@row_by_row(T.ArrayType(T.StringType()))
def anchors(page, url):
    """Absolute addresses of all anchors, distinct, in order, by an HTML parser."""
    parser = _Anchors()
    parser.feed(page or "")
    parser.handle_endtag("a")
    return list(dict.fromkeys(up.urljoin(url or "", h.strip()) for h, _ in parser.found if h.strip()))
