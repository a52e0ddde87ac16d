"""Relative links in columns: an address as seen from a page, by a fold over path segments with a stack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority with its slashes, path, parameters of the last segment, query, fragment (RFC 3986, appendix B)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#;]*(?:;[^?#/]*/[^?#;]*)*)(;[^?#]*)?(\?[^#]*)?(#.*)?$"
#: Schemes whose links are relative to each other.
_HIERARCHIC = ("http", "https")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def segments(parts: Column) -> Column:
    """A path's segments with dot segments taken out: . goes, .. takes the one before it along, and a path that ends in
    either ends in a slash. Any depth."""
    none = F.array().cast("array<string>")

    def step(stack: Column, s: Column) -> Column:
        # Above the root there is nothing to take along.
        return F.when(s == ".", stack).when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(s)))

    kept = F.aggregate(parts, none, step)
    return F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def resolve(base: Column, link: Column) -> Column:
    """link as seen from the page at base. Line feeds and tabs in links are dropped, as are control characters and spaces
    before them; a link of a scheme that isn't hierarchic, or of another one than the page's, stays what it is; null stays
    null."""
    link = F.regexp_replace(F.regexp_replace(link, r"[\r\n\t]", ""), r"^[\x00-\x20]+", "")
    own, at = F.lower(_part(link, 1)), F.lower(_part(base, 1))
    authority, path, params, query, fragment = (_part(link, i) for i in range(2, 7))
    query, fragment = (F.when(x.isin("?", "#"), "").otherwise(x) for x in (query, fragment))
    folder = F.regexp_replace(_part(base, 3), r"[^/]*$", "")
    # Where a folder is put before a path, empty segments between their ends go.
    put = F.split(F.concat(folder, path), "/", -1)
    put = F.filter(put, lambda s, i: (i == 0) | (i == F.size(put) - 1) | (s != ""))
    joined = F.array_join(segments(F.when(F.startswith(path, F.lit("/")), F.split(path, "/", -1)).otherwise(put)), "/")
    joined = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    same_page = (path == "") & (params == "")
    whole = F.when(same_page, F.concat(_part(base, 3), _part(base, 4), F.when(query == "", _part(base, 5)).otherwise(query))).otherwise(F.concat(joined, params, query))
    foreign = (own != "") & (~own.isin(*_HIERARCHIC) | (own != at))
    head = F.concat(F.when(own == "", at).otherwise(own), F.lit(":"))
    return (
        F.when(link == "", base)
        .when(foreign, link)
        .when(F.char_length(authority) > 2, F.concat(head, authority, path, params, query, fragment))
        .otherwise(F.concat(head, _part(base, 2), whole, fragment))
    )
