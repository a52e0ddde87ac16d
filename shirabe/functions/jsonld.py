"""JSON-LD in columns: documents as VARIANT, strictly one in a block, and the types that they tell.

A block counts as readable if it is one JSON document and nothing else. The reader of variants stops behind the
first value, so a block is read twice, inside an array and inside an object: only what is one whole value survives both
(`1] x` and `1} x` each fail one). Numbers that JSON hasn't got (NaN) and objects that name a key twice aren't
readable. Null html has no blocks; a block without a character isn't readable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A script element whose type names linked data; group 1 is its text.
SCRIPT = r"""(?is)<script\b(?=[^>]*?\btype\s*=\s*(?:"[^"]*ld\+json|'[^']*ld\+json|[^\s"'>]*ld\+json))[^>]*>(.*?)</script"""


def blocks(html: Column) -> Column:
    """The texts of the page's blocks, in order."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), F.array().cast("array<string>"))


def document(block: Column) -> Column:
    """The block's document as VARIANT; null if it isn't one."""
    listed = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), block, F.lit("}")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(alone & named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _each(value: Column) -> Column:
    """The elements of a list; any other value as the only element."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def _named(node: Column, name: str) -> Column:
    return F.try_variant_get(node, f'$["{name}"]', "variant")


def document_types(doc: Column) -> Column:
    """The types of a document's nodes: of the root, or of each that a list at the root has, and of those one level
    inside @graph. A type is a text; a list of types gives each of its texts."""
    nodes = _each(doc)
    inner = F.flatten(F.transform(nodes, lambda n: F.coalesce(F.try_variant_get(n, '$["@graph"]', "array<variant>"), F.array().cast("array<variant>"))))
    kinds = F.flatten(F.transform(F.concat(nodes, inner), lambda n: _each(_named(n, "@type"))))
    texts = F.filter(kinds, lambda k: F.coalesce(F.schema_of_variant(k) == "STRING", F.lit(False)))
    return F.transform(texts, lambda k: F.try_variant_get(k, "$", "string"))


def types(html: Column) -> Column:
    """The distinct types of all readable blocks of a page, in order of their names."""
    docs = F.filter(F.transform(blocks(html), document), lambda d: d.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(F.transform(docs, document_types))))


def invalid(html: Column) -> Column:
    """How many blocks of a page aren't readable."""
    return F.size(F.filter(blocks(html), lambda b: document(b).isNull()))
