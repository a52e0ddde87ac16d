"""HTML character references in columns: one tokenising pattern, and lookups of what it finds.

Names are those of the standard library's table. With a semicolon the whole name counts; without one, or where the
whole is no name, the longest name at its beginning that may stand without. Numbers give their code point; those that
HTML remaps give what it says, code points that are no characters give nothing, and those out of range the replacement
character. Anything else stays as it is; null stays null."""

from __future__ import annotations

from functools import cache
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Numbers that mean the characters of an old code page, and 0 and 13.
REMAPPED = {0x00: "�", 0x0D: "\r"} | {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
#: What is no character, besides every plane's last two.
NO_CHARACTERS = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF))


@cache
def _names() -> tuple[dict[str, str], str]:
    """All names, and a pattern of those that may stand without a semicolon, the longest first."""
    short = sorted((n for n in entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return entities.html5, "^(" + "|".join(short) + ")"


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _by_initial(body: Column) -> Column:
    """A name's characters. Names are told apart by their first letter first, so a lookup goes over few of them."""
    names, _ = _names()
    found: Column | None = None
    for c in sorted({n[0] for n in names}):
        own = {n: v for n, v in names.items() if n[0] == c}
        test = F.startswith(body, F.lit(c))
        found = F.when(test, _lookup(own, body)) if found is None else found.when(test, _lookup(own, body))
    assert found is not None
    return found


def _number(body: Column) -> Column:
    hexadecimal = body.rlike("^#[xX]")
    digits = F.regexp_replace(F.regexp_extract(body, r"^#[xX]?([0-9a-fA-F]+)", 1), "^0+(?=.)", "")
    # Longer numbers are out of range, whatever they are.
    n = F.when(F.char_length(digits) > 9, F.lit(0x110000)).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))
    nothing = F.pmod(n, F.lit(0x10000)) >= 0xFFFE
    for lo, hi in NO_CHARACTERS:
        nothing = nothing | n.between(lo, hi)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(_lookup(REMAPPED, n.cast("int")), F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "�").when(nothing, "").otherwise(char))


def unescape(text: Column) -> Column:
    """text with its character references replaced."""
    _, short = _names()

    def one(token: Column) -> Column:
        body = F.substring(token, 2, 40)
        name = F.regexp_extract(body, short, 1)
        rest = F.when(name != "", F.concat(_by_initial(name), F.substr(body, F.char_length(name) + 1))).otherwise(token)
        return F.when(F.startswith(body, F.lit("#")), _number(F.substr(token, F.lit(2)))).otherwise(F.coalesce(_by_initial(body), rest))

    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), one)
    gaps = F.split(text, TOKEN, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, f: F.concat(g, f)), ""), F.element_at(gaps, -1))
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)
