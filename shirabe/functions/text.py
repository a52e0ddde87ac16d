"""Text functions: white space, display width, Japanese, mojibake."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from shirabe.functions.lazy import F

from shirabe.config import THRESHOLDS
from shirabe.functions import dual as D
from shirabe.functions.dual import Dual

#: Every character that counts as white space, in one class for all engines.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Hiragana, katakana and kanji ranges.
JAPANESE = r"[\x{3041}-\x{3093}\x{30A1}-\x{30F6}\x{4E00}-\x{9FA5}]"
#: Full-width letters and digits.
FULLWIDTH = r"[\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF10}-\x{FF19}]+"
#: UTF-8 read as Latin-1, or two replacement characters.
MOJIBAKE = r"[\x{C3}\x{C2}][\x{80}-\x{BF}]|\x{FFFD}{2,}"


@cache
def wide(full: str = "WFA") -> str:
    """A class of the characters that take a full cell: East Asian width W, F or A unless told otherwise, from
    the character database."""
    spans: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.east_asian_width(chr(code)) in full:
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def norm(x: Dual) -> Dual:
    """White space collapsed to one space, none at the ends."""
    one = D.sub(x, SPACE + "+", " ")
    return Dual(F.trim(one.col), f"trim({one.sql}, ' ')")


def visible_length(x: Dual, full: str = "WFA") -> Dual:
    """Width in full cells, rounded up: wide characters count 1, others half."""
    n, w = D.length(x), D.count(x, wide(full))
    return Dual(F.ceil((n.col + w.col) / 2).cast("int"), f"ceil(({n.sql} + {w.sql}) / 2.0)::INT")


def has_japanese(x: Dual, letters: str = JAPANESE) -> Dual:
    """Enough Japanese characters, in number and in share of all."""
    n, j = D.length(x), D.count(x, letters)
    least, share = THRESHOLDS.japanese_least, THRESHOLDS.japanese_share
    return Dual((j.col >= least) & (j.col >= F.lit(share) * n.col), f"({j.sql} >= {least} AND {j.sql} >= {share}::DOUBLE * {n.sql})")


def first_matches(x: Dual, pattern: str, n: int = 3) -> Dual:
    every = D.extract_all(x, pattern)
    return Dual(F.array_join(F.slice(every.col, 1, n), ", "), f"array_to_string({every.sql}[1:{n}], ', ')")


def mojibake(x: Dual) -> Dual:
    found = D.extract(x, MOJIBAKE, 0)
    return Dual(F.substring(found.col, 1, 20), f"substring({found.sql}, 1, 20)")


def round_half_up(x: Dual) -> Dual:
    return Dual(F.floor(x.col + 0.5).cast("int"), f"floor({x.sql} + 0.5)::INT")


def username(x: Dual) -> Dual:
    """Trimmed, without leading @, lower case."""
    return Dual(F.lower(F.regexp_replace(F.trim(x.col), "^@+", "")), f"lower(regexp_replace(trim({x.sql}, ' '), '^@+', ''))")


def decode_entities(x: Dual) -> Dual:
    """The entities that the SQL form of extraction knows; the parser knows all."""
    for pattern, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;?", "&")):
        x = D.sub(x, pattern, by)
    return x
