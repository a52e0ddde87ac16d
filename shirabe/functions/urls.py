"""URL functions: parts, the normal form, and a check of literal addresses."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column

from shirabe.functions import dual as D
from shirabe.functions.dual import Dual
from shirabe.functions.lazy import F

#: Names a directory is served under; the normal form drops them.
INDEX = r"/(?:index\.html|index\.htm|index\.php|default\.html)$"
#: Ports that must not be fetched.
BLOCKED_PORTS = (22, 23, 25, 445, 3306, 5432, 6379, 11211, 11434)

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"


def scheme(url: Dual) -> Dual:
    return D.lower(D.extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Dual) -> Dual:
    """Lower case, without user and port; an IPv6 literal keeps its brackets."""
    return D.lower(D.extract(url, _AUTHORITY + r"(\[[^\]/?#]*\]|[^/:?#]*)", 1))


def port(url: Dual) -> Dual:
    return D.extract(url, _AUTHORITY + r"(?:\[[^\]/?#]*\]|[^/:?#\[]*):([0-9]+)", 1)


def normalize(url: Dual) -> Dual:
    """Without fragment, parameters of the last segment, index names and trailing slashes; the
    query stays; the host in lower case."""
    head = D.lower(D.extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    path = D.sub(D.extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    query = D.extract(url, r"^[^?#]*(\?[^#]+)", 1)
    path = D.sub(D.sub(path, INDEX, "/"), r"/+$", "")
    path = Dual(F.when(path.col == "", F.lit("/")).otherwise(path.col), f"CASE WHEN {path.sql} = '' THEN '/' ELSE {path.sql} END")
    return D.join(head, Dual(path.col, f"({path.sql})"), query)


def percent_decode(url: Dual) -> Dual:
    """Percent escapes decoded, + kept; text that can't be decoded stays."""
    safe = D.swap(url, "+", "%2B")
    return Dual(F.coalesce(F.try_url_decode(safe.col), url.col), f"COALESCE(TRY(url_decode({safe.sql})), {url.sql})")


def resolve(base: str, link: str) -> str:
    """A link as seen from a page (RFC 3986)."""
    try:
        return urljoin(base, link)
    except ValueError:
        return ""


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
#: A host that ends in a number is read as an address by resolvers, whatever its form.
_NUMBER = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$"
#: What a name is made of: ASCII letters, digits, and letters that stay what they are when names are mapped for lookup.
#: Anything else (circled, raised and full-width characters, other dots, ignorable ones) may turn into an address or
#: into localhost there, so it is refused.
_NAME = r"^[a-z0-9._\-\x{DF}-\x{F6}\x{F8}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{3B1}-\x{3C9}\x{430}-\x{45F}\x{3005}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]+$"
#: A backslash counts as a slash with many clients; neither it nor white space or control characters may stand before the path.
_BENT = r"^[^/?#]*(?://)?[^/?#]*[\x00-\x20\x7F\\]"
_SIX = r"^\[[23][0-9a-f]{3}:(?:[0-9a-f]{0,4}:){0,6}[0-9a-f]{0,4}\]$"


def public_host(name: Column) -> Column:
    """Whether a host is a plain name, or an address outside every private, loopback, link-local,
    shared, documentation, benchmark, multicast and reserved block. Any other numeric form (one number,
    hexadecimal, octal, fewer than four parts) is refused, and so is IPv6 outside 2000::/3, with its
    blocks for tunnels, documentation and protocol assignments."""
    h = F.regexp_replace(name, r"\.+$", "")
    a, b, c = (F.regexp_extract(h, _QUAD, i).try_cast("int") for i in (1, 2, 3))
    closed = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    first, second = (F.conv(F.concat(F.lit("0"), F.regexp_extract(h, r"^\[([0-9a-f]{1,4}):([0-9a-f]{0,4})", i)), 16, 10).try_cast("int") for i in (1, 2))
    colons, pairs = F.regexp_count(h, F.lit(":")), F.regexp_count(h, F.lit("::"))
    whole = ((pairs == 0) & (colons == 7)) | ((pairs == 1) & (colons <= 7) & ~F.contains(h, F.lit(":::")))
    ends = ~h.rlike(r"[^:]:\]$")
    six = h.rlike(_SIX) & whole & ends & (first != 0x2002) & ~((first == 0x2001) & ((second < 0x200) | (second == 0xDB8))) & ~((first == 0x3FFF) & (second < 0x1000))
    plain = h.rlike(_NAME) & ~h.rlike(_NUMBER) & (h != "localhost") & ~F.endswith(h, F.lit(".localhost"))
    return F.when(h.rlike(_QUAD), ~closed).when(F.startswith(h, F.lit("[")), six).otherwise(plain)


def public_literal(url: Dual) -> Column:
    """True for an http(s) URL with no blocked port and a public host. Names are checked against
    resolved addresses by `operators.safety.validate`."""
    ports = [str(p) for p in BLOCKED_PORTS]
    number = F.regexp_replace(port(url).col, "^0+(?=[0-9])", "")
    return scheme(url).col.isin("http", "https") & ~url.col.rlike(_BENT) & ~number.isin(*ports) & public_host(host(url).col)


def with_scheme(url: Dual) -> Dual:
    """https:// before what has no scheme."""
    t = Dual(F.trim(url.col), f"trim({url.sql}, ' ')")
    has = D.like(t, r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return Dual(F.when(has.col, t.col).otherwise(F.concat(F.lit("https://"), t.col)), f"(CASE WHEN {has.sql} THEN {t.sql} ELSE 'https://' || {t.sql} END)")
