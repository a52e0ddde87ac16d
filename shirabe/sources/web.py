"""Fetching: addresses in, landed rows out. Not deterministic, so land the result once and read that."""

from __future__ import annotations

import ipaddress
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.config import SETTINGS
from shirabe.functions import dual as D
from shirabe.functions import urls as U
from shirabe.sources.fetch import FETCH_LOG

HEADERS = {"User-Agent": "shirabe", "Accept-Language": "ja,en;q=0.8"}
MOST_REDIRECTS = 5


class Refused(Exception):
    """An address that must not be fetched."""


def _public(address: str) -> bool:
    ip = ipaddress.ip_address(address.split("%")[0])
    ip = ip.ipv4_mapped or ip if ip.version == 6 else ip
    shared = ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10")
    return not (shared or ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


def check(url: str, allow_private: bool = False) -> None:
    """Refuse what is not http(s), has a blocked port, or resolves to any address that is not public."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise Refused(f"not an http address: {url}")
    if parts.port in U.BLOCKED_PORTS:
        raise Refused(f"port {parts.port} is blocked")
    try:
        found = {i[4][0] for i in socket.getaddrinfo(parts.hostname, parts.port or (443 if parts.scheme == "https" else 80))}
    except (OSError, UnicodeError) as wrong:
        raise Refused(f"{parts.hostname} can't be resolved") from wrong
    if not allow_private and not all(map(_public, found)):
        raise Refused(f"{parts.hostname} is not public")


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):  # noqa: ANN002, ANN201
        return None


def get(url: str, method: str = "GET", allow_private: bool = False, timeout: float = 20.0) -> dict:
    """The landed form of one request. Every address on the way is checked; an error is told, not raised."""
    opener, begin = urllib.request.build_opener(_Stay), time.monotonic()
    row = {"final_url": url, "status": 0, "content_type": None, "redirect_chain": [], "body": None, "error": ""}
    try:
        for _ in range(MOST_REDIRECTS + 1):
            check(url, allow_private)
            try:
                answer = opener.open(urllib.request.Request(url, headers=HEADERS, method=method), timeout=timeout)
            except urllib.error.HTTPError as told:
                answer = told
            with answer:
                row |= {"final_url": url, "status": answer.status, "content_type": answer.headers.get("Content-Type")}
                row["redirect_chain"].append(url)
                target = answer.headers.get("Location")
                if answer.status not in (301, 302, 303, 307, 308) or not target:
                    row["body"] = answer.read(SETTINGS.body_bytes) if method == "GET" else None
                    break
                url = urllib.parse.urljoin(url, target)
        else:
            row["error"] = "too many redirects"
    except (Refused, OSError, ValueError) as wrong:
        row |= {"status": 0, "error": f"{type(wrong).__name__}: {wrong}"[:500]}
    return row | {"elapsed": time.monotonic() - begin}


def fetched(urls: DataFrame, method: str = "GET", allow_private: bool = False, delay: float = 1.0, timeout: float = 20.0) -> DataFrame:
    """FETCH_LOG rows of urls (audit_id, seq, url). A host's requests stay in one task, in order, with a pause
    of `delay` seconds between them, so that no server is met by many executors at once. method HEAD asks
    with GET again where HEAD is not allowed."""
    names = ["audit_id", "seq", "url", "final_url", "status", "elapsed", "content_type", "redirect_chain", "body", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            for audit, seq, url, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                time.sleep(max(0.0, last.get(host, 0.0) + delay - time.monotonic()))
                row = get(url or "", method, allow_private, timeout)
                if method == "HEAD" and row["status"] == 405:
                    row = get(url or "", "GET", allow_private, timeout)
                last = {host: time.monotonic()}
                row |= {"audit_id": audit, "seq": seq, "url": url}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in names}], schema)

    schema = pa.schema([("audit_id", pa.string()), ("seq", pa.int32()), ("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("elapsed", pa.float64()), ("content_type", pa.string()), ("redirect_chain", pa.list_(pa.string())), ("body", pa.binary()), ("error", pa.string())])
    rows = urls.select("audit_id", F.col("seq").cast("int").alias("seq"), "url", U.host(D.name("url")).col.alias("host"))
    return rows.repartition("host").sortWithinPartitions("host", "seq").mapInArrow(run, FETCH_LOG)
