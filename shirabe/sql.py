"""What SQL sees of the library: functions that Catalyst inlines, and tables from pages.

    register(spark)
    SELECT p.page_id, l.pos, normal_url(l.target) FROM pages p, LATERAL page_links(p.url, p.html) l
    WHERE url_host(l.target) = url_host(p.url) AND display_width(p.title) > 32

display_width(text), norm_text(text), url_host(url) and normal_url(url) are SQL functions, so they stay in
generated code. page_links(url, html) and page_facts(url, html) read a page by the parser; null arguments
count as empty. Their rows go by pickles of 100 pages: as Arrow batches they would come 10,000 at a time, in two
workers for each core where a query uses both."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from shirabe.functions import text as T
from shirabe.functions import urls as U

_HEAD = "[A-Za-z][A-Za-z0-9+.-]*://"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def functions() -> dict[str, str]:
    """name(arguments) RETURNS kind -> expression."""
    path = f"regexp_extract(url, {_quoted(f'^{_HEAD}[^/?#]*([^?#]*)')}, 1)"
    path = f"regexp_replace(regexp_replace(regexp_replace({path}, r';[^/]*$', ''), {_quoted(U.INDEX)}, '/'), r'/+$', '')"
    return {
        "display_width(value STRING) RETURNS INT": f"CAST(ceil((char_length(value) + regexp_count(value, {_quoted(T.wide())})) / 2) AS INT)",
        "norm_text(value STRING) RETURNS STRING": f"trim(regexp_replace(value, {_quoted(T.SPACE + '+')}, ' '))",
        "url_host(url STRING) RETURNS STRING": f"lower(regexp_extract(url, {_quoted(f'^{_HEAD}(?:[^/?#@]*@)?' + r'(\[[^\]/?#]*\]|[^/:?#]*)')}, 1))",
        "normal_url(url STRING) RETURNS STRING": f"concat(lower(regexp_extract(url, {_quoted(f'^({_HEAD}[^/?#]*)')}, 1)), coalesce(nullif({path}, ''), '/'), regexp_extract(url, {_quoted(r'^[^?#]*(\?[^#]+)')}, 1))",
    }


class PageLinkRows:
    """pos and target (whole address) of each link of a page, in order."""

    def eval(self, url: str, html: str) -> Iterator[tuple[int, str]]:
        from shirabe.sources.html import page_facts

        yield from enumerate(page_facts(url or "", html or "")["links"])


class PageFactRows:
    """Facts of a page as name and value: one parse, as many rows as there are facts with a text."""

    def eval(self, url: str, html: str) -> Iterator[tuple[str, str]]:
        from shirabe.sources.html import page_facts

        for name, value in page_facts(url or "", html or "").items():
            if not isinstance(value, (list, dict)):
                yield name, str(value)


def register(spark: SparkSession) -> None:
    """Make all of them known to a session; repeated calls replace them."""
    for head, body in functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("page_links", udtf(PageLinkRows, returnType="pos int, target string", useArrow=False))
    spark.udtf.register("page_facts", udtf(PageFactRows, returnType="name string, value string", useArrow=False))
