"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong kinds are reported wherever they match: `assign` (a named value such as password=...),
`access` (access key ids) and `hex` (long hexadecimal strings). Weak kinds are candidates that
alone mean little: other key and user identifiers, random-looking tokens, endpoints. A weak
candidate is reported only when its complementary parts lie in its scope, SCOPE code points around
its start: an identifier needs a secret, a token an identifier, an endpoint both.

Parts meet by an interval join on buckets of SCOPE code points. For each document, bucket and role
only the first and the last start are kept, and each bucket is joined with itself and its two
neighbours: within a bucket every start is in scope, from the bucket before the last start decides,
from the bucket after the first. This is exact, and no pair of parts is ever listed.

Positions come from the lengths of matches and of the texts between them, summed over the matches
of a document; they count code points.

Cases: null text is empty and has no spans; a null id is kept; rows with equal id and text get
equal spans; a very long text is one row of the regular expressions and then a row for each match;
an empty table gives an empty result; other columns pass through `redact` and are not read by
`scan`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.storage import store

SCOPE = 200
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
MARK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """group, least: a match counts only if that group has least code points; must: patterns that a
    match has to contain."""

    name: str
    role: int
    strong: bool
    pattern: str
    group: int = 0
    least: int = 0
    must: tuple[str, ...] = ()


KINDS = (
    Kind("assign", SECRET, True, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", IDENTIFIER, True, r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", SECRET, True, r"[0-9a-f]{32,}"),
    Kind("key_id", IDENTIFIER, False, r"\b(?:ASIA|AROA|AIDA|ANPA)[A-Z0-9]{12,}"),
    Kind("user", IDENTIFIER, False, r"""\b(?i:user(?:_?name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""),
    Kind("random", SECRET, False, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])", must=("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", ENDPOINT, False, r"""\bhttps?://[^\x00-\x20"'<>]+|\b[a-z0-9.-]+\.(?:amazonaws\.com|azure\.com|googleapis\.com)\b"""),
)


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """An array of (kind, i, gap, length, ok): the i-th match and the text before it."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    part = found if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))

    def row(x: Column) -> Column:
        ok = F.char_length(x["part"]) >= kind.least
        for p in kind.must:
            ok = ok & x["found"].rlike(p)
        return F.struct(F.lit(number).alias("kind"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["found"]).alias("length"), ok.alias("ok"))

    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), part.alias("part")), row)
    rows = F.transform(rows, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["length"].alias("length"), x["ok"].alias("ok")))
    return F.when(text.rlike(kind.pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,length:int,ok:boolean>>"))


def matches(text: Column) -> Column:
    """All matches of all kinds in a text."""
    return F.concat(*[_matches(text, n, k) for n, k in enumerate(KINDS)])


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """cr_id, cr_tag (of the text), kind (number), start, end of every reported span."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("cr_id"), F.xxhash64(body).alias("cr_tag"), body.alias("cr_text"))
    return linked_spans(base.select("cr_id", "cr_tag", F.explode(matches(F.col("cr_text"))).alias("m")))


def linked_spans(found: DataFrame) -> DataFrame:
    """The spans to report of matches (cr_id, cr_tag, m)."""
    rows = found.select("cr_id", "cr_tag", "m.*")
    # Rows with equal id and text give equal matches: one of each.
    rows = rows.groupBy("cr_id", "cr_tag", "kind", "i").agg(*[F.min(c).alias(c) for c in ("gap", "length", "ok")])
    upto = Window.partitionBy("cr_id", "cr_tag", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).filter("ok")
    rows = rows.select("cr_id", "cr_tag", "kind", (F.col("end") - F.col("length")).alias("start"), "end")
    role = F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), F.col("kind") + 1)
    strong = F.element_at(F.array(*[F.lit(k.strong) for k in KINDS]), F.col("kind") + 1)
    # Narrow rows, written once: texts go through the patterns a single time.
    rows = store(rows.select("*", role.alias("role"), strong.alias("strong"), F.floor(F.col("start") / SCOPE).alias("bucket")), "secret-parts")

    ends = rows.groupBy("cr_id", "cr_tag", "bucket", "role").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    near = ends.select("cr_id", "cr_tag", "role", "low", "high", "bucket", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step"))
    near = near.withColumn("bucket", F.col("bucket") + F.col("step"))
    parts = []
    for r in (IDENTIFIER, SECRET):
        mine = F.col("role") == r
        parts += [
            F.max(mine & (F.col("step") == 0)).alias(f"in{r}"),
            F.max(F.when(mine & (F.col("step") == 1), F.col("high"))).alias(f"before{r}"),
            F.min(F.when(mine & (F.col("step") == -1), F.col("low"))).alias(f"after{r}"),
        ]
    near = near.groupBy("cr_id", "cr_tag", "bucket").agg(*parts)
    weak = rows.filter("NOT strong")
    same = weak["cr_id"].eqNullSafe(near["cr_id"]) & (weak["cr_tag"] == near["cr_tag"]) & (weak["bucket"] == near["bucket"])
    linked = weak.join(near, same).select(weak["*"], *[near[f"{a}{r}"] for a in ("in", "before", "after") for r in (IDENTIFIER, SECRET)])

    def has(r: int) -> Column:
        start = F.col("start")
        return F.col(f"in{r}") | F.coalesce(F.col(f"before{r}") >= start - SCOPE, F.lit(False)) | F.coalesce(F.col(f"after{r}") <= start + SCOPE, F.lit(False))

    needs = F.when(F.col("role") == IDENTIFIER, has(SECRET)).when(F.col("role") == SECRET, has(IDENTIFIER)).otherwise(has(IDENTIFIER) & has(SECRET))
    keep = ["cr_id", "cr_tag", "kind", "start", "end"]
    return rows.filter("strong").select(*keep).unionByName(linked.filter(needs).select(*keep))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, a count for each strong kind, and cr_strong and cr_spans,
    arrays of (start, kind, end) in order."""
    rows = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    strong = [n for n, k in enumerate(KINDS) if k.strong]
    found = spans(docs, doc_id, text).groupBy("cr_id", "cr_tag").agg(rows.alias("cr_spans"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("cr_own"))
    joined = own.join(found, own["doc_id"].eqNullSafe(found["cr_id"]) & (own["cr_own"] == found["cr_tag"]), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    joined = joined.select("doc_id", F.coalesce("cr_spans", none).alias("cr_spans"))
    joined = joined.withColumn("cr_strong", F.filter("cr_spans", lambda s: s["kind"].isin(strong)))

    def count(n: int) -> Column:
        return F.size(F.filter("cr_spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{KINDS[n].name}")

    counts = [count(n) for n in strong]
    return joined.select("doc_id", *counts, "cr_strong", "cr_spans")


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = MARK) -> DataFrame:
    """docs with every reported span (overlapping ones as one) replaced by mark; columns stay, whatever
    they are called. Rows are written once with their matches, so texts go through the patterns a single time; only
    rows with a match are shuffled."""
    body = F.col(f"`{text}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("cr_row")
    rows = docs.select(row, F.monotonically_increasing_id().alias("cr_at"), matches(F.coalesce(body, F.lit(""))).alias("cr_matches"))
    rows = store(rows, "secret-rows")
    some = F.size("cr_matches") > 0
    found = linked_spans(rows.filter(some).select(F.col("cr_at").alias("cr_id"), F.lit(0).alias("cr_tag"), F.explode("cr_matches").alias("m")))
    order = Window.partitionBy("cr_id", "cr_tag").orderBy("start", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.coalesce((F.col("start") > ahead).cast("int"), F.lit(1)))
    found = found.withColumn("block", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("cr_id", "cr_tag", "block").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    # The texts between: from the end of a block to the start of the next.
    each = Window.partitionBy("cr_id", "cr_tag").orderBy("block")
    found = found.withColumn("from", F.coalesce(F.lag("b").over(each), F.lit(0)))
    found = found.groupBy("cr_id", "cr_tag").agg(F.array_sort(F.collect_list(F.struct(F.col("from").alias("from"), F.col("a").alias("to")))).alias("cr_gaps"), F.max("b").alias("cr_last"))
    own = F.col("cr_row").getField(text)
    hit = rows.filter(some).join(found, F.col("cr_at") == F.col("cr_id"), "left")
    parts = F.transform("cr_gaps", lambda g: F.substr(own, (g["from"] + 1).cast("int"), (g["to"] - g["from"]).cast("int")))
    tail = F.substr(own, (F.col("cr_last") + 1).cast("int"))
    clean = F.when(F.col("cr_last").isNull(), own).otherwise(F.array_join(F.concat(parts, F.array(tail)), mark))
    hit = hit.select(*[clean.alias(c) if c == text else F.col("cr_row").getField(c).alias(c) for c in docs.columns])
    return rows.filter(~some).select("cr_row.*").unionByName(hit)
