"""Each stage of the pipeline, on what the stage before has kept, against plain definitions."""

from collections import Counter, defaultdict

import brute
import corpus_pipeline
from shirabe.llm.storage import new_path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = docs.collect()
    quality, near, secrets, mixed, packed = (seen[n] for n, _ in corpus_pipeline.STAGES)
    row = lambda r: tuple(r[c] for c in columns)
    assert Counter(map(row, quality)) == Counter(row(r) for r in before if brute.good(r["text"]))
    label = brute.components({r["doc_id"]: r["text"] for r in quality}, 5)
    assert Counter(map(row, near)) == Counter(row(r) for r in quality if label[r["doc_id"]] == r["doc_id"])
    assert len(near) < len(quality) < len(before)

    def clean(r):
        text = brute.redacted(r["text"])
        return tuple(text if c == "text" else len(text) if c == "n_chars" else r[c] for c in columns)

    assert Counter(map(row, secrets)) == Counter(map(clean, near))
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in secrets:
        n = len(brute.WORD.findall(r["text"]))
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    times = Counter(map(row, mixed))
    assert set(times) <= set(map(row, secrets)) and max(times.values()) <= 3
    for r in mixed:
        taken[r["source"]] += len(brute.WORD.findall(r["text"]))
    for source, target in brute.targets(sizes).items():
        assert abs(taken[source] - target) <= most[source] / 2 + 1
    brute.check_packing(packed, [(r["doc_id"], r["text"]) for r in mixed])


def test_op1_query(spark, sf_dir):
    from shirabe.llm.queries import op1_packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    brute.check_packing(op1_packing(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in docs])


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_near_duplicates_of_the_tables(spark, sf_dir):
    from shirabe.llm.queries import op4_near_duplicates

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    label = brute.components({r["doc_id"]: r["text"] for r in docs}, 4)
    got = {r["doc_id"]: r["component_id"] for r in op4_near_duplicates(spark, sf_dir).collect()}
    assert got == label
    groups = defaultdict(int)
    for k in label.values():
        groups[k] += 1
    assert max(groups.values()) > 1


def test_comparison_across_groups(spark, monkeypatch):
    """Near copies with edits in many places, of which few are alike: pivots find some links, the rest is
    compared across groups, in small blocks."""
    import random

    from shirabe.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "MERGING", 1.0)
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(120)], {}
    for k in range(220):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        texts[k] = " ".join(w)
    texts |= {900: texts[3], 901: None, 902: "w1 w2 w3"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for n in (4, 5):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, n).collect()}
        assert got == brute.components(texts, n) and len(set(got.values())) > 10


def test_batches_are_small_and_the_setting_is_put_back(spark, sf_dir):
    """Texts of one split reach Python workers in small batches while stages run, and as before afterwards."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "'a' AS source", "repeat(concat('word', id, ' '), 10000) AS text", "0L AS n_chars")
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, before)
            stage(spark, docs.limit(3), "")
            got = docs.select("text").mapInArrow(sizes, "rows bigint, bytes bigint").collect()
            assert sum(r["rows"] for r in got) == 400
            assert max(r["bytes"] for r in got) < 2 * corpus_pipeline.BATCH_BYTES, name
    finally:
        spark.conf.set(key, before)
    corpus_pipeline.run(spark, sf_dir)
    assert spark.conf.get(key) == before


def test_the_sample_depends_on_no_order(spark, sf_dir):
    from shirabe.llm import quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [r.name for r in quality.order(docs)]
    assert names == [r.name for r in quality.order(docs.repartition(5))]
    assert len(quality.order(docs.limit(0))) == len(quality.RULES)
