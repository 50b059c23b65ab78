"""The corpus pipeline: each stage against its operator's brute-force result, and the whole run."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, WORD, brute_near, corpus
from tracelake.llm import mixing, secrets, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, t if i is None or i % 4 else f"{t or ''} vile slur", lang, source, n) for i, t, lang, source, n in corpus(160, 9)]
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.lit(True))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if model.score((r.text or "").encode()) < 0.5}
    assert clean.where("doc_id % 4 = 0").count() == 0 and clean.where("doc_id % 4 <> 0").count() > 100
    one = stages["near duplicates"](spark, clean, folder)
    rows = [tuple(r) for r in clean.collect()]
    want = {i for i, _, c in brute_near(rows, 5, 80) if i == c}
    assert {r.doc_id for r in one.collect() if r.doc_id is not None} == want and one.columns == columns
    hidden = one.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" password=abcdefghijkl1"))).otherwise(F.col("text")))
    safe = stages["secrets"](spark, hidden, folder)
    assert safe.where("text like '%abcdefghijkl1%'").count() == 0 and safe.columns == columns
    assert {r.doc_id: r.text for r in safe.collect()} == {r.doc_id: r.text and secrets.redact_text(r.text, secrets.all_spans(r.text)[1]) for r in hidden.collect()}
    mixed = stages["mixing"](spark, safe, folder)
    copies = Counter()
    for r in mixing.copies(safe).collect():
        copies[r.doc_id] += r.copies
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == +copies
    sizes, source = {r.doc_id: len(WORD.findall(r.text or "")) for r in safe.collect()}, {r.doc_id: r.source for r in safe.collect()}
    plan = {r.source: r.target for r in mixing.copies(safe).collect()}
    for s, target in plan.items():
        assert abs(sum(n * sizes[i] for i, n in copies.items() if source[i] == s) - target) <= max(sizes[i] for i in sizes if source[i] == s)
    coded = stages["pieces"](spark, mixed, folder)
    assert coded.count() == mixed.count() and coded.columns == [*columns, "ids", "parity"]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.where("parity = false").count() == 0


def test_stages_on_empty_tables_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    odd = docs.withColumns({"score": F.lit(1), "row": F.lit("r"), "copies": F.lit(2), "cluster": F.lit(3), "kept": F.lit(False), "size": F.lit("s"), "bands": F.lit(1), "y": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES:
        more = ["ids", "parity"] if name == "pieces" else []
        empty = stage(spark, odd.limit(0), folder)
        assert empty.columns == [*odd.columns, *more] and empty.count() == 0
        got = stage(spark, odd, folder)
        assert got.columns == [*odd.columns, *more]
        assert {(r.row, r.copies, r.kept, r["size"]) for r in got.collect()} == {("r", 2, False, "s")}
