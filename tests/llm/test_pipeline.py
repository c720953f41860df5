"""The classifier on held-out labels, and the pipeline against its stages done by hand."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm.cotraining import VERDICT, score_quality, train_quality
from tests.llm.fixtures import SCHEMA, frame
from tests.llm.test_shingles_and_repeats import components_by_force, hits_by_force

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_classifier_on_labels_it_never_saw(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    unseen = "pmod(hash(doc_id), 3) = 0"
    scored = score_quality(docs, labels.filter(f"NOT {unseen}")).join(labels.filter(unseen), "doc_id").select("quality", f"{VERDICT}.keep").collect()
    assert len(scored) > 80 and sum(r.keep == bool(r.quality) for r in scored) >= 0.97 * len(scored)
    good = [r for r in scored if r.quality]
    assert sum(r.keep for r in good) >= 0.98 * len(good)


def test_classifier_without_labels_keeps_all(spark):
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 1)], "doc_id long, quality int")
    got = score_quality(frame(spark), labels)
    assert got.filter(f"{VERDICT}.keep AND {VERDICT}.score IS NULL").count() == frame(spark).count()
    assert score_quality(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_classifier_on_awkward_rows(spark):
    made = frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    got = score_quality(made, labels).select("doc_id", f"{VERDICT}.*").collect()
    assert len(got) == made.count() and all(0 <= r.score <= 1 for r in got)


def test_pipeline_against_plain_code(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SMALL)
    assert kept.columns == docs.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    last = {}
    for i in sorted(left):
        last[left[i]] = i
    left = {i: t for t, i in last.items()}
    roots = components_by_force(list(left.items()))
    left = {i: t for i, t in left.items() if roots[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hits = hits_by_force(list(left.items()), items, 10)
    want = {i for i in left if not hits[i][-1]}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == want and all(r.n_tokens == len(r.ids) for r in got)
    assert 0 < len(want) < docs.count()


def two_kinds(spark, n):
    """Documents of two kinds, each with its own sources, and their labels."""
    text = "CASE WHEN id % 2 = 0 THEN concat('A calm line of words, number ', id, ', and one more.') ELSE concat('$$$ BUY||', id, ' !!! NOW NOW') END"
    return spark.range(n).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "concat('s', id % 8) AS source", "40L AS n_chars", "int(id % 2 = 0) AS quality")


def test_every_sure_document_of_a_large_pool_is_exchanged(spark):
    docs = two_kinds(spark, 12_000)
    model = train_quality(docs.drop("quality"), docs.filter("doc_id < 400").select("doc_id", "quality"))
    assert model.exchanged == (11_600, 11_600)


def test_fit_collects_and_broadcasts_no_rows(spark, monkeypatch):
    """As many labels as documents, half of them for other ids, and a third of the documents without an id."""
    def refuse(*_):
        raise AssertionError("rows go to the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    monkeypatch.setattr("pyspark.sql.functions.broadcast", refuse)
    made = two_kinds(spark, 900)
    docs = made.withColumn("doc_id", F.expr("CASE WHEN doc_id % 3 > 0 OR doc_id < 6 THEN doc_id END"))
    labels = made.filter("doc_id < 450").select("doc_id", "quality").unionByName(made.filter("doc_id < 450").selectExpr("doc_id + 5000 AS doc_id", "quality"))
    labelled = docs.join(labels, "doc_id").count()
    assert min(train_quality(docs.drop("quality"), labels).exchanged) >= 0.99 * (900 - labelled)
