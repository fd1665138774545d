"""Nulls, empty and long texts, repeated rows, clashing extra columns and empty tables for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import html_extract, knn_join, license_scan, line_dedup, minhash, mixing, quality_classifier, quality_rules, sentencepiece_wfst, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ROWS = [
    (1, "The cat sat on the mat and the dog ran.\nThe cat sat on the mat and the dog ran.", "en", "a", 79),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\r ", "en", "b", 5),
    (5, LONG, "en", "b", len(LONG)),
    (6, "tie one two three four five", "en", "c", 27),
    (7, "tie one two three four five", "en", "c", 27),
    (8, "same row twice in here", "en", None, 22),
    (8, "same row twice in here", "en", None, 22),
    (None, "no id but a text that stands", "en", "c", 28),
    (9, "漢字 😀 é \x00 ▁ ünï cödé", "xx", "c", 20),
]
CLASHES = "words key norm _text _words size rank host bands sketch part label token_ids quality_score _removed n_lines copies target component word_no".split()
OPERATORS = {
    "op1": sentencepiece_wfst.tokenized,
    "op3": mixing.mixed_documents,
    "op4": quality_rules.rule_verdicts,
    "op6": quality_classifier.classify,
    "op8": license_scan.license_verdicts,
    "op9": line_dedup.deduplicated_lines,
    "op10": minhash.near_duplicate_rows,
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_a_result(documents, name):
    rows = OPERATORS[name](documents).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(documents, name):
    assert OPERATORS[name](documents.limit(0)).collect() == []


def test_defined_results(documents):
    by = lambda frame: {r["doc_id"]: r for r in frame.collect()}
    rules = by(quality_rules.rule_verdicts(documents))
    assert rules[2]["n_words"] == rules[3]["n_words"] == rules[4]["n_words"] == 0 and rules[2]["base_failed"]
    assert rules[1]["n_dup_lines"] == 1 and rules[5]["n_words"] == 60_000
    near = by(minhash.near_duplicate_rows(documents))
    assert near[7]["component_id"] == 6 and near[6]["kept"] and not near[7]["kept"]
    assert near[2]["n_shingles"] == 0 and near[2]["component_id"] == 2 and near[4]["component_id"] == 4
    lines = by(line_dedup.deduplicated_lines(documents))
    assert lines[1]["n_removed"] == 1 and lines[2]["text"] is None and lines[3]["text"] == "" and lines[7]["text"] == ""
    licenses = by(license_scan.license_verdicts(documents))
    assert licenses[2]["n_words"] == 0 and licenses[2]["first_word"] is None and licenses[2]["labels"] == ""
    mixed = by(mixing.mixed_documents(documents))
    assert mixed[2]["size"] == 0 and mixed[2]["taken"] == 0


def test_toxicity_edges(spark, documents):
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, None), (99, 1), (None, 1)], "doc_id bigint, toxic int").withColumn("score", F.lit(1))
    assert toxicity.toxicity_scores(documents, labels).count() == len(ROWS)
    assert toxicity.toxicity_scores(documents, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(documents.limit(0), labels).count() == 0


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/", ""), (3, "x", "<p>a &amp; b<p> c\n d <b>e"), (3, "x", "<p>a &amp; b<p> c\n d <b>e"), (None, "http://h/", "<<<&#x41;></p></x><!-- ")], "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("low", F.lit(2))
    rows = html_extract.extract_text(pages).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in rows)[:4] == [("1", ""), ("2", ""), ("3", "a & b\nc d e"), ("3", "a & b\nc d e")] and len(rows) == 5
    assert html_extract.extract_text(pages.limit(0)).collect() == []


def test_vector_edges(spark):
    vectors = [(0, [1.0, 2.0]), (0, [0.5, 0.5]), (50, [1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf")]), (None, [1.0, 1.0]), (5, [3.0, 0.0]), (6, [3.0, 0.0]), (7, [])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("v", F.lit(1))
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn_join.nearest_vectors(frame).orderBy("query_id", "rank").collect()]
    one = 256 * 256
    assert found[:4] == [(0, 1, 5, 3 * one // 2), (0, 2, 6, 3 * one // 2), (0, 3, 50, one // 2), (0, 4, 7, 0)]
    assert found[4:] == [(50, 1, 5, 3 * one), (50, 2, 6, 3 * one), (50, 3, 0, one), (50, 4, 0, one // 2), (50, 5, 7, 0)]
    assert knn_join.nearest_vectors(frame.limit(0)).collect() == []


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, number):
    documents = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in [*CLASHES, "removed", "removed_from", "n_removed", "taken_id", "taken_times", "gone", "n_tokens", "_taken_id"]})
    out = corpus_pipeline.STAGES[number][1](spark, documents, "")
    if number < 4:
        assert out.columns == documents.columns
    else:
        assert out.count() == len(ROWS)
    out.collect()
    assert corpus_pipeline.STAGES[number][1](spark, documents.limit(0), "").count() == 0
