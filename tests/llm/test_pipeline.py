"""The pipeline, stage by stage, on the smallest tables and on rows with every kind of oddity."""

import os
import random

import pytest

import corpus_pipeline
from tabulon.llm.common import materialise

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, distance double, digest string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        sizes.append(docs.select("doc_id").distinct().count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert all(labels.get(k, 1) == 1 for k in kept)


def _text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def odd(spark, tmp_path):
    """A folder with documents of every kind and labels."""
    rng = random.Random(4)
    english = [a + b for a in ("house", "the", "and", "water", "with", "some", "tree", "from") for b in ("", "s", "ing", "er", "ly")]
    german = [a + b for a in ("haus", "der", "und", "wasser", "mit", "baum", "über", "schön") for b in ("", "en", "ung", "er", "lich")]
    texts = [_text(rng, english, rng.randint(80, 200)) for _ in range(60)] + [_text(rng, german, rng.randint(80, 200)) for _ in range(60)]
    rows = [(k, t, "en" if k < 60 else "de", "s", len(t), True, 0.5, "d") for k, t in enumerate(texts)]
    near = texts[3].split(" ")
    near[40] = "changed"
    rows += [(200, texts[3], "en", "s", 1, True, None, None), (201, " ".join(near), "en", "s", 1, True, None, None), (5, texts[5], "en", "s", len(texts[5]), True, 0.5, "d"), (5, _text(rng, english, 90), "en", "s", 2, True, None, None)]
    rows += [(300, None, "en", None, None, None, None, None), (301, "", None, None, None, None, None, None), (None, _text(rng, english, 100), "en", "s", 3, None, None, None), (302, _text(rng, english, 40_000), "en", "s", 4, None, None, None)]
    letters = "qxzjkvwpfbq"
    rows += [(400, " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(120)), None, "s", 5, None, None, None)]
    rows += [(401, " ".join(rng.choice(["ćwiczę", "żółwik", "brzęczy", "chrząszcz", "ściółką", "źdźbło", "pięćdziesiąt"]) for _ in range(100)) + " ".join(f" {c}" for c in "abc"), None, "s", 6, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(0, 120, 7)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows




def test_quality_and_language_on_odd_rows(spark, odd):
    folder, rows = odd
    first = corpus_pipeline.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert first.columns == list(corpus_pipeline.COLUMNS)
    ids = {r["doc_id"] for r in first.select("doc_id").collect()}
    assert not {300, 301} & ids and None in ids
    clean = spark.read.parquet(f"{folder}/documents.parquet").where("text IS NOT NULL AND text <> ''")
    second = corpus_pipeline.language(spark, clean, folder)
    left = {r["doc_id"] for r in second.collect()}
    assert left == {r[0] for r in rows} - {300, 301, 400, 401}  # gibberish and a foreign text go, all else stays


def test_near_duplicates_on_odd_rows(spark, odd):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    ids = [r["doc_id"] for r in got]
    assert 3 in ids and 200 not in ids and 201 not in ids
    assert sorted(r["n_chars"] for r in got if r["doc_id"] == 5) == sorted({r[4] for r in rows if r[0] == 5})  # equal rows once, others all
    assert None in ids and len(got) == len(rows) - 3


def test_whole_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    folder, rows = odd
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} <= {r[0] for r in rows} and max(r["offset"] + r["length"] for r in packed) <= 2048
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
