import os

import pytest

import corpus_pipeline
from hazardframe.llm import storage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """Labels and a benchmark for the odd rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 0, 0), (3, 1, 1), (7, 0, 0), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "nothing that any of the documents holds in it"), (None, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_odd_and_empty_tables(spark, odd, empty, folder, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    for docs in (odd, empty):
        out, _ = storage.write_table(function(spark, docs, folder), "t")
        assert out.count() == 0 if docs is empty else out.count() > 0
        if stage != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect()) or stage == "mixing"


def test_clean_rows_of_a_shared_id_stay_and_names_do_not_clash(spark, tmp_path):
    item = " ".join(f"question{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "pad " + item, "a"), (None, "a clean text", "b"), (5, item, "c"), (5, "another clean text", "d"), (6, None, "e"), (7, item + " end", "f")]
    docs = spark.createDataFrame([(*r, r[2], r[2], r[2], r[2]) for r in rows], "doc_id bigint, text string, source string, _hit string, TAG string, `row` string, `a.b` string")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r["a.b"] for r in left.collect()) == ["b", "d", "e"]


def test_names_do_not_clash_in_near_duplicates(spark):
    rows = [(2, "one two three four five six", "x"), (1, "one two three four five six", "y"), (3, "other", "z")]
    docs = spark.createDataFrame([(*r, *[r[2]] * 5) for r in rows], "doc_id bigint, text string, source string, _om_digest string, _om_id string, node string, class_id string, n string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns and sorted(r._om_digest for r in left.collect()) == ["y", "z"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.orderBy("start").collect()
    assert rows and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
def test_every_operator_has_one_query(entry_queries):
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry_queries if n.startswith("op") and n[2:].split("_")[0].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry_queries
