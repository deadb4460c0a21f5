"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows and no rows at all."""

import shutil

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and some{i % 53}" for i in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(None, "the text of no one in particular", "en", "s", 1), (900001, None, None, None, None), (900002, "", "en", "s", 0), (900002, "", "en", "s", 0), (900003, LONG, "en", "s", len(LONG)), (900004, "12 34 ***", "en", "s", 9)]
    return docs.union(spark.createDataFrame(rows, docs.schema))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_odd_rows(spark, odd, name, stage):
    got = stage(spark, odd, FOLDER).collect()
    ids = [r.doc_id for r in got]
    if name == "language_id":
        assert not {900001, 900002, 900004} & {*ids} and None in ids
        return
    long = [r for r in got if r.doc_id == 900003]
    assert len(long) == 1 and long[0].text == LONG
    if name == "near_dedup":
        assert sum(i in (900001, 900002) for i in ids) == 1, "texts without words are one group"
    else:
        assert len(got) == odd.count() or name == "decontamination" and None in ids and ids.count(900002) == 2


def test_stages_of_no_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), FOLDER).count() == 0, name


def test_run_reads_the_folder(spark, odd, tmp_path):
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    for table in ("benchmark", "labels"):
        shutil.copy(f"{FOLDER}/{table}.parquet", tmp_path)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert got and all(r.rate >= 0 and 0 <= r.p_toxic <= 1 for r in got) and 900003 in {r.doc_id for r in got}
