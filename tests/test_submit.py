"""Split test is scored: every source-1 record of it has a list, by the query and by the pipeline."""

import os

import pytest

import __spark_entry__ as e
from rowkin.plans import pipeline
from rowkin.plans.tables import Tables

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")


@needs_tables
def test_lists_of_every_test_record(spark, tmp_path):
    t = Tables(spark, SMALL, "test")
    ids = {r[0] for r in t.records.filter("source = 1").select("entity_id").collect()}
    pool = {r[0] for r in t.records.filter("source > 1").select("entity_id").collect()}
    got = e.queries()["predict_submit"](spark, SMALL).collect()
    assert ids and len(got) == len(ids) and {r["s1_id"] for r in got} == ids
    found = [c for r in got for c in r["matches"].split(",") if c]
    assert set(found) <= pool and len(found) == len(set(found)) and found
    pipeline.submit(spark, SMALL, str(tmp_path), rounds=2)
    for name in ("matching_results", "candidate_pairs"):
        lines = (tmp_path / f"{name}.tsv").read_text(encoding="utf-8").splitlines()[1:]
        assert [x.split("\t")[0] for x in lines] == sorted(ids)
