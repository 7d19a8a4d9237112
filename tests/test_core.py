"""Skew-free counting, blocking, text functions, similarity and files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rowkin.functions import similarity as sm
from rowkin.functions import text as tx
from rowkin.operators import blocking as bl
from rowkin.operators import learning as ln
from rowkin.operators import vectors as vx
from rowkin.operators.skew import dense_key_counts, heavy_keys
from rowkin.sources import files


def test_dense_counts_with_nulls_and_hot_key(spark):
    rows = [("hot", 1)] * 500 + [(None, 2)] * 3 + [("", None)] * 2 + [(f"k{i}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("block", F.lit("clash")).repartition(7)
    got = {r["key_value"]: (r["n_rows"], r["v"]) for r in dense_key_counts(df, ["k"], ["v"]).collect()}
    assert got["hot"] == (500, 500)
    assert got[None] == (3, 6)
    assert got[""] == (2, 0)
    assert len(got) == 43
    assert {r["key_value"] for r in heavy_keys(df, ["k"], 0.5).collect()} == {"hot"}


def test_dense_counts_of_empty_table(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert dense_key_counts(df, ["k"], ["v"]).count() == 0
    assert heavy_keys(df, ["k"]).count() == 0


def records(spark):
    rows = [
        ("S1-1", 1, "US", "acme foods", "1 main st", ["1"], "12345", "town"), ("S2-1", 2, "US", "acme foods", "1 main st", ["1"], "12345", "town"), ("S3-1", 3, "US", "acmee foods", "1 main", ["1"], "", "town"),
        ("S1-2", 1, None, None, None, None, None, None), ("S2-2", 2, "US", "", "", [], "", ""), ("S1-3", 1, "FR", "zebra", "9 rue x", ["9"], None, "lyon"),
    ]
    return spark.createDataFrame(rows, "entity_id string, source int, country string, name_core string, addr_norm string, addr_numbers array<string>, postcode string, city string")


def test_blocking_passes(spark):
    r = records(spark).withColumn("token", F.lit("clash"))
    assert {(x["s1_id"], x["cand_id"]) for x in bl.exact_name(r).collect()} == {("S1-1", "S2-1")}
    assert {(x["s1_id"], x["cand_id"]) for x in bl.addr_key(r).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    found = bl.union_passes({"exact_name": bl.exact_name(r), "rare_token": bl.rare_token(r), "addr_key": bl.addr_key(r)})
    assert found.groupBy("s1_id", "cand_id").count().filter("count > 1").count() == 0
    kept = bl.contract_columns(bl.prune(found, 1, 9, ("exact_name", "rare_token", "addr_key")))
    assert kept.filter("prune_rank = 0").count() == kept.count() == 1
    assert {x["cand_id"] for x in bl.tfidf_name(r).filter("s1_id = 'S1-1'").collect()} == {"S2-1", "S3-1"}
    assert bl.tfidf_name(r).filter("s1_id = 'S1-3'").count() == 0
    assert bl.reverse(r).filter("cand_id = 'S2-1'").first()["s1_id"] == "S1-1"
    assert bl.generate(r).count() == 2


def test_grams(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(vx.char_grams("t")).collect()][:2] == [[" ab", "ab ", " ab "], []]


def test_dense_top_k_against_plain(spark):
    random.seed(2)
    q = [("a", f"q{i}", [random.random() for _ in range(4)]) for i in range(5)]
    p = [("a", f"p{i}", [random.random() for _ in range(4)]) for i in range(9)]
    got = vx.dense_top_k(spark.createDataFrame(q, "country string, s1_id string, v array<double>"), spark.createDataFrame(p, "country string, cand_id string, v array<double>"), 3).collect()
    for _, i, v in q:
        want = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)), 5), c) for _, c, w in p)[:3]
        assert sorted((-r["score"], r["cand_id"]) for r in got if r["s1_id"] == i) == want


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_similarity_against_plain():
    random.seed(5)
    for _ in range(300):
        a, b = ("".join(random.choice("abc ") for _ in range(random.randrange(12))) for _ in range(2))
        assert sm.common_subsequence(a, b) == slow_lcs(a, b)
        assert 0 <= sm.partial_ratio(a, b) <= 100
    assert sm.indel_ratio("", "") == 100.0
    assert sm.token_set_ratio("a b", "b a c") == 100.0
    assert sm.token_set_ratio("", "a") == 0.0
    assert sm.token_sort_ratio("b a", "a b") == 100.0
    assert round(sm.jaro_winkler("martha", "marhta"), 6) == 0.961111


@pytest.mark.parametrize(("text", "want"), [(None, "EMPTY"), (" ", "EMPTY"), ("123", "OTHER"), ("abc", "LATIN"), ("राम x", "DEVANAGARI"), ("é", "LATIN")])
def test_scripts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.dominant_script("t")).first()[0] == want


def test_clean_and_fold(spark):
    df = spark.createDataFrame([("Crème & Brûlée, Straße",), (None,), ("<NULL>",), ("राम कॉ",)], "t string")
    assert [r[0] for r in df.select(tx.basic_clean("t")).collect()][:2] == ["creme and brulee straße", ""]
    assert df.select(tx.fold_latin("t")).first()[0] == "creme & brulee, strasse"
    assert [r[0] for r in df.select(tx.drop_placeholders("t")).collect()][2] == ""
    assert df.select(tx.fold_latin("t")).collect()[3][0] == "राम कॉ"


def test_normalise(spark):
    df = spark.createDataFrame([("Acme & Sons Pvt. Ltd.", "12/3 Market Street, Suite 4, Town 12345"), (None, None), ("Foo DBA Bar LLC", "N/A")], "n string, a string")
    got = df.select(*[c.alias(k) for k, c in tx.normalise_name("n").items()], *[c.alias(k) for k, c in tx.normalise_address("a").items()]).collect()
    assert (got[0]["name_core"], got[0]["legal_form"], got[0]["postcode"], got[0]["addr_numbers"][0]) == ("acme and sons", "PVT_LTD", "12345", "12-3")
    assert got[0]["addr_norm"].startswith("12 3 mkt st ste 4")
    assert got[1]["name_norm"] == "" and got[1]["addr_norm"] == ""
    assert got[2]["name_alts"] == ["foo", "bar llc"]


def test_folds(spark):
    rows = [(f"S1-{i}", "US" if i % 3 else None, i % 5) for i in range(100)]
    u = spark.createDataFrame(rows, "s1_id string, country string, n_true int").withColumn("loco_fold", F.lit(9))
    got = ln.stratified_folds(u).join(u, "s1_id").groupBy("country", F.least("n_true", F.lit(3)), "fold").count().collect()
    assert ln.stratified_folds(u).count() == 100
    sizes = {}
    for r in got:
        sizes.setdefault((r[0], r[1]), []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())
    assert {r["loco_fold"] for r in ln.loco_folds(u).collect()} == {0, None}
    assert ln.group_folds(u, 4).groupBy("s1_id").agg(F.countDistinct("gfold").alias("n")).filter("n > 1").count() == 0


def test_tsv_scan_and_lists(spark, tmp_path):
    path = tmp_path / "train_source1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A" \\ Co\tNA\tUS\n\nS1-2\t\t x \tIN\n', encoding="utf-8")
    rows = files.scan_tsv(spark, str(path), check_rows=True).collect()
    assert [tuple(r) for r in rows] == [("S1-1", '"A" \\ Co', "NA", "US"), ("S1-2", "", " x ", "IN")]
    truth = tmp_path / "truth.tsv"
    truth.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2\nS1-2\t\n", encoding="utf-8")
    assert [r["matches"] for r in files.scan_truth(spark, str(truth)).orderBy("s1_id").collect()] == [["S2-1", "S3-2"], []]
    universe = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "s1_id string, row_no int")
    pool = spark.createDataFrame([("S2-1",), ("S3-2",)], "entity_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "s1_id string, cand_id string")
    out = tmp_path / "matches.tsv"
    files.write_id_lists(files.id_list_frame(universe, pairs, pool), str(out))
    assert out.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS2-1,S3-2\n"
    assert files.validate_id_lists(spark, str(out), str(out), universe, pool) == []
    assert files.validate_id_lists(spark, str(out), None, universe, pool.limit(1)) == ["ids not in the pool"]
    with pytest.raises(ValueError):
        files.id_list_frame(universe, pairs.unionByName(spark.createDataFrame([("S1-1", "S2-9")], "s1_id string, cand_id string")), pool)


def test_small_sinks(spark, tmp_path):
    log = str(tmp_path / "log.csv")
    files.append_log(log, {"a": 1})
    files.append_log(log, {"a": 2, "b": "x"})
    assert open(log).read().splitlines() == ["a,b", "1,", "2,x"]
    files.save_json(str(tmp_path / "p.json"), {"t": 0.5})
    assert files.load_json(str(tmp_path / "p.json")) == {"t": 0.5}
    df = spark.createDataFrame([("a|b", 1)], "n string, k int")
    assert files.markdown_table(df).splitlines()[1:] == ["|---|---:|", "| a\\|b | 1 |"]
    files.write_stage(df, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 1
    vec = spark.createDataFrame([("a", [0.1]), ("b", [0.2])], "part string, v array<float>")
    assert files.write_vectors(vec, str(tmp_path / "v"), "part") == ["a", "b"]
    assert files.write_vectors(vec, str(tmp_path / "v"), "part") == []
    files.package_zip(str(tmp_path / "z.zip"), [log])
    assert os.path.getsize(tmp_path / "z.zip") > 0


def test_encode_plugs_in_a_model(spark):
    import numpy as np

    def model(texts):
        return np.array([[len(t), 1.0] for t in texts])

    out = vx.encode_texts(spark.createDataFrame([("abc",), (None,)], "t string"), "t", model, 2).collect()
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in out)
