"""Queries on names of any script: every row takes part, compared by character, beside brute force and the SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as e
from rowkin.functions.similarity import jaro_winkler
from rowkin.functions.text import LEGAL_FIRST, script_of_text

NAMES = {"S1-1": "café münchen", "S1-2": "शर्मा फूड्स", "S1-3": "acme foods", "S2-1": "cafe munchen", "S2-2": "sharma foods", "S3-3": "acme food", "S3-4": "शर्मा फूड"}
RAW = {"S1-1": "«Café München GmbH", "S1-2": "शर्मा फूड्स pvt", "S1-3": "ACME FOODS LLC", "S2-1": "CAFÉ MÜNCHEN", "S2-2": ">> sharma foods", "S3-3": "éclair aka acme", "S3-4": "‌शर्मा फूड"}
PAIRS = [("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S3-4"), ("S1-3", "S3-3")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("scripts"))
    rows = [("train", int(k[1]), k, "IN", RAW[k], NAMES[k], "1000") for k in NAMES]
    spark.createDataFrame(rows, "split string, source int, entity_id string, country string, business_name string, name_core string, postcode string").selectExpr("*", "timestamp '2024-01-01' as loaded_at").coalesce(1).write.parquet(f"{d}/records.parquet")
    spark.createDataFrame(PAIRS[2:], "s1_id string, cand_id string").coalesce(1).write.parquet(f"{d}/candidates_train.parquet")
    spark.createDataFrame(PAIRS, "s1_id string, cand_id string").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


def run(spark, tables, name):
    return {tuple(r)[:2]: tuple(r)[2:] for r in e.queries()[name](spark, tables).collect()}


def by_sql(tables, name):
    con = duckdb.connect()
    for t in ("records", "candidates_train", "labels"):
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    return {tuple(r)[:2]: tuple(r)[2:] for r in con.sql(e.oracle_sql()[name]).fetchall()}


def ned(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return round(row[-1] / max(len(a), len(b)), 6)


def test_similarities_of_every_pair(spark, tables):
    for name, fn in (("sim_jw", lambda a, b: round(jaro_winkler(a, b), 6)), ("sim_ned", ned)):
        got = run(spark, tables, name)
        assert got == {p: (fn(NAMES[p[0]], NAMES[p[1]]),) for p in PAIRS[2:]}
        assert by_sql(tables, name) == got


def test_misses_of_every_script(spark, tables):
    got = run(spark, tables, "misses")
    want = {p: ned(NAMES[p[0]], NAMES[p[1]]) for p in PAIRS[:2]}
    assert got == {p: (v, "address_only_match" if v > 0.6 else "other") for p, v in want.items()}
    assert {v[1] for v in got.values()} == {"address_only_match", "other"}
    assert by_sql(tables, "misses") == got


def test_noise_flags_of_every_record(spark, tables):
    legal = rf"(?i)^[^\w]*(?:{LEGAL_FIRST.replace(' ', '|')})(?:[^\w]|$)"
    want = {}
    for k, v in RAW.items():
        flags = (
            re.search(r"^[^\w]", v), re.search(r"^\d", v), re.search(r"(?i)www\.|https?:|\.(?:com|in|net|org|co|us|fr)\b", v), re.search(r"(?i)\bdba\b|trading as", v), not re.search(r"\s", v), re.search(r"\d", v),
            re.search("[A-ZÀ-ÖØ-Þ]", v) and not re.search("[a-z]", v), re.search(legal, v), re.search("[\u00ad\u200b-\u200f\u2060\ufeff]", v),
        )
        old = want.get(int(k[1]), (0,) * 10)
        want[int(k[1])] = (old[0] + 1, *(n + bool(f) for n, f in zip(old[1:], flags, strict=True)))
    got = {r["source"]: tuple(r)[1:] for r in e.queries()["re_noise_flags"](spark, tables).collect()}
    assert got == want and got[3][1] == 1 and got[2][7] == 1
    assert {k[0]: k[1:] + v for k, v in by_sql(tables, "re_noise_flags").items()} == {k: v for k, v in got.items()}


def test_scripts():
    assert [script_of_text(t) for t in ("한국어", "ひらがな", "สวัสดี", "שלום", "հայ", "සිංහල", "Ａcme", "中文", "", "123")] == ["HANGUL", "CJK", "THAI", "HEBREW", "ARMENIAN", "SINHALA", "LATIN", "CJK", "EMPTY", "OTHER"]
