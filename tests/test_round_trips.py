"""Gram search in chunks against brute force, list files and their checks, boosted training, and the data report."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowkin.operators import learning as ln
from rowkin.operators import vectors as vx
from rowkin.operators.common import cumulative
from rowkin.plans import reports
from rowkin.sources import files

SMALL = "/root/testdata/sf0.001"


def grams(text):
    out = []
    for w in text.lower().split():
        p = f" {w} "
        for n in (3, 4, 5):
            if n <= max(3, len(p)):
                out += [p[i : i + n] for i in range(max(1, len(p) - n + 1))]
    return Counter(out)


def brute(rows, k, fit):
    """Nearest records from the definition: {(s1, source): [(cand, score)]}."""
    def weights(texts):
        df = Counter(g for t in texts for g in grams(t))
        out = {}
        for t in set(texts):
            w = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in grams(t).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            out[t] = {g: x / norm for g, x in w.items()}
        return out

    everything = weights([t for _, _, _, t in rows])
    found = {}
    for i, s, c, t in rows:
        if s != 1:
            continue
        for source in (2, 3):
            pool = [(j, u) for j, r, d, u in rows if r == source and d == c]
            w = everything if fit == "all" else weights([u for _, r, d, u in rows if d == c and r in (1, source)])
            scored = sorted(((-round(sum(x * w[u].get(g, 0) for g, x in w[t].items()), 9), j) for j, u in pool))
            found |= {(i, j): -x for x, j in scored[:k] if x < 0}
    return found


@pytest.mark.parametrize("fit", ["all", "part"])
def test_gram_search_in_chunks(spark, monkeypatch, fit):
    random.seed(4)
    words = ["acme", "foods", "roofing", "tools", "bakery", "smith", "smyth", "x", "an"]
    rows = [(f"S{s}-{n}", s, random.choice("AB"), " ".join(random.sample(words, random.randrange(1, 4)))) for s in (1, 2, 3) for n in range(25)]
    df = spark.createDataFrame(rows + [("S1-n", 1, "A", None), ("S2-n", 2, None, "acme"), ("S3-b", 3, "A", " ")], "entity_id string, source int, country string, t string")
    whole = {(r[0], r[1]): round(r[2], 7) for r in vx.gram_neighbours(df, "t", 4, fit=fit, whole_source=False).select("s1_id", "cand_id", "score").collect()}
    monkeypatch.setattr(vx, "QUERY_TEXTS", 3)
    monkeypatch.setattr(vx, "POOL_TEXTS", 2)
    cut = {(r[0], r[1]): round(r[2], 7) for r in vx.gram_neighbours(df, "t", 4, fit=fit, whole_source=False).select("s1_id", "cand_id", "score").collect()}
    assert cut == whole
    if fit == "part":
        assert whole == {k: round(v, 7) for k, v in brute(rows, 4, fit).items()}
    assert vx.gram_neighbours(df.limit(0), "t", 4, fit=fit).count() == 0


def test_numbering(spark):
    df = spark.createDataFrame([(f"k{i:04d}", 1) for i in range(300)], "k string, one int").repartition(7)
    assert {r["k"]: r["upto"] for r in cumulative(df, "k", "one").collect()} == {f"k{i:04d}": i + 1 for i in range(300)}


def test_list_files(spark, tmp_path):
    universe = spark.createDataFrame([(f"S1-{i}", i) for i in range(40)], "s1_id string, row_no int").repartition(5)
    pool = spark.createDataFrame([(f"S2-{i}",) for i in range(50)], "entity_id string")
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{i + k}") for i in range(0, 40, 3) for k in (1, 0, 1)], "s1_id string, cand_id string")
    path = str(tmp_path / "lists.tsv")
    files.write_id_lists(files.id_list_frame(universe, pairs, pool), path)
    lines = open(path, encoding="utf-8").read().split("\n")
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and lines[-1] == "" and [x.split("\t")[0] for x in lines[1:-1]] == [f"S1-{i}" for i in range(40)]
    assert lines[1] == "S1-0\tS2-0,S2-1" and lines[2] == "S1-1\t"
    assert files.validate_id_lists(spark, path, None, universe, pool) == []
    swapped = [lines[0], lines[2], lines[1], *lines[3:]]
    for name, text, fault in (("swap", swapped, "rows missing, repeated or out of order"), ("short", [*lines[:-2], ""], "rows missing, repeated or out of order"), ("twice", [*lines[:-1], lines[-2], ""], "rows missing, repeated or out of order"), ("alien", [lines[0], lines[1] + ",S2-999", *lines[2:]], "ids not in the pool")):
        other = str(tmp_path / name)
        open(other, "w", encoding="utf-8").write("\n".join(text))
        assert fault in files.validate_id_lists(spark, other, None, universe, pool), name


def test_boosted_training_stops_early(spark):
    random.seed(1)
    rows = [(f"S1-{i}", f"S2-{i}", i % 2, x, None if i % 7 == 0 else random.random(), int(x > 0.5)) for i in range(400) for x in [random.random()]]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, fold int, a double, b double, y int")
    oof, models, found = ln.train_boosted(df, ["a", "b"], [0, 1], most=40, depth=2, seeds=(1, 2))
    assert len(models) == 2 and len(found["fold_rounds"]) == 4 and max(found["fold_rounds"]) <= 40
    assert found["rounds"] == max(1, int(sum(found["fold_rounds"]) / 4 * 1.1)) and next(iter(found["importance"])) == "a"
    got = {r["s1_id"]: r["prob"] for r in oof.collect()}
    assert len(got) == 400 and sum((got[r[0]] >= 0.5) == bool(r[5]) for r in rows) >= 390
    again = {r["s1_id"]: r["prob"] for r in ln.predict(models, df, ["a", "b"]).collect()}
    assert all(0 <= p <= 1 for p in again.values()) and len(again) == 400


def test_no_local_scratch_on_a_cluster(spark, monkeypatch):
    from rowkin import session

    class Context:
        master = "spark://somewhere:7077"
        applicationId = "app"

    class Session:
        conf = spark.conf
        sparkContext = Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            session.scratch_dir(Session())


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")
def test_report(spark, tmp_path):
    path = tmp_path / "report.md"
    titles = reports.write_report(spark, SMALL, str(path))
    text = path.read_text(encoding="utf-8")
    assert len(titles) == len(reports.SECTIONS) and all(f"## {t}\n" in text for t in titles)


def test_grams_in_tasks():
    """The grams that tasks make are those of the definition, also of texts longer than a slice, empty ones and letters beyond the first plane."""
    from rowkin.operators import grams as gr

    texts = ["ab", "", "a b", "acme foods acme", "x" * 40, "\U0001d538\U0001d539 zürich", "foods"] * 3
    kept = gr.LETTERS
    gr.LETTERS = 30
    try:
        of, _, tf, names = gr.text_grams(texts, True)
    finally:
        gr.LETTERS = kept
    got = [Counter() for _ in texts]
    for i, n, g in zip(of.tolist(), tf.tolist(), names, strict=True):
        got[i][g] += n
    assert got == [grams(t) for t in texts]


def test_gram_search_moves_no_pairs_of_chunks(spark, monkeypatch):
    """With chunks of two and three texts, what is shuffled stays near what it is with one chunk; copies for every pair of chunks took many times as much."""
    rows = [(f"S{1 + n % 3}-{n}", 1 + n % 3, "A", f"acme foods {n} roofing {n * 7919 % 1000}") for n in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, source int, country string, t string")

    def moved() -> tuple[int, set]:
        status = spark.sparkContext._jsc.sc().statusStore()
        seen = {s.stageId() for s in stages(status)}
        found = {tuple(r) for r in vx.gram_neighbours(df, "t", 3).select("s1_id", "cand_id", F.round("score", 7)).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(s.shuffleWriteRecords() for s in stages(status) if s.stageId() not in seen), found

    def stages(status):
        every = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return [every.apply(i) for i in range(every.size())]

    whole, found = moved()
    monkeypatch.setattr(vx, "QUERY_TEXTS", 3)
    monkeypatch.setattr(vx, "POOL_TEXTS", 2)
    cut, same = moved()
    assert same == found and cut < 1.5 * whole
