"""Queries of blocking, similarity search and pair features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.operators import blocking as bl
from rowkin.operators import features as ft
from rowkin.operators import vectors as vx
from rowkin.operators.common import PASSES
from rowkin.operators.grams import gram_weights
from rowkin.plans.tables import Tables, with_

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        name = fn.__name__
        Q[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            S[name] = sql
        return fn

    return add


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _score(df):
    return rounded(df.select("s1_id", "cand_id", F.col("cand_source").cast("int").alias("cand_source"), F.col("score").cast("double").alias("score")), "score")


_TOKENS = r"tok AS (SELECT DISTINCT country, entity_id, source, unnest(list_filter(regexp_split_to_array(trim(name_core), '\s+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^\p{Nd}+$'))) AS token FROM rec)"
_RARE = "rare AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM rec) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM tok GROUP BY token HAVING count(*) <= 20)"
_TOP30 = "row_number() OVER (PARTITION BY s1_id, cand_source ORDER BY score DESC, cand_id) <= 30"
_EXACT = f"exact AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, CAST(b.source AS INTEGER) AS cand_source, 1.0::DOUBLE AS score FROM rec a JOIN rec b ON a.country = b.country AND a.name_core = b.name_core WHERE a.source = 1 AND b.source IN (2, 3) AND trim(a.name_core) <> '' QUALIFY {_TOP30})"
_RARE_TOKEN = f"raretok AS (SELECT s1_id, cand_id, cand_source, score FROM (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, CAST(b.source AS INTEGER) AS cand_source, max(r.idf) AS score FROM tok a JOIN rare r USING (token) JOIN tok b ON a.country = b.country AND a.token = b.token WHERE a.source = 1 AND b.source IN (2, 3) GROUP BY ALL) QUALIFY {_TOP30})"
_ADDR = f"""keyed AS (SELECT country, entity_id, source, postcode, lower(city) AS city, coalesce(addr_numbers[1], '') AS number, regexp_extract(lower(addr_norm), '(\\S+)', 1) AS word FROM rec),
addrkey AS (SELECT s1_id, cand_id, cand_source, score FROM (SELECT s1_id, cand_id, cand_source, max(score) AS score FROM (
  SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, CAST(b.source AS INTEGER) AS cand_source, 1.0::DOUBLE AS score FROM keyed a JOIN keyed b ON a.country = b.country AND a.postcode = b.postcode AND a.number = b.number WHERE a.source = 1 AND b.source IN (2, 3) AND a.postcode <> '' AND a.number <> ''
  UNION ALL SELECT a.entity_id, b.entity_id, CAST(b.source AS INTEGER), 0.8::DOUBLE FROM keyed a JOIN keyed b ON a.country = b.country AND a.city = b.city AND a.number = b.number AND a.word = b.word WHERE a.source = 1 AND b.source IN (2, 3) AND a.city <> '' AND a.number <> '' AND a.word <> '') GROUP BY ALL) QUALIFY {_TOP30})"""


@query(with_("rec", _EXACT) + "SELECT s1_id, cand_id, cand_source, score FROM exact")
def blk_exact_name(t):
    return _score(bl.exact_name(t.records))


@query(with_("rec", _TOKENS, _RARE, _RARE_TOKEN) + "SELECT s1_id, cand_id, cand_source, round(score, 6) AS score FROM raretok")
def blk_rare_token(t):
    return _score(bl.rare_token(t.records))


@query(with_("rec", _ADDR) + "SELECT s1_id, cand_id, cand_source, round(score, 6) AS score FROM addrkey")
def blk_addr_key(t):
    return _score(bl.addr_key(t.records))


def _grams(text: str) -> str:
    """Gram weights over distinct texts, with the number of rows that share a text."""
    return f"""rows_ AS (SELECT entity_id, source, country, coalesce({text}, '') AS text FROM rec WHERE trim(coalesce({text}, '')) <> ''),
    texts AS (SELECT text, count(*) AS copies FROM rows_ GROUP BY text),
    wrd AS (SELECT text, copies, i AS wi, ' ' || w || ' ' AS p, length(w) AS n FROM (SELECT text, copies, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), 1) AS i FROM texts)),
    gr AS (SELECT text, copies, substr(p, CAST(i AS BIGINT), g) AS gram FROM wrd, (VALUES (3), (4), (5)) AS z(g), LATERAL (SELECT unnest(generate_series(1, greatest(1, n + 3 - g))) AS i) WHERE g <= greatest(3, least(5, n + 2))),
    tf AS (SELECT text, gram, count(*) AS tf, max(copies) AS copies FROM gr GROUP BY text, gram),
    dfs AS (SELECT gram, sum(copies) AS df FROM tf GROUP BY gram),
    raw AS (SELECT text, gram, (1.0::DOUBLE + ln(tf)) * (ln((1.0::DOUBLE + (SELECT sum(copies) FROM texts)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM tf JOIN dfs USING (gram)),
    wt AS (SELECT text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM raw)"""


def _knn(text: str, k: int) -> str:
    return with_("rec", _grams(text)) + f""", a AS (SELECT DISTINCT country, text AS t1 FROM rows_ WHERE source = 1), b AS (SELECT DISTINCT country, source, text AS t2 FROM rows_ WHERE source IN (2, 3)),
    bare AS (SELECT country, source FROM (SELECT DISTINCT country FROM a), (SELECT DISTINCT source FROM b) EXCEPT SELECT country, source FROM b),
    pool AS (SELECT country, source, country AS land, t2 FROM b UNION ALL SELECT DISTINCT bare.country, bare.source, NULL, b.t2 FROM bare JOIN b ON b.source = bare.source),
    aw AS (SELECT country, t1, gram, w AS w1 FROM a JOIN wt ON wt.text = t1), pw AS (SELECT country, source, t2, gram, w AS w2 FROM pool JOIN wt ON wt.text = t2),
    near AS (SELECT aw.country, t1, source, t2, round(sum(w1 * w2), 9) AS score FROM aw JOIN pw ON aw.country = pw.country AND aw.gram = pw.gram GROUP BY ALL),
    best AS (SELECT * FROM near QUALIFY rank() OVER (PARTITION BY country, t1, source ORDER BY score DESC) <= {k}),
    owned AS (SELECT best.country, t1, best.source, c.entity_id AS cand_id, score FROM best JOIN rows_ c ON c.text = best.t2 AND c.source = best.source AND c.country = best.country
        UNION ALL SELECT best.country, t1, best.source, c.entity_id, score FROM best JOIN bare ON bare.country = best.country AND bare.source = best.source JOIN rows_ c ON c.text = best.t2 AND c.source = best.source),
    topk AS (SELECT * FROM owned QUALIFY row_number() OVER (PARTITION BY country, t1, source ORDER BY score DESC, cand_id) <= {k})
    SELECT s.entity_id AS s1_id, cand_id, CAST(topk.source AS INTEGER) AS cand_source, round(score, 6) AS score FROM topk JOIN rows_ s ON s.source = 1 AND s.country = topk.country AND s.text = t1"""


@query(with_("rec", _grams("name_core")) + "SELECT text, gram, round(w, 6) AS w FROM wt")
def tfidf_charwb(t):
    texts = t.records.filter(F.trim("name_core") != "").groupBy(F.col("name_core").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return rounded(gram_weights(texts), "w")


@query(_knn("name_core", 20))
def blk_tfidf_name(t):
    return _score(bl.tfidf_name(t.records))


@query(_knn("concat_ws(' ', name_core, addr_norm)", 20))
def blk_tfidf_full(t):
    return _score(bl.tfidf_full(t.records))


@query(with_("rec") + r"""rows_ AS (SELECT entity_id, source, country, lower(concat_ws(' ', business_name, business_address)) AS text FROM rec WHERE country IS NOT NULL AND trim(lower(concat_ws(' ', business_name, business_address))) <> ''),
    parts AS (SELECT DISTINCT country, source AS target FROM rows_ WHERE source IN (2, 3) AND country IN (SELECT country FROM rows_ WHERE source = 1)),
    docs AS (SELECT target, r.* FROM parts p JOIN rows_ r ON r.country = p.country AND r.source IN (1, target)),
    wrd AS (SELECT text, i AS wi, ' ' || ws[i] || ' ' AS p, length(ws[i]) AS n FROM (SELECT text, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT DISTINCT text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM rows_))),
    gr AS (SELECT text, substr(p, CAST(i AS BIGINT), g) AS gram FROM wrd, (VALUES (3), (4), (5)) AS z(g), LATERAL (SELECT unnest(generate_series(1, greatest(1, n + 3 - g))) AS i) WHERE g <= greatest(3, least(5, n + 2))),
    tf AS (SELECT text, gram, count(*) AS tf FROM gr GROUP BY text, gram), sizes AS (SELECT country, target, count(*) AS n FROM docs GROUP BY country, target),
    dfs AS (SELECT country, target, gram, count(*) AS df FROM docs JOIN tf USING (text) GROUP BY ALL),
    wt AS (SELECT country, target, text, gram, w / sqrt(sum(w * w) OVER (PARTITION BY country, target, text)) AS w FROM (SELECT d.country, d.target, tf.text, tf.gram, (1.0::DOUBLE + ln(tf)) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w
        FROM (SELECT DISTINCT country, target, text FROM docs) d JOIN tf USING (text) JOIN dfs f ON f.country = d.country AND f.target = d.target AND f.gram = tf.gram JOIN sizes z ON z.country = d.country AND z.target = d.target)),
    near AS (SELECT x.country, x.target, x.text AS t1, y.text AS t2, round(sum(x.w * y.w), 9) AS score FROM wt x JOIN wt y ON x.country = y.country AND x.target = y.target AND x.gram = y.gram
        WHERE x.text IN (SELECT text FROM rows_ WHERE source = 1) AND y.text IN (SELECT text FROM rows_ WHERE source <> 1) GROUP BY ALL),
    topk AS (SELECT near.*, c.entity_id AS cand_id FROM near JOIN rows_ c ON c.text = t2 AND c.country = near.country AND c.source = target QUALIFY row_number() OVER (PARTITION BY near.country, target, t1 ORDER BY score DESC, cand_id) <= 10)
    SELECT s.entity_id AS s1_id, cand_id, CAST(target AS INTEGER) AS cand_source, round(score, 6) AS score FROM topk JOIN rows_ s ON s.source = 1 AND s.country = topk.country AND s.text = t1""".replace("rows_ AS", ", rows_ AS", 1).replace("\\\\s", "\\s"))
def blk_baseline_knn(t):
    raw = t.records.withColumn("raw", F.lower(F.concat_ws(" ", "business_name", "business_address")))
    return _score(vx.gram_neighbours(raw, "raw", 10, fit="part", whole_source=False))


@query(with_("rec", _grams("name_core")) + """, a AS (SELECT DISTINCT country, text AS t1 FROM rows_ WHERE source = 1), b AS (SELECT DISTINCT country, source, text AS t2 FROM rows_ WHERE source IN (2, 3)),
    near AS (SELECT a.country, t1, source, t2, round(sum(x.w * y.w), 9) AS score FROM a JOIN wt x ON x.text = t1 JOIN wt y ON y.gram = x.gram JOIN b ON b.t2 = y.text AND b.country = a.country GROUP BY ALL),
    pairs AS (SELECT s.entity_id AS s1_id, c.entity_id AS cand_id, CAST(c.source AS INTEGER) AS cand_source, score FROM near JOIN rows_ c ON c.text = t2 AND c.country = near.country AND c.source = near.source JOIN rows_ s ON s.source = 1 AND s.text = t1 AND s.country = near.country)
    SELECT s1_id, cand_id, cand_source, round(score, 6) AS score FROM pairs QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, s1_id) <= 5""")
def blk_reverse(t):
    return _score(bl.reverse(t.records))


@query("SELECT s1_id, cand_id, CAST(substr(cand_id, 2, 1) AS INTEGER) AS cand_source, round(max(CAST(bs_dense AS DOUBLE)), 6) AS score FROM candidates_train WHERE blk_dense GROUP BY s1_id, cand_id")
def blk_dense(t):
    return _score(bl.from_neighbours(t.cands.filter("blk_dense").select("s1_id", "cand_id", F.col("bs_dense").alias("score"))))


@query(with_("rec", _TOKENS, _RARE, _RARE_TOKEN, _EXACT, _ADDR, "allp AS (SELECT *, 'exact_name' AS pass FROM exact UNION ALL SELECT *, 'rare_token' FROM raretok UNION ALL SELECT *, 'addr_key' FROM addrkey)") + """SELECT s1_id, cand_id, min(cand_source) AS cand_source,
    bool_or(pass = 'exact_name') AS blk_exact_name, bool_or(pass = 'rare_token') AS blk_rare_token, bool_or(pass = 'addr_key') AS blk_addr_key, round(max(score) FILTER (pass = 'exact_name'), 6) AS bs_exact_name, round(max(score) FILTER (pass = 'rare_token'), 6) AS bs_rare_token, round(max(score) FILTER (pass = 'addr_key'), 6) AS bs_addr_key FROM allp GROUP BY s1_id, cand_id""")
def blk_union(t):
    r = t.records
    df = bl.union_passes({"exact_name": bl.exact_name(r), "rare_token": bl.rare_token(r), "addr_key": bl.addr_key(r)})
    return rounded(df.withColumn("cand_source", F.col("cand_source").cast("int")), "bs_exact_name", "bs_rare_token", "bs_addr_key")


_PCT = ", ".join(f"CASE WHEN bs_{p} IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY bs_{p} IS NULL ORDER BY bs_{p}) + (count(*) OVER (PARTITION BY bs_{p}) - 1) / 2.0::DOUBLE) / count(bs_{p}) OVER () END AS pct_{p}" for p in PASSES)
_PRUNED = f"""pct AS (SELECT s1_id, cand_id, {' + '.join(f'CAST(blk_{p} AS INTEGER)' for p in PASSES)} AS n_passes, {_PCT} FROM candidates_train),
    scored AS (SELECT s1_id, cand_id, n_passes, greatest({', '.join(f'pct_{p}' for p in PASSES)}) AS score FROM pct),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id) - 1 AS INTEGER) AS prune_rank FROM scored)"""


@query(f"WITH {_PRUNED} SELECT s1_id, cand_id, n_passes, round(score, 6) AS prune_score, prune_rank FROM ranked WHERE prune_rank < 3 OR n_passes >= 3")
def blk_prune(t):
    df = bl.prune(t.cands.drop("prune_score", "prune_rank"), 3)
    return rounded(df.select("s1_id", "cand_id", "n_passes", "prune_score", "prune_rank"), "prune_score")


_RAN = ("exact_name", "rare_token", "addr_key", "dense")
_GEN_PCT = ", ".join(f"CASE WHEN bs_{p} IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY bs_{p} IS NULL ORDER BY bs_{p}) + (count(*) OVER (PARTITION BY bs_{p}) - 1) / 2.0::DOUBLE) / count(bs_{p}) OVER () END AS pct_{p}" for p in _RAN)


@query(with_("rec", _TOKENS, _RARE, _RARE_TOKEN, _EXACT, _ADDR, "allp AS (SELECT *, 'exact_name' AS pass FROM exact UNION ALL SELECT *, 'rare_token' FROM raretok UNION ALL SELECT *, 'addr_key' FROM addrkey UNION ALL SELECT s1_id, cand_id, CAST(substr(cand_id, 2, 1) AS INTEGER), CAST(bs_dense AS DOUBLE), 'dense' FROM candidates_train WHERE blk_dense)",
             "un AS (SELECT s1_id, cand_id, min(cand_source) AS cand_source, " + ", ".join(f"bool_or(pass = '{p}') AS blk_{p}, max(score) FILTER (pass = '{p}') AS bs_{p}" for p in _RAN) + " FROM allp GROUP BY s1_id, cand_id)", f"pcts AS (SELECT *, {_GEN_PCT} FROM un)",
             f"ranked AS (SELECT *, greatest({', '.join(f'pct_{p}' for p in _RAN)}) AS score, {' + '.join(f'CAST(blk_{p} AS INTEGER)' for p in _RAN)} AS n_passes FROM pcts)", "cutoff AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(score, 9) DESC, cand_id) - 1 AS place FROM ranked)")
       + "SELECT s1_id, cand_id, CAST(cand_source AS TINYINT) AS cand_source, " + ", ".join(f"blk_{p}" if p in _RAN else f"false AS blk_{p}" for p in PASSES) + ", " + ", ".join(f"round(CAST(CAST(bs_{p} AS FLOAT) AS DOUBLE), 6) AS bs_{p}" if p in _RAN else f"CAST(NULL AS DOUBLE) AS bs_{p}" for p in PASSES)
       + ", round(CAST(CAST(score AS FLOAT) AS DOUBLE), 6) AS prune_score, CAST(place AS SMALLINT) AS prune_rank FROM cutoff WHERE place < 30 OR n_passes >= 3")
def blk_generate(t):
    neighbours = t.cands.filter("blk_dense").select("s1_id", "cand_id", F.col("bs_dense").alias("score"))
    made = bl.generate(t.records, top_n=30, neighbours=neighbours)
    return made.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in (*[f"bs_{p}" for p in PASSES], "prune_score")})


@query()
def blk_learned_prune(t):
    from rowkin.operators.learning import learned_prune

    scored, _ = learned_prune(t.cands, t.truth, top_n=50)
    return scored.select("s1_id", "cand_id", "prune_score", "prune_rank")


_Q, _P = "q AS (SELECT id AS s1_id, country, v AS v1 FROM vec WHERE source = 1)", "p AS (SELECT id AS cand_id, source, country, v AS v2 FROM vec WHERE source IN (2, 3))"
_DOT = "round(list_sum(list_transform(list_zip(v1, v2), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 5)"


@query(with_("vec", _Q, _P) + f"SELECT s1_id, cand_id, {_DOT} AS score FROM q JOIN p USING (country) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY {_DOT} DESC, cand_id) <= 10")
def dense_topk(t):
    v = t.vectors
    return vx.dense_top_k(v.filter("source = 1").select("country", F.col("id").alias("s1_id"), "v"), v.filter("source <> 1").select("country", F.col("id").alias("cand_id"), "v"), 10)


_DENSE = with_("vec", _Q, _P, "sizes AS (SELECT country, source, count(*) AS n FROM p GROUP BY ALL)", f"""fw AS (
    SELECT s1_id, cand_id, p.source, {_DOT} AS score FROM q JOIN p USING (country) JOIN sizes z ON z.country = q.country AND z.source = p.source AND z.n >= 20
    UNION ALL SELECT s1_id, cand_id, p.source, {_DOT} AS score FROM q, p WHERE NOT EXISTS (SELECT 1 FROM sizes z WHERE z.country = q.country AND z.source = p.source AND z.n >= 20))""",
    "fk AS (SELECT s1_id, cand_id, score FROM fw QUALIFY row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, cand_id) <= 20)",
    f"bk AS (SELECT s1_id, cand_id, {_DOT} AS score FROM q JOIN p USING (country) QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY {_DOT} DESC, s1_id) <= 3)") + "SELECT s1_id, cand_id, max(score) AS score FROM (SELECT * FROM fk UNION ALL SELECT * FROM bk) GROUP BY s1_id, cand_id QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY max(score) DESC, cand_id) <= 30"


@query(_DENSE)
def dense_neighbors(t):
    v = t.vectors
    return vx.dense_neighbours(v.filter("source = 1").select("country", F.col("id").alias("s1_id"), "v"), v.filter("source <> 1").select("country", F.col("id").alias("cand_id"), F.col("source").alias("cand_source"), "v"), k=20)


@query(with_("vec", _Q, _P) + f"SELECT s1_id, cand_id, {_DOT} AS cosine FROM q JOIN p USING (country)")
def pair_cosine(t):
    v = t.vectors
    pairs = v.filter("source = 1").select("country", F.col("id").alias("s1_id")).join(v.filter("source <> 1").select("country", F.col("id").alias("cand_id")), "country").select("s1_id", "cand_id")
    return vx.pair_cosine(pairs, v.select("id", "v")).select("s1_id", "cand_id", F.round("cosine", 5).alias("cosine"))


@query(with_("rec") + """SELECT entity_id, 26 AS dim, CAST(len(list_filter(v, lambda x: x > 0)) AS INTEGER) AS n_filled, CAST(list_position(v, list_max(v)) AS BIGINT) AS top_dim
    FROM (SELECT entity_id, list_transform(range(26), lambda i: length(t) - length(replace(t, chr(CAST(97 + i AS INTEGER)), ''))) AS v FROM (SELECT entity_id, 'query: ' || coalesce(name_core, '') AS t FROM rec))""")
def encode(t):
    """A stand-in for a sentence model, whose vectors SQL can follow: how often each letter occurs in the prefixed text."""
    import numpy as np

    def letters(texts):
        return np.array([[s.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for s in texts], dtype=np.float32).reshape(len(texts), 26)

    out = vx.encode_texts(t.records.select("entity_id", "name_core"), "name_core", letters, 26)
    return out.select("entity_id", F.size("embedding").alias("dim"), F.size(F.filter("embedding", lambda x: x > 0)).alias("n_filled"), F.array_position("embedding", F.array_max("embedding")).alias("top_dim"))


@query(with_("truth") + "SELECT coalesce(CAST(substr(cand_id, 2, 1) AS INTEGER), 0) AS source, count(*) AS n_true, round(avg(hit), 6) AS recall FROM (SELECT t.s1_id, t.cand_id, CASE WHEN c.cand_id IS NULL THEN 0 ELSE 1 END AS hit FROM truth t LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM candidates_train WHERE blk_dense) c USING (s1_id, cand_id)) GROUP BY GROUPING SETS ((CAST(substr(cand_id, 2, 1) AS INTEGER)), ())")
def dense_recall(t):
    from rowkin.operators.metrics import pair_recall

    return rounded(pair_recall(t.cands.filter("blk_dense"), t.truth), "recall")


@query(with_("rec", "fr AS (SELECT name_core, count(*) AS f FROM rec WHERE name_core <> '' GROUP BY name_core)", "own AS (SELECT entity_id, f FROM rec JOIN fr USING (name_core))") + "SELECT c.s1_id, c.cand_id, coalesce(a.f, 1) AS fc_name_freq_s1, coalesce(b.f, 1) AS fc_name_freq_cand FROM candidates_train c LEFT JOIN own a ON a.entity_id = c.s1_id LEFT JOIN own b ON b.entity_id = c.cand_id")
def fc_name_freq(t):
    return ft.name_frequency(t.cands.select("s1_id", "cand_id"), t.records)


_AKEY = "ak AS (SELECT entity_id, name_core, CASE WHEN coalesce(postcode, '') <> '' AND coalesce(addr_numbers[1], '') <> '' THEN postcode || '|' || addr_numbers[1] WHEN coalesce(addr_norm, '') <> '' THEN '__anorm__' || addr_norm END AS akey FROM rec)"


@query(with_("rec", _AKEY, "fr AS (SELECT akey, count(DISTINCT name_core) AS f FROM ak WHERE akey IS NOT NULL GROUP BY akey)", "own AS (SELECT entity_id, f FROM ak JOIN fr USING (akey))") + "SELECT c.s1_id, c.cand_id, coalesce(a.f, 1) AS fc_addr_freq_s1, coalesce(b.f, 1) AS fc_addr_freq_cand FROM candidates_train c LEFT JOIN own a ON a.entity_id = c.s1_id LEFT JOIN own b ON b.entity_id = c.cand_id")
def fc_addr_freq(t):
    return ft.address_frequency(t.cands.select("s1_id", "cand_id"), t.records)


_COUNTS = "SELECT s1_id, cand_id, count(*) OVER w AS fc_n_cands, count(*) FILTER (CAST(bs_dense AS DOUBLE) >= 0.95::DOUBLE) OVER w AS fc_n_close, CAST(prune_rank AS INTEGER) AS fc_rank, round(max(CAST(prune_score AS DOUBLE)) OVER w - CAST(prune_score AS DOUBLE), 6) AS fc_gap_best FROM candidates_train WINDOW w AS (PARTITION BY s1_id)"


@query(_COUNTS)
def fc_counts(t):
    return rounded(ft.candidate_counts(t.cands).select("s1_id", "cand_id", "fc_n_cands", "fc_n_close", "fc_rank", "fc_gap_best"), "fc_gap_best")


_REV = "SELECT s1_id, cand_id, CAST(row_number() OVER (PARTITION BY cand_id ORDER BY prune_score DESC NULLS LAST, s1_id) - 1 AS INTEGER) AS fc_rev_rank, count(*) OVER (PARTITION BY cand_id) AS fc_rev_n FROM candidates_train"


@query(_REV)
def fc_rev_rank(t):
    return ft.reverse_ranks(t.cands).select("s1_id", "cand_id", "fc_rev_rank", "fc_rev_n")


_PASS = "SELECT s1_id, cand_id, " + " + ".join(f"CAST(blk_{p} AS INTEGER)" for p in PASSES) + " AS fc_n_passes, CAST(cand_source AS INTEGER) AS fc_cand_source, " + ", ".join(f"CAST(blk_{p} AS INTEGER) AS fc_blk_{p}, round(CAST(bs_{p} AS DOUBLE), 6) AS fc_bs_{p}" for p in PASSES) + " FROM candidates_train"


@query(_PASS)
def fc_passes(t):
    df = ft.pass_features(t.cands)
    return rounded(df.select("s1_id", "cand_id", "fc_n_passes", "fc_cand_source", *[c for p in PASSES for c in (f"fc_blk_{p}", f"fc_bs_{p}")]), *[f"fc_bs_{p}" for p in PASSES])


@query(f"SELECT * FROM ({_COUNTS}) JOIN ({_REV}) USING (s1_id, cand_id) JOIN ({_PASS}) USING (s1_id, cand_id) JOIN ({S['fc_name_freq']}) USING (s1_id, cand_id) JOIN ({S['fc_addr_freq']}) USING (s1_id, cand_id)")
def context_all(t):
    return rounded(ft.context_features(t.cands, t.records), "fc_gap_best", *[f"fc_bs_{p}" for p in PASSES])


@query(with_("pr") + """SELECT s1_id, cand_id, CAST(row_number() OVER a - 1 AS INTEGER) AS fc2_rank_p, round(max(p) OVER (PARTITION BY s1_id) - p, 6) AS fc2_gap_p,
    round(nth_value(p, 2) OVER (PARTITION BY s1_id ORDER BY p DESC, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS fc2_second_p, count(*) FILTER (p > 0.5::DOUBLE) OVER (PARTITION BY s1_id) AS fc2_n_above_05,
    CAST(row_number() OVER b - 1 AS INTEGER) AS fc2_rev_rank_p, CASE WHEN row_number() OVER a = 1 AND row_number() OVER b = 1 THEN 1 ELSE 0 END AS fc2_mutual_best,
    round(CASE WHEN p >= max(p) OVER (PARTITION BY cand_id) THEN nth_value(p, 2) OVER (PARTITION BY cand_id ORDER BY p DESC, s1_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(p) OVER (PARTITION BY cand_id) END, 6) AS fc2_best_competitor_p
    FROM pr WINDOW a AS (PARTITION BY s1_id ORDER BY p DESC, cand_id), b AS (PARTITION BY cand_id ORDER BY p DESC, s1_id)""")
def stage2_all(t):
    return rounded(ft.stage2_features(t.preds), "fc2_gap_p", "fc2_second_p", "fc2_best_competitor_p")


@query()
def fc2_support(t):
    return ft.support(t.preds, t.records.select("entity_id", "name_core"))


@query("SELECT s1_id, cand_id, CAST(row_number() OVER w - 1 AS INTEGER) AS g_rank, round(max(s) OVER (PARTITION BY s1_id), 6) AS g_best, round(CASE WHEN row_number() OVER w = 1 THEN nth_value(s, 2) OVER (PARTITION BY s1_id ORDER BY s DESC, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(s) OVER (PARTITION BY s1_id) END, 6) AS g_other FROM (SELECT s1_id, cand_id, CAST(prune_score AS DOUBLE) AS s FROM candidates_train) WINDOW w AS (PARTITION BY s1_id ORDER BY s DESC, cand_id)")
def group_rank(t):
    df = ft.group_rank(t.cands.select("s1_id", "cand_id", F.col("prune_score").cast("double").alias("s")), "s1_id", "s", "cand_id")
    return rounded(df.drop("s"), "g_best", "g_other")


_DENSE_PAIRS = "dp AS (SELECT s1_id, cand_id, CAST(bs_dense AS DOUBLE) AS s FROM candidates_train WHERE blk_dense)"


@query(with_(_DENSE_PAIRS) + """, f AS (SELECT s1_id, cand_id, s, CAST(row_number() OVER r - 1 AS INTEGER) AS rr, max(s) OVER c AS best, nth_value(s, 2) OVER (PARTITION BY cand_id ORDER BY s DESC, s1_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, count(*) OVER c AS n, row_number() OVER (PARTITION BY s1_id ORDER BY s DESC, cand_id) AS own FROM dp WINDOW r AS (PARTITION BY cand_id ORDER BY s DESC, s1_id), c AS (PARTITION BY cand_id)),
    g AS (SELECT f.*, count(*) FILTER (s >= best - 0.02::DOUBLE) OVER (PARTITION BY cand_id) AS near FROM f)
    SELECT s1_id, cand_id, round(s, 6) AS score, rr AS q_rev_rank, round(best, 6) AS q_cand_best, n AS q_rev_n, near AS q_rev_n_close, round(best - s, 6) AS q_gap_cand_best, round(s - CASE WHEN rr = 0 THEN second ELSE best END, 6) AS q_rival_margin, CASE WHEN own = 1 AND rr = 0 THEN 1 ELSE 0 END AS q_mutual_best FROM g WHERE s1_id IN (SELECT s1_id FROM folds WHERE fold = 0)""")
def q_competition(t):
    pairs = t.cands.filter("blk_dense").select("s1_id", "cand_id", F.col("bs_dense").alias("score"))
    out = ft.competition(pairs, t.universe.filter("fold = 0"))
    return rounded(out.select("s1_id", "cand_id", "score", "q_rev_rank", "q_cand_best", "q_rev_n", "q_rev_n_close", "q_gap_cand_best", "q_rival_margin", "q_mutual_best"), "score", "q_cand_best", "q_gap_cand_best", "q_rival_margin")


@query(with_(_DENSE_PAIRS) + """, g AS (SELECT s1_id, cand_id, s, CAST(substr(cand_id, 2, 1) AS INTEGER) AS src, max(s) OVER (PARTITION BY s1_id) AS best FROM dp)
    SELECT s1_id, cand_id, round(s, 6) AS q_dense, src AS q_cand_source, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY s DESC, cand_id) AS INTEGER) AS q_rank, CAST(row_number() OVER (PARTITION BY s1_id, src ORDER BY s DESC, cand_id) AS INTEGER) AS q_rank_src,
    round(best - s, 6) AS q_gap_best, round(max(s) OVER (PARTITION BY s1_id, src) - s, 6) AS q_gap_best_src, count(*) OVER (PARTITION BY s1_id) AS q_n_cands, count(*) FILTER (s >= best - 0.02::DOUBLE) OVER (PARTITION BY s1_id) AS q_n_close, round(avg(s) OVER (PARTITION BY s1_id), 6) AS q_mean_score FROM g""")
def q_dense_block(t):
    pairs = t.cands.filter("blk_dense").select("s1_id", "cand_id", F.col("bs_dense").alias("score"))
    return rounded(ft.dense_block(pairs), "q_dense", "q_gap_best", "q_gap_best_src", "q_mean_score")


@query(with_("rec", "tx AS (SELECT entity_id, coalesce(name_core, '') AS name, coalesce(addr_norm, '') AS addr, coalesce(postcode, '') AS postcode, coalesce(addr_numbers[1], '') AS number FROM rec)") + """SELECT c.s1_id, c.cand_id, CASE WHEN a.postcode <> '' AND b.postcode <> '' THEN CAST(a.postcode = b.postcode AS INTEGER) END AS q_postcode, CASE WHEN a.number <> '' AND b.number <> '' THEN CAST(a.number = b.number AS INTEGER) END AS q_number,
    CAST(b.addr = '' AS INTEGER) AS q_cand_addr_empty, CAST(regexp_matches(b.name, '[^\\x00-\\x7F]') AS INTEGER) AS q_cand_non_latin, round(length(b.name) / greatest(length(a.name), 1), 6) AS q_name_len_ratio FROM candidates_train c JOIN tx a ON a.entity_id = c.s1_id JOIN tx b ON b.entity_id = c.cand_id""")
def q_equalities(t):
    text = t.records.select("entity_id", F.col("name_core").alias("name"), F.col("addr_norm").alias("addr"), "postcode", F.get("addr_numbers", F.lit(0)).alias("number"))
    return rounded(ft.equalities(t.cands, text), "q_name_len_ratio")


@query()
def q_name_scores(t):
    return ft.name_scores(t.cands, t.records.select("entity_id", F.col("name_core").alias("name")))


@query()
def q_addr_scores(t):
    return ft.address_scores(t.cands, t.records.select("entity_id", F.col("addr_norm").alias("addr")))


@query(with_("rec") + """SELECT c.s1_id, c.cand_id, CASE WHEN a.addr_norm <> '' AND b.addr_norm <> '' THEN round(len(list_intersect(list_distinct(string_split(a.addr_norm, ' ')), list_distinct(string_split(b.addr_norm, ' '))))
    / len(list_distinct(list_concat(string_split(a.addr_norm, ' '), string_split(b.addr_norm, ' ')))), 6) END AS fa_words FROM candidates_train c JOIN rec a ON a.entity_id = c.s1_id JOIN rec b ON b.entity_id = c.cand_id""")
def q_addr_words(t):
    return rounded(ft.address_scores(t.cands, t.records.select("entity_id", F.col("addr_norm").alias("addr"))).select("s1_id", "cand_id", "fa_words"), "fa_words")
