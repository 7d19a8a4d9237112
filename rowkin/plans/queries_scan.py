"""Queries of scans, projections, filters, folds and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowkin.functions import text as tx
from rowkin.functions.similarity import normalised_edit_distance, similarity
from rowkin.operators import learning as ln
from rowkin.operators.common import cumulative, source_of
from rowkin.plans.tables import Tables, with_
from rowkin.sources import files

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


@query("SELECT split, source, count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids FROM records GROUP BY split, source")
def scan_union(t):
    # the table is stacked already: one scan; files.scan_union stacks the six raw files
    return t.raw("records").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_ids"))


@query("SELECT s1_id, cast(count(DISTINCT cand_id) AS INTEGER) AS n, string_agg(DISTINCT cand_id, ',' ORDER BY cand_id) AS matches FROM labels GROUP BY s1_id")
def scan_truth(t):
    lists = t.raw("labels").groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), " , ").alias("ids"))
    out = files.parse_id_lists(lists, "s1_id", "ids")
    return out.select("s1_id", F.size("matches").alias("n"), F.array_join("matches", ",").alias("matches"))


@query("SELECT entity_id, name_core FROM records WHERE split = 'train' AND source = 1 AND country = 'France' OR split = 'train' AND source = 1 AND country = 'Spain'")
def scan_parquet_pruned(t):
    return t.raw("records").filter((F.col("split") == "train") & (F.col("source") == 1) & F.col("country").isin("France", "Spain")).select("entity_id", "name_core")


@query(with_("rec") + "SELECT entity_id, business_name, business_address FROM rec WHERE entity_id IN (SELECT cand_id FROM candidates_train WHERE prune_rank = 0)")
def scan_by_ids(t):
    ids = t.cands.filter("prune_rank = 0").select(F.col("cand_id").alias("entity_id"))
    return files.scan_by_ids(t.records, ids).select("entity_id", "business_name", "business_address")


@query(with_("pr", "excl", "sel", "uni") + "SELECT CAST(row_number() OVER (ORDER BY u.s1_id) AS INTEGER) AS row_no, u.s1_id AS source1_entity_id, coalesce(m.l, '') AS matched_entity_ids FROM uni u LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS l FROM sel GROUP BY s1_id) m USING (s1_id)")
def sink_id_lists(t):
    from rowkin.operators.selection import select_threshold

    # the universe's file order; here the order of the ids
    universe = cumulative(t.universe.select("s1_id", F.lit(1).alias("one")), "s1_id", "one").select("s1_id", F.col("upto").cast("int").alias("row_no"))
    pool = t.records.filter("source in (2, 3)").select("entity_id")
    return files.id_list_frame(universe, select_threshold(t.preds, 0.5), pool)


# The checksum of ids (ASCII) from its definition
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS ct)"


def crc(key: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda c, b: xor(c // 256, ct[(xor(c, b) % 256) + 1])), 4294967295)"


@query(with_("uni", CRC_TABLE) + f"SELECT s1_id, n_true FROM (SELECT s1_id, n_true, {crc('s1_id')} AS h FROM uni, crc_table) WHERE h % 10000 < 2000")
def sample_crc32(t):
    return t.universe.filter(ln.in_sample("s1_id", 0.2)).select("s1_id", "n_true")


@query("SELECT split, source, count(*) FILTER (trim(business_name) <> '') AS n_name, count(*) FILTER (trim(business_address) <> '') AS n_addr FROM records GROUP BY split, source")
def filter_nonempty(t):
    return t.raw("records").groupBy("split", "source").agg(F.count_if(F.trim("business_name") != "").alias("n_name"), F.count_if(F.trim("business_address") != "").alias("n_addr"))


@query(r"""SELECT source, count(*) FILTER (regexp_matches(business_name, '^[0-9]')) AS leading_digit, count(*) FILTER (regexp_matches(business_name, '(?i)(^www\.|https?://|\.(com|net|org|test|example)\b)')) AS domain,
    count(*) FILTER (regexp_matches(business_address, '(?i)\b(bis|ter|quater)\b')) AS bis, count(*) FILTER (regexp_matches(business_address, '(^|[^0-9])[0-9]{5,6}([^0-9]|$)')) AS postcode FROM records GROUP BY source""")
def filter_regex(t):
    n, a = F.col("business_name"), F.col("business_address")
    return t.raw("records").groupBy("source").agg(
        F.count_if(n.rlike("^[0-9]")).alias("leading_digit"), F.count_if(n.rlike(r"(?i)(^www\.|https?://|\.(com|net|org|test|example)\b)")).alias("domain"), F.count_if(a.rlike(r"(?i)\b(bis|ter|quater)\b")).alias("bis"), F.count_if(a.rlike(r"(?<!\d)\d{5,6}(?!\d)")).alias("postcode")
    )


@query("SELECT TRY_CAST(substr(cand_id, 2, 1) AS TINYINT) AS source, CASE WHEN cand_id LIKE 'S2-%' THEN 's2' WHEN cand_id LIKE 'S3-%' THEN 's3' ELSE 'other' END AS kind, count(*) AS n FROM candidates_train GROUP BY ALL")
def derive_source(t):
    kind = F.when(F.col("cand_id").startswith("S2-"), "s2").when(F.col("cand_id").startswith("S3-"), "s3").otherwise("other")
    return t.cands.groupBy(source_of("cand_id").alias("source"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s1_id, cand_id, cand_source, blk_dense, blk_exact_name, blk_rare_token, blk_addr_key, blk_tfidf_name, blk_tfidf_full, blk_reverse, bs_dense, bs_exact_name, bs_rare_token, bs_addr_key, bs_tfidf_name, bs_tfidf_full, bs_reverse, prune_score, prune_rank FROM candidates_train")
def reorder_cols(t):
    from rowkin.operators.blocking import contract_columns

    return contract_columns(t.cands.select(*sorted(t.cands.columns)))


@query(with_("uni", CRC_TABLE) + f"SELECT s1_id, CAST((row_number() OVER (PARTITION BY stratum ORDER BY h, s1_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT s1_id, coalesce(country, '') || '_' || CAST(least(n_true, 3) AS VARCHAR) AS stratum, {crc('s1_id')} AS h FROM uni, crc_table)")
def folds_stratified(t):
    return ln.stratified_folds(t.universe)


@query(with_("uni") + "SELECT s1_id, CAST(CASE WHEN country IS NOT NULL THEN (SELECT count(DISTINCT v.country) FROM uni v WHERE v.country < u.country) END AS SMALLINT) AS loco_fold FROM uni u")
def folds_loco(t):
    return ln.loco_folds(t.universe)


@query("SELECT DISTINCT s1_id, cand_id, 1 AS label FROM labels")
def labels_explode(t):
    truth = t.raw("labels").groupBy("s1_id").agg(F.collect_list("cand_id").alias("matches"))
    return ln.explode_labels(truth)


@query(f"WITH {CRC_TABLE} SELECT s1_id, cand_id, CAST({crc('s1_id')} % 5 AS INTEGER) AS gfold FROM candidates_train, crc_table")
def group_kfold(t):
    return ln.group_folds(t.cands.select("s1_id", "cand_id"), 5)


@query(with_("rec") + "SELECT country, entity_id, business_name FROM rec QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5('42:' || entity_id), entity_id) <= 5")
def random_sample_n(t):
    return ln.sample_per_group(t.records.select("country", "entity_id", "business_name"), "country", "entity_id", 5)


@query("SELECT country, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT country FROM records WHERE country IS NOT NULL)")
def factorize(t):
    from pyspark.sql import Window

    lands = t.raw("records").select("country").filter("country is not null").distinct()
    return lands.select("country", (F.row_number().over(Window.orderBy("country")) - 1).alias("code"))  # one row per country


_LETTERS, _PLAIN, _SEVERAL = tx.latin_folds()
_FOLDED = "lower(business_name)"
for _k, _v in sorted(_SEVERAL.items()):
    _FOLDED = f"replace({_FOLDED}, '{_k}', '{_v}')"


@query(f"SELECT split, entity_id, translate({_FOLDED}, '{_LETTERS}', '{_PLAIN}') AS folded FROM (SELECT DISTINCT split, entity_id, business_name FROM records)")
def str_fold_latin(t):
    return t.raw("records").select("split", "entity_id", "business_name").distinct().select("split", "entity_id", tx.fold_latin("business_name").alias("folded"))


@query()
def str_basic_clean(t):
    return t.raw("records").select("split", "entity_id", "business_name").distinct().select("split", "entity_id", tx.basic_clean("business_name").alias("clean"))


# Scripts by code point, written apart from the operator's table: the blocks of 128 from 0900 on hold one script each, the rest is listed.
_SCRIPT = """CASE WHEN u BETWEEN 65 AND 90 OR u BETWEEN 97 AND 122 OR u BETWEEN 192 AND 591 OR u BETWEEN 7680 AND 7935 THEN 'LATIN'
    WHEN u // 128 BETWEEN 18 AND 31 THEN ['DEVANAGARI', 'BENGALI', 'GURMUKHI', 'GUJARATI', 'ORIYA', 'TAMIL', 'TELUGU', 'KANNADA', 'MALAYALAM', 'SINHALA', 'THAI', 'LAO', 'TIBETAN', 'TIBETAN'][u // 128 - 17]
    WHEN u BETWEEN 880 AND 1023 THEN 'GREEK' WHEN u BETWEEN 1024 AND 1279 THEN 'CYRILLIC' WHEN u BETWEEN 1328 AND 1423 THEN 'ARMENIAN' WHEN u BETWEEN 1424 AND 1535 THEN 'HEBREW' WHEN u BETWEEN 1536 AND 1791 THEN 'ARABIC'
    WHEN u BETWEEN 1792 AND 1871 THEN 'SYRIAC' WHEN u BETWEEN 1920 AND 1983 THEN 'THAANA' WHEN u BETWEEN 4096 AND 4255 THEN 'MYANMAR' WHEN u BETWEEN 4256 AND 4351 THEN 'GEORGIAN' WHEN u BETWEEN 4608 AND 4991 THEN 'ETHIOPIC'
    WHEN u BETWEEN 5024 AND 5119 THEN 'CHEROKEE' WHEN u BETWEEN 6016 AND 6143 THEN 'KHMER' WHEN u BETWEEN 6144 AND 6319 THEN 'MONGOLIAN' WHEN u BETWEEN 11568 AND 11647 THEN 'TIFINAGH' WHEN u BETWEEN 11904 AND 40959 THEN 'CJK'
    WHEN u BETWEEN 44032 AND 55215 THEN 'HANGUL' WHEN u BETWEEN 65280 AND 65519 THEN 'FULLWIDTH' END"""
_LETTERS = f"""chars AS (SELECT DISTINCT business_name AS name, regexp_extract_all(business_name, '(?s).') AS cs FROM records WHERE business_name IS NOT NULL),
    spread AS (SELECT name, i, unicode(cs[i]) AS u FROM (SELECT name, cs, unnest(range(1, len(cs) + 1)) AS i FROM chars)), scripted AS (SELECT name, i, {_SCRIPT} AS script FROM spread)"""
SCRIPT_OF = f"""{_LETTERS}, votes AS (SELECT name, script, count(*) AS n, min(i) AS first FROM scripted WHERE script IS NOT NULL GROUP BY name, script),
    led AS (SELECT name, arg_max(script, n * 100000 - first) AS script FROM votes GROUP BY name),
    script_of AS (SELECT r.split, r.entity_id, r.country, CASE WHEN trim(coalesce(business_name, '')) = '' THEN 'EMPTY' ELSE coalesce(led.script, 'OTHER') END AS script FROM records r LEFT JOIN led ON led.name = r.business_name)"""


@query(f"WITH {SCRIPT_OF} SELECT script, count(*) AS n FROM script_of GROUP BY script")
def script_dominant(t):
    return t.raw("records").groupBy(tx.dominant_script("business_name").alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LETTERS}, sets AS (SELECT name, string_agg(DISTINCT script, '+' ORDER BY script) AS scripts FROM scripted WHERE script <> 'LATIN' GROUP BY name)
    SELECT coalesce(scripts, '') AS scripts, count(*) AS n FROM records LEFT JOIN sets ON name = business_name WHERE business_name IS NOT NULL GROUP BY 1""")
def script_nonlatin(t):
    return t.raw("records").filter("business_name is not null").groupBy(F.array_join(tx.non_latin_scripts("business_name"), "+").alias("scripts")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) FILTER (NOT regexp_matches(business_name, '[^\\x00-\\x7F]')) AS n_ascii, count(*) FILTER (regexp_matches(business_name, '[^\\x00-\\x7F]')) AS n_other FROM records GROUP BY source")
def str_is_ascii(t):
    return t.raw("records").groupBy("source").agg(F.count_if(tx.is_ascii("business_name")).alias("n_ascii"), F.count_if(~tx.is_ascii("business_name")).alias("n_other"))


@query("SELECT split, entity_id, addr_norm, coalesce(list_filter(regexp_split_to_array(addr_norm, '[^0-9]+'), lambda x: length(x) IN (5, 6))[-1], '') AS found FROM (SELECT DISTINCT split, entity_id, addr_norm FROM records WHERE addr_norm IS NOT NULL)")
def re_postcode(t):
    return t.raw("records").filter("addr_norm is not null").select("split", "entity_id", "addr_norm").distinct().withColumn("found", tx.last_postcode("addr_norm"))


@query("SELECT split, entity_id, addr_norm, regexp_extract(addr_norm, '([0-9]+)', 1) AS found FROM (SELECT DISTINCT split, entity_id, addr_norm FROM records WHERE addr_norm IS NOT NULL)")
def re_first_number(t):
    return t.raw("records").filter("addr_norm is not null").select("split", "entity_id", "addr_norm").distinct().withColumn("found", F.regexp_extract("addr_norm", "([0-9]+)", 1))


@query(r"SELECT split, entity_id, trim(regexp_replace(business_address, '(?i)<\s*null\s*>|\bnull\b|\bn/a\b', '', 'g')) AS kept FROM (SELECT DISTINCT split, entity_id, business_address FROM records WHERE business_address IS NOT NULL)")
def re_null_placeholder(t):
    return t.raw("records").filter("business_address is not null").select("split", "entity_id", "business_address").distinct().select("split", "entity_id", tx.drop_placeholders("business_address").alias("kept"))


def _hits(column: str, patterns: dict[str, str]) -> str:
    return ", ".join(f"count(*) FILTER ({p.format(c=column)}) AS {k}" for k, p in patterns.items())


_E = r"[^\p{{L}}\p{{N}}_]"
NAME_SQL = {
    "leading_junk": rf"regexp_matches({{c}}, '^{_E}')", "leading_digit": r"regexp_matches({c}, '^\p{{Nd}}')", "domain": rf"regexp_matches({{c}}, '(?i)(www\.|https?:|\.(com|in|net|org|co|us|fr)({_E}|$))')",
    "dba": rf"regexp_matches({{c}}, '(?i)(^|{_E})dba({_E}|$)|trading as')", "single_token": r"NOT regexp_matches({c}, '\s')", "has_digit": r"regexp_matches({c}, '\p{{Nd}}')", "upper": "regexp_matches({c}, '[A-ZÀ-ÖØ-Þ]') AND NOT regexp_matches({c}, '[a-z]')",
    "legal_first": rf"regexp_matches({{c}}, '(?i)^{_E}*(m/s|s/s|msme|private|pvt|proprietorship|partnership|sasuru|sarl|eurl|sas|sasu|sca|scs|snc|sci|gmbh|incorporated|corporation|company|limited|plc|pte|pty|llc|inc|ltd|corp|llp|sp|sa|co|lp|ab|as|bv|nv|oy)({_E}|$)')",
    "zero_width": r"regexp_matches({c}, '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]')",
}
_MARK_SQL = {k: rf"regexp_matches({{c}}, '(?i)(^|{_E})({w})({_E}|$)')" for k, w in {"near": "near|nearby", "opposite": "opposite|opp", "behind": "behind", "beside": "beside|adjacent to|next to", "in_front": "(in )?front of", "across": "across (from|the street)", "esquina": "esquina|vista|frente", "corner": "corner", "rear": "rear|back of|backside"}.items()}
_ADDRESS_SQL = {
    "upper": NAME_SQL["upper"], "starts_number": r"regexp_matches({c}, '^\s*\p{{Nd}}')", "bis": rf"regexp_matches({{c}}, '(?i)(^|{_E})(bis|ter|quater)({_E}|$)')", "placeholder": rf"regexp_matches({{c}}, '(?i)<\s*null\s*>|(^|{_E})(null|n/a)({_E}|$)')",
    "landmark": "(" + " OR ".join(_MARK_SQL.values()) + ")", "zero_width": NAME_SQL["zero_width"],
}


@query(f"SELECT source, count(*) AS n_rows, {_hits('business_name', NAME_SQL)} FROM records WHERE business_name IS NOT NULL GROUP BY source")
def re_noise_flags(t):
    rows = t.raw("records").filter("business_name is not null")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in tx.noise_flags("business_name").items()])


@query(f"SELECT source, count(*) AS n_rows, {_hits('business_address', _ADDRESS_SQL)} FROM records WHERE business_address IS NOT NULL GROUP BY source")
def re_address_flags(t):
    rows = t.raw("records").filter("business_address is not null")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in tx.address_flags("business_address").items()])


@query(f"SELECT source, {_hits('business_address', _MARK_SQL)} FROM records WHERE business_address IS NOT NULL GROUP BY source")
def re_landmarks(t):
    rows = t.raw("records").filter("business_address is not null")
    return rows.groupBy("source").agg(*[F.count_if(c).alias(k) for k, c in tx.landmark_flags("business_address").items()])


@query(with_("rec") + r"SELECT entity_id, unnest(list_distinct(list_filter(regexp_split_to_array(trim(name_core), '\s+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^\p{Nd}+$')))) AS token FROM rec")
def tokenize_ws(t):
    return t.records.select("entity_id", F.explode(F.array_distinct(tx.name_tokens("name_core"))).alias("token"))


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(business_name), '[\p{L}\p{M}\p{N}]+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^\p{Nd}+$'))) AS token FROM records) GROUP BY token")
def tokenize_word(t):
    return t.raw("records").select(F.explode(tx.word_tokens("business_name")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(with_("rec") + r"SELECT entity_id, CAST(len(regexp_extract_all(name_norm, '\s+')) + 1 AS INTEGER) AS n_tokens, lower(regexp_extract(name_norm, '(\S+)', 1)) AS first_token, CAST(length(name_norm) AS INTEGER) AS n_chars FROM rec WHERE name_norm IS NOT NULL")
def tokens_count(t):
    return t.records.filter("name_norm is not null").select("entity_id", (F.regexp_count("name_norm", F.lit(r"\s+")) + 1).alias("n_tokens"), F.lower(F.regexp_extract("name_norm", r"(\S+)", 1)).alias("first_token"), F.length("name_norm").alias("n_chars"))


@query(with_("rec") + "SELECT entity_id, coalesce(addr_numbers[1], '') AS first_number, array_to_string(addr_numbers, ',') AS numbers FROM rec")
def list_functions(t):
    return t.records.select("entity_id", F.coalesce(F.get("addr_numbers", F.lit(0)), F.lit("")).alias("first_number"), F.array_join("addr_numbers", ",").alias("numbers"))


_PAIRS = with_("rec") + "SELECT c.s1_id, c.cand_id, a.name_core AS a, b.name_core AS b FROM candidates_train c JOIN rec a ON a.entity_id = c.s1_id JOIN rec b ON b.entity_id = c.cand_id"


def _named(t):
    r = t.records.select("entity_id", "name_core")
    return t.cands.select("s1_id", "cand_id").join(r.withColumnsRenamed({"entity_id": "s1_id", "name_core": "a"}), "s1_id").join(r.withColumnsRenamed({"entity_id": "cand_id", "name_core": "b"}), "cand_id")


# DuckDB's distances count bytes: the characters of each pair are numbered first, so every one is a byte
PLAIN = "array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: chr(CAST(32 + list_position(cs, c) AS INTEGER))), '')"
_CODED = f"SELECT s1_id, cand_id, {PLAIN.format(x='a')} AS a, {PLAIN.format(x='b')} AS b FROM (SELECT *, list_distinct(regexp_extract_all(a || b, '(?s).')) AS cs FROM ({_PAIRS}) WHERE a IS NOT NULL AND b IS NOT NULL)"


@query(f"SELECT s1_id, cand_id, round(jaro_winkler_similarity(a, b), 6) AS jw FROM ({_CODED}) WHERE a <> '' AND b <> ''")
def sim_jw(t):
    return _named(t).filter("a <> '' and b <> ''").select("s1_id", "cand_id", F.round(similarity("jaro_winkler", "a", "b"), 6).alias("jw"))


@query(f"SELECT s1_id, cand_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS ned FROM ({_CODED})")
def sim_ned(t):
    return _named(t).filter("a is not null and b is not null").select("s1_id", "cand_id", F.round(normalised_edit_distance("a", "b"), 6).alias("ned"))


@query()
def sim_ratio(t):
    return _named(t).select("s1_id", "cand_id", *[F.round(similarity(s, "a", "b"), 6).alias(s) for s in ("ratio", "token_sort", "token_set", "partial")])


@query()
def normalize_records(t):
    n, a = tx.normalise_name("business_name"), tx.normalise_address("business_address")
    return t.raw("records").select("split", "entity_id", *[c.alias(k) for k, c in n.items()], *[c.alias(k) for k, c in a.items()])


