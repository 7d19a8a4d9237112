"""Matching records of source 1 with records of other sources, by soft logic.

Candidate pairs come from several weak blocks: one building and sounds in common, one spelling group and a neighbouring locality with
the same number, one spelling group and a town, one spelling group alone. Every pair is a variable in [0, 1]. Weighted rules on likeness
of names, places and countries, exclusivity and transitivity become hinge losses; their sum is convex and is minimised by alternating
directions: the rules of one source-1 record form a block, the exclusivity of one candidate forms a block, and the two kinds of blocks
are solved in turn and brought to agree by dual variables, until they do. The value of a pair is its confidence.

    NAME & PLACE & COUNTRY -> MATCH  PULL * max(0, name + place + country - 2 - x)
    MATCH -> NAME                    CHECK * max(0, x - name), and the same for PLACE and COUNTRY
    ~MATCH                           PRIOR * x
    MATCH(a, b) & SAME(b, c) -> MATCH(a, c)    CHAIN * max(0, x_b - x_c), and the other way round
    a candidate has one match        ONLY * max(0, sum of x over its source-1 records - 1)
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rowkin.llm.addresses import parse_columns
from rowkin.llm.clusters import chunk_stream
from rowkin.llm.locations import _PARTS, ADDRESS_COLUMNS, address_text, buildings, post_cost, prefixes_differ, same_state, town_blocks, town_cost
from rowkin.llm.names import Name, code, jaro_winkler, name_score, name_tokens, reader, trades_fit, words_score
from rowkin.llm.spellings import generic_words, token_groups
from rowkin.session import cut, drop

PULL, CHECK, PRIOR, CHAIN, ONLY = 2.0, 1.5, 0.1, 3.0, 4.0
#: Step of the alternating directions; they end when no value moves and the sides differ by less than CLOSE, or after so many rounds.
RHO, CLOSE, ROUNDS = 3.0, 0.005, 60
#: Least confidence of a reported match; two source-1 records that share a candidate evenly stay below it.
CONFIDENT = 0.52
# Names and codes of one country.
COUNTRIES = "us: usa, united states, united states of america, america; in: ind, india, bharat; fr: fra, france; de: deu, germany, deutschland; es: esp, spain, espana, españa; ie: irl, ireland, eire; be: bel, belgium, belgique; at: aut, austria, osterreich, österreich; mx: mex, mexico, méxico; ke: ken, kenya; gb: gbr, uk, united kingdom, great britain; ca: can, canada; ch: che, switzerland, schweiz; it: ita, italy, italia; pt: prt, portugal; nl: nld, netherlands"


def country_code(column: Column) -> Column:
    """One label per country for its names and codes; other labels in lower case, null where there is none."""
    pairs = [(form.strip(), part.split(":")[0].strip()) for part in COUNTRIES.split(";") for form in part.split(":")[1].split(",")]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    label = F.trim(F.lower(column.cast("string")))
    return F.when(label != "", F.coalesce(F.element_at(table, label), label))


def hinge_step(v: np.ndarray, name: np.ndarray, place: np.ndarray, country: np.ndarray, rho: float) -> np.ndarray:
    """argmin over x in [0, 1] of the pair's own rules + rho/2 (x - v)^2; the losses are piecewise linear, so the best of the pieces' own minima and the kinks."""
    all_three = name + place + country - 2
    points = [all_three, name, place, country, np.zeros_like(v), np.ones_like(v)]
    for pull in (0.0, PULL):
        for k in range(4):
            points.append(v - (PRIOR + k * CHECK - pull) / rho)
    x = np.clip(np.stack(points), 0, 1)
    cost = PULL * np.maximum(0, all_three - x) + PRIOR * x + rho / 2 * (x - v) ** 2
    for limit in (name, place, country):
        cost += CHECK * np.maximum(0, x - limit)
    return np.take_along_axis(x, cost.argmin(axis=0)[None], axis=0)[0]


def solve_blocks(v: np.ndarray, name: np.ndarray, place: np.ndarray, country: np.ndarray, group: np.ndarray, rho: float, sweeps: int = 40) -> np.ndarray:
    """The blocks of many source-1 records at once: the pairs' own rules, and transitivity among the pairs of one ``group`` (0, 1, ...: the
    candidates of one record that share spelling group and building).

    Inner alternating directions between the pairs' own step and the groups' step, which pulls each value towards its group's mean by at
    most the chain rules' weight. Groups are independent, so those at rest don't hold the others up.
    """
    size = np.bincount(group)
    many = size[group] > 1
    x = hinge_step(v, name, place, country, rho)
    if not many.any():
        return x
    # pairs alone in their group are done
    k = np.flatnonzero(many)
    v, name, place, country = v[k], name[k], place[k], country[k]
    _, group = np.unique(group[k], return_inverse=True)
    size = np.bincount(group)
    y, u = x[k].copy(), np.zeros(len(k))
    shift = CHAIN * (size[group] - 1) / size[group] / rho
    for _ in range(sweeps):
        own = hinge_step((v + y - u) / 2, name, place, country, 2 * rho)
        y = own + u
        mean = np.bincount(group, y)[group] / size[group]
        y = mean + np.sign(y - mean) * np.maximum(0, np.abs(y - mean) - shift)
        moved = np.abs(own - y).max(initial=0.0)
        u = u + own - y
        if moved < 1e-6:
            break
    x[k] = np.clip(y, 0, 1)
    return x


def sound_windows(words: tuple[str, ...]) -> list[str]:
    """Every three sounds in a row of a name's words, shorter words as a whole, and the words' first three letters."""
    out = set()
    for word in words:
        c = code(word)
        out.add("^" + word[:3])
        out.update(c[i : i + 3] for i in range(max(1, len(c) - 2)))
    return sorted(out)


def read_records(records: DataFrame) -> DataFrame:
    """``entity_id, source, tokens, country`` and the address parts, one row per record (the delivery loaded last); the tokens are the words of business_name, or of name_core where that is null or blank."""
    name = F.when(F.trim("business_name") != "", F.col("business_name")).otherwise(F.coalesce("name_core", F.lit("")))
    chosen = records.withColumn("__address", address_text()).withColumn("__name", name)
    newest = chosen.groupBy("entity_id").agg(F.max(F.struct("loaded_at", "source", "__name", "country", *ADDRESS_COLUMNS)).alias("v"))
    parse = pandas_udf(parse_columns, _PARTS)

    def split(names: pd.Series) -> pd.Series:
        return pd.Series([" ".join(name_tokens(n)) for n in names])

    split.__annotations__ = {"names": pd.Series, "return": pd.Series}
    parts = newest.select("entity_id", F.col("v.source").alias("source"), pandas_udf(split, "string")("v.__name").alias("tokens"), country_code(F.col("v.country")).alias("country"), parse(*[F.col(f"v.{c}") for c in ADDRESS_COLUMNS]).alias("p"))
    return parts.select("entity_id", "source", "tokens", "country", "p.*")


def once(fn):  # noqa: ANN001, ANN201
    """A function of columns to doubles that a filter on its result does not have computed a second time."""
    return pandas_udf(fn, "double").asNondeterministic()


def country_fit(a: str, b: str) -> Column:
    """1 for the same country, a little less where one is unknown, little for different ones."""
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.98)).otherwise(F.lit(0.3))


def nearness(*columns: pd.Series) -> pd.Series:
    """How likely two addresses of one number that are not known to be one building are one nevertheless: by their streets' likeness, if towns or postcodes agree."""
    out = []
    n = len(columns) // 2
    for row in zip(*columns, strict=True):
        (prefix, core, kind, town, post, state), (prefix2, core2, kind2, town2, post2, state2) = row[:n], row[n:]
        place = 0.0
        towns, posts = town_cost(town, town2), post_cost(post, post2)
        if (towns <= 1 or posts == 0 or towns == 2 and posts <= 1) and (towns <= 1 or same_state(state, state2)) and not prefixes_differ(prefix, prefix2):
            likeness = jaro_winkler(core.replace(" ", ""), core2.replace(" ", ""))
            if likeness >= 0.8:
                place = likeness - 0.1 * bool(kind and kind2 and kind != kind2) - 0.05 * (towns > 0)
        out.append(place)
    return pd.Series(out, dtype="float64")


def _place_keys(town: pd.Series, post: pd.Series) -> pd.Series:
    return pd.Series([[*(town_blocks(t) if t else ()), *(("P:" + p.lstrip("0"),) if p else ())] for t, p in zip(town, post, strict=True)])


def candidate_pairs(read: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, name, place, country, same)``: likenesses of the pairs that the blocks propose, in [0, 1].

    In one building ``place`` is 1. Of one spelling group and number in a neighbouring locality it is the streets' likeness, asked where no
    source-1 record of the group is in the candidate's building. A candidate whose address names no building has the share of each source-1 record of its spelling group that its town and postcode suit.
    """
    tokens = cut(read.filter("tokens <> ''").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")), "tokens")
    known_words = generic_words(tokens)
    groups = token_groups(tokens, known_words).select(F.xxhash64("tokens").alias("token_id"), "group")
    parts = ["prefix", "core", "kind", "town", "post", "state"]
    # what every block needs of a record, in short; names and address parts are looked up for the few records a block asks them of, among those of their kind
    short = read.withColumn("token_id", F.xxhash64("tokens")).withColumn("has_anchor", F.col("anchor") != "")
    known = cut(buildings(short, ("source", "country", "token_id", "has_anchor")).join(groups, "token_id", "left"), "known")
    first, others = known.filter("source = 1"), known.filter("source <> 1")
    wide = read.select("entity_id", "source", "anchor", *parts)

    def windows(names: pd.Series) -> pd.Series:
        read_ = reader(*known_words)
        return pd.Series([sound_windows(read_.read_tokens(n.split(" ")).words) for n in names])

    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        read_ = reader(*known_words)
        return pd.Series([name_likeness(read_.read_tokens(x.split(" ")), read_.read_tokens(y.split(" "))) for x, y in zip(a, b, strict=True)], dtype="float64")

    windows.__annotations__ = {"names": pd.Series, "return": pd.Series}
    likeness.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}

    # one building: one spelling group, or three sounds in a row in common
    left = first.filter("building is not null").select("building", "group", "country", F.col("entity_id").alias("s1_id"))
    right = others.filter("building is not null").select("building", "group", F.col("country").alias("c2"), F.col("entity_id").alias("cand_id"))
    one = F.lit(1.0)
    equal = left.join(right, ["building", "group"]).select("s1_id", "cand_id", one.alias("name"), one.alias("place"), country_fit("country", "c2").alias("country"), F.xxhash64("group", "building").alias("same"))
    # names of other groups: only buildings with more than one are spread over sounds, name by name and not record by record
    named = known.filter("building is not null").withColumn("g", F.coalesce("group", F.xxhash64("entity_id")))
    several = named.groupBy("building").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.min("source").alias("s"), F.max("source").alias("t")).filter("x <> y and s = 1 and t > 1").select("building")
    mixed = cut(named.join(several, "building", "left_semi").filter("token_id is not null").select("building", "entity_id", "source", "country", "token_id", "g"), "mixed")
    texts = tokens.select(F.xxhash64("tokens").alias("token_id"), "tokens")
    spoken = mixed.select("token_id").distinct().join(texts, "token_id")
    voices = spoken.select("token_id", F.explode(F.transform(pandas_udf(windows, "array<string>")("tokens"), lambda x: F.xxhash64(x))).alias("sound"))
    heard_in = mixed.select("building", "token_id", "g", (F.col("source") == 1).alias("first")).distinct().join(voices, "token_id")
    heard_in = cut(heard_in, "sounds")
    a = heard_in.filter("first").select("building", "sound", F.col("token_id").alias("n1"), F.col("g").alias("g1"))
    b = heard_in.filter("not first").select("building", "sound", F.col("token_id").alias("n2"), F.col("g").alias("g2"))
    near = a.join(b, ["building", "sound"]).filter("g1 <> g2").select("building", "n1", "n2").distinct()
    asked = near.select("n1", "n2").distinct().join(texts.select(F.col("token_id").alias("n1"), F.col("tokens").alias("x")), "n1").join(texts.select(F.col("token_id").alias("n2"), F.col("tokens").alias("y")), "n2")
    alike = asked.withColumn("like", once(likeness)("x", "y")).filter("like > 0").select("n1", "n2", "like")
    mine = mixed.filter("source = 1").select("building", F.col("token_id").alias("n1"), F.col("entity_id").alias("s1_id"), "country")
    theirs = mixed.filter("source <> 1").select("building", F.col("token_id").alias("n2"), F.col("entity_id").alias("cand_id"), F.col("country").alias("c2"), "g")
    unlike = near.join(alike, ["n1", "n2"]).join(mine, ["building", "n1"]).join(theirs, ["building", "n2"])
    unlike = unlike.select("s1_id", "cand_id", F.col("like").alias("name"), one.alias("place"), country_fit("country", "c2").alias("country"), F.xxhash64("g", "building").alias("same"))

    # one spelling group and number, neighbouring localities, not one building: for candidates whose building holds no source-1 record of their group
    keys = pandas_udf(_place_keys, "array<string>")
    open_ = others.filter("has_anchor and group is not null").join(left.select("building", "group").distinct(), ["building", "group"], "left_anti")
    open_ = open_.join(first.filter("has_anchor").select("group").distinct(), "group", "left_semi").select("group", "country", "entity_id").join(wide.filter("source <> 1 and anchor <> ''"), "entity_id")
    open_ = cut(open_.select("group", "anchor", F.col("country").alias("c2"), F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"{c}_b") for c in parts]), "open")
    whose = first.filter("has_anchor").join(open_.select("group").distinct(), "group", "left_semi").select("group", "country", "entity_id").join(wide.filter("source = 1 and anchor <> ''"), "entity_id")
    whose = whose.join(open_.select("group", "anchor").distinct(), ["group", "anchor"], "left_semi")
    a = whose.select("group", "anchor", "country", F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"{c}_a") for c in parts], F.explode(keys("town", "post")).alias("key"))
    b = open_.withColumn("key", F.explode(keys("town_b", "post_b")))
    apart = a.join(b, ["group", "anchor", "key"]).drop("key").distinct()
    apart = apart.withColumn("place", once(nearness)(*[f"{c}_a" for c in parts], *[f"{c}_b" for c in parts])).filter("place > 0")
    apart = apart.select("s1_id", "cand_id", one.alias("name"), "place", country_fit("country", "c2").alias("country"), F.xxhash64("cand_id").alias("same"))
    # written one by one, so none of the plans is large
    parts_ = [cut(part, "found") for part in (equal, unlike, apart, homeless_pairs(first, others, wide, keys))]
    drop(tokens, known, mixed, heard_in, open_)
    return reduce(DataFrame.unionByName, parts_)


def homeless_pairs(first: DataFrame, others: DataFrame, wide: DataFrame, keys) -> DataFrame:  # noqa: ANN001
    """Pairs of candidates whose address names no building with the source-1 records of their spelling group.

    Candidates alike in group, town, postcode, state and country are one profile; each profile meets the source-1 records of its group in
    neighbouring localities, or where it has no town all of them, postcode by postcode with the number of records that have it.

    Every record met counts in the total, whatever its own share. No other block proposes these candidates and none of their pairs has a
    partner in transitivity, so a pair's value never exceeds its share: pairs with a share under a half stay below CONFIDENT and are not listed.
    """
    profile = ["group", "town", "post", "state", "country"]
    homeless = others.filter("building is null and not has_anchor and group is not null").join(first.select("group").distinct(), "group", "left_semi")
    homeless = cut(homeless.join(wide.filter("source <> 1 and anchor = ''").select("entity_id", "town", "post", "state"), "entity_id").select("entity_id", *profile), "homeless")
    profiles = homeless.select(*profile).distinct().withColumn("profile", F.xxhash64(*[F.coalesce(c, F.lit("?")) if c != "group" else F.col(c) for c in profile]))
    owners = first.join(profiles.select("group").distinct(), "group", "left_semi").select("group", "entity_id", "country").join(wide.filter("source = 1"), "entity_id")
    owners = cut(owners.select("group", F.col("entity_id").alias("s1_id"), F.col("town").alias("t1"), F.col("post").alias("p1"), F.col("state").alias("st1"), F.col("country").alias("c1")), "owners")
    placed = profiles.filter("town <> ''").withColumn("key", F.explode(keys("town", F.lit(""))))
    near = placed.join(owners.filter("t1 <> ''").withColumn("key", F.explode(keys("t1", F.lit("")))), ["group", "key"]).drop("key").distinct()
    townless = placed.drop("key").distinct().join(owners.filter("t1 = ''"), "group")
    met = near.unionByName(townless)

    def weight(town: pd.Series, post: pd.Series, state: pd.Series, t1: pd.Series, p1: pd.Series, st1: pd.Series) -> pd.Series:
        out = []
        for t, p, s, t2, p2, s2 in zip(town, post, state, t1, p1, st1, strict=True):
            towns, posts = town_cost(t, t2), post_cost(p, p2)
            out.append(0.0 if towns > 2 or towns == 2 and t and not same_state(s, s2) else (4.0 if p and posts == 0 else 2.0 if posts == 1 else 1.0 if posts == 2 else 0.5))
        return pd.Series(out, dtype="float64")

    weight.__annotations__ = {c: pd.Series for c in ("town", "post", "state", "t1", "p1", "st1", "return")}
    weighed = met.withColumn("w", once(weight)("town", "post", "state", "t1", "p1", "st1")).filter("w > 0")
    total = weighed.groupBy("profile").agg(F.sum("w").alias("total"))
    shares = weighed.join(total, "profile").withColumn("place", F.col("w") / F.col("total")).filter("place >= 0.5").select("profile", "s1_id", "c1", "place")
    # without a town only the postcode tells source-1 records apart: those of one postcode have one weight
    spots = owners.groupBy("group", "p1").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit("")
    asked = cut(profiles.filter("town = ''").select("profile", "group", "post").join(spots, "group").withColumn("w", once(weight)(none, "post", none, none, "p1", none)), "asked")
    sums = asked.groupBy("profile").agg(F.sum(F.col("w") * F.col("n")).alias("total"))
    placeless = asked.join(sums, "profile").withColumn("place", F.col("w") / F.col("total")).filter("place >= 0.5").join(owners, ["group", "p1"])
    shares = shares.unionByName(placeless.select("profile", "s1_id", "c1", "place"))
    mine = homeless.withColumn("profile", F.xxhash64(*[F.coalesce(c, F.lit("?")) if c != "group" else F.col(c) for c in profile]))
    pairs = mine.join(shares, "profile")
    return pairs.select("s1_id", F.col("entity_id").alias("cand_id"), F.lit(1.0).alias("name"), "place", country_fit("country", "c1").alias("country"), F.xxhash64("entity_id").alias("same"))


def name_likeness(p: Name, q: Name) -> float:
    """How alike two names are; names that first name, trade or a lost word keep apart still have some likeness where their words are near."""
    score = name_score(p, q)
    if score >= 0.9 or not p.words or not q.words:
        return score
    words = words_score(p.words, q.words, p.foreign != q.foreign)
    if words > 0:
        return max(score, 0.6 * words)
    x, y = "".join(sorted(p.words)), "".join(sorted(q.words))
    near = max(jaro_winkler(x, y), jaro_winkler("".join(p.words), "".join(q.words)), jaro_winkler(code("".join(p.words)), code("".join(q.words))))
    one = any(len(w) >= 5 and w in q.words for w in p.words)
    if near >= 0.86 or one and near >= 0.7:
        return max(score, 0.55)
    return max(score, 0.0 if near < 0.75 else 0.54 if trades_fit(p.trades, q.trades) else 0.4)


_PAIR_DDL = "s1_id string, cand_id string, name double, place double, country double, same long, x double, z double, u double, rivals long"
_COLUMNS = ["s1_id", "cand_id", "name", "place", "country", "same", "x", "z", "u", "rivals"]


def _solve(pairs: pa.Table) -> pa.Table:
    """New ``x`` of the pairs of whole source-1 blocks."""
    pdf = pairs.to_pandas()
    name, place, country, z, u = (pdf[c].to_numpy(float) for c in ("name", "place", "country", "z", "u"))
    group = pdf.groupby(["s1_id", "same"], sort=False).ngroup().to_numpy()
    # a candidate without rivals is never bound by exclusivity: its pair starts at what its own rules ask for
    target = np.where(pdf["rivals"].to_numpy() > 1, z - u, np.clip(name + place + country - 2, 0, 1))
    x = solve_blocks(target, name, place, country, group, RHO)
    return pairs.set_column(pairs.schema.get_field_index("x"), "x", pa.array(x))


def _other_side(pairs: DataFrame) -> DataFrame:
    """Exclusivity of each candidate in closed form: nothing where the sum is at most 1, else an equal shift, at most ONLY / RHO."""
    rivals = Window.partitionBy("cand_id")
    shift = F.least(F.lit(ONLY / RHO), F.greatest(F.lit(0.0), (F.sum("v").over(rivals) - 1) / F.count(F.lit(1)).over(rivals)))
    moved = pairs.withColumn("v", F.col("x") + F.col("u")).withColumn("before", F.col("z")).withColumn("z", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") - shift)))
    return moved.withColumn("u", F.col("u") + F.col("x") - F.col("z")).drop("v")


def soft_matches(pairs: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, confidence)`` of candidate pairs, by alternating directions.

    A pair proposed by several blocks counts once, with its greatest likeness. Source-1 records none of whose candidates has a rival are
    solved at once; the others in rounds, until the two sides agree and nothing moves.
    """
    pairs = pairs.repartition("cand_id").groupBy("s1_id", "cand_id").agg(F.max(F.struct(F.col("name") + F.col("place"), "name", "place", "country", "same")).alias("m")).select("s1_id", "cand_id", "m.name", "m.place", "m.country", "m.same")
    count = F.count(F.lit(1)).over(Window.partitionBy("cand_id"))
    wish = F.greatest(F.lit(0.0), F.col("name") + F.col("place") + F.col("country") - 2)
    begun = pairs.select("s1_id", "cand_id", "name", "place", "country", "same", F.lit(0.0).alias("x"), wish.alias("z"), F.lit(0.0).alias("u"), count.alias("rivals"))

    def first_side(df: DataFrame) -> DataFrame:
        return chunk_stream(df.select(*_COLUMNS), "s1_id", _solve, _PAIR_DDL)

    solved = cut(first_side(begun), "solved")
    coupled = solved.filter("rivals > 1").select("s1_id").distinct()
    free = solved.join(coupled, "s1_id", "left_anti").select("s1_id", "cand_id", F.col("x").alias("confidence"))
    tied = cut(solved.join(coupled, "s1_id", "left_semi"), "tied")
    for _ in range(ROUNDS):
        moved = cut(_other_side(tied), "tied")
        apart = moved.agg(F.max(F.greatest(F.abs(F.col("x") - F.col("z")), F.abs(F.col("z") - F.col("before"))))).first()[0]
        tied = moved
        if apart is None or apart < CLOSE:
            break
        tied = first_side(moved)
    return free.unionByName(tied.select("s1_id", "cand_id", F.least("x", "z").alias("confidence")))


def linked_records(records: DataFrame) -> DataFrame:
    """``(s1_id, cand_id, confidence)`` of the candidate pairs of one split's records.

    Null or empty names match nothing by name, null and placeholder addresses name no place, an unknown country fits any. Repeated
    deliveries count once. Ties between source-1 records equally near a candidate share its confidence. Columns not named here are not read.
    """
    read = cut(read_records(records), "read")
    pairs = candidate_pairs(read)
    drop(read)
    return soft_matches(pairs)
