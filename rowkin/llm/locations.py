"""Address records that denote the same location.

House numbers (with letter or addition) or landmarks, the street's own name and kind and the place are read from each address. Blocks are
the postcode and the neighbouring localities, that is towns whose names begin or end with the same sounds; inside a block a
deletion-neighbourhood index over the street names of one number proposes pairs of addresses. Each pair is decided by assigning the
components of one address to those of the other at the least total cost, with hard vetoes on number, addition and landmark, on
contradicting words in front of the street's name, on contradicting kinds of street and on contradicting states. Addresses linked form
buildings. An address without a town is then assigned to the building that costs least, if one does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rowkin.llm.addresses import heard, parse_columns, squeeze
from rowkin.llm.clusters import components, group_stream, hub_members
from rowkin.llm.scripts import romanise
from rowkin.session import cut, drop

_PARTS = "anchor string, prefix string, core string, kind string, town string, post string, state string"


@lru_cache(maxsize=1 << 17)
def _letters(word: str) -> int:
    """The set of the word's letters as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance with swapped neighbours as one edit, or most + 1 when greater."""
    if a == b:
        return 0
    # an edit adds and removes at most a letter each
    if abs(len(a) - len(b)) > most or (_letters(a) ^ _letters(b)).bit_count() > 2 * most:
        return most + 1
    # what both begin and end with takes no edit
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    if len(a) == len(b) == 2 and a == b[::-1]:
        return 1
    if most == 1:
        return 1 if len(a) == len(b) == 1 else 2
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1] if last[-1] <= most else most + 1


@lru_cache(maxsize=1 << 16)
def same_town(a: str, b: str) -> bool:
    """Whether two town names are spellings of one."""
    if a == b:
        return True
    most = 2 if min(len(a), len(b)) >= 6 else 1
    return edits(a, b, most) <= most or edits(heard(a), heard(b), most) <= most


@lru_cache(maxsize=1 << 12)
def same_state(a: str, b: str) -> bool:
    """Whether two states may be one: equal, one the short form of the other, or one unknown."""
    a, b = sorted((romanise(a), romanise(b)), key=len)
    if not a or a == b or a[0] != b[0]:
        return not a or a == b
    if len(a) > 3:
        return edits(heard(a), heard(b), 3) <= 3
    at = 0
    for c in a:
        at = b.find(c, at) + 1
        if not at:
            return False
    return True


def post_cost(a: str, b: str) -> int:
    """0 for the same postcode, 1 for a damaged one, 2 where one is unknown or the area agrees, 4 for another area."""
    if not a or not b:
        return 2
    a, b = a.lstrip("0"), b.lstrip("0")
    if a == b:
        return 0
    if sorted(a) == sorted(b) or edits(a, b, 1) <= 1:
        return 1
    return 2 if a[:-2] == b[:-2] else 4


#: Greatest total cost of an assignment of components.
MOST = 5.0
#: Sounds of a town's name that make a locality block.
TOWN_SOUNDS = 2
#: Sounds of a street's name that make a block of addresses without a town.
STREET_SOUNDS = 3


def _word_cost(a: str, b: str) -> float:
    """Cost of assigning one word to another: 0 equal, half heard alike, 1 for each typing error up to two in long words, else too much."""
    if a == b:
        return 0.0
    x, y = heard(romanise(a)), heard(romanise(b))
    if x == y:
        return 0.5
    e = min(edits(a, b, 2), edits(x, y, 2))
    return float(e) if e <= 1 and min(len(a), len(b)) >= 3 or e <= 2 and min(len(a), len(b)) >= 7 else 99.0


def assignment_cost(a: list[str], b: list[str], left_out: float) -> float:
    """Least total cost of assigning the words of ``a`` to those of ``b``, each at most once; a word without a partner costs ``left_out``.

    Equal words go together; the others, few, are assigned by dynamic programming over subsets.
    """
    rest = list(b)
    mine = []
    for w in a:
        if w in rest:
            rest.remove(w)
        else:
            mine.append(w)
    if not mine or not rest:
        return left_out * (len(mine) + len(rest))
    if len(mine) > 8 or len(rest) > 8:
        mine, rest = ["".join(mine)], ["".join(rest)]
    best = {0: 0.0}
    for w in mine:
        after: dict[int, float] = {}
        for used, cost in best.items():
            after[used] = min(after.get(used, 999.0), cost + left_out)
            for k, other in enumerate(rest):
                if not used >> k & 1:
                    c = cost + _word_cost(w, other)
                    if c < after.get(used | 1 << k, 999.0):
                        after[used | 1 << k] = c
        best = after
    return min(cost + left_out * (len(rest) - used.bit_count()) for used, cost in best.items())


@lru_cache(maxsize=1 << 16)
def street_cost(a: str, b: str) -> float:
    """Cost of assigning one street's words to another's, the words as they stand or written together."""
    return min(_word_cost(a.replace(" ", ""), b.replace(" ", "")), assignment_cost(a.split(" "), b.split(" "), 99.0))


@lru_cache(maxsize=1 << 16)
def town_cost(a: str, b: str) -> float:
    """0 for the same town, 1 for spellings of one, 4 for different towns, 2 where one is unknown."""
    if not a or not b:
        return 2.0
    return 0.0 if a == b else 1.0 if same_town(a, b) else 4.0


@lru_cache(maxsize=1 << 14)
def prefixes_differ(a: str, b: str) -> bool:
    """Whether the words in front of two streets' names contradict each other; a mere s is south or saint."""
    if not a or not b or a == b:
        return False
    p, q = ({x for w in words.split() for x in (("s", "south", "saint") if w == "s" else (w,))} for words in (a, b))
    return p.isdisjoint(q)


def address_cost(a: tuple, b: tuple) -> float:
    """Total cost of assigning the components of one address to those of another with the same number or landmark; more than MOST for a veto."""
    if prefixes_differ(a[0], b[0]) or a[2] and b[2] and a[2] != b[2]:
        return 99.0
    town = town_cost(a[3], b[3])
    cost = street_cost(a[1], b[1]) + town
    if cost > MOST or town > 1 and not same_state(a[5], b[5]):
        return 99.0
    post = min(post_cost(x, y) for x in a[4].split(" ") for y in b[4].split(" ")) if " " in a[4] or " " in b[4] else post_cost(a[4], b[4])
    if a[3] and b[3]:
        # towns that agree need no postcode; different ones need the very same
        return cost + (0 if cost < 4 else post and 99)
    return cost + (post if post < 4 else 99)


#: What ``parse_columns`` takes, in its order.
ADDRESS_COLUMNS = ("__address", "city", "state", "postcode", "landmark")


def address_text() -> Column:
    """The address as written, its normalised form where that is null or blank; chosen before records are moved."""
    return F.when(F.trim("business_address") != "", F.col("business_address")).otherwise(F.col("addr_norm"))


def parsed(records: DataFrame) -> DataFrame:
    """``entity_id, source`` and the address parts, one row per record (the delivery loaded last)."""
    newest = records.withColumn("__address", address_text()).groupBy("entity_id").agg(F.max(F.struct("loaded_at", "source", *ADDRESS_COLUMNS)).alias("v"))
    parse = pandas_udf(parse_columns, _PARTS)
    return newest.select("entity_id", F.col("v.source").alias("source"), parse(*[F.col(f"v.{c}") for c in ADDRESS_COLUMNS]).alias("p")).select("entity_id", "source", "p.*")


@lru_cache(maxsize=1 << 16)
def street_keys(core: str) -> tuple[str, ...]:
    """The street's words as one, as heard and with each letter left out."""
    word = romanise(core.replace(" ", ""))
    keys = {heard(word), squeeze(word)}
    if len(word) >= 4:
        keys.update(heard(word[:i] + word[i + 1 :]) for i in range(len(word)))
    return tuple(sorted(keys))


@lru_cache(maxsize=1 << 16)
def town_blocks(town: str) -> tuple[str, ...]:
    """Neighbouring localities: the sounds at the beginning and at the end of the town's name, and the set of its sounds."""
    word = heard(romanise(town.replace(" ", "")))
    sounds = "".join(c for i, c in enumerate(word) if i == 0 or c not in "aeiou")
    return (f"B:{sounds[:TOWN_SOUNDS]}", f"E:{sounds[-TOWN_SOUNDS:]}", f"S:{''.join(sorted(set(sounds)))}")


@lru_cache(maxsize=1 << 16)
def post_blocks(post: str) -> tuple[str, ...]:
    """For addresses without a town: the postcode's first three and last two digits, of which any one wrong, missing or swapped pair of digits leaves one."""
    post = post.lstrip("0")
    return ("H:" + post[:3], "E:" + post[-2:]) if post else ()


def _index_keys(core: pd.Series, town: pd.Series, post: pd.Series) -> pd.Series:
    """Keys of forms with a town: the postcode and the set of the town's sounds, each with every deletion of the street; the beginning and the
    end of the town with the street as heard. So an error in the street or in the town, or one in each if the postcode agrees, leaves a key."""
    out = []
    for c, t, posts in zip(core, town, post, strict=True):
        begins, ends, sounds = town_blocks(t)
        blocks = (sounds, *sorted({"P:" + p.lstrip("0") for p in posts.split(" ") if p}))
        streets = street_keys(c)
        plain = heard(romanise(c.replace(" ", "")))
        out.append([b + "/" + k for b in blocks for k in streets] + [begins + "/" + plain, ends + "/" + plain])
    return pd.Series(out)


@lru_cache(maxsize=1 << 16)
def street_ends(core: str) -> tuple[str, ...]:
    """The sounds at the beginning and at the end of the street's words as one."""
    word = heard(romanise(core.replace(" ", "")))
    sounds = "".join(c for i, c in enumerate(word) if i == 0 or c not in "aeiou")
    return (f"b:{sounds[:STREET_SOUNDS]}", f"e:{sounds[-STREET_SOUNDS:]}")


def _area_keys(core: pd.Series, post: pd.Series) -> pd.Series:
    """Postcode blocks times the street's ends; "?" of addresses without a postcode."""
    return pd.Series([[b + "/" + k for b in (post_blocks(p) or ("?",)) for k in street_ends(c)] for c, p in zip(core, post, strict=True)])


def _costs(*columns: pd.Series) -> pd.Series:
    n = len(columns) // 2
    return pd.Series([address_cost(r[:n], r[n:]) for r in zip(*columns, strict=True)], dtype="float64")


def with_costs(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """``(a, b, cost)`` of pairs of forms."""
    parts = ["prefix", "core", "kind", "town", "post", "state"]
    left, right = forms.select(F.col("form").alias("a"), *[F.col(c).alias(f"{c}_a") for c in parts]), forms.select(F.col("form").alias("b"), *[F.col(c).alias(f"{c}_b") for c in parts])
    cost = pandas_udf(_costs, "double").asNondeterministic()  # else a filter on the cost has it computed twice
    return pairs.join(left, "a").join(right, "b").select("a", "b", cost(*[f"{c}_a" for c in parts], *[f"{c}_b" for c in parts]).alias("cost"))


def block_links(spread: DataFrame, forms: DataFrame) -> DataFrame:
    """``(a, b)``: accepted pairs of forms that share a key of ``spread`` (``form, n, key``, read once), enough of them to join all that may be joined. Written once.

    In every key each form is compared with the key's most frequent form, each pair once for all keys. Those that fail are compared with
    all other forms of the key, from frequent to rare, but for those they are joined with already: joined forms need no further pair. A
    form without a kind of street or a word in front of it takes over that of the first form it is joined with, so it never joins two that contradict each other.
    """
    members = cut(hub_members(spread), "members")
    pairs = members.select(F.col("hub").alias("a"), F.col("form").alias("b")).distinct()
    good = cut(with_costs(pairs, forms).filter(F.col("cost") <= MOST).select("a", "b"), "good")
    marked = members.join(good.select(F.col("a").alias("hub"), F.col("b").alias("form"), F.lit(True).alias("near")), ["hub", "form"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    of_key = Window.partitionBy("key")
    several = marked.withColumn("size", F.count(F.lit(1)).over(of_key)).withColumn("all", F.bool_and("near").over(of_key)).filter("size > 1 and not all")
    parts = ["prefix", "core", "kind", "town", "post", "state"]
    hubs = forms.select(F.col("form").alias("hub"), F.col("prefix").alias("hub_prefix"), F.col("kind").alias("hub_kind"))
    rest = several.join(hubs, "hub").join(forms.select("form", *parts), "form").select("key", "form", "n", "near", "hub_prefix", "hub_kind", *parts)

    def refused(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        held = list(rows)
        address = [tuple(row[c] for c in parts) for row in held]
        # by group: its prefix and kind; group 0 are the forms that the most frequent one took in
        group, says = [0 if row["near"] else k for k, row in enumerate(held, 1)], {}
        for g, row in zip(group, held, strict=True):
            says.setdefault(g, [row["hub_prefix"], row["hub_kind"]] if not g else [row["prefix"], row["kind"]])
            says[g] = [x or row[c] for x, c in zip(says[g], ("prefix", "kind"), strict=True)]
        for i, row in enumerate(held):
            for j, other in enumerate(held):
                if row["near"] or i == j or group[i] == group[j] or not other["near"] and j > i:
                    continue
                (p, kind), (q, kind2) = says[group[i]], says[group[j]]
                if prefixes_differ(p, q) or kind and kind2 and kind != kind2 or address_cost(address[j], address[i]) > MOST:
                    continue
                yield other["form"], row["form"]
                keep, gone = sorted((group[i], group[j]))
                says[keep] = [x or y for x, y in zip(says[keep], says[gone], strict=True)]
                group = [keep if g == gone else g for g in group]

    more = group_stream(rest, ["key"], [F.desc("n"), "form"], refused, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long")
    links = cut(good.unionByName(more).distinct(), "links")
    drop(members, good)
    return links


def given_homes(loose: DataFrame, homes: DataFrame, forms: DataFrame) -> DataFrame:
    """``(form, building)`` of the addresses without a town that one building suits at less cost than all others. Written once.

    Blocks are the beginning and the end of the postcode; buildings of which no postcode is known are in a block of their
    own with all postcodes, and addresses without a postcode meet every building of their number and street. Buildings of one block that
    are alike in all that is compared count as one offer that suits several, so such a block stays small.
    """
    area = pandas_udf(_area_keys, "array<string>")
    near = homes.join(loose.select("anchor").distinct(), "anchor", "left_semi")
    posted = near.groupBy("building").agg(F.max(F.col("post") != "").alias("posted"))
    near = near.join(posted, "building")

    # a building's forms by each of their postcodes
    near = near.withColumn("post", F.explode(F.split("post", " ")))

    def keyed(df: DataFrame, post: Column, kind: str, *keep: str) -> DataFrame:
        return df.select("form", *keep, "anchor", F.explode(area("core", post)).alias("k")).select("form", *keep, F.xxhash64("anchor", F.lit(kind), "k").alias("key"))

    none, post = F.lit(""), F.col("post")
    wanted = keyed(loose.filter(post != ""), post, "post").unionByName(keyed(loose.filter(post != ""), none, "unposted")).unionByName(keyed(loose.filter(post == ""), none, "any"))
    wanted = cut(wanted, "loose")
    spread = keyed(near.filter(post != ""), post, "post", "building").unionByName(keyed(near.filter(~F.col("posted")), none, "unposted", "building")).unionByName(keyed(near, none, "any", "building"))
    spread = spread.join(wanted.select("key").distinct(), "key", "left_semi").join(forms.select("form", "prefix", "core", "kind", "state", "post"), "form")
    offers = spread.groupBy("key", "prefix", "core", "kind", "state", "post").agg(F.min("form").alias("b"), F.min("building").alias("first"), F.max("building").alias("last"))
    met = cut(wanted.join(offers, "key").select(F.col("form").alias("a"), "b", "first", "last").distinct(), "met")
    costs = with_costs(met.select("a", "b").distinct(), forms).filter(F.col("cost") <= MOST).join(met, ["a", "b"])
    least = costs.groupBy("a").agg(F.min("cost").alias("cost"))
    best = costs.join(least, ["a", "cost"]).groupBy("a").agg(F.min("first").alias("building"), F.max("last").alias("other"))
    given = cut(best.filter(F.col("building") == F.col("other")).select(F.col("a").alias("form"), "building"), "given")
    drop(wanted, met)
    return given


def buildings(addresses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(entity_id, building)`` of every record of ``addresses`` (as ``parsed``) whose address names a building or landmark and a street.

    With ``keep``, these columns too, and the records of no building with a null building.
    """
    # addresses alike in all but postcode and state are one form where they have a town, since towns that agree need neither
    named = addresses.filter("anchor <> '' and core <> ''").withColumn("form", F.xxhash64("anchor", "prefix", "core", "kind", "town", F.when(F.col("town") == "", F.concat_ws("|", "post", "state")).otherwise("")))
    parts = ["anchor", "prefix", "core", "kind", "town"]
    posts = F.array_join(F.array_sort(F.array_remove(F.collect_set("post"), "")), " ")
    forms = cut(named.groupBy("form", *parts).agg(F.count(F.lit(1)).alias("n"), posts.alias("post"), F.max("state").alias("state")), "forms")
    placed, loose = forms.filter("town <> ''"), forms.filter("town = ''")
    keys = pandas_udf(_index_keys, "array<string>")
    spread = placed.select("form", "n", "anchor", F.explode(keys("core", "town", "post")).alias("k")).select("form", "n", F.xxhash64("anchor", "k").alias("key"))
    labels = components(block_links(spread, forms))
    homes = cut(placed.join(labels, F.col("form") == F.col("node"), "left").select("form", "anchor", "core", "post", F.coalesce("label", "form").alias("building")), "homes")

    given = given_homes(loose, homes, forms)
    # the others stay together where their postcode is the same
    left = cut(loose.join(given, "form", "left_anti"), "left")
    area = pandas_udf(_area_keys, "array<string>")
    spread = left.filter("post <> ''").select("form", "n", "anchor", "post", F.explode(area("core", F.lit(""))).alias("k")).select("form", "n", F.xxhash64("anchor", "post", "k").alias("key"))
    names = components(block_links(spread, left))
    rest = left.join(names, F.col("form") == F.col("node"), "left").select("form", F.coalesce("label", "form").alias("building"))
    laid = homes.select("form", "building").unionByName(given).unionByName(rest)
    at = named.select("entity_id", *keep, "form").join(laid, "form").select("entity_id", *keep, "building")
    return at.unionByName(addresses.filter("not (anchor <> '' and core <> '')").select("entity_id", *keep, F.lit(None).cast("long").alias("building"))) if keep else at


def location_groups(records: DataFrame) -> DataFrame:
    """``(entity_id, building, n_links)``: the building of each record whose address names one, and how many other records it links to.

    The form of the result for buildings of many records, whose pairs are too many to list.
    """
    homes = cut(buildings(cut(parsed(records), "addresses")), "homes")
    sizes = homes.groupBy("building").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("representative"))
    return homes.join(sizes, "building").select("entity_id", "representative", (F.col("n") - 1).alias("n_links"))


def same_location(records: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: pairs of different records whose addresses name the same building, the smaller id first, each once.

    Null, empty and placeholder addresses and mere places name no building and give no pair; nor does a number without a street. Repeated
    deliveries of a record count once. Other columns are not read.
    """
    homes = cut(buildings(cut(parsed(records), "addresses")), "homes")
    left, right = homes.select("building", F.col("entity_id").alias("id_a")), homes.select("building", F.col("entity_id").alias("id_b"))
    return left.join(right, "building").filter("id_a < id_b").select("id_a", "id_b")
