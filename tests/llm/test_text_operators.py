"""Terms, characters, samples, encodings, leakage and abuse on small fixtures and against brute force."""

import base64
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("rowkin.llm")

from rowkin.llm import bpe_encode as bpe  # noqa: E402
from rowkin.llm.abuse import abuse_scores, abusive_documents, grammar, source_rates  # noqa: E402
from rowkin.llm.burst_trie import BurstTrie, marked_terms, term_counts  # noqa: E402
from rowkin.llm.leakage import leaked_items  # noqa: E402
from rowkin.llm.stable_sample import block_sample  # noqa: E402
from rowkin.llm.unicode_repair import odd_values, repair_values  # noqa: E402


def test_trie_against_counter():
    random.seed(1)
    trie, want = BurstTrie(burst=4), Counter()
    for _ in range(3000):
        term = "".join(random.choice("abé") for _ in range(random.randrange(1, 9)))
        n = random.randrange(1, 4)
        trie.add(term, n, 1)
        want[term] += n
    assert {t: o for t, o, _ in trie.items()} == dict(want)
    assert trie.size == len(want)
    cut = {p + s: o for p, ss, os_, _ in trie.subtrees(2) for s, o in zip(ss, os_, strict=True)}
    assert cut == dict(want)


def test_terms_against_counter(spark):
    random.seed(2)
    texts = [" ".join(random.choice(["a", "ab", "abc", "abcd", "abcdefgh" * 40, "x", ""]) for _ in range(random.randrange(6))) for _ in range(200)] + [None, "", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("term", F.lit("clash")).repartition(5)
    occ, rec = Counter(), Counter()
    for t in texts:
        pieces = [x for x in (t or "").split(" ") if x]
        occ.update(pieces)
        rec.update(set(pieces))
    got = term_counts(df, ["t"]).collect()
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == {k: (occ[k], rec[k]) for k in occ}
    assert term_counts(df.limit(0), ["t"]).count() == 0


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "split string, entity_id string, loaded_at int, name_core string, addr_norm string")


def test_marks_count_records_once(spark):
    rows = [("a", f"e{i}", 1, "co " + ("one" if i == 0 else "two"), None) for i in range(30)] + [("a", "e0", 2, "co one", None), ("b", "e0", 1, "co two", "")]
    got = {r["term"]: (r["records"], r["mark"]) for r in marked_terms(deliveries(spark, rows)).collect()}
    assert got == {"co": (31, "common"), "one": (1, "rare"), "two": (30, "common")}
    assert marked_terms(deliveries(spark, [])).count() == 0


ODD = ["Ａcme", "café", "Ac​me", "Acme Co", "Аcme", "Ac­mе", "ɑcme", "ﬁrm", "ᎪCME", "आ​प", "Acme﻿"]
USUAL = ["Acme", "café", "1º piso", "Кафе Acme", "商店", "सेपोदेस्‍ मेडिकल्स", "ಕ್‌ಷ", "Ψωμί", "straße", "naïve – “ok”", ""]


def test_odd_values(spark):
    rows = [(i, v, None) for i, v in enumerate(ODD + USUAL)] + [(99, None, "x")]
    df = spark.createDataFrame(rows, "id int, n string, a string").withColumn("value", F.lit(1)).withColumn("word", F.lit("w"))
    assert {r["id"] for r in odd_values(df, ["id"], ["n", "a"]).collect()} == set(range(len(ODD)))
    assert odd_values(df.limit(0), ["id"], ["n", "a"]).count() == 0
    assert odd_values(df.unionByName(df), ["id"], ["n", "a"]).count() == len(ODD)


def test_substitution_needs_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "Аcme Foods"), (2, "acme foods"), (3, "Аzzz Foods"), (4, "Ａ​b" + "x" * 20000)], "id int, n string")
    got = {r["id"]: r for r in repair_values(df, ["id"], ["n"]).collect()}
    assert (got[1]["repaired"], got[1]["substituted_tokens"]) == ("Acme Foods", 1)
    assert (got[3]["repaired"], got[3]["mixed_tokens"], got[3]["substituted_tokens"], got[3]["likely_tokens"]) == ("Аzzz Foods", 1, 0, 0)
    assert got[4]["repaired"] == "Ab" + "x" * 20000
    assert set(got) == {1, 3, 4}


def test_sample_is_stable(spark):
    ids = [f"S1-{i:09d}" for i in range(0, 6400)] + [None, "", "odd-id"]
    df = spark.createDataFrame([(i, 1) for i in ids], "s1_id string, position int")
    full = {r["s1_id"] for r in block_sample(df, "s1_id").collect()}
    assert sum(1 for i in full if i.startswith("S1-")) == 6400 // 64 * 8
    half = df.filter("s1_id < 'S1-000003000' or s1_id is null")
    part = {r["s1_id"] for r in block_sample(half.unionByName(half).repartition(9), "s1_id").collect()}
    assert part == {i for i in full if i < "S1-000003000"}
    assert block_sample(df.limit(0), "s1_id").count() == 0
    per_block = block_sample(df.filter("s1_id like 'S1-%'"), "s1_id").groupBy("block_no").count().collect()
    assert {r["count"] for r in per_block} == {8}


needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)), reason="no vocabulary files")


@needs_vocabulary
def test_encoding_against_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
    random.seed(4)
    texts = ["".join(random.choice("aábc thing ing's  \n\t1234 <|endoftext|>😡ह") for _ in range(random.randrange(80))) for _ in range(300)]
    texts += ["x" * 5000, "ab" * 3000, "á" * 50, " ", "\n\n", "don't  stop"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(df, "text", ["doc_id"]).collect()}
    assert got[-1] == got[-2] == []
    for i, t in enumerate(texts):
        assert got[i] == other.encode_ordinary(t), t[:40]
    assert bpe.encode_column(df.limit(0), "text", ["doc_id"]).count() == 0


def story(town, name, number):
    return [
        f"The inn at {town} had {number} rooms, a green staircase and no wool, as {name} Karu soon learned.", f"The baker in {town} refused plums after {name} found {number + 1} pebbles in a sack.",
        f"Since the flood {name} measures the river at {town} with {number + 2} knots on a rope.", f"A clerk copied the name {name} {number + 3} times until the ink from {town} ran dry.",
    ]


def test_leakage(spark):
    lead = "Read the story below and answer the question. "
    people = [("Alpha", "Bodo", 11), ("Gamma", "Dede", 51), ("Ypsi", "Zeta", 91), ("Omi", "Kron", 131)]
    items = [(i, lead + " ".join(story(*p))) for i, p in enumerate(people)] + [(7, " ".join(story(*people[0]))), (8, None), (9, "")]
    a = story(*people[0])
    docs = [
        (1, "Nice lamp. " + a[0] + " Works well. " + a[1] + " Bye."), (2, " ".join(story("Other", "Person", 700))), (3, lead), (4, None), (5, ""), (6, " ".join(a).upper().replace(" ", "  ")),
        (10, a[0]), (11, " ".join(a).replace("green", "red").replace("plums", "figs").replace("ran", "went")), (12, "Nice lamp. " + a[0] + " Works well. " + a[1] + " Bye."), (13, "word " * 30000 + " ".join(story(*people[1]))),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("rep", F.lit(2))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("body", F.lit("x"))
    leaks = leaked_items(d, i).collect()
    got = {(r["doc_id"], r["item_id"]) for r in leaks if r["kind"] == "wording"}
    # the same story with another town, person and other numbers
    assert {r["doc_id"] for r in leaks if r["kind"] == "template"} >= {2}
    assert got == {(x, y) for x in (1, 6, 11, 12) for y in (0, 7)} | {(13, 1)}
    short = i.unionByName(spark.createDataFrame([(20, "Bodo sells plums", "x"), (21, "Zanzibar", "x")], "item_id long, text string, body string"))
    more = d.unionByName(spark.createDataFrame([(30, "Here Bodo sells plums today.", 1, 2), (31, "zanzibar", 1, 2), (32, "Bodo has plums", 1, 2)], "doc_id long, text string, key int, rep int"))
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(more, short).filter("kind = 'wording'").collect()} == got | {(30, 20), (31, 21)}
    assert leaked_items(d.limit(0), i).count() == 0
    assert leaked_items(d, i.limit(0)).count() == 0


ABUSE = [
    "You filthy parasite, get lost.", "The owner: piece of shit.", "Only a pathetic wanker would give this five stars.", "What a dumb b***h at the desk.", "The girl in chat must be the biggest 1d10t alive.", "i-d-i-o-t seller, you stupid m o r o n",
    "Foreigners like him should be shipped back in crates.", "Dear seller, I know where you live.", "Ferme ta gueule, espèce de débile.", "Soll doch verrecken, dieses Stück Drecksack.", "El jefe es un gilipollas gordo.", "Die Alten sollen alle verrecken.",
    "I get so horny looking at her naked tits.", "Me mandó fotos desnuda y quiero follar con ella.", "The seller is a stupid іdіоt.", "Los extranjeros tendrían que morirse.", "Just a ugly mooooron.", "The woman is a complete idoit.",
]
HARMLESS = [
    "My bitch had puppies and they adore this bed.", "The bastard file cuts steel nicely.", "I felt like an idiot when I found the switch.", "The courier called me an idiot, which I reported.", "A damn fine pan.", "This blender kills ice like a beast.",
    "Cette merde de perceuse a lâché.", "The sex of the chicks was marked on the box, two hens and a cock.", "Die cast parts, and the screen did die on me.", "Me sentí idiota al ver el botón.", "The seller is not an idiot.", "Total waste of money, this crappy hose leaks, pure garbage.", "Die Hündin liebt ihr Kissen.",
]


def test_abuse_sentences():
    g = grammar()
    assert [t for t in ABUSE if g.score(t) < 0.5] == []
    assert [t for t in HARMLESS if g.score(t) >= 0.5] == []


#: Sentences written before the grammar was tried on them; none is in the tables.
HELD_OUT_ABUSE = [
    "I hope you get run over.", "I will find you and hurt you.", "Norwegians are vermin and should be deported.", "The plumber is a lazy bastard.", "You are all worthless liars, go to hell.", "What an absolute moron answered my mail.", "Bolivians are nothing but thieves.", "Get these immigrants out, deport them all.",
    "Your cook is a filthy swine and you know it.", "I'm going to beat you when I see you.", "The postman, what a stupid cow and a cretin.", "Women are born liars.", "Vous êtes une bande de crétins.", "Le patron est un gros connard.", "Ich werde dich umbringen, du Ratte.", "Der Chef ist ein Arschloch.", "Die Spanier sind alle Diebe.",
    "Eres un payaso y un inútil.", "Ojalá te mueras, imbécil.", "Los bolivianos son escoria.", "Send me your naked tits, I want to fuck tonight.", "She is a dumb wh0re.", "You p4thetic l0ser.", "Muslims should be thrown out of the country.", "Shut your face, you imbecile.", "Everyone who works here is a complete idiot.", "I hope the driver dies.", "Refugees should be locked up.",
]
HELD_OUT_HARMLESS = [
    "The driver was a real pig farmer.", "The seller told me to rot in hell, I reported it.", "She said you are idiots.", "This knife will kill any tomato.", "I am such an idiot, I forgot the key.", "My son calls his sister a loser when they play this game.", "The Norwegians make good knives.", "The worm drive broke after a week.", "No driver is a bastard here, they were all friendly.",
    "The rat trap works, the rats are gone.", "A hot day, a naked flame: keep away from children.", "The courier is not a liar, the parcel came.", "These scissors beat the old ones.", "I was called a cretin by the clerk.", "Women will love this scarf.", "He never was a bad boss.", "Die Schweine auf dem Kissen sind süß.", "Je me suis senti idiot.", "El perro es un cerdo comiendo, nos encanta.", "The clown costume fits my kid.",
    "Dumb design, stupid colour, total trash.", "The dog is dead tired.", "It would be a sin to burn this candle.", "Send it back if it breaks.", "Germans and Austrians pay the same postage.", "The hoe is sharp and the old hag mask is funny.", "I hope you restock soon.", "The killer feature is the lamp.",
]


def test_abuse_on_held_out_sentences():
    g = grammar()
    hits = [t for t in HELD_OUT_ABUSE if g.score(t) >= 0.5]
    false = [t for t in HELD_OUT_HARMLESS if g.score(t) >= 0.5]
    recall, precision = len(hits) / len(HELD_OUT_ABUSE), len(hits) / max(1, len(hits) + len(false))
    assert recall >= 0.8 and precision >= 0.9, (recall, precision)


def test_disguises_are_read_as_a_whole():
    words = grammar().lexicon.words
    assert "idiot" in words("1d107") and "dickhead" in words("d1ckh34d") and "scumbag" in words("sc*mb@g") and "motherfucker" in words("m*th3rf*ck3r")
    assert words("100") == frozenset(("100",)) and words("b2b") == frozenset(("b2b",))


def test_abuse_documents(spark):
    rows = [(1, ABUSE[0], "a"), (2, HARMLESS[0], "a"), (3, None, None), (4, "", None), (5, "fine. " * 20000 + ABUSE[1], "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash"))
    assert {r["doc_id"] for r in abusive_documents(df).collect()} == {1, 5}
    assert {r["source"]: (r["n_docs"], r["n_abusive"]) for r in source_rates(df).collect()} == {"a": (2, 1), None: (2, 0), "b": (1, 1)}
    assert abuse_scores(df.limit(0), ["doc_id"]).count() == 0


def test_abuse_agrees_with_raters():
    import pandas as pd

    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    labels = pd.read_parquet(f"{folder}/doc_labels.parquet").dropna(subset=["abusive"]).groupby("doc_id").abusive.agg(["mean", "count"])
    sure = labels[(labels["count"] >= 2) & ((labels["mean"] == 0) | (labels["mean"] == 1))]
    text = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).set_index("doc_id").text
    g = grammar()
    hits = [(g.score(text[d] or "") >= 0.5) == (m == 1) for d, m in sure["mean"].items()]
    assert sum(hits) / len(hits) > 0.97
