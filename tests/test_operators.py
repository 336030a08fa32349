"""Operators against stated values and plain specifications."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom import jobs, providers
from termloom.operators import consensus, fuzzy, grouping, merge, ranking, stores, vectors


@pytest.mark.parametrize(("n", "green", "white"), [(1, 1, 0), (3, 1, 1), (10, 3, 1), (11, 3, 1), (50, 17, 3), (100, 35, 6)])
def test_percentile_tiers(spark, n, green, white):
    df = spark.range(n).withColumn("s", F.lit(1))
    got = ranking.percentile_tiers(df, ["s"], ["id"]).orderBy("id").collect()
    assert [r.tier for r in got] == ["green"] * green + ["white"] * white + ["orange"] * (n - green - white)


def test_quota_counts(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 10, 100)], "n int")
    got = df.select("n", *ranking.quota_counts(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 1, 1, 1), (10, 3, 1, 6), (100, 35, 10, 55)]


def test_slot_share(spark):
    df = spark.range(3)
    assert [r[0] for r in df.select(ranking.slot_share(F.lit(7), F.lit(3), F.col("id"))).collect()] == [3, 2, 2]
    assert [r[0] for r in df.select(ranking.slot_share(F.lit(35), F.lit(3), F.col("id"))).collect()] == [12, 12, 11]


def test_numeric_cap_and_keep_ratio(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["a1", "b", "k9", "c2", "d3", "e"])], "ord int, text string, s int")
    assert [r.text for r in ranking.numeric_cap(df, ["s"], ["ord"], exempt=["K9"]).orderBy("ord").collect()] == ["a1", "b", "k9", "c2", "e"]
    kept = ranking.keep_ratio(df, 0.5, ["s"], F.col("ord"), ["text"])
    assert sorted(r.ord for r in kept.collect()) == [3, 4, 5]
    assert ranking.keep_ratio(df, 0, ["s"], F.col("ord"), ["text"]).count() == 6
    assert ranking.keep_ratio(df, 0.01, ["s"], F.col("ord"), ["text"]).count() == 1


def test_ranked_over_tasks(spark):
    r = random.Random(0)
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([None, *range(20)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    key = lambda t: (t[1] is not None, t[1] or 0, t[2])
    want = {i: n for g in (None, "a", "b", "c") for n, (_, _, i) in enumerate(sorted((t for t in rows if t[0] == g), key=key), 1)}
    assert {x.i: x["rank"] for x in ranking.ranked(df, ["g"], ["x", "i"]).collect()} == want
    every = {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda t: (t[1] is None, -(t[1] or 0), t[2])), 8)}
    assert {x.i: x.sr_no for x in stores.numbered(df, [F.desc_nulls_last("x"), "i"], start=7).collect()} == every
    assert ranking.ranked(df.limit(0), ["g"], ["i"]).collect() == []
    tiers = lambda large: {x.i: x.tier for x in ranking.percentile_tiers(df.where("g IS NOT NULL"), ["g"], ["x", "i"], large).collect()}
    assert tiers(True) == tiers(False)


def test_label_cap(spark):
    rows = [("g1", "green", 0), ("g2", "green", 1), ("g3", "green", 2), ("o1", "orange", 0), ("o2", "orange", 1), ("w1", "white", 0)]
    df = spark.createDataFrame([(1, t, tier, o, "Dog Breed") for t, tier, o in rows] + [(1, "x", "white", 9, "Food")], "s int, text string, tier string, ord int, label string")
    assert {r.text for r in ranking.label_cap(df, grouping.LABEL_CAPS, ["s"], ["ord"]).collect()} == {"g1", "g2", "g3", "o1", "x"}


TERMS = "session_id int, page_id int, ord int, domain string, text string, label string, source string, count int, relevance double, weightage double, keybert_score double"


def test_merge_terms(spark):
    rows = [
        (1, 1, 0, "www.a.com", "Golden Retrievers", "Dog Breed", "gliner", 2, 0.5, 0.4, None), (1, 1, 1, "www.a.com", "a", "X", None, 9, 1.0, 1.0, None), (1, 1, 2, "www.a.com", "N/A", "X", None, 9, 1.0, 1.0, None),
        (1, 2, 0, "b.com", "golden retriever", "Animal Breed", "KeyBERT", 1, 0.8, 0.7, 0.3), (1, 2, 1, "b.com", "golden retriever", None, None, None, None, None, None), (1, 3, 0, "b.com", "123", "X", None, 1, 1.0, 1.0, None),
        (2, 4, 0, "c.com", "dogs", None, "keybert", 1, 0.1, 0.2, 0.5),
    ]
    got = {(r.session_id, r.key): r for r in merge.merge_terms(spark.createDataFrame(rows, TERMS)).collect()}
    assert set(got) == {(1, "golden retriever"), (2, "dog")}
    r = got[1, "golden retriever"]
    assert (r.text, r.label, r.combined_count, r.sources, r.source_counts) == ("Golden Retriever", "Dog Breed", 4, ["gliner", "keybert"], {"gliner": 3, "keybert": 1})
    assert (r.average_relevance, r.average_weightage, r.average_keybert_score, r.competitor_count, r.competitor_multiplier) == (0.45, 0.375, 0.3, 2, 2)
    assert r.adjusted_weightage == 0.75
    assert (got[2, "dog"].label, got[2, "dog"].text) == ("Keyphrase", "dogs")
    assert merge.merge_terms(spark.createDataFrame([], TERMS)).collect() == []


def test_span_votes(spark):
    spans = spark.createDataFrame([(1, i, t, lab) for i, (t, lab) in enumerate([("Pug dog", "Dog Breed"), ("pug dog", "Animal Breed"), ("Pug dog", "Dog Breed"), ("the", "X"), ("PUG DOG", " ")])], "page_id int, ord int, text string, label string")
    got = merge.aggregate_spans(spans).collect()
    assert [(r.text, r.label, r["count"]) for r in got] == [("Pug dog", "Dog Breed", 4)]


def test_word_range(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (2, 0.0)], "s int, adjusted_weightage double")
    assert sorted(r.word_range for r in merge.word_range(df, F.lit(100.0), ["s"]).collect()) == [0, 15, 45]


def test_buckets(spark):
    df = spark.createDataFrame([("green", "dog food", 1), ("green", "Hot Dogs", 2), ("green", "dogma", 3), ("green", "HOT DOGS", 9), ("white", "cat", 4), ("green", "to be", 1)], "tier string, text string, combined_count int")
    got = {(r.tier, r.word): [x.text for x in r.nlps] for r in grouping.word_buckets(df, order=["combined_count"]).collect()}
    assert got == {("green", "dog"): ["Hot Dogs", "dog food", "dogma"]}


def test_label_groups(spark):
    df = spark.createDataFrame([("Pug", "Dog Breed"), ("pug", "Dog Breed"), ("x", "NLP"), ("y", None)], "text string, label string")
    got = {r.label: r.texts for r in grouping.label_groups(df, ["text"]).collect()}
    assert len(got) == len(grouping.LABELS)
    assert (got["Dog Breed"], got["Other"], got["Pet"]) == (["Pug"], ["x", "y"], [])


def test_display(spark):
    df = spark.createDataFrame([(1, 0, "The Pug", "Dog Breed", 2), (1, 1, "Pug", "Dog Breed", 1), (1, 2, "Acme", "Brand", 9), (1, 3, "the", "X", 1)], "s int, ord int, text string, label string, combined_count int")
    assert [(r.text, r.combined_count, r.place) for r in grouping.display_terms(df, ["s"], ["ord"]).collect()] == [("Pug", 2, 1)]


def test_pick_labels(spark):
    phrases = spark.createDataFrame([("Pug",), ("my query",), ("none",)], "text string")
    spans = spark.createDataFrame([("Pug", "pug", "Dog Breed", 0.2), ("Pug", "pug dog", "Pet", 0.9), ("my query", "q", "Pet", 0.9)], "phrase string, text string, label string, score double")
    assert {r.text: r.label for r in grouping.pick_labels(phrases, spans, "My Query").collect()} == {"pug": "Dog Breed", "my query": "Phrase", "none": "Other"}


def spec_greedy(sims, counts, threshold):
    """Round by round: each term meets its first near later one; the less frequent of the two leaves."""
    left = list(range(len(counts)))
    for _ in range(50):
        out, won = set(), False
        for i in left:
            if i in out:
                continue
            near = [j for j in left if j > i and j not in out and sims[i, j] > threshold]
            if near:
                loser = near[0] if counts[i] >= counts[near[0]] else i
                out.add(loser)
                won |= loser != i
        left = [i for i in left if i not in out]
        if not won:
            return left
    return left


def test_greedy():
    r = np.random.default_rng(0)
    for _ in range(100):
        n = int(r.integers(1, 25))
        s = r.random((n, n))
        s = (s + s.T) / 2
        counts = r.integers(1, 5, n).tolist()
        assert vectors.greedy_survivors(s, counts, 0.7) == spec_greedy(s, counts, 0.7)
    assert vectors.greedy_survivors(np.ones((3, 3)), [1, 2, 3], 0.5, one_each=False) == [2]


def test_kmeans():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels, centres = vectors.spherical_kmeans(x, np.array([[1, 0], [0, 1], [-1, -1]], np.float32), pinned=(0,))
    assert labels.tolist() == [0, 0, 1, 1]
    assert centres[0].tolist() == [1, 0]
    assert np.allclose(centres[2], [-(0.5**0.5)] * 2)


@pytest.mark.parametrize("seed", range(5))
def test_triplet(seed):
    v = np.random.default_rng(seed).normal(size=64)
    own, opposite, middle = vectors.triplet(v)
    assert np.allclose([np.linalg.norm(z) for z in (own, opposite, middle)], 1, atol=1e-5)
    assert own @ opposite < -0.99
    assert own @ middle < 0.99
    assert own @ vectors.triplet(v, 0.9)[2] > own @ middle > opposite @ middle
    assert vectors.triplet(v, 0.5, "opposite")[2] @ opposite > 0.1
    with pytest.raises(ValueError, match="direction"):
        vectors.triplet(np.zeros(3))


def test_validate_anchors(spark):
    rows = [(1, 0, "query", [1.0, 0.0], False), (1, 1, "same", [1.0, 0.01], False), (1, 2, "far", [0.0, 1.0], False), (1, 3, "entity", [0.0, 1.0], True), (1, 4, "near", [0.8, 0.6], False), (1, 5, "ENTITY", [-1.0, 0.0], True)]
    got = {r.text: (r.status, r.role) for r in vectors.validate_anchors(spark.createDataFrame(rows, "session_id int, ord int, text string, vector array<float>, is_entity boolean")).collect()}
    assert got == {"query": ("accepted", "original"), "same": ("duplicate", None), "far": ("below_min_sim", None), "entity": ("accepted", "gliner_entity_1"), "near": ("accepted", "variant_2"), "ENTITY": ("repeated", None)}


def spec_slots(buckets, shares):
    """A direct reading: positions, one at a time."""
    at, used, out, rank = [0] * len(buckets), set(), [], [0] * len(buckets)

    def one(a):
        while at[a] < len(buckets[a]):
            i = at[a]
            at[a] += 1
            if buckets[a][i] not in used:
                used.add(buckets[a][i])
                rank[a] += 1
                out.append((a, i, rank[a]))
                return True
        return False

    lack = sum(sum(not one(a) for _ in range(n)) for a, n in enumerate(shares))
    while lack:
        order = sorted(range(len(buckets)), key=lambda a: at[a] - len(buckets[a]))
        got = 0
        for a in order:
            if lack and one(a):
                lack, got = lack - 1, got + 1
        if not got:
            break
    return out


def test_fill_slots():
    r = random.Random(0)
    for _ in range(200):
        buckets = [r.sample("abcdefghijkl", r.randint(0, 8)) for _ in range(r.randint(1, 4))]
        shares = [r.randint(0, 4) for _ in buckets]
        assert consensus.fill_slots(buckets, shares) == spec_slots(buckets, shares)


def assignments(spark, seed=0, anchors=3, n=20):
    r = random.Random(seed)
    rows = [(1, a + 1, f"anchor {a}", f"term {chr(97 + i)}{'x' * (i * 3 % 17)}", i, round(r.random(), 4)) for a in range(anchors) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id int, instance_index int, anchor string, text string, ord int, sim double").withColumn("key", F.lower("text"))
    return consensus.anchor_tiers(df)


@pytest.mark.parametrize("seed", range(3))
def test_slots_and_final_tiers(spark, seed):
    a = assignments(spark, seed)
    taken = consensus.select_slots(a).collect()
    n = {t: sum(r.tier == t for r in taken) for t in ("green", "orange", "white")}
    assert n["green"] <= 7
    assert n["white"] <= 2
    assert n["orange"] <= 11
    entities = a.select("session_id", "key", "text", F.lit(5).alias("combined_count"), F.lit(2).alias("competitor_count"), F.lit(0.5).alias("average_weightage")).distinct()
    whole = consensus.final_tiers(a, entities, "term a", average_words=F.lit(100.0))
    final = whole.collect()
    keys = [r.key for r in final]
    assert len(keys) == len(set(keys))
    assert all(r.word_range >= 1 for r in final)
    for t in n:
        ranks = [(r.instance_rank, r.instance_index) for r in sorted((r for r in final if r.tier == t), key=lambda r: r.ord)]
        assert ranks == sorted(ranks)
    again = consensus.final_tiers(a.repartition(7), entities, "term a", average_words=F.lit(100.0)).collect()
    assert sorted(map(str, again)) == sorted(map(str, final))


def test_one_tier_each(spark):
    df = spark.createDataFrame([(1, "t", "green", 1, 0.95), (1, "t", "orange", 2, 0.4), (1, "u", "white", 1, 0.4), (1, "u", "orange", 1, 0.4)], "session_id int, key string, tier string, instance_index int, sim double")
    assert {r.key: r.tier for r in consensus.one_tier_each(df).collect()} == {"t": "green", "u": "orange"}


def test_anchor_order(spark):
    df = spark.createDataFrame([(1, 0, "dogs"), (1, 1, "Best Dogs"), (1, 2, "DOGS"), (1, 3, "cats"), (1, 4, " ")], "session_id int, ord int, anchor string")
    order = lambda variants: [(r.anchor, r.instance_index) for r in consensus.anchor_order(df, "best dogs", variants=variants).orderBy("instance_index").collect()]
    assert order(["Dogs"]) == [("Best Dogs", 1), ("dogs", 2)]
    assert order([]) == [("Best Dogs", 1)]
    assert order(None) == [("Best Dogs", 1), ("dogs", 2), ("cats", 3)]


def test_tier_dedup(spark):
    df = spark.createDataFrame([("green", 0, "canine", 0.9), ("green", 1, "canines", 0.5), ("green", 2, "mastiff", 0.4), ("white", 3, "canine", 0.1), ("green", 4, "Canine", 0.2)], "tier string, ord int, text string, rank_score double")
    kept, pairs = fuzzy.dedup_tiers(df, ["tier"])
    assert {(r.tier, r.text) for r in kept.collect()} == {("green", "canines"), ("green", "mastiff"), ("white", "canine")}
    assert {(r.keep, r.remove) for r in pairs.collect()} == {("canines", "canine"), ("canines", "Canine")}
    kept, _ = fuzzy.dedup_tiers(df, ["tier"], keyword="CANINE")
    assert {r.text for r in kept.where("tier = 'green'").collect()} == {"canines", "mastiff", "canine", "Canine"}


def test_domains(spark):
    terms = spark.createDataFrame([(1, "petmd"), (1, "pet md"), (1, "mastiff"), (1, "PetMD.com")], "session_id int, text string")
    domains = spark.createDataFrame([(1, "petmd.com"), (1, "zzz.com")], "session_id int, domain string")
    out = {r.text for r in fuzzy.without_domains(terms, domains).collect()}
    assert "petmd" not in out
    assert {"mastiff", "pet md"} <= out
    assert "petmd" in {r.text for r in fuzzy.without_domains(terms, domains, keyword="PetMD").collect()}


def test_pairs(spark):
    df = spark.createDataFrame([(1, 0, "canine", 0.1, 1.0, 1), (1, 1, "canines", 0.9, 0.0, 1), (1, 2, "mastiff", 0.1, 0.0, 1), (1, 3, "Canine", 0.1, 1.0, 1), (2, 0, "canine", 0.0, 0.0, 1)], "session_id int, ord int, text string, average_relevance double, adjusted_weightage double, combined_count int")
    got = {(r.keep, r.remove): r.similarity_percent for r in fuzzy.duplicate_pairs(df).collect()}
    assert got == {("canines", "canine"): 92.3, ("canine", "Canine"): 100.0, ("canines", "Canine"): 92.3}


def test_stores(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k int, x string, y int")
    once = stores.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", None)]
    assert sorted(map(str, stores.upsert(once, new, ["k"]).collect())) == sorted(map(str, once.collect()))
    assert [r.k for r in stores.delete(once, new, ["k"]).collect()] == [1]
    urls = spark.createDataFrame([([" b", "a", "a"],), ([],)], "u array<string>")
    import hashlib

    assert [r.s for r in urls.select(stores.selection_key("u").alias("s")).collect()] == [hashlib.sha256(t).hexdigest()[:16] for t in (b'["a", "b"]', b"[]")]


def test_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise providers.TransientError
        return x

    assert providers.retried(flaky, 1, wait=0) == 1
    calls.clear()
    with pytest.raises(providers.TransientError):
        providers.retried(lambda x: flaky(calls.clear()), 1, wait=0)


def test_page_job(spark):
    body = "".join(f"<p>Golden Retriever and Labrador Dog number {i} live in New York.</p>" for i in range(12))
    pages = spark.createDataFrame([(1, "http://a.com/1", f"<title>Golden Retriever Guide</title>{body}"), (2, "http://b.com", "<title>404</title>x"), (3, None, None)], "page_id long, url string, html string")
    got = {r.text: r for r in jobs.page_terms(pages).collect()}
    assert {r.page_id for r in got.values()} == {1}
    assert "Golden Retriever" in got
    assert got["Golden Retriever"]["count"] >= 12


def test_organic_pages(spark):
    rows = [(1, 1, "http://www.google.com/x"), (1, 2, "http://a.com/p?ref=1"), (1, 3, "http://a.com/p/"), (1, 4, "http://b.com"), (1, 5, "http://c.com")]
    got = jobs.organic_pages(spark.createDataFrame(rows, "session_id int, pos int, url string"), 3)
    assert sorted(r.url for r in got.collect()) == ["http://a.com/p", "http://b.com"]


def test_session_jobs(spark):
    terms = spark.createDataFrame([(1, p, o, f"s{p}.com", t, "Pet", "gliner", 1 + o, 0.5, (o + p) / 16, None) for p in (1, 2, 3) for o, t in enumerate(["big dog", "small cat", "pug dogs", "red house", "blue bird", "old tree"])], TERMS)
    pages = spark.createDataFrame([(1, p, 100) for p in (1, 2, 3)], "session_id int, page_id int, word_count int")
    merged = jobs.merged_session(terms, pages)
    assert {r.tier for r in merged.collect()} == {"green", "white", "orange"}
    one = jobs.merged_session(terms, pages, selected=pages.where("page_id = 1"))
    assert all(r.competitor_count == 1 for r in one.collect())
    embed = providers.embedding(providers.StubEmbedder)
    entities = merged.drop("tier", "word_range")
    anchors = spark.createDataFrame([(1, "dogs", 0), (1, "house", 1)], "session_id int, anchor string, anchor_ord int").withColumn("vector", embed("anchor"))
    tiered = jobs.tiered_session(entities, anchors, entities.select("session_id", "key", embed("text").alias("vector")), "dogs", average_words=F.lit(100.0))
    rows = tiered.collect()
    assert rows
    assert {r.tiering_method for r in rows} == {"proportional_instance_v1"}
    assert jobs.tiered_session(entities, anchors, entities, "dogs", method="percentile").count() == 5  # the keep ratio leaves five of six
    document = jobs.session_document(tiered).first().document
    # sessions without anchors or without vectors fall back, alone
    three = entities.unionByName(entities.withColumn("session_id", F.lit(2))).unionByName(entities.withColumn("session_id", F.lit(3)))
    some = anchors.unionByName(anchors.withColumn("session_id", F.lit(3)))
    mixed = jobs.tiered_session(three, some, three.where("session_id < 3").select("session_id", "key", embed("text").alias("vector")), "dogs", average_words=F.lit(100.0))
    methods = {(r.session_id, r.tiering_method) for r in mixed.collect()}
    assert methods == {(1, "proportional_instance_v1"), (2, "percentile"), (3, "percentile")}
    assert {(r.key, r.tier) for r in mixed.where("session_id = 1").collect()} == {(r.key, r.tier) for r in rows}
    assert mixed.where("session_id = 3").count() == 5
    key = entities.agg(F.min("key")).first()[0]
    long = entities.withColumn("text", F.when(F.col("key") == key, "one very long term").otherwise(F.col("text")))
    assert jobs.tiered_session(long, anchors, entities, "dogs", method="percentile").count() == 4
    named = anchors.withColumn("anchor", F.when(F.col("anchor_ord") == 1, "One very long term ").otherwise(F.col("anchor")))
    assert jobs.tiered_session(long, named, entities, "dogs", method="percentile").count() == 5
    assert '"tiers"' in document
    with pytest.raises(ValueError, match="method"):
        jobs.tiered_session(entities, anchors, entities, "dogs", method="x")


def test_anchor_bundle(spark):
    class Same:
        """Every text but one points the same way."""

        def encode(self, texts, is_query=False):
            return np.array([[0.0, 1.0] if "Odd" in t else [1.0, len(t) / 1000] for t in texts], np.float32)

    class Names:
        def spans(self, texts, labels, threshold):
            assert threshold == 0.05
            return [[(w, "Topic", 0.1) for w in t.split("|")] for t in texts]

    keywords = spark.createDataFrame([(1, " Big Dog|big dog|Odd One|Odd One|the|Big Cat"), (2, " "), (3, "alone")], "session_id int, keyword string")
    got = jobs.anchor_bundle(keywords, Names, Same).orderBy("session_id", "anchor_ord").collect()
    assert [(r.session_id, r.anchor, r.anchor_ord, r.role) for r in got] == [(1, "Big Dog|big dog|Odd One|Odd One|the|Big Cat", 0, "original"), (1, "Big Dog", 1, "gliner_entity_1"), (3, "alone", 0, "original")]
    assert all(len(r.vector) == 2 for r in got)
