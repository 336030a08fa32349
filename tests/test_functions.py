"""Scalar functions against stated values and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions import chunks, fuzzy, html
from termloom.functions import text as X
from termloom.functions import urls as U
from termloom.functions import vectors as V


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_nlp_word_count(spark):
    assert values(spark, X.nlp_word_count, ["best dog breeds", "cost-effective health plans", "U.S. healthcare", "cost-effective plans", "", None, " a/b_c.d "]) == [3, 4, 3, 3, 0, 0, 4]


def test_word_limit(spark):
    keep = values(spark, lambda c: X.within_word_limit(c, ["One Two Three Four"]), ["one two three four", "one two three five", "a b c", "", None])
    assert keep == [True, False, True, False, False]


@pytest.mark.parametrize(
    ("word", "one"),
    [("breeds", "breed"), ("people", "person"), ("cities", "city"), ("ies", "ies"), ("quizzes", "quizz"), ("buses", "bus"), ("boxes", "box"), ("churches", "church"), ("dishes", "dish"), ("shelves", "shelf"), ("heroes", "hero"), ("plans", "plan"), ("glass", "glass"),
     ("bus", "bus"), ("this", "this"), ("ideas", "ideas"), ("as", "as"), ("dog", "dog"), ("wolves", "wolf")],
)
def test_singular(spark, word, one):
    assert values(spark, X.singular, [word]) == [one]


def test_entity_key(spark):
    assert values(spark, X.entity_key, ["  Golden   Retrievers ", "Dogs", "cats dogs", "", None]) == ["golden retriever", "dog", "cats dog", "", ""]


def test_title_case(spark):
    assert values(spark, X.title_case, ["medium-sized dog's HOUSE", "élan vital", "a1b"]) == ["Medium-Sized Dog'S House", "Élan Vital", "A1B"]


def test_valid_span(spark):
    rows = ["the", "You", "it's", "ab", "tion", "action", "nation", "nativ", "Golden Retriever", "", None, "attit", "dog", "fence"]
    assert values(spark, X.valid_span, rows) == [False, False, False, False, False, True, True, False, True, False, False, False, True, False]


def test_display_text(spark):
    assert values(spark, X.display_text, ["The Pug", "Your Dog", "for the family", "the", "The your Pug", None, "Pug"]) == ["Pug", "Dog", "for the family", "", "Pug", "", "Pug"]


def test_seed_texts(spark):
    got = values(spark, X.seed_texts, ["Dog Breeds to Deter Intruders and Keep You Safe", "Dogs", "the", "", None])
    assert got == [["Dog Breeds to Deter Intruders and Keep You Safe", "Dog Breeds", "Deter Intruders", "Keep You Safe"], ["Dogs"], ["the"], [], []]


def test_midpoint(spark):
    df = spark.createDataFrame([(11, 19), (2, 4), (4, 5), (5, 6), (0, 0), (-1, 0), (None, 3)], "a int, b int")
    assert [r.m for r in df.select(X.midpoint("a", "b").alias("m")).collect()] == [15, 3, 4, 6, 0, 0, 2]


def test_gate(spark):
    rows = [("", "t"), ("a " * 10, "t"), ("a " * 40, "404 page"), ("a " * 40, "t"), ("a " * 100, None), ("a " * 300, "t")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, t string")
    skip, most = X.gate("c", "t")
    got = df.orderBy("i").select(skip.alias("s"), most.alias("m")).collect()
    assert [r.s for r in got] == ["empty_content", "too_short", "error_like_title", None, None, None]
    assert [r.m for r in got][3:] == [60, 80, 100]


def test_keyword_list(spark):
    rows = ['["a", " b ", ""]', "a\n\n b \r\nc", "", None, "[not json", "\n".join(map(str, range(80)))]
    got = values(spark, X.keyword_list, rows)
    assert got[:5] == [["a", "b"], ["a", "b", "c"], [], [], ["[not json"]]
    assert len(got[5]) == 50


def test_proximity(spark):
    df = spark.createDataFrame([("big dog", "My Big Dog", "", "x"), ("big dog", "bigdog", "a big dog", "x"), ("w0", "", "", " ".join(f"w{i}" for i in range(30))), ("w3", "", "", " ".join(f"w{i}" for i in range(30))), ("", "a", "a", "a"), (None, "a", "a", "a")], "t string, a string, b string, c string")
    assert [r.p for r in df.select(X.in_proximity("t", "a", "b", "c").alias("p")).collect()] == [True, True, True, False, False, False]


def test_urls(spark):
    assert values(spark, U.normalized, ["http://A.com/x/?utm_source=1&q=2&ref=3&k#top", "http://a.com//", "http://a.com?q=1", None]) == ["http://A.com/x?q=2&k=", "http://a.com", "http://a.com?q=1", ""]
    assert values(spark, U.is_organic, ["http://www.google.com/x", "https://support.google.com", "http://wwwgoogle.com", "ftp://a.com", "http://a.com", None]) == [False, False, True, False, True, False]
    assert values(spark, U.is_social, ["http://m.youtube.com/x", "http://a.com/youtube.com", None]) == [True, False, False]
    assert values(spark, U.competitor_host, ["WWW.A.com:80", "m.a.com", "amp.www.a.com", "", None]) == ["a.com", "a.com", "www.a.com", "", ""]
    assert values(spark, lambda c: F.array_sort(U.domain_tokens(c)), ["www.blog.PetMD.com:443", "", None]) == [["blog", "com", "petmd"], [], []]
    assert values(spark, lambda c: U.is_banned(c, F.array(F.lit("petmd"))), ["PetMD", "123", " ", None, "pet md"]) == [True, True, True, True, False]
    assert values(spark, U.authority, [4.0, 45.0, 55.0, 96.0, 250.0, -3.0, None], "double") == [0, 4, 6, 10, 10, 0, 5]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.norm("a").alias("n"), V.unit("a").alias("u"), V.cosine("a", "b").alias("c")).collect()
    assert (got[0].n, got[0].u, got[0].c) == (5.0, [0.6, 0.8], pytest.approx(0.96))
    assert got[1].u == [0.0, 0.0]
    assert got[1].c == 0


def slow_ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return 100.0 if not a and not b else 200 * table[-1, -1] / (len(a) + len(b))


def test_fuzzy():
    rng = np.random.default_rng(0)
    texts = ["", "canine", "canines", "mastiff", "loyalty", "pet md", "petmd", *("".join(rng.choice(list("ab c"), rng.integers(0, 80))) for _ in range(60))]
    for a in texts:
        for b in texts:
            assert fuzzy.token_sort_ratio(a, b) == pytest.approx(slow_ratio(a, b))
    assert fuzzy.token_sort_ratio("canine", "canines") >= 75
    assert fuzzy.token_sort_ratio("mastiff", "loyalty") < 60
    assert fuzzy.token_sort_ratio("petmd", "petmd.com") >= 60
    assert fuzzy.report_form(" Long-Haired__dog ") == "long haired dog"


def test_html():
    title, about, headings, paragraphs, links = html.parse('<html><head><title> A </title><meta name="description" content=" about "></head><h1>One</h1><h3> Two <b>bold</b></h3><p>See our <a href="/x">pricing plans</a> today.</p><p>Visit <a>home</a> now.</p><p>Plain  text<br>here</p><p></p>')
    assert (title, about, headings) == ("A", "about", ["One", "Twobold"])
    assert paragraphs == ["See .", "Plain text here"]
    assert links == ["/x"]
    assert html.parse(None) == ("", "", [], [], [])
    assert html.scrub_links("a big dog ran. Big dog!", [("a", "big dog", None)]) == "ran. !"


def test_parse_pages(spark):
    df = spark.createDataFrame([(1, "http://www.a.com/x", "<title>T</title><h1>H one</h1><p>some words</p>"), (2, None, None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in html.parse_pages(df).collect()}
    assert (got[1].domain, got[1].content, got[1].word_count, got[1].heading_count, got[1].para_count) == ("www.a.com", "T H one some words", 5, 1, 1)
    assert (got[2].content, got[2].word_count) == ("", 0)


def test_chunks(spark):
    text = " ".join(f"word{i}" for i in range(400))
    got = chunks.bounds(text, 600, 400)
    assert got[0][0] == 0
    assert got[-1][1] == len(text)
    for a, b in got:
        assert a == 0 or text[a - 1] == " "
        assert b == len(text) or text[b - 1] == " "
        assert b - a <= 601
    assert chunks.bounds("") == []
    assert chunks.bounds("x" * 1500)[1] == (400, 1000)
    rows = values(spark, chunks.chunks, ["a b", "", "   ", None])
    assert [[c.text for c in r] for r in rows] == [["a b"], [], [], []]


def test_tfidf(spark):
    df = spark.createDataFrame([(3, 100, 9)], "c int, w int, n int")
    assert df.select(X.tfidf("c", "w", "n").alias("t")).first().t == round(0.03 * math.log(10), 4)


def test_page_probe(spark):
    from termloom.functions import html

    pages = {
        "": ("", False, False), "<TITLE lang=x>Hi There</title>": ("hi there", False, False), "<title>open": ("", False, False), "<title": ("", False, False),
        "<p id='search'>I'm NOT a Robot": ("", True, True), '<div id="main">': ("", True, False), "<div id=search>": ("", False, False), "access denied, recaptcha": ("", False, True),
        "access denied": ("", False, False), "x" * 8000 + "captcha": ("", False, False), "<title>" + "t" * 300 + "</title> Before you continue": ("t" * 200, False, True), "<title></title>": ("", False, False),
    }
    df = spark.createDataFrame([(h,) for h in pages] + [(None,)], "html string")
    got = {r.html: (r.page_title, r.has_search_root, r.is_blocked) for r in df.select("html", *(c.alias(n) for n, c in html.page_probe().items())).collect()}
    assert got == {**pages, None: ("", False, False)}
    rows = [("http://x/sorry/a", 5, True, False), (None, 1, False, True), ("u", 0, False, False), ("u", 0, True, False), ("u", None, False, False), ("u", 1, False, False)]
    df = spark.createDataFrame(rows, "url string, n int, has_search_root boolean, is_blocked boolean")
    assert [r[0] for r in df.select(html.block_reason("url", "n")).collect()] == ["sorry", "block_text", "empty", None, "empty", None]


def test_answers():
    from termloom.functions.answers import answer

    assert answer('{"a": [1]}') == {"a": [1]}
    assert answer("[1, 2]") == [1, 2]
    assert answer('x {"descriptions": ["old"]} assistantfinal {"b": 1} y {"c": {"d": 2}}') == {"d": 2}
    assert answer('{"descriptions": ["a"]} then {"descriptions": []} {"z": 1}') == {"descriptions": ["a"]}
    assert answer('```\n{"a": 1}\n``` or ```json\n{"a": 2}\n```') == {"a": 2}
    assert answer('said "}" {"a": "{"} end') == {"a": "{"}
    assert answer(None) is answer("") is answer("{open") is None
