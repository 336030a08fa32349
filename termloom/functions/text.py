"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IRREGULAR_PLURALS = {
    "breeds": "breed", "dogs": "dog", "cats": "cat", "people": "person", "children": "child", "geese": "goose",
    "teeth": "tooth", "feet": "foot", "mice": "mouse", "shelters": "shelter", "families": "family",
    "puppies": "puppy", "kittens": "kitten", "boxes": "box", "foxes": "fox", "bushes": "bush", "glasses": "glass",
    "wolves": "wolf", "lives": "life", "wives": "wife", "knives": "knife", "tzus": "tzu", "frises": "frise",
    "collies": "collie", "poodles": "poodle", "beagles": "beagle", "poodle": "poodle", "homes": "home", "times": "time",
}
BUCKET_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "her", "his", "in", "is",
    "it", "its", "of", "on", "or", "that", "the", "their", "them", "they", "this", "to", "was", "were", "with",
    "you", "your",
)
WEAK_TOKENS = (
    "the", "a", "i", "me", "you", "he", "him", "she", "her", "it", "we", "us", "they", "them", "my", "your", "his",
    "hers", "our", "their", "mine", "yours", "ours", "theirs", "who", "whom", "whose", "that", "this", "these", "those",
)
FRAGMENTS = (
    "tion", "ude", "ive", "nat", "iven", "attit", "ident", "itude", "ment", "ness", "ence", "ance", "ally", "cal",
    "ful", "ous", "ent", "ant", "est", "ity", "ly", "er", "ed", "al", "ic", "an", "or", "ar", "en", "on", "in", "at",
)
FRAGMENT_SUFFIXES, FRAGMENT_PREFIXES = ("tion", "ude", "ive", "ment", "ness", "ence", "ance"), ("nat", "ident", "iven")
ERROR_TITLES = ("404", "403", "access denied", "captcha", "web server is returning an unknown error", "error")
MAX_NLP_WORDS, MIN_WORDS, THIN_WORDS, MEDIUM_WORDS = 3, 30, 80, 250
THIN_TERMS, MEDIUM_TERMS, MOST_TERMS = 60, 80, 100
TEXT_CHARS, PREVIEW_CHARS = 18_000, 500


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(text: Column | str) -> Column:
    """Without white space of any kind at the ends; null is empty."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"^\s+|\s+$", "")


def text_key(text: Column | str) -> Column:
    """The key that display texts are compared by: trimmed, lower case."""
    return F.lower(trimmed(text))


def words(text: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def nlp_word_count(text: Column | str) -> Column:
    """Words between white space, hyphens, slashes, underscores, dots and other signs."""
    return F.size(F.filter(F.split(trimmed(text), r"(?U)[\s\-/_.]+|\W+"), lambda w: w != ""))


def is_exempt(text: Column | str, exempt: Iterable[str]) -> Column:
    keys = sorted({t.strip().lower() for t in exempt if t and t.strip()})
    return text_key(text).isin(keys) if keys else F.lit(False)


def within_word_limit(text: Column | str, exempt: Iterable[str] = (), most: int = MAX_NLP_WORDS) -> Column:
    """Whether a term is short enough, or one of the exempt anchors; blank terms are not."""
    return (trimmed(text) != "") & ((nlp_word_count(text) <= most) | is_exempt(text, exempt))


def is_numeric(text: Column | str) -> Column:
    return F.coalesce(_col(text), F.lit("")).rlike(r"(?U)\d")


def singular(word: Column | str) -> Column:
    """Singular of a lower-case English word: known irregular forms, then the first suffix rule that fits."""
    w = _col(word)
    known = F.create_map(*(F.lit(x) for pair in IRREGULAR_PLURALS.items() for x in pair))
    n = F.char_length(w)
    less = lambda k: F.substring(w, F.lit(1), n - k)
    long = n > 3
    rules = (
        F.when(long & w.endswith("ies"), F.concat(less(3), F.lit("y")))
        .when(long & w.rlike("(zes|ses|xes|ches|shes)$"), less(2))
        .when(long & w.endswith("ves"), F.concat(less(3), F.lit("f")))
        .when(long & w.endswith("oes"), less(2))
        .when((n > 2) & w.rlike("[^aeiou]s$") & ~w.rlike("ss$"), less(1))
        .otherwise(w)
    )
    return F.coalesce(F.element_at(known, w), rules)


def entity_key(text: Column | str) -> Column:
    """The key that terms are merged by: lower case, the last word in the singular, single spaces if there are several words."""
    t = F.lower(trimmed(text))
    parts = words(t)
    several = F.concat_ws(" ", F.slice(parts, F.lit(1), F.size(parts) - 1), singular(F.element_at(parts, -1)))
    return F.when(t.contains(" "), several).otherwise(singular(t))


def title_case(text: Column | str) -> Column:
    """Each run of letters with its first letter in upper and the others in lower case."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.char_length(r))))), "")


def display_form(text: Column | str) -> Column:
    """Title case for several words, else the text as it is."""
    return F.when(word_count(text) > 1, title_case(text)).otherwise(_col(text))


def bucket_tokens(text: Column | str) -> Column:
    """Singular ASCII words of a term, in order, with stop words."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)), singular)


def bucket_words(text: Column | str) -> Column:
    """The distinct words of a term that can name a bucket."""
    return F.array_except(bucket_tokens(text), F.array(*map(F.lit, BUCKET_STOP_WORDS)))


def token_base(word: Column) -> Column:
    """A word without signs at its ends, up to its first apostrophe, in lower case."""
    bare = F.regexp_replace(F.replace(word, F.lit("’"), F.lit("'")), r"""^["'()\[\]{}<>.,;:!?-]+|["'()\[\]{}<>.,;:!?-]+$""", "")
    return F.lower(F.substring_index(bare, "'", 1))


def valid_span(text: Column | str) -> Column:
    """Whether an extracted span is worth keeping: no pronoun or article, no short remnant, no known word fragment."""
    t = trimmed(text)
    bare = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    short = F.char_length(bare) <= 5
    weak = ~t.contains(" ") & token_base(t).isin(*WEAK_TOKENS)
    cut = bare.rlike(f"({'|'.join(FRAGMENT_SUFFIXES)})$") | bare.rlike(f"^({'|'.join(FRAGMENT_PREFIXES)})")
    return (t != "") & ~weak & (F.char_length(bare) > 2) & ~bare.isin(*FRAGMENTS) & ~(short & cut)


def display_text(text: Column | str) -> Column:
    """A term for display: without leading articles and pronouns; empty if nothing is left."""
    parts = words(text)
    strong = F.transform(parts, lambda w: ~F.lower(F.substring_index(F.replace(w, F.lit("’"), F.lit("'")), "'", 1)).isin(*WEAK_TOKENS))
    first = F.array_position(strong, F.lit(True))
    return F.when(first > 0, F.array_join(F.slice(parts, first.cast("int"), F.size(parts)), " ")).otherwise("")


def gate(content: Column | str, title: Column | str) -> tuple[Column, Column]:
    """Why a page is skipped (null: it isn't), and how many terms it may have."""
    n = word_count(content)
    bad = F.lit(False)
    for marker in ERROR_TITLES:
        bad = bad | F.lower(F.coalesce(_col(title), F.lit(""))).contains(marker)
    skip = F.when(trimmed(content) == "", "empty_content").when(n < MIN_WORDS, "too_short").when(bad, "error_like_title")
    most = F.when(n < THIN_WORDS, THIN_TERMS).when(n < MEDIUM_WORDS, MEDIUM_TERMS).otherwise(MOST_TERMS)
    return skip, most


def is_english(lang: Column | str) -> Column:
    """Whether a page counts as English, by the language that its source or a detector has found; unknown is not."""
    return F.coalesce(F.lower(_col(lang)).rlike(r"^en([-_]|$)"), F.lit(False))


def truncated(text: Column | str, most: int = TEXT_CHARS) -> Column:
    return F.substring(_col(text), 1, most)


def midpoint(low: Column | str, high: Column | str) -> Column:
    """Middle of a target range, halves to the even number; 0 where neither end is positive."""
    lo, hi = F.coalesce(_col(low), F.lit(0)), F.coalesce(_col(high), F.lit(0))
    return F.when((lo <= 0) & (hi <= 0), 0).otherwise(F.bround((lo + hi) / 2, 0)).cast("int")


def file_name(name: Column | str, most: int = 50) -> Column:
    """A name that is safe as a file name."""
    return F.substring(F.replace(F.regexp_replace(_col(name), r'[\\/*?:"<>|]', ""), F.lit(" "), F.lit("_")), 1, most)


def keyword_list(text: Column | str, most: int = 50) -> Column:
    """Keywords of a batch request: a JSON array of strings, or one on each line; trimmed, not empty, at most `most`."""
    t = trimmed(text)
    parsed = F.from_json(t, "array<string>")
    raw = F.when(t.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.split(t, r"\r?\n"))
    return F.slice(F.filter(F.transform(raw, trimmed), lambda x: x != ""), 1, most)


def has_words(needle: Column | str, text: Column | str) -> Column:
    """Whether the words of needle stand in text one after the other; never for none."""
    bounded = lambda c: F.concat(F.lit(" "), F.array_join(words(F.lower(c)), " "), F.lit(" "))
    return (word_count(needle) > 0) & bounded(_col(text)).contains(bounded(_col(needle)))


def in_proximity(term: Column | str, title: Column | str, description: Column | str, content: Column | str) -> Column:
    """Whether a term stands in title, description or the first tenth of the content's words, at least one."""
    w = words(content)
    head = F.array_join(F.slice(w, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(w) / 10).cast("int"))), " ")
    return has_words(term, title) | has_words(term, description) | has_words(term, head)


def tfidf(count: Column | str, total_words: Column | str, n_terms: Column | str) -> Column:
    return F.when((_col(total_words) > 0) & (_col(n_terms) > 0), F.round(_col(count) / _col(total_words) * F.log(_col(n_terms) + F.lit(1)), 4))


def seed_texts(title: Column | str, stop: Iterable[str] = BUCKET_STOP_WORDS) -> Column:
    """The full title, then the runs of words between stop words, without repeats of any case.

    stop: lower-case stop words; you, your and keep never are.
    """
    stop = sorted({s.lower() for s in stop} - {"you", "your", "keep"})
    t = trimmed(title)
    tokens = F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"), F.lit(0))
    marked = F.array_join(F.transform(tokens, lambda w: F.when(F.lower(w).isin(stop), F.lit("\n")).otherwise(w)), " ")
    chunks = F.filter(F.transform(F.split(marked, "\n"), trimmed), lambda x: x != "")
    every = F.concat(F.array(t), chunks)
    lowered = F.transform(every, F.lower)
    return F.when(t != "", F.filter(every, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)).otherwise(F.array().cast("array<string>"))
