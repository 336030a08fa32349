"""Token counts, BPE, lines, repeats."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from termloom.llm import bpe_lexicon, line_dedup, lm_scoring, repeats, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", None, "a", "It's  I'LL we'll\n\n x", "日本語テキスト　ok 12３٣ é́  x  y", " \t\n ", "a<|endoftext|> b  <|endoftext|>", "x" * 3000, "word " * 2000, "\x00\x1c a  b  c", "é" * 500 + " \n" + "12" * 400]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", i) for i, t in enumerate(ODD)] + [(None, "null id", "e", 1), (3, ODD[3], "e", 2), (3, ODD[3], "e", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def random_text(r, n):
    return "".join(r.choice([" ", "  ", "\n", "ab", "don't", "'s", "12", "é", "語", "<|endoftext|>", "...", "x" * 30, "\t ", " "]) for _ in range(n))


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 16), (64, 20), (100, 30)])
def test_splice_is_exact(chunk, overlap):
    r = random.Random(chunk)
    encode = lambda s: LIBRARY.encode(s, add_special_tokens=False)
    for _ in range(150):
        t = random_text(r, r.randint(1, 200))
        assert token_counts.splice(t, encode, chunk, overlap) == len(ids(t))


def test_splice_widens_without_stable_edges():
    encode = lambda s: LIBRARY.encode(s, add_special_tokens=False)
    for t in ("a" * 5000, "ab" * 3000, "'" * 4000, " " * 3000, "語" * 2000):
        assert token_counts.splice(t, encode, 200, 20) == len(ids(t))


def test_unbroken_runs_are_linear():
    sizes = []

    def encode(s):
        sizes.append(len(s))
        return LIBRARY.encode(s, add_special_tokens=False)

    for n in (20_000, 80_000):
        for t in ("ab" * (n // 2), "語" * n, "ab cd " * (n // 12) + "x" * (n // 2)):
            sizes.clear()
            assert token_counts.splice(t, encode, 1000, 50) == len(ids(t))
            assert sum(sizes) <= 3 * len(t)


def test_token_counts(docs, none):
    got = sorted(token_counts.token_counts(docs, PATH, chunk=200, overlap=20).collect(), key=str)
    want = sorted(((d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for d, t, *_ in docs.collect()), key=lambda x: f"Row(doc_id={x[0]}, n_bytes={x[1]}, n_tokens={x[2]}, over_limit={x[3]})")
    assert [tuple(r) for r in got] == want
    assert token_counts.token_counts(none, PATH).collect() == []


def test_ranks_agree():
    fast = bpe_lexicon.by_ranks(PATH)
    r = random.Random(5)
    for t in [*ODD, *(random_text(r, 80) for _ in range(300))]:
        assert fast.encode(t or "", allowed_special="all") == ids(t)


def test_merge_and_lexicon():
    m = bpe_lexicon.Merges(PATH)
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcdethionsr é") for _ in range(r.randint(1, 9))).encode() for _ in range(3000)})
    coded = [m.merge(w) for w in words]
    assert all(LIBRARY.encode(w.decode(), add_special_tokens=False).ids == c for w, c in zip(words, coded, strict=True) if len(m.find(w.decode())) == 1)
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon(words, coded))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b"", b"zzzzzzzzzzzzzzzz", words[0] + b"!", words[-1][:-1] + b"~"]).tolist() == [-1] * 4
    assert [lexicon.encoded(i) for i in range(len(words))] == coded
    assert len(lexicon.finals) < sum(map(len, words))
    empty = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon([], []))
    assert empty.find([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("words", [0, 3, 10_000])
def test_encode_decode(docs, none, words):
    coded = bpe_lexicon.encode(docs, PATH, words=words)
    rows = Counter((r.doc_id, tuple(r.ids)) for r in coded.collect())
    assert rows == Counter((d, tuple(ids(t))) for d, t, *_ in docs.collect())
    back = Counter((r.doc_id, r.text) for r in bpe_lexicon.decode(coded, PATH).collect())
    assert back == Counter((d, LIBRARY.decode(ids(t), skip_special_tokens=False)) for d, t, *_ in docs.collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = Counter(tuple(r) for r in bpe_lexicon.encode(docs, PATH, digests=True, words=words).collect())
    assert digests == Counter((d, len(ids(t)), sha(",".join(map(str, ids(t)))), sha(t or "")) for d, t, *_ in docs.collect())
    assert bpe_lexicon.encode(none, PATH).collect() == []


def brute_lines(rows, most=1):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    seen = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                seen.setdefault(key(line), set()).add(float("inf") if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(seen.get(key(x), ())) <= most or min(seen[key(x)]) == (float("inf") if d is None else d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("most", [1, 2])
def test_line_dedup(spark, most):
    r = random.Random(most)
    lines = ["a common line here", "A Common Line Here", "\t a common line here \r", "short", "", "ééééééééé", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "another long line", " another long line"]
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", "\n".join(r.choice(lines) for _ in range(r.randint(1, 6)))])) for _ in range(120)]
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "doc_id long, text string, n_lines string, id long").repartition(5)
    assert Counter(tuple(x) for x in line_dedup.line_dedup(df, max_docs=most).collect()) == brute_lines(rows, most)
    kept = line_dedup.line_dedup(df.withColumn("odd name, really", df.id), max_docs=most, keep=["n_lines", "doc_id", "odd name, really"])
    assert {(x.row.n_lines, x.row["odd name, really"]) for x in kept.collect()} == {("e", 1)}
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def test_line_dedup_takes_ids_of_any_type(spark):
    rows = [("b", "the same long line\nown line of b"), ("a", "the same long line"), (None, "The same long line \nshort"), ("c", None), ("a", "the same long line")]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id string, text string"))
    assert Counter(tuple(x) for x in out.collect()) == Counter([("b", "own line of b", 2, 1), ("a", "the same long line", 1, 0), ("a", "the same long line", 1, 0), (None, "short", 2, 1), ("c", "", 1, 0)])


def brute_repeats(rows, window):
    seen = Counter(t[k : k + window] for _, t in rows for k in range(len(t) - window + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return Counter(out)


def brute_passages(rows, window):
    """Number of words in windows that another row holds too, for each row."""
    split = [(t or "").lower().encode().split() for t in rows]
    grams = [[tuple(w[k : k + window]) for k in range(len(w) - window + 1)] for w in split]
    held = Counter(g for x in grams for g in set(x))
    return [len({k + j for k, g in enumerate(x) if held[g] > 1 for j in range(window)}) for x in grams]


@pytest.mark.parametrize(("often", "hot"), [(10_000, 20_000), (1, 2)])
def test_repeated_passages(spark, often, hot, monkeypatch):
    monkeypatch.setattr(repeats, "FREQUENT_RUNS", often)
    r = random.Random(often)
    word = lambda: r.choice(["a", "B", "b", "é", "cc", "longer", "\x00"]) + str(r.randint(0, 30))
    some = [[word() for _ in range(n)] for n in (9, 10, 11, 12, 30, 60)]
    rows = [None, "", " \n", "one", "x " * 40, "x " * 9, "x " * 10]
    for _ in range(70):
        parts = [r.choice(some) if r.random() < 0.5 else [word() for _ in range(r.randint(0, 20))] for _ in range(r.randint(0, 5))]
        rows.append("".join(w + r.choice([" ", "\n", "  \t"]) for p in parts for w in p))
    rows += [rows[20], rows[21], rows[21].upper() if rows[21].isascii() else rows[21], " ".join(word() for _ in range(4000)) + " " + " ".join(some[4])]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, n_words long").repartition(3)
    monkeypatch.setattr(repeats, "PASSAGE_FIRST", 4)
    out = repeats.remove_repeats(df, window=40, first=8, digit=10, hot=hot, passage=10).collect()
    assert [x.n_passage_words for x in sorted(out, key=lambda x: x.doc_id)] == brute_passages(rows, 10)
    assert 10 < sum(n > 0 for n in brute_passages(rows, 10)) < len(rows)
    assert {x.n_passage_words for x in repeats.remove_repeats(df, window=40, first=8, digit=10).collect()} == {0}
    assert repeats.remove_repeats(df.limit(0), passage=10).collect() == []


@pytest.mark.parametrize(("seed", "hot"), [(0, 20_000), (1, 2), (2, 0)])
def test_repeats(spark, seed, hot):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared = [word(n) for n in (30, 39, 40, 41, 90, 200)]
    rows = [(r.choice([None, 1, 2, 3]), "".join(r.choice([word(r.randint(0, 60)), r.choice(shared)]) for _ in range(r.randint(0, 6)))) for _ in range(60)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (8, None), (9, "ab" * 100), (10, "z" * 39), (11, "z" * 40), (12, word(39)), (13, word(3000)), (14, shared[5] + word(5) + shared[5])]
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "doc_id long, text string, kept string, k1 long").repartition(3)
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in repeats.remove_repeats(df, window=40, first=8, digit=10, hot=hot).collect())
    assert got == brute_repeats([(d, (t or "").encode()) for d, t in rows], 40)
    assert repeats.remove_repeats(df.limit(0)).collect() == []


def test_runs_cover_all_windows(monkeypatch):
    monkeypatch.setattr(repeats, "BUFFER", 900)
    r = np.random.default_rng(0)
    texts = [(i, r.integers(97, 100, n).astype(np.uint8)) for i, n in enumerate((0, 39, 40, 41, 500, 2500, 899, 900, 7))]
    seen = Counter()
    for which, begins, text, ends in repeats._pieces(iter(texts), 40):
        begin, number, _ = repeats.runs(text, ends, repeats._table(), 40, 8)
        for b, n in zip(begin, number, strict=True):
            part = int(np.searchsorted(ends, b, side="right"))
            lo = b - (ends[part - 1] if part else 0) + begins[part]
            seen.update((which[part], int(lo) + k) for k in range(n))
    assert set(seen) == {(i, k) for i, t in texts for k in range(len(t) - 39)}
    assert max(seen.values()) == 1


def test_lm_score(spark):
    r = random.Random(3)
    words = [w for w in "the of and syllable Syllable thtion ndth é ß then, | x".split()]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(None, "the of"), (81, None), (82, ""), (3, "the the"), (3, "the the"), (83, "ab c  " + "q" * 3000)]
    df = spark.createDataFrame([(*x, "e", 1.0) for x in rows], "doc_id long, text string, word string, score double")
    got = Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in lm_scoring.lm_score(df, PATH, frequent=4).collect())
    crc = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter()
    for d, t in rows:
        if not crc(d):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want[d, crc(d), len(w), sum(c[x] > 0 for x in w), n, round(float(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)), 6)] += 1
    assert got == want
    scores = lm_scoring.lm_score(df, PATH).collect()
    assert all(np.isfinite(x.score) and x.score < 0 for x in scores)
    assert lm_scoring.lm_score(df.limit(0), PATH).collect() == []


def brute_log10(p, stream, at, begin):
    """Log10 probability of the id at a place of a stream by the definition of the model; begin: the first place that its window sees."""
    from termloom.llm import attention_lm as lm

    q, now = p["query"][stream[at - 1]].astype(float), at - 1
    weight = [np.exp(q @ p["key"][stream[j]] / np.sqrt(lm.WIDTH) + p["back"][now - j]) for j in range(begin, at)]
    value = sum(w * p["value"][stream[j]].astype(float) for w, j in zip(weight, range(begin, at), strict=True)) / sum(weight)
    gate = np.exp(value @ p["mix"] + sum(p[f"gate{i}"][stream[now - i]].astype(float) for i in range(lm.LAST)))
    return np.log10((gate / gate.sum()) @ lm.distributions(p)[stream[at]])


def test_lm_score_brute(spark, monkeypatch):
    """Every text's score, id by id, by the model that the query has learned."""
    from termloom.llm import attention_lm as lm

    seen, trained = [], lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", lambda rows, path, vocab, size: seen.append((vocab, trained(rows, path, vocab, size))) or seen[-1][1])
    monkeypatch.setattr(lm_scoring, "BATCH", 2000)
    r = random.Random(8)
    words = "the of Syllable thtion é ß then, | x qqqq zebra".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 120)))) for i in range(40)] + [(40, None), (41, ""), (None, "a b")]
    got = {x.doc_id: x.score for x in lm_scoring.lm_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, vocabulary=20).collect()}
    (vocab, p), sub = seen[0], lm_scoring.Subwords(PATH)
    for d, t in rows:
        ids = sub.many(lm_scoring.words_of((t or "").encode()))[0]
        stream = np.concatenate([np.zeros(lm.CONTEXT + 1, int), vocab.place[ids].astype(int), [0]])
        want = vocab.within[ids].sum()
        for k in range(len(ids) + 1):
            want += brute_log10(p, stream, lm.CONTEXT + 1 + k, k // lm.STRIDE * lm.STRIDE)
        assert got[d] == pytest.approx(want, rel=1e-4)


def test_lm_stretches_have_whole_words():
    from termloom.llm import attention_lm as lm

    texts = ["aé " * 3000 + "é" * 9000 + " éa" * 3000, "one two", "", "語" * 5000]
    place = np.arange(lm_scoring.Subwords(PATH).size, dtype=np.int32)
    doc = [i for i in range(20) if not lm_scoring.held_out(i)][:4]
    batch = pa.RecordBatch.from_arrays([pa.array(doc), pa.array([t.encode() for t in texts], pa.binary())], ["id", "t"])
    rows = [np.frombuffer(x, np.int32).reshape(-1, lm.SPAN + 1) for b in lm_scoring._start(PATH, place, 1.0)(iter([batch])) for x in b.column(2).to_pylist()]
    whole = {tuple(ids(" " + w)) for w in ("aé", "éa", "one", "two")}
    seen = np.concatenate([x[:, lm.CONTEXT + 1 :].ravel() for x in rows])
    assert set(seen.tolist()) == {0, *(i for w in whole for i in w)}


def test_lm_counts_every_id(spark):
    """What the mixed distributions have given adds up to the ids of all training texts, whole and of any length."""
    from termloom.llm import attention_lm as lm

    rows = [(0, " ".join(f"word{i}" for i in range(3000))), (2, "the end"), (3, None), (1, "held out"), (None, "a")]
    df = spark.createDataFrame([(i, (t or "").encode() if t is not None else None) for i, t in rows], "id long, t binary").repartition(2)
    assert {i for i, _ in rows if lm_scoring.held_out(i)}
    sub = lm_scoring.Subwords(PATH)
    count = Counter()
    for i, t in rows:
        if not lm_scoring.held_out(i):
            count.update([*sub.many(lm_scoring.words_of((t or "").encode()))[0].tolist(), -1])
    texts = count.pop(-1)
    vocab = lm_scoring.Vocabulary(sub.size, dict(count), texts)
    found = df.mapInArrow(lm_scoring._expect(PATH, vocab, lm.initial(vocab.unigram)), "block int, n long, x array<double>").repartition(2, "block").mapInArrow(lm_scoring._add, "block int, n long, x array<double>").collect()
    given = np.concatenate([np.array(x.x).reshape(-1, lm.MIX) for x in sorted(found, key=lambda x: x.block)]).sum(axis=1)
    assert given[0] == pytest.approx(texts, abs=1e-3)
    assert all(given[vocab.place[i]] == pytest.approx(n, abs=1e-2) for i, n in count.items())
    assert {x.n for x in found} == {sum(count.values()) + texts}


def test_lm_gradients_and_maximisation():
    from termloom.llm import attention_lm as lm

    r = np.random.default_rng(1)
    x, y, of = lm.windows(r.integers(1, 9, 300).astype(np.int32), np.array([200, 100]))
    p = {k: v.astype(np.float64) for k, v in lm.initial(np.full(9, 1 / 9)).items()}
    value, grads = lm.gradients(p, x, y)
    for k, d in grads.items():
        for at in r.permutation(p[k].size)[:4]:
            if k == "word" and at % lm.MIX == 0:
                continue  # the unigram stays
            more = {**p, k: p[k].copy()}
            more[k].ravel()[at] += 1e-2
            less = {**p, k: p[k].copy()}
            less[k].ravel()[at] -= 1e-2
            assert (lm.gradients(more, x, y)[0] - lm.gradients(less, x, y)[0]) / 2e-2 == pytest.approx(d.ravel()[at], abs=3e-5)
    p, before = lm.initial(np.full(9, 1 / 9)), []
    for _ in range(4):
        before.append(lm.loss(p, x, y))
        given = np.zeros((9, lm.MIX))
        lm.expect(p, lm.distributions(p).astype(np.float32), x, y, np.ones_like(of, bool), given)
        p = lm.maximised(p, given, np.full(9, 1e-9))
    assert before == sorted(before, reverse=True)


def test_lm_is_better_than_frequencies_and_normalised():
    from termloom.llm import attention_lm as lm

    r = np.random.default_rng(0)
    cycle = np.tile([1, 2, 3, 4, 5], 400)  # the next one is certain
    x, y, of = lm.windows(cycle, np.array([1000, 1000]))
    assert (of >= 0).sum() == 2002
    p = lm.train(lm.initial(np.full(7, 1 / 7)), x, y, 150)
    assert lm.loss(p, x, y) < 0.5 < np.log(5)
    every = np.stack([lm.log_probabilities(p, lm.distributions(p).astype(np.float32), x[:2], np.full_like(y[:2], k)) for k in range(7)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    later = x.copy()
    later[:, -1] = r.integers(0, 7, len(x))  # what comes later changes nothing before
    a, b = (lm.log_probabilities(p, lm.distributions(p).astype(np.float32), z, y) for z in (x, later))
    assert np.allclose(a[:, :-1], b[:, :-1], atol=1e-5)


def test_clear(spark):
    from termloom.llm import common

    path = common.scratch(spark)
    spark.range(3).write.parquet(path)
    assert common.written(spark.range(2)).count() == 2
    common.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_lm_learns_from_every_id():
    """Pairs of ids are counted over all training texts, and gradient steps move attention and gates by whole texts: no part is sampled."""
    from termloom.llm import attention_lm as lm

    rows = [(0, " ".join(f"word{i % 70}" for i in range(3000))), (2, "the end"), (3, None), (1, "held out"), (None, "a")]
    sub, count = lm_scoring.Subwords(PATH), Counter()
    ids = [sub.many(lm_scoring.words_of((t or "").encode()))[0] for i, t in rows if not lm_scoring.held_out(i)]
    count.update(np.concatenate(ids).tolist())
    vocab = lm_scoring.Vocabulary(sub.size, dict(count), len(ids))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t and t.encode() for _, t in rows], pa.binary())], ["id", "t"])
    size, got = len(vocab.unigram), Counter()
    blocks = -(-size // lm_scoring.BLOCK)
    for b in lm_scoring._add_pairs(size)(lm_scoring._pairs(PATH, vocab)(iter([batch]))):
        block, at, n = (c[0].as_py() for c in b.columns)
        for k, m in zip(np.frombuffer(at, np.int32).tolist(), np.frombuffer(n, np.int64).tolist(), strict=True):
            got[block // blocks, *divmod(k + block % blocks * lm_scoring.BLOCK * size, size)] += m
    want = Counter()
    for x in ids:
        stream = [0] * lm.CONTEXT + vocab.place[x].tolist() + [0]
        want.update((i, stream[k - apart], stream[k]) for k in range(lm.CONTEXT, len(stream)) for i, apart in enumerate(lm.APART))
    assert got == want
    p = lm.initial(vocab.unigram)
    found = [r for b in lm_scoring._expect(PATH, vocab, p)(iter([batch])) for r in b.to_pylist()]
    n, flat, lo = found[0]["n"], np.concatenate([r["x"] for r in found if r["block"] >= blocks]), 0
    assert n == sum(count.values()) + len(ids)
    for k in sorted(set(p) - {"word"}):
        assert np.abs(flat[lo : lo + p[k].size] / n - p[k].ravel()).max() > 1e-3
        lo += p[k].size


def test_lm_reads_texts_once(spark, monkeypatch):
    """All that learns and scores reads the ids that were encoded once, and these are the ids of whole texts, of any length, null and empty ones too."""
    from termloom.llm import attention_lm as lm

    seen, trained = [], lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", lambda rows, path, vocab, size: seen.append((vocab, rows.columns, {x.id: bytes(x.places) for x in rows.collect()})) or trained(rows, path, vocab, size))
    monkeypatch.setattr(lm_scoring, "BATCH", 2000)
    rows = [(0, " ".join(f"word{i % 70}" for i in range(3000))), (2, "The end"), (3, None), (1, "held out zebra"), (4, ""), (5, "é  x\ty")]
    lm_scoring.lm_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), PATH, vocabulary=30, frequent=4).collect()
    vocab, columns, places = seen[0]
    assert columns == ["id", "places"]
    sub = lm_scoring.Subwords(PATH)
    want = {i: vocab.place[sub.many(lm_scoring.words_of((t or "").encode()))[0]] for i, t in rows}
    assert {i: np.frombuffer(x, vocab.kind).tolist() for i, x in places.items()} == {i: x.tolist() for i, x in want.items()}
    raw = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t and t.encode() for _, t in rows], pa.binary())], ["id", "t"])
    stored = pa.RecordBatch.from_arrays([raw.column(0), pa.array([places[i] for i, _ in rows], pa.binary())], ["id", "places"])
    a, b = ([np.concatenate(z) for z in zip(*[(x[t >= 0], y[t >= 0]) for x, y, t in ((x[:, lm.CONTEXT :], y, t) for x, y, t in lm_scoring._training(PATH, vocab, iter([batch])))], strict=True)] for batch in (raw, stored))
    assert all(map(np.array_equal, a, b)) and len(b[1]) == sum(len(x) + 1 for i, x in want.items() if not lm_scoring.held_out(i))


def test_lm_adds_rows_up_by_place():
    """Ids with one row, with a few and with more than are one product; room that a call leaves behind changes nothing in the next."""
    from termloom.llm import attention_lm as lm

    r = np.random.default_rng(5)
    at = np.repeat([7, 3, 0, 8, 5], [1, 2, lm.FEW, lm.FEW + 1, 2 * lm.PART + 3])
    r.shuffle(at)
    rows, want = r.normal(size=(len(at), 3)), np.zeros((9, 3))
    np.add.at(want, at, rows)
    some, sums = lm._by_place(9, at, rows)
    assert sorted(some) == [0, 3, 5, 7, 8] and np.allclose(sums, want[some])
    x, y, _ = lm.windows(r.integers(1, 9, 9000).astype(np.int32), np.array([8000, 1000]))
    p, room = lm.initial(np.full(9, 1 / 9)), {}
    for some in (slice(0, 200), slice(200, 210), slice(100, 290)):
        alone, kept = lm.gradients(p, x[some], y[some]), lm.gradients(p, x[some], y[some], room=room)
        assert alone[0] == kept[0] and all(np.array_equal(alone[1][k], kept[1][k]) for k in alone[1])
