"""Language codes, periodic runs and spelling variants against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeperil.llm import language_codes, periodic_runs, queries, spelling, toxicity
from codeperil.llm.periodic_runs import Runs
from codeperil.llm.spelling import Variants

SMALL, TABLES = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
#: Names of columns that the operators use themselves.
DOCS = "doc_id long, text string, lang string, runs string, word string, n long, score double, language string"


def frame(spark, texts, ids=None, lang=None):
    rows = [(i if ids is None else ids[i], t, lang[i] if lang else None, "x", "y", -1, -2.0, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# 11


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 30, 200])
def test_codewords_are_far_apart(n):
    code = language_codes.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    brute = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert language_codes.distance(code) == brute
    assert brute >= (1 << n - 2 if n <= 7 else code.shape[1] // 5)
    assert not (np.abs(code.sum(0, dtype=int)) == n).any()
    assert (language_codes.codewords(n) == code).all()


def test_grams_of_slices_and_batches_are_those_of_each_text(monkeypatch):
    r = random.Random(3)
    texts = ["", "a", "..", "Éa bC", "x" * 50, " q ", *("".join(r.choice("abé .Z9") for _ in range(r.randint(0, 90))) for _ in range(60))]

    def plain(text):
        runs = re.findall(r"[^\W\d_]+", text.lower())
        full = "".join(f" {w}" for w in runs) + " " * bool(runs)
        return sum(max(0, len(full) - n + 1) for n in language_codes.ORDERS)

    weights = np.random.default_rng(1).normal(size=(language_codes.BINS + 1, 3)).astype(np.float32)
    weights[-1] = 0
    together, known = language_codes.means(texts, weights)
    apart = [language_codes.means([t], weights)[0][0] for t in texts]
    assert np.allclose(together, apart, atol=1e-5)
    assert known.tolist() == [any(c.isalpha() for c in t) for t in texts]
    assert language_codes.gram_counts(language_codes.folded(texts)[1]).tolist() == [plain(t) for t in texts]
    monkeypatch.setattr(language_codes, "SLICE", 7)
    assert np.allclose(language_codes.means(texts, weights)[0], together, atol=1e-5)


@needs_tables
def test_held_out_documents_get_their_language(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = queries.op11_language_codes(spark, TABLES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert len(held) > 200 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.985
    assert all(0 <= r["score"] <= 1 for r in rows)


@needs_tables
def test_languages_of_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = docs.withColumn("lang", F.when(language_codes.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language_codes.learn_codes(docs), language_codes.learn_codes(other)
    assert a.languages == b.languages == ("de", "en", "es", "fr")
    assert (a.weights == b.weights).all() and (a.trust == b.trust).all()


def test_languages_of_odd_texts(spark):
    def text(letters, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60))

    texts, langs = [], []
    for i in range(120):
        kind = i % 3
        texts.append(text(("abcde", "efghi", "ijklm")[kind], i))
        langs.append(("a", "b", None)[kind])
    more = [None, "", " \n", "12 !?", "ab", text("abcde", 500) * 300, text("abcde", 1) + text("efghi", 2), "日本", "a\0b"]
    docs = frame(spark, [*texts, *more, texts[0]], ids=[*range(120), *range(1000, 1000 + len(more)), 0], lang=[*langs, *["a"] * len(more), "a"])
    model = language_codes.learn_codes(docs)
    assert model.languages == ("a", "b")
    rows = language_codes.identify_languages(docs, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    assert [by[i]["lang_pred"] for i in range(1000, 1004)] == ["und"] * 4 and all(by[i]["score"] == 0.0 for i in range(1000, 1004))
    assert by[1004]["lang_pred"] == by[1005]["lang_pred"] == "a" and by[1007]["lang_pred"] in ("a", "b")
    assert all(by[i]["lang_pred"] == langs[i] for i in range(120) if langs[i])
    assert by[1006]["score"] < by[1005]["score"]
    none = language_codes.learn_codes(docs.where("false"))
    assert {r["lang_pred"] for r in language_codes.identify_languages(docs, none).collect()} == {"und"}
    assert language_codes.identify_languages(docs.where("false"), model).count() == 0
    one = language_codes.learn_codes(docs.where("lang = 'a'"))
    assert {r["lang_pred"] for r in language_codes.identify_languages(docs, one).collect()} == {"a", "und"}
    unknown = frame(spark, ["abc ab", None], ids=[None, None])
    assert language_codes.identify_languages(unknown, model).count() == 2


def test_wrong_bits_are_corrected_and_flagged():
    code = language_codes.codewords(5)
    curves = np.array([[1.0, 0.0]] * code.shape[1])
    model = language_codes.CodeModel(tuple("abcde"), code, np.zeros((1, 1)), curves, np.full(code.shape, 1 / code.shape[1]))
    for language in range(5):
        x = code[language] * 4.0
        x[:3] *= -1  # the code has distance 8 and corrects 3
        best, score, _, unsure = language_codes.decode(x[None], model)
        assert best[0] == language and score[0] > 0.6 and not unsure[0]
        x[3:5] *= -1
        assert language_codes.decode(x[None], model)[3][0]


# 12


def brute_runs(words, how):
    """Every stretch of equal words q apart, for every q; of equal stretches the smallest q."""
    seen = {}
    for q in range(1, len(words) // how.exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(how.least_words, how.exponent * q):
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    r = random.Random(1)
    for _ in range(2500):
        how = Runs(r.choice([2, 3, 5, 6, 8]), r.choice([2, 3, 4]))
        kinds = r.choice([1, 2, 3, 5])
        words = [bytes([97 + r.randrange(kinds)]) for _ in range(r.randint(0, 60))]
        if words and r.random() < 0.5:
            a = r.randrange(len(words))
            p = 1 + r.randrange(max(1, (len(words) - a) // 2))
            words = words[:a] + (words[a : a + p] * 60)[: len(words) - a]
        assert periodic_runs.text_runs(words, how) == brute_runs(words, how), (words, how)


def brute_row(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words, Runs())
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@needs_tables
def test_runs_of_every_document(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op12_periodic_runs(spark, SMALL).select(*COLUMNS).collect()
    want = {r["doc_id"]: brute_row(r["doc_id"], r["text"]) for r in docs}
    assert len(found) == len(docs) and sum(r["n_runs"] > 0 for r in found) > 10
    for r in found:
        assert tuple(r) == want[r["doc_id"]]


def test_runs_of_odd_texts(spark):
    repeat = " ".join(["one two\x0bthree"] * 400)
    texts = [None, "", " \t\r\n ", "a a a a a", "a a a a a a", "a\x1ca\x1ca\x1ca\x1ca\x1ca", "ab\xa0" * 9, "x y z " * 5 + "x q", "É é " * 8, repeat, "a " * 2_000, "a a a a a a"]
    ids = [*range(11), 4]
    docs = frame(spark, [*texts, *texts], ids=[*ids, *[None] * 12])
    rows = periodic_runs.summarised(periodic_runs.find_runs(docs, edit=periodic_runs.planted)).select(*COLUMNS).collect()
    assert len(rows) == 24
    want = Counter(brute_row(i, t) for i, t in zip([*ids, *[None] * 12], [*texts, *texts], strict=True))
    assert Counter(tuple(r) for r in rows) == want
    plain = {r["doc_id"]: r for r in periodic_runs.find_runs(frame(spark, texts)).collect()}
    assert plain[9]["collapsed"] == "one two three" and plain[9]["runs"][0].asDict() == {"start": 0, "length": 1200, "period": 3}
    assert plain[7]["collapsed"] == "x y z q" and plain[0]["collapsed"] == "" and plain[5]["n_words"] == 1
    assert periodic_runs.summarised(periodic_runs.find_runs(docs.where("false"))).count() == 0


@pytest.mark.parametrize("kind", ["one word", "seven words", "two words at random", "five copies"])
def test_long_texts_that_repeat_take_little_time(kind):
    n, r = 200_000, random.Random(2)
    words = {"one word": [b"a"] * n, "seven words": [b"%d" % (i % 7) for i in range(n)], "two words at random": [b"%d" % r.randrange(2) for _ in range(n)], "five copies": [b"%d" % i for i in range(n // 5)] * 5}[kind]
    began = time.time()
    runs = periodic_runs.text_runs(words, Runs())
    assert time.time() - began < 60
    if kind != "two words at random":
        assert runs == [(0, n, {"one word": 1, "seven words": 7, "five copies": n // 5}[kind])]


def test_end_positions_stay_in_order():
    r = random.Random(5)
    numbers = r.sample(range(100_000), 5000)
    ends, known = periodic_runs.EndPositions(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        below, above = max((y for y in known if y < x), default=-1), min((y for y in known if y > x), default=-1)
        if len(known) % 50 == 0 or len(known) > 4900:
            assert ends.neighbours(x) == (below, above)
        ends.add(x)
        known.append(x)
    assert list(ends) == sorted(known) and ends.size == 5000 and max(map(len, ends.blocks)) < 2 * periodic_runs.BLOCK


# 13


def brute_counts(docs):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, how):
    words = {w: n for w, n in counts.items() if len(w) >= how.least_length and n >= how.least_count}
    near = {w: [] for w in words}
    some = sorted(words)
    for i, a in enumerate(some):
        for b in some[:i]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= how.factor * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@needs_tables
def test_variants_of_every_word(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_counts(docs), Variants())
    assert variant_rows(queries.op13_spelling_variants(spark, SMALL)) == want
    assert len(want) > 500 and sum(r[1] is not None for r in want) > 10


@pytest.mark.parametrize(("most_words", "q"), [(512, 2), (3, 2), (1, 1), (2, 3), (40, 4)])
def test_variants_of_random_words(spark, most_words, q):
    r = random.Random(most_words)
    counts = Counter()
    while len(counts) < 500:  # many neighbours, doubled letters and long chains
        word = "".join(r.choice("abÿ") for _ in range(r.choice([2, 3, 4, 5, 5, 6, 6, 7, 8])))
        counts[word] = r.choice([1, 2, 3, 16, 81, 400, 2000, 10**4, 10**6])
    counts["a" * 3000] = counts["a" * 3001] = 7
    how = Variants(least_length=3, least_count=2, q=q, most_words=most_words)
    words = spark.createDataFrame([*counts.items(), (None, 5), ("null", None), ("twice", 1), ("twice", 1)], "word string, n long")
    counts["twice"] = 2
    want = brute_variants(counts, how)
    assert variant_rows(spelling.variant_groups(words, how)) == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_words_of_odd_texts(spark):
    long = " ".join(["lengthy", "Lengthy", "lengthx"] * 3000)
    texts = [None, "", "12 .", "straße STRASSE Straße straÞe ×÷×÷×÷", "naïveté naïveté" * 3, "abcdefg" * 40, long, "Éclairs éclairs Éclairs"] * 6
    ids = [i % 9 if i % 5 else None for i in range(len(texts))]
    rows = variant_rows(spelling.spelling_variants(frame(spark, texts, ids=ids), edit=spelling.with_slips))
    assert rows == brute_variants(brute_counts(zip(ids, texts, strict=True)), Variants())
    assert any(r[0] == "éclairs" for r in rows) and any(r[0] == "Éclairs" for r in rows)
    assert variant_rows(spelling.spelling_variants(frame(spark, texts, ids=ids).where("false"))) == set()


# 7


@pytest.mark.parametrize("text", ["a" * 1_000_000, "汉" * 500_000, "1" * 1_000_000, "@" * 1_000_000, "a1" * 500_000, "a2" * 500_000, "e4t " * 250_000, "ab1!" * 250_000, "é\u0301" * 300_000])
def test_folding_takes_time_in_proportion(text):
    began = time.time()
    toxicity.fold(text)
    assert time.time() - began < 5


def test_disguises_are_found_as_before():
    plain = re.compile(r"[^\W\d_]*[0134578 9@$!|+](?:[0134578 9@$!|+]|[^\W\d_])*".replace(" ", ""))
    r = random.Random(6)
    for _ in range(20_000):
        text = "".join(r.choice("ab1 2!_é@汉.") for _ in range(r.randrange(14)))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in toxicity._DISGUISED.finditer(text)], text


def test_hits_with_many_exceptions():
    lexicon = toxicity.Lexicon({"bad": 2.0, "worse*": 1.0}, ("not bad", "bad idea not", "so worsening"))
    matcher = toxicity.Matcher(lexicon)
    text = toxicity.fold("not bad bad idea not bad worse so worsening worst " * 20_000)
    began = time.time()
    found = matcher.hits(text)
    assert time.time() - began < 5
    few = toxicity.fold("not bad bad idea not bad worse so worsening worst " * 3)
    spared = [(a, a + len(p) + 1) for p in lexicon.exceptions for a in [m.start() for m in re.finditer(f"(?= {p} )", few)]]
    hits = sorted([(m.start(), 2.0) for m in re.finditer("(?= bad )", few)] + [(m.start(), 1.0) for m in re.finditer("(?= worse)", few)])
    assert matcher.hits(few) == [(s, w) for s, w in hits if not any(a <= s < b for a, b in spared)]
    assert len(found) == 20_000


def test_spans_share_tables_of_powers():
    """The tables of powers are kept, and spans don't depend on which text came first."""
    from codeperil.llm import substring_dedup

    long, short = " ".join(f"Word{i} goes on here today." for i in range(300)), "One two three. Four five six seven. Eight nine ten eleven."
    how = substring_dedup.PRODUCTION
    first = [substring_dedup.Splitter(how).spans(t) for t in (short, long)]
    again = [substring_dedup.Splitter(how).spans(t) for t in (long, short)][::-1]
    assert all((x == y).all() for a, b in zip(first, again, strict=True) for x, y in zip(a, b, strict=True))
    table = substring_dedup._powers(substring_dedup._FACTOR, 5)
    assert table.tolist() == [pow(substring_dedup._FACTOR, i, 1 << 64) for i in range(6)]
    assert substring_dedup._n_words("İ A b c", False) == len(substring_dedup._words("İ A b c", False)) == 4


def test_spans_by_places_of_words_equal_those_word_by_word(monkeypatch):
    import random

    from codeperil.llm import substring_dedup

    draw = random.Random(7)
    letters = list("aBcé   ,;.!?\n\t\x1f\xa0…'\")")
    texts = ["", " ", "\n\n", "a. b", "Word " * 90, "... end.)\" \n next. " * 9, "İ A. b c. " * 9, "no end " * 30 + ",\n" + "q, " * 50]
    texts += ["".join(draw.choices(letters, k=draw.randint(1, 900))) for _ in range(200)]
    splitter = substring_dedup.Splitter(substring_dedup.PRODUCTION)
    placed = [(splitter.sentences(t), [x.tolist() for x in splitter.spans(t)]) for t in texts]
    assert substring_dedup._spaced(texts[3]) is not None
    assert [substring_dedup._spaced(t) for t in ("İ a", "ΑΣ a", "漢 a", "a，b")] == [None] * 4
    monkeypatch.setattr(substring_dedup, "_spaced", lambda text: None)
    assert placed == [(splitter.sentences(t), [x.tolist() for x in splitter.spans(t)]) for t in texts]
