"""The pipeline's stages and the near-duplicate classes of whole small tables against brute force."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codeperil.llm import near_dup, quality, toxicity
from codeperil.llm.queries import op6_minhash_near_dup, vocabulary

SMALL, TABLES = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def brute_classes(spark, docs, how):
    """doc_id: the smallest identifier of its class, by weighted Jaccard of all pairs; and the number of pairs."""
    sketch, n = near_dup.document_frequency(docs, how)
    sampler, shingler = near_dup.Sampler(near_dup.idf_levels(sketch, n), how), near_dup.Shingler(how.width)
    ids, bags, totals = [], [], []
    for r in docs.select("doc_id", "text").collect():
        (hashes,), _ = shingler.shingles([(r["text"] or "").lower().encode()])
        keys, counts = np.unique(hashes, return_counts=True)
        level = sampler.level(keys).astype(float)
        ids.append(r["doc_id"])
        bags.append({int(k): (int(c), w) for k, c, w in zip(keys, counts, level, strict=True)})
        totals.append(float((counts * level).sum()))
    where = defaultdict(list)
    for n, bag in enumerate(bags):
        for k in bag:
            where[k].append(n)
    top = {n: n for n in range(len(ids))}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    pairs = 0
    for a, bag in enumerate(bags):
        shared = Counter()
        for k, (c, w) in bag.items():
            for b in where[k]:
                if b > a:
                    shared[b] += min(c, bags[b][k][0]) * w
        for b, s in shared.items():
            if s >= how.similarity * (totals[a] + totals[b] - s) - 1e-9:
                pairs += 1
                top[root(a)] = root(b)
    classes = defaultdict(list)
    for n in range(len(ids)):
        classes[root(n)].append(ids[n])
    return {i: min(c) for c in classes.values() for i in c}, pairs


def test_near_duplicates_of_a_whole_table_against_all_pairs(spark):
    want, pairs = brute_classes(spark, spark.read.parquet(f"{TABLES}/documents.parquet"), near_dup.NearDup())
    got = {r["doc_id"]: r["class_id"] for r in op6_minhash_near_dup(spark, TABLES).collect()}
    assert pairs > 50 and set(got) == set(want)
    assert sum(got[i] == c for i, c in want.items()) >= 0.99 * len(want)  # a pair at the limit may miss all bands
    linked = [i for i, c in want.items() if c != i]
    assert sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, SMALL)
        assert out.columns == first
        return out, {r["doc_id"]: r for r in out.collect()}

    rules = quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    measures = {r["doc_id"]: r for r in quality.with_measures(docs).collect()}
    kept, rows = step("quality rules", docs)
    want = set()
    for i, r in measures.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and not any(all(x.holds(r) for x in rule.literals) for rule in rules):
            want.add(i)
    assert set(rows) == want

    kept, rows = step("exact dedup", spark.createDataFrame(list(rows.values()), docs.schema))
    groups = defaultdict(list)
    for i in want:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), measures[i]["text"])].append(i)
    assert set(rows) == {max(g) for g in groups.values()}

    kept, classes = spark.createDataFrame(list(rows.values()), docs.schema), None
    classes, _ = brute_classes(spark, kept, near_dup.NearDup())
    kept, rows = step("MinHash near-dedup", kept)
    assert set(rows) == set(classes.values())

    before = rows
    kept, rows = step("PII surrogates", spark.createDataFrame(list(rows.values()), docs.schema))
    assert set(rows) == set(before) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    changed = [i for i in rows if rows[i]["text"] != before[i]["text"]]
    emails = re.compile(r"[\w.]+@[\w.-]+\.[a-z]{2,}")
    for i in rows:
        assert not set(emails.findall(before[i]["text"])) & set(emails.findall(rows[i]["text"]))
    assert changed and all(rows[i]["source"] == before[i]["source"] for i in rows)

    packed = stages["best-fit packing"](spark, spark.createDataFrame(list(rows.values()), docs.schema), SMALL).collect()
    tokenizer = Tokenizer.from_str(vocabulary())
    places = defaultdict(list)
    for r in packed:
        ids = [*tokenizer.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids, 0][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in packed} == set(rows)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in packed)
    assert len(places) <= -(-total // 2048) + 1


def test_the_whole_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.agg(F.count_distinct("doc_id")).first()[0] > 50


def naive_hits(lexicon, folded):
    """Every word against every entry; exceptions word by word."""
    words, at, places = folded.split(), 0, []
    for w in words:
        places.append(at)
        at += len(w) + 1
    spared = set()
    for phrase in lexicon.exceptions:
        own = phrase.split()
        for n in range(len(words) - len(own) + 1):
            if words[n : n + len(own)] == own:
                spared |= set(range(n, n + len(own)))
    out = []
    for n, (w, p) in enumerate(zip(words, places, strict=True)):
        fits = [x for e, x in lexicon.weights.items() if (w.startswith(e[:-1]) if e.endswith("*") else w == e)]
        if fits and n not in spared:
            out.append((p, max(fits)))
    return out


def test_the_automaton_finds_what_a_naive_scan_finds():
    r = np.random.default_rng(5)
    vocabulary_ = ["".join(r.choice(list("abc"), r.integers(1, 6))) for _ in range(60)]
    for _ in range(200):
        entries = r.choice(vocabulary_, 8, replace=False)
        weights = {e + ("*" if r.random() < 0.4 and len(e) > 1 else ""): float(r.integers(1, 9)) for e in entries}
        exceptions = tuple({" ".join(r.choice(vocabulary_, 2)) for _ in range(4)})
        lexicon = toxicity.Lexicon(weights, exceptions)
        folded = toxicity.fold(" ".join(r.choice(vocabulary_, 50)))
        assert toxicity.Matcher(lexicon).hits(folded) == naive_hits(lexicon, folded)
