"""Ranked search against a plain version that scores every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import queries, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            scored.append((-score, i is None, i or 0, i))
        best = [x for x in sorted(scored) if x[0] < 0][:k]
        yield from ((item, rank, i, -score) for rank, (score, _, _, i) in enumerate(best, 1))


def result(found):
    return sorted(map(repr, map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())))


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["Éa", "ß", "İ", "a_b", "a\x85b", "x" * 300, "\U0001f600"]
    say = lambda n: rng.choice([" ", "  ", "-", "\n", "\x00"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, say(rng.choice([0, 1, 3, 30, 300]))) for i in range(n)]
    docs += [(i + n, docs[i][1]) for i in range(0, n, 3)] + [docs[1], (docs[2][0], "the"), (None, docs[5][1]), (None, "the"), (n * 9, None), (n * 9 + 1, "-!"), (n * 9 + 2, "the " * 20_000)]
    items = [(i, say(rng.choice([0, 1, 2, 10, 80]))) for i in range(30)] + [(3, "the the w1"), (None, "w2 THE W3"), (77, None), (78, "nowhere"), (79, "ß ß")]
    return docs, items


@pytest.mark.parametrize("seed,n,k", [(0, 20, 3), (1, 300, 10), (2, 2500, 10)])
def test_search_against_a_plain_one(spark, seed, n, k):
    docs, items = made(seed, n)
    # each row of items is a query of its own, so rows that repeat an id come out side by side
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert result(search.search_documents(table, asked, k=k)) == sorted(map(repr, plain(docs, items, k)))


def test_blocks_of_queries_whole_vocabularies_and_one_index_for_many(spark, monkeypatch):
    docs, items = made(5, 200)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(repr, plain(docs, items)))
    index = search.build_index(table)
    assert index.terms is None and result(search.search(index, asked)) == want
    monkeypatch.setattr(search, "QUERIES", 7)
    assert result(search.search(index, asked)) == want
    monkeypatch.setattr(search, "VOCABULARY", 5)
    assert result(search.search_documents(table, asked)) == want
    with pytest.raises(ValueError):
        search.search(search.build_index(table, terms=np.array([1], np.int64)), asked)


def test_odd_tables(spark, docs, documents, nothing):
    items = [(1, "one"), (2, documents[20][1]), (3, "É w1")]
    asked = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in items], "item_id long, text string, doc_id long, score long, query long, `a.b` int")
    assert result(search.search_documents(docs, asked)) == sorted(map(repr, plain(documents, items)))
    assert search.search_documents(nothing, asked).isEmpty()
    assert search.search_documents(docs, asked.limit(0)).isEmpty()
    assert search.search_documents(spark.createDataFrame([(1, " - ")], "doc_id long, text string"), asked).isEmpty()


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(0)
    tf, lengths = rng.integers(1, 500, 10_000), rng.integers(25, 5000, 10_000)
    impacts = search._impacts(tf, lengths)
    steps = -(-impacts // search.STEP)
    assert steps.max() <= 255 and (search.STEP * steps >= impacts).all() and (search.STEP * (steps - 1) < impacts).all()


def test_query(spark, sf_dir):
    rows = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    assert result(queries.QUERIES["op13_ranked_search"](spark, sf_dir)) == sorted(map(repr, plain(rows("documents", "doc_id"), rows("benchmark", "item_id"))))
