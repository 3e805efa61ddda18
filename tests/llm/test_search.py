"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from balanza.llm import search

DOCS = "doc_id bigint, text string, score bigint, rank int, item_id bigint, shard bigint"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    found = [(i, terms_of(t)) for i, t in docs]
    found = [(i, ts) for i, ts in found if ts]
    total, words = len(found), sum(len(ts) for _, ts in found)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, own in wanted.items():
        weights = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in ts for _, ts in found) + 1))) for t in own}
        scored = []
        for doc, ts in found:
            m = 100 - 90 + 90 * len(ts) * total // words
            score = sum(w * (1_000_000_000 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t, w in weights.items() if t in ts)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def check(spark, docs, items, k=10):
    left = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id bigint, text string, term string, doc_id int")
    assert sorted((tuple(r) for r in search.search(left, right, k).collect()), key=repr) == brute(docs, items, k)


def texts(n, seed):
    chance = random.Random(seed)
    words = [f"w{int(chance.paretovariate(0.7))}" for _ in range(400)]
    return [" ".join(chance.choice(words) for _ in range(chance.randrange(60))) for _ in range(n)]


def test_ranks_of_all_documents(spark):
    docs = list(enumerate(texts(700, 5)))
    docs += [(1000, None), (1001, ""), (1002, " -!{}~\x7f"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (3, docs[3][1]), (3, docs[3][1])]
    docs += [(1003, "É漢字É9 W1\x00w1 ſ K"), (1004, "w1 w5 " * 40_000), (1005, docs[8][1]), (1006, docs[8][1].upper())]
    items = list(enumerate(texts(12, 6))) + [(50, None), (51, ""), (52, "!"), (None, "w2 w9"), (53, "É漢字é9 nowhere"), (54, "w1"), (54, "W7")]
    check(spark, docs, items)


def test_hot_term_ties_and_few_documents(spark):
    check(spark, [(i, "same text here") for i in range(300)] + [(900, "other")], [(1, "same"), (2, "other"), (3, "text other")])
    check(spark, [(7, "alone")], [(1, "alone"), (2, "gone")])


def test_empty_tables(spark):
    some = [(1, "a b")]
    check(spark, [], some)
    check(spark, some, [])
    check(spark, [(1, None)], some)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_CHARS", 60)
    check(spark, list(enumerate(texts(200, 8))), list(enumerate(texts(9, 9))))


@pytest.mark.parametrize("short", [0, 1 / 32, 1 / 4, 1])
def test_walk_of_one_shard(monkeypatch, short):
    monkeypatch.setattr(search, "WINDOW", 64)
    monkeypatch.setattr(search, "SHORT_PART", short)
    chance = np.random.default_rng(3)
    n, windows = 5000, -(-5000 // 64)
    for trial in range(60):
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(chance.integers(0, 9)):
            docs = np.flatnonzero(chance.random(n) < chance.choice([0.001, 0.01, 0.1, 0.6]))
            adds = (chance.pareto(1, len(docs)) * chance.choice([1, 30, 500])).astype(np.int64) if trial % 2 else np.full(len(docs), 7)
            lists.append(search.Postings(docs, adds, windows))
            total[docs] += adds
        docs, scores = search.best_of(lists, n, 10)
        want = [d for d in np.lexsort((np.arange(n), -total))[:10] if total[d] > 0]
        assert list(docs) == want and list(scores) == [total[d] for d in want]


def test_long_lists_are_skipped(monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 64)
    n, chance = 20_000, np.random.default_rng(1)
    rare, common = np.sort(chance.choice(n, 40, replace=False)), np.flatnonzero(chance.random(n) < 0.7)
    lists = [search.Postings(rare, np.full(40, 900), -(-n // 64)), search.Postings(common, chance.integers(1, 50, len(common)), -(-n // 64))]
    looked = []
    search.best_of(lists, n, 10, looked)
    assert sum(looked) < len(common) / 20
