"""Classifiers and decontamination against plain computations on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from balanza.llm import decontaminate, language, quality, toxicity

DOCS = "doc_id bigint, text string, score string, predicted string, matches int, features int"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "s", "p", 1, 2) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# Decontamination -----------------------------------------------------------------------------


def plain_fold(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip()


def least_edits(window, text):
    """Edits between the window and the nearest substring of a text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    letters = np.array(list(text))
    for i, c in enumerate(window, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (letters != c))
        new = np.empty(len(text) + 1, int)
        new[0] = i
        # new[j] = min over k <= j of best[k] + (j - k)
        new[1:] = np.minimum(np.minimum.accumulate(best - np.arange(1, len(text) + 1)) + np.arange(1, len(text) + 1), i + np.arange(1, len(text) + 1))
        row = new
    return int(row.min())


def test_decontamination_against_full_edit_distance(spark):
    chance = random.Random(21)
    words = ["".join(chance.choice("abcdefghij") for _ in range(chance.randint(2, 7))) for _ in range(200)]
    prose = lambda n: " ".join(chance.choice(words) for _ in range(n))
    items = [(i, prose(40)[: chance.randint(45, 118)].strip()) for i in range(12)] + [(50, prose(60))]
    windows = []
    for item, text in items:
        m = len(text)
        starts = [0] if m <= 120 else [*range(0, m - 120, 60), m - 120]
        windows += [(item, text[s : s + 120]) for s in starts]
    texts = []
    for _ in range(150):
        _, window = chance.choice(windows)
        letters = list(window)
        for _ in range(chance.randint(0, len(window) // 4)):
            at = chance.randrange(len(letters))
            letters[at : at + chance.randint(0, 1)] = [chance.choice("abcdefghij")] * chance.randint(0, 1)
        texts.append(f"{prose(20)} {''.join(letters).upper()} {prose(20)}")
    texts += [prose(60), None, "", texts[0], texts[0]]
    want = []
    for text in texts:
        folded = plain_fold(text)
        hits = {item for item, w in windows if folded and least_edits(w, folded) <= decontaminate.edit_budget(len(w))}
        want.append(sorted(hits))
    # Windows of fewer than EDGED_CHARS characters would ask for word edges too.
    assert min(len(w) for _, w in windows) >= decontaminate.EDGED_CHARS
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {i: [] for i in range(len(texts))}
    rows = decontaminate.contamination(table(spark, texts), benchmark).collect()
    for r in rows:
        got[r["doc_id"]] = r["item_ids"]
        assert r["contaminated"] == int(r["n_items"] > 0)
    assert [got[i] for i in range(len(texts))] == want and len(rows) == len(texts)
    assert 40 < sum(map(bool, want)) < 140


# Quality -------------------------------------------------------------------------------------


def plain_grams(data):
    return {((int.from_bytes(data[i : i + 3], "big") * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - quality.BUCKET_BITS) for i in range(len(data) - 2)}


def test_quality_features_ratios_and_dual(spark):
    texts = [b"abcabc abd", b"", b"xy", "ñandú ñandú ñandú".encode(), bytes(range(97, 123)) * 5]
    seen = np.zeros(quality.FEATURES, np.int64)
    rows = [quality.features_of(np.frombuffer(t, np.uint8), seen) for t in texts]
    for row, t in zip(rows, texts):
        assert len(set(row.tolist())) == len(row) and {x for x in row.tolist() if x < 1 << quality.BUCKET_BITS} == plain_grams(t)
    labels = np.array([1, 1, 0, 0, 1])
    ratio = quality.log_count_ratios(rows, labels)
    for feature in {x for r in rows for x in r.tolist()}:
        p = (quality.SMOOTHING + sum(feature in r for r, y in zip(rows, labels) if y)) / (2 * quality.SMOOTHING + 3)
        n = (quality.SMOOTHING + sum(feature in r for r, y in zip(rows, labels) if not y)) / (2 * quality.SMOOTHING + 2)
        assert ratio[feature] == pytest.approx(np.log(p / n))


def test_dual_descent_reaches_the_minimum():
    """The weights found leave no slope in the primal objective."""
    chance = np.random.default_rng(3)
    rows = [np.sort(chance.choice(40, chance.integers(2, 9), replace=False)) for _ in range(60)]
    values = [chance.normal(size=len(r)) for r in rows]
    signs = np.where(chance.random(60) < 0.5, 1.0, -1.0)
    weights = quality.dual_descent(rows, values, signs, epochs=3000)
    x = np.zeros((60, 41))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r], x[i, 40] = v, 1.0
    w = np.append(weights[:40], weights[-1])
    loss = lambda w: 0.5 * w @ w + quality.PENALTY * (np.maximum(0, 1 - signs * (x @ w)) ** 2).sum()
    slope = w - 2 * quality.PENALTY * x.T @ (signs * np.maximum(0, 1 - signs * (x @ w)))
    assert np.abs(slope).max() < 0.02 * max(1.0, np.abs(w).max())
    assert all(loss(w) <= loss(w + 0.05 * chance.normal(size=41)) + 1e-9 for _ in range(50))


# Toxicity ------------------------------------------------------------------------------------


def test_toxicity_features():
    lexicon = toxicity.Lexicon(words={"zork"}, stems=set())
    you, insult = sorted(toxicity.SECOND_PERSON)[0], sorted(toxicity.INSULTS)[0]
    text = f"Hello THERE {you} {insult} zork!!! plain words"
    got = toxicity.features_of(text, lexicon)
    words = toxicity.WORD.findall(text.lower())
    raw = text.encode()
    assert got[0] == 1 and got[1] == pytest.approx(1 / len(words)) and got[2] == 1 and got[3] == pytest.approx(1 / len(words))
    assert got[6] == 2  # both stand near the second person
    assert got[8] == pytest.approx(sum(chr(b).isupper() for b in raw) / len(raw))
    assert got[11] == pytest.approx(np.log1p(len(words)))
    assert toxicity.features_of("", lexicon)[:8] == [0.0] * 8 or not any(toxicity.features_of("", lexicon)[:8])


# Both classifiers ----------------------------------------------------------------------------


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_rows_and_repeats(spark, module, label):
    """Held-out labels teach nothing, repeated rows score alike, and unseen texts are told apart."""
    chance = random.Random(5)
    good = "river road field stone quiet evening letter garden winter bridge".split()
    bad = "you idiot stupid moron SHUT UP!!! $$$ loser idiots trash".split()
    texts = [" ".join(chance.choice(bad if i % 3 == 0 else good) for _ in range(25)) for i in range(240)]
    sign = [int((i % 3 == 0) == (label == "toxic")) for i in range(240)]
    own = [(i, s, s) for i, s in enumerate(sign)]
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % module.FOLDS == module.HELD_OUT}
    spoilt = [(i, 1 - s, 1 - s) if i in held else (i, s, s) for i, s, _ in own]
    docs = table(spark, texts + texts[:5] + texts[:5], [*range(240), *range(5), *[None] * 5])
    scores = []
    for rows in (own, spoilt):
        out = module.score(docs, module.fit_on_labels(docs.limit(240), labels(spark, rows)))
        assert {"doc_id", "matches", "score", "predicted"} <= set(out.columns) and out.count() == 250
        scores.append(sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(float(r["score"]), 9), int(r["predicted"])) for r in out.collect()))
    assert scores[0] == scores[1]
    by_id = {}
    for i, score, said in scores[0]:
        by_id.setdefault(i, set()).add((score, said))
    assert all(len(v) == 1 for i, v in by_id.items() if i >= 0)
    right = sum(said == sign[i] for i in held for _, said in by_id[i])
    assert right >= 0.95 * len(held)


# Language ------------------------------------------------------------------------------------


def test_language_filter_answers_and_odd_rows(spark):
    """Every n-gram that was taught is known to its languages, and repeats, long texts and clashing columns are fine."""
    chance = random.Random(14)
    words = {n: ["".join(chance.choice(a) for _ in range(6)) for _ in range(60)] for n, a in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "mnopqrst"))}
    rows = [(i, " ".join(chance.choice(words[n]) for _ in range(30)), n) for i, n in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows * 2 + [(5, rows[5][1], "aa"), (None, "abc", "aa"), (7, None, "bb")], "doc_id bigint, text string, lang string")
    filters = language.learn(docs.where("doc_id != 5"))
    taught = [(t, n) for i, t, n in rows if i != 5 and zlib.crc32(str(i).encode()) % language.FOLDS != language.HELD_OUT]
    grams = Counter((int(h), n) for t, n in taught for _, _, found, _, _ in language.steps(pa.array([t])) for h in set(found.tolist()))
    spoken = Counter(h for h, _ in grams)
    common = [(h, n) for (h, n), times in grams.items() if times >= 10 and spoken[h] == 1]
    assert len(common) > 300
    for h, n in common:
        place = filters.languages.index(n)
        assert all(int(filters.masks[0][s[0]]) >> place & 1 for s in language.slots_of(np.array([h], np.uint64)))
    texts = [rows[0][1]] * 3 + [" ".join(words["cc"]) * 400, "", None, "12 ?"]
    asked = spark.createDataFrame([(1, t, "x", 3) for t in texts], "doc_id bigint, text string, lang_pred string, score int")
    got = [(r["lang_pred"], r["score"]) for r in language.predict(asked, filters).collect()]
    assert len({g for g in got if g[0] == "aa"}) == 1 and Counter(g[0] for g in got) == {"aa": 3, "cc": 1, "und": 3}
    assert all(0 <= s <= 1 for _, s in got) and language.predict(asked.limit(0), filters).count() == 0
