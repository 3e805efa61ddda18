"""Near copies, repeated strings, leaked passages and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from balanza.llm import decontaminate, graph, jaccard, queries, repeats
from balanza.session import scratch_path

DOCS = "doc_id bigint, text string, n_bytes int, root int, point string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0, "p") for i, t in enumerate(texts)], DOCS)


def brute_classes(texts, words, share):
    def shingles(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root)]


@pytest.mark.parametrize("words, share", [(3, 90), (5, 80)])
def test_jaccard_against_all_pairs(spark, words, share):
    chance = random.Random(3)
    pool = [f"w{i}" for i in range(400)]
    base = [[chance.choice(pool) for _ in range(chance.randint(1, 150))] for _ in range(12)]
    texts = [None, "", " \t", "A b", "a  B", "a b c"]
    for words_of in base:
        for _ in range(6):
            own = [chance.choice(pool) if chance.random() < 0.01 else w for w in words_of]
            texts.append(" ".join(own))
    texts += [texts[-1]] * 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(table(spark, texts), words, share, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, words, share)
    assert jaccard.classes(table(spark, [])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (5, 5), (20, 21), (20, 21)]
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


@pytest.mark.parametrize("a_task", [200_000, 10])
def test_components_of_chains_stars_and_chance(spark, monkeypatch, a_task):
    monkeypatch.setattr(graph, "EDGES_A_TASK", a_task)
    chance = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(30)] + [(299, 200 + i) for i in range(30)]
    edges += [(chance.randrange(1000, 1100), chance.randrange(1000, 1100)) for _ in range(60)] + [(-5, 3), (700, 700)]
    root = {}
    for e in edges:
        for v in e:
            root.setdefault(v, v)
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {v: low if r == high else r for v, r in root.items()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    chance.shuffle(edges)
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect())
    assert got == {v: root[v] for v in linked}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_jaccard_of_null_and_repeated_keys(spark):
    chance = random.Random(2)
    pool = [f"w{i}" for i in range(300)]
    texts = [" ".join(chance.choice(pool) for _ in range(60)) for _ in range(40)]
    texts += [f"{t} tail" for t in texts[:20]] + texts[:10]
    keys = [None if i % 3 else (i // 30) for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(keys, texts)), "doc_id bigint, text string")
    got = sorted((tuple(r) for r in jaccard.classes(docs).collect()), key=repr)
    want = []
    for key, (n, first) in zip(keys, brute_classes(texts, 5, 80)):
        members = [k for k, (_, r) in zip(keys, brute_classes(texts, 5, 80)) if r == first and k is not None]
        want.append((key, n, min(members) if members else None))
    assert got == sorted(want, key=repr)
    # Rows that share a key are not joined with each other: each wanted set is read once.
    ranks = jaccard.frequency_classes(docs, 5)
    found = jaccard.points(docs, ranks, 5, 80, 100, "doc_id", "text")
    sets = jaccard.sets_of(docs, found, found.select("set_id").distinct(), 5, "doc_id", "text")
    assert sets.count() == len(set(texts))


def test_jaccard_of_long_texts(spark):
    chance = random.Random(6)
    long = [f"w{chance.randrange(5000)}" for _ in range(150_000)]
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), "short one here", "x " * 200_000]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(table(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == brute_classes(texts, 5, 80)


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        covered = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                covered[i : i + length] = True
        out.append(bytes(b for b, c in zip(r, covered) if not c))
    return out


def test_repeats_against_counting(spark):
    chance = random.Random(4)
    words = [f"é{i}" for i in range(300)]
    passage = " ".join(chance.choice(words) for _ in range(80))
    def prose(n):
        return " ".join(chance.choice(words) for _ in range(n))

    texts = [None, "", "short", prose(200), prose(50) + passage + prose(50), prose(9) + passage, "ab" * 400, prose(100) * 2]
    texts += [texts[3], texts[4][:300]]
    rows = repeats.remove_repeats(table(spark, texts)).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in rows] == brute_repeats(texts, repeats.LENGTH)
    assert [r["n_bytes"] - sum(s["stop"] - s["start"] for s in r["spans"]) for r in rows] == [len(r["kept"]) for r in rows]
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_transform_against_counting():
    chance = random.Random(5)
    for _ in range(60):
        length = chance.choice([8, 12, 20])
        pool = [bytes(chance.choice(b"ab") for _ in range(40)) for _ in range(3)]
        pieces = [chance.choice(pool)[: chance.randint(0, 40)] + chance.choice(pool) for _ in range(chance.randint(1, 5))]
        seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        for p, got in zip(pieces, repeats.repeated_windows(pieces, length)):
            assert got.tolist() == [seen[p[i : i + length]] > 1 for i in range(max(len(p) - length + 1, 0))]


def test_windows_of_equal_and_nested_pieces():
    chance = random.Random(9)
    passage = bytes(chance.randrange(97, 105) for _ in range(60))
    pieces = [bytes(chance.randrange(97, 105) for _ in range(chance.randrange(30))) + passage[chance.randrange(20) : 60 - chance.randrange(20)] for _ in range(40)]
    pieces += [passage] * 5 + [pieces[0]] * 2 + [b"a" * 80]
    pieces = [p for p in pieces if len(p) >= 12]
    seen = Counter(p[i : i + 12] for p in pieces for i in range(len(p) - 11))
    for piece, flags in zip(pieces, repeats.repeated_windows(pieces, 12)):
        assert flags.tolist() == [seen[piece[i : i + 12]] > 1 for i in range(len(piece) - 11)]
    assert [f.tolist() for f in repeats.repeated_windows([b"abcdefghijklmnop"], 12)] == [[False] * 5]


def test_decontamination(spark):
    chance = random.Random(6)
    def prose(n):
        return " ".join("".join(chance.choice("abcdefghij") for _ in range(chance.randint(2, 8))) for _ in range(n))

    item, other = prose(60), prose(60)
    edited = item[:50] + "Q" + item[51:100] + item[102:]
    texts = [None, "", prose(300), prose(40) + ". " + item.upper() + prose(40), prose(20) + " " + edited, item[: len(item) * 2 // 3], prose(20000) + other]
    benchmark = spark.createDataFrame([(7, item), (8, other), (9, "tiny"), (None, prose(60)), (10, None)], "item_id bigint, text string")
    rows = decontaminate.contamination(table(spark, texts), benchmark).orderBy("doc_id").collect()
    assert [r["item_ids"] for r in rows] == [[], [], [], [7], [7], [7], [8]]
    assert rows[3]["least_edits"] == 0 and [r["contaminated"] for r in rows] == [0, 0, 0, 1, 1, 1, 1]
    assert decontaminate.contamination(table(spark, []), benchmark).count() == 0
    assert decontaminate.contamination(table(spark, texts), benchmark.limit(0)).agg({"contaminated": "sum"}).first()[0] == 0


def test_decontamination_finds_short_items(spark):
    items = [
        (1, "What is the capital of France?"), (2, "中国的首都是哪一座城市？请选择正确的答案：北京"), (3, "Yes."), (4, "¿Qué es?"),
        (5, "長城"), (6, "7 + 5"), (7, "?!"), (8, "ha ha ha ha ha ha"), (9, "Yes."),
    ]
    cases = [
        ("so: what is  the CAPITAL of france", [1]), ("What is the capital of France", [1]), ("What is the capitol of France? Paris", [1]),
        ("What is the capital of Germany?", []), ("somewhat is the capital of france", []), ("What is the capital of Francesca", []),
        ("他问中国的首都是哪一座城市？请选择正确的答案：北京对吗", [2]), ("yesterday eyes", []), ("oh yes", [3, 9]), ("Yes", [3, 9]), ("qué es", [4]),
        ("我們登上長城看日出", [5]), ("17 5", []), ("(7, 5)", [6]), ("haha ha ha ha ha ha ha", [8]), ("?!", []), ("", []), (None, []),
    ]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contamination(table(spark, [t for t, _ in cases]), benchmark).orderBy("doc_id").collect()
    assert [(t, r["item_ids"]) for (t, _), r in zip(cases, rows)] == cases
    found = decontaminate.find(table(spark, ["oh yes", "(What is the capital of France)"]), benchmark).orderBy("doc_id").collect()
    assert [[(m["start"], m["stop"], m["edits"]) for m in r["matches"]] for r in found] == [[(3, 6, 0)] * 2, [(1, 30, 0)]]


def test_pipeline_stages_keep_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) < docs.count() and all(r["round_trip"] for r in out)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns


def prose(chance, n):
    return " ".join(f"{chance.choice('bcdfg')}{chance.randint(0, 999)}" for _ in range(n))


def copies_table(spark):
    """Repeated rows, null ids and near copies: (id, text, source), and the rows as a table."""
    chance = random.Random(8)
    clean, other, lone, bare, shared = (prose(chance, 120) for _ in range(5))
    rows = [
        (7, clean, "a"), (7, clean, "a"), (7, clean, "a"), (None, clean, "a"), (9, clean + " end", "a"),
        (3, other, "a"), (3, other + " more", "a"), (3, other, "b"), (4, other, "a"),
        (None, bare, "a"), (None, bare, "a"), (None, bare + " x", "a"), (None, lone, "a"),
        (5, None, "a"), (5, None, "a"), (None, "", "a"), (None, "", "a"),
        (11, prose(chance, 60) + " " + shared, "a"), (12, prose(chance, 60) + " " + shared, "a"),
        (13, shared[:400] + " " + prose(chance, 200), "a"), (7, prose(chance, 90), "a"),
    ]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return rows, spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], kinds)


def test_pipeline_keeps_one_row_of_each_class(spark):
    rows, docs = copies_table(spark)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs.repartition(3), "")
    got = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    classes, wordless = {}, []
    for row, (n, root) in zip(rows, brute_classes([t for _, t, _ in rows], 5, 80)):
        (classes.setdefault(root, []) if n else wordless).append(row)
    assert Counter(r for r in got if not r[1]) == Counter(wordless)
    worded = [r for r in got if r[1]]
    assert len(worded) == len(classes)
    for members in classes.values():
        least = min((i is None, i or 0) for i, _, _ in members)
        assert sum(r in members and (r[0] is None, r[0] or 0) == least for r in worded) == 1
    cut = corpus_pipeline.cut_repeats(spark, kept, "").collect()
    assert Counter((r["doc_id"], (r["text"] or "").encode()) for r in cut) == Counter(
        zip([i for i, _, _ in got], brute_repeats([t for _, t, _ in got], repeats.LENGTH))
    )
    assert sum(bool(r["text"]) and r["doc_id"] == 7 for r in cut) == 2


def test_pipeline_stages_return_their_input_columns(spark):
    """Columns named as what the operators add come out as they went in, at every stage."""
    rows, docs = copies_table(spark)
    extra = {
        "score": "x", "predicted": "no", "matches": "m", "text_id": "t", "ranges": "r", "kept": "k", "spans": "s",
        "n_bytes": "n", "row": "w", "columns": "c", "component_id": "d", "n_shingles": "h", "set_id": "i", "Point.a": "p",
    }
    wide = docs.withColumns({c: F.concat(F.lit(v), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("source")) for c, v in extra.items()})
    folder = scratch_path(spark, "stages-test")
    labels = [(i, int(i != 4), 0) for i in (3, 4, 7, 9, 11, 12)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, rows[9][1])], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and out.schema["n_chars"].dataType == wide.schema["n_chars"].dataType, name
        got = out.collect()
        plain = stage(spark, docs, folder).collect()
        assert got and Counter(tuple(r)[:5] for r in got) == Counter(tuple(r) for r in plain), name
        for r in got:
            own = f"{-1 if r['doc_id'] is None else r['doc_id']}{r['source']}"
            assert all(r[c] == v + own for c, v in extra.items()), name
    clean = [r for r in rows if rows[9][1] not in (r[1] or "")]
    left = corpus_pipeline.drop_contaminated(spark, wide, folder).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in left) == Counter(clean)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
