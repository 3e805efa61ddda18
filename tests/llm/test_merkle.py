"""Merkle manifests against a plain recursive computation."""

import hashlib
import zlib

import pytest

from balanza.llm import merkle

ROWS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, idx int, hash string, path int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """(root, path of siblings of each leaf)."""
    paths, spots, nodes = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(nodes) > 1:
        for path, spot in zip(paths, spots):
            run = nodes[spot // 16 * 16 : spot // 16 * 16 + 16]
            path.append(("".join(run[: spot % 16]), "".join(run[spot % 16 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        spots = [s // 16 for s in spots]
    return nodes[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for members in by_source.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {s: tree([leaf(r) for r in by_source[s]]) for s in names}
    root, above = tree([built[s][0] for s in names])
    out = []
    for s, upper in zip(names, above):
        for row, lower in zip(by_source[s], built[s][1]):
            path = lower + upper
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if changed else row[4]
            now = leaf((*row[:4], low))
            for left, right in path:
                now = sha(left + now + right)
            out.append((row[0], leaf(row), built[s][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 1, "h", 2) for r in rows], ROWS)
    got = sorted((tuple(r) for r in merkle.verification(docs).collect()), key=repr)
    assert got == brute(rows)
    return got


@pytest.mark.parametrize("blocks", [8, 2])
def test_hot_source_nulls_repeats_and_long_texts(spark, monkeypatch, blocks):
    monkeypatch.setattr(merkle, "BLOCK_BITS", blocks)
    rows = [(i, "hot", "en", i, f"Text {i} É") for i in range(4400)]
    rows += [(i, f"s{i % 20}", None, None, None if i % 3 else "") for i in range(5000, 5340)]
    rows += [(None, None, None, None, None), (None, None, None, None, "A"), (7, None, "x", 0, "B" * 300_000)]
    rows += [(9000, "twice", "en", 1, "Same")] * 40 + [(9001, "", "en", 1, "alone"), (9002, "é", "en", 1, "1:x-")]
    got = check(spark, rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 257])
def test_heights(spark, count):
    check(spark, [(i, "one", "en", i, "X") for i in range(count)])


def test_many_lone_sources(spark):
    check(spark, [(i, f"s{i}", "en", i, "X") for i in range(300)])


def test_empty(spark):
    assert merkle.verification(spark.createDataFrame([], ROWS)).count() == 0
