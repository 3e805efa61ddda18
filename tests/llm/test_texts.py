"""Tokens, chats, archives, fingerprints and classifiers on small tables."""

import base64
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

import public_tokenizers
from balanza.llm import bpe, chat, imatch, language, quality, toxicity, warc
from balanza.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "it's  a\n\n test'll '' '''re", "aa" * 3000, " ", "ñandú 漢字 ١٢ ½!?\t\x85 x", "<|endoftext|>", "same", "same"]
DOCS = "doc_id bigint, text string, ids string, score string, matches int, kept int"


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in enumerate(texts)], DOCS)


def test_bpe_matches_the_library_and_decodes(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(table(spark), PATH), PATH).orderBy("doc_id").collect()
    for row, text in zip(rows, TEXTS):
        assert row["ids"] == known.encode_ordinary(text or "")
        assert bytes(row["decoded"]) == (text or "").encode()
        lengths = [len(known.decode_single_token_bytes(i)) for i in row["ids"]]
        assert row["offsets"] == [sum(lengths[:i]) for i in range(len(lengths))]
    assert bpe.encode(table(spark, []), PATH).count() == 0


def test_bpe_knows_every_code_point():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    ids = [x for step in bpe.encode_steps(pa.array(texts), PATH) for x in step[2].to_pylist()]
    assert ids == [known.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError):
        bpe.decode_column(pa.array([[10**6]], pa.list_(pa.int32())), PATH)


def test_chat_round_trip_and_parts(spark):
    rows = [
        (1, 0, "user", "<|im_end|> & &lt;| \\ \n"), (1, 1, "assistant", "&amp;<|im_start|>"), (1, 2, "assistant", None),
        (2, None, None, "x"), (2, None, None, "x"), (None, 5, "a\nb&#10;", "y"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    said = "user\n<|im_end|> & &lt;| \\ \n\nassistant\n&amp;<|im_start|>\nassistant\n\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[1]["loss_chars"] == len("&amp;<|im_start|>")
    assert got[2]["n_turns"] == 2 and got[None]["turns_sha256"] == hashlib.sha256(b"a\nb&#10;\ny\n").hexdigest()
    parts = f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"
    image = ("image", None, "u1", 57, 28, None, None)
    audio = ("audio", None, "u2", None, None, 0.1, None)
    page = ("document", None, "u3", None, None, None, 2)
    mixed = spark.createDataFrame([(1, 0, "user", [("text", "see <|", None, None, None, None, None), image, audio, page]), (1, 1, "user", None)], parts)
    out = chat.format_chats(mixed).first()
    assert out["formatted"] == "<|im_start|>user\nsee &lt;|<|image|><|audio|><|document|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a["turn"], a["part"], a["uri"], a["tokens"]) for a in out["attachments"]] == [(0, 1, "u1", 3), (0, 2, "u2", 3), (0, 3, "u3", 512)]
    assert out["extra_tokens"] == 518 and chat.chat_digests(df.limit(0)).count() == 0


def test_warc_bundles(spark):
    long, short = "é" * 60, "x"
    rows = [(3, "u", long), (1, "u\nv", long), (2, None, short), (4, None, short), (5, None, None), (None, "n", long), (6, "u", "z" * 600_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(warc.plan_records(pages), folder)
    assert warc.read_archives(index.where("record_id = 'urn:page:6'"), folder).count() == 1
    got = {r["page_id"]: r for r in warc.archive_digests(pages).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None),
        5: ("response", None), 6: ("response", None),
    }
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert warc.archive_digests(pages.limit(0)).count() == 0


def test_imatch_edits_and_equal_texts(spark):
    texts = ["the cat sat on a mat", "the cat sat on a mat", None, "", "one two", "ñu ü 漢字 x", "y " * 5000]
    rows = imatch.edit_report(table(spark, texts)).orderBy(F.desc("doc_id")).collect()
    ordered = [t or "" for t in reversed(texts)]
    for i, (row, text) in enumerate(zip(rows, ordered)):
        other, many = ordered[(i + 1) % len(ordered)], len(text) // 3
        edited = text[: len(text) - many] + other[:many]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    assert rows[-1]["fingerprint"] == rows[-2]["fingerprint"] and rows[-2]["near_next"] == 1.0
    assert imatch.edit_report(table(spark, [])).count() == 0
    single = imatch.edit_report(table(spark, ["only one here"])).first()
    assert single["near_next"] == 1.0


def test_warc_footer_and_repeated_ids(spark):
    """The seek table at a bundle's end lists the frames as they lie; equal ids, and columns named like results, do no harm."""
    rows = [(i % 50, "u", f"page {i} " * 3000, "x", 7) for i in range(100)] + [(900, None, "é" * 100, "y", 8), (900, "v", "é" * 100, "y", 8), (901, "v", "é" * 100, "z", 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string, frame int").repartition(2)
    folder = scratch_path(spark, "warc-footer")
    index = warc.write_archives(warc.plan_records(pages), folder)
    files, root = fs.FileSystem.from_uri(f"{folder}/bundles")
    names = {r.bundle: r.frames for r in index.groupBy("bundle").agg(F.max("frame").alias("frames")).collect()}
    for name, last in names.items():
        with files.open_input_file(f"{root}/{name}") as source:
            table, size = warc.read_seek_table(source), source.size()
            assert len(table) == last + 1 and last > 2
            for at, packed, plain in table:
                source.seek(at)
                assert len(zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)) == plain
            assert table[-1][0] + table[-1][1] + 8 + 8 * len(table) + 9 == size
            source.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read()
            assert whole.count(b"WARC/1.1\r\n") == index.where(F.col("bundle") == name).count()
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_digests(pages).collect() if r["page_id"] >= 900)
    assert got == [(900, "response", None), (900, "response", None), (901, "revisit", 900)]
    assert warc.archive_digests(pages).count() == 103
    cut = io.BytesIO(b"no footer here")
    cut.size = lambda: 14
    with pytest.raises(ValueError):
        warc.read_seek_table(cut)


def spark_hash(*values):
    """Spark's xxhash64 of some columns: 64-bit hashes that seed one another."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed % 2**64).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def brute_prints(texts):
    """I-Match in plain Python: (level, low, high, fingerprint) of each text, with the lexicon of all."""
    def terms_of(text):
        return {spark_hash(w) for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w}

    counts = Counter(t for text in texts for t in terms_of(text))
    known = {t for t, n in counts.items() if max(1, 0.001 * len(texts)) <= n <= max(1, 0.1 * len(texts))}

    def print_of(text):
        terms = terms_of(text)
        level = max(5, int(math.log2(max(1, len(terms)))))
        bits = {t: (t % 2**64) >> 17 for t in terms}
        own = {t for t in terms if bits[t] % 2**level < 32}
        found = own & known
        chosen = found if len(found) >= 0.25 * len(own) else own

        def hashes(level):
            out = []
            for subset in range(32):
                value = 0
                for i, t in enumerate(sorted(t for t in chosen if bits[t] % 2**level == subset)):
                    value = spark_hash(value, t) if i else spark_hash(t)
                out.append(value & 0xFFFFFFFF)
            return out

        low, high = hashes(level), hashes(level + 1)
        whole = "all:" + hashlib.sha256(",".join(map(str, sorted(terms))).encode()).hexdigest()[:32]
        return level, low, high, f"{level}:{''.join(f'{h:08x}' for h in low)}:{''.join(f'{h:08x}' for h in high)}" if own else whole

    return print_of


def brute_likeness(a, b):
    if a[3] == b[3]:
        return 1.0
    pairs = {0: [(a[1], b[1]), (a[2], b[2])], 1: [(a[1], b[2])], -1: [(a[2], b[1])]}.get(a[0] - b[0], [])
    used = [(x, y) for p, q in pairs for x, y in zip(p, q) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def test_imatch_against_a_plain_version(spark):
    chance = random.Random(12)
    words = [f"w{int(chance.paretovariate(0.6))}" for _ in range(3000)]
    texts = [" ".join(chance.choice(words) for _ in range(chance.choice([3, 40, 300]))) for _ in range(120)] + ["", None, "same", "same", "!?"]
    keys = list(range(100)) + [None] * 5 + [200] * 10 + list(range(300, 310))
    docs = spark.createDataFrame(list(zip(keys, texts)), "doc_id bigint, text string").withColumn("fingerprint", F.lit("x")).withColumn("bucket", F.lit(1))
    rows = imatch.edit_report(docs).collect()
    print_of = brute_prints([t or "" for t in texts])
    order = sorted(((k is None, -(k or 0), spark_hash(t or "") if t else spark_hash(""), t or "") for k, t in zip(keys, texts)))
    want = []
    for i, (missing, key, _, text) in enumerate(order):
        other = order[(i + 1) % len(order)][3]
        many = len(text) // 3
        changed = text[: len(text) - many] + other[:many]
        own, new, following = print_of(text), print_of(changed), print_of(other)
        want.append((None if missing else -key, len(text), hashlib.sha256(changed.encode()).hexdigest(), own[3], new[3], brute_likeness(own, new), brute_likeness(own, following)))
    assert sorted((tuple(r) for r in rows), key=repr) == sorted(want, key=repr)


def test_imatch_in_a_large_group_of_near_copies(spark):
    chance = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [chance.choice(words) for _ in range(120)]
    copies = [" ".join([*base[:i % 120], f"own{i}", *base[i % 120 + 1:]]) for i in range(400)]
    others = [" ".join(chance.choice(words) for _ in range(120)) for _ in range(800)]
    rows = {r["doc_id"]: r for r in imatch.edit_report(table(spark, copies + others)).collect()}
    group = [rows[i] for i in range(1, 400)]
    assert min(r["near_next"] for r in group) > 0.5
    mean = lambda rs: sum(r["near_edited"] for r in rs) / len(rs)
    assert mean(group) > 0.8 * mean([rows[i] for i in range(401, 1200)])
    assert max(rows[i]["near_next"] for i in range(401, 1200)) < 0.3


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_classifiers_learn_and_take_any_text(spark):
    good = [f"the quiet river number {i} runs along the old road" for i in range(80)]
    bad = [f"BUY!!! N{i}OW!!! ***%%% you idiot moron" for i in range(80)]
    docs = table(spark, good + bad + [None, "", "z" * 200_000])
    own = labels(spark, [(i, int(i < 80), int(i >= 80)) for i in range(160)] + [(None, 1, 1), (5, None, None)])
    for module, want in ((quality, lambda i: int(i < 80)), (toxicity, lambda i: int(i >= 80))):
        out = module.score(docs, module.fit_on_labels(docs, own)).orderBy("doc_id").collect()
        assert [r["predicted"] for r in out[:160]] == [want(i) for i in range(160)]
        assert len(out) == 163 and all(0 <= r["score"] <= 1 for r in out)
        alone = module.score(docs, module.fit_on_labels(docs, own.limit(0)))
        assert alone.select("score").distinct().count() == 1
        assert module.score(docs.limit(0), module.fit_on_labels(docs, own)).count() == 0


def test_language(spark):
    rows = [(i, ["der hund und die katze", "the dog and the cat"][i % 2] + f" {i}", ["de", "en"][i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows + [(100, None, "en"), (101, "12 !", "en"), (102, "und der hund", None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(docs.drop("lang"), language.learn(docs)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "de"
    assert language.predict(docs.drop("lang"), language.learn(docs.limit(0))).where("lang_pred != 'und'").count() == 0


def test_language_of_many_and_small_languages(spark):
    names = [f"l{i:02d}" for i in range(70)]
    words = {n: [chr(0x4E00 + 20 * i + j) * 5 for j in range(8)] for i, n in enumerate(names)}
    rows = [(100 * k + i, " ".join(words[n][:6]) + f" {k}", n) for i, n in enumerate(names) for k in range(8)]
    taught = [x for x in range(10_000, 10_100) if zlib.crc32(str(x).encode()) % language.FOLDS != language.HELD_OUT][:2]
    rows += [(taught[0], "только один", "one"), (taught[1], "ένα μόνο", "two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = language.learn(docs)
    assert filters.languages == sorted([*names, "one", "two"])
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs.drop("lang"), filters).collect()}
    assert got == {i: lang for i, _, lang in rows}
