"""DuckDB statements for the queries that SQL can express."""

OP8_WARC = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (
    SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h AND p.n >= 100
"""

OP9_CHAT = """
WITH c AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 11) AS BIGINT)
           AS formatted_chars
FROM c GROUP BY conv_id
"""

# CRC-32 of a decimal number, bit by bit; 3988292384 is its fixed polynomial.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({x}, ''), lambda s: ascii(s)::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]),
        lambda r, _: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)), 4294967295::UBIGINT)"""


def field(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"


def tree_levels(name: str, key: str, base: str, height: int) -> str:
    """CTEs of one forest: name0 is ``base (key, idx, n, h)``; each level takes runs of 16 while a tree has several nodes."""
    parts = [f"{name}0 AS ({base})"]
    for k in range(height):
        parts.append(
            f"{name}{k + 1} AS (SELECT {key}, idx // 16 AS idx, (max(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY idx)) AS h "
            f"FROM {name}{k} WHERE n > 1 GROUP BY {key}, idx // 16)"
        )
    tops = " UNION ALL ".join(f"SELECT {key}, h FROM {name}{k} WHERE n = 1" for k in range(height + 1))
    # Of each node with a parent: its siblings to the left and to the right.
    for k in range(height):
        parts.append(
            f"{name}s{k} AS (SELECT {key}, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r "
            f"FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY {key}, idx // 16 ORDER BY idx))"
        )
    return ",\n".join([*parts, f"{name}_top AS ({tops})"])


def merkle(height: int = 5, wide: int = 4) -> str:
    """Trees of up to 16**height leaves a source and 16**wide sources."""
    plain = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    crc = CRC32.format(x="doc_id::VARCHAR")
    base = "SELECT s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY s) AS n, h, again, doc_id FROM leaf"
    top = "SELECT 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, h, t.s FROM trees_top t JOIN (SELECT DISTINCT s, source FROM leaf) USING (s)"
    steps = [("trees", "s", k, "d.idx") for k in range(height)] + [("tops", "one", k, "p.idx") for k in range(wide)]
    joins, folded, proof = "", "d.again", "''"
    for i, (name, key, k, idx) in enumerate(steps):
        on = f"a{i}.s = d.s" if key == "s" else "true"
        joins += f" LEFT JOIN {name}s{k} a{i} ON {on} AND a{i}.idx = {idx} // {16**k}\n"
        proof += f" || coalesce(a{i}.l || a{i}.r, '')"
    out = f"d{len(steps)}"
    chain = [f"d0 AS (SELECT d.doc_id, d.h AS leaf, d.again AS fold, t.h AS subroot, {', '.join(f'a{i}.l AS l{i}, a{i}.r AS r{i}' for i in range(len(steps)))}, sha256({proof}) AS proof FROM trees0 d JOIN trees_top t ON t.s = d.s JOIN tops0 p ON p.s = d.s{joins})"]
    for i in range(len(steps)):
        chain.append(f"d{i + 1} AS (SELECT * REPLACE (CASE WHEN l{i} IS NULL THEN fold ELSE sha256(l{i} || fold || r{i}) END AS fold) FROM d{i})")
    return f"""
WITH leaf AS (
    SELECT doc_id, source, {field("source")} AS s, sha256({plain}) AS h,
           sha256({plain.replace("text", "low")}) AS again
    FROM (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM documents)
),
{tree_levels("trees", "s", base, height)},
{tree_levels("tops", "one", top, wide)},
{", ".join(chain)}
SELECT doc_id, leaf, subroot, (SELECT h FROM tops_top) AS root, proof AS proof_sha256, fold AS folded_root,
       fold = (SELECT h FROM tops_top) AS verified
FROM {out}
"""


TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SEARCH = f"""
WITH d AS (
    SELECT doc_id, {TERMS} AS ts, len(ts) AS n FROM documents WHERE len({TERMS}) > 0
), s AS (
    SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS terms FROM d
), q AS (
    SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark
), p AS (
    SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t
), w AS (
    SELECT t, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY t, total
), r AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * total) // terms))))) AS BIGINT) AS score
    FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id
), k AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT * FROM k WHERE rank <= 10
"""


ORACLES = {"op8_warc": OP8_WARC, "op9_chat": OP9_CHAT, "op11_merkle": merkle(), "op12_search": OP12_SEARCH}
