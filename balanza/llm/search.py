"""Ranked lexical search over an inverted index, hybrid of term-at-a-time and document-at-a-time.

The index is cut into shards of bounded size: a shard holds whole documents, one row per term
with the documents that hold it, and one row with the documents' ids and lengths. A query runs
in every shard and the shards' best are ranked together, so no list of a frequent term is ever
in one place.

In a shard, the short lists of a query are summed term by term into accumulators. These then
count as one more list, with its own bounds, next to the long ones. All lists are walked
together in document order, in windows: a window whose bounds can't reach the best found so
far is skipped, and in the others only documents of the lists that matter are looked up in
the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from balanza.llm.common import bounded_batches, list_array, utf8_steps
from balanza.session import materialize, spread

#: A shard is closed at so many terms (with repeats); its last document is whole.
SHARD_TERMS = 2_000_000
#: Rows of the index that a task hands over at once.
INDEX_ROWS = 20_000
#: Lists of at most this part of a shard's documents are short.
SHORT_PART = 1 / 32
#: Documents of a window.
WINDOW = 1024
#: Characters of the query terms that run in one pass over the index, and are broadcast; more queries take more passes.
BLOCK_CHARS = 4_000_000

INDEX = "shard bigint, term string, rows bigint, terms bigint, gaps array<int>, counts array<int>, ids array<bigint>"
HITS = "item_id bigint, doc_id bigint, score bigint"

# Fixed values of the contract: 0-9, A-Z, a-z and all beyond ASCII make terms, and A-Z are lowered.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms_of(column) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, terms, row of each term counted from there) of runs of rows; terms are in order and repeat."""
    for row, _, data, offsets in utf8_steps(column):
        inside = _IN_TERM[data]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        bounds = offsets[(offsets > 0) & (offsets < len(data))]
        fresh[bounds] = inside[bounds]  # a term ends with its text
        starts = np.flatnonzero(fresh)
        kept = _LOWER[data[inside]]
        cuts = np.zeros(len(starts) + 1, np.int64)
        cuts[:-1] = np.cumsum(inside)[starts] - 1
        cuts[-1] = len(kept)
        terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(kept))
        yield row, terms, np.searchsorted(offsets, starts, "right") - 1


def shard_rows(shard: int, ids: pa.Array, terms: pa.Array, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard: ``owner`` is the position in ``ids`` of each term's document.

    Documents are put in the order of their ids (null last), so that an earlier one wins a tie.
    Documents without a term are left out.
    """
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    length = np.bincount(owner, minlength=len(ids))[order]
    order, length = order[length > 0], length[length > 0]
    seat = np.zeros(len(ids), np.int64)
    seat[order] = np.arange(len(order))
    coded = pc.dictionary_encode(terms)
    pairs, counts = np.unique(coded.indices.to_numpy().astype(np.int64) * len(order) + seat[owner], return_counts=True)
    code, doc = pairs // len(order), pairs % len(order)
    size = np.bincount(code, minlength=len(coded.dictionary))
    end = np.cumsum(size)
    # Gaps between documents compress better than their numbers.
    gaps = np.diff(doc, prepend=0)
    first = end - size
    gaps[first] = doc[first]
    names = [f.split()[0] for f in INDEX.split(", ")]

    def batch(term, rows, terms, gaps, counts, ids):
        columns = [pa.array(np.full(len(rows), shard)), term, pa.array(rows.astype(np.int64)), pa.array(terms.astype(np.int64)), gaps, counts, ids]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def ints(lengths, values):
        return list_array(lengths, pa.array(values.astype(np.int32)))

    one = np.array([len(order)])
    yield batch(
        pa.nulls(1, pa.string()), one, np.array([length.sum()]), ints([0], one[:0]), ints(one, length),
        list_array(one, ids.take(pa.array(order)).cast(pa.int64())),
    )
    for a in range(0, len(size), INDEX_ROWS):
        b = min(len(size), a + INDEX_ROWS)
        span, many = slice(first[a], end[b - 1]), size[a:b]
        yield batch(
            coded.dictionary[a:b].cast(pa.string()), many, np.zeros(b - a), ints(many, gaps[span]), ints(many, counts[span]),
            list_array(np.zeros(b - a, np.int64), pa.array([], pa.int64())),
        )


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The inverted index of all terms of all whole texts, written to the shared folder.

    Rows with a null text, or without a term, are not in it; repeated ids are documents of their
    own; other columns are not read. An empty table gives an empty index. ``rows`` and ``terms``
    hold, in a term's row, how many documents have it, and in the row of the ids (its term is
    null) how many documents there are and their terms with repeats; ``counts`` are the terms'
    occurrences and the documents' lengths.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Names of a stage's partitions are the same in every attempt.
        shard, ids, terms, owner, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield from shard_rows(shard, pa.concat_arrays(ids), pa.concat_arrays(terms), np.concatenate(owner))

        for batch in batches:
            start = sum(map(len, ids))
            ids.append(batch.column(0).cast(pa.int64()))
            for row, found, rows in terms_of(batch.column(1)):
                terms.append(found)
                owner.append(rows + (start + row))
                held += len(found)
            if held >= SHARD_TERMS:
                yield from close()
                shard, ids, terms, owner, held = shard + 1, [], [], [], 0
        yield from close()

    own = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return materialize(own.mapInArrow(run, INDEX), "inverted")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) with each item's distinct terms; rows that share an item_id are one item, and items without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found, rows in terms_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows + row)), found.cast(pa.string())], names=["item_id", "term"]
                )

    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "item_id bigint, term string").groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def weight(total: int, having: int) -> int:
    """A term's weight among ``total`` documents of which ``having`` hold it."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * having + 1)))


class Postings:
    """One list of a shard: documents in order, what the term adds to each, and bounds of that."""

    def __init__(self, docs: np.ndarray, adds: np.ndarray, windows: int):
        self.docs, self.adds = docs, adds
        self.edges = np.searchsorted(docs, np.arange(windows + 1) * WINDOW)
        self.bounds = np.zeros(windows, np.int64)
        filled = np.flatnonzero(np.diff(self.edges))
        if len(filled):
            self.bounds[filled] = np.maximum.reduceat(adds, self.edges[filled])

    def best(self, k: int) -> int:
        """The k-th largest addition: at least k documents score as much. 0 if there are fewer."""
        return int(np.partition(self.adds, -k)[-k]) if len(self.adds) >= k else 0


def accumulate(short: list[Postings], n_docs: int) -> Postings:
    """Term at a time: the sum of short lists, as one list."""
    total = np.zeros(n_docs, np.int64)
    for one in short:
        total[one.docs] += one.adds
    docs = np.flatnonzero(total)
    return Postings(docs, total[docs], -(-n_docs // WINDOW))


def best_of(lists: list[Postings], n_docs: int, k: int, looked_at: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best of a shard, ties by document; ``looked_at`` gets the postings read in long lists."""
    limit = SHORT_PART * n_docs
    short, long = [x for x in lists if len(x.docs) <= limit], [x for x in lists if len(x.docs) > limit]
    walked = [accumulate(short, n_docs), *long] if short else long
    if not walked:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # k documents reach this score already, by one list alone.
    floor = max(1, *(x.best(k) for x in walked))
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.array([x.bounds for x in walked])
    for w in np.flatnonzero(bounds.sum(0) >= floor):
        order = np.argsort(bounds[:, w], kind="stable")
        reach = np.cumsum(bounds[order, w])
        if reach[-1] < floor:
            continue
        # A document that is only in the first lists can't reach the floor.
        idle = int(np.searchsorted(reach, floor))
        part = np.zeros(WINDOW, np.int64)
        for x in order[idle:]:
            a, b = walked[x].edges[w : w + 2]
            part[walked[x].docs[a:b] - w * WINDOW] += walked[x].adds[a:b]
            if looked_at is not None and walked[x] in long:
                looked_at.append(b - a)
        left = np.flatnonzero(part)
        for i in range(idle - 1, -1, -1):
            left = left[part[left] + reach[i] >= floor]
            if not len(left):
                break
            one = walked[order[i]]
            a, b = one.edges[w : w + 2]
            if a == b:
                continue
            here = one.docs[a:b] - w * WINDOW
            spot = np.minimum(np.searchsorted(here, left), b - a - 1)
            part[left] += np.where(here[spot] == left, one.adds[a:b][spot], 0)
            if looked_at is not None and one in long:
                looked_at.append(min(len(left), b - a))
        left = left[part[left] >= floor]
        docs, scores = np.concatenate([docs, left + w * WINDOW]), np.concatenate([scores, part[left]])
        if len(docs) >= k:
            top = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[top], scores[top]
            floor = max(floor, int(scores[-1]))
    top = np.lexsort((docs, -scores))[:k]
    return docs[top], scores[top]


def search_shard(table: pa.Table, queries: list[tuple], weights: dict[str, int], total: int, terms: int, k: int) -> pa.Table:
    """The ``k`` best documents of one shard for each (item_id, terms) of ``queries``."""
    name, rows = table["term"].to_pylist(), table["rows"].to_numpy()
    gaps, counts = table["gaps"].combine_chunks(), table["counts"].combine_chunks()
    own = name.index(None)
    ids, n_docs = table["ids"].combine_chunks()[own].values, int(rows[own])
    length = counts[own].values.to_numpy().astype(np.int64)
    slow = 8 * (10 + 90 * length * total // terms)
    lists, windows = {}, -(-n_docs // WINDOW)
    for i, term in enumerate(name):
        if term is not None:
            docs, tf = np.cumsum(gaps[i].values.to_numpy(), dtype=np.int64), counts[i].values.to_numpy().astype(np.int64)
            lists[term] = Postings(docs, weights[term] * (1_000_000_000 * tf // (1000 * tf + slow[docs])), windows)
    found = [(item, *best_of([lists[t] for t in wanted if t in lists], n_docs, k)) for item, wanted in queries]
    spots = np.concatenate([docs for _, docs, _ in found])
    return pa.table({
        "item_id": pa.array([item for item, docs, _ in found for _ in docs], pa.int64()),
        "doc_id": ids.take(pa.array(spots)), "score": pa.array(np.concatenate([s for *_, s in found])),
    })


def _blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """Queries in blocks of bounded size, fetched one partition at a time."""
    block, held = [], 0
    for row in queries.toLocalIterator():
        block.append(row)
        held += sum(map(len, row["terms"]))
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search_block(index: DataFrame, block: list[Row], total: int, terms: int, k: int) -> DataFrame:
    """The shards' best for one block of queries.

    The block's terms are bounded, so they go to the index and not the index to them: all
    shards' lists of one frequent term would meet in one task otherwise.
    """
    def of(wanted) -> DataFrame:
        table = index.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "term string")
        return index.where(F.col("term").isNotNull()).join(F.broadcast(table), "term", "left_semi")

    # At most one row for each of the block's terms.
    having = of({t for row in block for t in row["terms"]}).groupBy("term").agg(F.sum("rows")).collect()
    weights = {term: weight(total, int(n)) for term, n in having}
    weights = {term: w for term, w in weights.items() if w > 0}
    queries = [(row["item_id"], [t for t in row["terms"] if t in weights]) for row in block]
    shards = spread(of(weights).select(*index.columns).unionByName(index.where(F.col("term").isNull())), "shard")
    return shards.groupBy("shard").applyInArrow(lambda table: search_shard(table, queries, weights, total, terms, k), HITS)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents above score 0 of each item of ``items (item_id, text)``.

    Equal scores rank by ascending id, null ids last; repeated ids are ranked as documents of
    their own, and equal ids with equal scores in any order (their rows are equal). Items that
    share an id, null included, are one item with all their terms. Null, empty and termless
    texts, on either side, find nothing; very long ones are read whole. Other columns, and
    columns named like the results, are not read. Empty tables give no rows.
    """
    index = build_index(docs)
    sums = index.where(F.col("term").isNull()).agg(F.sum("rows"), F.sum("terms")).first()
    empty = docs.sparkSession.createDataFrame([], HITS)
    hits = empty
    if sums[0]:
        for block in _blocks(query_terms(items)):
            hits = hits.unionByName(_search_block(index, block, int(sums[0]), int(sums[1]), k))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
