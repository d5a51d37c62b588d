"""Ranked lexical search by NRA over impact-sorted lists.

A pass over the texts keeps, of each document, its length and the counts of the
terms that some item asks for.  Documents are then taken in shards of bounded size:
a shard's lists hold its documents by falling impact, and each item reads its lists
in step, from the front, never at random.  What a document has gained so far is its
lower bound; what it can still gain from lists it was not met in is at most their
next unread impact, which gives its upper bound.  Reading goes on until no other
document can enter the best, tie with them or change a score among them.

Shards pass on their best documents of each item; the score that the last of them
must reach carries over to a task's later shards.  Items are worked on in blocks of
bounded size, so neither the items nor the lists are ever whole in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import per_batch
from .common import materialize, pick, sums_before
from .terms import Terms

#: Documents an item returns.
BEST = 10
#: Bytes of items worked on at a time.
BLOCK_BYTES = 4 << 20
#: Entries and documents of a shard's lists, and entries of each list read in the first step.
SHARD_ENTRIES, SHARD_DOCS, FIRST_STEP = 1 << 21, 1 << 16, 256

#: ASCII characters of a term.
INSIDE = "0-9A-Za-z"
NO_ID = np.iinfo(np.int64).max  # sorts after every doc_id


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _numbered_items(items: DataFrame) -> tuple[DataFrame, int]:
    """q, item_id, text and block of every distinct item; the number of blocks."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    placed, totals = sums_before(pick(items, "item_id", "text").distinct(), ["item_id", "text"],
                                 {"q": F.lit(1).cast("long"), "before": size.cast("long")})
    block = F.floor(F.col("before") / BLOCK_BYTES).cast("long")
    return materialize(placed.select("q", "item_id", "text", block.alias("block")), "lexical-items"), totals["before"] // BLOCK_BYTES + 1


def _count_terms(vocabulary: Broadcast) -> Callable:
    """For per_batch: doc_id, n, terms and counts of documents, the counts of terms in ``vocabulary`` only."""
    def start() -> Callable:
        number, terms = vocabulary.value, Terms(INSIDE)

        def run(cols: list[list]) -> list:
            out: list[list] = [[] for _ in range(4)]
            for doc_id, text in zip(*cols):
                n, found = 0, Counter()
                for piece in terms.pieces(text):
                    met = terms.find_all(piece)
                    n += len(met)
                    found.update(map(number.get, met))
                if n:
                    found.pop(None, None)
                    for col, v in zip(out, (doc_id, n, list(found), list(found.values()))):
                        col.append(v)
            return out
        return run
    return start


class Shard:
    """Impact-sorted lists of some documents: for each term, documents by falling impact."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def best(self, terms: list[tuple[int, int]], k: int, reach: int) -> list[tuple[int, int]]:
        """(-score, place of the document) of the ``k`` best for ``terms`` (term, times), best first,
        ties by doc_id; documents that score under ``reach`` may be left out, those of 0 are."""
        lists = [(self.starts[t], self.starts[t + 1], times) for t, times in terms if self.starts[t] < self.starts[t + 1]]
        lower = np.zeros(len(self.ids), np.int64)
        met = np.zeros((len(lists), len(self.ids)), bool)
        at = np.array([a for a, _, _ in lists], np.int64)
        ahead = np.array([times * self.impact[a] for a, _, times in lists], np.int64)  # most that is unread, by list
        wanted = range(len(lists))
        step, reach = FIRST_STEP, max(reach, 1)
        while True:
            for i in wanted:
                _, end, times = lists[i]
                to = min(end, at[i] + step)
                docs = self.doc[at[i]:to]
                lower[docs] += times * self.impact[at[i]:to]
                met[i, docs] = True
                at[i], ahead[i] = to, times * self.impact[to] if to < end else 0
            step *= 2
            known = np.flatnonzero(met.any(axis=0))
            gained, rest = lower[known], int(ahead.sum())
            if len(known) >= k:
                reach = max(reach, int(np.partition(gained, len(known) - k)[len(known) - k]))
            upper = gained + rest - ahead @ met[:, known]
            stay = upper >= reach
            known, gained, upper = known[stay], gained[stay], upper[stay]
            if rest >= reach:  # a document not met so far may still be among the best
                wanted = np.flatnonzero(ahead)
            elif (upper == gained).all():
                order = np.lexsort((self.ids[known], -gained))[:k]
                return [(-int(gained[i]), int(known[i])) for i in order]
            else:  # only lists that may still change an interval
                open_ = known[upper > gained]
                wanted = np.flatnonzero((ahead > 0) & ~met[:, open_].all(axis=1))


def _search(asked: Broadcast, k: int) -> Callable:
    """For mapInArrow over (doc_id, m, terms, counts): q, item_id, doc_id, score of a task's best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = asked.value
        best: dict[int, list[tuple[int, int]]] = {}
        held: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
            m = rows["m"].to_numpy()
            lists = rows["terms"].combine_chunks()
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            tf = rows["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            shard = Shard(ids, m, doc, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tf.astype(np.int64), weights)
            for q, (_, terms) in queries.items():
                before = best.get(q, [])
                found = shard.best(terms, k, -before[-1][0] if len(before) == k else 1)
                if found:
                    best[q] = sorted(before + [(s, int(ids[i])) for s, i in found])[:k]
            held.clear()

        entries = docs = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held.append(batch.slice(at, 4096))
                entries += len(held[-1]["terms"].flatten())
                docs += held[-1].num_rows
                if entries >= SHARD_ENTRIES or docs >= SHARD_DOCS:
                    search()
                    entries = docs = 0
        if held:
            search()
        rows = [(q, queries[q][0], None if i == NO_ID else i, -s) for q, found in best.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["q", "item_id", "doc_id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of ``docs`` (doc_id, text) for each
    item of ``items`` (item_id, text).

    Null, empty and term-less texts take no part and items without a term or a match give
    no row; texts are read whole.  Equal scores go by ascending doc_id, a null doc_id last;
    repeated rows of ``docs`` are documents of their own.  Repeated rows of ``items`` are one
    item, rows that share an item_id only are items of their own, each with its ranks.
    An empty table gives an empty result; other columns are left aside.
    """
    spark = docs.sparkSession
    numbered, blocks = _numbered_items(items)
    texts = pick(docs, "doc_id", "text")
    terms = Terms(INSIDE)
    parts = []
    for block in range(blocks):  # items of some BLOCK_BYTES at a time, against all documents
        asked = {r["q"]: (r["item_id"], Counter(t for p in terms.pieces(r["text"]) for t in terms.find_all(p)))
                 for r in numbered.filter(F.col("block") == block).collect()}
        number = {t: i for i, t in enumerate(sorted({t for _, found in asked.values() for t in found}))}
        rows = materialize(per_batch(texts, "doc_id long, n long, terms array<long>, counts array<long>",
                                     _count_terms(spark.sparkContext.broadcast(number))), "lexical-counts")
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(number))], np.int64)
        queries = {q: (item_id, [(number[t], c) for t, c in found.items()]) for q, (item_id, found) in asked.items()}
        m = (F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {max(n_terms, 1)}L")).alias("m")
        parts.append(rows.select("doc_id", m, "terms", "counts").mapInArrow(
            _search(spark.sparkContext.broadcast((queries, weights)), k), "q long, item_id long, doc_id long, score long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    place = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten highest-scoring ``documents`` of every ``benchmark`` item, with exact integer scores;
    ``search`` says what null and empty texts, ties, repeated rows and empty tables give."""
    return search(docs, items)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
t AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
         FROM (SELECT DISTINCT item_id, text FROM benchmark)),
a AS (SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS times
         FROM (SELECT q, item_id, unnest(words) AS term FROM i) GROUP BY q, item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM g) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
         FROM t GROUP BY term),
s AS (SELECT q, item_id, doc_id, r, CAST(sum(times * w.w * ((1000000000 * tf) //
         (1000 * tf + 8 * (100 - 75 + (75 * len(words) * n_docs) // n_terms)))) AS BIGINT) AS score
         FROM a JOIN w USING (term) JOIN t USING (term) JOIN d USING (r) CROSS JOIN g GROUP BY q, item_id, doc_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
         FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
