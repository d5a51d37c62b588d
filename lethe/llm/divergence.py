"""How the sources of a language differ, over a minimal acyclic transducer of its vocabulary.

Terms that enough documents of a language hold are kept.  Their sorted list (each
behind its language) is cut into ranges of bounded size; each range becomes a minimal
automaton whose edges carry numbers: added up along a path they give a term's place
among all kept terms in byte order.  The texts then stream through the automata, all
terms of a piece side by side, and every term that an automaton accepts is counted by
that ordinal.  From there on terms are ordinals, also where ties are broken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrow  # noqa: F401  (this package's functions travel with the task)
from .common import attach_small, materialize, pick, sums_before
from .hashtable import Table
from .terms import PIECE, Terms

#: Documents of a language that must hold a term, and ranks of terms returned.
LEAST_DOCS, TOP = 10, 10
#: Distinct terms, and (group, term) pairs, a task holds before it hands its counts on.
HELD = 1 << 18
#: Bits of an ordinal in the key of a (group, term) pair.
ORDINAL_BITS = 40
#: Bytes of kept terms in one automaton, and of automata sent to the tasks at a time.
RANGE_BYTES, SENT_BYTES = 4 << 20, 64 << 20
#: Kept terms and sources of a tile in which sources are compared.
TILE_TERMS, TILE_SOURCES = 4096, 32

#: ASCII characters of a term.
INSIDE = "A-Za-z"
#: Stands between a language and a term; no byte of UTF-8.
BORDER = b"\xff"


# ---------------------------------------------------------------- kept terms

def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term and the number of documents (of the rows so far) that hold it."""
    terms = Terms(INSIDE)
    held: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, t.decode(), n) for lang, c in held.items() for t, n in c.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))],
                                          ["lang", "term", "docs"])

    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            met: set[bytes] = set()
            for piece in terms.pieces(text):
                met.update(terms.find_all(piece))
            of_lang = held.setdefault(lang, Counter())
            size -= len(of_lang)
            of_lang.update(met)
            size += len(of_lang)
            if size >= HELD:
                yield flush()
                size = 0
    if held:
        yield flush()


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, ord (its place among all kept terms of all languages, in byte order) and range."""
    counts = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, docs long")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    key = F.concat(F.col("lang").cast("binary"), F.lit(BORDER), F.col("term").cast("binary"))
    placed, _ = sums_before(kept.select("lang", "term", key.alias("key")), ["key"],
                            {"ord": F.lit(1).cast("long"), "before": F.octet_length("key").cast("long")})
    return materialize(placed.withColumn("range", F.floor(F.col("before") / RANGE_BYTES)).drop("before"), "divergence-kept")


# ---------------------------------------------------------------- the transducer

def build(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The minimal acyclic automaton of sorted, distinct ``words``, as arrays: edges (state * 256 +
    byte), their targets and numbers, and which states end a word.  The last state is the root.

    States are settled from their ends as soon as no later word can pass through them; equal
    ones are one.  An edge's number counts the words that leave its state earlier.
    """
    known: dict[tuple, int] = {}
    accepted: list[int] = []  # words from each settled state on
    final: list[bool] = []
    keys, targets, numbers = [], [], []

    def settle(ends: bool, edges: list[tuple[int, int]]) -> int:
        sign = (ends, *edges)
        state = known.get(sign)
        if state is None:
            state = known[sign] = len(accepted)
            n = int(ends)
            for byte, to in edges:
                keys.append(state << 8 | byte)
                targets.append(to)
                numbers.append(n)
                n += accepted[to]
            accepted.append(n)
            final.append(ends)
        return state

    path: list[list] = [[False, []]]  # open states of the last word: ends a word, settled edges
    last = b""
    for word in words:
        same = 0
        limit = min(len(word), len(last))
        while same < limit and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            ends, edges = path.pop()
            path[-1][1].append((last[i - 1], settle(ends, edges)))
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        ends, edges = path.pop()
        path[-1][1].append((last[i - 1], settle(ends, edges)))
    known.clear()  # the root is a state of its own, the last
    settle(*path[0])
    return np.array(keys, np.int64), np.array(targets, np.int32), np.array(numbers, np.int64), np.array(final, bool)


class Transducer:
    """Ordinals of kept terms from ``base`` on."""

    def __init__(self, base: int, keys: np.ndarray, targets: np.ndarray, numbers: np.ndarray, final: np.ndarray):
        self.base, self.targets, self.numbers, self.final = base, targets, numbers, final
        self.edges = Table(max(4, (4 * len(keys)).bit_length()))
        self.edges.add(keys, list(range(len(keys))))
        self.begun: dict[str, tuple[int, int]] = {}

    def begin(self, lang: str) -> tuple[int, int]:
        """State and number after a language and its border; state -1 if no term of it is in this range."""
        if lang not in self.begun:
            state, number = len(self.final) - 1, self.base
            for byte in lang.encode("utf-8", "surrogatepass") + BORDER:
                edge = int(self.edges.find(np.array([state << 8 | byte]))[0])
                if edge < 0:
                    state = -1
                    break
                state, number = int(self.targets[edge]), number + int(self.numbers[edge])
            self.begun[lang] = (state, number)
        return self.begun[lang]

    def read(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms at ``first`` of ``data``, begun in ``state``, are accepted, and their ordinals."""
        at = np.flatnonzero(state >= 0)
        state, number = state[at], number[at]
        found, ordinals = [], []
        k = 0
        while len(at):
            over = size[at] == k
            if over.any():
                ends = over & self.final[state]
                found.append(at[ends])
                ordinals.append(number[ends])
                at, state, number = at[~over], state[~over], number[~over]
            edge = self.edges.find(state.astype(np.int64) << 8 | data[first[at] + k])
            on = edge >= 0
            edge, at = edge[on], at[on]
            state, number = self.targets[edge], number[on] + self.numbers[edge]
            k += 1
        return (np.concatenate(found), np.concatenate(ordinals)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def transducers(kept: DataFrame) -> DataFrame:
    """range, base, bytes and the arrays (binary) of the automaton of every range of ``kept``, each built in its task."""
    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ord")
        arrays = build(rows["key"].to_pylist())
        raw = [x.tobytes() for x in arrays]
        return pa.table([pa.array([rows["range"][0].as_py()], pa.int64()), pa.array([rows["ord"][0].as_py()], pa.int64()),
                         pa.array([sum(map(len, raw))], pa.int64()), *[pa.array([x], pa.binary()) for x in raw]],
                        ["range", "base", "bytes", "keys", "targets", "numbers", "final"])

    return kept.select("range", "ord", "key").groupBy("range").applyInArrow(
        one, "range long, base long, bytes long, keys binary, targets binary, numbers binary, final binary")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, counts) pairs and the sum of each one's counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts


def _recount(sent: Broadcast) -> Callable:
    """For mapInArrow over (lang, source, text): lang, source, ord and count of kept terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Transducer(base, *[np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int32, np.int64, bool))])
                    for base, *raw in sent.value]
        terms = Terms(INSIDE)
        inside = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
        groups: dict[tuple[str, str], int] = {}
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        some: list[tuple[int, bytes]] = []  # groups and pieces of texts, about one piece's bytes in all

        def read() -> None:
            data = np.frombuffer(b" ".join(raw for _, raw in some) + b" ", np.uint8)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[data]]).astype(np.int8)))
            first, size = edge[::2], edge[1::2] - edge[::2]
            ends = np.cumsum([len(raw) + 1 for _, raw in some])
            group = np.array([g for g, _ in some], np.int64)[np.searchsorted(ends, first, side="right")]
            langs = [lang for lang, _ in groups]
            for a in automata:
                begun = np.array([a.begin(lang) for lang in langs], np.int64)[group]
                found, ordinals = a.read(data, first, size, begun[:, 0], begun[:, 1])
                keys = np.sort(group[found] << ORDINAL_BITS | ordinals)
                counts.append(_added([(keys, np.ones(len(keys), np.int64))]))
            some.clear()

        def flush() -> pa.RecordBatch:
            names = list(groups)
            keys, n = _added(counts)
            counts.clear()
            group = pa.array(keys >> ORDINAL_BITS)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in names], pa.string()).take(group) for i in (0, 1)]
                + [pa.array(keys & ((1 << ORDINAL_BITS) - 1)), pa.array(n)], ["lang", "source", "ord", "count"])

        held = 0
        for batch in batches:
            for lang, source, text in zip(*[batch[c].to_pylist() for c in ("lang", "source", "text")]):
                group = groups.setdefault((lang, source), len(groups))
                for piece in terms.pieces(text):
                    some.append((group, piece))
                    held += len(piece)
                    if held >= PIECE:
                        read()
                        held = 0
            if sum(len(k) for k, _ in counts) > 4 * HELD:
                counts[:] = [_added(counts)]
                if len(counts[0][0]) > HELD:
                    yield flush()
            if len(groups) > HELD:
                if some:
                    read()
                    held = 0
                if counts:
                    yield flush()
                groups.clear()
        if some:
            read()
        if counts:
            yield flush()
    return run


def recount(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, ord and count: occurrences of kept terms in the texts of each group, zeros left out.

    Automata are sent to the tasks some SENT_BYTES at a time; the texts stream once through each lot.
    """
    spark = docs.sparkSession
    made = materialize(transducers(kept), "divergence-automata")
    lots: list[list[int]] = []
    size = 0
    for r in made.select("range", "bytes").orderBy("range").collect():  # a row for some RANGE_BYTES of terms
        if not lots or size + r["bytes"] > SENT_BYTES:
            lots.append([])
            size = 0
        lots[-1].append(r["range"])
        size += r["bytes"]
    parts = []
    for lot in lots:
        rows = made.filter(F.col("range").between(lot[0], lot[-1])).select("base", "keys", "targets", "numbers", "final").collect()
        sent = spark.sparkContext.broadcast([tuple(map(_plain, r)) for r in rows])
        parts.append(docs.select("lang", "source", "text").mapInArrow(_recount(sent), "lang string, source string, ord long, count long"))
    if not parts:
        return spark.createDataFrame([], "lang string, source string, ord long, count long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("lang", "source", "ord").agg(F.sum("count").alias("count"))


def _plain(x: int | bytearray) -> int | bytes:
    return bytes(x) if isinstance(x, bytearray) else x


# ---------------------------------------------------------------- shares and differences

def _share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exactly."""
    wide = "decimal(19,0)"
    return F.expr(f"1L + (cast(1000000000 as decimal(10,0)) * cast({count} + 2 as {wide})) div cast({total} + 2 * {terms} as {wide})")


def _differ(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _tile(rows: pa.Table) -> pa.Table:
    """Sums over one tile's terms of the difference of each two sources, the lower number first.

    Rows without an ordinal say, for every source of the tile, its share of a term it lacks."""
    lang, i, j = (rows[c][0].as_py() for c in ("lang", "i", "j"))
    si, ord_, p = (rows[c].to_numpy() for c in ("si", "ord", "p"))
    plain = ord_ < 0
    sources, width = np.unique(si[plain]), int(rows["width"].to_numpy().max())
    share = np.empty((len(sources), width), np.int64)
    share[np.searchsorted(sources, si[plain])] = p[plain][:, None]
    share[np.searchsorted(sources, si[~plain]), ord_[~plain]] = p[~plain]
    left, right, sums = [], [], []
    for a, s in enumerate(sources):
        if s // TILE_SOURCES != i:
            continue
        others = np.flatnonzero((sources > s) & (sources // TILE_SOURCES == j))
        gap = share[others] - share[a]
        left.append(np.full(len(others), s))
        right.append(sources[others])
        sums.append((gap * gap // (share[others] + share[a])).sum(axis=1))
    cols = [np.concatenate(x).astype(np.int64) for x in (left, right, sums)] if left else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array([lang] * len(cols[0]), pa.string()), *map(pa.array, cols)], ["lang", "a", "b", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how each (lang, source) group of ``docs`` (text, lang,
    source) differs from the other sources of its language, and in which terms from the language.

    Null text, lang and source are ''.  Repeated rows are documents of their own; a text without a
    term gives its group alone; a language with no kept term gives value 0 for its pairs and no
    terms.  Equal values go by item in byte order.  Texts are read whole.  An empty table gives an
    empty result; other columns are left aside.
    """
    d = pick(docs, "text", "lang", "source").select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_terms(d, least_docs)
    counts = materialize(recount(d, kept), "divergence-counts")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.min("ord").alias("first"))
    total = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = materialize(
        d.select("lang", "source").distinct().join(of_lang, "lang", "left").join(total, ["lang", "source"], "left")
        .select("lang", "source", number.cast("long").alias("si"), F.coalesce("v", F.lit(0)).cast("long").alias("v"),
                "first", F.coalesce("total", F.lit(0)).cast("long").alias("total")), "divergence-groups")
    shares = materialize(
        attach_small(counts, groups, ["lang", "source"], ["ord"])
        .select("lang", "source", "si", "ord", "first", _share("count", "total", "v").alias("p")), "divergence-shares")
    return _pairs(groups, shares, of_lang).unionByName(_terms(counts, groups, shares, kept, top))


def _pairs(groups: DataFrame, shares: DataFrame, of_lang: DataFrame) -> DataFrame:
    """Part ``pair``: sources meet in tiles of some sources and kept terms; a tile's sums leave it, not its terms."""
    blocks = groups.groupBy("lang").agg((F.floor(F.max("si") / TILE_SOURCES)).alias("most"))
    tiles = of_lang.select("lang", "v", F.explode(F.sequence(F.lit(0), F.floor((F.col("v") - 1) / TILE_TERMS))).alias("tile")).select(
        "lang", "tile", F.least(F.lit(TILE_TERMS), F.col("v") - F.col("tile") * TILE_TERMS).alias("width"))
    none = groups.filter("v = 0").select("lang").distinct().select("lang", F.lit(0).cast("long").alias("tile"), F.lit(0).cast("long").alias("width"))
    plain = groups.join(tiles.unionByName(none), "lang").select(
        "lang", "tile", "si", F.lit(-1).cast("long").alias("ord"),
        F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(1).cast("long").alias("p"), "width")
    place = F.col("ord") - F.col("first")
    met = shares.select("lang", F.floor(place / TILE_TERMS).alias("tile"), "si", (place % TILE_TERMS).alias("ord"), "p",
                        F.lit(0).cast("long").alias("width"))
    block = F.floor(F.col("si") / TILE_SOURCES)
    rows = plain.unionByName(met).join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "most"))).select(
        "lang", "tile", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "si", "ord", "p", "width")
    sums = rows.groupBy("lang", "tile", "i", "j").applyInArrow(_tile, "lang string, a long, b long, value long")
    half = materialize(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")
    both = half.select("lang", "a", "b", "value").unionByName(half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "si", "source")
    named = both.join(names.withColumnRenamed("si", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("si").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))


def _terms(counts: DataFrame, groups: DataFrame, shares: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """Part ``term``: ties go by ordinal; a term's string comes back only for the ranks returned."""
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    of_term = counts.groupBy("lang", "ord").agg(F.sum("count").alias("count"))
    usual = of_term.join(lang_total, "lang").select("ord", _share("count", "total", "v").alias("q"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    best = shares.join(usual, "ord").filter("p > q").select("lang", "source", "ord", _differ("p", "q").alias("value")).withColumn(
        "rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return best.join(kept.select("ord", F.col("term").alias("item")), "ord").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op12_divergence(docs: DataFrame) -> DataFrame:
    """Differences of every source of ``documents`` from the others of its language, and its ten most
    telling terms; ``divergence`` says what nulls, ties, repeated rows and empty tables give."""
    return divergence(docs)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM t) GROUP BY lang, term HAVING count(*) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
         FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) AS p
         FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT kept.lang, kept.term, 1 + (1000000000 * (n + 2)) // (l.total + 2 * v.v) AS q
         FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) kept
         JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) l USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS two, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
         ON s.lang = a.lang AND s.one = a.source AND s.two = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM both_)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR place <= 10
"""
