"""Exact removal of repeated word windows by a compacted De Bruijn graph.

Windows of ``WINDOW`` words are the edges of a De Bruijn graph: each leads from
its first words to its last.  Edges that follow one another in a text and share
their least ``GRAM``-word hash form a path without branches that every text runs
through alike, so paths, not edges, are shuffled: about one row for eight words.

1. Each text is cut into its paths.  Path rows meet by that least hash.  All
   occurrences of a path but the first (smallest doc_id, start) repeat it whole.
2. Where one least hash starts several different paths the graph branches: their
   first occurrences are joined to their texts again and laid out edge by edge,
   and all occurrences of an edge but its first repeat it.
3. Repeated pieces carry the coordinates of their source.  Joined by document,
   pieces that go on in the text and in the source alike compact to spans.
4. Spans are verified by their source coordinates: a digest of the words at the
   source must equal that of the words at the span.  Spans that pass are removed.

Rows are combined within a batch of documents before any shuffle, so a passage
that a third of all documents share is a few rows for each batch.  Batches are
settled in sort order with one group's state, never a whole group in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import per_batch
from .common import attach, materialize, pick
from .hashing import GROUP, MUL, U64, Powers, WordHasher, mix

#: Words of a window and of the grams whose least hash names a path.
WINDOW, GRAM = 20, 6
#: Rows that share a doc_id but not the text get places of their own from here on.
PART = 1 << 40
NO_ID = -(1 << 63)

class Hasher(WordHasher):
    """Hashes of the words, windows and paths of texts."""

    def __init__(self) -> None:
        super().__init__()
        self.words = Powers(0xD6E8FEB86659FD93)

    def sums(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram hashes, window hashes) at every word where one starts."""
        up, _ = self.words.to(32)

        def longer(left: np.ndarray, right: np.ndarray, by: int) -> np.ndarray:
            n = len(right) - by
            return left[:n] + up[by] * right[by:]
        two = longer(h, h, 1)
        four = longer(two, two, 2)
        six = longer(four, two, 4)
        sixteen = longer(eight := longer(four, four, 4), eight, 8)
        return mix(six), mix(longer(sixteen, four, 16))

    def window_hashes(self, h: np.ndarray) -> np.ndarray:
        return self.sums(h)[1] if len(h) >= WINDOW else np.zeros(0, U64)

    def path_hashes(self, h: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Hash of the words of the paths of ``windows`` windows from word ``first`` on."""
        up, down = self.words.to(len(h) + 1)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(h * up[:-1])])
        return mix((total[first + windows + WINDOW - 1] - total[first]) * down[first] + windows.astype(U64) * U64(MUL))


def least_of_each(grams: np.ndarray) -> np.ndarray:
    """The least gram hash of every window."""
    m = grams
    for by in (1, 2, 4):
        m = np.minimum(m[:-by], m[by:])
    by = WINDOW - GRAM + 1 - 8
    return np.minimum(m[:-by], m[by:])


#: Columns of path rows: least hash, path hash, document, first window, windows (negative: a
#: repeated piece, settled already), and a settled piece's source.
ROWS = "v long, c long, doc long, pos long, n long, src_doc long, src_pos long"


def _own_repeats(windows: np.ndarray, valid: np.ndarray, doc: np.ndarray, run: np.ndarray, length: np.ndarray,
                 starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that repeat an earlier one of their own path, and by how many words earlier.

    Within a path of up to 15 windows that is at most 14 words; longer paths are sorted.
    """
    n = len(windows)
    back = np.zeros(n, np.int64)
    for p in range(WINDOW - GRAM, 0, -1):
        same = (windows[p:] == windows[:-p]) & valid[p:] & (doc[p:n] == doc[:n - p])
        back[p:][same] = p
    for a, k in zip(starts[length > WINDOW - GRAM + 1], length[length > WINDOW - GRAM + 1]):
        _, first, which = np.unique(windows[a:a + k], return_index=True, return_inverse=True)
        gap = np.arange(k) - first[which]
        back[a:a + k] = np.where(gap > 0, gap, back[a:a + k])
    at = np.flatnonzero(back)
    return at, back[at]


def _paths(hasher: Hasher, ids: list[int], parts: list[int], texts: list[bytes]) -> list[np.ndarray]:
    """The ROWS of a group of texts."""
    raw = b"\n".join(texts)
    h, first_byte = hasher.word_hashes(raw)
    none = [np.zeros(0, np.int64)] * 7
    if len(h) < WINDOW:
        return none
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, first_byte, side="right")
    first_word = np.searchsorted(doc, np.arange(len(texts)))
    grams, windows = hasher.sums(h)
    least = least_of_each(grams)
    n = len(windows)
    valid = doc[:n] == doc[WINDOW - 1:]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]) & (doc[1:n] == doc[:n - 1]))
    starts = np.flatnonzero(new)
    if not len(starts):
        return none
    run = np.cumsum(new) - 1
    length = np.bincount(run[valid], minlength=len(starts))
    c = hasher.path_hashes(h, starts, length)
    key, place = np.array(ids, np.int64), np.array(parts, np.int64) * PART
    d = doc[starts]
    zero = np.zeros(len(starts), np.int64)
    paths = [least[starts].view(np.int64), c.view(np.int64), key[d], place[d] + starts - first_word[d], length, zero, zero]
    at, back = _own_repeats(windows, valid, doc, run, length, starts)
    if not len(at):
        return paths
    # Neighbouring windows that repeat by the same distance are one piece.
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (back[1:] != back[:-1]) | (doc[at[1:]] != doc[at[:-1]])]))
    many = np.diff(np.append(head, len(at)))
    at, back = at[head], back[head]
    d = doc[at]
    pos = place[d] + at - first_word[d]
    own = [mix((pos + key[d]).astype(U64)).view(np.int64), np.zeros(len(at), np.int64), key[d], pos, -many, key[d], pos - back]
    return [np.concatenate(x) for x in zip(paths, own)]


def _combined(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of one batch with each path's occurrences but the first turned into settled pieces."""
    v, c, doc, pos, n = cols[:5]
    order = np.lexsort((pos, doc, c, v))
    cols = [x[order] for x in cols]
    v, c, doc, pos, n = cols[:5]
    open_ = n > 0
    same = np.concatenate([[False], (v[1:] == v[:-1]) & (c[1:] == c[:-1]) & open_[1:] & open_[:-1]]) if len(v) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(v)))) if len(v) else np.zeros(0, np.int64)
    same &= ~((doc == doc[first]) & (pos == pos[first]))  # a repeated row is no repeat of itself
    cols[5] = np.where(same, doc[first], cols[5])
    cols[6] = np.where(same, pos[first], cols[6])
    cols[4] = np.where(same, -n, n)
    cols[0] = np.where(same, mix((pos + doc).astype(U64)).view(np.int64), v)
    cols[1] = np.where(same, 0, c)
    return cols


def _start_paths() -> Callable:
    hasher = Hasher()

    def cut(cols: list[list]) -> list:
        out: list[list[np.ndarray]] = []
        ids, parts, texts, size = [], [], [], 0

        def flush() -> None:
            if texts:
                out.append(_paths(hasher, ids, parts, texts))
        for i, p, t in zip(*cols):
            raw = t.encode()
            if size + len(raw) > GROUP:
                flush()
                ids, parts, texts, size = [], [], [], 0
            ids.append(i)
            parts.append(p)
            texts.append(raw)
            size += len(raw)
        flush()
        return [pa.array(x) for x in _combined([np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 7)]
    return cut


PIECES = "doc long, pos long, n long, src_doc long, src_pos long, branch long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ROWS -> PIECES: repeated pieces, and (src_doc null, branch set to the least
    hash) the first occurrences of the paths of hashes that start several.

    What is kept between batches: the last path's first occurrence and whether it
    waits for a second path of its hash.
    """
    names = [f.split(" ")[0] for f in PIECES.split(", ")]
    held: np.ndarray | None = None  # v, c, doc, pos, n of the last path's first occurrence
    waits = False

    def pieces(doc, pos, n, src_doc, src_pos, branch, is_branch: bool) -> pa.RecordBatch:
        none = pa.nulls(len(doc), pa.int64())
        cols = [pa.array(doc), pa.array(pos), pa.array(n)]
        cols += [none, none, pa.array(branch)] if is_branch else [pa.array(src_doc), pa.array(src_pos), none]
        return pa.RecordBatch.from_arrays(cols, names)

    for batch in batches:
        v, c, doc, pos, n, src_doc, src_pos = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        settled = n < 0
        if settled.any():
            yield pieces(doc[settled], pos[settled], -n[settled], src_doc[settled], src_pos[settled], None, False)
        rows = np.stack([x[~settled] for x in (v, c, doc, pos, n)])
        carried = held is not None
        if carried:
            rows = np.concatenate([held[:, None], rows], axis=1)
        if not rows.shape[1]:
            continue
        v, c, doc, pos, n = rows
        new_v = np.concatenate([[True], v[1:] != v[:-1]])
        new = np.concatenate([[True], (c[1:] != c[:-1])]) | new_v
        first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
        again = ~new & ~((doc == doc[first]) & (pos == pos[first]))
        if again.any():
            f = first[again]
            yield pieces(doc[again], pos[again], n[again], doc[f], pos[f], None, False)
        heads = np.flatnonzero(new)
        group = np.cumsum(new_v)[heads]
        many = np.bincount(group)[group]
        out = many > 1
        if carried and not waits:  # the carried path went out before; paths that follow under its hash go out too
            out |= group == group[0]
            out[0] = False
        last = heads[-1]
        waits = not out[-1] and not (carried and not waits and len(heads) == 1)
        held = rows[:, last].copy()
        if out.any():
            k = heads[out]
            yield pieces(doc[k], pos[k], n[k], None, None, v[k], True)


def _settled(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions("v", "c", "doc", "pos").mapInArrow(_settle, PIECES)


def _start_edges() -> Callable:
    hasher = Hasher()

    def lay_out(cols: list[list]) -> list:
        out: list[list[np.ndarray]] = []
        for doc, part, text, starts, lengths, hashes in zip(*cols):
            windows = hasher.window_hashes(hasher.word_hashes(text.encode())[0])
            s, k = np.array(starts, np.int64), np.array(lengths, np.int64)
            at = np.repeat(s - (np.cumsum(k) - k), k) + np.arange(k.sum())
            zero = np.zeros(len(at), np.int64)
            out.append([np.repeat(np.array(hashes, np.int64), k), windows[at].view(np.int64), zero + doc, at + part * PART, zero + 1, zero, zero])
        return [pa.array(x) for x in _combined([np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 7)]
    return lay_out


def compact(starts: np.ndarray, windows: np.ndarray, src_doc: np.ndarray, src_pos: np.ndarray) -> list[np.ndarray]:
    """Pieces of one document, joined where text and source go on alike (pieces of the
    same source that overlap or touch on one diagonal)."""
    order = np.lexsort((starts, src_pos - starts, src_doc))
    s, k, d, p = starts[order], windows[order], src_doc[order], src_pos[order]
    reach = s + k
    same = np.concatenate([[False], (d[1:] == d[:-1]) & (p[1:] - s[1:] == p[:-1] - s[:-1])])
    # The furthest end so far on the diagonal: running maxima, kept apart by the diagonal's number.
    line = np.cumsum(~same)
    top = np.maximum.accumulate(line * (PART * 2) + reach)
    head = np.concatenate([[True], ~same[1:] | (s[1:] + line[1:] * (PART * 2) > top[:-1])])
    at = np.flatnonzero(head)
    end = np.maximum.reduceat(reach, at)
    return [s[at], end - s[at], d[at], p[at]]


def _digest(words: list[bytes], start: int, windows: int) -> int:
    return int.from_bytes(hashlib.sha256(b" ".join(words[start:start + windows + WINDOW - 1])).digest()[:8], "little", signed=True)


def _start_spans() -> Callable:
    def run(cols: list[list]) -> list:
        out: list[list] = [[] for _ in range(7)]
        for doc, part, text, starts, windows, src_doc, src_pos in zip(*cols):
            words = text.encode().split()
            s, k, d, p = compact(*(np.array(x, np.int64) for x in (starts, windows, src_doc, src_pos)))
            for a, n, sd, sp in zip(s.tolist(), k.tolist(), d.tolist(), p.tolist()):
                for col, x in zip(out, (doc, part, a, n, sd, sp, _digest(words, a, n))):
                    col.append(x)
        return out
    return run


def _start_sources() -> Callable:
    def run(cols: list[list]) -> list:
        out: list[list] = [[] for _ in range(4)]
        for doc, part, text, places, windows in zip(*cols):
            words = text.encode().split()
            for p, n in zip(places, windows):
                for col, x in zip(out, (doc, p, n, _digest(words, p % PART, n))):
                    col.append(x)
        return out
    return run


def _start_removal() -> Callable:
    def run(cols: list[list]) -> list:
        out: list[list] = [[] for _ in range(6)]
        for doc, part, text, starts, windows in zip(*cols):
            words = text.encode().split()
            keep = np.ones(len(words) + 1, np.int64)
            if starts:
                s = np.array(starts, np.int64)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, s, 1)
                np.add.at(depth, s + np.array(windows, np.int64) + WINDOW - 1, -1)
                keep = np.cumsum(depth) == 0
                kept = [w for w, k in zip(words, keep.tolist()) if k]
            else:
                kept = words
            whole = b" ".join(kept)
            for col, x in zip(out, (doc, part, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode())):
                col.append(x)
        return out
    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, part, text): doc is doc_id (null ones least), part tells rows that share a
    doc_id but not the text apart; rows that repeat both are one document.  Where a
    doc_id repeats, also (doc, part, times): how many rows each document has."""
    d = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    many = d.select("doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if many.isEmpty():
        return d.select("doc", F.col("doc").bitwiseAND(F.lit(0)).alias("part"), "text"), None  # 0, but no constant: joins keep both keys
    hashed = d.withColumn("h", F.xxhash64("text"))
    parts = materialize(hashed.groupBy("doc", "h").agg(F.count(F.lit(1)).alias("times")).withColumn(
        "part", (F.row_number().over(Window.partitionBy("doc").orderBy("h")) - 1).cast("long")), "repeats-parts")
    keyed = attach(hashed, parts, ["doc", "h"], ["text"]).dropDuplicates(["doc", "part"]).select("doc", "part", "text")
    return keyed, parts.select("doc", "part", "times")


def find_pieces(keyed: DataFrame) -> DataFrame:
    """Repeated pieces (doc, part, starts, windows, sources) by document, unverified."""
    paths = per_batch(keyed.select("doc", "part", "text"), ROWS, _start_paths)
    first = materialize(_settled(paths, "v"), "repeats-paths")
    part_of = F.expr(f"pos div {PART}").alias("part")
    start_of = (F.col("pos") % PART).alias("start")
    branches = first.filter("branch is not null").select("doc", part_of, F.struct(start_of, "n", "branch").alias("b")).groupBy(
        "doc", "part").agg(F.collect_list("b").alias("b"))  # a document's own paths
    open_texts = keyed.join(branches, ["doc", "part"]).select("doc", "part", "text", "b.start", "b.n", "b.branch")
    # edges only look for their like: a hot least hash is dealt by edge (branches found so mean nothing)
    edges = _settled(per_batch(open_texts, ROWS, _start_edges), "v", "c").filter("branch is null")
    return first.filter("branch is null").union(edges).select("doc", part_of, start_of, "n", "src_doc", "src_pos")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """Verified spans (doc, part, start, windows, src_doc, src_pos) of the documents (doc, part, text)."""
    pieces = find_pieces(keyed)
    by_doc = pieces.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n", "src_doc", "src_pos")).alias("p"))  # a document's own
    spans = materialize(per_batch(
        keyed.join(by_doc, ["doc", "part"]).select("doc", "part", "text", "p.start", "p.n", "p.src_doc", "p.src_pos"),
        "doc long, part long, start long, windows long, src_doc long, src_pos long, digest long", _start_spans), "repeats-spans")
    wanted = spans.select(F.col("src_doc").alias("doc"), F.expr(f"src_pos div {PART}").alias("part"), "src_pos", "windows").distinct()
    asked = wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("src_pos", "windows")).alias("w"))  # distinct ranges of one text
    sources = per_batch(keyed.join(asked, ["doc", "part"]).select("doc", "part", "text", "w.src_pos", "w.windows"),
                        "src_doc long, src_pos long, windows long, digest long", _start_sources)
    proven = attach(spans, sources.withColumnRenamed("digest", "source_digest"), ["src_doc", "src_pos", "windows"], ["doc", "part"])
    return proven.filter("digest = source_digest").select("doc", "part", "start", "windows", "src_doc", "src_pos")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (text) of every row of ``docs`` (doc_id, text).

    Removed is each word that a window covers whose words also start earlier: in a
    smaller doc_id, or in the same document.  A null text has no words; rows that
    repeat doc_id and text are one document and each get its result; rows that share
    a doc_id only are documents of their own, ordered by text hash, and a null doc_id
    comes first.  An empty table gives an empty result; other columns are left aside.
    """
    keyed, times = _keyed(docs)
    spans = repeated_spans(keyed)
    lists = spans.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "windows")).alias("s"))  # a document's own
    done = per_batch(keyed.join(lists, ["doc", "part"], "left").select(
        "doc", "part", "text", "s.start", "s.windows"),
        "doc long, part long, n_words long, n_removed long, kept_sha256 string, kept string", _start_removal)
    if times is not None:
        done = done.join(times, ["doc", "part"]).withColumn("row", F.explode(F.array_repeat(F.lit(True), F.col("times").cast("int"))))
    return done.withColumn("doc_id", F.when(F.col("doc") != NO_ID, F.col("doc"))).select(
        "doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def op7_substring_dedup(docs: DataFrame) -> DataFrame:
    """Words of every text of ``documents`` that an earlier window of 20 words covers, and what is left (null texts have none)."""
    return remove_repeats(docs).drop("kept")
