"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared in blocks of 64: bit plane b of a block is one word
that holds bit b of all its fingerprints, so one XOR gives a difference bit for
64 fingerprints, and carry-save counters (one word per counter bit) keep 64
distances at once.  A block is abandoned once every distance is past the radius.

Which blocks meet: fingerprints within ``radius`` bits agree on at least one of
the choices of all but ``radius`` of more than ``radius`` bit ranges.  Each choice
makes a bucket of equal masked values; buckets are dealt in parts of about
``PART`` fingerprints, and each pair of parts is compared by itself, so a bucket
of any size is spread over tasks and no pair is left out.  A task returns the
links that connect its fingerprints, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import per_batch, whole_groups
from .common import SALTS, attach, bucket, framed, materialize, meetings, pick, restored
from .graph import components

#: Words of a shingle, bits two linked fingerprints may differ in, seed of the shingle hash.
SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of a bucket compared in one piece.
PART = 2048
#: Entries (query and word of 64 lanes) whose hits are laid out at a time.
HITS = 1 << 13
#: Shingles whose bits are counted at a time.
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is set if over half of the shingle hashes set it."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = words[at:at + PIECE + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (long) of every row."""
    def start() -> Callable:
        return lambda cols: [cols[0], cols[1], [fingerprint(t, shingle) for t in cols[2]]]
    d = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return per_batch(d, "doc_id long, text_hash long, fp long", start)


def masks(ranges: int, radius: int) -> list[int]:
    """Signed 64-bit masks of all choices of ``ranges - radius`` of the bit ranges."""
    cuts = [64 * i // ranges for i in range(ranges + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    whole = [sum(c) for c in combinations(each, ranges - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def ranges_for(n: int, radius: int) -> int:
    """The fewest bit ranges whose masks leave about PART of ``n`` random fingerprints a bucket."""
    ranges = radius + 1
    while ranges < 2 * radius + 2 and n >> (64 * (ranges - radius) // ranges) > PART:
        ranges += 1
    return ranges


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def past_radius(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare query i with the 64 lanes of word ``words[i]``, for all i at once.

    ``over`` marks lanes left out from the start.  Returns the entries that end
    with a lane within the radius, and those lanes' complement.
    """
    alive = np.arange(len(queries))
    levels = radius.bit_length()
    counters = [np.zeros(len(queries), np.uint64) for _ in range(levels)]
    over = over.copy()
    for b in range(64):
        carry = planes[b][words] ^ (np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1)))
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            # Lanes past the radius: a counter overflowed, or its bits exceed the radius.
            above, equal = over.copy(), ~over
            for k in reversed(range(levels)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            stay = above != ALL
            if b == 63:
                return alive[stay], above[stay]
            if not stay.all():  # whole blocks are abandoned
                alive, words, queries, over = alive[stay], words[stay], queries[stay], over[stay]
                counters = [c[stay] for c in counters]
                if not len(alive):
                    break
    return alive, over


def lanes(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of groups of fingerprints: (planes, first word of each group, first
    fingerprint of each word, lanes of each word that are empty)."""
    n_words = (sizes + 63) // 64
    first = np.cumsum(n_words) - n_words
    at = np.repeat(starts - 64 * first, n_words) + 64 * np.arange(n_words.sum())
    held = np.minimum(64, np.repeat(starts + sizes, n_words) - at)
    order = np.repeat(at, held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    lane = (order - np.repeat(at, held)).astype(np.uint64)
    f, cut = fps[order], np.cumsum(held) - held
    planes = np.empty((64, len(at)), np.uint64)
    for b in range(64):
        planes[b] = np.bitwise_or.reduceat(((f >> np.uint64(b)) & np.uint64(1)) << lane, cut) if len(cut) else 0
    empty = np.where(held < 64, ALL << np.minimum(held, 63).astype(np.uint64), np.uint64(0))
    return planes, first, at, empty


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] and b[i]: each node gets the smallest label it reaches."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        low = np.minimum(la[apart], lb[apart])
        np.minimum.at(labels, la[apart], low)
        np.minimum.at(labels, lb[apart], low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def links(fps: np.ndarray, side: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group of rows, the fingerprints within ``radius``.

    Groups begin at ``starts``.  A group whose ``side`` is all False is compared with
    itself; in others the rows of side False (first) meet those of side True.
    """
    n = len(fps)
    ends = np.append(starts[1:], n)
    right = np.add.reduceat(side.astype(np.int64), starts)
    left = np.where(right > 0, ends - starts - right, ends - starts)
    lane_start = np.where(right > 0, starts + left, starts)
    lane_size = np.where(right > 0, right, ends - starts)
    planes, first, word_at, empty = lanes(fps, lane_start, lane_size)
    n_words = (lane_size + 63) // 64
    labels = np.arange(n)
    # One entry for each query and word of its group; within a group, words from the query's own on.
    group = np.repeat(np.arange(len(starts)), left)
    query = np.repeat(starts - (np.cumsum(left) - left), left) + np.arange(left.sum())
    own = np.where(right[group] > 0, 0, (query - starts[group]) // 64)
    times = n_words[group] - own
    total = np.cumsum(times)
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 17))))
        t = times[at:to]
        q = np.repeat(query[at:to], t)
        g = np.repeat(group[at:to], t)
        w = np.repeat(first[group[at:to]] + own[at:to], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        over = empty[w].copy()
        same = (right[g] == 0) & (word_at[w] + 64 > q) & (word_at[w] <= q)
        place = (q[same] - word_at[w[same]]).astype(np.uint64)
        over[same] |= ALL >> (np.uint64(63) - place)  # lanes up to the query's own
        hit, out = past_radius(planes, w, fps[q], over, radius)
        for some in range(0, len(hit), HITS):  # among near copies every lane may be one
            some_hits, some_out = hit[some:some + HITS], out[some:some + HITS]
            i, lane = np.nonzero(np.unpackbits((~some_out).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            labels = join_labels(labels, q[some_hits[i]], word_at[w[some_hits[i]]] + lane)
        at = to
    linked = np.nonzero(labels != np.arange(n))[0]
    return linked, labels[linked]


def _compare(radius: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cut in whole_groups(batches, 4):
            a, b = links(cols[5].view(np.uint64), cols[4] != cols[2], cut, radius)
            yield pa.RecordBatch.from_arrays([pa.array(cols[5][a]), pa.array(cols[5][b])], ["a", "b"])
    return run


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fps`` (fp) within ``radius`` bits."""
    n = fps.count()
    choices = masks(ranges_for(n, radius), radius)
    each = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(choices)])
    rows = fps.select("fp", F.explode(each).alias("x")).select("x.t", "x.key", "fp")
    return meetings(rows, "fp", PART).mapInArrow(_compare(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp and component_id of every row of ``docs`` (doc_id, text).

    Documents link when their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id reachable (null where no doc_id is known),
    component_hash the smallest text hash that this doc_id has there.  Texts
    without a word, null ones too, have fingerprint zero and link like any other.
    Repeated rows each get their row, an empty table gives an empty result, other
    columns are left aside.
    """
    prints = materialize(fingerprints(docs, shingle).withColumn("part", bucket(SALTS, "doc_id", "text_hash")), "simhash-prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    pairs = materialize(prints.groupBy("fp", "part").agg(F.min(first).alias("first")), "simhash-pairs")
    nodes = materialize(pairs.groupBy("fp").agg(F.min("first").alias("first")), "simhash-nodes")
    roots = components(materialize(near_links(nodes.select("fp"), radius), "simhash-links"))
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "first")
    classes = linked.groupBy("root").agg(F.min("first").alias("least"))
    of_linked = attach(linked.select("fp", "root"), classes, ["root"], ["fp"]).select("fp", "least")
    of_print = nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))
    return prints.join(pairs.select("fp", "part").join(of_print, "fp"), ["fp", "part"]).select(
        "doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("component_hash"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: one of its smallest doc_id
    and, where rows share that doc_id, of the smallest text hash."""
    found = near_duplicates(docs).filter(
        F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("component_hash")))
    chosen = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    keyed = framed(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    kept = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    return restored(kept.dropDuplicates(["doc_id", "text_hash"]), docs)


def op3_simhash_dedup(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; ``near_duplicates`` says what nulls and repeated rows give."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
