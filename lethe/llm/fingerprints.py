"""Document fingerprints by SimHash, and the search for near ones.

Terms are pairs of neighbouring words of the lower-cased text (ASCII letters); a
text of fewer than ``SHORT`` words adds its single words and its runs of four
characters, so that small edits of short texts still leave terms in common.  A
term weighs log2(1 + its count), and its hash votes with that weight for or
against each of the 128 bits.

Near fingerprints are found by permuted block tables: with the bits cut in
radius + 1 blocks, two fingerprints within the radius agree on a whole block, so
in the table that leads with that block they share a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import per_batch, whole_groups
from .common import SALTS, bucket, materialize, meetings, pick
from .hashing import MUL, U64, WordHasher, mix

BITS, RADIUS, SHORT = 128, 6, 16
#: Fingerprints of a bucket compared in one piece; terms whose votes are summed at a time.
PART, PIECE = 2048, 1 << 14


class Fingerprinter:
    """Fingerprints of whole texts, as two unsigned 64-bit words."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def terms(self, raw: bytes) -> np.ndarray:
        words, _ = self.hasher.word_hashes(raw)
        pairs = mix(words[:-1] * U64(MUL) + words[1:])
        if len(words) >= SHORT:
            return pairs
        b = np.frombuffer(raw, np.uint8).astype(U64)
        runs = b[:-3] << U64(24) | b[1:-2] << U64(16) | b[2:-1] << U64(8) | b[3:] if len(b) > 3 else b
        return np.concatenate([pairs, words, mix(runs + U64(1 << 40))])

    def fingerprint(self, text: str) -> np.ndarray:
        terms = self.terms(text.encode("utf-8", "surrogatepass").lower())
        terms, counts = np.unique(terms, return_counts=True)
        weights = np.log2(1.0 + counts).astype(np.float32)
        votes = np.zeros(BITS)
        for at in range(0, len(terms), PIECE):
            t, w = terms[at:at + PIECE], weights[at:at + PIECE]
            bits = np.unpackbits(np.stack([mix(t + U64(MUL * k % 2 ** 64)) for k in (1, 2)], axis=1).view(np.uint8), axis=1, bitorder="little")
            votes += 2.0 * (w @ bits.astype(np.float32)) - float(w.sum())
        return np.packbits(votes > 0, bitorder="little").view("<u8")


def text_of(fp: np.ndarray) -> str:
    return f"{int(fp[1]):016x}{int(fp[0]):016x}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / BITS


def edit(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by the first as many code points of ``after``."""
    k = len(text) // 4
    return text[:len(text) - k] + after[:k]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, fp_low long, fp_high long, part int, place string, text string")
_NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(),
          pa.string(), pa.string()]


def _compared(maker: Fingerprinter, doc_id, text: str, fp: np.ndarray, after: str, after_fp: np.ndarray) -> list:
    edited = edit(text, after)
    edited_fp = fp if edited == text else maker.fingerprint(edited)
    low, high = fp.view(np.int64).tolist()
    return [doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), text_of(fp), text_of(edited_fp),
            likeness(fp, edited_fp), likeness(fp, after_fp), low, high, None, None, None]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order -> each compared with the one after it; the first and the last
    of the partition also as ``head`` and ``tail`` rows with their texts, to be matched later."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    maker = Fingerprinter()
    before = None

    def end(doc_id, text: str, fp: np.ndarray, place: str) -> list:
        low, high = fp.view(np.int64).tolist()
        return [doc_id, len(text), None, text_of(fp), None, None, None, low, high, part, place, text]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    for batch in batches:
        rows = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:2])):
            fp = maker.fingerprint(text)
            rows.append(end(doc_id, text, fp, "head") if before is None else _compared(maker, *before, text, fp))
            before = (doc_id, text, fp)
        if rows:
            yield batch_of(rows)
    if before is not None:
        yield batch_of([end(*before, "tail")])


def _start_tails() -> Callable:
    maker = Fingerprinter()

    def run(cols: list[list]) -> list:
        rows = []
        for doc_id, text, low, high, after, after_low, after_high in zip(*cols):
            fp, after_fp = (np.array(x, np.int64).view(np.uint64) for x in ((low, high), (after_low, after_high)))
            rows.append(_compared(maker, doc_id, text, fp, after, after_fp))
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in _NAMES]
    return run


def compared_in_order(docs: DataFrame) -> DataFrame:
    """SCHEMA's rows, one for each row of ``docs``: its fingerprint, its edited text's and the next document's.

    Texts move once, into ranges of (doc_id, text hash); each range is walked in
    order, and the one document that ends a range meets the first of the next.
    """
    d = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    walked = materialize(d.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(_walk, SCHEMA), "prints-walked")
    done = walked.filter("place is null")
    ends = walked.filter("place is not null")
    parts = sorted(r[0] for r in ends.filter("place = 'tail'").select("part").collect())  # one number a partition
    if not parts:
        return done
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    heads = ends.filter("place = 'head'").select(F.col("part").alias("after"), F.col("text").alias("after_text"),
                                                 F.col("fp_low").alias("after_low"), F.col("fp_high").alias("after_high"))
    tails = ends.filter("place = 'tail'").join(after, "part").join(heads, "after").select(
        "doc_id", "text", "fp_low", "fp_high", "after_text", "after_low", "after_high")
    return done.union(per_batch(tails, SCHEMA, _start_tails))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(low, high) masks of the radius + 1 blocks of the fingerprint."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        mask = ((1 << b) - 1) ^ ((1 << a) - 1)
        out.append((mask & (2 ** 64 - 1), mask >> 64))
    return out


def _signed(x: int) -> int:
    return x - 2 ** 64 if x >> 63 else x


def _count_near(radius: int) -> Callable:
    masks = np.array(blocks(radius), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cut in whole_groups(batches, 4):
            t, _, i, j, part, low, high, docs = cols
            a, b = low.view(np.uint64), high.view(np.uint64)
            ends = np.repeat(np.append(cut[1:], len(t)), np.diff(np.append(cut, len(t))))
            near = np.zeros(len(t), np.int64)
            alive, gap = np.arange(len(t)), 0
            while True:
                gap += 1
                alive = alive[alive + gap < ends[alive]]
                if not len(alive):
                    break
                other = alive + gap
                x, y = a[alive] ^ a[other], b[alive] ^ b[other]
                ok = (np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= radius) & ((i[alive] == j[alive]) | (part[alive] != part[other]))
                if ok.any():
                    p, q, x, y = alive[ok], other[ok], x[ok], y[ok]
                    # A pair counts in the first table whose block it agrees on.
                    first = ((x[:, None] & masks[:, 0]) | (y[:, None] & masks[:, 1]) == 0).argmax(axis=1) == t[p]
                    np.add.at(near, p[first], docs[q[first]])
                    np.add.at(near, q[first], docs[p[first]])
            has = near > 0
            yield pa.RecordBatch.from_arrays([pa.array(low[has]), pa.array(high[has]), pa.array(near[has])], ["fp_low", "fp_high", "near"])
    return run


def count_near(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp_low, fp_high, near): for each fingerprint of ``prints`` (fp_low, fp_high, docs) with any,
    the documents under other fingerprints within ``radius`` bits."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(
        F.col("fp_low").bitwiseAND(F.lit(_signed(lo))), F.col("fp_high").bitwiseAND(F.lit(_signed(hi)))).alias("key"))
        for t, (lo, hi) in enumerate(blocks(radius))])
    rows = prints.withColumn("x", F.explode(tables)).select("x.t", "x.key", "fp_low", "fp_high", "docs", F.xxhash64("fp_low", "fp_high").alias("own"))
    placed = meetings(rows, "own", PART).select("t", "key", "i", "j", "part", "fp_low", "fp_high", "docs")
    return placed.mapInArrow(_count_near(radius), "fp_low long, fp_high long, near long").groupBy("fp_low", "fp_high").agg(F.sum("near").alias("near"))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), their likeness to those of the
    edited text and of the next document, and n_near, the other documents within ``radius`` bits.

    A null text counts as empty; an empty text has no term and fingerprint zero.
    Rows that repeat a doc_id follow one another by text hash; null doc_ids come
    first; a single row is its own next.  An empty table gives an empty result,
    other columns are left aside.
    """
    rows = materialize(compared_in_order(docs).drop("part", "place", "text").withColumn("_part", bucket(SALTS, "doc_id", "edited_sha256")), "prints")
    pairs = rows.groupBy("fp_low", "fp_high", "_part").agg(F.count(F.lit(1)).alias("n"))
    prints = materialize(pairs.groupBy("fp_low", "fp_high").agg(F.sum("n").alias("docs")), "prints-distinct")
    near = count_near(prints, radius)
    of_print = prints.join(near, ["fp_low", "fp_high"], "left").select(
        "fp_low", "fp_high", (F.coalesce("near", F.lit(0)) + F.col("docs") - 1).alias("n_near"))
    of_pair = pairs.select("fp_low", "fp_high", "_part").join(of_print, ["fp_low", "fp_high"])
    return rows.join(of_pair, ["fp_low", "fp_high", "_part"]).drop("_part", "fp_low", "fp_high")


def op6_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text, and how alike they are (null texts are empty)."""
    return fingerprint_documents(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                              "near_edited", "near_next", "n_near")
