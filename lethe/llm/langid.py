"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of the bytes that follow every run of up to
``ORDER`` bytes in a bounded sample of its texts.  The trees are frozen, so the
code length of a byte after a context is a fixed number: found in the longest
known context or, after an escape from it (method C: as many escapes as distinct
followers, with the followers already ruled out excluded), in shorter ones, down
to a uniform byte.  A tree is kept as sorted arrays of the contexts and followers
the language really has, all of them, so a model grows with its sample and with
the number of languages only.  The distinct runs of four bytes in a group of texts
are looked up once a language; a text's exact code length under every language is
then a sum of their lengths, and the language of the shortest code wins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import per_batch, small_batches
from .common import attach_small, framed, materialize, pick, restored

ORDER = 3
#: The sample a language is learnt from: documents, bytes of one document, and the
#: pieces that a longer document gives instead of its whole text.
SAMPLE_DOCS = 300
SAMPLE_BYTES = 32_768
SAMPLE_PIECES = 32
#: Texts are scored in pieces of so many bytes, pieces in groups of so many bytes times languages.
PIECE = 1 << 18
GROUP = 1 << 22
UNDETERMINED = "und"
#: Neighbouring bytes are no independent evidence: bits of difference that count as one.
BITS_PER_BIT = 16.0
_PAD = b"\n" * ORDER


def held_out(doc_id="doc_id"):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pieces(text: Column) -> Column:
    """The bytes of a text to learn from: of up to SAMPLE_BYTES the whole text; of a longer one
    SAMPLE_PIECES pieces, one from a hash-chosen place in each equal part of it."""
    data, size = text.cast("binary"), SAMPLE_BYTES // SAMPLE_PIECES
    part = F.floor(F.octet_length(text) / SAMPLE_PIECES).cast("long")

    def piece(k: Column) -> Column:
        at = k * part + F.pmod(F.xxhash64(text, k), part - (size - 1))
        return F.substring(data, (at + 1).cast("int"), F.lit(size))

    spread = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)), piece)
    return F.when(F.octet_length(text) <= SAMPLE_BYTES, F.array(data)).otherwise(spread)


def sample(docs: DataFrame) -> list[tuple[str, list[bytes]]]:
    """Per language, in order: the bytes of up to SAMPLE_DOCS training documents.

    Candidates are distinct documents of any length with a letter; those of the
    smallest hashes of text are taken, long ones in ``pieces`` cut to whole
    characters.  Only the part of the hash range that holds about twice as many
    is ranked.
    """
    d = pick(docs, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
        & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    distinct = materialize(d.groupBy("lang", "h").agg(F.min("doc_id").alias("id")), "langid-candidates")
    cut = F.when(F.col("n") <= 2 * SAMPLE_DOCS, F.lit(2.0 ** 63)).otherwise(
        F.lit(2.0 ** 64) * (2 * SAMPLE_DOCS) / F.col("n") - F.lit(2.0 ** 63))
    cuts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", cut.alias("cut"))
    near = attach_small(distinct, cuts, ["lang"], ["h"]).filter(F.col("h").cast("double") <= F.col("cut"))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= SAMPLE_DOCS).select("lang", "h", "id")
    same = (d["lang"] == chosen["lang"]) & (d["h"] == chosen["h"]) & d["doc_id"].eqNullSafe(chosen["id"])
    rows = d.join(F.broadcast(chosen), same).select(d["lang"], pieces(F.col("text")).alias("pieces")).distinct().collect()  # SAMPLE_DOCS a language
    texts: dict[str, list[bytes]] = defaultdict(list)
    for r in rows:
        texts[r["lang"]] += [bytes(p).decode(errors="ignore").encode() for p in r["pieces"]]
    return sorted((k, sorted(v)) for k, v in texts.items())


def _runs(data: bytes) -> np.ndarray:
    """Every run of ORDER + 1 bytes, as a number whose lowest byte is the last one."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` is in the sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """One language's frozen contexts of up to ORDER bytes and the bytes that follow them.

    A context's followers also follow its suffix, so what an exclusion takes from the
    suffix's total is one number a context: ``down`` holds the bits of that total's
    share, ``escape`` those of leaving it (none where no follower is left).
    """

    def __init__(self, docs: list[bytes]):
        runs = [_runs(_PAD + t) for t in docs if t]
        run, n = np.unique(np.concatenate(runs), return_counts=True) if runs else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.grams, self.contexts, self.counts = [], [], []  # by order: sorted keys, bits of the counts
        self.start, self.leave, self.down, self.escape = [], [], [], []  # by order: bits a context
        shorter = None
        for k in range(ORDER + 1):
            gram, at = np.unique(run & np.uint32(256 ** (k + 1) - 1), return_inverse=True)
            count = np.bincount(at, n, len(gram))
            context, first, kinds = np.unique(gram >> np.uint32(8), return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(gram) else np.zeros(0)
            down, escape = np.zeros(len(context)), np.zeros(len(context))
            if k and len(gram):
                above, above_count, above_context, above_total, above_kinds = shorter
                ruled_out = np.add.reduceat(above_count[_find(above, gram & np.uint32(256 ** k - 1))[0]], first)
                suffix = _find(above_context, context & np.uint32(256 ** (k - 1) - 1))[0]
                left = above_kinds[suffix] - kinds
                share = above_total[suffix] - ruled_out + left
                some = left > 0
                down[some] = np.log2(share[some])
                escape[some] = down[some] - np.log2(left[some])
            self.grams.append(gram)
            self.contexts.append(context)
            self.counts.append(np.log2(count).astype(np.float32))
            self.start.append(np.log2(total + kinds).astype(np.float32))
            self.leave.append((np.log2(total + kinds) - np.log2(kinds)).astype(np.float32))
            self.down.append(down.astype(np.float32))
            self.escape.append(escape.astype(np.float32))
            shorter = gram, count, context, total, kinds
        self.unmet = float(np.log2(256 - len(self.grams[0]))) if len(self.grams[0]) < 256 else 0.0

    def nbytes(self) -> int:
        return sum(a.nbytes for part in vars(self).values() if isinstance(part, list) for a in part)

    def lengths(self, run: np.ndarray) -> np.ndarray:
        """Bits of the last byte of every run, after the bytes before it."""
        bits = np.zeros(len(run), np.float32)
        open_, longer = np.arange(len(run)), np.full(len(run), -1)  # still without a code; their context one byte longer
        for k in range(ORDER, -1, -1):
            r = run[open_]
            context, known = _find(self.contexts[k], (r >> np.uint32(8)) & np.uint32(256 ** k - 1))
            gram, hit = _find(self.grams[k], r & np.uint32(256 ** (k + 1) - 1))
            came = longer >= 0
            start, leave = np.zeros(len(r), np.float32), np.zeros(len(r), np.float32)
            fresh = known & ~came
            start[fresh], leave[fresh] = self.start[k][context[fresh]], self.leave[k][context[fresh]]
            if came.any():
                start[came], leave[came] = self.down[k + 1][longer[came]], self.escape[k + 1][longer[came]]
            bits[open_[hit]] += start[hit] - self.counts[k][gram[hit]]
            miss = ~hit
            bits[open_[miss]] += leave[miss]
            longer = np.where(known, context, -1)[miss]
            open_ = open_[miss]
        bits[open_] += np.float32(self.unmet)
        return bits


class Model:
    """The trees of all languages, in order of their names."""

    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language; a piece's sum does not depend on its group."""
        out = np.zeros((len(texts), len(self.langs)))
        if not out.size:
            return out
        held, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE):  # long texts in pieces, each after the bytes before it
                run = _runs(_PAD + t[:PIECE] if at == 0 else t[at - ORDER: at + PIECE])
                held.append((i, run))
                size += len(run)
                if size * len(self.langs) >= GROUP:
                    self._add(held, out)
                    held, size = [], 0
        if held:
            self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        distinct = np.unique(np.concatenate([run for _, run in held]))
        bits = np.stack([tree.lengths(distinct) for tree in self.trees], axis=1)
        for i, run in held:
            out[i] += bits[np.searchsorted(distinct, run)].sum(axis=0, dtype=np.float64)


def learn(texts: list[tuple[str, list[bytes]]]) -> Model:
    """Freeze the statistics of every language."""
    return Model([k for k, _ in texts], [Tree(docs) for _, docs in texts])


#: A text whose shortest code is longer than its plain bytes, and that by more than
#: this many bits, is in no learnt language.
SLACK_BITS = 64.0


def _predictor(docs: DataFrame) -> Callable[[], Callable[[list], tuple[list, list, list]]]:
    """Learn from ``docs``; the result, run once in a task, gives texts' languages, scores and bits a byte."""
    learnt = learn(sample(docs))
    packed = docs.sparkSession.sparkContext.broadcast(learnt)  # at most SAMPLE_DOCS x SAMPLE_BYTES runs a language

    def start() -> Callable:
        model = packed.value

        def run(texts: list) -> tuple[list, list, list]:
            has = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.langs else []
            pred, scores, rate = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            coded = [texts[i].encode() for i in has]
            for i, t, b in zip(has, coded, model.code_lengths(coded)):
                best = int(b.argmin())
                pred[i] = model.langs[best]
                scores[i] = float(1.0 / np.exp2((b[best] - b) / BITS_PER_BIT).sum())
                rate[i] = float(b[best] / len(t))
            return pred, scores, rate
        return run
    return start


def predict(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """The language of every whole text of ``docs`` (doc_id, text, lang).

    Returns doc_id, held_out, lang_pred, score and bits_per_byte.  Learnt from
    ``train`` (by default ``docs``), never from held-out documents.  A text that is
    null or has no letter is ``und`` with score 0; so is every text when there is
    nothing to learn from.  Equal codes go to the language first by code point.
    Repeated rows each get their row, a null doc_id is not held out, an empty
    table gives an empty result, other columns are left aside.
    """
    predictor = _predictor(docs if train is None else train)

    def start() -> Callable:
        run = predictor()
        return lambda cols: [cols[0], cols[1], *run(cols[2])]

    d = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")
    return per_batch(d, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double", start)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learnt language: not ``und``, and
    with a code no longer than its plain bytes and SLACK_BITS.  No row moves.

    Null and empty texts are ``und`` and go; where no row has a lang nothing is learnt, so
    every text goes; an empty table stays empty."""
    predictor = _predictor(docs)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = predictor()
        for texts in batches:
            pred, _, rate = run(texts.tolist())
            yield pd.Series([p != UNDETERMINED and (r - 8.0) * len(t.encode()) <= SLACK_BITS
                             for p, r, t in zip(pred, rate, texts)], dtype=bool)

    return restored(framed(docs, "text").filter(known("text")), docs)


def op4_langid(docs: DataFrame) -> DataFrame:
    """The language of every whole text of ``documents``; ``predict`` says what null, empty and repeated texts give."""
    return predict(docs)
