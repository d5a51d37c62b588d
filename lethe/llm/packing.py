"""Packing by shortest-pack-first over the length histogram.

A document's ids and the id 0 after them are cut into pieces of at most ``SIZE``.
The histogram of piece lengths (at most ``SIZE`` entries) is all the driver sees:
lengths are placed longest first into the shortest pack that has room, as counts
of packing patterns, not as single packs.  The pieces of each length, numbered in
Spark, are then joined to the places that the patterns hold for that length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import per_batch
from .common import materialize, pick, ranked

#: Tokens a sequence holds.
SIZE = 1024
#: Id after each document.
END = 0
#: White space in one run from which a text goes to the vocabulary's own library.
LONG_RUN = 50_000
#: How the vocabulary's pre-tokenizer cuts a text into pieces that merge by themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of every ordinary token of a byte-level vocabulary file, by id.

    Such files write byte b as a printable character: itself where it is one,
    else the next unused character from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def read_added(path: str) -> dict[str, int]:
    """The vocabulary file's added tokens: whole strings that stand for one id wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    for t in added:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} is not taken literally")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """Ids of whole texts, as the vocabulary's own library gives them.

    ``encode`` cuts a text at the added tokens, leftmost first and longest among
    those that start together; ``ids`` takes all of a text as ordinary text.
    Where no two white-space characters meet, the last two branches of PIECES
    come down to single characters; leaving their look-ahead out is faster.  The
    look-ahead uses up its stack in a very long run of white space: a text with one
    is encoded by the library itself, which is slower.
    """

    def __init__(self, path: str):
        import tiktoken
        self.path = path
        ranks = read_ranks(path)
        self.added = read_added(path)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        plain = PIECES.replace(r"|\s+(?!\S)|\s+", r"|\s")
        self.any, self.plain = (tiktoken.Encoding("ids", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
                                for p in (PIECES, plain))
        self.gap = re.compile(r"\s\s")
        self.runs = re.compile(r"\s+")
        self.library = None

    def ids(self, text: str) -> list[int]:
        return (self.any if self.gap.search(text) else self.plain)(text)

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in self.runs.finditer(text)):
            if self.library is None:
                from tokenizers import Tokenizer
                self.library = Tokenizer.from_file(self.path)
            return self.library.encode(text, add_special_tokens=False).ids
        parts = self.cuts.split(text) if self.cuts else [text]
        if len(parts) == 1:
            return self.ids(text)
        out: list[int] = []
        for i, part in enumerate(parts):  # every second part is an added token
            out += [self.added[part]] if i % 2 else self.ids(part)
        return out


def _start_cutting(path: str, size: int) -> Callable:
    encoder = Encoder(path)

    def cut(cols: list[list]) -> list:
        out: list[list] = [[] for _ in range(5)]
        for doc_id, text in zip(*cols):
            ids = np.array([*encoder.encode(text or ""), END], "<u4")
            for start in range(0, len(ids), size):
                piece = ids[start:start + size]
                for col, v in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                    col.append(v)
        return out

    return cut


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece of ``docs`` (doc_id, text)."""
    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long",
                     lambda: _start_cutting(path, size))


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs, by shortest-pack-first from the longest length down."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by tokens used
    done: list[tuple[int, tuple[int, ...]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown: list[tuple[int, tuple[int, ...]]] = []
        while left:
            used = min((u for u in open_packs if u + length <= size), default=0)
            if not used:
                # One pack takes as many pieces of this length as fit.
                fit = size // length
                full, rest = divmod(left, fit)
                grown += [(full, (length,) * fit)] * bool(full) + [(1, (length,) * rest)] * bool(rest)
                left = 0
                continue
            count, pack = open_packs[used].pop()
            if not open_packs[used]:
                del open_packs[used]
            take = min(count, left)
            if take < count:
                open_packs[used].append((count - take, pack))
            left -= take
            longer = (take, (*pack, length))
            open_packs[used + length].append(longer)
        for count, pack in grown:
            open_packs[sum(pack)].append((count, pack))
        for pack in open_packs.pop(size, []):
            done.append(pack)
    return done + [p for u in sorted(open_packs) for p in open_packs[u]]


def places(packs: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, list[int], list[int], list[int], list[int]]]:
    """Per length: running counts of its places, and of each run of places the
    first sequence, the offset of the first place and the places one sequence has."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    first = 0
    for count, pack in packs:
        offset = 0
        for length, times in sorted(Counter(pack).items(), reverse=True):
            by_length[length].append((count * times, first, offset, times))
            offset += length * times
        first += count
    out = []
    for length, runs in sorted(by_length.items()):
        ends = np.cumsum([r[0] for r in runs]).tolist()
        out.append((length, ends, [r[1] for r in runs], [r[2] for r in runs], [r[3] for r in runs]))
    return out


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id, text) in its sequence.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (from 0) and
    offset.  A null or empty text is the id 0 alone.  Rows that repeat a doc_id are
    packed each, null doc_ids are kept, an empty table gives an empty result and
    other columns are left aside.  ``path`` names the vocabulary file on every
    executor, by default the installed one's.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path or tokenizer_path(), size), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(places(patterns(histogram, size)),
                                  "length long, ends array<long>, firsts array<long>, offsets array<long>, times array<long>")
    # Pieces of a length that repeat a (doc_id, start) are told apart by their checksum or are alike.
    numbered = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], "rank")
    run = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    placed = numbered.join(F.broadcast(table), "length").withColumn("run", run + 1)  # one row a length
    before = F.when(F.col("run") > 1, F.element_at("ends", F.col("run") - 1)).otherwise(F.lit(0))
    placed = placed.withColumn("nth", F.col("rank") - before).withColumn("times", F.element_at("times", F.col("run")))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.element_at("firsts", F.col("run")) + F.expr("nth div times")).alias("sequence_id"),
        (F.element_at("offsets", F.col("run")) + F.expr("nth % times") * F.col("length")).alias("offset"))


def op8_packing(docs: DataFrame) -> DataFrame:
    """Every piece of every text of ``documents`` with its place in a sequence; null and empty texts give the id 0 alone."""
    return pack(docs)
