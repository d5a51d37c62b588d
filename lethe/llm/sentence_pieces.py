"""SentencePiece ids of whole texts by a table of prefixes, and texts from ids.

Byte-pair pieces merge by score: of all neighbours whose joint string is a piece the
best-scored pair merges first, the leftmost of equals.  Hence (a) a row of pieces is
the code of its string exactly when each two neighbours stay apart if their joint
string is merged alone, and (b) every prefix of a text has one code, so one last
piece.  ``PrefixTable`` keeps that last piece for each prefix: an automaton finds the
pieces that end there, longest first, and the one that is compatible with the last
piece of the prefix before it is the one.  The ids are read off backwards.  This
takes steps in proportion to the text, however long it is without a space.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow  # noqa: F401  (this package's functions travel with the task)
from .common import pick
from .hashtable import Table

#: The character that stands for a space, and the one for bytes that are no character.
SPACE, BROKEN = "▁", "�"
#: Longest stretch whose ids are kept for the next time it comes up, and the number of those kept.
KEPT_CHARS, KEPT = 64, 1 << 18
#: Pairs of pieces whose test is kept: half of two to this power.
PAIR_BITS = 21
#: Characters of texts worked on together, in a task.
TOGETHER = 1 << 20


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_wise(text: str) -> str:
    """``text`` with one character for each of its UTF-8 bytes; none of them is 0xFF."""
    return text.encode().decode("latin-1")


class PrefixTable:
    """The last piece of every prefix of a string, for pieces that merge by score.

    ``scores`` has the score of every piece that may merge.  Characters that occur in
    pieces but are none themselves take part as pieces without a score; characters in
    no piece at all stand for themselves.
    """

    def __init__(self, scores: dict[str, float]):
        import ahocorasick
        self.scores = scores
        self.known = {c for p in scores for c in p}
        self.pieces = [*scores, *sorted(self.known - scores.keys())]
        self.automaton = ahocorasick.Automaton()  # over bytes: its nodes then have few branches
        for i, p in enumerate(self.pieces):
            self.automaton.add_word(byte_wise(p), i)
        self.byte_sizes = [len(p.encode()) for p in self.pieces]
        self.sizes = np.array(self.byte_sizes)
        self.automaton.make_automaton()
        self._flatten()
        self.merges: dict[int, tuple | None] = {}
        self.pairs = Table(PAIR_BITS)

    def _flatten(self) -> None:
        """The automaton as arrays over its states, 0 being the root: ``steps`` by state and byte,
        ``fails``, the state of the longest piece that ends there, and of the next shorter one."""
        _, edges, fails = self.automaton.dump() if self.pieces else ([], [], [])
        children: dict[int, list] = {}
        for parent, label, child in edges:
            children.setdefault(parent, []).append((ord(label), child))
        order = list(set(children) - {child for _, _, child in edges}) or [0]
        spelt = {order[0]: ""}
        for node in order:  # grows: all states, parents first
            for label, child in children.get(node, []):
                spelt[child] = spelt[node] + chr(label)
                order.append(child)
        at = {node: i for i, node in enumerate(order)}
        number = {byte_wise(p): i for i, p in enumerate(self.pieces)}
        self.piece = np.array([number.get(spelt[node], -1) for node in order])
        self.fails = np.zeros(len(order), np.int64)
        for node, back in fails:
            self.fails[at[node]] = at[back]
        self.longest, self.shorter = np.full(len(order), -1), np.full(len(order), -1)
        for i in sorted(range(1, len(order)), key=lambda i: len(spelt[order[i]])):
            self.shorter[i] = self.longest[self.fails[i]]
            self.longest[i] = i if self.piece[i] >= 0 else self.shorter[i]
        self.steps = Table(max(4, (4 * len(edges)).bit_length()))
        self.steps.add(np.array([at[p] << 8 | ord(b) for p, b, _ in edges], np.int64), [at[c] for _, _, c in edges])

    def history(self, piece: int) -> tuple | None:
        """The merges that make ``piece`` alone, in order: their scores, and the first and the last
        part before each and at the end.  None if its string does not become one piece."""
        if piece not in self.merges:
            parts, steps = list(self.pieces[piece]), []
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.scores.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                steps.append((best, parts[0], parts[-1]))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            steps.append((-np.inf, parts[0], parts[-1]))
            self.merges[piece] = tuple(zip(*steps)) if len(parts) == 1 else None
        return self.merges[piece]

    def compatible(self, before: int, piece: int) -> bool:
        """Whether the joint string of two pieces merges into just these two (of one, if ``before`` is -1).

        Each side merges in its own order; whichever score is better goes first, the left
        side's of equals.  They part ways if a merge across the border is ever due.
        """
        right = self.history(piece)
        if before < 0:
            return right is not None
        left = self.history(before)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            across = self.scores.get(left[2][i] + right[1][j])
            own, other = left[0][i], right[0][j]
            if across is not None and across > own and across >= other:
                return False
            if own == other == -np.inf:
                return across is None
            if own >= other:
                i += 1
            else:
                j += 1

    def parts(self, text: str) -> list[str]:
        """The pieces of ``text``, of any length; its characters must be ``known``."""
        raw = byte_wise(text)
        last = [-1] * (len(raw) + 1)  # of the empty prefix too: no piece comes before
        sizes, n, kept = self.byte_sizes, len(self.pieces), {}
        for end, piece in self.automaton.iter(raw) if raw else ():
            end += 1
            if last[end] < 0:
                start = end - sizes[piece]
                before = last[start]
                if before >= 0 or not start:
                    key = (before + 1) * n + piece
                    fits = kept.get(key)
                    if fits is None:
                        fits = kept[key] = self.compatible(before, piece)
                    if fits:
                        last[end] = piece
        found, at = [], len(raw)
        while at:
            found.append(self.pieces[last[at]])
            at -= sizes[last[at]]
        return found[::-1]

    def short_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (by number) of many short texts, one after another, and how many each has.

        The table of all texts is filled side by side: first every prefix of one byte, then
        those of two, and so on.  Characters must be ``known``.
        """
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(size + 1) - size - 1  # place of each text's empty prefix
        data = np.frombuffer(b" ".join(raw), np.uint8).astype(np.int64)
        last = np.full(int((size + 1).sum()), -2)
        last[first] = -1
        state = np.zeros(len(raw), np.int64)
        longest_first = np.argsort(-size, kind="stable")
        going = np.searchsorted(-size[longest_first], -np.arange(int(size.max(initial=0))), side="left")
        for k, n in enumerate(going):  # texts of more than k bytes
            here = longest_first[:n]
            byte = data[first[here] + k]
            todo, old = np.arange(n), state[here]
            while len(todo):
                new = self.steps.find(old << 8 | byte[todo])
                done = (new >= 0) | (old == 0)
                state[here[todo[done]]] = np.maximum(new[done], 0)
                todo, old = todo[~done], self.fails[old[~done]]
            node = self.longest[state[here]]
            here, node = here[node >= 0], node[node >= 0]
            while len(here):
                piece = self.piece[node]
                before = last[first[here] + k + 1 - self.sizes[piece]]
                fit = before >= -1
                fit[fit] = self._fits(before[fit], piece[fit])
                last[first[here[fit]] + k + 1] = piece[fit]
                here, node = here[~fit], self.shorter[node[~fit]]
                here, node = here[node >= 0], node[node >= 0]
        at = first + size
        todo = np.flatnonzero((last[at] >= 0) & (size > 0))
        whose, what = [], []
        while len(todo):
            found = last[at[todo]]
            whose.append(todo)
            what.append(found)
            at[todo] -= self.sizes[found]
            todo = todo[at[todo] > first[todo]]
        if not whose:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        owner, found = np.concatenate(whose[::-1]), np.concatenate(what[::-1])
        return found[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(texts))

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        keys = (before + 1) * len(self.pieces) + piece
        fits = self.pairs.find(keys)
        new = np.unique(keys[fits < 0])
        if len(new):
            answers = [self.compatible(k // len(self.pieces) - 1, k % len(self.pieces)) for k in new.tolist()]
            fits[fits < 0] = np.array(answers, np.int32)[np.searchsorted(new, keys[fits < 0])]
            self.pairs.add(new, answers)
        return fits == 1


class Codec:
    """Ids and texts by a byte-pair model with byte fallback; ValueError for any other model."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        if len(byte_ids) != 256 or any(model.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: pieces of 256 bytes are needed, unused ones are not supported")
        control = [i for i in range(n) if model.is_control(i)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.normalize: Callable[[str], str] = model.normalize
        self.leads = model.normalize("a").startswith(SPACE)  # a space is put before each text
        self.id_of = {names[i]: i for i in plain}
        self.byte_id = {int(names[i][1:-1], 16): i for i in byte_ids}
        self.table = PrefixTable({names[i]: model.get_score(i) for i in plain})
        self.number = np.array([self.id_of.get(p, -1) for p in self.table.pieces])
        self.ends = np.array([model.bos_id(), model.eos_id()], "<u4").tobytes()
        # Nothing merges over a space that follows another character if no piece holds one there.
        self.inside = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.foreign: set[str] = set()  # characters met that are in no piece: nothing merges over them
        self._cut()
        # For decoding: the string of each id, the value of a byte's, the ids that show nothing.
        self.strings = np.array([" \u2047 " if model.is_unknown(i) else names[i] for i in range(n)], object)
        self.strings[control] = ""
        self.values = np.full(n, -1, np.int64)
        for value, i in self.byte_id.items():
            self.values[i] = value
        self.control = np.zeros(n, bool)
        self.control[control] = True
        self.kept: dict[str, bytes] = {}

    def _cut(self) -> None:
        out = re.escape("".join(sorted(self.foreign)))
        alone = f"[{out}]|" if out else ""
        self.stretches = re.compile(f"{alone}[^{out}]+" if self.inside and out else "(?s:.+)" if self.inside
                                    else f"{alone}{SPACE}*[^{SPACE}{out}]+|{SPACE}+")

    def _ids(self, parts: list[str]) -> bytes:
        ids: list[int] = []
        for p in parts:
            known = self.id_of.get(p)
            ids.extend([known] if known is not None else [self.byte_id[b] for b in p.encode()])
        return np.array(ids, "<u4").tobytes()

    def _short(self, texts: list[str]) -> dict[str, bytes]:
        found, n = self.table.short_parts(texts)
        ids = self.number[found]
        raw, to = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
        whole = np.ones(len(n), bool)
        whole[np.repeat(np.arange(len(n)), n)[ids < 0]] = False  # a character of pieces that has no id of its own
        return {t: raw[a:b] if w else self._ids(self.table.parts(t))
                for t, a, b, w in zip(texts, (to - 4 * n).tolist(), to.tolist(), whole.tolist())}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text between begin and end, as little-endian unsigned 32-bit integers."""
        texts = [self.normalize(t) for t in texts]
        foreign = set().union(*texts) - self.table.known
        if not foreign <= self.foreign:
            self.foreign |= foreign
            self._cut()
        stretches = [self.stretches.findall(t) for t in texts]
        met = set(chain.from_iterable(stretches))
        new = [s for s in met if s not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept, new = {}, list(met)
        ids = self.kept
        alone = [s for s in new if s in self.foreign]
        long = [s for s in new if len(s) > KEPT_CHARS]
        ids.update({s: self._ids([s]) for s in alone})
        ids.update({s: self._ids(self.table.parts(s)) for s in long})
        ids.update(self._short([s for s in new if len(s) <= KEPT_CHARS and s not in self.foreign]))
        out = [b"".join([self.ends[:4], *map(ids.__getitem__, parts), self.ends[4:]]) for parts in stretches]
        for s in long:
            del ids[s]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, raw: bytes) -> str:
        """The text of ids as ``encode`` gives them."""
        ids = np.frombuffer(raw, "<u4").astype(np.int64)
        parts = self.strings[ids].tolist()
        values = self.values[ids]
        at = np.flatnonzero(values >= 0)
        if len(at):  # each run of bytes gives characters, at its first place
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                parts[run[0]] = characters(bytes(values[run].astype(np.uint8)))
                for i in run[1:]:
                    parts[i] = ""
        shown = np.flatnonzero(~self.control[ids])
        if self.leads and len(shown) and values[shown[0]] < 0 and parts[shown[0]].startswith(SPACE):
            parts[shown[0]] = parts[shown[0]][1:]
        return "".join(parts).replace(SPACE, " ")


def characters(raw: bytes) -> str:
    """UTF-8 characters of ``raw``; a byte that begins none becomes one BROKEN."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        good = raw[:e.start].decode()
        return good + BROKEN + characters(raw[e.start + 1:]) if len(raw) < 500 else "".join(_one_by_one(raw))


def _one_by_one(raw: bytes) -> Iterator[str]:
    at = 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                yield raw[at:at + size].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            yield BROKEN
        at += size


def codec(path: str) -> Codec:
    """The codec of a file, made once in a worker process: what it has kept serves the worker's later tasks."""
    held = sys.modules.setdefault("held_by_this_worker", types.ModuleType("held_by_this_worker")).__dict__
    if ("codec", path) not in held:
        held["codec", path] = Codec(path)
    return held["codec", path]


def _mapped(df: DataFrame, schema: str, kinds: list[pa.DataType], path: str,
            fn: Callable[[Codec, list], list[list]]) -> DataFrame:
    """Rows (doc_id, text or ids) of ``df`` through ``fn``, which gets some TOGETHER characters of
    the second column at a time and gives the columns after doc_id."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids, values = batch.columns
            at = 0
            while at < batch.num_rows:
                some, size, start = [], 0, at
                while at < batch.num_rows and size < TOGETHER:
                    some.append(values[at].as_py())
                    size += len(some[-1] or "")
                    at += 1
                yield pa.RecordBatch.from_arrays([ids.slice(start, at - start), *[
                    pa.array(x, t) for x, t in zip(fn(c, some), kinds)]], names)
    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers, begin and end included) of
    every row of ``docs`` (doc_id, text), as the model's own library encodes the whole text.

    A null text is empty: begin and end alone.  Repeated rows each get their row, an
    empty table gives an empty result, other columns are left aside.
    """
    return _mapped(pick(docs, "doc_id", "text"), "doc_id long, ids binary", [pa.binary()], path,
                   lambda c, texts: [c.encode_all([t or "" for t in texts])])


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ``coded`` (doc_id, ids as ``encode`` gives them; null: no ids)."""
    return _mapped(pick(coded, "doc_id", "ids"), "doc_id long, text string", [pa.string()], path,
                   lambda c, ids: [[c.decode(x or b"") for x in ids]])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text: ``encode`` and then ``decode`` of every row, in one pass."""
    def both(c: Codec, texts: list) -> list[list]:
        ids = c.encode_all([t or "" for t in texts])
        return [ids, [c.decode(x) for x in ids]]
    return _mapped(pick(docs, "doc_id", "text"), "doc_id long, ids binary, text string", [pa.binary(), pa.string()], path, both)


def op13_sentence_pieces(docs: DataFrame) -> DataFrame:
    """Length and digest of the ids of every whole text of ``documents``, and the digest of the text
    decoded from them; ``encode`` says what null and empty texts, repeated rows and empty tables give."""
    return round_trip(docs, model_path()).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
