"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, plus signs,
digits, scheme separators and identifier cues.  A deterministic parser for the
anchor's kind expands it to both sides, within the text and beyond the end of
the kind's last match, and validates what it found.  Positions count code points.

Kinds, in the order in which spans that start together are listed:
email, ip, card, phone (the base kinds), then url and account, which the method
adds: addresses with a scheme or ``www.``, and identifiers that follow a cue.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import per_batch
from .common import framed, pick, restored

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Cues that an identifier follows.
CUES = ("account", "acct", "iban", "ssn", "passport", "password", "passwd", "api_key", "apikey", "token", "secret")
#: Starts of identifiers that need no cue.
PREFIXES = ("AKIA", "ghp_")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_AFTER_CUE = re.compile(r"(?:\s{0,3}(?:no\.?|number|id|#))?\s{0,3}[:=#]?\s{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9+/_-]{5,})")
_KEY = re.compile(r"[A-Za-z0-9_]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for w in ("www.", "WWW."):
        a.add_word(w, ("www", 4))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    for p in PREFIXES:
        a.add_word(p, ("key", len(p)))
    a.make_automaton()
    return a


def _word_before(text: str, at: int) -> bool:
    return at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")


def find_spans(text: str, anchors: ahocorasick.Automaton) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of every span in ``text``, in no particular order."""
    done = dict.fromkeys(KINDS, 0)  # where each kind may go on
    for last, (kind, length) in anchors.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= done["ip"]:
                if m := _IP.match(text, at):
                    done["ip"] = m.end()
                    if all(len(p) <= 3 and int(p or "0") <= 255 for p in (d.lstrip("0") for d in m[0].split("."))):
                        yield at, m.end(), "ip"
                else:
                    done["ip"] = _DIGITS.match(text, at).end()
            if at >= done["card"]:
                if m := _CARD.match(text, at):
                    done["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        yield at, m.end(), "card"
                else:
                    done["card"] = at + 1
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                yield start, m.end(), "email"
        elif kind == "phone":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    yield at, m.end(), "phone"
        elif kind == "url" or kind == "www":
            start = at
            if kind == "url":
                while start > done["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
            if at >= done["url"] and (start < at if kind == "url" else not _word_before(text, at)) and (m := _URL_REST.match(text, last + 1)):
                rest = m[0].rstrip(".,;:!?)")
                host = rest.split("/", 1)[0]
                if "." in host.strip(".") or (kind == "www" and host):
                    done["url"] = last + 1 + len(rest)
                    yield start, done["url"], "url"
        elif kind == "cue":
            if at >= done["account"] and not _word_before(text, at) and (m := _AFTER_CUE.match(text, last + 1)):
                if sum("0" <= c <= "9" for c in m[1]) >= 4:
                    done["account"] = m.end(1)
                    yield m.start(1), m.end(1), "account"
        elif at >= done["account"] and not _word_before(text, at) and (m := _KEY.match(text, at)):
            done["account"] = m.end()
            yield at, m.end(), "account"


_ORDER = {k: i for i, k in enumerate(KINDS)}


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    return sorted(find_spans(text, anchors), key=lambda s: (s[0], _ORDER[s[2]]))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += (text[at:start], f"[{kind.upper()}]")
        at = end
    return "".join([*out, text[at:]])


def _start_scan() -> Callable:
    anchors = automaton()

    def scan(cols: list[list]) -> list:
        ids, texts = cols
        counts: list[list[int]] = [[] for _ in BASE]
        digests, listed = [], []
        for t in texts:
            spans = spans_of(t or "", anchors)
            for n, k in zip(counts, BASE):
                n.append(sum(s[2] == k for s in spans))
            digests.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if _ORDER[k] < 4).encode()).hexdigest())
            listed.append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
        return [ids, *counts, digests, listed]

    return scan


def scan(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.  A null
    text counts as empty and has no span; repeated rows each get their row; null
    doc_ids are kept; an empty table gives an empty result; other columns are left
    aside.  One pass, no shuffle.
    """
    return per_batch(pick(docs, "doc_id", "text"),
                     "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", _start_scan)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets and
    ``n_chars`` counted anew; a null text stays null, all other columns stay."""
    def start() -> Callable:
        anchors = automaton()

        def clean(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else redacted(t, spans_of(t, anchors)))
        return clean

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        clean = start()
        for texts in batches:
            yield clean(texts)

    out = framed(docs, "text").withColumn("clean", cleaned("text"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("clean").cast("long")
    return restored(out, docs, **changed)


def op9_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text of ``documents`` (null texts are empty), the base kinds digested."""
    return scan(docs)
