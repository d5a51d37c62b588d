"""Terms of texts as runs of bytes of UTF-8: with A-Z lower-cased, every byte from 0x80 on is inside one."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text worked on at a time.
PIECE = 1 << 20


class Terms:
    """Runs of ``inside`` (a bytes class of ASCII characters, without brackets) and bytes above 0x7F."""

    def __init__(self, inside: str):
        body = inside.encode() + rb"\x80-\xff"
        self.find_all = re.compile(b"[" + body + b"]+").findall
        self._outside = re.compile(b"[^" + body + b"]")

    def pieces(self, text: str | None) -> Iterator[bytes]:
        """The lower-cased bytes of ``text`` in pieces of about PIECE bytes, cut only between terms."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
        at = 0
        while at < len(raw):
            m = self._outside.search(raw, at + PIECE)
            to = m.end() if m else len(raw)
            yield raw[at:to]
            at = to
