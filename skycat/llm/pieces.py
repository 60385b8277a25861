"""Cutting a text at single spaces between non-spaces.

The pre-tokenizer's pattern always ends a match before such a space, and no match
reaches over it, so the pieces can be encoded one by one and the results joined.
Pieces repeat, so an encoder keeps what it found for the last ones.
"""

from __future__ import annotations

import re

#: Longest piece that is remembered, and how many pieces a worker remembers (about 120 MB).
MEMO_CHARS = 48
MEMO_PIECES = 600_000


_RARE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")


def plain(text: str) -> bool:
    """Whether every space of the text stands alone between two non-spaces."""
    if text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text:
        return False
    return _RARE.search(text) is None


def pieces(text: str) -> list[str]:
    """The text's pieces in order; all but the first begin with their space."""
    parts = text.split(" ")
    if plain(text):
        return [parts[0], *[" " + p for p in parts[1:]]]
    # runs of white space: a cut needs a non-space on both sides
    out, run = [], [parts[0]]
    for p in parts[1:]:
        last = run[-1]
        if last and not last[-1].isspace() and p and not p[0].isspace():
            out.append(" ".join(run))
            run = ["", p]
        else:
            run.append(p)
    out.append(" ".join(run))
    return out


class Memo(dict):
    """piece -> encoded bytes; forgets all when full, so its memory is bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = found
        return found
