"""Passages of texts, folded so that the same words look the same however they are disguised.

The folding works on the bytes of a whole batch at once; a text costs some hundred nanoseconds a character.
"""

from __future__ import annotations

import re

import numpy as np

from tessella.llm.text import fold

#: Digits and signs that stand for letters inside a word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
ENDS = "\n\r.!?"
WIDE_ENDS = re.compile("[।…。！？]+")
WIDE_SIGNS = re.compile("[«»“”‘’–—•·]+")

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[ord("a") : ord("z") + 1] = True
_WORD = _LETTER.copy()
_WORD[ord("0") : ord("9") + 1] = True
_STAND_IN = np.zeros(256, np.uint8)
for _k, _v in STAND_INS.items():
    _STAND_IN[ord(_k)] = ord(_v)
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " .-_*"]] = True
_INNER = np.zeros(256, bool)
_INNER[[ord(c) for c in ".!?"]] = True
DOC = 0x1E
_CLEAN = bytearray(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
for _c in ENDS:
    _CLEAN[ord(_c)] = 10
for _c in "0123456789":
    _CLEAN[ord(_c)] = ord("0")
_CLEAN[DOC] = DOC
_CLEAN = bytes(_CLEAN)


def _disguises(b: np.ndarray) -> np.ndarray:
    """Undoes stand-ins, letters set apart and letters drawn out, in lower-case UTF-8."""
    n = len(b)
    if n < 8:
        return b
    # letters set apart: three or more single letters with the same sign between them
    word, plain = _WORD[b], _PLAIN[b]
    single = plain.copy()
    single[1:] &= ~word[:-1]
    single[:-1] &= ~word[1:]
    gap = np.zeros(n, bool)
    gap[1:-1] = _GAP[b[1:-1]] & single[:-2] & single[2:]
    chain = np.zeros(n, bool)
    same = gap[:-2] & gap[2:] & (b[:-2] == b[2:])
    chain[:-2] |= same
    chain[2:] |= same
    b = b[~chain]
    # stand-ins: in a word that has letters, all before its last letter, and then those after it
    n = len(b)
    part = _WORD[b] | (_STAND_IN[b] > 0)
    first = part.copy()
    first[1:] &= ~part[:-1]
    starts = np.flatnonzero(first)
    if len(starts):
        of = np.cumsum(first)[part] - 1
        where = np.flatnonzero(part)
        letter = _LETTER[b[where]]
        last = np.full(len(starts), -1)
        np.maximum.at(last, of[letter], where[letter])
        stands = (_STAND_IN[b[where]] > 0) & (last[of] >= 0) & ~((b[where] == ord("@")) & first[where])  # a mention is no word
        inside = stands & (where < last[of])
        disguised = np.zeros(len(starts), bool)
        disguised[of[inside]] = True
        swap = where[stands & disguised[of]]
        b = b.copy()
        b[swap] = _STAND_IN[b[swap]]
    # a full stop or question mark inside a word or number ends nothing
    inner = np.zeros(n, bool)
    inner[:-1] = _INNER[b[:-1]] & _WORD[b[1:]]
    b = np.where(inner, np.uint8(32), b)
    # letters drawn out: three or more of the same become one
    again = np.zeros(n, bool)
    again[1:] = (b[1:] == b[:-1]) & _PLAIN[b[1:]]
    run = again.copy()
    run[1:] &= again[:-1]
    more = again.copy()
    more[:-1] &= again[1:]
    return b[~(run | more)]


def passages(texts: list[str | None], least: int = 8, most: int = 220) -> tuple[list[bytes], np.ndarray]:
    """Sentences and lines of the texts, at most ``most`` bytes each, and the text of each. Every word of a text is in a passage.

    Passages shorter than ``least`` are joined to the next one of their text.
    """
    folded = []
    for t in texts:
        t = fold(t) if t else ""
        if not t.isascii():
            t = WIDE_SIGNS.sub(" ", WIDE_ENDS.sub("\n", t))
        folded.append(t.replace("\x1e", " "))
    data = _disguises(np.frombuffer("\x1e".join(folded).encode("utf-8", "replace"), np.uint8)).tobytes().translate(_CLEAN)
    out: list[bytes] = []
    at: list[int] = []
    for i, doc in enumerate(data.split(b"\x1e")):
        held = b""
        for p in doc.split(b"\n"):
            p = p.strip()
            if not p:
                continue
            if held:
                p, held = held + b" " + p, b""
            if len(p) < least:
                held = p
                continue
            while len(p) > most:
                k = p.rfind(b" ", most // 2, most)
                k = most if k < 0 else k
                out.append(p[:k])
                at.append(i)
                p = p[k:].strip()
            if p:
                out.append(p)
                at.append(i)
        if held:
            out.append(held)
            at.append(i)
    return out, np.array(at, np.int64)
