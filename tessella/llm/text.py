"""Folding of texts to what they say, whatever their layout and spelling of characters."""

from __future__ import annotations

import html
import re
import unicodedata

#: Small letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
})
#: Characters without a width, as ranges of code points.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")
MARKS = re.compile("[\u0300-\u036f]")
WORD = re.compile(r"[^\W\d_]+")
NUMBER = re.compile(r"\d+")
TOKEN = re.compile(r"[^\W\d_]+|\d+")


def unescape(text: str) -> str:
    """Entities, and the escapes of a text that was stored as one line."""
    if "&" in text:
        text = html.unescape(text)
    if text.count("\\n") > text.count("\n"):
        text = text.replace("\\r", "").replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"').replace("\\'", "'")
    return text


def fold(text: str) -> str:
    """Lower case without entities, invisible characters, accents and look-alikes. Both sides of a comparison are folded."""
    text = unescape(text)
    if text.isascii():
        return text.lower()
    text = MARKS.sub("", unicodedata.normalize("NFKD", INVISIBLE.sub("", text)))
    return text.casefold().translate(LOOKALIKES)
