"""Texts to comparable words."""

from __future__ import annotations

import html
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
#: Characters without width, soft hyphens and combining marks, as they stand after decomposition.
_UNSEEN = re.compile("[­̀-ͯ؜᠎​-‏‪-‮⁠-⁤︀-️﻿]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[^\S\n]*\n[\s>|]*(?=[^\W\d_])")
_FOREIGN = re.compile("[Ͱ-ӿ]")
_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")

# Letters of other scripts that look like Latin ones, and Latin letters without a decomposition.
_LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
        "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    }
)
_LETTERS = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def words(text: str) -> list[str]:
    """The words of ``text`` in small letters without accents.

    Entities, escapes, twice-encoded characters, look-alike letters, characters without width, words broken at the end
    of a line and all punctuation and layout are undone or left out.
    """
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    if not text.isascii():
        if _MOJIBAKE.search(text):
            try:
                text = text.encode("cp1252").decode("utf-8")
            except UnicodeError:
                pass
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_LETTERS)
        if _FOREIGN.search(text):
            text = text.translate(_LOOKALIKES)
    else:
        text = text.lower()
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text)
