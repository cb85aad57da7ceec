"""What looks alike: the character table of problem 8.

``of_char`` gives the look of one character, the edges of the vocabulary trie of
:mod:`coilworks.llm.canonical`; ``skeleton`` spells a whole text by it and stands
for what the vocabulary does not have.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# fixed values: letters of another script that look like a Latin letter, and that letter
CYRILLIC = "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХІЈЅҮԌ"
CYRILLIC_AS = "aeopcyxijshdqwlABEKMHOPCTXIJSYG"
GREEK = "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ"
GREEK_AS = "oABEZHIKMNOPTYXcj"

# fixed values: letters that look like a Latin one in many typefaces but are signs of their own too (Hα, Δν); read
# as that letter only where a word mixes alphabets and the corpus has the word so spelled
WEAK = "αγικνρτυωкмт"
WEAK_AS = "ayikvptuwkmt"

# fixed values: two code points of one sign that canonical decomposition leaves apart
TWINS = {"\u00b5": "\u03bc", "\u2206": "\u0394", "\u2211": "\u03a3", "\u220f": "\u03a0", "\u2011": "\u2010"}

#: characters written as two or more letters: Latin ligatures, digraphs and Roman numerals
DIGRAPHS = ((0xFB00, 0xFB17), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F))

_ALIKE = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS, strict=True)) | TWINS


def _ignorable(ch: str) -> bool:
    """Invisible: format characters, variation selectors, joiners and fillers."""
    code = ord(ch)
    return unicodedata.category(ch) == "Cf" or code == 0x034F or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5) or 0x180B <= code <= 0x180F


@lru_cache(maxsize=None)
def of_char(ch: str) -> str:
    """What one character contributes to the skeleton."""
    if ch.isascii():
        return ch
    if _ignorable(ch):
        return ""
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    wide = unicodedata.decomposition(ch)
    if wide.startswith(("<wide>", "<narrow>")):
        return "".join(of_char(chr(int(x, 16))) for x in wide.split()[1:])
    if wide.startswith("<compat>") and any(a <= ord(ch) <= b for a, b in DIGRAPHS):
        return "".join(of_char(chr(int(x, 16))) for x in wide.split()[1:])
    return "".join(_ALIKE.get(c, c) for c in unicodedata.normalize("NFD", ch))


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = value = of_char(chr(code))
        return value


_TABLE = _Table()
_WEAK_TABLE = str.maketrans(WEAK, WEAK_AS)


def coarse(text: str) -> str:
    """The skeleton with weak look-alikes as Latin letters: equal for all that may look alike, and for more."""
    return skeleton(text).translate(_WEAK_TABLE)


def skeleton(text: str) -> str:
    """Equal for two texts exactly if they look the same; ASCII text is its own skeleton."""
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_TABLE)))


def words(text: str) -> list[str]:
    """Words for comparison: skeleton in lower case, cut at white space, letters and digits only."""
    out = []
    for w in skeleton(text).lower().split():
        if not w.isalnum():
            w = "".join(c for c in w if c.isalnum())
        if w:
            out.append(w)
    return out
