"""Comparable forms of character names, native names and titles."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

# fixed values: words that stand before or after a name without being part of it
HONORIFICS = frozenset(
    "prof professor dr doctor mr mrs ms miss sir lady lord dame madame captain major general colonel sergeant commander officer agent detective "
    "king queen prince princess saint father mother sister brother uncle aunt master mistress old young "
    "san kun chan sama sensei senpai dono hime".split()
)
# fixed values: what is added to a title for a sequel, a format or a part
_SEQUEL = re.compile(
    r"\s+(?:the movie|movie|the prologue|prologue|after story|reprise|special|ova|ona|tv|(?:\d+(?:st|nd|rd|th)|first|second|third|final) season|season \d+|part \d+|i{2,3}|iv|v|\d+)$"
)
# fixed values: kana by row, in the spelling that canonical() gives
_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ",
    "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ",
}
KANA = {k: c + v for c, row in _ROWS.items() for v, k in zip("aiueo", row)} | {"ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "o", "ン": "n", "ヴ": "bu"}
_SMALL = {"ャ": "a", "ュ": "u", "ョ": "o"}
_KANJI = re.compile(r"[㐀-鿿]")
# fixed values: Hepburn spellings and the shorter ones they are read as
_SPELLING = (
    ("sha", "sya"), ("shu", "syu"), ("sho", "syo"), ("shi", "si"), ("cha", "tya"), ("chu", "tyu"), ("cho", "tyo"), ("chi", "ti"), ("tsu", "tu"),
    ("ja", "zya"), ("ju", "zyu"), ("jo", "zyo"), ("ji", "zi"), ("fu", "hu"), ("ou", "o"), ("oo", "o"), ("oh", "o"), ("uu", "u"),
)


def _plain(text: str) -> str:
    """NFKC without hidden characters."""
    return "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")


def _unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 16)
def canonical(word: str) -> str:
    """A romanised word without marks of length, in one spelling of its syllables."""
    word = _unaccented(word.lower())
    for a, b in _SPELLING:
        word = word.replace(a, b)
    return re.sub(r"(.)\1", r"\1", word)


def name_tokens(name: str | None) -> list[str]:
    """The canonical words of a name, without nicknames in quotes, remarks in brackets and honorifics."""
    if not name:
        return []
    text = re.sub(r"[\"“”«»][^\"“”«»]*[\"“”«»]|\([^)]*\)", " ", _plain(name))
    words = [x for x in re.split(r"[\W_]+", text) if x]
    kept = [x for x in words if x.lower() not in HONORIFICS]
    return [canonical(x) for x in kept or words]


def field(value: str | None, keys: tuple[str, ...]) -> list[str]:
    """The values of a field that holds plain text or a JSON object as text: of `keys` in their order."""
    if value is None or not value.strip():
        return []
    if value.lstrip().startswith("{"):
        try:
            found = json.loads(value)
            return [x for k in keys if isinstance(x := found.get(k), str) and x.strip()]
        except (ValueError, AttributeError):
            pass
    return [value]


def native(text: str | None) -> str | None:
    """A native name without spaces and separators."""
    return re.sub(r"[\s・·＝=\-]", "", _plain(text)) or None if text else None


def reading(text: str | None) -> list[str]:
    """The canonical words of a name in katakana; none for other scripts."""
    out = []
    for word in re.split(r"[\s・·＝=]+", _plain(text or "")):
        got = ""
        for c in word:
            if c in _SMALL and got.endswith("i"):
                got = got[:-1] + "y" + _SMALL[c]
            elif c in KANA:
                got += KANA[c]
            elif c != "ー":
                return []
        if got:
            out.append(canonical(got))
    return out


def is_kanji(text: str) -> bool:
    return bool(_KANJI.search(text))


def title_key(title: str | None) -> str | None:
    """A title in lower case without marks, spaces and what is added for a sequel or a format."""
    if not title:
        return None
    text = re.sub(r"[^\w]+", " ", re.sub(r"['’]", "", _unaccented(_plain(title).lower()))).strip()
    while (shorter := _SEQUEL.sub("", text)) != text:
        text = shorter
    return text.replace(" ", "").replace("_", "") or None


@lru_cache(maxsize=1 << 18)
def distance(a: str, b: str, most: int = 2) -> int:
    """Edits, swaps of neighbours included, between two words; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            new.append(best)
        if min(new) > most + 1:
            return most + 1
        older, old = old, new
    return min(old[-1], most + 1)


def _word_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.7 if a[0] == b[0] else 0.0  # an initial
    d = distance(a, b)
    return 1 - d / max(len(a), len(b)) if d <= 2 else 0.0


def name_similarity(a: list[str], b: list[str]) -> float:
    """From 0 to 1: the same words in any order, few edits of the whole, word by word, or one name of two."""
    if not a or not b:
        return 0.0
    if sorted(a) == sorted(b):
        return 1.0
    best, whole = 0.0, "".join(b)
    for other in {"".join(a), "".join(a[::-1])}:
        d = distance(other, whole)
        if d <= 2:
            best = max(best, 1 - d / max(len(other), len(whole)))
    if len(a) == 1 or len(b) == 1:
        return max(best, 0.8 * max(_word_similarity(x, y) for x in a for y in b))
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    for order in (long, long[::-1]):
        best = max(best, sum(_word_similarity(x, y) for x, y in zip(short, order)) / len(long))
    return best
