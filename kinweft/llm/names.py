"""Typed names as given name, house and ordinal: one spelling for three scripts and many habits."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

# The letters of kana rows and of Cyrillic, written as Latin.
_VOWELS = "aiueo"
_ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ", "w": "ワヰヮヱヲ"}
_KANA = {k: c + v for c, row in _ROWS.items() for k, v in zip(row, _VOWELS)} | {"ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ン": "n", "ヴ": "vu", "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "ya", "ュ": "yu", "ョ": "yo", "ッ": "", "ー": ""}
_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh sch - y - e yu ya".split()))
TITLES = {"big", "little", "lady", "miss", "mister", "mr", "mrs", "ms", "prince", "princess", "papa", "mama", "old", "young", "king", "queen", "sir", "baby", "uncle", "aunt", "dr", "lord", "granny", "grandpa"}
LINKS = {"of", "von", "van", "de", "du", "da", "no", "the"}
#: Endings that no plain name has.
PET = ("chan", "kun", "lein", "tje", "tto")
ENDINGS = ("chan", "kun", "lein", "chen", "tje", "tto", "ette", "ito", "ita", "ie", "y", "ko")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}

_QUOTED = re.compile(r"[\"“”„‟«»‘’']([^\"“”„‟«»‘’']{1,40})[\"“”„‟«»‘’']|\(([^()]{1,40})\)")
_NUMBER = re.compile(r"(?:\b(?:no|nr|num|number)\b\.?|#|№|第)\s*(\d{1,3})|\b(\d{1,3})(?:st|nd|rd|th|世|代目)?\b", re.I)
_WORDED = re.compile(r"\bthe (second|third|fourth|fifth)\b|\b(junior|jr)\b\.?", re.I)
_ORDER = {"second": 2, "third": 3, "fourth": 4, "fifth": 5}
_INITIAL = re.compile(r"^[^\W\d_]$")


class Name(NamedTuple):
    given: str  # "" where only a house is known
    house: str  # "" where the name is a single word
    ordinal: int  # 1 where none is written
    kind: str  # full, open (full, or else a pet form), initial (given is a letter), pet (given is a stem), single, single_pet


def latin(text: str) -> str:
    """Kana and Cyrillic as Latin letters, marks dropped; case kept."""
    out = []
    for c in unicodedata.normalize("NFKC", text):
        if "ぁ" <= c <= "ゖ":
            c = chr(ord(c) + 0x60)
        if c in _KANA:
            out.append(_KANA[c])
        elif c.lower() in _CYRILLIC:
            r = _CYRILLIC[c.lower()].replace("-", "")
            out.append(r.capitalize() if c.isupper() else r)
        else:
            out.append(c)
    t = unicodedata.normalize("NFKD", "".join(out))
    return "".join(c for c in t if not unicodedata.combining(c))


def parse(text: str | None) -> list[Name]:
    """The readings of a typed name: one, or two where its order is open; none for null and blank."""
    if not text or not text.strip():
        return []
    t = _QUOTED.sub(" ", text) if _QUOTED.sub("", text).strip() else text
    t = latin(t.replace("・", " ").replace("･", " ").replace("·", " ").replace("=", " "))
    ordinal = 1
    m = _NUMBER.search(t)
    if m:
        ordinal = int(m[1] or m[2])
        t = t[: m.start()] + " " + t[m.end() :]
    m = _WORDED.search(t)
    if m:
        ordinal = _ORDER.get((m[1] or "").lower(), 2)
        t = t[: m.start()] + " " + t[m.end() :]
    t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t)
    turned = "," in t
    t = re.sub(r"-(?=(?:chan|kun|san|sama)\b)", "", t, flags=re.I)
    t = re.sub(r"(?<=\w)-(?=[a-z])", "", t) if not t.isupper() else t
    ws = [w for w in re.split(r"[^\w.]+|_+", t) if w.strip(".")]
    low = [w.strip(".").lower() for w in ws]
    keep: list[str] = []
    for k, w in enumerate(low):
        if w in _ROMAN and len(low) > 1 and k > 0 and w != "i" and ordinal == 1:
            ordinal = _ROMAN[w]
        elif w in TITLES and len(low) > 1 and k < len(low) - 1:
            continue
        elif w in LINKS and 0 < k < len(low) - 1:
            continue
        elif w:
            keep.append(w)
    keep = ["".join(c for c in w if c.isalnum()) for w in keep]
    keep = [w for w in keep if w]
    if not keep:
        return []
    if len(keep) == 1:
        stem = _stem(keep[0])
        return [Name(keep[0], "", ordinal, "single")] + ([Name(stem, "", ordinal, "single_pet")] if stem else [])
    if len(keep) > 2:
        keep = [keep[0], "".join(keep[1:])]
    a, b = keep
    if turned:
        a, b = b, a
    out = []
    kind = "open" if _stem(a) or _stem(b) else "full"
    for g, h in ((a, b), (b, a)):
        if _INITIAL.match(g) or _INITIAL.match(h):
            if _INITIAL.match(g) and not _INITIAL.match(h):
                out.append(Name(g, h, ordinal, "initial"))
            continue
        if not (g.endswith(PET) and _stem(g)) and not (h.endswith(PET) and _stem(h)):
            out.append(Name(g, h, ordinal, kind))
        if _stem(g) and not (h.endswith(PET) and _stem(h)):
            out.append(Name(_stem(g), h, ordinal, "pet"))
    return out


def _stem(w: str) -> str:
    """What is left of a pet form without its ending; "" for other words."""
    for e in ENDINGS:
        if w.endswith(e) and len(w) - len(e) >= 3:
            return w[: -len(e)]
    return ""
