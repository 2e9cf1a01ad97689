"""Words of texts as they were meant: without markup, marks, soft hyphens and case."""

from __future__ import annotations

import html
import re
import unicodedata

_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|table|h[1-6]|blockquote)\b[^<>]{0,300}>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x180E, *range(0x202A, 0x202F), *range(0x2066, 0x206A)])


def fold(text: str) -> str:
    """NFKD without combining marks and invisible characters, case-folded."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.translate(_INVISIBLE))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def plain(text: str) -> str:
    """The text without tags, entities and escapes."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text).replace("\\n", " ").replace("\\t", " ")
    return text


def words(text: str | None) -> list[str]:
    """The folded words of a text, in order; none for null."""
    return _WORD.findall(fold(plain(text))) if text else []
