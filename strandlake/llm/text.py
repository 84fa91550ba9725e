"""Words and sentences of documents, the same for every operator on texts."""

from __future__ import annotations

import html
import re
import sys
import unicodedata

import numpy as np

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|a|tt|code|sup|sub)(?:\s[^<>]{0,200})?>", re.I)
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")
_ASCII_ODD = re.compile(r"[<&]")
_NO_WORD = re.compile(r"[\W_]+")
_MARKS = None  # made at first use: one class of all combining characters


def _marks() -> re.Pattern:
    global _MARKS
    if _MARKS is None:
        at = np.flatnonzero([unicodedata.combining(chr(c)) > 0 for c in range(sys.maxunicode + 1)])
        runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
        _MARKS = re.compile("[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]+")
    return _MARKS


def plain(text: str) -> str:
    """Text without markup, accents, letter width and invisible characters, in lower case."""
    if _ASCII_ODD.search(text):
        text = html.unescape(_TAG.sub(" ", _INLINE.sub("", text)))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        if not text.isascii():
            text = _marks().sub("", text).casefold()
    return text.lower()


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[[*b"0123456789"]] = True
_LETTER_CODE = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # powers of the base and of its inverse modulo 2**64, as far as needed so far


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(2 * n, 1 << 16) + 1, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes stirred, so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str | None], numbers_alike: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and the offsets of the texts in them.

    The words are those of ``words``; none is made as an object. A word's hash is a polynomial in its bytes, taken from sums
    over all bytes and stirred, so that two different words share one with a chance of about 2**-64. With ``numbers_alike`` all-digit words count as one.
    """
    parts = []
    for t in texts:
        if not t:
            parts.append(b"")
        elif t.isascii() and "<" not in t and "&" not in t:
            parts.append(t.encode())
        else:
            t = plain(t)
            parts.append((t if t.isascii() else _NO_WORD.sub(" ", t)).encode())
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    b = np.frombuffer(b"\n".join(parts).lower() + b"\n", np.uint8)
    edge = np.diff(np.concatenate([[0], _IS_WORD[b].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER_CODE[b] * up[: len(b)], dtype=np.uint64)])
    h = mixed((total[end] - total[start]) * down[start])
    if numbers_alike:
        digits = np.concatenate([[0], np.cumsum(_IS_DIGIT[b])])
        h[digits[end] - digits[start] == end - start] = 1
    return h, np.searchsorted(start, at)


def in_chunks(texts: list[str | None], chars: int = 2_000_000):
    """(first, texts) in turn, about ``chars`` characters at a time, a longer text alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield at, texts[at:k]
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


# A line of an alignment or sequence block: a name and a long run of residues and gaps, residues alone, a header.
_BLOCK = re.compile(r"^\s*(?:#.*|//|>\S*.*|(?:\S+\s+)?[ACGTUNacgtun.\-_~]{20,}|(?:\S+\s+)?[().<>\[\]{}]{10,})\s*$")
_MARK = re.compile(r"</?(?:p|li|h\d|br|div|tr|td)[^<>]{0,100}>", re.I)
_END = re.compile(r"(?<=[.!?…])[\"”’)]*\s+|\n+")
_LETTER = re.compile(r"[^\W\d_]")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text; lines of sequence blocks and pieces without a word are none."""
    if not text:
        return []
    out = []
    for line in _MARK.sub("\n", text).split("\n"):
        if _BLOCK.match(line):
            continue
        for s in _END.split(line):
            s = s.strip(" \t\r\u00a0\ufeff-*•")
            if len(s) > 1 and _LETTER.search(s):
                out.append(s)
    return out
