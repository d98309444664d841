"""Cutting texts into sentences, and sentences into words."""

from __future__ import annotations

from collections.abc import Iterator

import regex

# A line's leading mark: a dash or bullet, a bracketed or one- to two-letter label.
_MARK_TEXT = r"(?:[-–—•*>]+\s+|\[\w{1,12}\]:?\s+|\w{1,2}:\s+)"
_MARK = regex.compile(_MARK_TEXT + "+")
_END = regex.compile(r"(?<![.!?…])[.!?…]++[\"'»”“’)\]]*+(?=\s)|\n(?=[^\S\n]*+\n)|\n(?=[^\S\n]*+" + _MARK_TEXT + ")")
_WORD = regex.compile(r"\p{L}++")
_FORMAT = regex.compile(r"\p{Cf}+")


def _is_address(token: str) -> bool:
    host, slash, _ = token.partition("/")
    return "://" in token or "www." in token or "@" in token or bool(slash and "." in host.strip("."))


def words(text: str) -> list[str]:
    """Lower-case runs of letters; addresses and invisible format characters do not count."""
    if not text.isascii():
        text = _FORMAT.sub("", text)
    if "www." in text or "/" in text or "@" in text:
        text = " ".join(t for t in text.split() if not _is_address(t))
    return _WORD.findall(text.lower())


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch between sentence ends, without leading marks and outer white space."""
    start = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        at = start
        while at < end and text[at].isspace():
            at += 1
        if (start == 0 or "\n" in text[start - 1 : at]) and (mark := _MARK.match(text, at, end)):
            at = mark.end()
        stop = end
        while stop > at and text[stop - 1].isspace():
            stop -= 1
        if stop > at:
            yield at, stop
        start = end


def sentence_words(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and words of each sentence of the whole text.

    A sentence ends at end marks before white space, at an empty line, and before a line
    that opens with a mark; other line breaks do not end it. Leading marks of a line are no
    part of it, and a stretch without a word is none.
    """
    lower = text.lower()
    plain = len(lower) == len(text) and not ("www." in text or "/" in text or "@" in text) and (text.isascii() or not _FORMAT.search(text))
    if plain:  # the same words, found in place
        find = _WORD.findall
        return [(a, b, w) for a, b in _pieces(text) if (w := find(lower, a, b))]
    return [(a, b, w) for a, b in _pieces(text) if (w := words(text[a:b]))]


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence."""
    return [(a, b) for a, b, _ in sentence_words(text)]
