"""Cutting texts into the pre-tokens of a public BPE tokenizer, exactly as its library does.

The ``regex`` module may know letters of a newer Unicode version than the library. A text that has such a character
is cut by the library itself, so that the pieces are always the library's.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import regex

#: How the two public vocabularies cut a text (their files state the same patterns).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(1)
def newer_characters() -> regex.Pattern:
    """Letters and numbers to ``regex`` that this Python's (and the library's) Unicode tables leave unassigned."""
    found = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    letters = regex.compile(r"[\p{L}\p{N}]")
    found = [c for c in found if letters.match(chr(c))]
    if not found:
        return regex.compile(r"(?!)")
    runs, start, last = [], found[0], found[0]
    for c in [*found[1:], sys.maxsize]:
        if c != last + 1:
            runs.append(f"\\U{start:08x}-\\U{last:08x}")
            start = c
        last = c
    return regex.compile(f"[{''.join(runs)}]")


#: Texts without a character from here on are cut by ``re``, which is faster, with the same classes written out.
PLAIN_END = 0x250
beyond_plain = re.compile(f"[^\\x00-{chr(PLAIN_END - 1)}]").search


def plain_pattern(pattern: str) -> str:
    """The pattern with its three classes spelled for characters below PLAIN_END."""

    def ranges(test) -> str:
        found = [c for c in range(PLAIN_END) if test(chr(c))]
        return "".join(f"\\u{c:04x}" for c in found) if len(found) < 3 else _runs(found)

    letters, numbers = ranges(lambda c: unicodedata.category(c)[0] == "L"), ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = "\\t-\\r \\x85\\xa0"
    return pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


def _runs(points: list[int]) -> str:
    out, start, last = [], points[0], points[0]
    for c in [*points[1:], sys.maxsize]:
        if c != last + 1:
            out.append(f"\\u{start:04x}-\\u{last:04x}")
            start = c
        last = c
    return "".join(out)


@functools.lru_cache(4)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def cutter(path: str) -> Callable[[str], list[str]]:
    """A function from a text to its list of pre-tokens; special strings stay whole. Only for the two BPE files in JSON."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = [t["content"] for t in spec["added_tokens"]]
    folds = spec["normalizer"] is not None
    pattern = WORD_PATTERN if folds else BYTE_PATTERN
    find, find_plain = regex.compile(pattern).findall, re.compile(plain_pattern(pattern)).findall
    newer = newer_characters()
    split = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split
    whole = set(specials)

    def cut(text: str) -> list[str]:
        if folds:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
        if not beyond_plain(text):
            return find_plain(text)
        if not newer.search(text):
            return find(text)
        return [text[a:b] for _, (a, b) in load_tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]

    def cut_all(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return cut(text)
        out: list[str] = []
        for part in split(text):
            if part in whole:
                out.append(part)
            elif part:
                out += cut(part)
        return out

    return cut_all


BLOCK = 1 << 20
_word_end = regex.compile(r"(?<=\S)\s").search


def text_blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in parts of about ``size`` characters, so that a very long text's pre-tokens are never held all at once.

    Parts end before white space that follows other characters. A pre-token starts there in any case, and nothing that
    comes before looks further, so the parts' pre-tokens are the text's.
    """
    at, n = 0, len(text)
    while n - at > size:
        m = _word_end(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
