"""Words of a text as problem 9 compares them."""

from __future__ import annotations

import re
import unicodedata

# the mark comes first and what stands before it is looked at afterwards: so other places are passed by at once
DIVIDED = re.compile(r"[-‐‑­](?<=\w.)[-‐‑­]*[ \t\r]*\n\s*(?=\w)")
INSIDE = re.compile(r"['’ʼ‐‑­-](?<=\w.)(?=\w)|[.,](?<=\d.)(?=\d)")
ACCENT = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
BRACKETED = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}")
WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, without accents, with words joined that a hyphen divides at a line end."""
    text = DIVIDED.sub("", text)
    text = ACCENT.sub("", unicodedata.normalize("NFKD", text)) if not text.isascii() else text
    return text.casefold()


def words_of(text: str) -> list[str]:
    return WORD.findall(INSIDE.sub("", plain(text)))


MARKED = re.compile(r"[^\W_]+|[\[\](){}]")
ACROSS = re.compile(r"[-‐‑­]\s*[\[({]")  # a word may go on after what stands in brackets
SIGNS = frozenset("[](){}")


def readings_of(text: str) -> list[list[str]]:
    """The words with and without what stands in brackets; one list where there are no brackets.

    The text is split once, with its brackets; which of them match is then found out in a line of one sign a word.
    """
    if ACROSS.search(text):
        return readings_apart(text)
    parts = MARKED.findall(INSIDE.sub("", plain(text)))
    line = "".join([p if p in SIGNS else "w" for p in parts])
    bare = blanked(line)
    whole = [p for p in parts if p not in SIGNS]
    return [whole] if bare == line else [whole, [p for p, c in zip(parts, bare) if c == "w"]]


def blanked(line: str) -> str:
    """The line with everything in brackets made blank, nested ones from the inside."""
    while BRACKETED.search(line):
        line = BRACKETED.sub(lambda m: " " * len(m.group()), line)
    return line


def readings_apart(text: str) -> list[list[str]]:
    """The same by splitting the text twice."""
    whole = words_of(text)
    if not BRACKETED.search(text):
        return [whole]
    bare = BRACKETED.sub(" ", text)
    while BRACKETED.search(bare):  # nested ones, from the inside
        bare = BRACKETED.sub(" ", bare)
    return [whole, words_of(bare)]
