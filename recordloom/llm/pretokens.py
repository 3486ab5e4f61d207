"""Cutting text into units that byte-level BPE encodes on their own.

The pattern of these tokenizers never joins a character to one that follows a single space, other than the space
itself, so a text can be cut before each space and every piece (space included) matched by itself.  The cut is
wrong only inside runs of white space with two adjacent spaces; texts that hold such a run are cut by
:data:`COARSE` instead, which keeps the run as the pattern sees it.
"""

from __future__ import annotations

import regex

#: Fixed value: the public pattern of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FINE = regex.compile(PATTERN)
COARSE = regex.compile(r" ?\S+|\s+(?!\S)|\s+")


def pieces(text: str) -> list[str]:
    """Pieces whose pattern matches, one after the other, are the matches of ``text``."""
    if "  " in text:
        return COARSE.findall(text)
    head, *rest = text.split(" ")
    return ([head] if head else []) + [" " + x for x in rest]


def matches(piece: str) -> list[str]:
    return FINE.findall(piece)
