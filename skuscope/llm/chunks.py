"""Cutting a text where the fixed pre-tokenizers always cut.

A chunk keeps its leading space, so chunks concatenate to the text. Cuts: before a single
space, around a single line end, around runs of white space (the last of them may join the
next word), and between a letter and a comma or full stop that ends a word. Both public
patterns put a boundary at each of these places, so encoding chunk by chunk equals encoding
the text; distinct chunks are few compared with words.

Where texts are normalised first (``spaces_separate``), the letter before a stop must be one
that stays a single letter, whatever precedes it: U+0130 becomes a letter and a mark.
"""

from __future__ import annotations

import re

MARK = "\x01"
_DOUBLED = re.compile(r"\s\s").search
_STOP = re.compile(r"[.,](?<=[^\W\d_].)(?=[ \n]|\Z)").sub
_STEADY_STOP = re.compile(r"[.,](?<=[A-Za-zÀ-ÖØ-öø-ıĲ-ɏ].)(?<!\u0130.)(?=[ \n]|\Z)").sub
#: Runs of the common white space, no other beside them and no special string (``<|``) after them.
_RUN = re.compile(r"(?<!\s)[ \t\n\r]++(?!\s|<\|)").sub


def _around(found: re.Match) -> str:
    run = found[0]
    if found.end() == len(found.string):
        return MARK + run
    head, last = run[:-1], run[-1]
    return (MARK + head if head else "") + MARK + (last if last == " " else last + MARK)


def cut(text: str, spaces_separate: bool) -> list[str]:
    """Chunks of a text; one chunk if a cut isn't certain.

    ``spaces_separate``: white space never joins a token, so runs of it need no care.
    """
    if MARK in text:
        return [text]
    if spaces_separate:
        return _STEADY_STOP(MARK + r"\g<0>", text).replace(" ", MARK + " ").replace("\n", f"{MARK}\n{MARK}").split(MARK)
    text = _STOP(MARK + r"\g<0>", text)
    if _DOUBLED(text):
        return _RUN(_around, text).split(MARK)
    return text.replace(" ", MARK + " ").replace("\n", f"{MARK}\n{MARK}").split(MARK)
