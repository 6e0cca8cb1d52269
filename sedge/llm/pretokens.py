"""Pre-tokens of the byte-level vocabularies.

Every space between two characters that aren't white space begins a pre-token, whatever stands
around it. So a text can be cut there and the cuts' pre-tokens be kept by their wording: words
recur, and the pattern then runs once per distinct cut instead of once per occurrence. A text
in which white space meets a space is matched as a whole.
"""

from __future__ import annotations

import re
from string import punctuation

import public_tokenizers
import regex

SPLIT = regex.compile(public_tokenizers.PATTERN)


def pieces(text: str) -> list[str]:
    """The matches of the pattern; together they are the text."""
    return SPLIT.findall(text)


#: White space that meets a space: then spaces aren't sure to begin pre-tokens.
ODD = re.compile(r" \s|[^\S ] ")


def spaced(cut: str) -> tuple[str, ...]:
    """The pre-tokens of a cut and the space before it. Letters and then punctuation are one each."""
    core = cut.rstrip(punctuation)
    if core.isalpha():
        return (" " + core,) if len(core) == len(cut) else (" " + core, cut[len(core) :])
    return tuple(pieces(" " + cut))
