"""Pre-tokens: pieces of a text that a tokenizer encodes one by one, whatever stands around them.

The SentencePiece model writes a space as U+2581, puts one in front of the text, and has no piece with that
character behind another one, nor any with a line break; so a text splits before each run of spaces and around
each line break. `load` asserts this of the model at hand.
"""

from __future__ import annotations

import re

import public_tokenizers

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
SPACE = "▁"
_SEGMENT = re.compile(r"\n| +[^ \n]*|[^ \n]+")


def piece_segments(text: str) -> list[str]:
    """The pre-tokens of a whole text, spaces written as spaces, the model's dummy prefix included; none if empty."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    return _SEGMENT.findall(" " + text)


def splits_at_spaces(pieces: list[str]) -> bool:
    return not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
