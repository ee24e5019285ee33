"""Cuts of a text that no pre-token of a byte-level BPE pattern crosses.

A lone space between two non-blank characters starts a new pre-token, and a lone line feed
between two non-blank characters is one by itself. Cutting there gives short pieces that
repeat a lot, and whose tokens, one piece after the other, are the tokens of the text.
"""

from __future__ import annotations

import re

_CUTS = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")


def cut(text: str) -> list[str]:
    """The pieces of a text; joined together they are the text."""
    return _CUTS.split(text) if text else []
