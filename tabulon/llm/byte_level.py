"""Byte-level BPE vocabularies in the tokenizers JSON form, encoded by the faster rank encoder.

Where the file's merges are in the order of the ids they make, merging by least rank gives
the ids that the tokenizers library gives; that order is checked when the file is read, and a
file without it is encoded by the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import public_tokenizers

#: Longer texts are encoded in parts, cut where no pre-token is cut.
PART_CHARS = 200_000
#: Blank runs that the rank encoder's pattern engine can't take; the tokenizers library can.
_LONG_BLANKS = re.compile(r"\s{1000}")

_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a vocabulary entry stands for: printable Latin-1
    characters are themselves, the other bytes follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


def _parts(text: str) -> list[str]:
    from tabulon.llm.pieces import cut

    out, held, size = [], [], 0
    for piece in cut(text):
        if held and size + len(piece) > PART_CHARS:
            out.append("".join(held))
            held, size = [], 0
        held.append(piece)
        size += len(piece)
    return [*out, "".join(held)]


def _ranked(data: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    vocab, of = data["model"]["vocab"], _byte_of()
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
    if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    return {bytes(of[c] for c in token): k for token, k in vocab.items() if token not in special}, special


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian 32-bit words; kept from task to task."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        ranked = _ranked(json.load(file))

    def plain(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    if ranked is None:
        part = plain
    else:
        import tiktoken

        ranks, special = ranked
        encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def part(text: str) -> list[int]:
            if len(text) > PART_CHARS or _LONG_BLANKS.search(text):
                return plain(text)
            if any(s in text for s in special):
                return encoding.encode(text, allowed_special="all")
            return encoding.encode_ordinary(text)

    def encode(text: str) -> bytes:
        if len(text) <= PART_CHARS:
            return array("I", part(text)).tobytes()
        return b"".join(array("I", part(p)).tobytes() for p in _parts(text))

    _ENCODERS[path] = encode
    return encode
