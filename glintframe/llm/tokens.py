"""Byte-level BPE ids in tasks: the tokenizer file's own vocabulary, run by tiktoken.

The file is the ``tokenizers`` library's JSON; its path is a parameter and must be readable
on the executors.  tiktoken gives the same ids several times faster (tests compare the two).
The strings of added tokens in a text become these tokens' ids, as ``tokenizers`` has it by default.

Defined cases: an empty text has no ids; texts of any length are encoded whole, long ones in blocks cut where no token can span.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at a time.
BLOCK = 1 << 20


def _printable_bytes() -> dict[str, int]:
    """The vocabulary file writes a byte as itself where it is printable Latin-1, else as the next character from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    byte = _printable_bytes()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def blocks(text: str) -> Iterator[str]:
    """``text`` in parts that are encoded alike alone: no pre-token or added token holds a space that a visible character follows, but at its start."""
    at = 0
    while len(text) - at > BLOCK:
        end = text.find(" ", at + BLOCK)
        while 0 <= end < len(text) - 1 and text[end + 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0 or end >= len(text) - 1:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text.  An added token is looked for only where its string is there at all."""
    found = encoding(path)
    added = tuple(found.special_tokens_set)
    return lambda text: found.encode(text, allowed_special="all") if any(x in text for x in added) else found.encode_ordinary(text)


def ids(text: str, path: str) -> np.ndarray:
    encode = encoder(path)
    if len(text) <= BLOCK:
        return np.array(encode(text), np.uint32)
    return np.concatenate([np.array(encode(part), np.uint32) for part in blocks(text)])
