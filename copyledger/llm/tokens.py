"""Splitting whole texts into pieces that tokenizers treat on their own."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

# The code points with the Unicode property White_Space, as ranges.
_SPACES = [
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
WHITE_SPACE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _SPACES)
_CHUNK = re.compile(f"[^{WHITE_SPACE}]+")
# A run without white space with at most one blank before it, or white space.
_UNIT = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]")
# str.split() also splits at these, which are no white space to tokenizers.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once per worker process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def chunks_of(text: str) -> list[str]:
    """Maximal runs without white space."""
    return _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()


def units_of(text: str) -> list[str]:
    """Pieces at whose borders a byte-level pre-tokenizer splits in any case;
    joined they give ``text``."""
    return _UNIT.findall(text)
