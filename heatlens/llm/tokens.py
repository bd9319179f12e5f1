"""Token ids of byte-level BPE vocabularies, as the tokenizers library gives them.

The tokenizers library takes about 0.6 s per megabyte and core. Texts of plain Latin
characters go through tiktoken's merge loop instead, built from the same vocabulary
file; splitting such texts does not depend on the version of the Unicode tables that
either library has. All other texts, and those with a special token in them, go through the
tokenizers library itself. Vocabularies are read where they are installed, on each executor.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]|<\|")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the other bytes, in order, for the code points from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """``ids(text)``: uint32 ids without special tokens added."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {
            bytes(map(alphabet.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self._fast = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    @functools.cached_property
    def exact(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if _OTHER.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    """One instance per Python worker and vocabulary."""
    return ByteBpe(path)
