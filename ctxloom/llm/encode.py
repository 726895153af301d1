"""Token ids of a public byte-level BPE.

The same vocabulary is there for two libraries. `tokenizers` encodes about 1 MB a second and core
here, `tiktoken` about 5, so the second does the work; tests/llm holds its ids against those of the
first, which knows one special string: where it stands in a text, it is one id.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from pathlib import Path

VOCABULARY = "byte_bpe_50k"
#: The vocabulary's special strings and their ids.
SPECIAL = {"<|endoftext|>": 50256}
#: The first id beyond the vocabulary; no text gives it.
END_OF_DOCUMENT = 50257


class Encoder:
    """Texts to ids; one per Python worker."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        ranks = {}
        for line in Path(public_tokenizers.path(vocabulary + ".tiktoken")).read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self.bpe = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str | None) -> array:
        """The ids of a text as unsigned 32-bit integers; null is empty."""
        return array("I", self.bpe.encode(text, allowed_special="all", disallowed_special=()) if text else ())


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    return Encoder(vocabulary)
