"""Token ids of whole documents with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os

import numpy as np

VOCABULARY = "byte_bpe_50k.tiktoken"
EOS = 1  # closes every document
DTYPE = "<u4"

_encodings: dict = {}


def encoding(vocabulary: str = VOCABULARY):
    """Encoder for a rank file, given as a path or as a file name of ``public_tokenizers``.

    Kept per process, so a Python worker loads the ranks once. The rank file holds the
    vocabulary of ``byte_bpe_50k.json``: the ids are those of ``tokenizers`` (tested), found
    several times faster. Strings of special tokens in a text are ordinary text.
    """
    if vocabulary not in _encodings:
        import public_tokenizers
        import tiktoken

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[vocabulary] = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[vocabulary]


def document_ids(text: str | None, vocabulary: str = VOCABULARY, eos: int = EOS) -> np.ndarray:
    """Ids of a whole text, closed by ``eos``; a null text is empty."""
    ids = encoding(vocabulary).encode_ordinary(text) if text else []
    ids.append(eos)
    return np.array(ids, dtype=DTYPE)
