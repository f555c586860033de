"""Token ids of whole texts by a public vocabulary.

``byte_bpe_50k.json`` (read by ``tokenizers``) and ``byte_bpe_50k.tiktoken``
hold the same vocabulary. The ids of ``Tokenizer.encode(text,
add_special_tokens=False)`` are made here from the second file, in a fifth of
the CPU time, with the added tokens that the first names: where a text holds the
string of one, its id stands, as with ``tokenizers``. ``tests/llm`` hold the two
against each other.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import public_tokenizers
import tiktoken

#: The public vocabulary: a name that ``public_tokenizers`` knows, or a path, without ``.json`` and ``.tiktoken``.
BYTE_BPE = "byte_bpe_50k"
END_ID = 0

_encoders: dict[str, tuple[tiktoken.Encoding, frozenset[str]]] = {}


def encoder(vocabulary: str = BYTE_BPE) -> tuple[tiktoken.Encoding, frozenset[str]]:
    """This worker's encoder and the strings of its added tokens, loaded once."""
    if vocabulary not in _encoders:
        path = (lambda end: vocabulary + end) if "/" in vocabulary else (lambda end: public_tokenizers.path(vocabulary + end))
        with open(path(".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(x): int(rank) for x, rank in (line.split() for line in lines if line.strip())}
        with open(path(".json"), encoding="utf-8") as file:
            text = file.read()
        # Only this list is parsed: the vocabulary beside it would take each worker some 50 MB.
        start = text.index("[", text.index('"added_tokens"'))
        added = {x["content"]: x["id"] for x in json.JSONDecoder().raw_decode(text, start)[0]}
        _encoders[vocabulary] = (
            tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added),
            frozenset(added),
        )
    return _encoders[vocabulary]


def encode(text: str | None, vocabulary: str = BYTE_BPE, end_id: int = END_ID) -> np.ndarray:
    """Ids of the whole text (null: empty) and then ``end_id``, as little-endian unsigned 32-bit numbers."""
    ids = []
    if text:
        known, added = encoder(vocabulary)
        # The search for added tokens costs time only in texts that hold one.
        ids = known.encode(text, allowed_special="all") if any(x in text for x in added) else known._core_bpe.encode_ordinary(text)
    ids.append(end_id)
    return np.array(ids, "<u4")
