"""Public tokenizers, loaded once a Python worker.  A file is named by its path, or by its name in
the public_tokenizers package, which each executor looks up for itself."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

BPE_JSON = "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def resolve(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(4)
def load_ranks(name: str) -> dict[bytes, int]:
    with open(resolve(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def rank_encoding(name: str):
    """The tiktoken library's encoder of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(name), special_tokens={})


@functools.lru_cache(4)
def json_tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(resolve(name))
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


#: Up to here both libraries' Unicode tables agree (tests try each code point), and their vocabularies are the same.
_BEYOND = re.compile("[^\x00-ɏ]")


def bpe_ids(texts: list[str], json_name: str = BPE_JSON, ranks_name: str = BPE_RANKS) -> list[np.ndarray]:
    """Ids of each text as the tokenizers library gives them: read off the faster encoder of the same
    vocabulary where all characters are below U+0250, else by that library."""
    fast = rank_encoding(ranks_name)
    out = []
    for t in texts:
        ids = json_tokenizer(json_name).encode(t, add_special_tokens=False).ids if _BEYOND.search(t) else fast.encode_ordinary(t)
        out.append(np.array(ids, np.uint32))
    return out
