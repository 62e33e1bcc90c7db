"""Encoder for the byte-level pair vocabulary.

The rank form and the JSON form of the vocabulary give the same ids (tests compare them); the rank form is five times as fast, but its
pattern matcher gives up on very long runs of white space. Texts with such a run are encoded by the JSON form's library.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Longest run of white space that the rank form gets.
RUN = 100_000
# Fixed values of the vocabulary: its pattern and its one special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}


def ranks(path: str) -> dict[bytes, int]:
    """Id of each token's bytes."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


def paths(rank_path: str | None = None, json_path: str | None = None) -> tuple[str, str]:
    if rank_path is None or json_path is None:
        import public_tokenizers

        rank_path = rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    return rank_path, json_path


def encoder(special: bool, rank_path: str | None = None, json_path: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts; ``special``: the special token's string in a text is that token, else plain text."""
    import tiktoken

    rank_path, json_path = paths(rank_path, json_path)
    encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks(rank_path), special_tokens=SPECIAL)
    long_run = re.compile(r"\s{%d}" % RUN)
    slow = []

    def one(text: str) -> np.ndarray:
        if len(text) >= RUN and long_run.search(text):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_path))
                slow[0].encode_special_tokens = not special
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
        allowed = {"allowed_special": "all"} if special else {"disallowed_special": ()}
        return encoding.encode_to_numpy(text, **allowed).astype(np.uint32)

    return lambda texts: [one(t) for t in texts]
