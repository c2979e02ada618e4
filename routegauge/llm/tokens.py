"""Token ids of whole texts with a public byte-level BPE file."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_encoding(path: str):
    """A ``tiktoken`` encoding with the vocabulary, merge order and special tokens of a byte-level BPE ``.json`` file.

    It gives the ids of ``tokenizers`` for the same file without added special tokens (tests compare the two), about
    four times as fast. The file must list its merges in the order of the ids they make; others are refused.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, vocab = byte_alphabet(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    if made != sorted(made):
        raise ValueError(f"{path} does not number its tokens in the order of its merges")
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text as an array; a special token's string inside a text is that token, as the library's default has it."""
    encoding = load_encoding(path)

    def encode(text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, allowed_special="all")

    return encode
