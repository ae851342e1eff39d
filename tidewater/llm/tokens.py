"""Token counts of texts under a public vocabulary file."""

from __future__ import annotations

import base64

import tiktoken

#: The vocabulary file used unless another is given; it must be present on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(texts, path: str = VOCABULARY) -> list[int]:
    """Tokens of each text; null and empty texts have none."""
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if isinstance(t, str) and t else 0 for t in texts]
