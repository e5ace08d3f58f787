"""Public vocabulary files, loaded once per Python worker from a path that is a parameter."""

import base64
import os
from functools import lru_cache

from deckweave.llm.pieces import PATTERN


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A ``tokenizers`` tokenizer without truncation or padding; Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """A ``tiktoken`` encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
