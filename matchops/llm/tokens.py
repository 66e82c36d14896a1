"""Token ids of texts through cached space-separated chunks.

Cutting a text before every space that a non-space follows never changes
its tokens: for the byte-level split pattern such a place is always a
piece boundary, and a run of white space before it is matched the same
way at the end of a chunk.  Chunks repeat a lot, so each worker keeps the
ids of the chunks it has met in a cache of bounded size.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

CACHE_ENTRIES = 250_000  # per worker and cache; it is emptied when full
LONGEST_CACHED = 64  # characters; longer chunks are encoded anew each time

_UNEVEN = re.compile(r" (?=\s|$)")  # a space that does not begin a chunk
_CUT = re.compile(r" (?=\S)")


def chunks(text: str) -> list[str]:
    """Pieces of the text; each but the first has lost one leading space."""
    return text.split(" ") if _UNEVEN.search(text) is None else _CUT.split(text)


class ChunkCache(dict):
    """chunk (without its leading space) -> little-endian uint32 ids."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.encode_all, self.limit = encode_all, limit

    def __missing__(self, chunk: str) -> bytes:
        return self.encode_all([" " + chunk])[0]

    def fill(self, rests: list[list[str]]) -> None:
        """Encode the chunks that are not known yet, all at once."""
        if len(self) > self.limit:
            self.clear()
        new = [c for c in set().union(*rests).difference(self) if len(c) <= LONGEST_CACHED]
        self.update(zip(new, self.encode_all([" " + c for c in new]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [chunks(t) if t else [""] for t in texts]
        heads = self.encode_all([c[0] for c in cut])
        rests = [c[1:] for c in cut]
        self.fill(rests)
        get = self.__getitem__
        return [h + b"".join(map(get, r)) for h, r in zip(heads, rests, strict=True)]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins by which byte-level vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranks_of_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ids of byte strings, ids of special strings) of a byte-level BPE file.

    In such a file ids rise with the merge order, so they are merge ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = _byte_alphabet()
    vocab = {bytes(table[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return vocab, special


def ranks_of_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class JsonTokenizer:
    """ids of whole texts as the ``tokenizers`` library gives them for a
    byte-level BPE file without normaliser: special strings found in a text
    become their own id, the text between them is encoded piece by piece."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks, self.special = ranks_of_json(path)
        core = tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache = ChunkCache(lambda chunks: [np.array(core.encode_ordinary(c), "<u4").tobytes() for c in chunks])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self.cache.ids(texts)
        parts = [self.cut.split(t) for t in texts]
        done = iter(self.cache.ids(["" if p in self.special else p for ps in parts for p in ps]))
        return [b"".join(np.array([self.special[p]], "<u4").tobytes() + next(done) if p in self.special else next(done)
                         for p in ps) for ps in parts]


@lru_cache(maxsize=2)
def json_tokenizer(path: str) -> JsonTokenizer:
    """One per worker process and file."""
    return JsonTokenizer(path)
