"""Byte-level BPE ids of whole batches: each distinct chunk of a worker's texts is encoded once.

Texts are cut where the tokenizer's own pattern always cuts (before a space that leads a word, around runs of white space),
so the ids are those of encoding each text as a whole. Texts with white space outside ASCII are encoded whole.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import tiktoken

from textloom.llm.arrow_text import alternating
from textloom.llm.spans_cache import SpanCache

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_WIDE = re.compile(b"|".join(c.encode() for c in "\x1c\x1d\x1e\x1f\x85\xa0                　"))


@lru_cache(2)
def encoding(path: str = TOKENIZER) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Chunks remembered by a worker; some 150 bytes each.
CHUNKS = 1_000_000


@lru_cache(2)
def _cache(path: str) -> SpanCache:
    encode = encoding(path)._core_bpe.encode_ordinary if hasattr(encoding(path), "_core_bpe") else encoding(path).encode_ordinary

    def ids(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(encode, map(bytes.decode, spans)))
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), n

    return SpanCache(ids, np.int32, CHUNKS)


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that tile every text and that the pattern never joins."""
    begins, ends, white = alternating(_SPACE[data], offs)
    first, last, blank, end = begins[~white], ends[~white], begins[white], ends[white]
    last_byte = np.zeros(len(data) + 1, bool)
    last_byte[offs[1:]] = True
    final = last_byte[end]  # white space that ends a text is one piece
    leads = ~final & (data[end - 1] == 32)  # its last space belongs to the word after it
    cut = end - np.where(final, 0, 1)
    at = np.zeros(len(data) + 1, bool)
    at[end[leads]] = True
    first -= at[first]
    starts = np.concatenate([first, blank[blank < cut], cut[~final & ~leads]])
    ends = np.concatenate([last, cut[blank < cut], end[~final & ~leads]])
    raw = data.tobytes()
    wide = np.unique(np.searchsorted(offs, np.array([m.start() for m in _WIDE.finditer(raw)], np.int64), side="right") - 1)
    if len(wide):
        keep = ~np.isin(np.searchsorted(offs, starts, side="right") - 1, wide)
        starts, ends = np.concatenate([starts[keep], offs[wide]]), np.concatenate([ends[keep], offs[wide + 1]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def token_ids(data: np.ndarray, offs: np.ndarray, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and the number of each text's."""
    starts, ends = chunks(data, offs)
    ids, n = _cache(path).look_up(data, starts, ends)
    per_text = np.bincount(np.searchsorted(offs, starts, side="right") - 1, n, minlength=len(offs) - 1).astype(np.int64) if len(starts) else np.zeros(len(offs) - 1, np.int64)
    return ids, per_text
