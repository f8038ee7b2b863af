"""Token ids of a public byte-level BPE vocabulary, a slice of texts at a time.

Texts are cut into the pieces of the vocabulary's pattern by array operations,
only distinct pieces are merged, and the ids are gathered from there.  The
result equals the tokenizer's own on every text; texts with code points that
are unassigned here go to the tokenizer itself.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np

from pressmill.llm.text import _powers, code_points, mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TOP = 0x20000
_SPACES = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(5)
_CACHED = 200_000


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_TOP, _OTHER, np.uint8)
    for i in range(_TOP):
        c = unicodedata.category(chr(i))
        kind[i] = _SPACE if i in _SPACES else _LETTER if c[0] == "L" else _NUMBER if c[0] == "N" else _UNKNOWN if c == "Cn" else _OTHER
    kind[-1] = _UNKNOWN
    return kind, mix(np.arange(_TOP, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)


class Encoder:
    """Encodes lists of texts with the vocabulary file at path (ranks in base64, one a line)."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokenizer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.known: dict[int, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        n = len(texts)
        points, starts, lens = code_points(texts)
        kinds, values = _classes()
        low = np.minimum(points, _TOP - 1)
        kind = kinds[low]
        ends = starts + lens
        kind[ends] = 9
        odd = np.zeros(n, bool)
        if (kind == _UNKNOWN).any():
            odd[np.searchsorted(starts, np.flatnonzero(kind == _UNKNOWN), "right") - 1] = True
        cut = np.append(True, kind[1:] != kind[:-1])
        cut[starts] = True
        # Of white space before something else the last character stands apart; a blank joins what follows.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != 9))
        cut[last] = True
        blank = last[points[last] == 32]
        cut[blank + 1] = False
        # 's and the like: an apostrophe alone, at a piece's start, before such letters.
        q = np.flatnonzero((points == 39) & cut)
        q = q[q + 1 < len(points)]
        q = q[(kind[q + 1] == _LETTER) & cut[q + 1]]
        if len(q):
            at = np.append(points, [0, 0])
            a, b = at[q + 1], at[q + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            one &= ~two
            cut[q[one | two] + 1] = False
            cut[q[one] + 2] = True
            cut[q[two] + 3] = True
        cut[ends] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(points))
        owner = np.searchsorted(starts, begin, "right") - 1
        stay = (kind[begin] != 9) & ~odd[owner]
        begin, end, owner = begin[stay], end[stay], owner[stay]
        size = 1 << max(18, int(len(points)).bit_length())
        up, down = _powers(size)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values[low] * up[: len(points)], out=total[1:])
        h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > _CACHED:
            self.known.clear()
        known, encode = self.known, self.tokenizer.encode_ordinary
        joined = points.tobytes()
        found = []
        for x, b, e in zip(distinct.tolist(), begin[first].tolist(), end[first].tolist(), strict=True):
            ids = known.get(x)
            if ids is None:
                known[x] = ids = tuple(encode(joined[4 * b : 4 * e].decode("utf-32-le")))
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum()))
        offset = np.cumsum(sizes) - sizes
        each = sizes[inverse]
        out = flat[np.repeat(offset[inverse] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        counts = np.bincount(owner, each, n).astype(np.int64)
        if odd.any():
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.array(encode(texts[i]), np.int64)
                counts[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, counts


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder a worker and vocabulary."""
    return Encoder(path)
