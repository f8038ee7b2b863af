"""Slow and plain versions of the operators, for comparison."""

from __future__ import annotations

import unicodedata


def word_spans(text):
    out, at = [], None
    for i, c in enumerate(text + " "):
        inside = c.isalnum() or unicodedata.category(c)[0] == "M"
        if inside and at is None:
            at = i
        elif not inside and at is not None:
            out.append((at, i))
            at = None
    return out


def lower(word):
    return "".join(c.lower()[0] for c in word)


def words(text):
    return [lower(text[a:b]) for a, b in word_spans(text)]


class Groups:
    """Union and find; the least of each group stands for it."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_groups(ids, prints, radius):
    """Each id's group by all pairs of fingerprints (as numbers)."""
    g = Groups()
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                g.join(ids[i], ids[j])
    return {x: g.find(x) for x in ids}


def first_fit_decreasing(lengths, capacity):
    room, out = [], []
    for n in lengths:
        for k, r in enumerate(room):
            if r >= n:
                break
        else:
            room.append(capacity)
            k = len(room) - 1
        out.append((k, capacity - room[k]))
        room[k] -= n
    return out


def repeated_words(texts, size=50):
    """For each text (in order) which words lie in a run of size words that an earlier text has."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        runs = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        for k, r in enumerate(runs):
            if seen.get(r, i) != i:
                gone[k : k + size] = [True] * size
        for r in runs:
            seen.setdefault(r, i)
        out.append(gone)
    return out


def contains_words(text, pattern):
    return " " + " ".join(words(pattern)) + " " in " " + " ".join(words(text)) + " "


def crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def chunk_ends(data, gear, least, normal, most, hard, easy):
    """Normalised gear-hash boundaries, a byte at a time; the hash runs on over whatever comes before."""
    h, hashes = 0, []
    for b in data:
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        hashes.append(h)
    ends, start = [], 0
    whole = lambda i: i >= len(data) or data[i] & 0xC0 != 0x80
    while len(data) - start > least:
        for n in range(least, len(data) - start):
            bits = hard if n < normal else easy
            if n < most and whole(start + n) and hashes[start + n - 1] >> (32 - bits) == 0:
                break
            if n == most:
                while not whole(start + n):
                    n -= 1
                break
        else:
            break
        start += n
        ends.append(start)
    return [*ends, len(data)] if start < len(data) else ends
