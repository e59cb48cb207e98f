"""Brute-force versions of the operators, for small inputs."""

import zlib

import xxhash


def words(text):
    return (text or "").encode().lower().split()


def simhash(text, k=3):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(n, linked):
    """Smallest index reachable over ``linked(i, j)``."""
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(n)]


def crc_ids(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())
