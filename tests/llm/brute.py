"""Plain versions of what the operators find, for small inputs."""

import hashlib
import re

import numpy as np
import xxhash

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ascii_lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        v = int(ch) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return sorted(found)


def base_sha(text):
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, z, k in base_spans(text)).encode()).hexdigest()


def simhash(text, width=4):
    words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(parts))


def components(n, linked):
    """Root of each of n nodes; linked(i) gives an array of neighbours."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in linked(i):
            parent[find(int(j))] = find(i)
    return [find(i) for i in range(n)]


def simhash_components(ids, prints, limit=4):
    values = np.array(prints, dtype=np.uint64)
    roots = components(len(values), lambda i: np.flatnonzero(np.bitwise_count(values ^ values[i]) <= limit))
    low = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    return [low.get(r) for r in roots]
