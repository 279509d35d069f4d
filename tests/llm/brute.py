"""Plain versions of the contracts, one document list in, one dict or list out."""

import hashlib
import re
from collections import defaultdict


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    found.sort()
    n = [sum(x[1] == k for x in found) for k in range(3)]
    return (*n, sha(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in found)))


def simhash(text, shingle=3, radius=3):
    import xxhash

    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    sh = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    bits = [0] * 64
    for s in sh:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(sh))


def components(fps, radius=3):
    """fps: list of (doc_id, fingerprint)."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(fps):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(fps))]


def contamination(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[a : a + window])].add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in wins:
                    hit.update(range(a, a + n))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def byte_repeats(docs, width=100):
    """docs: (doc_id, bytes) in order; (n_bytes, n_removed, n_spans, kept_sha256) for each."""
    first = {}
    for d, raw in docs:
        for a in range(len(raw) - width + 1):
            first.setdefault(raw[a : a + width], (d, a))
    out = []
    for d, raw in docs:
        gone = bytearray(len(raw))
        for a in range(len(raw) - width + 1):
            if first[raw[a : a + width]] != (d, a):
                gone[a : a + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, sha(kept)))
    return out


def word_repeats(docs, width=20):
    """docs: (doc_id, text) in order."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for a in range(len(w) - width + 1):
            first.setdefault(tuple(w[a : a + width]), (d, a))
    out = []
    for d, w in split:
        gone = bytearray(len(w))
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] != (d, a):
                gone[a : a + width] = b"\1" * width
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out
