"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re


def substrings(docs, symbols, join, length):
    """docs: (id, text). The symbols of windows that also start in a document with a smaller id go."""
    first = {}
    for i, text in docs:
        if i is not None:
            s = symbols(text)
            for k in range(len(s) - length + 1):
                w = tuple(s[k : k + length])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, text in docs:
        s = symbols(text)
        gone = [False] * len(s)
        for k in range(len(s) - length + 1):
            if i is not None and first[tuple(s[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = join([x for x, g in zip(s, gone) if not g])
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def word_windows(docs, length=13):
    return [(i, n, r, h) for i, n, r, _, h in substrings(docs, words, b" ".join, length)]


def byte_windows(docs, length=50):
    return substrings(docs, lambda t: list((t or "").encode()), bytes, length)


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_components(docs, n, similarity):
    """(id, set size, least id reachable) of (id, text)."""
    sets = [(i, shingle_set(t, n)) for i, t in docs]
    up = {i: i for i, _ in sets if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    held = {}
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            held.setdefault(x, []).append(k)
    done = set()
    for ks in held.values():
        for x in range(len(ks)):
            for y in ks[x + 1 :]:
                if (ks[x], y) not in done:
                    done.add((ks[x], y))
                    (i, a), (j, b) = sets[ks[x]], sets[y]
                    if 100 * len(a & b) >= similarity * len(a | b):
                        i, j = root(i), root(j)
                        up[max(i, j)] = min(i, j)
    return sorted([(i, len(s), root(i) if i is not None else None) for i, s in sets], key=repr)
