"""Plain versions of the operators, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def jaccard(rows, n, percent):
    """rows: doc_id, text. Returns {doc_id: (n_shingles, component)}."""
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    overlap = {}
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                overlap[a, b] = overlap.get((a, b), 0) + 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in overlap.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(rows, k=50):
    """rows: doc_id, text. Returns {doc_id: (n_words, n_removed, kept words)}."""
    texts = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d, w in texts.items():
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(d, first.get(g, d))
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out[d] = (len(w), len(gone), [x for i, x in enumerate(w) if i not in gone])
    return out
