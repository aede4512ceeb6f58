"""Plain, slow versions of the operators' contracts, for small inputs."""

from collections import defaultdict


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def jaccard_components(docs, width=3, percent=90):
    """{doc_id: (set size, component)} of [(doc_id, text)]."""
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i in sets}
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in index[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    return {i: (len(s), find(parent, i)) for i, s in sets.items()}


def words(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, window=13):
    """{doc_id: (words, hit words, sorted item ids)}."""
    index = defaultdict(set)
    for i, text in items:
        seq = words(text)
        if seq:
            for k in range(max(1, len(seq) - window + 1)):
                index[tuple(seq[k : k + window])].add(str(i))
    sizes = {len(w) for w in index}
    out = {}
    for i, text in docs:
        seq = words(text)
        hit, found = set(), set()
        for m in sizes:
            for k in range(len(seq) - m + 1):
                if (names := index.get(tuple(seq[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    found |= names
        out[i] = (len(seq), len(hit), sorted(found))
    return out


def repeats(docs, length=200):
    """{doc_id: removed byte runs} of [(doc_id, bytes)]."""
    from collections import Counter

    seen = Counter(b[k : k + length] for _, b in docs for k in range(len(b) - length + 1))
    out = {}
    for i, b in docs:
        runs = []
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        out[i] = runs
    return out
