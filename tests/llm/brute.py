"""Plain single-process versions of operators, to hold the Spark ones against."""

from collections import Counter, defaultdict


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)}


def union_find(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(rows, num=85, den=100):
    """{doc_id: (n_shingles, component_id)} by an exact prefix-filtered join over all rows (doc_id, text)."""
    sets = {i: shingles(x) for i, x in rows}
    count = Counter(s for x in sets.values() for s in x)
    index, links = defaultdict(list), []
    for i, x in sets.items():
        seen = set()
        for s in sorted(x, key=lambda s: (count[s], s))[: len(x) - -(-num * len(x) // den) + 1]:
            for j in index[s]:
                if j not in seen:
                    seen.add(j)
                    y = sets[j]
                    if den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                        both = len(x & y)
                        if den * both >= num * (len(x) + len(y) - both):
                            links.append((i, j))
            index[s].append(i)
    part = union_find(sets, links)
    return {i: (len(sets[i]), part[i]) for i in sets}
