"""Plain Python versions of what the operators compute, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def components(rows, n, percent):
    """{doc_id: (size, smallest linked doc_id)} of (doc_id, text) with unique doc_ids."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeated_words(text):
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(covered)


def repeated_lines(text):
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(lines) - len(set(lines))
