"""Plain Python versions of what the operators compute, for small tables."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i: i + width]) for i in range(len(w) - width + 1)}


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(texts, width, percent):
    """{id: component} of {id: text}."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    return components(texts, [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)])


def benchmark_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(text, items, size=10):
    """(words, hit words, item ids) against [(id, text)]."""
    w = benchmark_words(text)
    hit, ids = set(), set()
    for item, t in items:
        x = benchmark_words(t)
        n = min(size, len(x))
        for win in {tuple(x[i: i + n]) for i in range(len(x) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i: i + n]) == win:
                    hit.update(range(i, i + n))
                    ids.add(item)
    return len(w), len(hit), ids


def line_dedup(rows, least=10):
    """[(id, n_lines, n_dropped, text)] of [(id, text)]."""
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
