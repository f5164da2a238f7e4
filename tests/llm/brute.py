"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOOSE = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def jaccard_components(docs):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = defaultdict(list)
    for i in ids:
        for g in sets[i]:
            holders[g].append(i)
    for i in ids:
        common = defaultdict(int)
        for g in sets[i]:
            for j in holders[g]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_dedup(docs, least=50):
    """{doc_id: text}: lines in later runs of ``least`` words and more are cut, trying every run."""
    rows = {}
    for i, t in docs:
        rows[i] = [(p, line, len(WORD.findall(line))) for p, line in enumerate((t or "").split("\n"))]
    runs = defaultdict(list)
    for i, lines in rows.items():
        full = [x for x in lines if x[2]]
        for a in range(len(full)):
            n = 0
            for e in range(a, len(full)):
                n += full[e][2]
                if n >= least:
                    runs[tuple(x[1] for x in full[a : e + 1])].append((i, full[a][0], full[e][0]))
    gone = defaultdict(set)
    for found in runs.values():
        d, _, z = min(found)
        for i, a, e in found:
            if i != d or a > z:
                gone[i].update(range(a, e + 1))
    return {i: t if not gone[i] else "\n".join(x[1] for x in rows[i] if x[0] not in gone[i]) for i, t in docs}


def loose(text):
    return [w.translate(LOW) for w in LOOSE.findall(text or "")]


def overlaps(text, item, window=13, wrong=2):
    """Whether some alignment has a stretch of ``window`` words with at most ``wrong`` unequal ones."""
    t, q = loose(text), loose(item)
    if len(q) < 5:
        return False
    if len(q) < window:
        window, wrong = len(q), int(len(q) >= 8)
    if not set(t) & set(q):
        return False
    for shift in range(-len(q) + window, len(t) - window + 1):
        a, e = max(0, shift), min(len(t), shift + len(q))
        same = [t[p] == q[p - shift] for p in range(a, e)]
        for s in range(len(same) - window + 1):
            if window - sum(same[s : s + window]) <= wrong:
                return True
    return False
