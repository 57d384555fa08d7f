"""Brute-force near-duplicate components for the tests."""
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def expected(rows, num=85, den=100):
    """{doc_id: (n_shingles, component)} for unique doc_ids."""
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    par = {d: d for d in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    by_shingle = {}
    for d in ids:
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    done = set()
    for members in by_shingle.values():
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                if (a, b) in done:
                    continue
                done.add((a, b))
                if min(len(sets[a]), len(sets[b])) * den < num * max(len(sets[a]), len(sets[b])):
                    continue
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    par[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}
