"""Plain Python versions of the operators' contracts, to compare with."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = words(lowered(text))
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k, percent):
    """{id: (set size, least id reachable)}"""
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def kept_words(docs, k=20):
    """{id: (words, removed, kept words)}"""
    first, split = {}, {i: words(t) for i, t in docs}
    for i in sorted(split):
        for at in range(len(split[i]) - k + 1):
            first.setdefault(tuple(split[i][at : at + k]), (i, at))
    out = {}
    for i, w in split.items():
        gone = set()
        for at in range(len(w) - k + 1):
            if first[tuple(w[at : at + k])] != (i, at):
                gone.update(range(at, at + k))
        out[i] = len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


def counts(text):
    """(words, characters in words, symbols, repeated lines, words in repeated windows)"""
    text = text or ""
    w, places = words(text), defaultdict(list)
    for at in range(len(w) - 7):
        places[tuple(w[at : at + 8])].append(at)
    covered = {p for v in places.values() if len(v) > 1 for at in v for p in range(at, at + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def contained(docs, items, k=5, percent=80):
    """{(doc, item): (shared, all)}"""
    def sets(text):
        return shingles(text, k) if len(words(text)) >= k else set()

    out = {}
    for d, text in docs:
        have = sets(text)
        for i, item in items:
            want = sets(item)
            if want and 100 * len(want & have) >= percent * len(want):
                out[d, i] = len(want & have), len(want)
    return out


def without_site_lines(docs, ratio, least):
    """[(id, text, host)] -> [(id, text, lines, dropped)]"""
    def strip(line):
        return line.strip(" \t\x0b\x0c\r")

    pages, seen, kinds = Counter(h for _, _, h in docs), Counter(), defaultdict(set)
    for _, t, h in docs:
        distinct = {strip(x) for x in (t or "").split("\n")} - {""}
        seen.update((h, x) for x in distinct)
        for start in (0, 16):
            kind = min((hashlib.md5(x.encode()).hexdigest()[start : start + 15] for x in distinct), default=None)
            for x in [*distinct, None] if distinct else []:
                kinds[h, x, start].add(kind)

    def boilerplate(h, x):
        often = h is not None and x != "" and seen[h, x] >= least and seen[h, x] > ratio * pages[h]
        return often and any(len(kinds[h, x, s]) >= least and len(kinds[h, x, s]) > ratio * len(kinds[h, None, s]) for s in (0, 16))

    out = []
    for i, t, h in docs:
        lines = (t or "").split("\n")
        bad = [boilerplate(h, strip(x)) for x in lines]
        rest = "\n".join(x for x, b in zip(lines, bad) if not b)
        out.append((i, t if t is None else rest, len([x for x in lines if strip(x)]), sum(bad)))
    return out
