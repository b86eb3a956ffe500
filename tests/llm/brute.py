"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict


def space_words(text):
    return [] if text is None else re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return "" if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def near_duplicates(docs, k, percent):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component_id)}; doc_ids are distinct."""
    sets = {}
    for i, t in docs:
        w = space_words(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def remove_repeats(docs, window):
    """docs: list of (doc_id, text) -> list of (doc_id, n_words, n_removed, sha256 of what is kept)."""
    words = [space_words(t) for _, t in docs]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingle_similarity(a, b, k):
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    both = sum((x & y).values())
    return both, sum((x | y).values())


def contaminated(docs, items, k, percent):
    """(doc_id, item_id) -> best similarity of an item-sized window."""
    out = {}
    for i, t in docs:
        w = plain_words(t)
        for j, u in items:
            v = plain_words(u)
            if not v or not w:
                continue
            n, kk = min(len(v), len(w)), min(k, len(v))
            if len(w) < kk:
                continue
            best = 0
            for s in range(len(w) - n + 1):
                both, either = shingle_similarity(w[s : s + n], v, kk)
                if 100 * both >= percent * either:
                    best = max(best, both / either)
            if best:
                out[i, j] = best
    return out


def license_base(text, phrases):
    w = plain_words(text)
    places, labels = [], set()
    for label, phrase in phrases:
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += hits
        if hits:
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def containment(text, template, threshold):
    w, t = plain_words(text), template.split()
    best = 0.0
    for s in range(max(1, len(w) - len(t) + 1)):
        share = len(set(w[s : s + len(t)]) & set(t)) / len(set(t))
        best = max(best, share)
    return best if best >= threshold - 1e-12 else 0.0


def minimax(sizes, shards):
    """Smallest possible largest sum of `shards` contiguous runs."""
    from functools import cache

    @cache
    def best(i, k):
        if k == 1:
            return sum(sizes[i:])
        total, least = 0, sum(sizes[i:])
        for j in range(i, len(sizes)):
            total += sizes[j]
            least = min(least, max(total, best(j + 1, k - 1)))
        return least

    return best(0, shards)


def mix_targets(sizes):
    """{source: size} -> {source: target} by resharing the excess until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        w = sum(weight[s] for s in free)
        left = total - sum(capped.values())
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(3 * sizes[s]) for s in over}
