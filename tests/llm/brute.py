"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def repeats(items_of: list[tuple], n: int) -> list[list[bool]]:
    """Which items of each (doc_id, items) lie in a run of ``n`` that starts earlier; null ids first."""
    key = lambda d: (d is not None, d or 0)
    first = {}
    for d, items in items_of:
        for s in range(len(items) - n + 1):
            w, at = items[s: s + n], (key(d), s)
            w = bytes(w) if isinstance(items, bytes) else tuple(w)
            if w not in first or at < first[w]:
                first[w] = at
    out = []
    for d, items in items_of:
        gone = [False] * len(items)
        for s in range(len(items) - n + 1):
            w = bytes(items[s: s + n]) if isinstance(items, bytes) else tuple(items[s: s + n])
            if first[w] < (key(d), s):
                gone[s: s + n] = [True] * n
        out.append(gone)
    return out


def byte_dedup(docs: list[tuple], n: int = 100) -> list[tuple]:
    raw = [(d, (t or "").encode()) for d, t in docs]
    rows = []
    for (d, b), gone in zip(raw, repeats(raw, n)):
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        rows.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return rows


def word_dedup(docs: list[tuple], n: int = 20) -> list[tuple]:
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    return [(d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())) for (d, w), gone in zip(split, repeats(split, n))]


def lower_words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs: list[tuple], items: list[tuple], n: int = 13) -> list[tuple]:
    windows = defaultdict(set)
    for i, t in items:
        w = lower_words(t)
        if w and i is not None:
            k = min(n, len(w))
            for s in range(len(w) - k + 1):
                windows[tuple(w[s: s + k])].add(i)
    sizes = {len(w) for w in windows}
    rows = []
    for d, t in docs:
        w, hit, ids = lower_words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[s: s + k]))):
                    hit |= set(range(s, s + k))
                    ids |= found
        rows.append((d, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids))).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return rows


def bag(text: str | None, k: int = 5) -> Counter:
    w = lower_words(text)
    return Counter(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def near_classes(docs: list[tuple], least: float = 0.8) -> dict:
    bags = {d: bag(t) for d, t in docs}
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            low = sum((bags[a] & bags[b]).values())
            high = sum((bags[a] | bags[b]).values())
            if high and low / high >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def mix_targets(sizes: dict, most: int = 3) -> dict:
    """Target per source from its size; None sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        free -= over
    return target
