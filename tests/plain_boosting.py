"""A plain booster over the same definitions: one node at a time, histograms of every node from its rows, no bins kept."""

import numpy as np


def boost(x, y, kinds, rounds, step, leaves, least, l2=0.0, depth=None, loss="squared", rising=(), cuts=None):
    """Predicted scores of the training rows after every tree, and the trees as nested tuples. ``x`` has NaN where missing."""
    n, width = x.shape
    cuts = cuts or [np.unique(v[~np.isnan(v)]) for v in x.T]
    cuts = [(c[:-1] + c[1:]) / 2 for c in cuts]
    base = np.mean(y) if loss == "squared" else np.log(np.mean(y) / (1 - np.mean(y)))
    raw = np.full(n, base)

    def ways(r, f):
        """(rows that go left, whether missing ones do) of each split of one feature, in order."""
        v = x[r, f]
        gone = np.isnan(v)
        if kinds[f] == "number":
            for missing_left in ((False, True) if gone.any() else (False,)):
                for c in [*cuts[f], np.inf]:
                    yield missing_left, np.where(gone, missing_left, v <= c)
        elif kinds[f] == "single":
            for c in range(int(np.nanmax(x[:, f])) + 1):
                yield False, v == c
        else:
            code = np.where(gone, 0, v + 1).astype(int)
            have = sorted(set(code.tolist()), key=lambda c: (g[r][code == c].sum() / (h[r][code == c].sum() + 10.0), c))
            for i in range(1, len(have)):
                yield False, np.isin(code, have[:i])

    def best(r, low, high, level):
        out = (0.0, None)
        if len(r) < 2 * least or (depth is not None and level >= depth):
            return out
        val = lambda a, b: np.clip(-a / (b + l2), low, high)
        cost = lambda a, b: 2 * a * val(a, b) + (b + l2) * val(a, b) ** 2
        whole = cost(g[r].sum(), h[r].sum())
        tried = {}
        for f in range(width):
            for k, (missing_left, goes) in enumerate(ways(r, f)):
                gl, hl, gr, hr = g[r][goes].sum(), h[r][goes].sum(), g[r][~goes].sum(), h[r][~goes].sum()
                if goes.sum() < least or (~goes).sum() < least or hl < 1e-3 or hr < 1e-3 or (f in rising and val(gl, hl) > val(gr, hr)):
                    continue
                order = {"number": 1 if missing_left else 0, "subset": 2, "single": 3}[kinds[f]]
                gain = whole - cost(gl, hl) - cost(gr, hr)
                if gain > tried.get(order, (0.0,))[0] + 1e-12:
                    mid = (val(gl, hl) + val(gr, hr)) / 2
                    tried[order] = (gain, f, goes, (low, mid, mid, high) if f in rising else (low, high, low, high))
        for order in sorted(tried):
            if tried[order][0] > out[0] + 1e-12:
                out = tried[order]
        return out
    history = []
    for _ in range(rounds):
        if loss == "squared":
            g, h = raw - y, np.ones(n)
        else:
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
        tips = [(np.arange(n), -np.inf, np.inf, 0)]
        found = [best(*tips[0])]
        while len(tips) < leaves and max(b[0] for b in found) > 0:
            i = max(range(len(found)), key=lambda j: found[j][0])
            r, low, high, level = tips.pop(i)
            _, _, goes, (a, b, c, d) = found.pop(i)
            for part, lo, hi in ((r[goes], a, b), (r[~goes], c, d)):
                tips.append((part, lo, hi, level + 1))
                found.append(best(part, lo, hi, level + 1))
        for r, low, high, _ in tips:
            raw[r] += step * np.clip(-g[r].sum() / (h[r].sum() + l2), low, high)
        history.append(raw.copy())
    return history


