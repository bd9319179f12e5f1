"""Sequential folds over small traces, written from the definitions.

A trace is a list of keys in arrival order; ``slices`` gives each access's slice.
"""

from __future__ import annotations

from collections import defaultdict

ALPHA = 0.05
LAMBDA = 0.95


def forward(keys, slices):
    state = {}
    for key, s in zip(keys, slices):
        if key not in state:
            state[key] = (0.0, s)
        elif state[key][1] != s:
            est, before = state[key]
            state[key] = (ALPHA + est * LAMBDA ** (s - before), s)
    return {k: est for k, (est, _) in state.items()}


def neighbor(keys, slices, reach=16):
    est, at = {}, {}
    last_key, last_est = None, 0.0
    for key, s in zip(keys, slices):
        if key not in est:
            est[key], at[key] = 0.0, s
            continue
        if at[key] == s:
            continue
        if last_key is not None and abs(key - last_key) <= reach:
            est[key] = last_est
        else:
            est[key] = ALPHA + est[key] * LAMBDA ** (s - at[key])
        at[key] = s
        last_key, last_est = key, est[key]
    return est


def rank_partials(keys, slices, parts, per_part):
    """Partials by how many slices a part has seen so far."""
    tables, seen_at, factor, before = defaultdict(dict), defaultdict(dict), {}, {}
    for key, s, p in zip(keys, slices, parts):
        factor.setdefault(p, per_part)
        table, seen = tables[p], seen_at[p]
        if key not in table:
            table[key], seen[key] = 0.0, s
        elif seen[key] != s:
            table[key] += LAMBDA ** factor[p]
            seen[key] = s
        if before.get(p) != s and factor[p] >= 0:
            factor[p] -= 1
        before[p] = s
    return tables


def number_partials(keys, slices, parts):
    tables = defaultdict(dict)
    for key, s, p in zip(keys, slices, parts):
        tables[p][key] = tables[p][key] + LAMBDA**s if key in tables[p] else 0.0
    return tables


def rolled(tables, step_of):
    total = {}
    for p in sorted(tables):
        for key, partial in tables[p].items():
            total[key] = ALPHA * partial + LAMBDA ** step_of(p) * total.get(key, 0.0)
    return total


def backward(keys, slices, end, t=1):
    est = defaultdict(float)
    for key, s in set(zip(keys, slices)):
        if s >= t:
            est[key] += ALPHA * LAMBDA ** (end - s)
    return dict(est)


def top(est, k, digits=12):
    ranked = sorted(((round(v, digits), key) for key, v in est.items()), key=lambda r: (-r[0], r[1]))
    return [key for _, key in ranked[:k]]
