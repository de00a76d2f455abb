"""A plain-Python level-by-level walk that states the trace rules directly.

It shares no code with the package and is used only to check small graphs."""

from __future__ import annotations

from collections import defaultdict


def select(rows, pattern):
    """rows: (txid, ts, asset, raw, next); returns the followed ones."""
    if pattern == "thorough" or len(rows) <= 1:
        return list(rows)
    by_asset = defaultdict(list)
    for row in rows:
        by_asset[row[2]].append(row)
    out = []
    for group in by_asset.values():
        ranked = sorted(group, key=lambda r: (
            -r[3], -(r[1] if r[1] is not None else -10**18), r[0], r[4]))
        total = sum(r[3] for r in ranked) or 1
        before = 0
        for i, row in enumerate(ranked):
            if pattern == "rapid" and i < 3 and 10 * before < 8 * total:
                out.append(row)
            if pattern == "balanced" and i < 8 and 20 * row[3] >= total:
                out.append(row)
            before += row[3]
    return out


def walk(moves, seed, stops, direction="forward", pattern="balanced", hops=3, dust=100):
    """moves: (txid, ts, src, dst, asset, raw).  Returns (edges, nodes, accounts)."""
    here, there = (3, 2) if direction == "backward" else (2, 3)
    by_wallet = defaultdict(list)
    for m in moves:
        by_wallet[m[here]].append(m)
    nodes, bound = {seed: (0, "victim")}, {seed: None}
    edges, accounts, frontier = [], {}, [seed]
    for depth in range(hops):
        reached = {}
        for wallet in frontier:
            states = defaultdict(int)
            eligible = []
            for m in by_wallet[wallet]:
                late = bound[wallet] is not None and m[1] is not None and (
                    m[1] > bound[wallet] if direction == "backward" else m[1] < bound[wallet])
                if m[2] == m[3]:
                    states["self"] += 1
                elif m[5] < dust:
                    states["dust"] += 1
                elif late:
                    states["time"] += 1
                else:
                    eligible.append((m[0], m[1], m[4], m[5], m[there]))
            chosen = select(eligible, pattern)
            states["followed"] = len(chosen)
            states["skipped"] = len(eligible) - len(chosen)
            accounts[wallet] = (dict(states), len(by_wallet[wallet]))
            for txid, ts, asset, raw, nxt in chosen:
                edges.append((depth + 1, txid, wallet, nxt, asset, raw))
                value = ts if ts is not None else bound[wallet]
                reached.setdefault(nxt, []).append(value)
        frontier = []
        for wallet, values in reached.items():
            if wallet in nodes:
                continue
            merged = None if None in values else (
                max(values) if direction == "backward" else min(values))
            role = stops.get(wallet, "intermediary")
            if role == "intermediary" and depth + 1 == hops:
                role = "unexpanded"
            nodes[wallet] = (depth + 1, role)
            bound[wallet] = merged
            if role == "intermediary":
                frontier.append(wallet)
    return edges, nodes, accounts
