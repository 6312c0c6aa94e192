"""Construction rules, balanced and exact selection, for the candidates of one game."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Quota:
    """A construction rule: for each position the least and most members, and how many lineups should follow it."""

    name: str
    counts: dict[str, tuple[int, int]]
    lineups: int

    def fits(self, positions: Sequence[str]) -> bool:
        return all(lo <= sum(p == pos for p in positions) <= hi for pos, (lo, hi) in self.counts.items())


def validate(quotas: Sequence[Quota], known: Sequence[str], size: int) -> None:
    """Names are unique and not empty, counts positive, positions known, and exact rules add up to the size."""
    names = [q.name for q in quotas]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError("rules need names of their own")
    for q in quotas:
        if q.lineups < 1 or any(lo < 0 or hi < lo for lo, hi in q.counts.values()):
            raise ValueError(f"rule {q.name} has impossible counts")
        if set(q.counts) - set(known):
            raise ValueError(f"rule {q.name} names an unknown position")
        if set(q.counts) == set(known) and all(lo == hi for lo, hi in q.counts.values()) and sum(lo for lo, _ in q.counts.values()) != size:
            raise ValueError(f"rule {q.name} doesn't make a lineup")


def balanced(candidates: list[tuple], n: int, cap: int) -> list:
    """Identifiers whose members were used least so far, better ones first among equals."""
    used: dict = {}
    rest, out = list(candidates), []
    while rest and len(out) < n:
        ok = [c for c in rest if all(used.get(m, 0) < cap for m in c[1])]
        if not ok:
            break
        best = min(ok, key=lambda c: (sum(used.get(m, 0) for m in c[1]), -c[2]))
        out.append(best[0])
        rest.remove(best)
        for m in best[1]:
            used[m] = used.get(m, 0) + 1
    return out


def exact_capped(candidates: list[tuple], n: int, cap: int) -> list:
    """Identifiers of the n candidates of greatest total quality with each member in at most `cap`, by branch and bound.

    For small pools: candidates are sorted by quality and a branch is cut when the next best
    ones, caps aside, can't beat the best total so far. If no n fit, as many as fit are taken.
    """
    rows = sorted(candidates, key=lambda c: (-c[2], str(c[0])))
    quality = [c[2] for c in rows]
    ahead = [0.0]
    for v in quality:
        ahead.append(ahead[-1] + v)
    best: tuple[int, float, list] = (0, 0.0, [])

    def go(at: int, taken: list, total: float, used: dict) -> None:
        nonlocal best
        if (len(taken), total) > (best[0], best[1] + 1e-12):
            best = (len(taken), total, list(taken))
        for i in range(at, len(rows)):
            reach = min(n - len(taken), len(rows) - i)
            if len(taken) + reach < best[0] or (len(taken) + reach == best[0] and total + ahead[i + reach] - ahead[i] <= best[1] + 1e-12):
                return
            ident, members, q = rows[i][:3]
            if reach and all(used.get(m, 0) < cap for m in members):
                for m in members:
                    used[m] = used.get(m, 0) + 1
                go(i + 1, [*taken, ident], total + q, used)
                for m in members:
                    used[m] -= 1

    go(0, [], 0.0, {})
    return best[2]
