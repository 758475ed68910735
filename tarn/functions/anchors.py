"""Literal anchors derived from a pattern: what every match must contain.

``derive`` gives a set of literals one of which is in every match (anchors), and
literals that are all in every match (confirm_all). A pattern without such literals is
unfilterable, which is said rather than guessed. Letters under a flag that ignores case
count in both cases, and sets that grow too large are given up.
"""

from __future__ import annotations

import re
import re._parser as sre
from dataclasses import dataclass, replace
from itertools import product

from tarn.functions.rules import Rule, portable

MOST, LEAST = 32, 3


@dataclass(frozen=True)
class Plan:
    """``anchors`` is empty for a pattern that can't be filtered."""

    anchors: tuple[bytes, ...]
    confirm_all: tuple[bytes, ...] = ()


def _exact(node, folded: bool) -> set[bytes] | None:
    """All strings a node matches, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        c = bytes([arg]) if arg < 256 else None
        return None if c is None else {c.lower(), c.upper()} if folded else {c}
    if op is sre.IN and all(x[0] is sre.LITERAL for x in arg) and len(arg) <= 4:
        return set().union(*[_exact(x, folded) or set() for x in arg])
    if op is sre.SUBPATTERN:
        return _exact_all(arg[3], (folded or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
    if op is sre.BRANCH:
        parts = [_exact_all(x, folded) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        inner = _exact_all(arg[2], folded)
        return None if inner is None else {b"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
    return None


def _exact_all(nodes, folded: bool) -> set[bytes] | None:
    out = {b""}
    for node in nodes:
        found = _exact(node, folded)
        if found is None or len(out) * len(found) > MOST:
            return None
        out = {a + b for a in out for b in found}
    return out


def _sets(nodes, folded: bool) -> list[set[bytes]]:
    """Sets of literals, each of which has a member in every match."""
    out: list[set[bytes]] = []
    run = {b""}

    def close() -> None:
        nonlocal run
        if min(map(len, run)) >= 1:
            out.append(run)
        run = {b""}

    for node in nodes:
        found = _exact(node, folded)
        if found is not None and len(run) * len(found) <= MOST:
            run = {a + b for a in run for b in found}
            continue
        close()
        op, arg = node
        if op is sre.SUBPATTERN:
            out += _sets(arg[3], (folded or bool(arg[1] & re.IGNORECASE)) and not arg[2] & re.IGNORECASE)
        elif op is sre.BRANCH:
            best = [max(_sets(x, folded), key=_worth, default=None) for x in arg[1]]
            if all(b is not None for b in best):
                out.append(set().union(*best))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            out += _sets(arg[2], folded)
        elif found is not None:
            run = found
    close()
    return [s for s in out if len(s) <= 4 * MOST]


def _worth(s: set[bytes]) -> tuple[int, int]:
    return min(map(len, s)), -len(s)


def derive(pattern: str, least: int = LEAST) -> Plan:
    parsed = sre.parse(portable(pattern, "python"))
    found = _sets(parsed, bool(parsed.state.flags & re.IGNORECASE))
    good = [s for s in found if min(map(len, s)) >= least]
    if not good:
        return Plan(())
    best = max(good, key=_worth)
    sure = sorted({next(iter(s)) for s in found if len(s) == 1 and s is not best and len(next(iter(s))) >= 2}, key=lambda x: (-len(x), x))
    return Plan(tuple(sorted(best)), tuple(sure))


def with_policy(rule: Rule, policy: str = "manual_only") -> Rule:
    """``manual_only`` keeps a rule's anchors; ``prefer_derived`` takes derived ones where there are any; ``derived_only`` insists."""
    if policy == "manual_only":
        return rule
    plan = derive(rule.pattern)
    if plan.anchors:
        return replace(rule, anchors=plan.anchors, confirm_all=plan.confirm_all)
    if policy == "derived_only":
        raise ValueError(f"rule {rule.name} has no anchors to derive")
    return rule
