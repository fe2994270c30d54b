"""Query descriptions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import combinations

from ..functions.quantize import DIST_PARTS, THETA_PARTS


@dataclass(frozen=True)
class RelationConstraint:
    """Distance bins d_min to d_max inclusive, and a set of angle bins, from the first role to the second."""

    d_min: int
    d_max: int
    theta_bins: frozenset[int]


@dataclass(frozen=True)
class QuerySpec:
    query_id: str
    role_types: tuple[int, ...]
    relations: Mapping[tuple[int, int], RelationConstraint] = field(default_factory=dict)
    min_consecutive_frames: int = 1
    topk: int = 10
    theta_parts: int = THETA_PARTS
    distance_parts: int = DIST_PARTS

    def __post_init__(self):
        n = len(self.role_types)
        if not n:
            raise ValueError("a query has one role at least")
        for i, j in self.relations:
            if i == j or not (0 <= i < n and 0 <= j < n):
                raise ValueError(f"relation {(i, j)} doesn't join two of {n} roles")


def parse_types(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


ENTRY = re.compile(r"\s*(?P<i>\d+)\s*-\s*(?P<j>\d+)\s*:\s*(?P<theta>[^,;:]+),(?P<d>[^,;:]+)")


def parse_pair_constraints(text: str, role_count: int) -> dict[tuple[int, int], tuple[float, float]]:
    """`0-1:1.0,5;0-2:0.5,2`: limits of angle and distance, one entry for every pair of roles."""
    pairs = list(combinations(range(role_count), 2))
    entries = [e for e in (text or "").split(";") if e.strip()] if pairs else []
    read = [ENTRY.fullmatch(e) for e in entries]
    if None in read:
        raise ValueError(f"{entries[read.index(None)]!r} isn't of the form i-j:theta,d")
    keys = [tuple(sorted((int(m["i"]), int(m["j"])))) for m in read]
    if sorted(keys) != pairs:
        raise ValueError(f"limits are given for {sorted(keys)}, but the pairs of {role_count} roles are {pairs}")
    return {k: (float(m["theta"]), float(m["d"])) for k, m in zip(keys, read, strict=True)}


def parse_relations(text: str) -> dict[tuple[int, int], RelationConstraint]:
    """`0-1:0,2:-5..5;1-2:0,7:3,4`: distance bins from and to, and angle bins as a range or a list, from the first role to the second."""
    out = {}
    for entry in filter(str.strip, text.split(";")):
        m = re.fullmatch(r"\s*(\d+)-(\d+):(-?\d+),(-?\d+):(?:(-?\d+)\.\.(-?\d+)|(-?\d+(?:,-?\d+)*))\s*", entry)
        if not m:
            raise ValueError(f"{entry!r} isn't of the form i-j:from,to:bins")
        bins = range(int(m[5]), int(m[6]) + 1) if m[5] else map(int, m[7].split(","))
        out[int(m[1]), int(m[2])] = RelationConstraint(int(m[3]), int(m[4]), frozenset(bins))
    return out
