"""Array and map columns, and configurations that inherit."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def union(a: Column, b: Column) -> Column:
    """Distinct elements of two arrays."""
    return F.array_union(a, b)


def merged(a: Column, b: Column, first_wins: bool = False) -> Column:
    """Entries of two maps; where both have a key, the second's, or the first's."""
    keep, give = (a, b) if first_wins else (b, a)
    rest = F.map_filter(give, lambda k, _: ~F.map_contains_key(keep, k))
    return F.map_concat(rest, keep)


def renamed_keys(m: Column, pattern: str, value: str, values_too: bool = False) -> Column:
    """Keys, and text values if asked for, with a pattern replaced."""
    out = F.transform_keys(m, lambda k, _: F.regexp_replace(k, pattern, value))
    return F.transform_values(out, lambda _, v: F.regexp_replace(v, pattern, value)) if values_too else out


def split_by_lengths(a: Column, lengths: list[int]) -> Column:
    """An array cut into pieces of given lengths."""
    starts = [1 + sum(lengths[:i]) for i in range(len(lengths))]
    return F.array(*(F.slice(a, s, n) for s, n in zip(starts, lengths, strict=True)))


def has_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def has_duplicates(a: Column) -> Column:
    return F.size(a) != F.size(F.array_distinct(a))


class Configurations:
    """Named settings that inherit from others under the key 'parent', merged deeply or not."""

    def __init__(self, settings: Mapping[str, Mapping[str, Any]], deep: bool = True):
        self.settings, self.deep = dict(settings), deep

    def _merge(self, low: Mapping[str, Any], high: Mapping[str, Any]) -> dict[str, Any]:
        out = dict(low)
        for k, v in high.items():
            both = self.deep and isinstance(v, Mapping) and isinstance(out.get(k), Mapping)
            out[k] = self._merge(out[k], v) if both else v
        return out

    def get(self, name: str) -> dict[str, Any]:
        chain, at = [], name
        while at is not None:
            if at in chain:
                raise ValueError(f"{name} inherits from itself: {[*chain, at]}")
            if at not in self.settings:
                raise KeyError(at)
            chain.append(at)
            at = self.settings[at].get("parent")
        out: dict[str, Any] = {}
        for n in reversed(chain):
            out = self._merge(out, {k: v for k, v in self.settings[n].items() if k != "parent"})
        return out

    def differences(self, a: str, b: str) -> dict[str, tuple[Any, Any]]:
        x, y = self.get(a), self.get(b)
        return {k: (x.get(k), y.get(k)) for k in sorted({*x, *y}) if x.get(k) != y.get(k)}


class Features:
    """A named set of switches, changed by adding and removing."""

    def __init__(self, base: set[str] | frozenset[str] = frozenset(), add: tuple[str, ...] = (), remove: tuple[str, ...] = (), label: str = ""):
        self.on = frozenset(base) | frozenset(add)
        if unknown := set(remove) - self.on:
            raise ValueError(f"not switched on: {sorted(unknown)}")
        self.on -= frozenset(remove)
        self.label = label or "_".join(sorted(self.on)) or "plain"

    def __contains__(self, name: str) -> bool:
        return name in self.on
