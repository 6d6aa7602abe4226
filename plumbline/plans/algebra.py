"""Plan nodes of the query algebra and their JSON form.

A slot that holds a string beginning with "?" is a hole: the question left it open, and such a plan is not executed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, fields, is_dataclass


@dataclass(frozen=True)
class Region:
    place: str
    op = "REGION"


@dataclass(frozen=True)
class Select:
    entity: str
    region: Region | None = None
    time: tuple[str | None, str | None] | None = None
    op = "SELECT"


@dataclass(frozen=True)
class Aggregate:
    by: str
    metric: str
    source: object
    op = "AGGREGATE"


@dataclass(frozen=True)
class Relate:
    relation: str
    left: object
    right: object
    threshold: float | None = None
    op = "RELATE"


@dataclass(frozen=True)
class Compare:
    how: str
    left: object
    op = "COMPARE"


@dataclass(frozen=True)
class Rank:
    """Grouped ranking, an extension: the `top` groups by count within each value of `within`."""

    group: str
    top: int
    source: object
    within: str | None = None
    op = "RANK"


_NODES = {c.op: c for c in (Region, Select, Aggregate, Relate, Compare, Rank)}
_SLOTS = {
    "AGGREGATE": {"by": {"space", "time"}, "metric": {"count"}},
    "RELATE": {"relation": {"within"}},
    "COMPARE": {"how": {"trend_direction"}},
}


class PlanError(ValueError):
    """A plan that names an unknown operator, or whose slots cannot mean anything."""


def from_json(tree: dict | str) -> object:
    """The plan node of a JSON tree whose objects carry their operator in `op`."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    if (kind := _NODES.get(tree.get("op"))) is None:
        raise PlanError(f"unknown operator {tree.get('op')!r}")
    names = {f.name for f in fields(kind)}
    slots = {"threshold" if k == "threshold_km" else k: v for k, v in tree.items() if k != "op"}
    if unknown := set(slots) - names:
        raise PlanError(f"{kind.op} has no slot {sorted(unknown)}")
    if isinstance(slots.get("time"), dict):
        slots["time"] = (slots["time"].get("start"), slots["time"].get("end"))
    try:
        return kind(**{k: from_json(v) if isinstance(v, dict) else v for k, v in slots.items()})
    except TypeError as e:
        raise PlanError(f"{kind.op}: {e}") from None


def to_json(node: object) -> dict:
    out: dict = {"op": node.op}
    for f in fields(node):
        value = getattr(node, f.name)
        out[f.name] = to_json(value) if is_dataclass(value) else {"start": value[0], "end": value[1]} if f.name == "time" and value else value
    return out


def canonical(node: object) -> str:
    """One spelling for equal plans: JSON with sorted keys."""
    return json.dumps(to_json(node), sort_keys=True)


def holes(node: object) -> Iterator[str]:
    """The open slots of a plan, wherever they are."""
    for f in fields(node):
        value = getattr(node, f.name)
        for x in value if isinstance(value, tuple) else (value,):
            if is_dataclass(x):
                yield from holes(x)
            elif isinstance(x, str) and x.startswith("?"):
                yield x


def validate(node: object) -> None:
    """Raise PlanError unless every slot has a value that the compiler knows; a `within` needs its threshold."""
    for slot, known in _SLOTS.get(node.op, {}).items():
        if getattr(node, slot) not in known:
            raise PlanError(f"{node.op}: {slot} must be one of {sorted(known)}")
    if isinstance(node, Relate) and (node.threshold is None or node.threshold <= 0):
        raise PlanError("RELATE within needs a positive threshold")
    if isinstance(node, Compare) and not (isinstance(node.left, Aggregate) and node.left.by == "time"):
        raise PlanError("COMPARE trend_direction needs an AGGREGATE by time")
    for f in fields(node):
        if is_dataclass(value := getattr(node, f.name)):
            validate(value)
