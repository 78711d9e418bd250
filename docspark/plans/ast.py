"""Nodes of parsed and canonical queries. loc is the (line, column) of the defining token."""

from __future__ import annotations

from dataclasses import dataclass, field

Loc = tuple[int, int]


@dataclass(frozen=True)
class Path:
    """keys: str, int or '[*]'. var is set when aliases are resolved: 'base' or 'unnest'."""

    loc: Loc
    keys: tuple[str | int, ...]
    var: str = ""


@dataclass(frozen=True)
class Lit:
    loc: Loc
    value: object


@dataclass(frozen=True)
class Param:
    loc: Loc
    name: str


@dataclass(frozen=True)
class Bool:
    """op is and / or."""

    op: str
    loc: Loc
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    loc: Loc
    arg: object


@dataclass(frozen=True)
class Cmp:
    loc: Loc
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Between:
    loc: Loc
    arg: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class Test:
    """kind: null, missing, in, like, contains; arg is its operand."""

    kind: str
    loc: Loc
    path: object
    arg: object = None
    negated: bool = False


@dataclass(frozen=True)
class Projection:
    path: Path
    name: str | None
    loc: Loc


@dataclass(frozen=True)
class Unnest:
    path: Path
    alias: str
    loc: Loc


@dataclass(frozen=True)
class Source:
    name: str
    loc: Loc
    args: tuple | None = None


@dataclass
class Query:
    select: list[Projection] | None
    source: Source
    alias: str | None
    unnest: Unnest | None
    where: object | None
    order: list[tuple[Path, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    offset_loc: Loc | None = None
    subscribe: bool = False
