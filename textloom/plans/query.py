"""Queries as immutable values; the planner turns them into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

AND, OR = "AND", "OR"


@dataclass(frozen=True, kw_only=True)
class Query:
    boost: float | None = None


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class Term(Query):
    """Not analysed; one hit per occurrence."""

    field: str
    text: str


@dataclass(frozen=True)
class Range(Query):
    """Over the terms of a field, as strings; bounds are not analysed."""

    field: str
    lt: str | None = None
    lte: str | None = None
    gt: str | None = None
    gte: str | None = None


@dataclass(frozen=True)
class Match(Query):
    field: str
    text: str
    operation: str = AND
    prefix: bool = False


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    text: str
    slop: int = 0


@dataclass(frozen=True)
class GeoPoint(Query):
    field: str
    latitude: float
    longitude: float


@dataclass(frozen=True)
class GeoPolygon(Query):
    """``rings``: lists of (lon, lat)."""

    field: str
    rings: tuple


@dataclass(frozen=True)
class Bool(Query):
    should: tuple = ()
    must: tuple = ()
    filter: tuple = ()
    must_not: tuple = ()
