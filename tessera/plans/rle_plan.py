"""A small plan over run tables: filters go to the column they read, columns that nothing reads are not joined, joins work on
runs, and runs are decoded last."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from tessera.operators import rle


@dataclass(frozen=True)
class RunPlan:
    """A relation stored as one run table a column. Filters name the columns that they read."""

    columns: dict[str, DataFrame]
    filters: tuple[tuple[frozenset[str], Column], ...] = ()
    selected: tuple[str, ...] | None = field(default=None)

    def filter(self, reads: Sequence[str], condition: Column) -> RunPlan:
        _known(reads, self.columns)
        return replace(self, filters=(*self.filters, (frozenset(reads), condition)))

    def select(self, *names: str) -> RunPlan:
        _known(names, self.columns)
        return replace(self, selected=names)

    def runs(self) -> DataFrame:
        """Runs of the selected columns. A filter on one column is applied before any join, others once their columns have
        met; a column with a filter stays in the join even if it is not selected."""
        wanted = list(self.selected or self.columns)
        needed = [c for c in self.columns if c in wanted or any(c in reads for reads, _ in self.filters)]
        out, have, waiting = None, set(), list(self.filters)
        for name in needed:
            side = self.columns[name]
            for reads, condition in self.filters:
                if reads == {name}:
                    side = rle.filter_runs(side, condition)
            have.add(name)
            out = side if out is None else rle.reconstruct(out, side)
            waiting = [f for f in waiting if f[0] != {name}]
            for f in [f for f in waiting if f[0] <= have]:
                out = rle.filter_runs(out, f[1])
                waiting.remove(f)
        return rle.project_runs(out, *wanted)

    def aggregate(self, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
        return rle.aggregate_runs(self.runs(), keys, aggs)

    def rows(self) -> DataFrame:
        return rle.decode(self.runs())

    def join(self, other: RunPlan, keys: Sequence[tuple[str, str]]) -> JoinPlan:
        """An inner equi-join on runs, below decoding: a pair of runs meets once, whatever their lengths."""
        return JoinPlan(self, other, tuple(keys))


@dataclass(frozen=True)
class JoinPlan:
    """A join of two plans. Filters go to the side that holds all they read, and only those of both sides wait for the join;
    each side joins only the columns that keys, selection or waiting filters need."""

    left: RunPlan
    right: RunPlan
    keys: tuple[tuple[str, str], ...]
    filters: tuple[tuple[frozenset[str], Column], ...] = ()
    selected: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError("an equi-join needs at least one key pair")
        if clash := set(self.left.columns) & set(self.right.columns):
            raise ValueError(f"both sides have {sorted(clash)}")
        _known([a for a, _ in self.keys], self.left.columns)
        _known([b for _, b in self.keys], self.right.columns)

    @property
    def columns(self) -> list[str]:
        return [*(self.left.selected or self.left.columns), *(self.right.selected or self.right.columns)]

    def filter(self, reads: Sequence[str], condition: Column) -> JoinPlan:
        for side in ("left", "right"):
            if set(reads) <= set(getattr(self, side).columns):
                return replace(self, **{side: getattr(self, side).filter(reads, condition)})
        _known(reads, [*self.left.columns, *self.right.columns])
        return replace(self, filters=(*self.filters, (frozenset(reads), condition)))

    def select(self, *names: str) -> JoinPlan:
        _known(names, self.columns)
        return replace(self, selected=names)

    def runs(self) -> DataFrame:
        """Runs of the selected columns; ids are dense from 0 in the order of the sides' ids."""
        wanted = list(self.selected or self.columns)
        read = {*wanted, *(c for pair in self.keys for c in pair), *(c for reads, _ in self.filters for c in reads)}
        sides = [side.select(*[c for c in side.columns if c in read]).runs() for side in (self.left, self.right)]
        out = rle.join_runs(*sides, self.keys)
        for _, condition in self.filters:
            out = rle.filter_runs(out, condition)
        return rle.project_runs(out, *wanted)

    def aggregate(self, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
        return rle.aggregate_runs(self.runs(), keys, aggs)

    def rows(self) -> DataFrame:
        return rle.decode(self.runs())


def _known(names: Iterable[str], columns: Iterable[str]) -> None:
    if missing := sorted(set(names) - set(columns)):
        raise ValueError(f"the plan has no column {', '.join(missing)}")
