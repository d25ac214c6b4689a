"""Operator contract: learn from training rows, then transform any rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec

from ..functions.ordering import add_window_columns

SPLIT = "__split__"
HELD_OUT = "std_test"


@dataclass(frozen=True)
class OrderedPart:
    """Columns over ordered groups: ``build`` makes ``makes`` from ``reads`` for a window whose frames reach ``halo`` rows back.

    Parts of equal group and order can share one shuffle and one sort.
    """

    group: tuple[str, ...]
    order: tuple[str, ...]
    build: Callable[[WindowSpec], dict[str, Column]]
    halo: int
    reads: frozenset[str]
    makes: frozenset[str]
    limit: int | None = None

    def fits(self, others: list[OrderedPart]) -> bool:
        """Whether it may run beside ``others`` instead of after them."""
        made = frozenset().union(*[p.makes for p in others])
        return all((p.group, p.order, p.limit) == (self.group, self.order, self.limit) for p in others) \
            and not made & (self.reads | self.makes | set(self.group) | set(self.order))


def apply_ordered(df: DataFrame, parts: list[OrderedPart]) -> DataFrame:
    """All parts over one window; they have one group and order."""
    first = parts[0]

    def build(window):
        return {n: c for p in parts for n, c in p.build(window).items()}
    return add_window_columns(df, list(first.group), list(first.order), build, max(p.halo for p in parts), first.limit)


class Operator:
    """A table-to-table step.

    ``fit_on_train``   statistics come from training rows only.
    ``train_only``     held-out rows pass through untouched.
    ``uses_history``   sees all splits at once and handles the marker itself.
    ``cross_row``      a row's result depends on other rows of the same table.
    ``per_split``      adds rows, so it runs on each split separately.
    """

    fit_on_train = False
    train_only = False
    uses_history = False
    cross_row = False
    per_split = False

    @property
    def runs_jobs(self) -> bool:
        """Whether fitting or applying the step starts jobs on its input."""
        return self.fit_on_train or self.cross_row or self.uses_history or self.per_split

    #: semantic type of columns the operator adds, name -> type
    output_col_types: dict[str, str] = {}

    #: parameter that takes any number of further tables, if the operator has one
    many_tables: str | None = None

    @classmethod
    def side_tables(cls, params: dict) -> list[tuple[str, str | None]]:
        """Parameters that take one further table each, with the column by which the table is known, if any."""
        return []

    def ordered_part(self, df: DataFrame) -> OrderedPart | None:
        """What the step adds over ordered groups of ``df``, if that is all it does; see :class:`OrderedPart`."""
        return None

    def __init__(self):
        self.fitted = False

    def fit(self, df: DataFrame) -> "Operator":
        self._fit(df)
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            self.fit(df)
        return self._apply(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _fit(self, df: DataFrame) -> None:
        """Learn from ``df``; the default learns nothing."""

    def _apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def choose(name: str, given, allowed) -> None:
    if given not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, got {given!r}")
