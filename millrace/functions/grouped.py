"""Pandas callables per group: over whole ordered groups, or over batches that carry facts of their group."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator  # noqa: UP035  (the form Spark's inference reads)

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import keyed_join
from .ordering import order_columns
from .values import col


def apply_groups(df: DataFrame, keys: list[str], order: list,
                 method: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Call ``method`` once per group on an iterator over the whole group, in ``order``.

    The group arrives in batches of bounded size (``spark.sql.execution.arrow.maxRecordsPerBatch``), sorted on disk by
    Spark, so a callable that keeps a running state or writes as it reads handles a group larger than a worker; one that
    needs the group as one frame may concatenate the batches.  Rows with missing keys are groups too.  The output's
    order within a group is the callable's.  One group is one task's work: use it where the callable needs that.  Many small groups share their batches to and from the worker.
    """
    within, columns = [col(k) for k in keys], list(df.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, rows = [], 0
        for group in _groups(batches, columns):
            for out in method(group):
                # Small results travel together, large ones as they come.
                made.append(out)
                rows += len(out)
                if rows >= ROWS_TOGETHER:
                    yield pd.concat(made, ignore_index=True)
                    made, rows = [], 0
            for _ in group:
                pass
        if made:
            yield pd.concat(made, ignore_index=True)

    # The number of parts is given, as a callable's work does not show in the bytes by which the engine would merge parts.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *within).sortWithinPartitions(*within, *order_columns(order))
    # Two hashes tell neighbouring groups apart, missing keys and NaN too.
    marked = dealt.withColumns({m: F.xxhash64(F.lit(m), *within) for m in MARKS})
    return marked.mapInPandas(run, schema)


MARKS = ("__mark_1__", "__mark_2__")
# Rows of results that are handed on at once.
ROWS_TOGETHER = 10_000


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[Iterator[pd.DataFrame]]:
    """The batches of each group in turn, cut where the marks change; a group is read before the next one begins."""
    ahead: list = []

    def pieces():
        last = None
        for batch in batches:
            if not len(batch):
                continue
            marks = batch[list(MARKS)].to_numpy()
            starts = np.r_[last is None or bool((marks[0] != last).any()), (marks[1:] != marks[:-1]).any(axis=1)]
            last, batch = marks[-1], batch[columns]
            cuts = np.flatnonzero(starts).tolist()
            edges = [*([] if cuts and cuts[0] == 0 else [0]), *cuts, len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    yield bool(starts[a]), batch.iloc[a:b].reset_index(drop=True)

    rest = pieces()

    def one():
        yield ahead.pop()
        for first, piece in rest:
            if first:
                ahead.append(piece)
                return
            yield piece

    for _, piece in rest:
        ahead.append(piece)
        while ahead:
            yield one()


def map_with_facts(df: DataFrame, keys: list[str], facts: dict[str, Column], method: Callable[[pd.DataFrame], pd.DataFrame],
                   schema: str) -> DataFrame:
    """Call ``method`` on pandas batches whose rows carry the ``facts`` of their group as columns.

    The facts are aggregates of the whole group, combined by Spark and joined to its rows, so no group has to fit
    in one task; a batch holds rows of any groups.  For callables that need the group itself see :func:`apply_groups`.
    """
    stats = df.groupBy(*[col(k) for k in keys]).agg(*[c.alias(n) for n, c in facts.items()])

    def run(batches):
        for batch in batches:
            yield method(batch)

    return keyed_join(df, stats, keys).mapInPandas(run, schema)
