"""Recipes: operators wired over named tables, applied with train / held-out discipline.

Row-local steps stay lazy; the input of a step that runs jobs is written once, so nothing upstream runs twice.
"""

from __future__ import annotations

from collections import Counter
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, functions as F

from .. import operators
from ..operators.base import HELD_OUT, SPLIT, Operator, apply_ordered
from ..functions.values import as_list, col
from ..session import materialise, table_scope


class RecipeError(ValueError):
    pass


def _checked_nodes(spec: dict) -> tuple[dict, dict, str]:
    dag = spec.get("dag")
    if not isinstance(dag, dict):
        raise RecipeError("a recipe needs a 'dag' mapping")
    sources, steps = {}, {}
    for node in dag.get("sources") or []:
        if not node.get("id") or not node.get("table"):
            raise RecipeError("every source needs id and table")
        if node["id"] in sources:
            raise RecipeError(f"source {node['id']} appears twice")
        sources[node["id"]] = node["table"]
    for node in dag.get("ops") or []:
        if not node.get("id") or not node.get("op"):
            raise RecipeError("every step needs id and op")
        if node["id"] in steps or node["id"] in sources or node["id"] == "train":
            raise RecipeError(f"id {node['id']} appears twice")
        if not as_list(node.get("prev")):
            raise RecipeError(f"step {node['id']} has no input")
        steps[node["id"]] = node
    if not sources:
        raise RecipeError("a recipe needs at least one source")
    ends = as_list((dag.get("train") or {}).get("prev"))
    if len(ends) != 1:
        raise RecipeError("train must have exactly one input")
    return sources, steps, ends[0]


def _ordered(sources, steps, end):
    """Step ids so that inputs come first; every node must feed the result."""
    known = {**sources, **steps}
    if end not in known:
        raise RecipeError(f"unknown input {end}")
    graph = {}
    for name, node in steps.items():
        inputs = as_list(node["prev"])
        for i in inputs:
            if i not in known:
                raise RecipeError(f"step {name} reads unknown input {i}")
        graph[name] = inputs
    try:
        order = list(TopologicalSorter(graph).static_order())
    except CycleError as error:
        raise RecipeError(f"cycle between steps: {error.args[1]}") from error
    used, todo = set(), [end]
    while todo:
        name = todo.pop()
        if name not in used:
            used.add(name)
            todo.extend(graph.get(name, []))
    unused = [n for n in known if n not in used]
    if unused:
        raise RecipeError(f"nodes that do not feed the result: {unused}")
    return [n for n in order if n in steps]


class Recipe:
    """``Recipe.from_spec(spec).run(tables)`` gives the final table.

    ``kind`` is 'tabular' or 'rec'; see :func:`apply_with_split`.
    """

    def __init__(self, sources, steps, end, order, kind):
        self.sources, self.steps, self.end, self.order, self.kind = sources, steps, end, order, kind
        self.fitted: dict[str, Operator] = {}

    @classmethod
    def from_spec(cls, spec: dict, kind: str = "tabular") -> "Recipe":
        if kind not in ("tabular", "rec"):
            raise RecipeError("kind must be 'tabular' or 'rec'")
        sources, steps, end = _checked_nodes(spec)
        return cls(sources, steps, end, _ordered(sources, steps, end), kind)

    def run(self, tables: dict[str, DataFrame], tidy: bool = False) -> DataFrame:
        """The final table.  With ``tidy`` it is written, and the tables written on the way are deleted."""
        if tidy and tables:
            with table_scope(next(iter(tables.values())).sparkSession):
                return materialise(self._run(tables), keep=True)
        return self._run(tables)

    def _run(self, tables: dict[str, DataFrame]) -> DataFrame:
        values = {}
        for name, table in self.sources.items():
            if table not in tables:
                raise RecipeError(f"table {table} is not available")
            values[name] = tables[table]
        readers = Counter(i for node in self.steps.values() for i in as_list(node["prev"]))
        fixed, done = set(values), set()
        for name in self.order:
            if name in done:
                continue
            node = self.steps[name]
            main, *side = as_list(node["prev"])
            step = self._bound(node, [values[i] for i in side], tables)
            # A step that runs jobs on its input, or one that several steps read, would run all before it again
            # for each of them: its result is written once.  Sources are files already.
            for i in [main, *side]:
                if i not in fixed and (readers[i] > 1 or i == main and step.runs_jobs):
                    values[i] = materialise(values[i])
                    fixed.add(i)
            if side:
                step = self._bound(node, [values[i] for i in side], tables)
            chain = self._shared_window(name, step, values[main], readers, tables)
            if len(chain) > 1:
                last = list(chain)[-1]
                values[last] = apply_ordered(values[main], [part for _, part in chain.values()])
                self.fitted.update({n: s for n, (s, _) in chain.items()})
                done.update(chain)
                continue
            values[name] = apply_with_split(step, values[main], self.kind)
            self.fitted[name] = step
        return values[self.end]

    def _shared_window(self, name: str, step: Operator, df: DataFrame, readers, tables) -> dict:
        """The step and those right after it that add columns over the same ordered groups: {id: (step, part)}.

        They read what the first one reads and nothing else reads what they write, so one shuffle and one sort serve all.
        Tables with a split marker go step by step.
        """
        if SPLIT in df.columns:
            return {}
        chain: dict = {}
        while step is not None:
            part = step.ordered_part(df)
            if part is None or not part.fits([p for _, p in chain.values()]):
                break
            chain[name] = step.fit(df), part
            nexts = [n for n, node in self.steps.items() if as_list(node["prev"]) == [name]]
            if readers[name] != 1 or name == self.end or len(nexts) != 1:
                break
            name = nexts[0]
            step = self._bound(self.steps[name], [], tables)
        return chain

    def _bound(self, node, side, tables):
        kind = getattr(operators, node["op"], None)
        if not (isinstance(kind, type) and issubclass(kind, Operator)):
            raise RecipeError(f"unknown operator {node['op']}")
        params = {}
        for key, given in (node.get("params") or {}).items():
            if isinstance(given, str) and given.startswith("$"):
                if given[1:] not in tables:
                    raise RecipeError(f"table {given[1:]} is not available")
                given = tables[given[1:]]
            params[key] = given
        if side:
            params.update(_placed(node["id"], kind, params, side))
        return kind(**params)


def _placed(name: str, kind: type[Operator], params: dict, tables: list[DataFrame]) -> dict:
    """Which parameter takes each further input, by what the operator declares.

    Tables known by a column go first; the others fill the parameters left, from the last one on.
    """
    if kind.many_tables and kind.many_tables not in params:
        return {kind.many_tables: tables}
    free = {p: known_by for p, known_by in kind.side_tables(params) if p not in params}
    if len(tables) > len(free):
        raise RecipeError(f"step {name} takes {len(free)} further inputs, {len(tables)} are given")
    out, unknown = {}, []
    for table in tables:
        match = next((p for p, c in free.items() if c in table.columns and p not in out), None)
        if match:
            out[match] = table
        else:
            unknown.append(table)
    return out | dict(zip([p for p in reversed(free) if p not in out], unknown))


def apply_with_split(step: Operator, df: DataFrame, kind: str = "tabular") -> DataFrame:
    """Apply one step so that held-out rows never inform it.

    Statistics are fitted on training rows; train-only steps leave held-out rows as
    they are; the marker stays a column of its row throughout.  In 'rec' tables a
    step that reads across rows runs per split; in 'tabular' tables it sees all rows.
    """
    if SPLIT not in df.columns or step.uses_history:
        return step.fit(df).transform(df)
    held = col(SPLIT) == F.lit(HELD_OUT)
    train = df.where(col(SPLIT) == F.lit("train")).drop(SPLIT)
    if step.fit_on_train:
        step.fit(train)
    if step.train_only:
        rest = df.where(~F.coalesce(held, F.lit(False)))
        new = _per_split(step, rest) if kind == "rec" or step.cross_row else _kept_marker(step, rest)
        return new.unionByName(df.where(held), allowMissingColumns=True)
    if step.per_split or (kind == "rec" and step.cross_row):
        return _per_split(step, df)
    return _kept_marker(step, df)


def _kept_marker(step, df):
    return step.transform(df) if step.fitted else step.fit(df).transform(df)


def _per_split(step, df):
    """Transform each split on its own; the marker values are a handful."""
    out = None
    for row in sorted(df.select(SPLIT).distinct().collect(), key=lambda r: str(r[0])):
        part = df.where(col(SPLIT).eqNullSafe(F.lit(row[0]))).drop(SPLIT)
        if not step.fit_on_train:
            step.fit(part)
        new = step.transform(part).withColumn(SPLIT, F.lit(row[0]).cast("string"))
        out = new if out is None else out.unionByName(new, allowMissingColumns=True)
    return df if out is None else out
