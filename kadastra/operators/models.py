"""Models that the caller brings: vectors, scores and summaries of columns, set up once for each Python worker."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadastra.operators.views import lineage

#: States of so many groups are held at once by a task before they are handed on.
OPEN = 10_000
#: States of so many partitions are merged first.
TOGETHER = 64

_made: dict[str, Any] = {}


def _ready(key: str, make: Callable[[], Any]) -> Any:
    """This worker's model. A worker runs many tasks, and makes the model at the first batch of the first of them."""
    if key not in _made:
        _made[key] = make()
    return _made[key]


def with_model(df: DataFrame, column: str, make: Callable[[], Callable[[list], Sequence]], name: str, kind: str, *, batch: int = 64) -> DataFrame:
    """`df` with column `name` of type `kind`: what the model that `make()` gives makes of `column`, at most `batch` values in one call.

    Nulls aren't shown to the model and stay null; without other values it isn't made. A call must give as many results as it got values, or the query
    fails. Repeated values are shown each time. Rows stay where they are.
    """
    key = uuid4().hex

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            known = [i for i, v in enumerate(s.notna()) if v]
            values = s.tolist()
            out: list = [None] * len(values)
            for at in range(0, len(known), batch):
                some = known[at : at + batch]
                results = list(_ready(key, make)([values[i] for i in some]))
                if len(results) != len(some):
                    raise ValueError(f"the model gave {len(results)} results for {len(some)} values")
                for i, r in zip(some, results):
                    out[i] = r
            yield pd.Series(out, dtype=object)

    return df.withColumn(name, run(column))


class Summary(Protocol):
    """How a group becomes one value. States must be small and picklable; `merge` must give the same whatever the order and the grouping."""

    def start(self) -> Any: ...

    def add(self, state: Any, values: list) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> Any: ...


class Longest:
    """The default: how many values there are, and the longest `most` different ones cut to `width` characters, ties in their order."""

    def __init__(self, most: int = 3, width: int = 80, unit: str = "réponses") -> None:
        self.most, self.width, self.unit = most, width, unit

    def start(self) -> tuple[int, list[str]]:
        return 0, []

    def _cut(self, values: set[str]) -> list[str]:
        return sorted(values, key=lambda v: (-len(v), v))[: self.most]

    def add(self, state: tuple[int, list[str]], values: list[str]) -> tuple[int, list[str]]:
        return state[0] + len(values), self._cut({*state[1], *values})

    def merge(self, a: tuple[int, list[str]], b: tuple[int, list[str]]) -> tuple[int, list[str]]:
        return a[0] + b[0], self._cut({*a[1], *b[1]})

    def finish(self, state: tuple[int, list[str]]) -> str:
        return f"{state[0]} {self.unit} : " + " | ".join(v[: self.width] for v in state[1])


def summaries(df: DataFrame, keys: Sequence[str], column: str, make: Callable[[], Summary] = Longest, name: str = "summary", kind: str = "string") -> DataFrame:
    """(keys, name): one summary of `column` for each group.

    Tasks fold their rows into a state for each group, and states are merged in two steps, so no task holds a group's rows and a popular group is a state for
    each partition. Keys are plain values; null is a group. Null values are left out; a group of nulls is the summary of nothing. No rows give no groups.
    """
    key = uuid4().hex
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, _state binary" if keys else "_state binary"
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        fields: list[pa.Field] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(fields)]
            states = pa.array([pickle.dumps(s) for s in held.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, states], [*(f.name for f in fields), "_state"])

        for b in batches:
            fields = [b.schema.field(i) for i in range(n)]
            groups: dict[tuple, list] = {}
            names = zip(*(b.column(i).to_pylist() for i in range(n))) if n else iter([()] * b.num_rows)
            for group, value in zip(names, b.column(n).to_pylist()):
                values = groups.setdefault(group, [])
                if value is not None:
                    values.append(value)
            model = _ready(key, make)
            for group, values in groups.items():
                held[group] = model.add(held[group] if group in held else model.start(), values)
            if len(held) >= OPEN:
                yield out()
                held = {}
        if held:
            yield out()

    @F.pandas_udf("binary")
    def merge(states: pd.Series) -> bytes:
        model = _ready(key, make)
        whole = pickle.loads(states.iloc[0])
        for s in states.iloc[1:]:
            whole = model.merge(whole, pickle.loads(s))
        return pickle.dumps(whole)

    @F.pandas_udf(kind)
    def finish(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([_ready(key, make).finish(pickle.loads(x)) for x in s], dtype=object)

    folded = df.select(*keys, F.col(column).alias("_value")).mapInArrow(fold, schema)
    first = folded.withColumn("_part", F.expr(f"spark_partition_id() div {TOGETHER}")).groupBy(*keys, "_part").agg(merge("_state").alias("_state"))
    return first.groupBy(*keys).agg(merge("_state").alias("_state")).select(*keys, finish("_state").alias(name))


def view_summaries(df: DataFrame, views: dict[str, Sequence[str]], column: str, make: Callable[[], Summary] = Longest, name: str = "summary") -> DataFrame:
    """(view_name, dim1_value, dim2_value, name): a summary of `column` for each row of the views that `materialise` makes of `views`; rows lacking one of a view's keys are left out of it."""
    return summaries(lineage(df, views, column), ["view_name", "dim1_value", "dim2_value"], column, make, name)
