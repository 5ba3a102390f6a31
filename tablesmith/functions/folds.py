"""Folds over each entity's rows in order, with a state that is carried from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def folded(df: DataFrame, by: list[str], order: list[str], inputs: list[str], outputs: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """``df`` with the columns of ``outputs``: ``step(state, *inputs)`` gives the next state and a tuple of them.

    Rows are dealt by entity and sorted within tasks, and pass through Python in batches; only the state of one entity
    is held, whatever the number of its rows. An entity's rows depend on each other, so they share a task.
    """
    added = StructType.fromDDL(outputs)
    schema = StructType(df.schema.fields + added.fields)
    names, width = df.columns, len(added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        entity, state = object(), None
        for b in batches:
            out: list[list] = [[] for _ in range(width)]
            keys = list(zip(*[b.column(names.index(c)).to_pylist() for c in by], strict=True))
            for key, row in zip(keys, zip(*[b.column(names.index(c)).to_pylist() for c in inputs], strict=True), strict=True):
                if key != entity:
                    entity, state = key, start()
                state, values = step(state, *row)
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            columns = [b.column(i) for i in range(len(names))] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
