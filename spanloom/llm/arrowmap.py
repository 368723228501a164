"""Run a numpy function over the texts of a DataFrame, a few megabytes of whole documents at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.textnp import Texts, chunks, releasing, whole


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until no column of ``df`` is called so (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_struct(df: DataFrame, text: str, name: str, compute: Callable[[Texts], list], fields: T.StructType, most: int = 1 << 20) -> DataFrame:
    """All columns of ``df`` and a struct column ``name``: what ``compute`` makes of ``df[text]``.

    ``compute`` gets some whole documents (a null text is empty) and returns an array for each field.  Documents stay
    in their rows and partitions: there is no shuffle.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, fields)])
    kinds = [to_arrow_type(f.dataType) for f in fields.fields]
    names = [f.name for f in fields.fields]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made: list[list[pa.Array]] = [[] for _ in kinds]
            for piece in chunks(whole(batch.column(at)), most):
                for out, kind, values in zip(made, kinds, compute(piece), strict=True):
                    out.append(values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
            columns = [pa.concat_arrays(x) for x in made]
            struct = pa.StructArray.from_arrays(columns, names)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return df.mapInArrow(releasing(run), schema)
