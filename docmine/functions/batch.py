"""Caller-supplied Python functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_per_page(df: DataFrame, fn: Callable, column: str, keys: list[str], out: str = "text") -> DataFrame:
    """``fn`` on every value; a failure leaves an empty text and its message."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + f", `{out}` string, error string"

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            values, errors = [], []
            for value in pdf[column]:
                try:
                    values.append(fn(value))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - reported per row
                    values.append("")
                    errors.append(str(exc))
            yield pdf[keys].assign(**{out: values, "error": errors})

    return df.select(*keys, column).mapInPandas(run, schema)


def batch_infer(
    df: DataFrame,
    load: Callable[[], object],
    predict: Callable[[object, list], list],
    column: str,
    key: str,
    out_type: str,
    batch: int = 128,
    workers: int | None = None,
) -> DataFrame:
    """``predict(model, values)`` in chunks; the model is loaded once per task, results go by
    key, and the rows of a failing chunk get ``success`` false and the message as ``error``.
    A model that cannot be loaded fails the job."""
    if workers:
        df = df.repartition(workers, key)
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[key]

    def run(batches: Iterator[pd.DataFrame]):
        model = None
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                model = load() if model is None else model
                try:
                    found = list(predict(model, list(part[column])))
                    if len(found) != len(part):
                        raise ValueError("one result per value expected")
                    error = None
                except Exception as exc:  # noqa: BLE001 - the chunk is marked
                    found, error = [None] * len(part), f"{type(exc).__name__}: {exc}"
                result = {key: part[key].values, "result": pd.Series(found, dtype=object), "success": error is None}
                yield pd.DataFrame({**result, "error": pd.Series([error] * len(part), dtype=object)})

    return df.select(key, column).mapInPandas(run, f"`{key}` {kind}, result {out_type}, success boolean, error string")


def embed(df: DataFrame, load: Callable, encode: Callable, column: str, key: str, batch: int = 32) -> DataFrame:
    """Vectors by key, in chunks of 32."""
    return batch_infer(df, load, encode, column, key, "array<double>", batch)


def reduce_partials(
    df: DataFrame, keys: list[str], partial: Callable[[pd.DataFrame], dict], merge: dict[str, str], schema: str
) -> DataFrame:
    """User counters per Arrow batch, merged by built-in aggregates (``sum``, ``min``,
    ``max``). ``partial`` maps a batch of one key to its counters, so no key is gathered."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    full = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = [
                {**dict(zip(keys, group if isinstance(group, tuple) else (group,))), **partial(part)}
                for group, part in pdf.groupby(keys, dropna=False)
            ]
            if rows:
                yield pd.DataFrame(rows)[[*keys, *merge]]

    calls = {"sum": F.sum, "min": F.min, "max": F.max}
    return df.mapInPandas(run, full).groupBy(*keys).agg(*[calls[how](c).alias(c) for c, how in merge.items()])
