"""Plug-in stages: run any per-frame model over a table of frames."""

import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captura.operators.shared import written


def map_frames(df: DataFrame, build: Callable[[], Callable], schema: str, keys=("video_id", "frame_idx")):
    """Apply a model batch by batch; returns (results, failures).

    ``build`` is called once per task and returns a function from a pandas batch
    to a pandas batch of ``schema`` with the same index. When a batch fails, its
    rows are retried one at a time so that only the bad ones end up in
    ``failures`` with the error text. Outcomes are written once to shared storage and both are
    read from there, so the model sees a row once, also if an executor is lost later. Filter and prune columns before calling: the
    optimizer does not move them past Python.
    """
    out = T._parse_datatype_string(schema)
    kinds = dict(df.dtypes)
    key_schema = [T.StructField(k, T._parse_datatype_string(kinds[k])) for k in keys]
    fields = [f for f in out.fields if f.name not in keys]
    full = T.StructType([*key_schema, *[T.StructField(f.name, f.dataType, True) for f in fields], T.StructField("error", T.StringType())])
    names = [f.name for f in full.fields]

    def run(batches):
        model = build()

        def attempt(pdf):
            result = model(pdf)
            keyed = pd.concat([pdf[list(keys)], result.drop(columns=list(keys), errors="ignore")], axis=1)
            return keyed.assign(error=None)

        for pdf in batches:
            try:
                yield attempt(pdf)[names]
            except Exception:
                for i in range(len(pdf)):
                    row = pdf.iloc[i : i + 1]
                    try:
                        yield attempt(row)[names]
                    except Exception as exc:
                        why = traceback.format_exception_only(type(exc), exc)[-1].strip()
                        yield row[list(keys)].assign(error=why).reindex(columns=names)

    mapped = written(df.mapInPandas(run, full), "outcomes")
    results = mapped.filter(F.col("error").isNull()).drop("error")
    failures = mapped.filter(F.col("error").isNotNull()).select(*keys, F.col("error").alias("reason"))
    return results, failures


# Named factories, looked up by configuration.
_STAGES: dict = {}


def register_stage(name: str, build: Callable[[], Callable]) -> None:
    _STAGES[name] = build


def stage(name: str) -> Callable[[], Callable]:
    if name not in _STAGES:
        raise ValueError(f"unknown stage {name!r}; registered: {sorted(_STAGES)}")
    return _STAGES[name]
