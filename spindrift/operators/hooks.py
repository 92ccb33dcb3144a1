"""Outside functions (text, embedding and similarity models) over whole tables, in batches, with a contract and captured failures.

A hook is a function of a list of values that returns one result for each. It runs inside tasks on at most ``batch`` rows at a time, so neither a
partition nor a table is held. Results that are not as many as the rows of their batch are an error that names the batch, whatever
is captured: they can't be told apart, so none of them is used.

``on_error="raise"`` propagates a failure. ``on_error="capture"`` gives a batch that fails to the function again row by row: the rows that fail have no result and an ``error``
(stage and what was said), all others are whole. ``dead_letters`` are those rows; ``fail_open`` puts a default in their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH = 64
_ERROR = "struct<stage:string,message:string>"


class WrongCount(ValueError):
    """A hook returned more or fewer results than it was given rows."""


def _checked(fn: Callable[[list], list], values: list, stage: str, where: str) -> list:
    out = fn(values)
    out = list(out) if out is not None else []
    if len(out) != len(values):
        raise WrongCount(f"{stage}: {len(out)} results for {len(values)} rows in {where}")
    return out


def hooked(rows: DataFrame, column: str, out: str, kind: str, fn: Callable[[list], list], stage: str, batch: int = BATCH, on_error: str = "raise") -> DataFrame:
    """``rows`` with ``out`` (of Spark type ``kind``), what ``fn`` makes of ``column``; with ``error`` where failures are captured."""
    if on_error not in ("raise", "capture"):
        raise ValueError("on_error is raise or capture")
    if batch < 1:
        raise ValueError("batch must be positive")
    capture = on_error == "capture"
    named = StructType().add("row", rows.select(F.struct("*").alias("row")).schema["row"].dataType).add(out, _parse_datatype_string(kind)).add("error", _parse_datatype_string(_ERROR))
    arrow = to_arrow_schema(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                own = b.slice(lo, batch)
                values = own.column(1).to_pylist()
                where = f"partition {part}, rows {done} to {done + len(values) - 1}"
                done += len(values)
                errors: list = [None] * len(values)
                try:
                    made = _checked(fn, values, stage, where)
                except WrongCount:
                    raise
                except Exception:
                    if not capture:
                        raise
                    made = []
                    for i, v in enumerate(values):
                        try:
                            made += _checked(fn, [v], stage, f"{where}, row {i}")
                        except WrongCount:
                            raise
                        except Exception as e:
                            made.append(None)
                            errors[i] = {"stage": stage, "message": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(made, arrow.field(1).type), pa.array(errors, arrow.field(2).type)], schema=arrow)

    met = rows.select(F.struct("*").alias("row"), F.col(column).alias("value")).mapInArrow(run, named)
    return met.select("row.*", out, "error") if capture else met.select("row.*", out)


def dead_letters(made: DataFrame, *keys: str) -> DataFrame:
    """``keys``, stage and message of the rows that failed."""
    return made.where("error is not null").select(*keys, "error.stage", "error.message")


def fail_open(made: DataFrame, column: str, default: object) -> DataFrame:
    """``made`` with ``default`` where a row failed, and without ``error``."""
    return made.withColumn(column, F.when(F.col("error").isNotNull(), F.lit(default)).otherwise(F.col(column))).drop("error")


def provided_context(queries: DataFrame, retrieve: Callable[[list], list], enabled: bool = True, open_on_failure: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """query_id and context of every query (query_id, text), made by an outside retriever; and the failures, where it fails open.

    Off: all contexts are empty and nothing is asked. Failing open, a query whose retrieval failed has an empty context; otherwise the failure is raised."""
    if not enabled:
        return queries.select("query_id", F.lit("").alias("context")), None
    made = hooked(queries.select("query_id", "text"), "text", "context", "string", retrieve, "retrieval", on_error="capture" if open_on_failure else "raise")
    if not open_on_failure:
        return made.select("query_id", F.coalesce("context", F.lit("")).alias("context")), None
    return fail_open(made, "context", "").select("query_id", F.coalesce("context", F.lit("")).alias("context")), dead_letters(made, "query_id")
