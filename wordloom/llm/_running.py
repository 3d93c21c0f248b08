"""Running totals within groups over a table sorted by ranges, so that a group of any size is spread over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm._shared import spool, tasks_for


def _totals(group: str, values: list[str], xor: bool) -> Callable:
    gather = np.bitwise_xor.accumulate if xor else np.cumsum
    join = np.bitwise_xor if xor else np.add

    def within(column: np.ndarray, heads: np.ndarray, run: np.ndarray) -> np.ndarray:
        sums = gather(column)
        before = np.concatenate([[0], sums])[heads]
        return sums ^ before[run] if xor else sums - before[run]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        last_group, carry = None, dict.fromkeys(values, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            keys = batch.column(group).to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
            heads, number = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            columns = []
            for v in values:
                sums = within(batch.column(v).to_numpy().astype(np.int64), heads, number)
                if keys[0] == last_group:
                    sums[number == 0] = join(sums[number == 0], carry[v])
                carry[v] = sums[-1]
                columns.append(pa.array(sums))
            last_group = keys[-1]
            tail = pa.array(np.zeros(batch.num_rows, bool))
            held = pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(np.full(batch.num_rows, part, np.int64)), tail], names=[*batch.schema.names, *(f"{v}_total" for v in values), "part", "tail"])
        if held is not None:
            end = np.zeros(held.num_rows, bool)
            end[-1] = True
            yield held.set_column(held.num_columns - 1, "tail", pa.array(end))

    return run


def running_totals(df: DataFrame, group: str, order: list[Column], values: list[str], name: str, keep: list[str] | None = None, xor: bool = False) -> DataFrame:
    """``df`` (all columns, or ``keep``) with NAME_total for each name in ``values`` (longs that are not null).

    That is the sum, or the exclusive or, over the rows of the same ``group`` (a
    long) up to and with this one, by ``order``.  Each partition adds up its own
    rows; a group that goes on in the next partition is carried over in one row
    for each partition, which is all that the driver sees.
    """
    spark = df.sparkSession
    kept = df.columns if keep is None else keep
    dealt = df.repartitionByRange(tasks_for(df), F.col(group), *order).sortWithinPartitions(F.col(group), *order).select(*kept)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema), *(f"{v}_total long" for v in values), "part long", "tail boolean"])
    local = spool(dealt.mapInArrow(_totals(group, values, xor), fields), name)
    carried, before = [], None
    for t in sorted(local.where("tail").select("part", group, *(f"{v}_total" for v in values)).collect()):
        sums = list(t[2:])
        if before is not None:
            carried.append((t[0], *before))
            if before[0] == t[1]:
                sums = [a ^ b if xor else a + b for a, b in zip(sums, before[1:], strict=True)]
        before = (t[1], *sums)
    schema = ", ".join(["part long", f"{group} long", *(f"{v}_carried long" for v in values)])
    joined = local.join(F.broadcast(spark.createDataFrame(carried, schema)), ["part", group], "left")
    pairs = [(v, F.col(f"{v}_total"), F.coalesce(f"{v}_carried", F.lit(0))) for v in values]
    added = [(total.bitwiseXOR(carry) if xor else total + carry).alias(f"{v}_total") for v, total, carry in pairs]
    return joined.select(*kept, *added)
