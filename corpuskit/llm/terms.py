"""Frequency of every distinct term by external sort and run-length scan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_RUN_SCHEMA = "term string, kind int, occurrences bigint, records bigint, first string, last string, part int"
_RUN_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (term, kind, record, part) rows to one row per run of (term, kind).

    A run has its occurrences, its distinct records, and the first and last of these. It
    may go on over any number of batches; only its last row is kept between them.
    """
    names = [x.split()[0] for x in _RUN_SCHEMA.split(", ")]
    open_run: list | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term, kind, record, part = (batch.column(i) for i in range(4))

        def differs(a: pa.Array) -> np.ndarray:
            out = np.ones(n, bool)
            out[1:] = pc.fill_null(pc.not_equal(a[1:], a[:-1]), True).to_numpy(zero_copy_only=False)
            return out

        new_run = differs(term) | differs(kind)
        new_record = new_run | differs(record)
        joins = open_run is not None and [term[0].as_py(), kind[0].as_py()] == open_run[:2]
        if joins:
            new_record[0] = record[0].as_py() != open_run[5]
        new_record &= pc.is_valid(record).to_numpy(zero_copy_only=False)
        edges = np.append(np.flatnonzero(new_run), n)
        counts, records = np.diff(edges), np.add.reduceat(new_record.astype(np.int64), edges[:-1])
        starts, ends = pa.array(edges[:-1]), pa.array(edges[1:] - 1)
        runs = [list(x) for x in zip(*(c.to_pylist() for c in (term.take(starts), kind.take(starts))), counts.tolist(), records.tolist(), *(c.to_pylist() for c in (record.take(starts), record.take(ends), part.take(starts))))]
        if joins:
            first = runs[0]
            runs[0] = [*open_run[:2], open_run[2] + first[2], open_run[3] + first[3], open_run[4], first[5], open_run[6]]
        elif open_run is not None:
            runs.insert(0, open_run)
        open_run = runs.pop()
        if runs:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*runs), _RUN_TYPES)], names)
    if open_run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(open_run, _RUN_TYPES)], names)


def term_frequencies(df: DataFrame, term: str, records: Mapping[str, str]) -> DataFrame:
    """Per term: ``occurrences`` (rows) and, for each entry ``name: column`` of ``records``, distinct non-null values.

    The (term, kind, record) rows are range-partitioned and sorted with a row number as last
    resort, so neither a term that owns a third of all rows nor a pair that is repeated as often
    lies in one partition. Each partition is scanned once; a term at the border of partitions
    gives one partial row in each. Their counts add up, less one record wherever a
    partition begins with the record with which the one before ends; a term has at most
    one such row a partition.

    Rows with a null term count for nothing. A null record adds an occurrence but no record.
    An empty table gives no rows. Terms are compared as strings, exactly.
    """
    names = list(records)
    kinds = [F.struct(F.lit(i).alias("kind"), F.col(records[name]).cast("string").alias("record")) for i, name in enumerate(names)]
    known = df.where(F.col(term).isNotNull()).select(F.col(term).cast("string").alias("term"), F.array(*kinds).alias("p"), F.pmod(F.monotonically_increasing_id(), F.lit(8192)).cast("int").alias("salt"))
    pairs = known.select("term", F.explode("p").alias("p"), "salt").select("term", "p.kind", "p.record", "salt")
    order = ["term", "kind", "record", "salt"]
    runs = pairs.repartitionByRange(*order).sortWithinPartitions(*order).select("term", "kind", "record", F.spark_partition_id().alias("part")).mapInArrow(_scan_runs, _RUN_SCHEMA)
    before = F.lag("last").over(Window.partitionBy("term", "kind").orderBy("part"))
    runs = runs.withColumn("records", F.col("records") - F.coalesce((F.col("first") == before).cast("int"), F.lit(0)))
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == i, F.col("records"))), F.lit(0)).alias(name) for i, name in enumerate(names)]
    return runs.groupBy("term").agg(F.sum(F.when(F.col("kind") == 0, F.col("occurrences"))).alias("occurrences"), *counts)


def mark_terms(frequencies: DataFrame, rare: tuple[str, int], common: tuple[str, int, float]) -> DataFrame:
    """Add ``is_rare`` (column below a count) and ``is_common`` (column above a share of a total).

    ``common`` is (column, total, share); with a total of 0 nothing is common.
    """
    (rare_column, least), (common_column, total, share) = rare, common
    return frequencies.withColumn("is_rare", F.col(rare_column) < least).withColumn("is_common", F.col(common_column) > F.lit(share) * F.lit(total))
