"""Places, prefix hashes and running sums down ordered groups, without gathering a group.

Rows are sorted by range of (group, order), so a group of any size is dealt over
as many tasks as it needs.  Each task walks its rows in order and numbers them
from the start of its range; one row a range tells where it begins and ends.
From those the driver works out what the ranges before add to the first group of
each, and a second pass adds it.  All three measures can be carried on so: the
place and the sum by addition, and the prefix hash, a polynomial of the rows'
digests modulo the prime 2^127 - 1, by one multiplication with a power of its base.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm import _common as C

_PRIME = (1 << 127) - 1
_BASE = 0x3C6EF372FE94F82B5BE0CD19137E2179  # fixed value: any odd number below the prime


def running(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` (with x binary and n_bytes) with ``idx`` (from 1), ``path`` (prefix hash over x) and ``total`` (running n_bytes).

    ``order`` must tell the rows of a group apart, or those it doesn't must be
    equal.  Groups are compared as values; null is one of them.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    at, place = C.unused(rows, "_at", "_range")
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    names = sorted_rows.columns
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", idx long, path binary, total long"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, h, total = object(), 0, 0, 0
        for batch in batches:
            ns, hs, totals = [], [], []
            for k, x, b in zip(batch.column(group).to_pylist(), batch.column("x").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True):
                if k != key:
                    key, n, h, total = k, 0, 0, 0
                n, h, total = n + 1, (h * _BASE + int.from_bytes(x)) % _PRIME, total + b
                ns.append(n)
                hs.append(h.to_bytes(16))
                totals.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ns, pa.int64()), pa.array(hs, pa.binary()), pa.array(totals, pa.int64())], [*names, "idx", "path", "total"])

    local = C.materialize(sorted_rows.mapInArrow(walk, out).withColumn(at, F.monotonically_increasing_id()).withColumn(place, F.spark_partition_id()), "walked")
    first = F.min_by(F.struct(group), at).alias("first")
    last = F.max_by(F.struct(group, "idx", "path", "total"), at).alias("last")
    before: dict[int, tuple] = {}  # range -> what its first group had before it
    key, n, h, total = object(), 0, 0, 0
    for r in sorted(local.groupBy(place).agg(first, last).collect(), key=lambda r: r[place]):  # one row a range
        if r.first[group] == key:
            before[r[place]] = (key, n, h, total)
        else:
            n = h = total = 0
        if r.last[group] != r.first[group]:
            n = h = total = 0
        key, n, h, total = r.last[group], n + r.last.idx, (h * pow(_BASE, r.last.idx, _PRIME) + int.from_bytes(r.last.path)) % _PRIME, total + r.last.total

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            places = cols[place].to_pylist()
            if not before.keys().isdisjoint(places):
                ns, hs, totals = cols["idx"].to_pylist(), cols["path"].to_pylist(), cols["total"].to_pylist()
                for i, (p, k) in enumerate(zip(places, cols[group].to_pylist(), strict=True)):
                    if p in before and k == before[p][0]:
                        _, n, h, total = before[p]
                        hs[i] = ((h * pow(_BASE, ns[i], _PRIME) + int.from_bytes(hs[i])) % _PRIME).to_bytes(16)
                        ns[i], totals[i] = ns[i] + n, totals[i] + total
                cols |= {"idx": pa.array(ns, pa.int64()), "path": pa.array(hs, pa.binary()), "total": pa.array(totals, pa.int64())}
            names = [c for c in cols if c not in (at, place)]
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return local.mapInArrow(carry, out) if before else local.drop(at, place)
