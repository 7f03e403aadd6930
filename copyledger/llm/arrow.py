"""Arrow pieces of counting jobs: blocks of bounded size and merged partial counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text that one step of a task works on at a time, in bytes.
BLOCK_BYTES = 8_000_000
# Rows of partial counts that a task holds before it gives them out, and those given out at a time.
HELD_ROWS = 1_000_000
OUT_ROWS = 50_000


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most ``limit`` bytes in ``column``, whose nulls count
    as empty; a longer value makes a block of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def totals(table: pa.Table, keys: Sequence[str], sums: Sequence[str]) -> pa.Table:
    """Sums of ``sums`` for every value of ``keys``, columns named as before. Keys that
    are dictionary-encoded are grouped by their numbers and stay so."""
    table = table.unify_dictionaries()
    values = {}
    for k in keys:
        if pa.types.is_dictionary(table[k].type) and table[k].num_chunks:
            values[k] = table[k].chunk(0).dictionary
            numbers = pa.chunked_array([c.indices for c in table[k].chunks])
            table = table.set_column(table.schema.get_field_index(k), k, numbers)
    summed = table.group_by(list(keys), use_threads=False).aggregate([(c, "sum") for c in sums])
    summed = summed.select([*keys, *[f"{c}_sum" for c in sums]]).rename_columns([*keys, *sums])
    for k, dictionary in values.items():
        coded = pa.DictionaryArray.from_arrays(summed[k].combine_chunks(), dictionary)
        summed = summed.set_column(summed.schema.get_field_index(k), k, coded)
    return summed


def _plain(table: pa.Table) -> pa.Table:
    """``table`` with dictionary-encoded columns written out."""
    for i, column in enumerate(table.columns):
        if pa.types.is_dictionary(column.type):
            table = table.set_column(i, table.column_names[i], pc.cast(column, column.type.value_type))
    return table


class Partials:
    """Partial counts of one task. Tables are added and merged by hash; once merging
    leaves more than ``held`` rows they are given out, to be summed by Spark. Keys that
    are dictionary-encoded are held as numbers and given out as plain values."""

    def __init__(self, keys: Sequence[str], sums: Sequence[str], held: int = HELD_ROWS):
        self.keys, self.sums, self.held = keys, sums, held
        self.tables: list[pa.Table] = []
        self.rows = 0

    def _taken(self) -> pa.Table:
        """All held rows, which are held no longer: merging need not keep them twice."""
        tables, self.tables = self.tables, []
        return pa.concat_tables(tables)

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.tables.append(table)
        self.rows += table.num_rows
        if self.rows > self.held:
            merged = totals(self._taken(), self.keys, self.sums)
            self.tables, self.rows = [merged], merged.num_rows
            if self.rows > self.held // 2:
                yield from self.finish()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            merged = totals(self._taken(), self.keys, self.sums) if len(self.tables) > 1 else self._taken()
            self.rows = 0
            for start in range(0, merged.num_rows, OUT_ROWS):
                yield from _plain(merged.slice(start, OUT_ROWS)).to_batches()
