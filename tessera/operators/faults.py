"""Faults of single pages: told in rows of their own, so that one bad page never ends a job.

Every kernel that sees whole pages yields good rows and, for a page that it can't handle, one row with page_id, the stage
and what went wrong. Rows are split once, after the stage's table is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.sources.store import dealt

#: Characters of a message that are kept: of a fault deep in a page's text the rest says nothing more.
MOST = 500
#: Stands for a page_id that is null.
NO_PAGE = -(1 << 63)


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:MOST]


def guarded(build: Callable[[pa.Table], pa.Table], schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """build for applyInArrow by page_id, with a column error: null, or in a page's only row what build threw. schema: of what build gives."""

    def run(page: pa.Table) -> pa.Table:
        try:
            good = build(page).cast(schema)
            return good.append_column("error", pa.nulls(good.num_rows, pa.string()))
        except Exception as e:  # whatever it is, it is that page's alone
            row = [pa.array([page["page_id"][0].as_py()], schema.field("page_id").type) if f.name == "page_id" else pa.nulls(1, f.type) for f in schema]
            return pa.Table.from_arrays([*row, pa.array([told(e)], pa.string())], names=[*schema.names, "error"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, list], list[int]]]:
    """Rows that are sorted by page_id: columns of many whole pages at once, and where each page starts, with the end."""
    held: list[pa.RecordBatch] = []

    def given() -> tuple[dict[str, list], list[int]]:
        table = pa.Table.from_batches(held)
        ids = table["page_id"].combine_chunks().fill_null(NO_PAGE).to_numpy()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist()
        return {c: table[c].to_pylist() for c in table.column_names}, [*starts, len(ids)]

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("page_id").fill_null(NO_PAGE).to_numpy()
        before = held[-1].column("page_id").slice(held[-1].num_rows - 1).fill_null(NO_PAGE)[0].as_py() if held else ids[0]
        changes = np.flatnonzero(np.append(ids[0] != before, ids[1:] != ids[:-1]))
        if len(changes):
            last = int(changes[-1])
            held.append(batch.slice(0, last))
            yield given()
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield given()


def by_pages(rows: DataFrame, build: Callable[[dict[str, list]], tuple[list, ...]], schema: pa.Schema, ddl: str) -> DataFrame:
    """build on each page's columns (in the order of node_id), which gives the columns of schema behind page_id; with the column error, as guarded() has it.

    Pages stream through a task many at a time: a group of its own for each would cost far more than the work on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in whole_groups(batches):
            out: list[list] = [[] for _ in range(len(schema) + 1)]
            for a, b in zip(starts, starts[1:], strict=False):
                try:
                    made = build({k: v[a:b] for k, v in columns.items()})
                    n = len(made[0])
                    good = (*made, [None] * n)
                except Exception as e:  # whatever it is, it is that page's alone
                    n, good = 1, (*([None] for _ in range(len(schema) - 1)), [told(e)])
                out[0] += columns["page_id"][a : a + 1] * n
                for whole, own in zip(out[1:], good, strict=True):
                    whole += own
            yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(out, schema, strict=False)), pa.array(out[-1], pa.string())], [*schema.names, "error"])

    return dealt(rows).sortWithinPartitions("page_id", "node_id").mapInArrow(run, f"{ddl}, error string")
