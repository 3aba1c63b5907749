"""What the operators share: table access, the shared folder, and tables that cut lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from faintline.operators.joins import spread_join
from faintline.sources.storage import discard, keep, new_path, shared_dir, table

__all__ = ["discard", "fresh", "keep", "new_path", "shared_dir", "slices", "spread_join", "table"]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column of df (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of a column, so that work in a task stays bounded."""
    for batch in batches:
        size = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), 1))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
            yield batch.slice(at, stop - at)
            at = stop
