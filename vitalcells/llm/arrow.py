"""Arrow batches in tasks."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Stands for a null doc_id where an order is needed.
LAST = (1 << 63) - 1


def longs(column: pa.Array, null: int = LAST) -> np.ndarray:
    if column.null_count:
        column = column.fill_null(null)
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def record_batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c)
                                       for c in columns], names=names)


def by_key(batches: Iterator[pa.RecordBatch], columns: list[str], weight: Callable | None = None,
           limit: int = 200_000) -> Iterator[dict[str, pa.Array]]:
    """Batches sorted by key, joined so that no key is cut; one is held until its key has ended."""
    held: list[dict] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {c: batch.column(c) for c in columns}
        key = longs(part["key"])
        held.append(part)
        size += batch.num_rows if weight is None else weight(part)
        if size < limit:
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        if key[0] == key[-1] and len(held) > 1 and longs(held[-2]["key"])[-1] == key[0]:
            continue
        if cut == 0 and len(held) == 1:
            continue
        done = [*held[:-1], {c: part[c].slice(0, cut) for c in columns}]
        held = [{c: part[c].slice(cut) for c in columns}]
        size = len(key) - cut if weight is None else weight(held[0])
        yield {c: pa.concat_arrays([d[c] for d in done]) for c in columns}
    if held:
        yield {c: pa.concat_arrays([d[c] for d in held]) for c in columns}
