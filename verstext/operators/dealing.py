"""Rows dealt by key as compressed blocks.

Rows of one key that lie together, such as the versions of a document, hold nearly the same text. Before the shuffle
they are put into one zstd block, which keeps that text once; after it the blocks are opened and their rows sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

PACKED_ROWS, PACKED_BYTES = 50_000, 16_000_000
BLOCK_ROWS = 10_000
OPEN_ROWS, OPEN_BYTES = 10_000, 8_000_000
LEVEL = 6  # of zstd


def deal(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows, those of equal ``keys`` in one task, sorted by keys and ``order``, NULL last.

    The first column of ``order`` may not be NULL. A task holds some thousand rows at a time, or
    those of a key that have the same value in the first column of ``order`` if that is more.
    """
    first = order[0]
    schema = rows.schema
    # the layout of the rows is the same in all blocks, so Spark's own compression of the shuffle leaves little of it
    block = StructType([*[schema[k] for k in keys], schema[first], StructField("layout", BinaryType()), StructField("block", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            yield _packed(table, keys, first)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _opened(batches, keys, order)

    packed = rows.mapInArrow(pack, block).repartition(*keys).sortWithinPartitions(*keys, F.col(first))
    return packed.mapInArrow(unpack, schema)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some ten thousand rows, so that few keys are cut in two."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACKED_ROWS or size >= PACKED_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _packed(table: pa.Table, keys: list[str], first: str) -> pa.RecordBatch:
    """One row for each key, or for each ``BLOCK_ROWS`` of its rows, with the least value of ``first`` in it."""
    at = [_codes(table.column(k)) for k in keys]
    values = table.column(first).to_numpy()
    order = np.lexsort((values, *at))
    at = [a[order] for a in at]
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for a in at:
        fresh[1:] |= a[1:] != a[:-1]
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(order))
    cuts = [c for b, e in zip(begins.tolist(), ends.tolist()) for c in range(b, e, BLOCK_ROWS)]
    if (np.diff(order) != 1).any():
        table = table.take(pa.array(order))
    rows = table.combine_chunks().to_batches()[0]
    codec = pa.Codec("zstd", compression_level=LEVEL)
    blocks = [codec.compress(rows.slice(b, e - b).serialize(), asbytes=True) for b, e in zip(cuts, [*cuts[1:], len(order)])]
    heads = rows.select([*keys, first]).take(pa.array(cuts))
    layout = [rows.schema.serialize().to_pybytes()] * len(cuts)
    return pa.RecordBatch.from_arrays([*heads.columns, pa.array(layout, pa.binary()), pa.array(blocks, pa.binary())], [*keys, first, "layout", "block"])


def _opened(batches: Iterator[pa.RecordBatch], keys: list[str], order: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    groups: list[int] = []  # the number of the key of each held table
    rows = size = 0
    last, group = None, 0
    layouts: dict[bytes, pa.Schema] = {}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:-1]]
        for *key, least, layout, block in zip(*columns, batch.columns[-1]):
            group += key != last
            if rows >= OPEN_ROWS or size >= OPEN_BYTES:
                # rows of this key from ``least`` on may still come
                done, rest = _sorted(held, groups, order, group if key == last else None, least)
                yield from done.to_batches()
                held, groups = ([rest], [group]) if rest.num_rows else ([], [])
                rows, size = rest.num_rows, rest.nbytes
            last = key
            if layout not in layouts:
                layouts[layout] = pa.ipc.read_schema(pa.BufferReader(layout))
            opened = pa.CompressedInputStream(pa.BufferReader(block.as_buffer()), "zstd").read()
            table = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(opened), layouts[layout])])
            held.append(table)
            groups.append(group)
            rows, size = rows + table.num_rows, size + table.nbytes
    if held:
        yield from _sorted(held, groups, order, None, None)[0].to_batches()


def _sorted(held: list[pa.Table], groups: list[int], order: list[str], open_group: int | None, least) -> tuple[pa.Table, pa.Table]:
    """The held rows in order: those that are complete, and those of the open key from ``least`` on."""
    table = pa.concat_tables(held).combine_chunks()
    number = np.repeat(groups, [t.num_rows for t in held])
    keyed = table.select(order).append_column("number of the key", pa.array(number))
    spots = pc.sort_indices(keyed, [("number of the key", "ascending"), *[(c, "ascending") for c in order]], null_placement="at_end")
    table = table.take(spots).combine_chunks()
    if open_group is None:
        return table, table.slice(0, 0)
    waits = (number[spots.to_numpy()] == open_group) & (table.column(order[0]).to_numpy() >= least)
    done = table.num_rows - int(waits.sum())
    return table.slice(0, done), table.slice(done).combine_chunks()
