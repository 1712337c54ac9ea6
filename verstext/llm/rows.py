"""Row-wise work in Python that leaves the key column as Arrow delivers it, NULLs and large values included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

PIECE_ROWS = 512
KEPT_OBJECTS = 4
_KEPT: dict[str, object] = {}


def once_per_worker(name: str, make: Callable[[], object]) -> object:
    """An index or vocabulary that a Python worker makes for its first task and keeps for the next ones.

    At most ``KEPT_OBJECTS`` are kept; the oldest goes first.
    """
    if name not in _KEPT:
        while len(_KEPT) >= KEPT_OBJECTS:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[name] = make()
    return _KEPT[name]


def map_keyed(rows: DataFrame, start: Callable[[], Callable], fields: str) -> DataFrame:
    """The key column (the first) and ``fields``, made from the other columns.

    ``start`` is called once for each task and returns a function that takes the columns after the
    key as lists, for up to 512 rows, and returns ``(picked, columns)``: the new columns, and for each new row the
    position of its input row, or None if there is one new row for each input row in the same order.
    """
    made = StructType.fromDDL(fields)
    types = [to_arrow_type(f.dataType) for f in made.fields]
    names = [rows.columns[0], *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                picked, columns = work(*(piece.column(i).to_pylist() for i in range(1, piece.num_columns)))
                key = piece.column(0) if picked is None else piece.column(0).take(pa.array(picked, pa.int64()))
                yield pa.RecordBatch.from_arrays([key, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return rows.mapInArrow(run, StructType([rows.schema.fields[0], *made.fields]))


def keep_rows(rows: DataFrame, start: Callable[[], Callable], text: str = "text") -> DataFrame:
    """The rows that stay, all columns as they are: each row is judged by its own text.

    ``start`` is called once for each task and returns a function that takes up to 512 texts (NULL
    as empty) and says for each one if its row stays.
    """
    column = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays = start()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(at, PIECE_ROWS)
                yield piece.filter(pa.array(stays([t or "" for t in piece.column(column).to_pylist()]), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
