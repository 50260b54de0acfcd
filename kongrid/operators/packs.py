"""Cells travel packed: one row holds all cells of a grid that lie in one Arrow batch.

A batch is cut into runs of cells that follow each other along a line; a run is its place and its length, and the values lie
behind each other as bytes. So a shuffle sorts and moves a few rows for a grid instead of one row per cell, whatever cells are
missing or repeated. In a group the cells are plain arrays again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from kongrid.operators.cut import cut, narrow_rows

# Values that lie as bytes, by their type in Spark: in Arrow and in NumPy.
KINDS = {
    T.DoubleType(): (pa.float64(), np.float64), T.FloatType(): (pa.float32(), np.float32), T.LongType(): (pa.int64(), np.int64), T.IntegerType(): (pa.int32(), np.int32),
    T.ShortType(): (pa.int16(), np.int16), T.ByteType(): (pa.int8(), np.int8), T.BooleanType(): (pa.bool_(), np.bool_),
}
WHOLE = (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType())


def packable(grid: DataFrame, vals: list[str]) -> bool:
    """Whether places are whole numbers and values have a type of fixed width."""
    return all(grid.schema[c].dataType in WHOLE for c in "yx") and all(grid.schema[v].dataType in KINDS for v in vals)


def _bytes(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary column whose rows start at `first`; the last entry is the end."""
    data = np.ascontiguousarray(data)
    at = (first * data.itemsize * (data.size // max(1, len(data)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(at), pa.py_buffer(data.data if data.size else b"")])


def _tiles(v: np.ndarray, size: int, below: int, above: int, first: bool) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """(cells, their tile): the tile of each cell, the one before it for the first `below` cells of a tile (of tile 0 only with
    `first`) and the one behind it for the last `above`."""
    own = v // size
    out = [(slice(None), own)]
    if below or above:
        at = v - own * size
        for where, by in (((at < below) & (first | (own != 0)), -1), (at >= size - above, 1)):
            k = np.flatnonzero(where)
            out.append((k, own[k] + by))
    return out


def runs(grid: DataFrame, keys: list[str], vals: list[str], tile: int | None = None, reach: int | tuple = 0) -> DataFrame:
    """(keys, _ty, _tx, _runs, two binary columns per value): the packed cells of `grid`. With `tile` they are dealt to tiles of
    that side that need them (`reach`, or what `_tiles` takes), else all go to one. Cells without a place have none."""
    below, above, zero = (reach, reach, False) if isinstance(reach, int) else reach
    grid = grid.select(*keys, "y", "x", *vals)
    schema = T.StructType([
        *[grid.schema[k] for k in keys], T.StructField("_ty", T.IntegerType()), T.StructField("_tx", T.IntegerType()), T.StructField("_runs", T.BinaryType()),
        *[T.StructField(f"_{n}{i}", T.BinaryType()) for i in range(len(vals)) for n in "vk"],
    ])
    kinds = [KINDS[grid.schema[v].dataType] for v in vals]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [pc.is_valid(batch.column(c)) for c in ("y", "x")]
            batch = batch if all(h.true_count == batch.num_rows for h in have) else batch.filter(pc.and_(*have))
            if not batch.num_rows:
                continue
            y, x = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "x"))
            take, ty, tx = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
            if tile is not None and (min(y.min(), x.min()) < 0 or max(y.max(), x.max()) >= tile - above or zero):
                parts = []
                for a, t in _tiles(y, tile, below, above, zero):
                    a = take[a]
                    parts += [(a[b], t[b], u) for b, u in _tiles(x[a], tile, below, above, zero)]
                take, ty, tx = (np.concatenate(p) for p in zip(*parts))
            code = np.zeros(len(y), np.int64)
            for k in keys:
                names_ = batch.column(k).dictionary_encode(null_encoding="encode")
                code = code * len(names_.dictionary) + names_.indices.to_numpy(zero_copy_only=False)
            code = code[take]
            for t in (ty, tx):
                if t.any():
                    code = code * (int(t.max() - t.min()) + 1) + t - t.min()
            if (np.diff(code) < 0).any():
                order = np.argsort(code, kind="stable")
                code, take, ty, tx = code[order], take[order], ty[order], tx[order]
            y, x = y[take], x[take]
            new = np.append(True, code[1:] != code[:-1])
            first = np.flatnonzero(new)
            begin = np.flatnonzero(new | np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)))
            places = np.stack([y[begin], x[begin], np.diff(np.append(begin, len(y)))], 1)
            one = pa.array(take[first])
            out = [batch.column(k).take(one) for k in keys] + [pa.array(t[first].astype(np.int32)) for t in (ty, tx)]
            ends = np.append(first, len(y))
            out.append(_bytes(places, np.searchsorted(begin, ends)))
            moved = None if np.array_equal(take, np.arange(batch.num_rows)) else take
            for v, (arrow, kind) in zip(vals, kinds):
                c = batch.column(v)
                known = c.null_count == 0
                value = c if known else c.fill_null(False if arrow == pa.bool_() else float("nan") if pa.types.is_floating(arrow) else 0)
                value = value.to_numpy(zero_copy_only=False).astype(kind, copy=False)
                out.append(_bytes(value if moved is None else value[moved], ends))
                valid = np.zeros(0, np.bool_) if known else np.asarray(pc.is_valid(c))[take]
                out.append(_bytes(valid, np.zeros(len(ends), np.int64) if known else ends))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return grid.mapInArrow(run, schema)


def _joined(c: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    c = c.combine_chunks()
    if not len(c):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    if at[-1] == at[0]:
        return np.zeros(0, kind), np.zeros(len(c), np.int64)
    return np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


def cells_of(table: pa.Table, kinds: list) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places y, x and (values, which are not null) of the packed rows of one group; in order of lines if it is a full rectangle."""
    places, _ = _joined(table["_runs"], np.int64)
    y, x, n = places.reshape(-1, 3).T
    begin = np.cumsum(n) - n
    x = np.repeat(x - begin, n) + np.arange(int(n.sum()))
    y = np.repeat(y, n)
    columns = []
    for i, kind in enumerate(kinds):
        value, rows = _joined(table[f"_v{i}"], kind)
        valid, told = _joined(table[f"_k{i}"], np.bool_)
        if not told.any():
            valid = np.ones(len(value), bool)
        elif (told != rows).any():  # rows of batches without a null tell nothing
            some, valid = valid, np.ones(len(value), bool)
            valid[np.repeat(told > 0, rows)] = some
        columns.append((value, valid))
    order = row_major(y, x)
    if order is not None:
        y, x, columns = y[order], x[order], [(v[order], k[order]) for v, k in columns]
    return y, x, columns


def row_major(y: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """The order of cells along lines, line after line, if they are a full rectangle without repeats; else nothing."""
    if not len(y):
        return None
    y0, x0 = int(y.min()), int(x.min())
    h, w = int(y.max()) - y0 + 1, int(x.max()) - x0 + 1
    if h * w != len(y):
        return None
    place = np.full(len(y), -1)
    place[(y - y0) * w + x - x0] = np.arange(len(y))
    return place if (place >= 0).all() else None


def places_of(y: np.ndarray, x: np.ndarray) -> bytes:
    """`_runs` of the cells of one grid."""
    begin = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)))
    return np.ascontiguousarray(np.stack([y[begin], x[begin], np.diff(np.append(begin, len(y)))], 1), np.int64).tobytes()


def places(runs_: bytes) -> np.ndarray:
    """Rows (y, x, number of cells) of `_runs`."""
    return np.frombuffer(runs_, np.int64).reshape(-1, 3)


PACKED = [T.StructField(c, T.BinaryType()) for c in ("_runs", "_v0", "_k0")]


def row_of(key: pa.Table, keys: list[str], y: np.ndarray, x: np.ndarray, value: np.ndarray, known: np.ndarray) -> pa.Table:
    """A grid of one value as one packed row."""
    valid = b"" if known.all() else known.tobytes()
    return pa.table({k: key[k] for k in keys} | {"_runs": [places_of(y, x)], "_v0": [value.astype(np.float64).tobytes()], "_k0": [valid]}).cast(_row_schema(key, keys))


def _row_schema(key: pa.Table, keys: list[str]) -> pa.Schema:
    return pa.schema([*[key.schema.field(k) for k in keys], *[pa.field(f.name, pa.binary()) for f in PACKED]])


def opened(packed: DataFrame, keys: list[str], y: T.DataType, x: T.DataType, v: str = "v") -> DataFrame:
    """The cells of grids of one packed row each; `_packed` of the result is what it was made of."""
    schema = T.StructType([*[packed.schema[k] for k in keys], T.StructField("y", y), T.StructField("x", x), T.StructField(v, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                py, px, ((value, known),) = cells_of(row, [np.float64])
                out = repeated(row, keys, len(py)) | {"y": pa.array(py), "x": pa.array(px), v: pa.array(value) if known.all() else pa.array(value, mask=~known)}
                yield from pa.table({c: out[c] for c in arrow.names}).cast(arrow).to_batches()

    cells = packed.select(*keys, *[f.name for f in PACKED]).mapInArrow(run, schema)
    cells._packed = packed
    return cells


def merged(y: np.ndarray, x: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list]:
    """Cells of which several lie at a place become one: the sum of what is known over the number of cells."""
    columns = [(v.astype(np.float64), k) for v, k in columns]
    if row_major(y, x) is not None:
        return y, x, columns
    place, at, n = np.unique(np.stack([y, x], 1), axis=0, return_inverse=True, return_counts=True)
    at = at.reshape(-1)
    out = [(np.bincount(at, np.where(k, v, 0.0), len(place)) / n, np.bincount(at, k, len(place)) > 0) for v, k in columns]
    return place[:, 0], place[:, 1], out


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def per_grid(grid: DataFrame, keys: list[str], vals: list[str], run: Callable, schema, beside: DataFrame | None = None, tile: int | None = None, reach: int | tuple = 0) -> DataFrame:
    """`run` of every grid (every tile of it, with `tile`) on its packed cells: run(key, y, x, cells) with a table of one row for the
    keys and tile, and cells (values, which are not null) by name. With `beside` (rows by the same keys) every grid that has
    such rows, with cells or without, runs as run(key, y, x, cells, rows); other grids have no result."""
    packed = runs(grid, keys, vals, tile, reach)
    with narrow_rows(packed):
        packed = cut(packed)
    kinds = [KINDS[grid.schema[v].dataType][1] for v in vals]
    by = keys if tile is None else [*keys, "_ty", "_tx"]
    # packed rows are few and small, yet what is done with them isn't: as many tasks as asked for, never fewer
    packed = packed.repartition(tasks_of(grid), *by)

    def arrays(table: pa.Table):
        y, x, columns = cells_of(table, kinds)
        return y, x, dict(zip(vals, columns))

    if beside is None:
        return packed.groupBy(*by).applyInArrow(lambda table: run(table.select([*keys, "_ty", "_tx"]).slice(0, 1), *arrays(table)), schema)
    none = to_arrow_schema(schema).empty_table()

    def both(rows: pa.Table, table: pa.Table) -> pa.Table:
        return run(rows.select(keys).slice(0, 1), *arrays(table), rows) if rows.num_rows else none

    return beside.repartition(tasks_of(grid), *by).groupBy(*by).cogroup(packed.groupBy(*by)).applyInArrow(both, schema)


def repeated(key: pa.Table, names: list[str], n: int) -> dict[str, pa.Array]:
    """The columns `names` of a table of one row, `n` times."""
    at = pa.array(np.zeros(n, np.int64))
    return {k: key[k].combine_chunks().take(at) for k in names}
