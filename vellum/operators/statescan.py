"""State machines over ordered rows, without a document in one group.

What a row does to a machine of a few states is a map from states to states, and such maps compose. Rows are dealt by
(document, chunk of positions); each chunk's maps compose to one, a scan over the chunks' maps (a byte a state) gives the
state in which each chunk begins, and then all chunks run at once. Rows are shuffled once, their keys and symbols once
more. A document of any length spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import Names, cols

#: Positions in a chunk.
CHUNK = 1 << 16


class Machine:
    """States, the first of which is the start, symbols, and what a symbol does in a state: the next state and an output.

    ``step`` is called once for each pair, on the driver; tasks get a table. At most 256 states."""

    def __init__(self, states: Sequence[Hashable], symbols: Sequence[Hashable], step: Callable[[Hashable, Hashable], tuple[Hashable, object]]):
        if len(states) > 256:
            raise ValueError("at most 256 states")
        place = {s: i for i, s in enumerate(states)}
        did = [[step(s, x) for s in states] for x in symbols]
        self.states, self.symbols = list(states), list(symbols)
        self.outputs = [[out for _, out in row] for row in did]
        pad = bytes(256 - len(states))
        self.tables = [bytes(place[s] for s, _ in row) + pad for row in did]

    def output(self, symbol: Column, state: Column, kind: str) -> Column:
        """What a row puts out, by its symbol's number and the state before it; null where ``step`` gives None."""
        flat = F.array(*(F.lit(x) for row in self.outputs for x in row)).cast(f"array<{kind}>")
        return F.element_at(flat, symbol * len(self.states) + state + 1)


def numbered(values: Sequence[tuple[Hashable, Column]], symbols: Sequence[Hashable]) -> Column:
    """Number of the first symbol whose condition holds; the last symbol where none does."""
    out = F.lit(len(symbols) - 1)
    for name, when in reversed(values):
        out = F.when(F.coalesce(when, F.lit(False)), symbols.index(name)).otherwise(out)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple], list[int]]]:
    """Batches with the places where a key begins (the first row's may go on from before) and the keys there."""
    for b in batches:
        if b.num_rows:
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for k in keys:
                c = b.column(k)
                new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
            starts = new.nonzero()[0]
            at = pa.array(starts)
            yield b, list(zip(*(b.column(k).take(at).to_pylist() for k in keys), strict=True)), starts.tolist()


def scanned(df: DataFrame, doc: Names, pos: Names, symbol: Column, machine: Machine, name: str = "state", chunk: Column | None = None) -> DataFrame:
    """``df`` with the number of the state before each row in column ``name``. ``chunk`` (by default the first position
    divided by CHUNK) must not fall along the order. Rows with equal positions come in any order; null documents are one."""
    order, columns = cols(pos), df.columns
    chunk = F.floor(F.col(order[0]) / CHUNK) if chunk is None else chunk
    rows = df.withColumns({"__symbol": symbol.cast("int"), "__doc": F.to_json(F.struct(*cols(doc))), "__chunk": chunk.cast("long")})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    key = ["__doc", "__chunk"]
    same = bytes(range(256))
    tables, n = machine.tables, len(machine.states)

    def made(done: list[tuple], maps: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64()), pa.array(maps, pa.binary())], [*key, "__map"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, same
        for b, keys, starts in _groups(batches, key):
            symbols, done, maps = b.column("__symbol").to_pylist(), [], []
            for of, i, j in zip(keys, starts, [*starts[1:], b.num_rows], strict=True):
                if of != last:
                    if last is not None:
                        done.append(last)
                        maps.append(now[:n])
                    last, now = of, same
                for s in symbols[i:j]:
                    now = now.translate(tables[s])
            if done:
                yield made(done, maps)
        if last is not None:
            yield made([last], [now[:n]])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            out = []
            for of, m in zip(b.column("__doc").to_pylist(), b.column("__map").to_pylist(), strict=True):
                at = at if of == last else 0
                out.append(at)
                last, at = of, m[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int32())], [*key, "__from"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b, keys, starts in _groups(batches, key):
            symbols, begin, out = b.column("__symbol").to_pylist(), b.column("__from").to_pylist(), []
            for of, i, j in zip(keys, starts, [*starts[1:], b.num_rows], strict=True):
                if of != last:
                    last, at = of, begin[i]
                for s in symbols[i:j]:
                    out.append(at)
                    at = tables[s][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.int32())], [*columns, name])

    narrow = rows.select(*key, *order, "__symbol").repartition(*key).sortWithinPartitions(*key, *order)
    maps = narrow.mapInArrow(folded, "__doc string, __chunk long, __map binary")
    starts = maps.repartition("__doc").sortWithinPartitions(*key).mapInArrow(begun, "__doc string, __chunk long, __from int")
    joined = rows.repartition(*key).join(starts, key).sortWithinPartitions(*key, *order)
    return joined.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", `{name}` int")


def without_jumps(df: DataFrame, doc: Names, pos: Names, level: Column, most: int = 9, name: str = "repaired", chunk: Column | None = None) -> DataFrame:
    """Heading levels (1 to ``most``, null for other rows) without jumps: a level goes down to one below the last repaired
    one. The state is that level."""
    machine = Machine(range(most + 1), [None, *range(1, most + 1)], lambda last, n: (last, None) if n is None else (min(n, last + 1),) * 2)
    number = F.coalesce(level, F.lit(0)).cast("int")
    return scanned(df, doc, pos, number, machine, "__state", chunk).withColumn(name, machine.output(number, F.col("__state"), "int")).drop("__state")
