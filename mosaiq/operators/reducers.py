"""Block reductions by reducers of the caller's own, with partial states before the shuffle.

A reducer's states are rows of a whole-number matrix. Each batch of cells is reduced to one state a block
where it lies, states are dealt by block, and runs of equal blocks are merged as they stream by; only
the last block of a batch waits for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.grid import whole_div


class Reducer:
    """What to override: ``width``, ``update``, ``finish``, and ``merge`` where states do not add up."""

    #: Numbers of a state.
    width = 1

    def init(self, n: int):
        """States of ``n`` blocks without cells."""
        import numpy as np

        return np.zeros((n, self.width), np.int64)

    def update(self, states, block, values) -> None:
        """Takes values in; ``block`` names the row of each."""
        raise NotImplementedError

    def merge(self, states, starts):
        """One state for each run of states, which begin at ``starts``."""
        import numpy as np

        return np.add.reduceat(states, starts, axis=0)

    def finish(self, states):
        """One whole number a state."""
        raise NotImplementedError


class Median(Reducer):
    """The lower median of unsigned bytes, by their histogram."""

    width = 256

    def update(self, states, block, values) -> None:
        import numpy as np

        np.add.at(states, (block, values), 1)

    def finish(self, states):
        import numpy as np

        sums = np.cumsum(states, axis=1)
        return (sums < (sums[:, -1:] + 1) // 2).sum(axis=1)


class Spread(Reducer):
    """The largest value less the smallest one."""

    width = 2

    def init(self, n: int):
        import numpy as np

        return np.tile(np.array([[-(1 << 62), -(1 << 62)]]), (n, 1))

    def update(self, states, block, values) -> None:
        import numpy as np

        np.maximum.at(states[:, 0], block, values)
        np.maximum.at(states[:, 1], block, -values)

    def merge(self, states, starts):
        import numpy as np

        return np.maximum.reduceat(states, starts, axis=0)

    def finish(self, states):
        return states[:, 0] + states[:, 1]


def block_reduce_custom(cells: DataFrame, block_h: int, block_w: int, reducer: Reducer) -> DataFrame:
    """(y, x[, c], v) of each block of cells (y, x[, c], v); blocks without cells give no row."""
    keys = ["y", "x", *(["c"] if "c" in cells.columns else [])]
    kind = ", ".join(f"{k} bigint" for k in keys)

    def runs(columns):
        import numpy as np

        order = np.lexsort(columns[::-1])
        at = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([c[1:] != c[:-1] for c in at], axis=0)
        return order, at, np.flatnonzero(new), np.cumsum(new) - 1

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            order, at, starts, block = runs([batch[k].to_numpy() for k in keys])
            states = reducer.init(len(starts))
            reducer.update(states, block, batch["v"].to_numpy()[order])
            yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in at], pa.array([s.tobytes() for s in np.ascontiguousarray(states, np.int64)], pa.binary())], [*keys, "state"])

    def final(batches):
        import numpy as np
        import pyarrow as pa

        def row(columns, states):
            return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(np.asarray(reducer.finish(states), np.int64))], [*keys, "v"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch[k].to_numpy() for k in keys]
            states = np.frombuffer(b"".join(batch["state"].to_pylist()), np.int64).reshape(batch.num_rows, reducer.width)
            if held:
                columns, states = [np.concatenate(p) for p in zip(held[0], columns, strict=True)], np.concatenate((held[1], states))
            order, at, starts, _ = runs(columns)
            merged = reducer.merge(states[order], starts)
            firsts = [c[starts] for c in at]
            if len(starts) > 1:
                yield row([c[:-1] for c in firsts], merged[:-1])
            held = [c[-1:] for c in firsts], merged[-1:]
        if held:
            yield row(*held)

    named = cells.select(whole_div(F.col("y"), block_h).alias("y"), whole_div(F.col("x"), block_w).alias("x"), *[F.col(k).cast("bigint") for k in keys[2:]], F.col("v").cast("bigint"))
    states = named.mapInArrow(partial, f"{kind}, state binary").repartition(*keys).sortWithinPartitions(*keys)
    return states.mapInArrow(final, f"{kind}, v bigint")
