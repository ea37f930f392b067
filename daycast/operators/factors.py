"""Least squares from mergeable triangular factors.

The rows (1, x1..xp, y) of any set are reduced to the triangular factor of their QR
decomposition. Factors of two sets, stacked and factored again, are the factor of both
sets together, so fits of blocks, prefixes and sliding windows are merges, and a small
solve gives the coefficients.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FACTOR = pa.schema([("n", pa.int64()), ("r", pa.list_(pa.float64()))])
FACTOR_SCHEMA = "n long, r array<double>"


def inputs(cols: list[str]) -> Column:
    """The model inputs of a row as one array (null counts as 0): plans and Arrow batches
    then hold one column, however many inputs there are."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def design(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, y])


def solve(r: np.ndarray, n: int | None = None) -> np.ndarray:
    """[b0, b1..bp] from stacked factors of ``n`` rows.

    Below the first row the factor belongs to the centred columns, so the solution
    is the minimum-norm one of the centred system, the intercept follows. The rank is
    cut as for a solve on the rows themselves.
    """
    p = r.shape[1] - 2
    if len(r) < p + 2:
        r = np.vstack([r, np.zeros((p + 2 - len(r), p + 2))])
    r = triangle(r)
    rcond = np.finfo(float).eps * max(n or 0, p + 1)
    beta, *_ = np.linalg.lstsq(r[1:, 1:p + 1], r[1:, p + 1], rcond=rcond)
    return np.concatenate([[(r[0, p + 1] - r[0, 1:p + 1] @ beta) / r[0, 0]], beta])


def factor(table: pa.Table, width: int, x: str = "x", y: str = "y") -> pa.Table:
    """One row (n, r) for the rows of ``table``."""
    r = triangle(design(matrix(table[x], width), table[y].to_numpy()))
    return pa.Table.from_pydict({"n": [table.num_rows], "r": [r.ravel()]}, FACTOR)


def stacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of all factors of an Arrow list column, of ``width`` inputs."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width + 2)


class SlidingFactor:
    """Factor of a window that grows at one end and shrinks at the other.

    Two stacks: the front holds the rows that will be dropped, with the factors of its
    suffixes (one per ``step`` rows, so a drop costs no more than ``step`` rows merged
    again); the back holds what was pushed, as one factor. ``base`` is the factor of
    rows between the two that are never dropped. When the front runs out, the pushed
    rows become the front.
    """

    def __init__(self, front: np.ndarray, base: np.ndarray | None = None, base_rows: int = 0, step: int = 16):
        self.width, self.step, self.base, self.base_rows = front.shape[1], step, base, base_rows
        self._turn(front)

    def _turn(self, front: np.ndarray) -> None:
        self.front, self.at = front, 0
        empty = np.zeros((0, self.width))
        self.pushed, self.back = [], empty
        held = empty if self.base is None else self.base
        self.suffix = {}                       # first row -> factor of the rows from there on
        edges = list(range(0, len(front), self.step)) + [len(front)]
        self.suffix[len(front)] = held
        for a, b in reversed(list(zip(edges[:-1], edges[1:]))):
            held = triangle(np.vstack([front[a:b], held]))
            self.suffix[a] = held

    def __len__(self) -> int:
        return len(self.front) - self.at + self.base_rows + len(self.pushed)

    def push(self, row: np.ndarray) -> None:
        self.pushed.append(row)
        self.back = np.vstack([self.back, row])
        if len(self.back) > self.width + self.step:
            self.back = triangle(self.back)

    def drop(self) -> None:
        if self.at == len(self.front):
            if self.base_rows or not self.pushed:
                raise IndexError("there is no row to drop")
            self._turn(np.array(self.pushed))
        self.at += 1

    def rows(self) -> np.ndarray:
        """Rows with the same factor as the window."""
        edge = min(-(-self.at // self.step) * self.step, len(self.front))
        return np.vstack([self.front[self.at:edge], self.suffix[edge], self.back])

    def solve(self) -> np.ndarray:
        return solve(self.rows(), len(self))
