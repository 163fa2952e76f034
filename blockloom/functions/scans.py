"""Running computations along the elements of arrays, for many rows at a time.

A document whose tokens are an array keeps them in order in its own row, so what depends on the tokens before needs no sort and
no shuffle. The steps are the few that column functions lack: sums, pairs of brackets, numbers within groups. Null arrays give empty ones.
What a lambda looks up by position should come from here or from a table: the optimizer puts other arrays' expressions into the lambda, to be computed for each element.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTS = T.ArrayType(T.IntegerType())
RANKS, TOTALS = (T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in names])) for names in (("group", "no"), ("step", "total")))
PAIRS = T.ArrayType(T.StructType([T.StructField(name, T.IntegerType()) for name in ("partner", "around", "depth")]))
#: Elements that are worked on at once, unless a row has more: numbers of all of them are held several times over.
SLICE = 100_000


def _laid(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the rows with a leading 0, and for every element its row and where its row starts."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ends, np.repeat(np.arange(len(lengths)), lengths), np.repeat(ends[:-1], lengths)


def slices(lists: pa.ListArray, most: int | None = None) -> list[tuple[int, int]]:
    """First row and number of rows of stretches with no more elements than most (SLICE), or of one row; at least one stretch."""
    ends = _laid(lists)[0]
    cuts = [0]
    while cuts[-1] < len(lists):
        last = int(np.searchsorted(ends, ends[cuts[-1]] + (most or SLICE), side="right")) - 1
        cuts.append(min(max(last, cuts[-1] + 1), len(lists)))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)] or [(0, 0)]


def _sliced(scan: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    @wraps(scan)
    def run(*lists: pa.ListArray) -> pa.Array:
        return pa.concat_arrays([scan(*(x.slice(*part) for x in lists)) for part in slices(lists[0])])

    return run


def _flags(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(lists.flatten(), False).to_numpy(zero_copy_only=False).astype(bool)


def _numbers(lists: pa.ListArray, missing: int) -> np.ndarray:
    return pc.fill_null(lists.flatten(), missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _sums(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums up to each element, from the start of its row."""
    total = np.concatenate([[0], np.cumsum(steps)])
    return total[1:] - total[start]


@F.arrow_udf(TOTALS)
@_sliced
def _totals(steps: pa.Array) -> pa.Array:
    ends, _, start = _laid(steps)
    return _listed(ends, pa.StructArray.from_arrays([steps.flatten(), pa.array(_sums(_numbers(steps, 0), start), pa.int32())], names=["step", "total"]))


class Laid:
    """Elements of rows one after another, and what windows by row compute of them, for many rows at a time.

    row: the row of each element, rising. A place is an index into all elements; -1 stands for none.
    """

    def __init__(self, row: np.ndarray) -> None:
        self.row, self.index = row, np.arange(len(row))
        self.new = np.ones(len(row), bool)
        self.new[1:] = row[1:] != row[:-1]
        self.first = self.upto(self.new)

    @staticmethod
    def upto(flags: np.ndarray) -> np.ndarray:
        """The place of the last flagged element up to each, of any row."""
        return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), -1))

    def sums(self, steps: np.ndarray) -> np.ndarray:
        """Sums up to each element of its row."""
        return _sums(steps, self.first)

    def place(self, by: int) -> np.ndarray:
        """Places of the elements that many after each (before, if by is negative), in the same row."""
        at = np.clip(self.index + by, 0, max(len(self.row) - 1, 0))
        return np.where((at == self.index + by) & (self.row[at] == self.row), at, -1)

    def last(self, flags: np.ndarray) -> np.ndarray:
        """Places of the last flagged element up to each, in the same row."""
        at = self.upto(flags)
        return np.where(at >= self.first, at, -1)

    def grouped(self, groups: np.ndarray, walk: Callable[[Laid, np.ndarray], np.ndarray]) -> np.ndarray:
        """What walk gives for the elements of each row and group in order; it gets them laid by group, and their places."""
        key = self.row * (int(groups.max(initial=0)) + 1) + groups
        at = np.argsort(key, kind="stable")
        out = walk(Laid(key[at]), at)
        back = np.empty_like(out)
        back[at] = out
        return back

    def pairs(self, opens: np.ndarray, closes: np.ndarray, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Partners (places) and depths of brackets, as in pairs()."""
        n = len(self.row)
        net = self.sums(opens.astype(np.int64) - closes)
        apart = self.row * (2 * n + 2)  # rows lie so far apart that one's minimum is never another's
        reach = net - np.minimum(np.minimum.accumulate(net - apart) + apart, 0)
        before = picked(reach, self.place(-1), 0)
        level = np.where(opens, reach, np.where(closes & (before > 0), before, 0))
        at = np.flatnonzero(level > 0)
        at = at[np.argsort(self.row[at] * (n + 1) + level[at], kind="stable")]
        a, b = at[:-1], at[1:]
        fits = (self.row[a] == self.row[b]) & (level[a] == level[b]) & opens[a] & ~opens[b]
        if names is not None:
            fits &= names[a] == names[b]
        partner = np.full(n, -1)
        partner[a[fits]], partner[b[fits]] = b[fits], a[fits]
        return partner, self.sums(np.where(partner < 0, 0, np.where(opens, 1, -1)))

    def around(self, opens: np.ndarray, partner: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Places of the opens of the innermost pairs that elements lie in, not their own."""
        n, first = len(self.row), opens & (partner >= 0)
        outside = depth - first
        place = lambda which, depths: (self.row[which] * (n + 1) + depths) * (n + 1) + which
        owners = np.flatnonzero(first)
        owners = owners[np.argsort(place(owners, depth[owners]), kind="stable")]
        inner = np.flatnonzero(outside > 0)
        around = np.full(n, -1)
        if len(inner):
            around[inner] = owners[np.searchsorted(place(owners, depth[owners]), place(inner, outside[inner])) - 1]
        return around


def picked(values: np.ndarray, places: np.ndarray, missing: object) -> np.ndarray:
    """The values at the places, missing where there is none."""
    return np.where(places >= 0, values[places], missing) if len(values) else np.full(len(places), missing)


def _paired(opens: pa.Array, closes: pa.Array, same: pa.Array | None) -> pa.Array:
    ends, row, start = _laid(opens)
    laid, o, c = Laid(row), _flags(opens), _flags(closes)
    names = None if same is None else pc.fill_null(same.flatten().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    partner, depth = laid.pairs(o, c, names)
    number = lambda x: pa.array(x - start, pa.int32(), mask=x < 0)
    return _listed(ends, pa.StructArray.from_arrays([number(partner), number(laid.around(o, partner, depth)), pa.array(depth, pa.int32())], names=["partner", "around", "depth"]))


@F.arrow_udf(PAIRS)
@_sliced
def _pairs(opens: pa.Array, closes: pa.Array) -> pa.Array:
    return _paired(opens, closes, None)


@F.arrow_udf(PAIRS)
@_sliced
def _named_pairs(opens: pa.Array, closes: pa.Array, same: pa.Array) -> pa.Array:
    return _paired(opens, closes, same)


@F.arrow_udf(INTS)
@_sliced
def _inside(opens: pa.Array, partners: pa.Array) -> pa.Array:
    ends, _, start = _laid(opens)
    partner = _numbers(partners, -1) + start
    first = np.flatnonzero(_flags(opens) & (partner > np.arange(len(start))))
    steps = np.zeros(len(start), np.int64)
    steps[first] = 1
    steps[partner[first]] = -1
    return _listed(ends, pa.array(_sums(steps, start), pa.int32()))


@F.arrow_udf(RANKS)
@_sliced
def _ranks(groups: pa.Array) -> pa.Array:
    ends, row, _ = _laid(groups)
    group = _numbers(groups, -1)
    at = np.flatnonzero(group >= 0)
    at = at[np.lexsort((at, group[at], row[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (row[at[1:]] != row[at[:-1]]) | (group[at[1:]] != group[at[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    out = np.full(len(row), -1)
    out[at] = np.arange(len(at)) - begin + 1
    return _listed(ends, pa.StructArray.from_arrays([groups.flatten(), pa.array(out, pa.int32(), mask=out < 0)], names=["group", "no"]))


@F.arrow_udf(INTS)
@_sliced
def _latest(groups: pa.Array, flags: pa.Array) -> pa.Array:
    ends, row, start = _laid(groups)
    group, flag = _numbers(groups, -1), _flags(flags)
    at = np.flatnonzero(group >= 0)
    at = at[np.lexsort((at, group[at], row[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (row[at[1:]] != row[at[:-1]]) | (group[at[1:]] != group[at[:-1]])
    seen = np.maximum.accumulate(np.where(flag[at] | new, np.arange(len(at)), 0))
    out = np.full(len(row), -1)
    out[at] = np.where(flag[at[seen]], at[seen], -1)
    return _listed(ends, pa.array(out - start, pa.int32(), mask=out < 0))


def totals(steps: Column) -> Column:
    """array<struct<step, total>>: the steps, and their sums up to each element, nulls as 0."""
    return _totals(steps)


def pairs(opens: Column, closes: Column, same: Column | None = None) -> Column:
    """array<struct<partner, around, depth>>: brackets of any kind, from arrays of flags.

    partner: where an open's close is and a close's open, null elsewhere and for strays. depth: pairs that are open after the
    element. around: the open of the innermost pair that an element lies in (not its own). same: names in which the two of a pair have to agree.
    """
    return _pairs(opens, closes) if same is None else _named_pairs(opens, closes, same)


def inside(opens: Column, partners: Column) -> Column:
    """array<int>: of the pairs whose open is flagged, those that are open after each element."""
    return _inside(opens, partners)


def ranks(groups: Column) -> Column:
    """array<struct<group, no>>: the groups, and the number of each element among those of its group so far, from 1; null without a group."""
    return _ranks(groups)


def latest(groups: Column, flags: Column) -> Column:
    """array<int>: the last flagged element of the same group, up to each element; null without one."""
    return _latest(groups, flags)
