"""Pairs of whole numbers that meet in lists, counted: packed on their way between tasks, a few bytes a pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Rows of lists that are paired at once, pairs that are packed at once, and pairs handed on in one batch.
LISTS_AT_ONCE, PAIRS_AT_ONCE, ROWS_OUT = 4_096, 2_000_000, 100_000
PACKED = "task int, n int, packed binary"
COUNTED = "k1 long, k2 long, shared long"


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash (splitmix64)."""
    z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists one after the other, and how many each has (null: none)."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), sizes


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _planes(column: np.ndarray) -> np.ndarray:
    """The numbers' lowest bytes, then their next ones, as far as one of them has more than zeros there."""
    many = max(1, (int(column.view(np.uint64).max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8).T[:many])


def _from_planes(planes: np.ndarray) -> np.ndarray:
    out = planes[0].astype(np.int64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def pack(batches: Iterable[pa.RecordBatch], tasks: int, split: int) -> Iterator[pa.RecordBatch]:
    """PACKED rows of lists (xs, ys): each x with each y, or with the values before it in xs where ys is null; xs is then in falling order.

    A pair goes to the task that its x names, or one of ``split`` tasks from there on by its y. Of each task the pairs x < y are in order, as the differences from
    the pair before and a count, compressed.
    """
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        for k in range(0, batch.num_rows, LISTS_AT_ONCE):
            piece = batch.slice(k, LISTS_AT_ONCE)
            (xs, nx), (ys, ny) = _flat(piece.column("xs")), _flat(piece.column("ys"))
            own = np.repeat(piece.column("ys").is_null().to_numpy(zero_copy_only=False), nx)
            start = np.repeat(_before(nx), nx)
            first = np.where(own, start, len(xs) + np.repeat(_before(ny), nx))
            many = np.where(own, np.arange(len(xs)) - start, np.repeat(ny, nx))
            known, rank = np.unique(np.concatenate([xs, ys]), return_inverse=True)
            bits = max(1, int(len(known) - 1).bit_length())
            if 2 * bits + tasks.bit_length() > 63:
                raise ValueError(f"{len(known)} values at once and {tasks} tasks do not fit one number")
            mixed = _mixed(known)
            home, step = (mixed % np.uint64(tasks)).astype(np.int64), ((mixed >> np.uint64(32)) % np.uint64(split)).astype(np.int64)
            sums = np.cumsum(many)
            at = 0
            while at < len(many):
                to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                n = many[at:to]
                y = rank[np.arange(n.sum()) + np.repeat(first[at:to] - _before(n), n)]
                x = np.repeat(rank[at:to], n)
                task = home[x] if split == 1 else (home[x] + step[y]) % tasks
                code = np.sort(task << (2 * bits) | x << bits | y)
                at = to
                if len(code):
                    yield _packed(code, bits, known, codec)


def _packed(code: np.ndarray, bits: int, known: np.ndarray, codec: pa.Codec) -> pa.RecordBatch:
    """One row for each task of the codes (task, rank of x, rank of y), which are in order."""
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    n = np.diff(np.r_[starts, len(code)])
    code, mask = code[starts], (1 << bits) - 1
    task, x, y = code >> (2 * bits), known[code >> bits & mask], known[code & mask]
    fresh = np.r_[True, task[1:] != task[:-1]]
    dx = x - np.where(fresh, 0, np.r_[0, x[:-1]])
    dy = y - np.where(fresh | (dx != 0), x, np.r_[0, y[:-1]])
    edges = [*np.flatnonzero(fresh).tolist(), len(code)]
    planes = [_planes(c) for c in (dx, dy, n)]
    widths, planes = bytes(map(len, planes)), np.concatenate(planes)
    packed = [widths + codec.compress(planes[:, a:b].tobytes(), asbytes=True) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.record_batch([pa.array(task[edges[:-1]], pa.int32()), pa.array(np.diff(edges), pa.int32()), pa.array(packed, pa.binary())], ["task", "n", "packed"])


def _unpacked(n: int, packed: bytes, codec: pa.Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = [0, *np.cumsum(np.frombuffer(packed, np.uint8, 3)).tolist()]
    planes = np.frombuffer(codec.decompress(packed[3:], n * w[3], asbytes=True), np.uint8).reshape(-1, n)
    dx, dy, counts = (_from_planes(planes[a:b]) for a, b in zip(w, w[1:], strict=False))
    x = np.cumsum(dx)
    runs = np.flatnonzero(np.r_[True, dx[1:] != 0])
    y = np.cumsum(dy)
    return x, y + np.repeat(x[runs] - (y[runs] - dy[runs]), np.diff(np.r_[runs, n])), counts


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, in order, with the sum of its counts."""
    x, y, n = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    least = [int(c.min()) for c in (x, y)]
    bits = [max(1, (int(c.max()) - k).bit_length()) for c, k in ((x, least[0]), (y, least[1]), (n, 0))]
    if sum(bits) > 63:
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], n[order]
    else:
        code = ((x - least[0]) << bits[1] | (y - least[1])) << bits[2] | n
        del x, y, n
        code.sort()
        n, code = code & ((1 << bits[2]) - 1), code >> bits[2]
        x, y = (code >> bits[1]) + least[0], (code & ((1 << bits[1]) - 1)) + least[1]
    starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return x[starts], y[starts], np.add.reduceat(n, starts)


def count(batches: Iterable[pa.RecordBatch], at_once: int, least: int) -> Iterator[pa.RecordBatch]:
    """COUNTED rows, in order, of one task's PACKED rows: pairs that met at least so many times."""
    codec, held, n, most = pa.Codec("zstd", 1), [], 0, at_once
    for batch in batches:
        for size, packed in zip(batch.column("n").to_pylist(), batch.column("packed"), strict=True):
            held.append(_unpacked(size, packed.as_py(), codec))
            n += size
            if n > most:
                held = [_merged(held)]
                n = len(held[0][0])
                most = max(at_once, 2 * n)
    if held:
        columns = _merged(held)
        columns = [c[columns[2] >= least] for c in columns]
        for k in range(0, len(columns[0]), ROWS_OUT):
            yield pa.record_batch([pa.array(c[k : k + ROWS_OUT]) for c in columns], ["k1", "k2", "shared"])
