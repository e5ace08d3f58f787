"""Exact best match inside a task: small numpy helpers over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

QUERY_STEP = 512
INDEX_STEP = 2048
PAIR_ELEMENTS = 1 << 22
# Pairs in question per query from which a block is worth a product in double.
CROWD = 8


def matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of an Arrow list array by length: ``{length: (rows, matrix)}``, nulls left out.

    A null element becomes NaN.
    """
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    found = {}
    for length in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == length)
        if len(rows) == len(lengths):
            matrix = flat.reshape(len(rows), length)
        else:
            matrix = flat[starts[rows, None] + np.arange(length)]
        found[int(length)] = (rows, matrix)
    return found


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows in double scaled to length 1; zero rows stay zero."""
    wide = matrix.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    return wide / np.where(lengths == 0, 1.0, lengths)[:, None]


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows scaled to length 1 as ``(codes, scales, errors)``, a byte per element.

    ``codes * scale`` is a row, up to a vector of at most the length ``error``. Scales and errors are
    in single precision, errors rounded up.
    """
    units = unit_rows(matrix)
    scales = (np.abs(units).max(axis=1, initial=0.0) / 127).astype(np.float32)
    scales[scales == 0] = 1.0
    codes = np.clip(np.rint(units / scales[:, None]), -127, 127)
    rest = units - codes * scales[:, None].astype(np.float64)
    errors = np.sqrt(np.einsum("ij,ij->i", rest, rest)).astype(np.float32)
    return codes.astype(np.int8), scales, np.nextafter(errors, np.float32(np.inf))


def packed(codes: np.ndarray, scales: np.ndarray, errors: np.ndarray) -> list[bytes]:
    """Quantised rows as byte strings: the codes, the scale, the error."""
    ends = np.stack([scales, errors], axis=1).astype("<f4")
    whole = np.concatenate([codes.view(np.uint8), np.ascontiguousarray(ends).view(np.uint8)], axis=1)
    return [row.tobytes() for row in whole]


def unpacked(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of packed rows of one length, at least one, as ``quantised`` gives them."""
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(rows), -1)
    ends = np.ascontiguousarray(data[:, -8:]).view("<f4").astype(np.float64)
    return data[:, :-8].view(np.int8), ends[:, 0], ends[:, 1]


def best_bounds(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from below and above on the best cosine of each row of ``one`` with all rows of ``two``.

    Both are quantised. Of unit vectors u = a + e and v = b + f, the products u·v and a·b differ by
    at most |e| + |f| + 3 |e| |f|; rounding in single precision comes on top.
    """
    codes, scales, errors = one
    held, held_scales, held_errors = two
    low, high = np.full(len(codes), -np.inf), np.full(len(codes), -np.inf)
    slack = 4 * (codes.shape[1] + 16) * float(np.finfo(np.float32).eps)
    rough = codes.astype(np.float32) * scales[:, None].astype(np.float32)
    for first in range(0, len(held), INDEX_STEP):
        step = slice(first, first + INDEX_STEP)
        block = np.ascontiguousarray((held[step].astype(np.float32) * held_scales[step, None].astype(np.float32)).T)
        error = float(held_errors[step].max())
        for start in range(0, len(codes), QUERY_STEP):
            part = slice(start, start + QUERY_STEP)
            top = (rough[part] @ block).max(axis=1).astype(np.float64)
            width = errors[part] * (1 + 3 * error) + error + slack
            low[part] = np.maximum(low[part], top - width)
            high[part] = np.maximum(high[part], top + width)
    return low, high


def _ordered_sum(products: np.ndarray) -> np.ndarray:
    # Added up from the left, so that a score has the same last bit wherever it is computed.
    return np.add.accumulate(products, axis=1)[:, -1]


def exact_scores(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in double, 0 where a length is 0."""
    if queries.shape[1] == 0:
        return np.zeros(len(queries))
    dot = _ordered_sum(queries * others)
    lengths = np.sqrt(_ordered_sum(queries * queries)) * np.sqrt(_ordered_sum(others * others))
    return np.where(lengths == 0, 0.0, dot / np.where(lengths == 0, 1.0, lengths))


def first_best(
    queries: np.ndarray, index: np.ndarray, threshold: float, only: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each query the first index row with the greatest cosine above the threshold.

    Gives ``(rows, scores)`` with row -1 where no score is above it. ``only`` names the index rows
    that count, ascending; what counts is finite, and so are the queries. The threshold is not
    negative, so that a zero query has no match.

    A matrix product in single precision finds the rows that its rounding leaves in question.
    Only those are scored exactly, in double, and compared; ties go to the first row. Memory is
    bounded by the step sizes.
    """
    rows = np.full(len(queries), -1, dtype=np.int64)
    scores = np.full(len(queries), float(threshold))
    wide = queries.astype(np.float64)
    units = unit_rows(wide)
    rough_units = units.astype(np.float32)
    # Bound on the rounding of a product of two unit vectors in single precision.
    error = (queries.shape[1] + 8) * float(np.finfo(np.float32).eps)
    for first in range(0, len(index if only is None else only), INDEX_STEP):
        step = slice(first, first + INDEX_STEP)
        block = index[step if only is None else only[step]].astype(np.float64)
        block_units = unit_rows(block)
        rough_block = np.ascontiguousarray(block_units.T, dtype=np.float32)
        for low in range(0, len(queries), QUERY_STEP):
            rough = rough_units[low : low + QUERY_STEP] @ rough_block
            top = rough.max(axis=1)
            reached = scores[low : low + QUERY_STEP] - error
            at = np.flatnonzero(top >= reached)
            if not len(at):
                continue
            floor = np.maximum(top[at] - 2 * error, reached[at])
            near, hit = np.nonzero(rough[at] >= floor[:, None])
            if len(near) > CROWD * len(at):
                near, hit = _narrowed(units[low + at], block_units, floor)
            _keep_best(wide, block, low + at[near], hit, first, rows, scores)
    if only is not None and len(only):
        rows = np.where(rows < 0, -1, only[rows])
    return rows, scores


def _narrowed(units, block_units, floor):
    """The rows in question after a product in double, for blocks with many near the best."""
    close = units @ block_units.T
    slack = 1e-12 + 8 * units.shape[1] * np.finfo(np.float64).eps
    return np.nonzero(close >= np.maximum(close.max(axis=1) - slack, floor)[:, None])


def _keep_best(wide, block, near, hit, first, rows, scores):
    """Score pairs exactly and keep what beats the best so far; pairs come in index order."""
    step = max(1, PAIR_ELEMENTS // max(1, block.shape[1]))
    for start in range(0, len(near), step):
        at, to = near[start : start + step], hit[start : start + step]
        exact = exact_scores(wide[at], block[to])
        order = np.lexsort((to, -exact, at))
        at, to, exact = at[order], to[order], exact[order]
        top = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        better = top[exact[top] > scores[at[top]]]
        rows[at[better]] = first + to[better]
        scores[at[better]] = exact[better]


def _usable_rows(matrix: np.ndarray, copies: bool) -> np.ndarray | None:
    """Rows with finite elements only, and of equal ones the first if there are ``copies``; None for all.

    Rows are told apart by a hash and then by their bytes, a bounded number at a time. Rows of equal
    hash that differ all stay.
    """
    keep = np.ones(len(matrix), bool)
    whole = np.dtype(f"u{matrix.itemsize}")
    factors = np.random.default_rng(len(matrix)).integers(0, 1 << 64, matrix.shape[1], np.uint64) | np.uint64(1)
    hashes = np.zeros(len(matrix), np.uint64)
    for first in range(0, len(matrix), INDEX_STEP):
        step = slice(first, first + INDEX_STEP)
        keep[step] = np.isfinite(matrix[step]).all(axis=1)
        if copies:
            hashes[step] = (matrix[step].view(whole).astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
    if copies and len(matrix) and matrix.shape[1]:
        _, at, group = np.unique(hashes, return_index=True, return_inverse=True)
        later = np.flatnonzero(at[group] != np.arange(len(matrix)))
        for first in range(0, len(later), INDEX_STEP):
            own = later[first : first + INDEX_STEP]
            same = matrix[own].view(whole) == matrix[at[group[own]]].view(whole)
            keep[own[same.all(axis=1)]] = False
    return None if keep.all() else np.flatnonzero(keep)


class IndexRows:
    """Vectors of an index in tie-break order, with their positions and card ids.

    A worker holds the vectors once, and for each length of query up to one number a row.
    """

    def __init__(self, table: pa.Table, copies: bool = True):
        self.copies = copies
        table = table.sort_by("idx").combine_chunks()
        self.idx = one_chunk(table["idx"])
        self.card_id = one_chunk(table["card_id"])
        self._by_length = matrices(one_chunk(table["embedding"]))
        self._usable: dict[tuple[int, int], np.ndarray | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "_usable": {}}

    def _best(self, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """``first_best`` over the vectors that queries of this length can match.

        Longer vectors are cut to the query's length and shorter ones left out. Vectors with
        an element that is not finite never win. Of equal vectors of one length the first stands
        for all; tables without ``copies`` are not searched for them.
        """
        length = queries.shape[1]
        rows, scores = np.full(len(queries), -1, dtype=np.int64), np.full(len(queries), float(threshold))
        for size, (own, matrix) in self._by_length.items():
            if size < length:
                continue
            matrix = matrix[:, :length]
            if (size, length) not in self._usable:
                self._usable[size, length] = _usable_rows(matrix, self.copies)
            best, score = first_best(queries, matrix, threshold, self._usable[size, length])
            place = np.where(best < 0, -1, own[best])
            # Ties between lengths go to the first row, too.
            better = (best >= 0) & ((score > scores) | (score == scores) & (place < rows))
            rows[better], scores[better] = place[better], score[better]
        return rows, scores

    def search(self, vectors: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, scores)`` for an Arrow list array of query vectors; row -1 for no match."""
        rows = np.full(len(vectors), -1, dtype=np.int64)
        scores = np.full(len(vectors), np.nan)
        for _, (at, queries) in matrices(vectors).items():
            finite = np.isfinite(queries).all(axis=1)
            best, score = self._best(queries[finite], threshold)
            found = best >= 0
            target = at[finite][found]
            rows[target] = best[found]
            scores[target] = score[found]
        return rows, scores


def one_chunk(column: pa.ChunkedArray) -> pa.Array:
    merged = column.combine_chunks()
    if isinstance(merged, pa.ChunkedArray):
        merged = merged.chunk(0) if merged.num_chunks else pa.array([], merged.type)
    return merged


def taken(values: pa.Array, rows: np.ndarray) -> pa.Array:
    """Values at the rows, null where the row is -1."""
    return values.take(pa.array(rows, mask=rows < 0))


def hits(index: IndexRows, vectors: pa.Array, threshold: float) -> pa.StructArray:
    """Struct ``(idx, card_id, score)`` per query vector, its fields null for no match."""
    rows, scores = index.search(vectors, threshold)
    return pa.StructArray.from_arrays(
        [
            taken(index.idx, rows),
            taken(index.card_id, rows),
            pa.array(scores, mask=rows < 0),
        ],
        names=["idx", "card_id", "score"],
    )
