"""Banded positive definite systems of any length, cut into blocks that tasks solve apart.

Block k holds rows k * block and on; its first `width` rows (but for block 0) are a
border. Inner rows of different blocks meet at borders only, so each block
eliminates its inner rows by itself, which leaves a small matrix over the borders
at its two ends. These add up to one banded system of width rows a border, which
is solved for each matrix in one task; with the borders known, blocks are solved
apart again. A task solves all its blocks in one loop over their rows.

The factor in the order of the rows follows from the same small matrices: what all
rows before a block take from its first rows is carried from border to border, and
blocks are then factored apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.functions.windows import DEFAULT, DeltaWindow
from phonoframe.operators import kernels
from phonoframe.operators.grouping import kind, over_utterances, tasks_of

#: Rows of a block.
BLOCK = 2048
#: What tells blocks apart.
BY = ("utt", "chunk")


@dataclass
class Block:
    """Rows low to high of a matrix, its own and the border that follows: the lower band (width + 1, rows, D) and the right sides (rows, D)."""

    utt: object
    chunk: int
    low: int
    left: int
    right: int
    band: np.ndarray
    b: np.ndarray

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        rows = slice(self.left, self.band.shape[1] - self.right)
        return self.band[:, rows], self.b[rows]

    def couplings(self) -> np.ndarray:
        """(inner rows, left + right, D): the entries between inner rows and borders."""
        w, size, d = self.band.shape[0] - 1, self.band.shape[1], self.band.shape[2]
        n = size - self.left - self.right
        out = np.zeros((n, self.left + self.right, d))
        for k in range(1, w + 1):
            for t in range(self.left, min(self.left + k, self.left + n)):  # inner row, border column
                if t - k >= 0:
                    out[t - self.left, t - k] = self.band[k, t]
            for t in range(size - self.right, size):  # border row, inner column
                if self.left <= t - k < self.left + n:
                    out[t - k - self.left, t - n] = self.band[k, t]
        return out

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Matrix and right side over both borders, of which the first belongs to this block."""
        m, d = self.left + self.right, self.band.shape[2]
        s, g = np.zeros((m, m, d)), np.zeros((m, d))
        for i in range(self.left):
            for j in range(i + 1):
                s[i, j] = s[j, i] = self.band[i - j, i]
            g[i] = self.b[i]
        return s, g


def eliminated(blocks: list[Block]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block the matrix (borders, borders, D) and right side (borders, D) that its inner rows leave."""
    bands, rights, couplings = [], [], []
    for x in blocks:
        (band, b), c = x.inner(), x.couplings()
        couplings.append(c)
        bands.append(np.tile(band, (1, 1, 1 + c.shape[1])))
        rights.append(np.concatenate([b, *c.transpose(1, 0, 2)], 1))
    out = []
    for x, c, solved in zip(blocks, couplings, kernels.solve_many(bands, rights), strict=True):
        z = solved.reshape(len(solved), 1 + c.shape[1], x.b.shape[1])
        s, g = x.own()
        out.append((s - np.einsum("nid,njd->ijd", c, z[:, 1:]), g - np.einsum("nid,nd->id", c, z[:, 0])))
    return out


def border_solution(parts: list[tuple[int, int, np.ndarray, np.ndarray]], width: int) -> list[np.ndarray]:
    """Solutions at the borders of each block (left + right, D), from (left, right, matrix, right side) of all blocks in order."""
    n, d = (len(parts) - 1) * width, parts[0][3].shape[1]
    band, b = np.zeros((2 * width, n, d)), np.zeros((n, d))
    at = [np.r_[(k - 1) * width : (k - 1) * width + left, k * width : k * width + right] for k, (left, right, _, _) in enumerate(parts)]
    for rows, (_, _, s, g) in zip(at, parts, strict=True):
        b[rows] += g
        for i, row in enumerate(rows):
            for j in range(i + 1):
                band[row - rows[j], row] += s[i, j]
    x = kernels.solve_factored(kernels.cholesky(band), b)
    return [x[rows] for rows in at]


def solved(blocks: list[Block], borders: list[np.ndarray]) -> list[np.ndarray]:
    """Each block's solution, borders included."""
    bands, rights = [], []
    for x, y in zip(blocks, borders, strict=True):
        band, b = x.inner()
        bands.append(band)
        rights.append(b - np.einsum("nid,id->nd", x.couplings(), y))
    inner = kernels.solve_many(bands, rights)
    return [np.concatenate([y[: x.left], z, y[x.left :]]) for x, y, z in zip(blocks, borders, inner, strict=True)]


def with_lengths(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """rows with n (of lengths: utt, n)."""
    return rows.join(lengths.select("utt", F.col("n").cast("long").alias("n")), "utt")


def spread(rows: DataFrame, place: Column, before: int, after: int, block: int) -> DataFrame:
    """rows (which have n) with chunks and chunk, once for each block whose rows, `before` rows ahead of them or `after` rows behind them, hold the place. The last block takes what is left over."""
    met = rows.withColumn("chunks", F.greatest(F.floor(F.col("n") / block), F.lit(1)))
    of = lambda x: F.least(F.greatest(F.floor(x / block), F.lit(0)), F.col("chunks") - 1)
    return met.withColumn("chunk", F.explode(F.sequence(of(place - after), of(place + before))))


def cut(rows: DataFrame, lengths: DataFrame, place: Column, before: int, after: int, block: int) -> DataFrame:
    """rows with n (of lengths: utt, n), ``spread`` over blocks."""
    return spread(with_lengths(rows, lengths), place, before, after, block)


def _blocks(some: list[pd.DataFrame], assemble, width: int, block: int) -> list[Block]:
    out = []
    for pdf in some:
        utt, chunk, n = (pdf[c].iloc[0] for c in ("utt", "chunk", "n"))
        low, last = int(chunk) * block, chunk == max(n // block, 1) - 1
        high = int(n) if last else low + block + width
        out.append(Block(utt, int(chunk), low, width if chunk else 0, 0 if last else width, *assemble(pdf, low, high, int(n))))
    return out


def _parted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list]:
    """A block's rows and what is known at its border (nothing: empty), which comes first as it has no place."""
    border = pdf["border"].iloc[0]
    return (pdf.iloc[1:], border) if isinstance(border, (np.ndarray, list)) else (pdf, [])


def _together(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One table of what a stack of blocks or matrices gives: a table for each would cost more than its rows."""
    if held := list(parts):
        yield pd.concat(held, ignore_index=True)


def _by_block(rows: DataFrame, kernel, schema: str, order: str, tasks: int | None, only: str | None = None) -> DataFrame:
    return over_utterances(rows.select(*BY, *[c for c in rows.columns if c not in BY]), kernel, schema, order=order, tasks=tasks, key=BY, only=only)


def solve_blocks(rows: DataFrame, assemble: Callable[[pd.DataFrame, int, int, int], tuple[np.ndarray, np.ndarray]], finish, schema: str, width: int, block: int, order: str, tasks: int | None) -> DataFrame:
    """finish(block, its solution, its rows) of every block of `rows` (as ``cut`` gives them).

    assemble(rows of a block, low, high, n) returns the band and the right sides of
    rows low to high. width is the band's or more. Rows are dealt by block once, for
    both passes; borders are then dealt to them.
    """
    if block < 2 * width + 1:
        raise ValueError(f"blocks of {block} rows are too short for a band of {width}")
    utt = f"utt {kind(rows, 'utt')}"

    def reduce(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _blocks(some, assemble, width, block)
        parts = eliminated(blocks)
        yield pd.DataFrame({"utt": [x.utt for x in blocks], "chunk": [x.chunk for x in blocks], "left": [x.left for x in blocks], "right": [x.right for x in blocks], "s": [s.ravel() for s, _ in parts], "g": [g.ravel() for _, g in parts]})

    def met(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in some:
            parts = []
            for left, right, s, g in zip(pdf["left"], pdf["right"], pdf["s"], pdf["g"], strict=True):
                m = left + right
                parts.append((left, right, np.asarray(s).reshape(m, m, -1), np.asarray(g).reshape(m, -1)))
            yield pd.DataFrame({"utt": pdf["utt"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "border": [x.ravel() for x in border_solution(parts, width)]})

    def end(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known = zip(*map(_parted, some), strict=True)
        blocks = _blocks(own, assemble, width, block)
        borders = [np.asarray(k, float).reshape(x.left + x.right, x.b.shape[1]) for k, x in zip(known, blocks, strict=True)]
        yield from _together(finish(x, y, pdf) for x, y, pdf in zip(blocks, solved(blocks, borders), own, strict=True))

    dealt = rows.drop("chunks").repartition(tasks_of(rows, tasks), *BY)
    parts = _by_block(dealt, reduce, f"{utt}, chunk long, left int, right int, s array<double>, g array<double>", order, tasks, only=f"n >= {2 * block}")
    borders = over_utterances(parts, lambda some: _together(met(some)), f"{utt}, chunk long, border array<double>", order="chunk", tasks=tasks)
    known = dealt.unionByName(borders.repartition(tasks_of(rows, tasks), *BY), allowMissingColumns=True)
    return _by_block(known, end, schema, order, tasks)


def solve(a: DataFrame, b: DataFrame, sizes: DataFrame, width: int, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """(mat, idx, value): x of A x = b, A symmetric positive definite with its lower band given as (mat, row, col, value)."""
    # below: how far under the diagonal, which rows in a row share; -1 are right sides, -2 rows that only have a block known.
    below = lambda c: c.cast("long").alias("below")
    entries = a.where(f"row >= col and row - col <= {width}").select(F.col("mat").alias("utt"), "row", below(F.col("row") - F.col("col")), F.col("value").cast("double").alias("value"))
    right = b.select(F.col("mat").alias("utt"), F.col("idx").alias("row"), below(F.lit(-1)), F.col("value").cast("double").alias("value"))
    lengths = sizes.select(F.col("mat").alias("utt"), "n")
    # Rows of zeros too have their block.
    empty = cut(lengths.select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("row"), below(F.lit(-2)), F.lit(0.0).alias("value")), lengths, F.col("row"), 0, 0, block)
    rows = cut(entries.unionByName(right), lengths, F.col("row"), 0, width, block).unionByName(empty)

    def assemble(pdf: pd.DataFrame, low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        row, under, value = (pdf[c].to_numpy() for c in ("row", "below", "value"))
        row, under = (row - low).astype(np.int64), under.astype(np.int64)
        inner, right = (under >= 0) & (row >= under), under == -1
        band, x = np.zeros((width + 1, high - low, 1)), np.zeros((high - low, 1))
        band[under[inner], row[inner], 0] = value[inner]
        x[row[right], 0] = value[right]
        return band, x

    def finish(x: Block, y: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
        own = y[: len(y) - x.right, 0]
        return pd.DataFrame({"mat": [x.utt] * len(own), "idx": x.low + np.arange(len(own)), "value": own})

    return solve_blocks(rows, assemble, finish, f"mat {kind(a, 'mat')}, idx long, value double", width, block, "row", tasks)


def _trajectory_rows(frames: DataFrame, windows: Sequence[DeltaWindow], block: int, gathered: bool = False) -> tuple[DataFrame, int, int]:
    """Frames in blocks with as many on both sides as windows reach, the width of the borders, and how far windows look back."""
    back, ahead = max(w.left for w in windows), max(w.right for w in windows)
    width = max(back + ahead, 1)
    reach = max(back, ahead)
    if gathered:
        # In the order of a delta's window, which then answers for both.
        every = Window.partitionBy("utt").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = frames.where("utt is not null").withColumn("n", (F.max("frame").over(every) + 1).cast("long"))
    else:
        met = with_lengths(frames, frames.groupBy("utt").agg((F.max("frame") + 1).alias("n")))
    return spread(met, F.col("frame"), reach, width + reach, block), width, back


def _precisions(pdf: pd.DataFrame, n: int, windows: Sequence[DeltaWindow]) -> list[np.ndarray]:
    """Of each window, by frame; those of dynamic windows are 0 where the widest window leaves the utterance."""
    variances = np.stack(pdf["variances"].to_numpy()).astype(float)
    if (variances <= 0).any():
        raise ValueError(f"a variance of {pdf['utt'].iloc[0]} isn't positive")
    parts = np.split(1 / variances, len(windows), axis=1)
    edge = max(max(w.left, w.right) for w in windows)
    frame = pdf["frame"].to_numpy()
    for p in parts[1:]:
        p[(frame < edge) | (frame >= n - edge)] = 0
    return parts


def _assembled(pdf: pd.DataFrame, low: int, high: int, n: int, windows: tuple[DeltaWindow, ...], width: int, right) -> tuple[np.ndarray, np.ndarray]:
    first = int(pdf["frame"].iloc[0])
    tau = _precisions(pdf, n, windows)
    narrow = kernels.precision_band(tau, windows)
    band = np.zeros((width + 1, high - low, narrow.shape[2]))
    band[: len(narrow)] = narrow[:, low - first : high - first]
    return band, right(pdf, tau)[low - first : high - first]


def mlpg(frames: DataFrame, windows: Sequence[DeltaWindow] = DEFAULT, block: int = BLOCK, tasks: int | None = None, gathered: bool = False) -> DataFrame:
    """(utt, frame, means, variances) -> (utt, frame, features), as ``paramgen.mlpg``, of utterances of any length. Every frame is there; a variance that isn't positive is an error.

    gathered: windows have brought each utterance's frames together already, say to number them or
    to find their deltas. Another window then finds lengths; else a join does, which makes frames
    anew, but which adaptive execution can split or turn into one by broadcast if an utterance is long.
    """
    windows = tuple(windows)
    rows, width, _ = _trajectory_rows(frames.select("utt", "frame", "means", "variances"), windows, block, gathered)

    def right(pdf: pd.DataFrame, tau: list[np.ndarray]) -> np.ndarray:
        mu = np.split(np.stack(pdf["means"].to_numpy()).astype(float), len(windows), axis=1)
        return sum(kernels.apply_transposed(t * m, w) for t, m, w in zip(tau, mu, windows, strict=True))

    def finish(x: Block, y: np.ndarray, _: pd.DataFrame) -> pd.DataFrame:
        own = y[: len(y) - x.right]
        return pd.DataFrame({"utt": [x.utt] * len(own), "frame": x.low + np.arange(len(own)), "features": list(own)})

    return solve_blocks(rows, lambda *a: _assembled(*a, windows, width, right), finish, f"utt {kind(frames, 'utt')}, frame long, features array<double>", width, block, "frame", tasks)


def mlpg_gradient(frames: DataFrame, windows: Sequence[DeltaWindow] = DEFAULT, block: int = BLOCK, tasks: int | None = None, gathered: bool = False) -> DataFrame:
    """(utt, frame, variances, gradient) -> (utt, frame, features), as ``paramgen.mlpg_gradient``, of utterances of any length. gathered: as for ``mlpg``."""
    windows = tuple(windows)
    rows, width, back = _trajectory_rows(frames.select("utt", "frame", "variances", "gradient"), windows, block, gathered)
    right = lambda pdf, _: np.stack(pdf["gradient"].to_numpy()).astype(float)

    def finish(x: Block, y: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
        # A block knows its own rows and the border behind them: it answers for rows whose windows lie in these.
        low = back if x.left else 0
        high = len(y) - x.right + (back if x.right else 0)
        first = int(pdf["frame"].iloc[0])
        tau = [t[x.low + low - first : x.low + high - first] for t in _precisions(pdf, int(pdf["n"].iloc[0]), windows)]
        got = np.concatenate([t * kernels.apply_window(y, w)[low:high] for t, w in zip(tau, windows, strict=True)], 1)
        return pd.DataFrame({"utt": [x.utt] * len(got), "frame": x.low + low + np.arange(len(got)), "features": list(got)})

    return solve_blocks(rows, lambda *a: _assembled(*a, windows, width, right), finish, f"utt {kind(frames, 'utt')}, frame long, features array<double>", width, block, "frame", tasks)


def solve_triangular(factor: DataFrame, b: DataFrame, sizes: DataFrame, width: int, transposed: bool = False, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """(mat, idx, value): x of L x = b, or of transpose(L) x = b, L lower banded; a zero on the diagonal is an error.

    A block maps the last `width` values before it to its own last ones, an affine
    map that it finds by itself; the maps are applied one after the other for each
    matrix, and blocks are solved apart with what they then know.
    """
    if block < width:
        raise ValueError(f"blocks of {block} rows are too short for a band of {width}")
    n = F.col("n")
    lengths = sizes.select(F.col("mat").alias("utt"), "n")
    entries = factor.where(f"row >= col and row - col <= {width}").select(F.col("mat").alias("utt"), "row", "col", F.col("value").cast("double").alias("value"))
    right = b.select(F.col("mat").alias("utt"), F.col("idx").alias("row"), F.lit(-1).cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    if transposed:  # the same from the last row up
        turned = entries.join(lengths, "utt").select("utt", (n - 1 - F.col("col")).alias("row"), (n - 1 - F.col("row")).alias("col"), "value")
        entries, right = turned, right.join(lengths, "utt").select("utt", (n - 1 - F.col("row")).alias("row"), "col", "value")
    empty = lengths.select("utt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(block).cast("long"))).alias("row"), F.lit(-2).cast("long").alias("col"), F.lit(0.0).alias("value"))
    rows = cut(entries.unionByName(right).unionByName(empty), lengths, F.col("row"), 0, 0, block)
    utt = f"utt {kind(factor, 'mat')}"

    def blocks_of(some: list[pd.DataFrame]) -> list[tuple[pd.DataFrame, int, np.ndarray, np.ndarray, np.ndarray]]:
        """low, band, right side and (rows, width) what each value before the block takes from them."""
        out = []
        for pdf in some:
            low = int(pdf["chunk"].iloc[0]) * block
            high = int(pdf["n"].iloc[0]) if pdf["chunk"].iloc[0] == pdf["chunks"].iloc[0] - 1 else low + block
            row, col, value = (pdf[c].to_numpy() for c in ("row", "col", "value"))
            row, right, inner = row.astype(np.int64) - low, col == -1, col >= low
            band, x, c = np.zeros((width + 1, high - low, 1)), np.zeros((high - low, 1)), np.zeros((high - low, width))
            band[(row + low - col)[inner].astype(np.int64), row[inner], 0] = value[inner]
            x[row[right], 0] = value[right]
            before = (col >= 0) & ~inner
            c[row[before], (col[before] - low + width).astype(np.int64)] = value[before]
            out.append((pdf, low, band, x, c))
        return out

    def substituted(bands: list[np.ndarray], rights: list[np.ndarray]) -> list[np.ndarray]:
        band = kernels.stacked([np.repeat(a, r.shape[1], 2) for a, r in zip(bands, rights, strict=True)])
        at = np.cumsum([0, *(r.shape[1] for r in rights)])
        for k, r in enumerate(rights):
            band[0, len(r) :, at[k] : at[k + 1]] = 1
        x = kernels.solve_triangular(band, kernels.stacked(rights))
        return [x[: len(r), i:j] for r, i, j in zip(rights, at[:-1], at[1:], strict=True)]

    def reduce(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = blocks_of(some)
        got = substituted([a for _, _, a, _, _ in own], [np.concatenate([x, -c], 1) for _, _, _, x, c in own])
        tails = [y[len(y) - width :] for y in got]
        yield pd.DataFrame({"utt": [p["utt"].iloc[0] for p in some], "chunk": [p["chunk"].iloc[0] for p in some], "map": [y.ravel() for y in tails]})

    def met(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in some:
            state, out = np.zeros(width), []
            for m in pdf["map"]:
                out.append(state)
                m = np.asarray(m).reshape(width, 1 + width)
                state = m[:, 0] + m[:, 1:] @ state
            yield pd.DataFrame({"utt": pdf["utt"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "border": out})

    def end(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_, known = zip(*map(_parted, some), strict=True)
        own = blocks_of(rows_)
        rights = [x - (c @ np.asarray(k, float))[:, None] if len(k) else x for (_, _, _, x, c), k in zip(own, known, strict=True)]

        def parts() -> Iterator[pd.DataFrame]:
            for (pdf, low, _, _, _), y in zip(own, substituted([a for _, _, a, _, _ in own], rights), strict=True):
                idx = low + np.arange(len(y))
                yield pd.DataFrame({"mat": [pdf["utt"].iloc[0]] * len(y), "idx": int(pdf["n"].iloc[0]) - 1 - idx if transposed else idx, "value": y[:, 0]})

        yield from _together(parts())

    schema = f"mat {kind(factor, 'mat')}, idx long, value double"
    if not width:
        return _by_block(rows.withColumn("border", F.lit(None).cast("array<double>")), end, schema, "row", tasks)
    # The last block's map isn't asked for; a short block could not hold it.
    parts = _by_block(rows.where("chunk < chunks - 1"), reduce, f"{utt}, chunk long, map array<double>", "row", tasks)
    last = rows.where("chunks > 1 and chunk = chunks - 1").select("utt", "chunk").distinct().withColumn("map", F.array_repeat(F.lit(0.0), width * (1 + width)))
    borders = over_utterances(parts.unionByName(last), lambda some: _together(met(some)), f"{utt}, chunk long, border array<double>", order="chunk", tasks=tasks)
    return _by_block(rows.unionByName(borders, allowMissingColumns=True), end, schema, "row", tasks)


def taken_before(parts: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
    """What the rows before each block take from the matrix over its first rows, from (left, right, matrix over the borders) of all blocks in order."""
    out = [np.zeros((0, 0))]
    for left, right, s in parts[:-1]:
        taken = -s[left:, left:, 0]
        if left:
            cross = s[:left, left:, 0]
            taken = taken + cross.T @ np.linalg.solve(s[:left, :left, 0] - out[-1], cross)
        out.append(taken)
    return out


def cholesky(a: DataFrame, sizes: DataFrame, width: int, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """(mat, row, col, value): the lower factors of symmetric positive definite banded matrices of any size. Another matrix is an error."""
    if block < 2 * width + 1:
        raise ValueError(f"blocks of {block} rows are too short for a band of {width}")
    utt = f"utt {kind(a, 'mat')}"
    entries = a.where(f"row >= col and row - col <= {width}").select(F.col("mat").alias("utt"), "row", "col", F.col("value").cast("double").alias("value"))
    rows = cut(entries, sizes.select(F.col("mat").alias("utt"), "n"), F.col("row"), 0, width, block)

    def assemble(pdf: pd.DataFrame, low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        row, col, value = (pdf[c].to_numpy() for c in ("row", "col", "value"))
        inner = col >= low
        band = np.zeros((width + 1, high - low, 1))
        band[(row - col)[inner].astype(np.int64), (row - low)[inner].astype(np.int64), 0] = value[inner]
        return band, np.zeros((high - low, 1))

    def reduce(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _blocks(some, assemble, width, block)
        yield pd.DataFrame({"utt": [x.utt for x in blocks], "chunk": [x.chunk for x in blocks], "left": [x.left for x in blocks], "right": [x.right for x in blocks], "s": [s.ravel() for s, _ in eliminated(blocks)]})

    def met(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in some:
            parts = [(left, right, np.asarray(s).reshape(left + right, left + right, 1)) for left, right, s in zip(pdf["left"], pdf["right"], pdf["s"], strict=True)]
            yield pd.DataFrame({"utt": pdf["utt"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "border": [x.ravel() for x in taken_before(parts)]})

    def end(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known = zip(*map(_parted, some), strict=True)
        blocks = _blocks(own, assemble, width, block)
        bands = []
        for x, k in zip(blocks, known, strict=True):
            taken = np.asarray(k, float).reshape(x.left, x.left)
            for i in range(x.left):
                for j in range(i + 1):
                    x.band[i - j, i, 0] -= taken[i, j]
            # Columns of the next border are the next block's: its rows are needed for this block's columns only, and are made large.
            for t in range(x.band.shape[1] - x.right, x.band.shape[1]):
                x.band[0, t] += np.abs(x.band).max() * 4 * width
            bands.append(x.band)
        whole = kernels.stacked(bands)
        for i, x in enumerate(blocks):
            whole[0, x.band.shape[1] :, i] = 1
        factor = kernels.cholesky(whole)

        def parts() -> Iterator[pd.DataFrame]:
            for i, x in enumerate(blocks):
                k, t = (v.ravel() for v in np.indices(x.band.shape[:2]))
                good = (t >= k) & (t - k < x.band.shape[1] - x.right)
                yield pd.DataFrame({"mat": [x.utt] * int(good.sum()), "row": x.low + t[good], "col": x.low + (t - k)[good], "value": factor[k[good], t[good], i]})

        yield from _together(parts())

    parts = _by_block(rows.where("chunks > 1"), reduce, f"{utt}, chunk long, left int, right int, s array<double>", "row", tasks)
    taken = over_utterances(parts, lambda some: _together(met(some)), f"{utt}, chunk long, border array<double>", order="chunk", tasks=tasks)
    return _by_block(rows.unionByName(taken, allowMissingColumns=True), end, f"mat {kind(a, 'mat')}, row long, col long, value double", "row", tasks)
