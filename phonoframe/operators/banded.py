"""Banded matrices as tables (mat, row, col, value): entries inside the band, zeros left out.

Sums, products and bands are joins and aggregates, so many matrices are worked
on at once and the shuffle is by matrix and inner index. Factors, solutions and
inverses are recursions along the diagonal: a kernel per matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.operators import kernels
from phonoframe.operators.grouping import kind, over_utterances

ENTRY = ["mat", "row", "col", "value"]
#: Rows of a matrix whose products meet in one task.
PRODUCT_ROWS = 4096


def _summed(entries: DataFrame) -> DataFrame:
    """Entries of a place added up. They are dealt by rows before: a task's share then follows from the entries themselves, and not from the fewer bytes that they were made of."""
    return entries.repartition("mat", "row").groupBy("mat", "row", "col").agg(F.sum("value").alias("value"))


def from_rows(df: DataFrame, left: int, right: int) -> DataFrame:
    """Entries with -left <= col - row <= right."""
    return df.where((F.col("col") - F.col("row")).between(-left, right)).select(*ENTRY)


def transpose(a: DataFrame) -> DataFrame:
    return a.select("mat", F.col("col").alias("row"), F.col("row").alias("col"), "value")


def add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """a + factor * b."""
    return _summed(a.select(*ENTRY).unionByName(b.select("mat", "row", "col", (F.col("value") * factor).alias("value"))))


def times(a: DataFrame, factor: float) -> DataFrame:
    return a.select("mat", "row", "col", (F.col("value") * factor).alias("value"))


def dot_mv(a: DataFrame, x: DataFrame) -> DataFrame:
    """(mat, row, value) of the product with vectors x (mat, idx, value)."""
    v = x.select("mat", F.col("idx").alias("col"), F.col("value").alias("_x"))
    return a.join(v, ["mat", "col"]).groupBy("mat", "row").agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def dot_mm(a: DataFrame, b: DataFrame, diag: DataFrame | None = None, band: tuple[int, int] | None = None) -> DataFrame:
    """a * b, or a * diag * b; band: entries in it only, the others are left out as they are made.

    What meets at an inner index is gathered there, those of a stretch of
    ``PRODUCT_ROWS`` in one task: products of a place are then added up before they move.
    """
    kinds = [("_a", a, "col", "row"), ("_b", b, "row", "col")] + ([] if diag is None else [("_d", diag, "idx", "idx")])
    met = None
    for name, df, inner, outer in kinds:
        own = df.select("mat", F.col(inner).alias("_k"), F.lit(name).alias("_of"), F.col(outer).alias("_at"), F.col("value").cast("double").alias("_v")).where("mat is not null and _k is not null")
        met = own if met is None else met.unionByName(own)
    dealt = met.withColumn("_s", F.floor(F.col("_k") / PRODUCT_ROWS)).repartition("mat", "_s")
    lists = [F.collect_list(F.when(F.col("_of") == name, F.struct("_at", "_v"))).alias(name) for name, *_ in kinds]
    both = dealt.groupBy("mat", "_s", "_k").agg(*lists)
    for name, *_ in kinds:
        both = both.withColumn(name, F.explode(name))
    both = both.select("mat", F.col("_a._at").alias("row"), F.col("_b._at").alias("col"), F.col("_a._v").alias("_x"), F.col("_b._v").alias("_y"), (F.lit(1.0) if diag is None else F.col("_d._v")).alias("_z"))
    if band:
        both = both.where((F.col("col") - F.col("row")).between(-band[0], band[1]))
    return both.groupBy("mat", "row", "col").agg(F.sum(F.col("_x") * F.col("_z") * F.col("_y")).alias("value"))


def band_of_outer(x: DataFrame, y: DataFrame, left: int, right: int) -> DataFrame:
    """The band of the outer product of vectors (mat, idx, value): each x meets only the y of its band."""
    spread = x.select("mat", F.col("idx").alias("row"), F.col("value").alias("_x"), F.explode(F.sequence(F.col("idx") - left, F.col("idx") + right)).alias("col"))
    v = y.select("mat", F.col("idx").alias("col"), F.col("value").alias("_y"))
    return spread.join(v, ["mat", "col"]).select("mat", "row", "col", (F.col("_x") * F.col("_y")).alias("value"))


def trace_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mat, value): the trace of transpose(a) * b."""
    other = b.select("mat", "row", "col", F.col("value").alias("_b"))
    return a.join(other, ["mat", "row", "col"]).groupBy("mat").agg(F.sum(F.col("value") * F.col("_b")).alias("value"))


def diagonal(a: DataFrame) -> DataFrame:
    """(mat, idx, value)."""
    return a.where("row = col").select("mat", F.col("row").alias("idx"), "value")


def from_diagonal(x: DataFrame) -> DataFrame:
    return x.select("mat", F.col("idx").alias("row"), F.col("idx").alias("col"), "value")


def reverse(a: DataFrame, sizes: DataFrame) -> DataFrame:
    """Both axes turned round; sizes is (mat, n)."""
    return a.join(sizes, "mat").select("mat", (F.col("n") - 1 - F.col("row")).alias("row"), (F.col("n") - 1 - F.col("col")).alias("col"), "value")


def block(a: DataFrame, start: int, end: int) -> DataFrame:
    """The principal block [start, end)."""
    inside = F.col("row").between(start, end - 1) & F.col("col").between(start, end - 1)
    return a.where(inside).select("mat", (F.col("row") - start).alias("row"), (F.col("col") - start).alias("col"), "value")


def embed(a: DataFrame, start: int) -> DataFrame:
    """As a principal block of a larger matrix."""
    return a.select("mat", (F.col("row") + start).alias("row"), (F.col("col") + start).alias("col"), "value")


def window_matrix(lengths: DataFrame, left: int, taps: tuple[float, ...]) -> DataFrame:
    """The Toeplitz matrix of a delta window for each (mat, n): entry (t, t + k - left) is taps[k]."""
    rows = lengths.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    taps_ = F.array(*[F.struct(F.lit(k - left).cast("long").alias("o"), F.lit(float(v)).alias("v")) for k, v in enumerate(taps) if v])
    wide = rows.withColumn("_t", F.explode(taps_)).withColumn("col", F.col("row") + F.col("_t.o"))
    return wide.where((F.col("col") >= 0) & (F.col("col") < F.col("n"))).select("mat", "row", "col", F.col("_t.v").alias("value"))


def scaled(a: DataFrame, by: DataFrame) -> DataFrame:
    """a times a factor of each matrix; by is (mat, factor)."""
    return a.join(by, "mat").select("mat", "row", "col", (F.col("value") * F.col("factor")).alias("value"))


def plus_band_of(a: DataFrame, b: DataFrame, left: int, right: int, factor: float = 1.0) -> DataFrame:
    """a + factor * the band of b that has `left` entries below and `right` above the diagonal."""
    return add(a, from_rows(b, left, right), factor)


def dense(a: DataFrame, sizes: DataFrame) -> DataFrame:
    """All entries, zeros included; sizes is (mat, n). Each row's entries and its beginning write out the zeros up to the next entry, so zeros don't move."""
    known = sizes.where("n > 0 and mat is not null").select("mat", F.col("n").cast("long").alias("n"))
    begin = known.select("mat", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row"), F.lit(-1).cast("long").alias("col"), F.lit(None).cast("double").alias("value"))
    inside = a.select(*ENTRY).join(known, "mat").where("row >= 0 and row < n and col >= 0 and col < n")
    rows = begin.unionByName(inside.select("mat", "n", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")).repartition("mat", "row")
    after = F.lead("col").over(Window.partitionBy("mat", "row").orderBy("col"))
    runs = rows.withColumn("_to", F.coalesce(after, F.col("n")) - 1)
    # From an entry, or from behind the row's beginning; entries of one place are all there.
    first, last = F.greatest("col", F.lit(0).cast("long")), F.greatest("col", "_to")
    places = runs.where("greatest(col, _to) >= 0").select("mat", "row", F.col("col").alias("_own"), "value", F.explode(F.sequence(first, last)).alias("col"))
    return places.select("mat", "row", "col", F.when(F.col("col") == F.col("_own"), F.coalesce("value", F.lit(0.0))).otherwise(0.0).alias("value"))


def widths(a: DataFrame) -> DataFrame:
    """(mat, left, right): the narrowest band that holds all entries that aren't zero."""
    off = F.col("col") - F.col("row")
    return a.where("value <> 0").groupBy("mat").agg(F.greatest(F.max(-off), F.lit(0)).alias("left"), F.greatest(F.max(off), F.lit(0)).alias("right"))


def in_common_band(matrices: list[DataFrame], sizes: DataFrame) -> list[DataFrame]:
    """The matrices, each with all entries (zeros included) of the narrowest band that holds them all."""
    every = matrices[0].select(*ENTRY)
    for m in matrices[1:]:
        every = every.unionByName(m.select(*ENTRY))
    common = sizes.join(widths(every), "mat", "left").fillna(0, ["left", "right"]).where("n > 0")
    rows = common.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    low, high = F.greatest(F.col("row") - F.col("left"), F.lit(0)), F.least(F.col("row") + F.col("right"), F.col("n") - 1)
    grid = rows.select("mat", "row", F.explode(F.sequence(low, high)).alias("col"))
    return [grid.join(m.select(*ENTRY), ["mat", "row", "col"], "left").select("mat", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value")) for m in matrices]


def as_diagonals(a: DataFrame, sizes: DataFrame, left: int, right: int, by: str = "col") -> DataFrame:
    """(mat, diagonal, idx, value): the band as a rectangle of right + left + 1 diagonals, the uppermost first, each as long as the matrix and indexed by column or row; places outside the matrix are 0."""
    if by not in ("row", "col"):
        raise ValueError("diagonals are indexed by row or col")
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx")
    grid = sizes.where("n > 0").select("mat", index).withColumn("diagonal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left + right).cast("long"))))
    band_ = from_rows(a, left, right).select("mat", (F.col("row") - F.col("col") + right).alias("diagonal"), F.col(by).alias("idx"), "value")
    return grid.join(band_, ["mat", "diagonal", "idx"], "left").select("mat", "diagonal", "idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def from_diagonals(d: DataFrame, sizes: DataFrame, right: int, by: str = "col") -> DataFrame:
    """Entries from a rectangle as ``as_diagonals`` makes it; places outside the matrix don't count."""
    off = F.col("diagonal") - right
    row, col = (F.col("idx") + off, F.col("idx")) if by == "col" else (F.col("idx"), F.col("idx") - off)
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("n")) & (F.col("col") < F.col("n"))
    return d.join(sizes, "mat").withColumn("row", row).withColumn("col", col).where(inside).select(*ENTRY)


def overlap_add(blocks: DataFrame, step: int = 1, onto: DataFrame | None = None) -> DataFrame:
    """Square blocks (mat, window, row, col, value) laid along the diagonal every `step` and added up, onto a matrix if one is given. Blocks may come in any number of parts."""
    at = F.col("window") * step
    laid = blocks.select("mat", (F.col("row") + at).alias("row"), (F.col("col") + at).alias("col"), "value")
    laid = laid if onto is None else laid.unionByName(onto.select(*ENTRY))
    return _summed(laid)


def sliding(a: DataFrame, sizes: DataFrame, width: int, step: int = 1) -> DataFrame:
    """(mat, window, row, col, value): blocks of `width` by `width` along the diagonal every `step`; sizes (mat, n) that they don't fill exactly are an error."""
    if step < 1 or width < step:
        raise ValueError("a step is 1 at least and no longer than a block")
    n = F.col("n")
    fits = (n >= width - step) & ((n + step - width) % step == 0)
    last = F.when(fits, F.floor((n - width) / step)).otherwise(F.raise_error(F.lit(f"blocks of {width} every {step} don't fit a matrix")).cast("long"))
    low, high = F.least("row", "col"), F.greatest("row", "col")
    first = F.greatest(F.ceil((high - width + 1) / step), F.lit(0))
    marked = a.join(sizes, "mat").withColumn("_a", first).withColumn("_b", F.least(F.floor(low / step), last)).where("_a <= _b")
    spread = marked.withColumn("window", F.explode(F.sequence("_a", "_b")))
    at = F.col("window") * step
    return spread.select("mat", "window", (F.col("row") - at).alias("row"), (F.col("col") - at).alias("col"), "value")


def _systems(a: DataFrame, width: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], b: DataFrame | None, sizes: DataFrame, schema: str, tasks: int | None) -> DataFrame:
    """A kernel over the lower bands (width + 1, n, 1) and right sides (n, 1) of each matrix."""
    right = [] if b is None else [b.select(F.col("mat").alias("utt"), F.col("idx").alias("row"), F.lit(-1).cast("long").alias("col"), "value")]
    mine = from_rows(a, width, 0).select(F.col("mat").alias("utt"), "row", "col", F.col("value").cast("double").alias("value"))
    size = sizes.select(F.col("mat").alias("utt"), F.col("n").alias("row"), F.lit(-2).cast("long").alias("col"), F.lit(0.0).alias("value"))
    rows = mine
    for other in [size, *right]:
        rows = rows.unionByName(other)

    def one(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        row, col, value = (pdf[c].to_numpy() for c in ("row", "col", "value"))
        n = int(row[col == -2][0])
        band, x = np.zeros((width + 1, n, 1)), np.zeros((n, 1))
        inner = col >= 0
        band[row[inner] - col[inner], row[inner], 0] = value[inner]
        x[row[col == -1], 0] = value[col == -1]
        return band, x

    def run(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        systems = [one(pdf) for pdf in some]
        # Matrices of similar sizes side by side: one loop over their rows serves them all. Rows beyond a matrix are the unit matrix's.
        for group in kernels.by_length([len(x) for _, x in systems]):
            bands, rights = kernels.stacked([systems[i][0] for i in group]), kernels.stacked([systems[i][1] for i in group])
            for k, i in enumerate(group):
                bands[0, len(systems[i][1]) :, k] = 1
            got = kernel(bands, rights)
            for k, i in enumerate(group):
                n, mat = len(systems[i][1]), some[i]["utt"].iloc[0]
                if got.ndim == 2:
                    yield pd.DataFrame({"mat": [mat] * n, "idx": np.arange(n), "value": got[:n, k]})
                    continue
                own = got[:, :n, k]
                d, t = (v.ravel() for v in np.indices(own.shape))
                good = t >= d
                yield pd.DataFrame({"mat": [mat] * int(good.sum()), "row": t[good], "col": (t - d)[good], "value": own[d[good], t[good]]})

    return over_utterances(rows, run, schema, order="row", tasks=tasks)


def _schema(a: DataFrame, columns: str) -> str:
    return f"mat {kind(a, 'mat')}, {columns}"


def cholesky(a: DataFrame, sizes: DataFrame, width: int, tasks: int | None = None) -> DataFrame:
    """The lower factors of symmetric positive definite matrices of which at least the lower band is given; an error for others."""
    return _systems(a, width, lambda band, _: kernels.cholesky(band), None, sizes, _schema(a, "row long, col long, value double"), tasks)


def solve(a: DataFrame, b: DataFrame, sizes: DataFrame, width: int, tasks: int | None = None) -> DataFrame:
    """(mat, idx, value): x of A x = b for symmetric positive definite matrices."""
    return _systems(a, width, lambda band, x: kernels.solve_factored(kernels.cholesky(band), x), b, sizes, _schema(a, "idx long, value double"), tasks)


def solve_triangular(factor: DataFrame, b: DataFrame, sizes: DataFrame, width: int, transposed: bool = False, tasks: int | None = None) -> DataFrame:
    """(mat, idx, value): x of L x = b, or of transpose(L) x = b; a zero on the diagonal is an error."""
    return _systems(factor, width, lambda band, x: kernels.solve_triangular(band, x, transposed), b, sizes, _schema(factor, "idx long, value double"), tasks)


def solve_factored(factor: DataFrame, b: DataFrame, sizes: DataFrame, width: int, tasks: int | None = None) -> DataFrame:
    """(mat, idx, value): x of L transpose(L) x = b."""
    return _systems(factor, width, kernels.solve_factored, b, sizes, _schema(factor, "idx long, value double"), tasks)


def inverse_band(a: DataFrame, sizes: DataFrame, width: int, out_width: int, tasks: int | None = None) -> DataFrame:
    """The lower band of the inverses of symmetric positive definite matrices, without the rest of them."""
    return _systems(a, width, lambda band, _: kernels.inverse_band(kernels.cholesky(band), out_width), None, sizes, _schema(a, "row long, col long, value double"), tasks)


def inverse(a: DataFrame, sizes: DataFrame, width: int, tasks: int | None = None, columns: int = 128) -> DataFrame:
    """The lower triangles of whole inverses: a matrix of n rows gives n * (n + 1) / 2 entries.

    Each block of `columns` unit columns is solved apart, in a task that has the
    matrix's band besides; the rows above a block's first column aren't needed.
    """
    lower = from_rows(a, width, 0).select("mat", "row", "col", F.col("value").cast("double").alias("value"))
    size = sizes.select("mat", F.col("n").cast("long").alias("row"), F.lit(-2).cast("long").alias("col"), F.lit(0.0).alias("value"))
    met = lower.unionByName(size).join(sizes.select("mat", F.ceil(F.col("n") / columns).alias("_blocks")), "mat")
    spread = met.select("mat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block"), "row", "col", "value")
    keyed = spread.withColumn("key", F.to_json(F.struct("mat", "block"), {"ignoreNullFields": "false"})).select("key", "mat", "block", "row", "col", "value")

    def kernel(some: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, units, firsts = [], [], []
        for pdf in some:
            row, col, value = (pdf[c].to_numpy() for c in ("row", "col", "value"))
            n, first = int(row[col == -2][0]), int(pdf["block"].iloc[0]) * columns
            inner, wide = col >= 0, min(columns, n - first)
            band, unit = np.zeros((width + 1, n, 1)), np.zeros((n, wide))
            band[row[inner] - col[inner], row[inner], 0] = value[inner]
            unit[first + np.arange(wide), np.arange(wide)] = 1
            bands.append(band)
            units.append(unit)
            firsts.append(first)
        for group in kernels.by_length([len(u) for u in units]):
            solved = kernels.solve_many([np.repeat(bands[i], units[i].shape[1], 2) for i in group], [units[i] for i in group])
            for i, x in zip(group, solved, strict=True):
                row, col = (v.ravel() for v in np.indices(x.shape))
                good = row >= col + firsts[i]
                yield pd.DataFrame({"mat": [some[i]["mat"].iloc[0]] * int(good.sum()), "row": row[good], "col": col[good] + firsts[i], "value": x.ravel()[good]})

    return over_utterances(keyed, kernel, _schema(a, "row long, col long, value double"), order="row", tasks=tasks, key="key")
