"""Queries over banded matrices: one per utterance, as large as it has frames, filled from all of its frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonoframe.operators import banded, longbands, paramgen
from phonoframe.plans.registry import ORACLE_SQL, query
from phonoframe.plans.tables import EVENTS, events

#: Rounded, and never -0.
R = lambda c, n=4: F.round(c, n) + 0.0


def _sizes(spark, sf):
    """Of each matrix; met by hash, as entries, many more than frames, would else be sorted for it."""
    return events(spark, sf).groupBy(F.col("utt").alias("mat")).agg(F.count("*").alias("n")).hint("shuffle_hash")


def _matrix(spark, sf, column: str, slope: float):
    """Row t holds, within two of the diagonal, column / 97 (so that no product ends in a five) and `slope` for each place to the right."""
    e = events(spark, sf).select(F.col("utt").alias("mat"), F.col("frame").alias("row"), F.col(column).alias("_v"))
    wide = e.join(_sizes(spark, sf), "mat").withColumn("_o", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn("col", F.col("row") + F.col("_o"))
    inside = wide.where("col >= 0 and col < n")
    return inside.select("mat", "row", "col", (F.col("_v") / 97 + slope * F.col("_o")).alias("value"))


def _a(spark, sf):
    return _matrix(spark, sf, "value", 0.1)


def _b(spark, sf):
    return _matrix(spark, sf, "f0", -0.2)


def _vector(spark, sf):
    return events(spark, sf).select(F.col("utt").alias("mat"), F.col("frame").alias("idx"), (F.col("value") / 97).alias("value"))


_M = f"""{EVENTS}, n AS (SELECT utt AS mat, count(*) AS n FROM e GROUP BY utt), o AS (SELECT unnest(range(-2, 3)) AS o),
a AS (SELECT mat, frame AS "row", frame + o AS col, value/97 + 0.1*o AS value FROM e JOIN n ON mat = utt, o WHERE frame + o BETWEEN 0 AND n - 1),
b AS (SELECT mat, frame AS "row", frame + o AS col, f0/97 - 0.2*o AS value FROM e JOIN n ON mat = utt, o WHERE frame + o BETWEEN 0 AND n - 1),
x AS (SELECT utt AS mat, frame AS idx, value/97 AS value FROM e)"""


@query(f'WITH {_M} SELECT a.mat, "row", round(sum(a.value*x.value), 4) + 0.0 AS value FROM a JOIN x ON a.mat = x.mat AND a.col = x.idx GROUP BY a.mat, "row"')
def band_dot_mv(spark, sf):
    return banded.dot_mv(_a(spark, sf), _vector(spark, sf)).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT a.mat, a."row", b.col, round(sum(a.value*b.value), 4) + 0.0 AS value FROM a JOIN b ON a.mat = b.mat AND a.col = b."row" GROUP BY a.mat, a."row", b.col')
def band_dot_mm(spark, sf):
    return banded.dot_mm(_a(spark, sf), _b(spark, sf)).withColumn("value", R("value"))


@query(f"""WITH {_M} SELECT a.mat, a."row", b.col, round(sum(a.value*x.value*b.value), 4) + 0.0 AS value FROM a JOIN b ON a.mat = b.mat AND a.col = b."row" JOIN x ON x.mat = a.mat AND x.idx = a.col
WHERE abs(a."row" - b.col) <= 1 GROUP BY a.mat, a."row", b.col""")
def band_dot_mm_partial(spark, sf):
    return banded.dot_mm(_a(spark, sf), _b(spark, sf), _vector(spark, sf), (1, 1)).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT mat, "row", col, round(sum(value), 4) + 0.0 AS value FROM (SELECT * FROM a UNION ALL SELECT mat, col AS "row", "row" AS col, -2*value FROM b) GROUP BY mat, "row", col')
def band_add_transposed(spark, sf):
    return banded.add(_a(spark, sf), banded.transpose(_b(spark, sf)), -2.0).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT mat, "row", col, round(sum(value), 4) + 0.0 AS value FROM (SELECT * FROM a UNION ALL SELECT mat, "row", col, 3*value FROM b WHERE col - "row" BETWEEN -1 AND 0) GROUP BY mat, "row", col')
def band_plus_band_of(spark, sf):
    return banded.plus_band_of(_a(spark, sf), _b(spark, sf), 1, 0, 3.0).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT mat, "row", col, round(-0.5*value*n/7, 4) + 0.0 AS value FROM a JOIN n USING (mat)')
def band_times(spark, sf):
    """By a number for all matrices, then by one of each matrix."""
    by = _sizes(spark, sf).select("mat", (F.col("n") / 7).alias("factor"))
    return banded.scaled(banded.times(_a(spark, sf), -0.5), by).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT x.mat, x.idx AS "row", y.idx AS col, round(x.value*y.value, 4) + 0.0 AS value FROM x JOIN x y ON x.mat = y.mat AND y.idx - x.idx BETWEEN -1 AND 2')
def band_of_outer(spark, sf):
    v = _vector(spark, sf)
    return banded.band_of_outer(v, v, 1, 2).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT a.mat, round(sum(a.value*b.value), 4) + 0.0 AS value FROM a JOIN b ON a.mat = b.mat AND a."row" = b."row" AND a.col = b.col GROUP BY a.mat')
def trace_dot(spark, sf):
    return banded.trace_dot(_a(spark, sf), _b(spark, sf)).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT mat, 7 - ("row" - 2) + 4 AS "row", 7 - (col - 2) + 4 AS col, round(value, 4) + 0.0 AS value FROM a WHERE "row" BETWEEN 2 AND 9 AND col BETWEEN 2 AND 9')
def band_block_reverse_embed(spark, sf):
    """The principal block of rows 2 to 9, turned round and put into a larger matrix."""
    a = banded.block(_a(spark, sf), 2, 10)
    sizes = a.select("mat").distinct().withColumn("n", F.lit(8).cast("long"))
    return banded.embed(banded.reverse(a, sizes), 4).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT mat, "row", col, round(value, 4) + 0.0 AS value FROM a WHERE "row" = col')
def band_diagonal(spark, sf):
    return banded.from_diagonal(banded.diagonal(_a(spark, sf))).withColumn("value", R("value"))


@query(f"""WITH {_M}, t AS (SELECT mat, n, unnest(range(n)) AS "row" FROM n), k AS (SELECT * FROM (VALUES (-1, -0.5), (1, 0.5)) v(o, v))
SELECT mat, "row", "row" + o AS col, CAST(v AS DOUBLE) AS value FROM t, k WHERE "row" + o BETWEEN 0 AND n - 1""")
def window_matrix(spark, sf):
    return banded.window_matrix(_sizes(spark, sf), 1, (-0.5, 0.0, 0.5))


@query(f"""WITH {_M}, t AS (SELECT mat, n, unnest(range(n)) AS frame FROM n), k AS (SELECT * FROM (VALUES (0, 0, 1.0), (1, -1, -0.5), (1, 1, 0.5), (2, -1, 1.0), (2, 0, -2.0), (2, 1, 1.0)) v(w, o, v))
SELECT mat, w*n + frame AS "row", frame + o AS col, CAST(v AS DOUBLE) AS value FROM t, k WHERE frame + o BETWEEN 0 AND n - 1""")
def window_table(spark, sf):
    """The matrix of the static, delta and delta-delta windows, one below the other, for each length."""
    return paramgen.window_table(_sizes(spark, sf))


@query(f"""WITH {_M}, r AS (SELECT mat, n, unnest(range(n)) AS "row" FROM n), g AS (SELECT mat, "row", unnest(range(n)) AS col FROM r)
SELECT g.mat, g."row", g.col, round(coalesce(a.value, 0.0), 4) + 0.0 AS value FROM g LEFT JOIN a ON a.mat = g.mat AND a."row" = g."row" AND a.col = g.col""")
def band_dense(spark, sf):
    return banded.dense(_a(spark, sf), _sizes(spark, sf)).withColumn("value", R("value"))


@query(f"""WITH {_M}, s AS (SELECT mat, "row", col, value FROM b WHERE value <> 0 AND col >= "row"), u AS (SELECT mat, "row", col, value FROM a WHERE abs(col - "row") <= 1 AND value <> 0 UNION ALL SELECT * FROM s),
w AS (SELECT mat, greatest(max("row" - col), 0) AS l, greatest(max(col - "row"), 0) AS r FROM u GROUP BY mat),
t AS (SELECT n.mat, n, coalesce(l, 0) AS l, coalesce(r, 0) AS r, unnest(range(n)) AS "row" FROM n LEFT JOIN w ON w.mat = n.mat), g AS (SELECT mat, "row", unnest(range(greatest("row" - l, 0), least("row" + r, n - 1) + 1)) AS col FROM t)
SELECT g.mat, g."row", g.col, round(coalesce(s.value, 0.0), 4) + 0.0 AS value FROM g LEFT JOIN s ON s.mat = g.mat AND s."row" = g."row" AND s.col = g.col""")
def band_common(spark, sf):
    """An upper band in the narrowest band that also holds a tridiagonal matrix."""
    tri, upper = banded.from_rows(_a(spark, sf), 1, 1), banded.from_rows(_b(spark, sf), 0, 2)
    return banded.in_common_band([tri, upper], _sizes(spark, sf))[1].withColumn("value", R("value"))


@query(f"""WITH {_M}, t AS (SELECT mat, unnest(range(n)) AS idx FROM n), g AS (SELECT mat, idx, unnest(range(4)) AS diagonal FROM t)
SELECT g.mat, CAST(g.diagonal AS BIGINT) AS diagonal, g.idx, round(coalesce(a.value, 0.0), 4) + 0.0 AS value FROM g LEFT JOIN a ON a.mat = g.mat AND a.col = g.idx AND a."row" - a.col + 2 = g.diagonal""")
def band_as_diagonals(spark, sf):
    return banded.as_diagonals(_a(spark, sf), _sizes(spark, sf), 1, 2).withColumn("value", R("value"))


@query(f'WITH {_M} SELECT mat, "row", col, round(value, 4) + 0.0 AS value FROM a WHERE col - "row" BETWEEN -1 AND 2')
def band_layout_round_trip(spark, sf):
    """A band as diagonals by row, and back."""
    sizes = _sizes(spark, sf)
    return banded.from_diagonals(banded.as_diagonals(_a(spark, sf), sizes, 1, 2, "row"), sizes, 2, "row").withColumn("value", R("value"))


_BLOCKS = """f AS (SELECT mat, n - (n - 3) % 2 AS n FROM n WHERE n >= 3), w AS (SELECT mat, unnest(range((n - 3) // 2 + 1)) AS w FROM f),
s AS (SELECT a.mat, w AS "window", a."row" - 2*w AS "row", a.col - 2*w AS col, value FROM w JOIN a ON a.mat = w.mat AND a."row" BETWEEN 2*w AND 2*w + 2 AND a.col BETWEEN 2*w AND 2*w + 2)"""


def _blocks(spark, sf):
    """Blocks of 3 by 3 every 2, of matrices cut to a size that they fill."""
    n = F.col("n") - F.pmod(F.col("n") - 3, F.lit(2))
    sizes = _sizes(spark, sf).where("n >= 3").select("mat", n.alias("n"))
    return banded.sliding(_a(spark, sf), sizes, 3, 2)


@query(f'WITH {_M}, {_BLOCKS} SELECT mat, "window", "row", col, round(value, 4) + 0.0 AS value FROM s')
def matrix_windows(spark, sf):
    return _blocks(spark, sf).withColumn("value", R("value"))


@query(f'WITH {_M}, {_BLOCKS} SELECT mat, "row" + 2*"window" AS "row", col + 2*"window" AS col, round(sum(value), 4) + 0.0 AS value FROM s GROUP BY ALL')
def matrix_overlap_add(spark, sf):
    return banded.overlap_add(_blocks(spark, sf), 2).withColumn("value", R("value"))


#: Symmetric tridiagonal matrices: 3 + value / 1000 on the diagonal, -1 beside it. d, l: their factors; v: right sides.
_TRI = f"""{EVENTS}, v AS (SELECT utt AS mat, frame AS i, count(*) OVER (PARTITION BY utt) AS n, 3 + value/1000 AS a, f0/100 AS b FROM e),
f(mat, i, n, d, l, z) AS (SELECT mat, i, n, sqrt(a), CAST(0 AS DOUBLE), b/sqrt(a) FROM v WHERE i = 0
  UNION ALL SELECT v.mat, v.i, v.n, sqrt(a - 1/(f.d*f.d)), -1/f.d, (b + f.z/f.d)/sqrt(a - 1/(f.d*f.d)) FROM f JOIN v ON v.mat = f.mat AND v.i = f.i + 1),
g AS (SELECT *, lead(l, 1, 0) OVER (PARTITION BY mat ORDER BY i) AS up FROM f),
x(mat, i, x, t) AS (SELECT mat, i, z/d, 1/(d*d) FROM g WHERE i = n - 1 UNION ALL SELECT g.mat, g.i, (z - up*x.x)/d, 1/(d*d) + up*up/(d*d)*x.t FROM x JOIN g ON g.mat = x.mat AND g.i = x.i - 1)"""


def _tridiagonal(spark, sf):
    e = events(spark, sf).select(F.col("utt").alias("mat"), F.col("frame").alias("row"), "value")
    diagonal = e.select("mat", "row", F.col("row").alias("col"), (3 + F.col("value") / 1000).alias("value"))
    return diagonal.unionByName(e.where("row > 0").select("mat", "row", (F.col("row") - 1).alias("col"), F.lit(-1.0).alias("value")))


def _right(spark, sf):
    return events(spark, sf).select(F.col("utt").alias("mat"), F.col("frame").alias("idx"), (F.col("f0") / 100).alias("value"))


@query(f'WITH RECURSIVE {_TRI} SELECT mat, i AS "row", i AS col, round(d, 6) + 0.0 AS value FROM f UNION ALL SELECT mat, i, i - 1, round(l, 6) FROM f WHERE i > 0')
def band_cholesky(spark, sf):
    return banded.cholesky(_tridiagonal(spark, sf), _sizes(spark, sf), 1).withColumn("value", R("value", 6))


@query(ORACLE_SQL["band_cholesky"])
def band_cholesky_blocks(spark, sf):
    """Matrices cut into blocks of 8 rows, as very large ones are."""
    return longbands.cholesky(_tridiagonal(spark, sf), _sizes(spark, sf), 1, block=8).withColumn("value", R("value", 6))


@query(f"WITH RECURSIVE {_TRI} SELECT mat, i AS idx, round(x, 6) + 0.0 AS value FROM x")
def band_solve(spark, sf):
    return banded.solve(_tridiagonal(spark, sf), _right(spark, sf), _sizes(spark, sf), 1).withColumn("value", R("value", 6))


@query(ORACLE_SQL["band_solve"])
def band_solve_blocks(spark, sf):
    return longbands.solve(_tridiagonal(spark, sf), _right(spark, sf), _sizes(spark, sf), 1, block=8).withColumn("value", R("value", 6))


@query(f"WITH RECURSIVE {_TRI} SELECT mat, i AS idx, round(z, 6) + 0.0 AS value FROM f")
def band_solve_triangular(spark, sf):
    sizes = _sizes(spark, sf)
    factor = banded.cholesky(_tridiagonal(spark, sf), sizes, 1)
    return banded.solve_triangular(factor, _right(spark, sf), sizes, 1).withColumn("value", R("value", 6))


@query(ORACLE_SQL["band_solve_triangular"])
def band_solve_triangular_blocks(spark, sf):
    sizes = _sizes(spark, sf)
    factor = longbands.cholesky(_tridiagonal(spark, sf), sizes, 1, block=8)
    return longbands.solve_triangular(factor, _right(spark, sf), sizes, 1, block=8).withColumn("value", R("value", 6))


@query(f"WITH RECURSIVE {_TRI} SELECT mat, i AS idx, round(x, 6) + 0.0 AS value FROM x")
def band_solve_both_triangles(spark, sf):
    """A lower system, then the transposed one: together they solve the whole."""
    sizes = _sizes(spark, sf)
    factor = banded.cholesky(_tridiagonal(spark, sf), sizes, 1)
    half = banded.solve_triangular(factor, _right(spark, sf), sizes, 1)
    return banded.solve_triangular(factor, half, sizes, 1, transposed=True).withColumn("value", R("value", 6))


@query(f"""WITH RECURSIVE {_TRI}, h AS (SELECT x.mat, x.i, t, lead(t, 1, 0) OVER (PARTITION BY x.mat ORDER BY x.i) AS t1, up, d, n FROM x JOIN g ON g.mat = x.mat AND g.i = x.i)
SELECT mat, i AS "row", i AS col, round(t, 6) + 0.0 AS value FROM h UNION ALL SELECT mat, i + 1, i, round(-up/d*t1, 6) + 0.0 FROM h WHERE i < n - 1""")
def band_of_inverse(spark, sf):
    return banded.inverse_band(_tridiagonal(spark, sf), _sizes(spark, sf), 1, 1).withColumn("value", R("value", 6))


@query(f"""WITH RECURSIVE {_TRI}, h AS (SELECT x.mat, x.i, t, sum(CASE WHEN x.i > 0 THEN ln(-l/lag_d) ELSE 0 END) OVER (PARTITION BY x.mat ORDER BY x.i) AS s FROM x JOIN (SELECT *, lag(d) OVER (PARTITION BY mat ORDER BY i) AS lag_d FROM g) g ON g.mat = x.mat AND g.i = x.i)
SELECT p.mat, p.i AS "row", q.i AS col, round(p.t*exp(p.s - q.s), 6) + 0.0 AS value FROM h p JOIN h q ON q.mat = p.mat AND q.i <= p.i""")
def full_inverse(spark, sf):
    return banded.inverse(_tridiagonal(spark, sf), _sizes(spark, sf), 1).withColumn("value", R("value", 6))
