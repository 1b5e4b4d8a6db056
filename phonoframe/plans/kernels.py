"""Queries whose kernels run per utterance: parameter generation, spectra, alignment, mapping, post-filter.

Their SQL says the same by other means: recursions along the frames for banded
systems, sums of cosines and sines for transforms, closed forms for mixtures.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from phonoframe.functions.windows import DEFAULT
from phonoframe.operators import alignment, gmm, longbands, mixtures, paramgen, postfilter, sequence, spectral
from phonoframe.plans.registry import ORACLE_SQL, query
from phonoframe.plans.tables import EVENTS, events, table

#: Rounded, and never -0.
R = lambda c, n=4: F.round(c, n) + 0.0


def _dynamic(spark, sf):
    """(utt, frame, means, variances, gradient): static, delta and delta-delta of the events."""
    e = events(spark, sf)
    for name, window in zip("abc", DEFAULT, strict=True):
        e = sequence.delta(e, "value", name, window)
    return e.select("utt", "frame", F.array("a", "b", "c").alias("means"), F.array(F.lit(1.0), 0.1 + F.col("frame") % 3, F.lit(0.5)).alias("variances"), F.array("value").alias("gradient"))


#: d: means and precisions (t0, t1, t2) of each frame; dynamic windows count nothing on the first and the last frame.
_MEANS = f"""{EVENTS}, w AS (SELECT utt, frame, value, lag(value, 1, 0) OVER o AS p, lead(value, 1, 0) OVER o AS q, count(*) OVER (PARTITION BY utt) AS n FROM e WINDOW o AS (PARTITION BY utt ORDER BY frame)),
d AS (SELECT utt, frame, n, value AS m0, 0.5*q - 0.5*p AS m1, p - 2*value + q AS m2, 1/CAST({{v0}} AS DOUBLE) AS t0,
  CASE WHEN frame IN (0, n-1) THEN 0 ELSE 1/CAST({{v1}} AS DOUBLE) END AS t1, CASE WHEN frame IN (0, n-1) THEN 0 ELSE 1/CAST({{v2}} AS DOUBLE) END AS t2, value FROM w)"""

#: s: the bands a, b, c (0, 1 and 2 below the diagonal) and the right side r of each row; x: the solution, by elimination forward and substitution backward.
_SOLVED = """b0 AS (SELECT utt, frame, n, {right} AS r,
  t0 + 0.25*(lag(t1, 1, 0) OVER o + lead(t1, 1, 0) OVER o) + lag(t2, 1, 0) OVER o + 4*t2 + lead(t2, 1, 0) OVER o AS a,
  -2*(lag(t2, 1, 0) OVER o + t2) AS b, lag(t2, 1, 0) OVER o - 0.25*lag(t1, 1, 0) OVER o AS c FROM d WINDOW o AS (PARTITION BY utt ORDER BY frame)),
f(utt, frame, n, l1, l2, d, dp, z, zp) AS (SELECT utt, frame, n, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(a AS DOUBLE), CAST(1 AS DOUBLE), CAST(r AS DOUBLE), CAST(0 AS DOUBLE) FROM b0 WHERE frame = 0
  UNION ALL SELECT y.utt, y.frame, y.n, k1, k2, a - k1*k1*d - k2*k2*dp, d, r - k1*z - k2*zp, z FROM (
    SELECT b0.utt, b0.frame, b0.n, a, r, f.d, f.dp, f.z, f.zp, CASE WHEN b0.frame >= 2 THEN c/f.dp ELSE 0 END AS k2,
      (b - CASE WHEN b0.frame >= 2 THEN c*f.l1 ELSE 0 END)/f.d AS k1 FROM f JOIN b0 ON b0.utt = f.utt AND b0.frame = f.frame + 1) y),
h AS (SELECT utt, frame, n, z/d AS g, lead(l1, 1, 0) OVER o AS u1, lead(l2, 2, 0) OVER o AS u2 FROM f WINDOW o AS (PARTITION BY utt ORDER BY frame)),
x(utt, frame, y, y1) AS (SELECT utt, frame, g, CAST(0 AS DOUBLE) FROM h WHERE frame = n - 1
  UNION ALL SELECT h.utt, h.frame, g - u1*x.y - u2*x.y1, x.y FROM x JOIN h ON h.utt = x.utt AND h.frame = x.frame - 1)"""

_RIGHT = "t0*m0 + 0.5*lag(t1*m1, 1, 0) OVER o - 0.5*lead(t1*m1, 1, 0) OVER o + lag(t2*m2, 1, 0) OVER o - 2*t2*m2 + lead(t2*m2, 1, 0) OVER o"
_OWN, _UNIT = {"v0": "1", "v1": "0.1 + frame % 3", "v2": "0.5"}, {"v0": "1", "v1": "1", "v2": "1"}


@query(f"WITH RECURSIVE {_MEANS.format(**_OWN)}, {_SOLVED.format(right=_RIGHT)} SELECT utt, frame, round(y, 4) + 0.0 AS y FROM x")
def mlpg(spark, sf):
    return paramgen.mlpg(_dynamic(spark, sf)).select("utt", "frame", R(F.col("features")[0]).alias("y"))


@query(ORACLE_SQL["mlpg"])
def mlpg_blocks(spark, sf):
    """Utterances cut into blocks of 16 frames, as very long ones are."""
    return longbands.mlpg(_dynamic(spark, sf), block=16, gathered=True).select("utt", "frame", R(F.col("features")[0]).alias("y"))


@query(f"""WITH RECURSIVE {_MEANS.format(**_OWN)}, {_SOLVED.format(right="value")},
g AS (SELECT x.utt, x.frame, y, lag(y, 1, 0) OVER o AS p, lead(y, 1, 0) OVER o AS q, t0, t1, t2 FROM x JOIN d ON d.utt = x.utt AND d.frame = x.frame WINDOW o AS (PARTITION BY x.utt ORDER BY x.frame))
SELECT utt, frame, round(t0*y, 4) + 0.0 AS a, round(t1*(0.5*q - 0.5*p), 4) + 0.0 AS b, round(t2*(p - 2*y + q), 4) + 0.0 AS c FROM g""")
def mlpg_gradient(spark, sf):
    return paramgen.mlpg_gradient(_dynamic(spark, sf)).select("utt", "frame", *[R(F.col("features")[k]).alias(c) for k, c in enumerate("abc")])


@query(ORACLE_SQL["mlpg_gradient"])
def mlpg_gradient_blocks(spark, sf):
    return longbands.mlpg_gradient(_dynamic(spark, sf), block=16, gathered=True).select("utt", "frame", *[R(F.col("features")[k]).alias(c) for k, c in enumerate("abc")])


def _rows(spark, sf):
    e = _dynamic(spark, sf).select("utt", "frame", F.posexplode("means").alias("dim", "value"))
    return sequence.reshape_means(e.withColumn("dim", F.col("dim").cast("long")), 1)


@query(f"WITH RECURSIVE {_MEANS.format(**_UNIT)}, {_SOLVED.format(right=_RIGHT)} SELECT utt, frame, CAST(0 AS BIGINT) AS dim, round(y, 4) + 0.0 AS value FROM x")
def unit_variance_mlpg(spark, sf):
    """Every utterance at its own length."""
    return paramgen.unit_variance_mlpg(_rows(spark, sf)).withColumn("value", R("value"))


@query(f"""WITH RECURSIVE {_MEANS.format(**_UNIT)}, {_SOLVED.format(right="value")},
g AS (SELECT x.utt, x.frame, d.n, y, lag(y, 1, 0) OVER o AS p, lead(y, 1, 0) OVER o AS q, t1, t2 FROM x JOIN d ON d.utt = x.utt AND d.frame = x.frame WINDOW o AS (PARTITION BY x.utt ORDER BY x.frame))
SELECT utt, frame AS "row", CAST(0 AS BIGINT) AS dim, round(y, 4) + 0.0 AS value FROM g UNION ALL SELECT utt, frame + n, 0, round(t1*(0.5*q - 0.5*p), 4) + 0.0 FROM g UNION ALL SELECT utt, frame + 2*n, 0, round(t2*(p - 2*y + q), 4) + 0.0 FROM g""")
def unit_variance_gradient(spark, sf):
    """The transposed form: gradients by trajectories become gradients by reshaped means."""
    g = events(spark, sf).select("utt", "frame", F.lit(0).cast("long").alias("dim"), "value")
    return paramgen.unit_variance_mlpg(g, transposed=True).withColumn("value", R("value"))


def _features(spark, sf):
    return events(spark, sf).select("utt", "frame", F.array(F.col("value") / 100, F.col("f0") / 100).alias("features"))


def transform_length(frames) -> int:
    """A power of two that no utterance is longer than, 256 at least."""
    longest = (frames.agg(F.max("frame")).first()[0] or 0) + 1
    return max(256, 1 << (longest - 1).bit_length())


_LENGTH = "k AS (SELECT CAST(greatest(256, pow(2, ceil(log2(max(frame) + 1)))) AS BIGINT) AS n FROM e)"
#: z: the transform of value / 100; every frame counts.
_DFT = f"""{EVENTS}, {_LENGTH}, j AS (SELECT n, unnest(range(n // 2 + 1)) AS bin FROM k),
z AS (SELECT utt, bin, sum(value/100*cos(2*pi()*(frame*bin % n)/n)) AS re, -sum(value/100*sin(2*pi()*(frame*bin % n)/n)) AS im FROM e, j GROUP BY utt, bin)"""


@query(f"WITH {_DFT} SELECT utt, bin, round(re*re + im*im, 3) + 0.0 AS power, round(re/sqrt(re*re + im*im), 4) + 0.0 AS re, round(im/sqrt(re*re + im*im), 4) + 0.0 AS im FROM z")
def modspec_phase(spark, sf):
    x = _features(spark, sf)
    m = spectral.modspec(x, transform_length(x))
    return m.select("utt", "bin", R(F.col("power")[0], 3).alias("power"), R(F.col("re")[0]).alias("re"), R(F.col("im")[0]).alias("im"))


@query(f"""WITH {EVENTS}, {_LENGTH}, g AS (SELECT u.utt, unnest(range(n)) AS frame FROM (SELECT DISTINCT utt FROM e) u, k)
SELECT g.utt, g.frame, round(coalesce(value, 0.0)/100, 4) AS y FROM g LEFT JOIN e ON e.utt = g.utt AND e.frame = g.frame""")
def modspec_round_trip(spark, sf):
    x = _features(spark, sf)
    return spectral.inv_modspec(spectral.modspec(x, transform_length(x))).select("utt", "frame", R(F.col("features")[0]).alias("y"))


def _smoothed_sql(above: str) -> str:
    return f"""WITH {_DFT}, s AS (SELECT utt, bin, n, CASE WHEN bin <= floor(n*50/200.0) THEN re ELSE {above.format("re")} END AS re, CASE WHEN bin <= floor(n*50/200.0) THEN im ELSE {above.format("im")} END AS im FROM z, k)
SELECT e.utt, e.frame, round(sum((CASE WHEN bin IN (0, n // 2) THEN 1 ELSE 2 END)*(re*cos(2*pi()*(frame*bin % n)/n) - im*sin(2*pi()*(frame*bin % n)/n)))/max(n), 4) + 0.0 AS y FROM e JOIN s ON s.utt = e.utt GROUP BY e.utt, e.frame"""


@query(_smoothed_sql("{}/sqrt(re*re + im*im)"))
def modspec_smoothing(spark, sf):
    x = _features(spark, sf)
    return spectral.smoothed(x, 200, transform_length(x), 50).select("utt", "frame", R(F.col("features")[0]).alias("y"))


@query(_smoothed_sql("0"))
def modspec_smoothing_linear(spark, sf):
    x = _features(spark, sf)
    return spectral.smoothed(x, 200, transform_length(x), 50, log_domain=False).select("utt", "frame", R(F.col("features")[0]).alias("y"))


@query(f"""WITH {_DFT} SELECT e.utt, e.frame, round(2*sum(cos(bin)*(re*cos(2*pi()*(frame*bin % n)/n) - im*sin(2*pi()*(frame*bin % n)/n))), 3) + 0.0 AS y FROM e JOIN z ON z.utt = e.utt, k GROUP BY e.utt, e.frame""")
def modspec_gradient(spark, sf):
    """From gradients by the powers, cos(bin) here, back to the frames."""
    e = events(spark, sf)
    n = transform_length(e)
    bins = e.select("utt").distinct().select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n // 2).cast("long"))).alias("frame"))
    both = bins.join(e.select("utt", "frame", (F.col("value") / 100).alias("v")), ["utt", "frame"], "left")
    x = both.select("utt", "frame", F.array(F.coalesce("v", F.lit(0.0))).alias("features"), F.array(F.cos(F.col("frame"))).alias("gradient"))
    got = spectral.modspec_gradient(x, n)
    return got.join(e.select("utt", "frame"), ["utt", "frame"], "left_semi").select("utt", "frame", R(F.col("features")[0], 3).alias("y"))


@query()
def dtw_paths(spark, sf):
    """Every utterance aligned with its successor, approximately."""
    x = _features(spark, sf)
    return alignment.paths(x, x.withColumn("utt", F.col("utt") - 1))


#: c: the least cost of row i as a list over the columns; a row's recursion is a running minimum.
_DTW = f"""{EVENTS}, v AS (SELECT utt, frame, value/100 AS a, f0/100 AS b FROM e),
x AS (SELECT v.utt, list(a ORDER BY frame) AS a, list(b ORDER BY frame) AS b FROM v GROUP BY utt),
t AS (SELECT x.utt, x.a AS a, x.b AS b, y.a AS c, y.b AS d FROM x JOIN x y ON y.utt = x.utt + 1),
s(utt, i, cost) AS (SELECT utt, CAST(0 AS BIGINT), list_prepend(CAST(0 AS DOUBLE), list_transform(c, lambda z: CAST('inf' AS DOUBLE))) FROM t
  UNION ALL SELECT utt, i + 1, list_prepend(CAST('inf' AS DOUBLE), list_reduce(list_prepend([CAST('inf' AS DOUBLE)], list_transform(range(1, len(c) + 1), lambda j: [least(cost[j], cost[j + 1]), sqrt(pow(a[i + 1] - c[j], 2) + pow(b[i + 1] - d[j], 2))])),
    lambda acc, p: list_append(acc, least(p[1], acc[len(acc)]) + p[2]))[2:]) FROM (SELECT s.utt, s.i, s.cost, t.a, t.b, t.c, t.d FROM s JOIN t ON t.utt = s.utt AND s.i < len(t.a)))"""


@query(f"WITH RECURSIVE {_DTW} SELECT s.utt, round(cost[len(cost)]/(len(a) + len(c)), 5) AS distance FROM s JOIN t ON t.utt = s.utt AND s.i = len(t.a)")
def dtw_distance(spark, sf):
    """The exact distance of every utterance to its successor."""
    x = _features(spark, sf)
    y = x.withColumn("utt", F.col("utt") - 1)
    return alignment.paths(x, y, exact=True).groupBy("utt").agg(F.first("distance").alias("distance")).select("utt", F.round("distance", 5).alias("distance"))


@query(ORACLE_SQL["dtw_distance"])
def dtw_aligned_cost(spark, sf):
    """The distances of the frames that exact paths bring together, added up: the least cost."""
    x = _features(spark, sf)
    y = x.withColumn("utt", F.col("utt") - 1)
    path = alignment.paths(x, y, exact=True)
    far = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    cost = alignment.aligned(path, x, y).groupBy("utt").agg(F.sum(far).alias("cost"))
    # An utterance's trailing silence isn't aligned: lengths end with the path.
    ends = path.groupBy("utt").agg((F.max("x_frame") + F.max("y_frame") + 2).alias("n"))
    return cost.join(ends, "utt").select("utt", F.round(F.col("cost") / F.col("n"), 5).alias("distance"))


def _mixture(**how) -> gmm.JointMixture:
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 4, 8))
    return gmm.JointMixture(np.array([0.5, 0.3, 0.2]), rng.normal(size=(3, 4)) * 2, a @ a.transpose(0, 2, 1) / 8 + np.eye(4), **how)


def _mixture_sql(diff: bool = False) -> str:
    """y0, y1 of each frame: conditional means, weighed by the components' shares. Constants of the mixture are written out."""
    m = _mixture()
    d, terms = 2, []
    for k in range(3):
        mean, cov = m.means[k], m.covariances[k]
        x, y, xx, yx = mean[:d], mean[d:], cov[:d, :d], cov[d:, :d]
        if diff:
            y, yx = y - x, (cov[:d, d:] - xx).T
        inverse, slope = np.linalg.inv(xx), yx @ np.linalg.inv(xx)
        g = [f"(x{i} - ({x[i]!r}))" for i in range(d)]
        form = " + ".join(f"({inverse[i, j]!r})*{g[i]}*{g[j]}" for i in range(d) for j in range(d))
        terms.append((f"({float(np.log(m.weights[k]) - 0.5 * np.log(np.linalg.det(xx)))!r}) - 0.5*({form})", [f"({y[i]!r}) + " + " + ".join(f"({slope[i, j]!r})*{g[j]}" for j in range(d)) for i in range(d)]))
    text = lambda s: s.replace("np.float64(", "(")
    logs = ", ".join(f"{text(t)} AS l{k}" for k, (t, _) in enumerate(terms))
    share = "exp(l{0} - greatest(l0, l1, l2))"
    total = " + ".join(share.format(k) for k in range(3))
    ys = ", ".join(f"round(({' + '.join(share.format(k) + f'*({text(terms[k][1][i])})' for k in range(3))})/({total}), 5) + 0.0 AS y{i}" for i in range(d))
    return f"WITH {EVENTS}, v AS (SELECT utt, frame, value/100 AS x0, f0/100 AS x1 FROM e), l AS (SELECT *, {logs} FROM v) SELECT utt, frame, {ys} FROM l"


def _two(df):
    return df.select("utt", "frame", *[R(F.col("features")[k], 5).alias(f"y{k}") for k in range(2)])


@query(_mixture_sql())
def gmm_mapping(spark, sf):
    return _two(gmm.mapped(_features(spark, sf), _mixture()))


@query(_mixture_sql(diff=True))
def gmm_difference(spark, sf):
    """The mapping to what the target is above the source."""
    return _two(gmm.mapped(_features(spark, sf), _mixture(diff=True)))


def _dynamic_mixture() -> gmm.JointMixture:
    """Sources and targets of three windows; sources and targets are correlated dimension by dimension."""
    rng = np.random.default_rng(1)
    cov = np.stack([np.diag(rng.uniform(1, 2, 6)) for _ in range(2)])
    for k in range(3):
        cov[:, k, k + 3] = cov[:, k + 3, k] = rng.uniform(0.2, 0.6)
    return gmm.JointMixture(np.array([0.6, 0.4]), rng.normal(size=(2, 6)) * 2, cov)


def _trajectory_sql() -> str:
    m = _dynamic_mixture()
    logs, means, variances = [], [], []
    for k in range(2):
        x, y, c = m.means[k, :3], m.means[k, 3:], m.covariances[k]
        var, cross, own = np.diag(c)[:3], np.array([c[i, i + 3] for i in range(3)]), np.diag(c)[3:]
        logs.append(f"{float(np.log(m.weights[k]) - 0.5 * np.log(var).sum())!r} - 0.5*(" + " + ".join(f"pow(f{i} - ({float(x[i])!r}), 2)/{float(var[i])!r}" for i in range(3)) + ")")
        means.append([f"({float(y[i])!r}) + {float(cross[i] / var[i])!r}*(f{i} - ({float(x[i])!r}))" for i in range(3)])
        variances.append([float(own[i] - cross[i] ** 2 / var[i]) for i in range(3)])
    pick = lambda a, b: f"CASE WHEN {logs[0]} >= {logs[1]} THEN {a} ELSE {b} END"
    m_ = ", ".join(f"{pick(means[0][i], means[1][i])} AS m{i}" for i in range(3))
    t_ = ", ".join(f"{'CASE WHEN frame IN (0, n-1) THEN 0 ELSE ' if i else ''}1/({pick(variances[0][i], variances[1][i])}){' END' if i else ''} AS t{i}" for i in range(3))
    own = f"""{EVENTS}, w AS (SELECT utt, frame, value/100 AS value, lag(value/100, 1, 0) OVER o AS p, lead(value/100, 1, 0) OVER o AS q, count(*) OVER (PARTITION BY utt) AS n FROM e WINDOW o AS (PARTITION BY utt ORDER BY frame)),
v AS (SELECT utt, frame, n, value AS f0, 0.5*q - 0.5*p AS f1, p - 2*value + q AS f2 FROM w), d AS (SELECT utt, frame, n, {m_}, {t_} FROM v)"""
    return f"WITH RECURSIVE {own}, {_SOLVED.format(right=_RIGHT)} SELECT utt, frame, round(y, 4) + 0.0 AS y FROM x"


@query(_trajectory_sql())
def gmm_trajectory(spark, sf):
    """Conversion by trajectories: each frame under its likeliest component, dynamic features included."""
    e = events(spark, sf).withColumn("value", F.col("value") / 100)
    for name, window in zip("abc", DEFAULT, strict=True):
        e = sequence.delta(e, "value", name, window)
    frames = e.select("utt", "frame", F.array("a", "b", "c").alias("features"))
    return gmm.converted(frames, _dynamic_mixture(), DEFAULT).select("utt", "frame", R(F.col("features")[0]).alias("y"))


def _joint(spark, sf):
    """(vec_id, features): the first two numbers of each embedding, a source and its target."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.array(e[0].cast("double"), e[1].cast("double")).alias("features"))


#: p0: the start of two components; p1, p2: after one and two rounds of expectation maximisation.
_FITTED = "e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), p0 AS (SELECT k AS component, 0.5::DOUBLE AS w, avg(x) + stddev_pop(x)*(k - 0.5) AS m0, avg(y) + stddev_pop(y)*(k - 0.5) AS m1, var_pop(x) + 1e-6 AS c00, 0::DOUBLE AS c01, var_pop(y) + 1e-6 AS c11 FROM e, (SELECT unnest(range(2)) AS k) GROUP BY k)" + "".join(f""",
l{k} AS (SELECT vec_id, x, y, component, w/sqrt(c00*c11 - c01*c01)*exp(-0.5*(c11*(x-m0)*(x-m0) - 2*c01*(x-m0)*(y-m1) + c00*(y-m1)*(y-m1))/(c00*c11 - c01*c01)) AS d FROM e, p{k - 1}),
r{k} AS (SELECT *, d/sum(d) OVER (PARTITION BY vec_id) AS r FROM l{k}),
p{k} AS (SELECT component, sum(r)/(SELECT count(*) FROM e) AS w, sum(r*x)/sum(r) AS m0, sum(r*y)/sum(r) AS m1, sum(r*x*x)/sum(r) - pow(sum(r*x)/sum(r), 2) + 1e-6 AS c00,
  sum(r*x*y)/sum(r) - sum(r*x)*sum(r*y)/pow(sum(r), 2) AS c01, sum(r*y*y)/sum(r) - pow(sum(r*y)/sum(r), 2) + 1e-6 AS c11 FROM r{k} GROUP BY component)""" for k in (1, 2))


@query(f"WITH {_FITTED} SELECT component, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in ('w', 'm0', 'm1', 'c00', 'c01', 'c11'))} FROM p1")
def gmm_step(spark, sf):
    """One round of expectation maximisation over all embeddings, from a start that their means and variances decide."""
    x = _joint(spark, sf)
    got = mixtures.stepped(x, mixtures.start(x, 2))
    m, c = F.col("mean"), F.col("covariance")
    return got.select("component", *[R(v, 5).alias(n) for n, v in (("w", F.col("weight")), ("m0", m[0]), ("m1", m[1]), ("c00", c[0]), ("c01", c[1]), ("c11", c[3]))])


@query(f"WITH {_FITTED}, t AS (SELECT vec_id, w/sqrt(c00)*exp(-0.5*(x-m0)*(x-m0)/c00) AS s, m1 + c01/c00*(x-m0) AS y FROM e, p2) SELECT vec_id, round(sum(s*y)/sum(s), 4) + 0.0 AS y FROM t GROUP BY vec_id")
def gmm_fitted_mapping(spark, sf):
    """The target's expectation by a mixture fitted to the embeddings in two rounds."""
    x = _joint(spark, sf)
    mixture = mixtures.fit(x, 2, rounds=2, close=-1.0)
    frames = x.select(F.col("vec_id").alias("utt"), F.lit(0).alias("frame"), F.slice("features", 1, 1).alias("features"))
    return gmm.mapped(frames, mixture).select(F.col("utt").alias("vec_id"), R(F.col("features")[0]).alias("y"))


#: Spectra of warped cepstra are sums of cosines at warped frequencies.
@query("""WITH c AS (SELECT vec_id, unnest(range(len(embedding))) AS m, unnest(embedding)::DOUBLE AS c FROM embeddings),
k AS (SELECT bin, 2*pi()*bin/1024 AS w, w + 2*atan2(0.42*sin(w), 1 - 0.42*cos(w)) AS b FROM (SELECT unnest(range(513)) AS bin)),
s AS (SELECT vec_id, bin, sum(c*cos(m*b)) AS x, sum(CASE WHEN m >= 2 THEN 1.4*c ELSE c END*cos(m*b)) AS y FROM c, k GROUP BY vec_id, bin),
g AS (SELECT vec_id, sum((CASE WHEN bin IN (0, 512) THEN 1 ELSE 2 END)*exp(2*x)) AS a, sum((CASE WHEN bin IN (0, 512) THEN 1 ELSE 2 END)*exp(2*y)) AS b FROM s GROUP BY vec_id)
SELECT c.vec_id, CAST(m AS BIGINT) AS dim, round(CASE WHEN m >= 2 THEN 1.4*c WHEN m = 0 THEN c + ln(a/b)/2 ELSE c END, 4) + 0.0 AS y FROM c JOIN g ON g.vec_id = c.vec_id""")
def post_filter(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("utt"), F.lit(0).cast("long").alias("frame"), F.col("embedding").cast("array<double>").alias("features"))
    out = postfilter.post_filter(e, 0.42).select(F.col("utt").alias("vec_id"), F.posexplode("features").alias("dim", "y"))
    return out.select("vec_id", F.col("dim").cast("long").alias("dim"), R("y").alias("y"))
