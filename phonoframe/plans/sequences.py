"""Queries along frames: filters, deltas, trimming, interpolation, lengths, windows, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from phonoframe.functions import scalar
from phonoframe.functions.windows import DELTA, DELTA2, STATIC, WIDE_DELTA
from phonoframe.operators import datasets, metrics, sequence
from phonoframe.plans.registry import ORACLE_SQL, query
from phonoframe.plans.tables import EVENTS, PAIRS, events, pairs
from phonoframe.session import shared_folder
from phonoframe.streaming import windows as stream_windows

R = lambda c, n=6: F.round(c, n)
_KEYS = ["utt", "frame"]


@query(f"WITH {EVENTS} SELECT utt, frame, round(sign(value/500)*ln(1+256*abs(value/500))/ln(257), 6) AS y FROM e")
def mulaw(spark, sf):
    return events(spark, sf).select(*_KEYS, R(scalar.mulaw(F.col("value") / 500)).alias("y"))


@query(f"WITH {EVENTS} SELECT utt, frame, round(sign(value/500)*(pow(257.0, abs(value/500))-1)/256, 6) AS y FROM e")
def inv_mulaw(spark, sf):
    return events(spark, sf).select(*_KEYS, R(scalar.inv_mulaw(F.col("value") / 500)).alias("y"))


@query(f"WITH {EVENTS} SELECT utt, frame, CAST(floor((ln(1+256*(value/500))/ln(257)+1)/2*256) AS INTEGER) AS y FROM e")
def mulaw_quantize(spark, sf):
    return events(spark, sf).select(*_KEYS, scalar.mulaw_quantize(F.col("value") / 500).alias("y"))


@query(f"WITH {EVENTS}, q AS (SELECT utt, frame, 2*(CAST(floor(value) AS BIGINT)%257)/256.0-1 AS z FROM e) SELECT utt, frame, round(sign(z)*(pow(257.0, abs(z))-1)/256, 6) AS y FROM q")
def inv_mulaw_quantize(spark, sf):
    return events(spark, sf).select(*_KEYS, R(scalar.inv_mulaw_quantize(F.floor("value") % 257)).alias("y"))


@query(f"WITH {EVENTS} SELECT utt, frame, round(value - 0.97*coalesce(lag(value) OVER (PARTITION BY utt ORDER BY frame), 0), 6) AS y FROM e")
def preemphasis(spark, sf):
    return sequence.preemphasis(events(spark, sf), "value", "y").select(*_KEYS, R("y").alias("y"))


@query(f"""WITH RECURSIVE {EVENTS}, r(utt, frame, y) AS (SELECT utt, frame, value FROM e WHERE frame = 0
UNION ALL SELECT e.utt, e.frame, e.value + 0.97*r.y FROM r JOIN e ON e.utt = r.utt AND e.frame = r.frame + 1) SELECT utt, frame, round(y, 4) AS y FROM r""")
def inv_preemphasis(spark, sf):
    return sequence.inv_preemphasis(events(spark, sf), "value", "y").select(*_KEYS, R("y", 4).alias("y"))


_LAG = "coalesce({f}(value, {n}) OVER (PARTITION BY utt ORDER BY frame), 0)"


def _delta_sql(taps: dict[int, str]) -> str:
    terms = [f"({t})*" + ("value" if o == 0 else _LAG.format(f="lead" if o > 0 else "lag", n=abs(o))) for o, t in taps.items()]
    return f"WITH {EVENTS} SELECT utt, frame, round({' + '.join(terms)}, 5) AS y FROM e"


def _delta(spark, sf, window):
    return sequence.delta(events(spark, sf), "value", "y", window).select(*_KEYS, R("y", 5).alias("y"))


@query(_delta_sql({0: "1.0"}))
def delta_static(spark, sf):
    return _delta(spark, sf, STATIC)


@query(_delta_sql({-1: "-0.5", 1: "0.5"}))
def delta(spark, sf):
    return _delta(spark, sf, DELTA)


@query(_delta_sql({-1: "1.0", 0: "-2.0", 1: "1.0"}))
def delta_delta(spark, sf):
    return _delta(spark, sf, DELTA2)


@query(_delta_sql({-2: "1/12.0", -1: "-8/12.0", 1: "8/12.0", 2: "-1/12.0"}))
def delta_wide(spark, sf):
    return _delta(spark, sf, WIDE_DELTA)


def _trim_sql(where: str) -> str:
    return f"""WITH {EVENTS}, t AS (SELECT utt, frame, f0, min(CASE WHEN f0 >= 200 THEN frame END) OVER (PARTITION BY utt) AS a,
max(CASE WHEN f0 >= 200 THEN frame END) OVER (PARTITION BY utt) AS b FROM e) SELECT utt, frame, f0 FROM t WHERE {where}"""


def _trim(spark, sf, ends):
    return sequence.trim_zeros(events(spark, sf), F.abs("f0"), ends, 200.0).select(*_KEYS, "f0")


@query(_trim_sql("frame >= a AND b IS NOT NULL"))
def trim_zeros_front(spark, sf):
    return _trim(spark, sf, "f")


@query(_trim_sql("frame <= b"))
def trim_zeros_back(spark, sf):
    return _trim(spark, sf, "b")


@query(_trim_sql("frame BETWEEN a AND b"))
def trim_zeros_both(spark, sf):
    return _trim(spark, sf, "fb")


@query(f"WITH {EVENTS} SELECT utt, row_number() OVER (PARTITION BY utt ORDER BY frame) - 1 AS frame, f0 FROM e WHERE f0 > 1e-7")
def remove_zeros(spark, sf):
    return sequence.remove_zeros(events(spark, sf), F.abs("f0")).select(*_KEYS, "f0")


_N = "n AS (SELECT utt, count(*) AS n FROM e GROUP BY utt)"


@query(f"""WITH {EVENTS}, {_N} SELECT utt, frame, value FROM e UNION ALL
SELECT utt, unnest(range(n, CAST(ceil(n/8.0)*8 AS BIGINT))) AS frame, 0.0 AS value FROM n""")
def adjust_length_pad(spark, sf):
    return sequence.adjust_length(events(spark, sf).select(*_KEYS, "value"), "value", 8)


def _fill_sql(fill: str) -> str:
    return f"""WITH {EVENTS}, n AS (SELECT utt, count(*) AS n, list(value ORDER BY frame) AS v FROM e GROUP BY utt), x AS (SELECT *, CAST(ceil(n/8.0)*8 AS BIGINT) AS t FROM n),
p AS (SELECT utt, n, v, t, unnest(range(n, t)) AS frame FROM x) SELECT utt, frame, round(value, 5) AS value FROM e UNION ALL SELECT utt, frame, round({fill}, 5) AS value FROM p"""


def _filled(spark, sf, fill):
    return sequence.adjust_length(events(spark, sf).select(*_KEYS, "value"), "value", 8, fill=fill).select(*_KEYS, R("value", 5).alias("value"))


@query(_fill_sql("v[n]"))
def adjust_length_edge(spark, sf):
    return _filled(spark, sf, "edge")


@query(_fill_sql("v[frame % n + 1]"))
def adjust_length_wrap(spark, sf):
    return _filled(spark, sf, "wrap")


@query(_fill_sql("v[CASE WHEN frame % (2*n) < n THEN frame % (2*n) ELSE 2*n - 1 - frame % (2*n) END + 1]"))
def adjust_length_symmetric(spark, sf):
    return _filled(spark, sf, "symmetric")


@query(_fill_sql("v[CASE WHEN frame % greatest(2*n - 2, 1) < n THEN frame % greatest(2*n - 2, 1) ELSE 2*n - 2 - frame % greatest(2*n - 2, 1) END + 1]"))
def adjust_length_reflect(spark, sf):
    return _filled(spark, sf, "reflect")


@query(_fill_sql("list_max(v)"))
def adjust_length_maximum(spark, sf):
    return _filled(spark, sf, "maximum")


@query(_fill_sql("list_avg(v)"))
def adjust_length_mean(spark, sf):
    return _filled(spark, sf, "mean")


@query(_fill_sql("list_median(v)"))
def adjust_length_median(spark, sf):
    return _filled(spark, sf, "median")


@query(_fill_sql("v[n]*(t - 1 - frame)/(t - n)"))
def adjust_length_linear_ramp(spark, sf):
    return _filled(spark, sf, "linear_ramp")


@query(f"WITH {EVENTS}, {_N} SELECT utt, frame, value FROM e JOIN n USING (utt) WHERE frame < n // 8 * 8")
def adjust_length_cut(spark, sf):
    return sequence.adjust_length(events(spark, sf), "value", 8, pad=False).select(*_KEYS, "value")


def _two(spark, sf):
    e = events(spark, sf).select("utt", "frame", "value")
    return e, e.withColumn("utt", F.col("utt") - 1).where("utt >= 0")


_XY = "x AS (SELECT utt, frame, value FROM e), y AS (SELECT utt - 1 AS utt, frame, value FROM e WHERE utt >= 1)"


@query(f"WITH {EVENTS}, {_XY} SELECT coalesce(x.utt, y.utt) AS utt, coalesce(x.frame, y.frame) AS frame, coalesce(x.value, 0.0) AS x_value, coalesce(y.value, 0.0) AS y_value FROM x FULL JOIN y ON x.utt = y.utt AND x.frame = y.frame")
def adjust_pair_pad(spark, sf):
    return sequence.adjust_pair(*_two(spark, sf))


@query(f"""WITH {EVENTS}, {_XY}, b AS (SELECT x.utt, x.frame, x.value AS x_value, y.value AS y_value, count(*) OVER (PARTITION BY x.utt) AS n FROM x JOIN y ON x.utt = y.utt AND x.frame = y.frame)
SELECT utt, frame, x_value, y_value FROM b WHERE frame < n // 4 * 4""")
def adjust_pair_cut(spark, sf):
    return sequence.adjust_pair(*_two(spark, sf), pad=False, by=4)


@query(f"""WITH {EVENTS}, i AS (SELECT utt, frame, f0,
last_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN f0 > 0 THEN frame END IGNORE NULLS) OVER b AS t0,
first_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN f0 > 0 THEN frame END IGNORE NULLS) OVER a AS t1
FROM e WINDOW b AS (PARTITION BY utt ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY utt ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT utt, frame, round(CASE WHEN f0 > 0 THEN f0 WHEN v0 IS NULL THEN coalesce(v1, f0) WHEN v1 IS NULL THEN v0 ELSE v0 + (v1-v0)*(frame-t0)/(t1-t0) END, 6) AS y FROM i""")
def interpolate_f0(spark, sf):
    return sequence.interpolate(events(spark, sf), "f0", "y").select(*_KEYS, R("y").alias("y"))


def _interpolated_sql(between: str) -> str:
    return f"""WITH {EVENTS}, i AS (SELECT utt, frame, f0,
last_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN f0 > 0 THEN frame END IGNORE NULLS) OVER b AS t0,
first_value(CASE WHEN f0 > 0 THEN f0 END IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN f0 > 0 THEN frame END IGNORE NULLS) OVER a AS t1
FROM e WINDOW b AS (PARTITION BY utt ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY utt ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT utt, frame, round(CASE WHEN f0 > 0 THEN f0 WHEN v0 IS NULL THEN coalesce(v1, f0) WHEN v1 IS NULL THEN v0 ELSE {between} END, 6) AS y FROM i"""


@query(_interpolated_sql("v0"))
def interpolate_previous(spark, sf):
    return sequence.interpolate(events(spark, sf), "f0", "y", "zero").select(*_KEYS, R("y").alias("y"))


@query(_interpolated_sql("v1"))
def interpolate_next(spark, sf):
    return sequence.interpolate(events(spark, sf), "f0", "y", "next").select(*_KEYS, R("y").alias("y"))


@query(_interpolated_sql("CASE WHEN frame - t0 <= t1 - frame THEN v0 ELSE v1 END"))
def interpolate_nearest(spark, sf):
    return sequence.interpolate(events(spark, sf), "f0", "y", "nearest").select(*_KEYS, R("y").alias("y"))


@query(f"""WITH {EVENTS}, n AS (SELECT utt, count(*) AS n FROM e GROUP BY utt), w AS (SELECT utt, unnest(range((n - 10) // 5 + 1)) AS "window" FROM n WHERE n >= 10), m AS (SELECT utt, max("window") + 1 AS m FROM w GROUP BY utt)
SELECT w.utt, w."window", w."window" // 3 AS chunk, w."window" // 3 * 3 AS start, least(w."window" // 3 * 3 + 3, m) AS "end", count(*) AS n FROM w JOIN m ON m.utt = w.utt JOIN e ON e.utt = w.utt AND e.frame >= w."window"*5 AND e.frame < w."window"*5 + 10 GROUP BY ALL""")
def chunked_windows(spark, sf):
    """Windows three at a time."""
    c = sequence.chunked(sequence.sliding(events(spark, sf), "value", 10, 5), 3)
    return c.groupBy("utt", "window", "chunk", "start", "end").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS}, n AS (SELECT utt, count(*) AS n FROM e GROUP BY utt), w AS (SELECT utt, unnest(range((n - 10) // 5 + 1)) AS w FROM n WHERE n >= 10)
SELECT utt, frame, round(sum(value), 5) AS value FROM (SELECT e.utt, e.frame, e.value FROM w JOIN e ON e.utt = w.utt AND e.frame >= w.w*5 AND e.frame < w.w*5 + 10 UNION ALL SELECT utt, frame, value FROM e) GROUP BY utt, frame""")
def overlap_add_onto(spark, sf):
    """Chunks of windows added up onto the frames that they were cut from."""
    e = events(spark, sf)
    parts = sequence.chunked(sequence.sliding(e, "value", 10, 5), 3)
    chunks = parts.where("chunk % 2 = 0").unionByName(parts.where("chunk % 2 = 1"))
    return sequence.overlap_add(chunks, "value", 5, onto=e).select(*_KEYS, R("value", 5).alias("value"))


@query(f"""WITH {EVENTS}, n AS (SELECT utt, count(*) AS n FROM e GROUP BY utt), w AS (SELECT utt, unnest(range((n - 10) // 5 + 1)) AS "window" FROM n WHERE n >= 10)
SELECT w.utt, w."window", e.frame - w."window"*5 AS "offset", e.value FROM w JOIN e ON e.utt = w.utt AND e.frame >= w."window"*5 AND e.frame < w."window"*5 + 10""")
def sliding_windows(spark, sf):
    return sequence.sliding(events(spark, sf), "value", 10, 5)


@query(ORACLE_SQL["sliding_windows"])
def streamed_windows(spark, sf):
    """The same windows from a stream of frames that comes in several batches, cut without regard to utterances."""
    root = shared_folder(spark, "stream")
    frames = events(spark, sf).select("utt", "frame", "value")
    frames.repartition(6, F.floor(F.col("frame") / 7) + F.col("utt")).write.parquet(f"{root}/frames")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/frames")
        windows = stream_windows.sliding(stream, "value", 10, 5)
        windows.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/windows").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(windows.schema).parquet(f"{root}/windows")


@query(f"""WITH {EVENTS}, n AS (SELECT utt, count(*) AS n FROM e GROUP BY utt), w AS (SELECT utt, unnest(range((n - 10) // 5 + 1)) AS w FROM n WHERE n >= 10)
SELECT e.utt, e.frame, round(sum(e.value), 5) AS value FROM w JOIN e ON e.utt = w.utt AND e.frame >= w.w*5 AND e.frame < w.w*5 + 10 GROUP BY e.utt, e.frame""")
def overlap_add(spark, sf):
    windows = sequence.sliding(events(spark, sf), "value", 10, 5)
    return sequence.overlap_add(windows, "value", 5).select(*_KEYS, R("value", 5).alias("value"))


@query(f"WITH {PAIRS} SELECT utt, round(sqrt(avg((x-y)*(x-y))), 5) AS rmse FROM p GROUP BY utt")
def rmse(spark, sf):
    return metrics.rmse(pairs(spark, sf), "x", "y", "utt").select("utt", R("rmse", 5).alias("rmse"))


@query(f"WITH {PAIRS} SELECT utt, round(sqrt(avg(CASE WHEN x_voiced+y_voiced >= 2 THEN (x-y)*(x-y) END)), 5) AS rmse FROM p GROUP BY utt")
def voiced_rmse(spark, sf):
    return metrics.voiced_rmse(pairs(spark, sf), "x", "y", "x_voiced", "y_voiced", "utt").select("utt", R("rmse", 5).alias("rmse"))


@query(f"WITH {PAIRS} SELECT utt, round(sqrt(avg(CASE WHEN x_voiced+y_voiced >= 2 THEN pow(exp(x/100)-exp(y/100), 2) END)), 4) AS rmse FROM p GROUP BY utt")
def voiced_rmse_linear(spark, sf):
    p = pairs(spark, sf).withColumns({"x": F.col("x") / 100, "y": F.col("y") / 100})
    return metrics.voiced_rmse(p, "x", "y", "x_voiced", "y_voiced", "utt", linear=True).select("utt", R("rmse", 4).alias("rmse"))


@query(f"WITH {PAIRS} SELECT utt, round(avg(CASE WHEN x_voiced <> y_voiced THEN 1.0 ELSE 0.0 END), 6) AS error FROM p GROUP BY utt")
def voicing_error(spark, sf):
    return metrics.voicing_error(pairs(spark, sf), "x_voiced", "y_voiced", "utt").select("utt", R("error").alias("error"))


@query(f"""WITH {EVENTS}, m AS (SELECT max(frame) + 1 AS t FROM e), n AS (SELECT utt, count(*) AS n FROM e GROUP BY utt)
SELECT utt, frame, value FROM e UNION ALL SELECT utt, unnest(range(n, t)) AS frame, 0.0 AS value FROM n, m""")
def pad_grid(spark, sf):
    return datasets.padded(events(spark, sf))


@query(f"""WITH {EVENTS}, n AS (SELECT utt, count(*) AS n FROM e GROUP BY utt), o AS (SELECT utt, sum(n) OVER (ORDER BY utt) - n AS first, sum(n) OVER (ORDER BY utt) AS last FROM n),
g AS (SELECT event_id AS g FROM events)
SELECT g AS global_frame, utt, CAST(g - first AS BIGINT) AS frame FROM g JOIN o ON g >= first AND g < last""")
def framewise_range_join(spark, sf):
    from phonoframe.plans.tables import table

    lengths = events(spark, sf).groupBy("utt").agg(F.count("*").alias("n"))
    wanted = table(spark, sf, "events").select(F.col("event_id").alias("global_frame"))
    return datasets.framewise(datasets.offsets(lengths, "utt"), wanted)


@query(f"WITH {EVENTS} SELECT utt, frame, round(sign(value/250-1)*ln(1+256*abs(value/250-1))/ln(257), 6) + 0.0 AS y FROM e")
def mulaw_signed(spark, sf):
    return events(spark, sf).select(*_KEYS, (R(scalar.mulaw(F.col("value") / 250 - 1)) + 0.0).alias("y"))


@query(f"WITH {EVENTS} SELECT utt, frame, CAST(floor((sign(value/250-1)*ln(1+256*abs(value/250-1))/ln(257)+1)/2*256) AS INTEGER) AS y FROM e")
def mulaw_quantize_signed(spark, sf):
    return events(spark, sf).select(*_KEYS, scalar.mulaw_quantize(F.col("value") / 250 - 1).alias("y"))


@query(f"""WITH {EVENTS}, t AS (SELECT *, max(CASE WHEN f0 > 0 THEN frame END) OVER (PARTITION BY utt) AS b FROM e)
SELECT utt, frame, round(CASE WHEN frame <= b THEN sum(f0) OVER (PARTITION BY utt ORDER BY frame) ELSE 0.0 END, 4) AS a, CASE WHEN frame <= b THEN 2*f0 ELSE 0.0 END AS b FROM t""")
def each_trimmed(spark, sf):
    """A function of every utterance without its trailing silence, padded back: running sums, and doubled values."""
    x = events(spark, sf).select("utt", "frame", F.array("f0").alias("features"))
    y = datasets.each_matrix(x, lambda m: np.concatenate([np.cumsum(m, 0), 2 * m], 1))
    return y.select(*_KEYS, R(F.coalesce(F.col("features")[0], F.lit(0.0)), 4).alias("a"), F.col("features")[1].alias("b"))


@query(f"""WITH {EVENTS}, n AS (SELECT utt, count(*) // 2 AS n FROM e GROUP BY utt) SELECT e.utt, frame, round(CASE WHEN frame < n THEN sum(value) OVER (PARTITION BY e.utt ORDER BY frame) ELSE 0.0 END, 4) AS a FROM e JOIN n ON n.utt = e.utt""")
def each_padded(spark, sf):
    """A function of the first half of every utterance, padded back."""
    e = events(spark, sf)
    x = e.select("utt", "frame", F.array("value").alias("features"))
    lengths = e.groupBy("utt").agg(F.floor(F.count("*") / 2).alias("n"))
    return datasets.each_matrix(x, lambda m: np.cumsum(m, 0), lengths).select(*_KEYS, R(F.col("features")[0], 4).alias("a"))


@query(f"""WITH {EVENTS} SELECT a.utt, a.frame, a.value AS x, b.f0 AS y FROM e a JOIN e b ON b.utt = a.utt + 1 AND a.frame = b.frame""")
def paired_frames(spark, sf):
    x = events(spark, sf)
    y = x.select((F.col("utt") - 1).alias("utt"), "frame", F.array("f0").alias("features"))
    p = datasets.paired(x.select("utt", "frame", F.array("value").alias("features")), y)
    return p.select(*_KEYS, F.col("x")[0].alias("x"), F.col("y")[0].alias("y"))


@query(f"""WITH {EVENTS}, t AS (SELECT utt, count(*) AS n, list(value ORDER BY frame) AS v FROM e GROUP BY utt), m AS (SELECT max(n) + 3 AS m FROM t), g AS (SELECT utt, n, v, unnest(range(m)) AS frame FROM t, m)
SELECT utt, frame, CASE WHEN frame < n THEN v[frame + 1] ELSE 0.0 END AS value FROM g""")
def padded_rows(spark, sf):
    """Utterances as arrays of frames, three frames longer than the longest."""
    e = events(spark, sf)
    rows = e.groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: F.array(x["value"])).alias("features"))
    longest = rows.agg(F.max(F.size("features"))).first()[0] or 0
    out = datasets.padded_rows(rows, longest + 3, 1).select("utt", F.posexplode("features").alias("frame", "v"))
    return out.select("utt", F.col("frame").cast("long").alias("frame"), F.col("v")[0].alias("value"))
