"""Datasets of utterances: indexing, pairing, padding, frame-wise access."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.operators.grouping import each, kind, over_utterances, running_total


def numbered(utts: DataFrame, *order: str, tasks: int | None = None) -> DataFrame:
    """A row per utterance with ordinal from 0, numbered in sorted parts over the cluster."""
    return running_total(utts, "ordinal", F.lit(1), *order, tasks=tasks).withColumn("ordinal", F.col("ordinal") - 1)


def length(utts: DataFrame) -> int:
    """How many utterances a dataset has."""
    return utts.count()


def lengths(utts: DataFrame) -> DataFrame:
    """The same as a table of one row (n), for plans that use it."""
    return utts.agg(F.count("*").alias("n"))


def at(utts: DataFrame, index: int | slice) -> DataFrame:
    """Utterances by ordinal: a number (negative: from the end) or a slice. Their number is asked for only where the index needs it, in the same plan."""
    ordinal = F.col("ordinal")
    n = lambda: utts.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).scalar()
    if isinstance(index, int):
        return utts.where(ordinal == (F.lit(index) if index >= 0 else n() + index))
    step = 1 if index.step is None else index.step
    if not step:
        raise ValueError("a slice's step isn't zero")

    def place(x: int | None, default) -> Column:
        if x is None:
            return default()
        return F.lit(x) if x >= 0 else F.greatest(n() + x, F.lit(0 if step > 0 else -1))

    if step > 0:
        start = place(index.start, lambda: F.lit(0))
        inside = ordinal >= start
        if index.stop is not None:
            inside = inside & (ordinal < place(index.stop, n))
        return utts.where(inside & ((ordinal - start) % step == 0))
    start = F.least(place(index.start, lambda: n() - 1), n() - 1)
    return utts.where((ordinal <= start) & (ordinal > place(index.stop, lambda: F.lit(-1))) & ((start - ordinal) % -step == 0))


def paired(x: DataFrame, y: DataFrame) -> DataFrame:
    """(utt, frame, x, y) of frames that both have."""
    a, b = (df.select("utt", "frame", F.col("features").alias(n)) for df, n in ((x, "x"), (y, "y")))
    return a.join(b, ["utt", "frame"])


def padded(frames: DataFrame, value: str = "value", length: int | None = None) -> DataFrame:
    """(utt, frame, value) with zeros to `length` frames (default: the longest utterance's). Longer utterances fail."""
    ends = frames.groupBy("utt").agg((F.max("frame") + 1).cast("long").alias("_n"))
    goal = F.lit(length).cast("long") if length is not None else ends.agg(F.max("_n")).scalar()
    short = ends.withColumn("_t", goal)
    fail = F.raise_error(F.concat(F.lit("longer than the padded length: "), F.col("utt").cast("string"))).cast("long")
    last = F.when(F.col("_n") > F.col("_t"), fail).otherwise(F.col("_t"))
    zeros = short.select("utt", F.explode(F.when(last > F.col("_n"), F.sequence(F.col("_n"), last - 1))).alias("frame"), F.lit(0.0).alias(value))
    return frames.select("utt", "frame", value).unionByName(zeros)


def padded_rows(utts: DataFrame, length: int, width: int) -> DataFrame:
    """features (array of frames) with zero frames appended to `length`; longer ones fail."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.lit(length) - F.size("features"))
    fail = F.raise_error(F.lit("longer than the padded length")).cast("array<array<double>>")
    return utts.withColumn("features", F.when(F.size("features") > length, fail).otherwise(F.concat("features", zero)))


def batched(frames: DataFrame, length: int | None = None, value: str = "features") -> DataFrame:
    """(utt, n, features): a row per utterance with its number of frames and all of them as floats, zero frames appended to `length` (default: the longest utterance's). Longer utterances fail."""
    listed = frames.groupBy("utt").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("frame", value))), lambda x: x[value].cast("array<float>")).alias("features"))
    goal = F.lit(length).cast("long") if length is not None else frames.groupBy("utt").agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    zero = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), F.size(F.col("features")[0])), (F.col("_t") - F.col("n")).cast("int"))
    fail = F.raise_error(F.concat(F.lit("longer than the padded length: "), F.col("utt").cast("string"))).cast("array<array<float>>")
    padded_ = F.when(F.col("n") > F.col("_t"), fail).otherwise(F.concat("features", zero))
    return listed.withColumn("_t", goal).select("utt", "n", padded_.alias("features"))


def offsets(lengths: DataFrame, *order: str) -> DataFrame:
    """(utt, n) with first and end, its frames' places in the concatenation of all; a row per utterance, summed in sorted parts over the cluster."""
    return running_total(lengths, "end", F.col("n"), *order).withColumn("first", F.col("end") - F.col("n"))


def framewise(places: DataFrame, wanted: DataFrame, bucket: int = 1000) -> DataFrame:
    """wanted (global_frame) -> (global_frame, utt, frame): a range join through buckets of frames, so it is an equi-join."""
    spread = places.where("n > 0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("end") - 1) / bucket))))
    asked = wanted.withColumn("_b", F.floor(F.col("global_frame") / bucket))
    joined = asked.join(spread, "_b").where((F.col("global_frame") >= F.col("first")) & (F.col("global_frame") < F.col("end")))
    return joined.select("global_frame", "utt", (F.col("global_frame") - F.col("first")).alias("frame"))


def each_utterance(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of one utterance's frames, in order; utt is the first column."""
    return over_utterances(frames, each(fn), schema)


def each_matrix(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], lengths: DataFrame | None = None, eps: float = 1e-7, tasks: int | None = None) -> DataFrame:
    """(utt, frame, features) of fn applied to each utterance's matrix, padded back to its number of frames with zeros.

    fn sees the frames without trailing silence, or the first n of `lengths`
    (utt, n). It may change the dimension; a result that is longer than the
    utterance is an error. An utterance of silence only is given to fn empty.
    """
    rows = frames.select("utt", "frame", "features") if lengths is None else frames.select("utt", "frame", "features").join(lengths.select("utt", "n"), "utt")

    trimmed = lengths is None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["features"].to_numpy()).astype(float)
        if trimmed:
            loud = np.flatnonzero(np.abs(x).sum(1) >= eps)
            n = int(loud[-1]) + 1 if len(loud) else 0
        else:
            n = int(pdf["n"].iloc[0])
        y = np.asarray(fn(x[:n]), float)
        if y.ndim != 2 or len(y) > len(x):
            raise ValueError(f"the result for {pdf['utt'].iloc[0]} has shape {y.shape}, and the utterance {len(x)} frames")
        out = np.zeros((len(x), y.shape[1]))
        out[: len(y)] = y
        return pd.DataFrame({"utt": pdf["utt"].to_numpy(), "frame": pdf["frame"].to_numpy(), "features": list(out)})

    return over_utterances(rows, each(run), f"utt {kind(frames, 'utt')}, frame long, features array<double>", tasks=tasks)


def first_per_group(files: DataFrame, n: int, groups: list[str], order: str = "path") -> DataFrame:
    """The first n files of each group: partial and final limits per group."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def with_label(files: DataFrame, names: list[str], column: str = "speaker") -> DataFrame:
    """speaker_label: the position in the list of names; a name that isn't in it fails."""
    place: Column = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(column))
    fail = F.raise_error(F.concat(F.lit("unknown name "), F.col(column))).cast("int")
    return files.withColumn("speaker_label", F.when(place > 0, (place - 1).cast("int")).otherwise(fail))
