"""Aligned labels: rows (utt, idx, start_time, end_time, context), times in 100 ns, -1 where a label has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonoframe.sources.corpora import write_files

#: 5 ms.
FRAME_SHIFT = 50_000
#: Contexts of silence.
SILENCE = ".*-sil+.*"


def _along():
    return Window.partitionBy("utt").orderBy("idx")


def _upto():
    return _along().rowsBetween(Window.unboundedPreceding, 0)


def at(labels: DataFrame, index: int | slice | list[int]) -> DataFrame:
    """The labels of every utterance at a place (negative: from its end), in a range, or at a list of places. A range's step counts for nothing, as in label files' own tools."""
    n, idx = F.count("*").over(Window.partitionBy("utt")), F.col("idx")
    places = index if isinstance(index, list) else [] if isinstance(index, slice) else [index]
    if not isinstance(index, slice):
        if all(p >= 0 for p in places):
            return labels.where(idx.isin(places))
        return labels.withColumn("_n", n).where(idx.isin([p for p in places if p >= 0]) | (idx - F.col("_n")).isin([p for p in places if p < 0])).drop("_n")
    edge = lambda x: F.lit(x) if x >= 0 else F.col("_n") + x
    marked = labels.withColumn("_n", n)
    if index.start is not None:
        marked = marked.where(idx >= edge(index.start))
    if index.stop is not None:
        marked = marked.where(idx < edge(index.stop))
    return marked.drop("_n")


def contiguity(labels: DataFrame) -> DataFrame:
    """labels with ok: the label isn't empty and starts where its predecessor ends."""
    before = F.lag("end_time").over(_along())
    return labels.withColumn("ok", (F.col("start_time") < F.col("end_time")) & (before.isNull() | (before == F.col("start_time"))))


def strict(labels: DataFrame) -> DataFrame:
    """labels, failing at the first one that isn't contiguous."""
    said = F.concat(F.lit("labels aren't contiguous in "), F.col("utt").cast("string"), F.lit(" at "), F.col("idx").cast("string"))
    checked = contiguity(labels)
    return checked.withColumn("idx", F.when(F.col("ok"), F.col("idx")).otherwise(F.raise_error(said).cast("long"))).select(*labels.columns)


def rounded(labels: DataFrame, shift: int = FRAME_SHIFT) -> DataFrame:
    """Times on the frame grid, halves to even."""
    snap = lambda c: (F.bround(F.col(c) / shift) * shift).cast("long")
    return labels.withColumns({"start_time": snap("start_time"), "end_time": snap("end_time")})


def with_durations(labels: DataFrame, durations: DataFrame, shift: int = FRAME_SHIFT) -> DataFrame:
    """Times from durations (utt, idx, frames), from the utterance's first start on. A label without a duration fails."""
    joined = labels.join(durations.select("utt", "idx", "frames"), ["utt", "idx"], "left")
    known = F.when(F.col("frames").isNotNull(), F.col("frames")).otherwise(F.raise_error(F.lit("a label has no duration")).cast("long"))
    first = F.first("start_time").over(_upto())
    end = (first + F.sum(known * shift).over(_upto())).cast("long")
    return joined.withColumn("_end", end).withColumn("start_time", (F.col("_end") - F.col("frames") * shift).cast("long")).withColumn("end_time", F.col("_end")).select(*labels.columns)


def is_silence(pattern: str = SILENCE):
    """The pattern matches from the start of the context."""
    return F.col("context").rlike(f"^(?:{pattern})")


def silence_labels(labels: DataFrame, pattern: str = SILENCE) -> DataFrame:
    return labels.where(is_silence(pattern)).select("utt", "idx")


def silence_phones(labels: DataFrame, pattern: str = SILENCE) -> DataFrame:
    """(utt, phone) of silence."""
    states = num_states(labels)
    return silence_labels(labels, pattern).join(states, "utt").select("utt", F.floor(F.col("idx") / F.col("num_states")).alias("phone")).distinct()


def _frames(start, end):
    """The frames from start to end, without end; none if there are none."""
    return F.explode(F.when(end > start, F.sequence(start, end - 1)))


def silence_frames(labels: DataFrame, pattern: str = SILENCE, shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, frame) of silence."""
    at = lambda c: F.floor(F.col(c) / shift)
    return labels.where(is_silence(pattern)).select("utt", _frames(at("start_time"), at("end_time")).alias("frame")).distinct()


def without_silence(frames: DataFrame, labels: DataFrame, pattern: str = SILENCE, shift: int = FRAME_SHIFT) -> DataFrame:
    return frames.join(silence_frames(labels, pattern, shift), ["utt", "frame"], "left_anti")


def state_aligned(labels: DataFrame) -> DataFrame:
    """(utt, state_aligned): whether the first context ends in a state, as [2]."""
    return labels.groupBy("utt").agg(F.min_by(F.col("context").rlike(r"\[.\]$"), "idx").alias("state_aligned"))


def num_states(labels: DataFrame) -> DataFrame:
    """(utt, num_states): states of the first phone; 1 for phone alignments."""
    state = F.regexp_extract("context", r"\[(\d)\]$", 1).cast("int")
    marked = labels.withColumn("_s", state).withColumn("_fall", (F.lag("_s").over(_along()) >= F.col("_s")).cast("int"))
    first = marked.withColumn("_run", F.coalesce(F.sum("_fall").over(_upto()), F.lit(0))).where("_run = 0")
    return first.groupBy("utt").agg(F.coalesce(F.max("_s") - F.min("_s") + 1, F.lit(1)).alias("num_states"))


def counts(labels: DataFrame, shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, num_labels, num_states, num_phones, num_frames)."""
    totals = labels.groupBy("utt").agg(F.count("*").alias("num_labels"), F.floor(F.max_by("end_time", "idx") / shift).alias("num_frames"))
    return totals.join(num_states(labels), "utt").withColumn("num_phones", F.floor(F.col("num_labels") / F.col("num_states"))).select("utt", "num_labels", "num_states", "num_phones", "num_frames")


def _document(labels: DataFrame, line) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"])
    return labels.groupBy("utt").agg(F.array_join(lines, "\n").alias("text"))


def as_text(labels: DataFrame) -> DataFrame:
    """(utt, text): a label file, without times where there are none."""
    timed = F.concat_ws(" ", F.col("start_time").cast("string"), F.col("end_time").cast("string"), "context")
    return _document(labels, F.when(F.col("start_time") < 0, F.col("context")).otherwise(timed))


def phone_name():
    """What stands between the first - and the next +, or the whole context."""
    found = F.regexp_extract("context", r"^[^-]*-([^+]*)\+", 1)
    return F.when(F.col("context").rlike(r"^[^-]*-[^+]*\+"), found).otherwise(F.col("context"))


def as_audacity(labels: DataFrame) -> DataFrame:
    """(utt, text): start and end in seconds and the phone, by tabs."""
    return _document(labels, F.format_string("%.4f\t%.4f\t%s", F.col("start_time") * 1e-7, F.col("end_time") * 1e-7, phone_name()))


def as_textgrid(labels: DataFrame) -> DataFrame:
    """(utt, text): one interval tier named phoneme."""
    seconds = lambda c: F.format_string("%.7f", c * 1e-7)
    number = F.row_number().over(_along())
    line = F.concat(
        F.lit("        intervals ["), number.cast("string"), F.lit("]:\n            xmin = "), seconds(F.col("start_time")),
        F.lit("\n            xmax = "), seconds(F.col("end_time")), F.lit('\n            text = "'), F.replace(phone_name(), F.lit('"'), F.lit('""')), F.lit('"'),
    )
    body = _document(labels.withColumn("_line", line), F.col("_line"))
    ends = labels.groupBy("utt").agg(seconds(F.max_by("end_time", "idx")).alias("_end"), F.count("*").cast("string").alias("_n"))
    head = F.concat(
        F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = 0\nxmax = '), "_end", F.lit("\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n        class = \"IntervalTier\"\n        name = \"phoneme\"\n        xmin = 0\n        xmax = "),
        "_end", F.lit("\n        intervals: size = "), "_n", F.lit("\n"),
    )
    return body.join(ends, "utt").select("utt", F.concat(head, "text", F.lit("\n")).alias("text"))


def write_text(documents: DataFrame, path: str, suffix: str = ".lab") -> int:
    """One text file per utterance of documents (utt, text), named after it, in a folder of any store that pyarrow knows; how many were written."""
    return write_files(documents.select(F.concat(F.col("utt").cast("string"), F.lit(suffix)).alias("name"), F.col("text").cast("binary").alias("content")), path)
