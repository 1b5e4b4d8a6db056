"""From labels and questions to numeric features per phone and per frame.

Questions are answered before labels are spread over frames. ``binary_answer`` and
``numeric_answer`` say what an answer is, for one question; ``answered`` takes all
questions of a set at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from phonoframe.functions.scalar import coarse_coding
from phonoframe.operators.answering import Machine, note_numbers
from phonoframe.operators.labels import FRAME_SHIFT, state_aligned
from phonoframe.sources.questions import Question

#: Width of the sub-phone features.
WIDTHS = {None: 0, "full": 9, "minimal_frame": 2, "state_only": 1, "frame_only": 1, "uniform_state": 2, "minimal_phoneme": 3, "coarse_coding": 4}


def width(kind: str | None) -> int:
    if kind not in WIDTHS:
        raise ValueError(f"unknown sub-phone features {kind!r}")
    return WIDTHS[kind]


def binary_answer(q: Question, context: Column) -> Column:
    """1 if any pattern of the question is found."""
    return F.coalesce(context.rlike("|".join(f"(?:{p})" for p in q.patterns)), F.lit(False)).cast("int")


def numeric_answer(q: Question, context: Column) -> Column:
    """The number in the question's group; a note's number; p and m are signs. Without a match -1, or -50 for questions about signed numbers. A match that is no number fails."""
    got = F.regexp_extract(context, q.patterns[0], 1)
    notes = F.create_map(*[F.lit(x) for pair in note_numbers().items() for x in pair])
    sign = F.when(got.startswith("p"), 1.0).when(got.startswith("m"), -1.0)
    fail = F.raise_error(F.concat(F.lit(f"{q.name} finds no number: "), got)).cast("double")
    number = F.when(sign.isNotNull(), sign * F.substring(got, 2, 20).try_cast("double")).otherwise(F.coalesce(notes[got].cast("double"), got.try_cast("double")))
    return F.when(got == "", F.lit(-50.0 if q.signed else -1.0)).otherwise(F.coalesce(number, fail)).cast("float")


def answered(labels: DataFrame, binary: list[Question], numeric: list[Question], packed: bool = False) -> DataFrame:
    """labels with answers: an array of the binary, then the numeric questions'; packed: with bits, a string of 0 or 1 for each binary question, and numbers, an array of the numeric ones'.

    Rows stay where they are: each batch of them is answered once per different
    context, by one automaton of all questions' texts. A null context answers
    nothing: 0, and -1 or -50 for numbers.
    """
    machine = Machine(binary, numeric)
    at = labels.columns.index("context")
    floats = ArrayType(FloatType())
    schema = StructType([*labels.schema.fields, *([StructField("bits", StringType()), StructField("numbers", floats)] if packed else [StructField("answers", floats)])])

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))

    def strings(rows: np.ndarray) -> pa.Array:
        ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer((rows != 0).astype(np.uint8) + np.uint8(ord("0"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(at).dictionary_encode("encode")
            rows = machine.answers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            answers = [strings(rows[:, : len(binary)]), lists(rows[:, len(binary) :])] if packed else [lists(rows)]
            yield pa.record_batch([*batch.columns, *answers], names=schema.names)

    return labels.mapInArrow(run, schema)


def phone_frames(labels: DataFrame, kind: str | None = None, shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, idx, frame, features) of phone alignments; a phone's frames run from its start to its end, both rounded down."""
    if kind not in (None, "minimal_phoneme", "coarse_coding"):
        raise ValueError(f"{kind!r} needs a state alignment")
    first, last = F.floor(F.col("start_time") / shift), F.floor(F.col("end_time") / shift)
    spread = labels.withColumn("_n", last - first).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    i, n = F.col("_i"), F.col("_n")
    features = {None: [], "minimal_phoneme": [(i + 1) / n, (n - i) / n, n], "coarse_coding": [*_coarse(i, n), n]}[kind]
    return spread.select("utt", "idx", (first + i).alias("frame"), F.array(*[f.cast("double") for f in features]).alias("features"))


def _coarse(i: Column, n: Column) -> list[Column]:
    """Three densities over the phone, on grids of 600 points that span three phone lengths and begin at -1.5, -1 and -0.5 of one."""
    at = F.floor(200.0 / n * i)
    return [coarse_coding(begin + 3 / 599 * (offset + at), centre) for begin, offset, centre in ((-1.5, 300, 0.0), (-1.0, 200, 0.5), (-0.5, 100, 1.0))]


def states(labels: DataFrame, shift: int = FRAME_SHIFT) -> DataFrame:
    """State alignments with state (from 1), frames, phone, phone_frames, num_states and before (frames of the phone's earlier states)."""
    along = Window.partitionBy("utt").orderBy("idx")
    state = F.regexp_extract("context", r"\[(\d)\]$", 1).cast("int") - 1
    marked = labels.withColumn("state", state).withColumn("frames", F.floor((F.col("end_time") - F.col("start_time")) / shift))
    phone = F.sum((F.col("state") == 1).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1
    of_phone = Window.partitionBy("utt", "phone")
    before = F.coalesce(F.sum("frames").over(of_phone.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("phone", phone).withColumns({"phone_frames": F.sum("frames").over(of_phone), "num_states": F.max("state").over(Window.partitionBy("utt")), "before": before})


def state_frames(labels: DataFrame, kind: str | None = "full", shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, idx, frame, features) of state alignments; frames count the states' own frames."""
    if kind == "minimal_phoneme" or kind not in WIDTHS:
        raise ValueError(f"{kind!r} isn't for state alignments")
    s = states(labels, shift)
    start = F.coalesce(F.sum("frames").over(Window.partitionBy("utt").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = s.withColumn("_start", start).where("frames > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)))
    i, n, p, state, before = (F.col(c) for c in ("_i", "frames", "phone_frames", "state", "before"))
    at = before + i
    features = {
        None: [],
        "full": [(i + 1) / n, (n - i) / n, n, state, F.col("num_states") + 1 - state, p, n / p, (p - at) / p, (at + 1) / p],
        "state_only": [state],
        "frame_only": [(at + 1) / p],
        "uniform_state": [(at + 1) / p, F.greatest(F.lit(1), F.bround((at + 1) / p * 5))],
        "minimal_frame": [(i + 1) / n, state],
        "coarse_coding": [*_coarse(at, p), p],
    }[kind]
    return spread.select("utt", "idx", (F.col("_start") + i).alias("frame"), F.array(*[f.cast("double") for f in features]).alias("features"))


def _by_alignment(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Utterances with a state alignment, and the others."""
    with_states = state_aligned(labels).where("state_aligned").select("utt")
    return labels.join(with_states, "utt", "left_semi"), labels.join(with_states, "utt", "left_anti")


def frame_features(labels: DataFrame, state_kind: str | None = "full", phone_kind: str | None = None, shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, idx, frame, features), each utterance by its own kind of alignment."""
    states_, phones = _by_alignment(labels)
    return state_frames(states_, state_kind, shift).unionByName(phone_frames(phones, phone_kind, shift))


def linguistic_frames(labels: DataFrame, answers: DataFrame, frames: DataFrame) -> DataFrame:
    """(utt, frame, features): each frame's label's answers, then its sub-phone features."""
    a = answers.select("utt", "idx", F.col("answers").cast("array<double>").alias("_a"))
    return frames.join(a, ["utt", "idx"]).select("utt", "frame", F.concat("_a", "features").alias("features"))


def state_durations(labels: DataFrame, num_states: int = 5, shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, phone, state_1 ... ): frames of each state of a phone."""
    s = states(labels, shift)
    return s.groupBy("utt", "phone").agg(*[F.coalesce(F.sum(F.when(F.col("state") == k, F.col("frames"))), F.lit(0)).alias(f"state_{k}") for k in range(1, num_states + 1)])


def phone_durations(labels: DataFrame, shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, idx, frames) of phone alignments, truncated."""
    return labels.select("utt", "idx", ((F.col("end_time") - F.col("start_time")) / shift).cast("long").alias("frames"))


def durations(labels: DataFrame, num_states: int = 5, shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, phone, frames): an array of the states' frames, or of the phone's alone, by the utterance's kind of alignment."""
    states_, phones = _by_alignment(labels)
    of_states = state_durations(states_, num_states, shift).select("utt", "phone", F.array(*[f"state_{k}" for k in range(1, num_states + 1)]).alias("frames"))
    return of_states.unionByName(phone_durations(phones, shift).select("utt", F.col("idx").alias("phone"), F.array("frames").alias("frames")))


def _unit_frames(labels: DataFrame, shift: int) -> DataFrame:
    """Labels with frames, unit (the phone's number), of_phone (its frames, array of its states' frames), from (frames before the label) and last (whether the label ends its phone), by the utterance's kind of alignment."""
    states_, phones = _by_alignment(labels)
    s = states(states_, shift)
    of_phone = Window.partitionBy("utt", "phone")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("state", "frames")).over(of_phone)), lambda x: x["frames"])
    a = s.select("utt", "idx", F.col("phone").alias("unit"), "frames", F.col("phone_frames").alias("sum"), listed.alias("listed"), (F.col("state") == F.col("num_states")).alias("last"))
    whole = ((F.col("end_time") - F.col("start_time")) / shift).cast("long")
    b = phones.select("utt", "idx", F.col("idx").alias("unit"), whole.alias("frames"), whole.alias("sum"), F.array(whole).alias("listed"), F.lit(True).alias("last"))
    before = F.coalesce(F.sum("frames").over(Window.partitionBy("utt").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return a.unionByName(b).withColumn("from", before)


def duration_features(labels: DataFrame, kind: str = "numerical", unit: str = "state", size: str = "phoneme", shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, row, features): durations in frames, a row per phone or, of size "frame", per frame.

    numerical: of unit "state" the frames of each of the phone's states, of unit
    "phoneme" their sum. binary: 1 in the last frame of each state or phone, for
    frames only. Utterances without states know phones only: both units are their
    phones' frames.
    """
    for value, known in ((kind, ("numerical", "binary")), (unit, ("state", "phoneme")), (size, ("phoneme", "frame"))):
        if value not in known:
            raise ValueError(f"{value!r} isn't one of {known}")
    if kind == "binary" and size == "phoneme":
        raise ValueError("binary durations mark frames")
    x = _unit_frames(labels, shift)
    values = F.col("listed") if unit == "state" else F.array("sum")
    if size == "phoneme":
        return x.where("last").select("utt", F.col("unit").alias("row"), values.alias("features"))
    spread = x.where("frames > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)))
    ends = (F.col("_i") == F.col("frames") - 1) & (F.lit(unit == "state") | F.col("last"))
    return spread.select("utt", (F.col("from") + F.col("_i")).alias("row"), (F.array(ends.cast("long")) if kind == "binary" else values).alias("features"))


def duration_marks(labels: DataFrame, unit: str = "state", shift: int = FRAME_SHIFT) -> DataFrame:
    """(utt, frame, mark): 1 in the last frame of each state or phone."""
    if unit not in ("state", "phoneme"):
        raise ValueError(f"unknown unit {unit!r}")
    s = states(labels, shift)
    end = F.sum("frames").over(Window.partitionBy("utt").orderBy("idx"))
    spread = s.withColumn("_end", end).where("frames > 0").withColumn("frame", F.explode(F.sequence(F.col("_end") - F.col("frames"), F.col("_end") - 1)))
    last = (F.col("frame") == F.col("_end") - 1) & (F.lit(unit == "state") | (F.col("state") == F.col("num_states")))
    return spread.select("utt", "frame", last.cast("int").alias("mark"))
