"""Sliding windows over streams of frames, whatever the batches are cut into."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from phonoframe.operators.grouping import kind

#: Groups of utterances that share one state, as reading and writing a state costs more than the windows of an utterance do.
BUCKETS = 1024


class Tails(StatefulProcessor):
    """Keeps, for each utterance of a bucket, the first frame of its next window and the frames from there on that no finished window has used up."""

    def __init__(self, width: int, step: int, value: str, utt: str):
        self.width, self.step, self.value, self.utt = width, step, value, utt

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Frames and values of all utterances one after the other, `sizes` of them each.
        self.tails = handle.getValueState("tails", f"utts array<{self.utt}>, starts array<long>, sizes array<long>, frames array<long>, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        utts, starts, sizes, frames, values = self.tails.get() if self.tails.exists() else ([], [], [], [], [])
        name = lambda u: u if u == u else "NaN"
        index = {name(u): k for k, u in enumerate(utts)}
        utts, starts = list(utts), np.asarray(starts, np.int64)
        owner = np.repeat(np.arange(len(utts)), np.asarray(sizes, np.int64))
        frames, values = np.asarray(frames, np.int64), np.asarray(values, float)
        for pdf in rows:
            code, met = pd.factorize(pdf["utt"], use_na_sentinel=False) if not key[1] else (np.zeros(len(pdf), np.int64), [None])
            met = met.tolist() if hasattr(met, "tolist") else met
            place = np.array([index.setdefault(name(u), len(index)) for u in met], np.int64)
            utts += [u for u, k in zip(met, place.tolist(), strict=True) if k >= len(utts)]
            starts = np.concatenate([starts, np.zeros(len(utts) - len(starts), np.int64)])
            owner = np.concatenate([owner, place[code]])
            frames = np.concatenate([frames, pdf["frame"].to_numpy(np.int64)])
            values = np.concatenate([values, pdf[self.value].to_numpy(float)])
            # The first that came counts; a frame of finished windows only is late, or came before.
            by = np.lexsort((frames, owner))
            owner, frames, values = owner[by], frames[by], values[by]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (frames[1:] != frames[:-1])][: len(by)] & (frames >= starts[owner])
            owner, frames, values = owner[new], frames[new], values[new]
            first = np.searchsorted(owner, np.arange(len(utts)))
            whole = np.bincount(owner, frames - starts[owner] == np.arange(len(owner)) - first[owner], len(utts)).astype(np.int64)  # frames without a gap
            n = np.where(whole >= self.width, (whole - self.width) // self.step + 1, 0)
            if n.any():
                of = np.repeat(np.arange(len(utts)), n)
                window = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                at = (first[of] + window * self.step)[:, None] + np.arange(self.width)
                names = pd.Series(utts, dtype=object)[np.repeat(of, self.width)].to_numpy()
                yield pd.DataFrame({"utt": names, "window": np.repeat(starts[of] // self.step + window, self.width), "offset": np.tile(np.arange(self.width), len(of)), self.value: values[at].ravel()})
            starts = starts + n * self.step
            rest = frames >= starts[owner]
            owner, frames, values = owner[rest], frames[rest], values[rest]
        self.tails.update((utts, starts.tolist(), np.bincount(owner, minlength=len(utts)).tolist(), frames.tolist(), values.tolist()))

    def close(self) -> None:
        pass


def sliding(frames: DataFrame, value: str, width: int, step: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(utt, frame, value) streamed -> (utt, window, offset, value): what ``sequence.sliding`` gives for all frames, each window once, as soon as its last frame is there.

    Frames may come in any order and in any batches; a frame that comes twice counts
    once. What is kept for an utterance is less than a window and the frames beyond
    a gap. Utterances share `buckets` states, which a checkpoint goes on with only if
    it was made with as many. The session needs the RocksDB state store.
    """
    if step < 1 or width < step:
        raise ValueError("a step is 1 at least and no longer than a window")
    if buckets < 1:
        raise ValueError("there is one bucket at least")
    utt = kind(frames, "utt")
    schema = f"utt {utt}, window long, offset long, {value} double"
    # Null utterances have a bucket of their own, so that pandas keeps the others' type.
    rows = frames.select(F.pmod(F.xxhash64("utt"), F.lit(buckets)).alias("_bucket"), F.col("utt").isNull().alias("_none"), "utt", "frame", value)
    return rows.groupBy("_bucket", "_none").transformWithStateInPandas(Tails(width, step, value, utt), schema, "append", "none")
