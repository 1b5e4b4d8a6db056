"""Removal of repeated passages by bucket-pointer refinement.

Two positions repeat when the LENGTH bytes from them are equal. Refinement puts
positions into buckets of equal beginnings and refines only buckets that can
still matter:

0. *q-gram buckets.* Of every LENGTH-byte string the q-gram with the least hash
   is its anchor (equal strings have equal anchors at equal places), so only
   about one position in fifteen needs a bucket. A bucket that lies in one
   document is finished.
1. *Buckets of neighbouring offsets.* An anchor's bucket is refined by all that
   strings around the anchor can reach, LENGTH - q bytes before and LENGTH
   after it. Where a smaller document has the same, the whole stretch goes, and
   the position is finished.
2. *Later offsets.* Of what is left, one place for each different surrounding
   is refined to LENGTH bytes exactly: positions are sorted by the pair of their
   own bucket and the bucket at a later offset, which doubles the depth, and the
   new identifiers serve the next round.

Step 0 and 1 shuffle hashes packed per slice of text, with equal surroundings
within a slice merged before; step 2 shuffles surroundings of few anchors. The
number of buckets follows from the bytes of all texts, and a task holds one
bucket at a time. A bucket far above its share holds a q-gram that very many
documents have in different surroundings: it isn't gathered but refined over the
cluster, by groups of equal surroundings and at last of equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm.common import binary_rows, groups, kept, mixed, released, slices, table, utf8, written

LENGTH, Q = 50, 20
_SLICE, _SLICE_DOCS = 1 << 20, 1 << 15
#: Bytes of text per bucket; packed rows of a bucket (a slice's share each), and surroundings of a q-gram, that a task gathers at most.
BUCKET_TEXT, BUCKET_ROWS, BUCKET_BYTES, GATHERED = 8 << 20, 1 << 16, 32 << 20, 1 << 17
_LAST = np.uint64(2**64 - 1)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The kinds of answers, in the lowest bit of a key.
DONE, ASKED = 0, 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return kept(f"passage powers {n}", lambda: (np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _INVERSE))))


def _ahead(x: np.ndarray, steps: int, combine, fill) -> np.ndarray:
    """combine over x[i], ..., x[i + steps - 1] (backwards for negative steps) by doubling."""
    n, back, span = abs(steps), steps < 0, 1
    while span < n:
        step = min(span, n - span)
        moved = np.full_like(x, fill)
        if step < len(x):
            if back:
                moved[step:] = x[:-step]
            else:
                moved[:-step] = x[step:]
        x = combine(x, moved)
        span += step
    return x


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """Of each anchor: document, position in the buffer, start and end of its surroundings, q-gram hash, hash of the surroundings."""
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    power, inverse = _powers(max(1 << 21, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
    gram = lambda a, b: mixed((total[b] - total[a]) * inverse[a])
    end = np.repeat(at[1:], np.diff(at))
    p = np.arange(n - q + 1)
    h = np.full(n, _LAST)
    h[: n - q + 1] = np.where(p + q <= end[: n - q + 1], gram(p, p + q), _LAST)
    least = _ahead(h, length - q + 1, np.minimum, _LAST)
    least[np.arange(n) + length > end] = 0
    chosen = np.flatnonzero((_ahead(least, -(length - q + 1), np.maximum, np.uint64(0)) == h) & (h != _LAST))
    doc = np.searchsorted(at, chosen, "right") - 1
    a, b = np.maximum(chosen - (length - q), at[doc]), np.minimum(chosen + length, at[doc + 1])
    around = mixed(gram(a, b) ^ (chosen - a).astype(np.uint64) * _BASE)
    return doc, chosen, a, b, h[chosen], around


def short(x: np.ndarray) -> bytes:
    """The lower six bytes of 64-bit numbers."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unshort(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def answer_key(h: np.ndarray, around: np.ndarray) -> np.ndarray:
    """What a document finds its anchors by; the lowest bit is free."""
    six = np.uint64((1 << 48) - 1)
    return mixed((h & six) * _BASE + (around & six)) & ~np.uint64(1)


def doc_slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    for i, j in slices(at, _SLICE):
        for k in range(i, j, _SLICE_DOCS):
            yield k, min(k + _SLICE_DOCS, j)


def surroundings(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, direct and packed anchors (documents with their ids, hashes): one per different surrounding of a slice; direct: the others, which are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            whole, offsets = utf8(batch.column(1))
            for i, j in doc_slices(offsets):
                raw, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc, _, _, _, h, around = anchors(raw, at)
                if not len(doc):
                    continue
                own = ids[i:j]
                h, around = unshort(short(h)), unshort(short(around))
                order = np.lexsort((own[doc], around, h))
                doc, h, around = doc[order], h[order], around[order]
                fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (around[1:] != around[:-1])])
                # Anchors of the first document itself stay with it: a text doesn't repeat itself.
                lead = own[doc[np.flatnonzero(fresh)]][np.cumsum(fresh) - 1]
                later = ~fresh & (own[doc] != lead)
                rows = []
                if later.any():
                    pick = np.unique(np.stack([doc[later], answer_key(h[later], around[later]).view(np.int64)]), axis=1)
                    used, number = np.unique(pick[0], return_inverse=True)
                    rows.append((int(h[0] % np.uint64(buckets)), True, own[used].tobytes(), number.astype(np.uint16).tobytes(), pick[1].tobytes(), b""))
                doc, h, around = doc[fresh], h[fresh], around[fresh]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                doc, h, around, bucket = doc[by], h[by], around[by], bucket[by]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    used, number = np.unique(doc[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), False, own[used].tobytes(), number.astype(np.uint16).tobytes(), short(h[a:b]), short(around[a:b])))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names=["bucket", "direct", "ids", "docs", "h", "around"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "bucket int, direct boolean, ids binary, docs binary, h binary, around binary")


def judge(ids: list[bytes], docs: list[bytes], hashes: list[bytes], arounds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and key (lowest bit: DONE or ASKED) of the anchors of a bucket that need anything."""
    doc = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint16)] for i, d in zip(ids, docs, strict=True)])
    h, around = unshort(b"".join(hashes)), unshort(b"".join(arounds))
    by = np.lexsort((doc, around, h))
    doc, h, around = doc[by], h[by], around[by]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], around[1:] != around[:-1]])
    group, part = np.cumsum(new_h) - 1, np.cumsum(new) - 1
    first = doc[np.flatnonzero(new)][part]
    starts = np.flatnonzero(new_h)
    several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))[group]
    varied = (np.bincount(group, new) > 1)[group]
    key = answer_key(h, around)
    done = doc > first
    asked = new & several & varied
    return np.concatenate([doc[done], doc[asked]]), np.concatenate([key[done] | np.uint64(DONE), key[asked] | np.uint64(ASKED)]).view(np.int64)


def judged(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """doc_id and key of the anchors that need anything, rows sorted by bucket; of buckets above either bound, all packed anchors as they are."""
    names = ["doc_id", "key", "ids", "docs", "h", "around"]

    def answers(doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(doc), pa.array(key), *[pa.nulls(len(doc), pa.binary())] * 4], names=names)

    def as_they_are(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in t.to_batches():
            none = pa.nulls(len(batch), pa.int64())
            yield pa.record_batch([none, none, *(batch.column(k) for k in range(2, 6))], names=names)

    def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
        direct = t.column(1).to_numpy()
        for r in t.filter(pa.array(direct)).to_pylist():
            yield answers(np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["docs"], np.uint16)], (np.frombuffer(r["h"], np.uint64) | np.uint64(DONE)).view(np.int64))
        rest = t.filter(pa.array(~direct)).combine_chunks()
        if len(rest):
            bucket = rest.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = rest.slice(i, j - i)
                if part.nbytes > most_bytes:
                    yield from as_they_are(part)
                else:
                    yield answers(*judge(*(part.column(k).to_pylist() for k in range(2, 6))))

    for t, whole in groups(batches, 1, 1, most_rows):
        if whole:
            yield from solved(t)
        else:
            direct = t.column(1).to_numpy()
            yield from solved(t.filter(pa.array(direct)))
            yield from as_they_are(t.filter(pa.array(~direct)))


def refined(large: DataFrame) -> DataFrame:
    """doc_id and key as ``judge`` gives them, of packed anchors (ids, docs, h, around) of large buckets: aggregates over the cluster that gather no group."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc = np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["docs"], np.uint16)]
                yield pa.record_batch([pa.array(doc), pa.array(unshort(r["h"]).view(np.int64)), pa.array(unshort(r["around"]).view(np.int64))], names=["doc_id", "h", "around"])

    def keyed(bit: int):
        @F.pandas_udf("long")
        def key(h, around):
            import pandas as pd

            return pd.Series((answer_key(h.to_numpy(np.int64).view(np.uint64), around.to_numpy(np.int64).view(np.uint64)) | np.uint64(bit)).view(np.int64))

        return key("h", "around").alias("key")

    rows = large.mapInArrow(unpack, "doc_id long, h long, around long")
    first = written(rows.groupBy("h", "around").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "suffix-first")
    done = rows.join(first, ["h", "around"]).where("doc_id > first").select("doc_id", keyed(DONE))
    varied = first.groupBy("h").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("last").alias("high")).where("n > 1 and low < high").select("h")
    asked = first.join(varied, "h").select(F.col("first").alias("doc_id"), keyed(ASKED))
    return done.unionByName(asked)


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Intervals joined where they overlap or touch, within groups; sorted."""
    group = np.zeros(len(start), np.int64) if group is None else group
    if not len(start):
        return start, end, group
    by = np.lexsort((start, group))
    start, end, group = start[by], end[by], group[by]
    # Ends so far, made to start anew with each group by a shift that no end reaches.
    shift = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * (int(end.max()) + 1)
    upto = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], (start + shift)[1:] > upto[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return start[new], (upto - shift)[last], group[new]


def places(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """h, doc_id, start, end, lead, around: intervals that are done (around null), and surroundings that were asked for with the anchor's place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2)
            key_at = np.asarray(keys.offsets)
            flat = keys.values.to_numpy().view(np.uint64)
            whole, offsets = utf8(batch.column(1))
            for i, j in doc_slices(offsets):
                raw, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc, p, a, b, h, around = anchors(raw, at)
                key = answer_key(h, around)
                kind = np.full(len(key), -1)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    mine, x, y = flat[key_at[i + d] : key_at[i + d + 1]], first[d], first[d + 1]
                    for k, bit in ((DONE, np.uint64(DONE)), (ASKED, np.uint64(ASKED))):
                        some = np.sort(mine[mine & np.uint64(1) == bit])
                        if len(some):
                            here = key[x:y] | bit
                            kind[x:y][some[np.minimum(np.searchsorted(some, here), len(some) - 1)] == here] = k
                done = np.flatnonzero(kind == DONE)
                s, e, d = merged(a[done], b[done], doc[done])
                yield pa.record_batch(
                    [pa.array(mixed(d.astype(np.uint64) + np.uint64(i)).view(np.int64)), pa.array(ids[i:j][d]), pa.array((s - at[d]).astype(np.int64)), pa.array((e - at[d]).astype(np.int64)), pa.array(np.zeros(len(d), np.int32)), pa.nulls(len(d), pa.binary())],
                    names=["h", "doc_id", "start", "end", "lead", "around"],
                )
                for x in range(0, len(asked := np.flatnonzero(kind == ASKED)), 1 << 14):
                    k = asked[x : x + (1 << 14)]
                    size = b[k] - a[k]
                    cuts = np.concatenate([[0], np.cumsum(size)])
                    text = raw[np.arange(cuts[-1]) + np.repeat(a[k] - cuts[:-1], size)]
                    yield pa.record_batch(
                        [pa.array(h[k].view(np.int64)), pa.array(ids[i:j][doc[k]]), pa.array(a[k] - at[doc[k]]), pa.array(b[k] - at[doc[k]]), pa.array((p[k] - a[k]).astype(np.int32)), binary_rows(text, cuts)],
                        names=["h", "doc_id", "start", "end", "lead", "around"],
                    )

    keys = answers.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    joined = docs.select("doc_id", "text").join(keys, "doc_id").select("doc_id", "text", "keys")
    return joined.mapInArrow(run, "h long, doc_id long, start long, end long, lead int, around binary")


def refine(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A bucket for every position of the texts: equal where the `length` bytes from there are equal, -1 where the text is too short.

    Bucket-pointer refinement: buckets of eight bytes, then pairs of a bucket and
    the one at a later offset, until the depth is reached.
    """
    n = len(raw)
    if n < length:
        return np.full(n, -1)
    depth = 8
    padded = np.concatenate([raw, np.zeros(depth, np.uint8)])
    bucket = np.zeros(n, np.uint64)
    for k in range(depth):
        bucket = bucket << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    bucket = np.unique(bucket, return_inverse=True)[1]
    while depth < length:
        step = min(depth, length - depth)
        later = np.zeros(n, np.int64)
        later[:-step] = bucket[step:]
        bucket = np.unique(bucket * (int(bucket.max()) + 1) + later, return_inverse=True)[1]
        depth += step
    end = np.repeat(at[1:], np.diff(at))
    bucket[np.arange(n) + length > end] = -1
    return bucket


def covered(batches: Iterator[pa.RecordBatch], gathered: int) -> Iterator[pa.RecordBatch]:
    """doc_id, start, end: intervals that are done, and those of strings that a smaller document's surroundings have; rows sorted by h.

    The surroundings of a q-gram that has more than `gathered` go on with the anchor's place, lead, for ``equal_strings``.
    """
    names = ["doc_id", "start", "end", "lead", "around"]
    spans = lambda *columns: pa.record_batch([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.int32()), pa.nulls(len(columns[0]), pa.binary())], names=names)
    for t, whole in groups(batches, 1, 1 << 14, gathered):
        done = t.column(5).is_null().to_numpy()
        doc, start, end, lead = (t.column(k).to_numpy() for k in (1, 2, 3, 4))
        yield spans(*(x[done] for x in (doc, start, end)))
        if done.all():
            continue
        ask = np.flatnonzero(~done)
        if not whole:
            yield from t.select([1, 2, 3, 4, 5]).take(pa.array(ask)).rename_columns(names).to_batches()
            continue
        raw, at = utf8(t.column(5).combine_chunks().take(pa.array(ask)))
        row = np.repeat(np.arange(len(ask)), np.diff(at))
        place = np.arange(len(raw)) - at[row]
        bucket = refine(raw, at)
        # Strings that hold the anchor.
        use = np.flatnonzero((bucket >= 0) & (place <= lead[ask][row]) & (place + LENGTH >= lead[ask][row] + Q))
        bucket, of, from_ = bucket[use], doc[ask][row[use]], start[ask][row[use]] + place[use]
        by = np.lexsort((of, bucket))
        first = np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]])[: len(by)]
        repeat = by[of[by] > of[by][np.flatnonzero(first)][np.cumsum(first) - 1]]
        s, e, d = merged(from_[repeat], from_[repeat] + LENGTH, of[repeat])
        yield spans(d, s, e)


def equal_strings(large: DataFrame) -> DataFrame:
    """doc_id, start, end of the strings around an anchor that a smaller document has too; large has doc_id, start, lead and around. Strings are grouped over the cluster."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, lead = (batch.column(k).to_numpy() for k in range(3))
            raw, at = utf8(batch.column(3))
            low = np.maximum(lead + Q - LENGTH, 0)
            high = np.minimum(lead, np.diff(at) - LENGTH)
            n = np.maximum(high - low + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            place = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            text = raw[((at[row] + place)[:, None] + np.arange(LENGTH)).ravel()]
            yield pa.record_batch([pa.array(doc[row]), pa.array(start[row] + place), binary_rows(text, LENGTH * np.arange(len(row) + 1))], names=["doc_id", "start", "string"])

    rows = large.select("doc_id", "start", "lead", "around").mapInArrow(strings, "doc_id long, start long, string binary")
    first = rows.groupBy("string").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return rows.join(first, "string").where("doc_id > first").select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: bytes covered by LENGTH-byte strings that also start in a document with a smaller doc_id (intervals may overlap)."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = int(min(1 << 30, 16 + n_bytes // BUCKET_TEXT))
    packed = surroundings(docs, buckets).repartition("bucket").sortWithinPartitions("bucket")
    rows, size, gathered = BUCKET_ROWS, BUCKET_BYTES, GATHERED
    answers = written(packed.mapInArrow(lambda batches: judged(batches, rows, size), "doc_id long, key long, ids binary, docs binary, h binary, around binary"), "suffix-answers")
    released(spark)
    large = answers.where("ids is not null").select("ids", "docs", "h", "around")
    known = answers.where("ids is null").select("doc_id", "key")
    if not large.isEmpty():
        known = known.unionByName(written(refined(large), "suffix-large"))
    found = places(docs, known).repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: covered(batches, gathered), "doc_id long, start long, end long, lead int, around binary")
    spans = written(found, "suffix-spans")
    released(spark)
    large = spans.where("around is not null")
    some = spans.where("around is null").select("doc_id", "start", "end")
    return some if large.isEmpty() else some.unionByName(written(equal_strings(large), "suffix-strings"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every document.

    Texts are UTF-8 bytes, null is empty; strings never cross documents, and a
    document doesn't repeat itself. Texts under LENGTH bytes lose nothing. Rows
    that share a doc_id are judged alike: none repeats the other, and intervals
    of either apply to both where they fit. Null doc_ids lose nothing and cost
    nobody anything. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            spans = batch.column(2).to_pylist()
            out = []
            for i, some in enumerate(spans):
                text = raw[at[i] : at[i + 1]]
                removed, n = 0, 0
                if some:
                    a = np.array([(x["start"], x["end"]) for x in some], np.int64)
                    s, e, _ = merged(a[:, 0], np.minimum(a[:, 1], len(text)))
                    removed, n = int((e - s).sum()), len(s)
                    edges = np.concatenate([[0], np.stack([s, e], 1).ravel(), [len(text)]])
                    text = np.concatenate([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                kept = text.tobytes()
                out.append((int(at[i + 1] - at[i]), removed, n, hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 50 bytes take from every document (the contract of ``without_repeats``)."""
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")
