"""Exact Jaccard join on word shingles in the metric space of sets.

The Jaccard distance is a metric. Two documents link at a distance of 0.2 or
less, and the join finds all components of links, exactly:

1. *Reach.* Sets that link differ in a fifth of either at most, so they share s
   shingles at least among the first fifth and s more of each in one global
   order of shingles, whatever s is. Here s grows with the smaller set. The
   order puts very common shingles last, so passages that many documents share
   don't draw together documents that have nothing else in common. A document
   is replicated to the cells of these shingles only.
2. *Regions.* A small cell proposes its pairs; a pair that meets in no large cell
   must meet in s small ones, and is then tested around its smaller document,
   the pivot. A large cell becomes a region around its smallest document, cut
   into slabs of similar set sizes (a window by the triangle inequality with
   the empty set as pivot: sizes of linked documents differ by a quarter at most).
3. *Recursion.* A region picks pivots and measures every member's distance to
   them. Members within the radius link to a pivot. Pivots far from each other
   make Voronoi regions: a member within ``CORE`` of its nearest pivot is of the
   core of that region, and members as near to that pivot as CORE and the radius,
   but not much nearer to another, are its boundary and go there too. Members of
   no core are told apart by the shingles they share: linked sets have one in common
   among the rarest fifth of either, by how often shingles occur among these
   members, so each such shingle that two of them have makes a region. Within the
   triangle window of distances to the pivot a region keeps only members between which links that connect
   anything new can be. Regions beyond ``LOCAL`` shingles do this step by step
   over the cluster, dealt by a salt; others in a task, pivot by pivot.

Sets travel as sorted 64-bit hashes; links compare intersections and unions by
integers. A set that several documents have in common, by a digest of 128 bits
and its size, takes part once; within a cell the first 64 bits and the size tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import binary_rows, by_key, groups, released, slices, table, utf8, written
from phonoframe.llm.components import components
from phonoframe.llm.shingles import set_digest, shingle_sets

SIZE = 5
#: Documents link when PART * |intersection| >= LINK * |union|.
PART, LINK = 100, 80
#: Shingles that linked sets share in their reach: so many and this per cent of the smaller set.
SHARED, SHARED_PER_CENT = 2, 4
#: A shingle is common from this many documents on; of these the most frequent go last, at most COMMON_MOST (the order decides the cost, not the result).
COMMON, COMMON_MOST = 48, 1 << 18
#: Cells of up to this many sets propose pairs; rows of a cell that a task gathers at most; digests that a task remembers, so as to post a set once.
SMALL, GATHERED, REMEMBERED = 48, 1 << 18, 1 << 20
#: Shingles of all members of a region that one task joins (8 bytes each).
LOCAL = 3_000_000
#: Members of a large region, by a hash, of which each becomes a pivot; members of one salt, about; distance within which a Voronoi region has its core.
PIVOTS, SALT_MEMBERS, CORE = 32, 4096, 0.3
#: The radius of links, and a little for rounding.
RADIUS = (PART - LINK) / PART + 1e-9
#: Steps of distance in which large regions look for members to excuse.
BINS = 100
_SLICE = 1 << 20


def reach(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order: those that aren't common, then the common ones, each by hash."""
    n = len(tokens)
    most = min(n, (PART - LINK) * n // PART + SHARED + SHARED_PER_CENT * n // 100)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        late = common[at] == tokens
        if late.any():
            tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[:most]


def sets_of(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    raw, at = utf8(texts)
    for i, j in slices(at, _SLICE):
        yield i, shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], SIZE)


def common_shingles(docs: DataFrame, least: int = COMMON, most: int = COMMON_MOST) -> np.ndarray:
    """Sorted hashes of shingles in the plain reach of at least `least` documents, the `most` most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in sets_of(batch.column(0)):
                token, n = np.unique(np.concatenate([reach(s, np.zeros(0, np.uint64)) for s in sets]), return_counts=True)
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(n.astype(np.int32))], names=["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token long, n int").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).toArrow()
    return np.sort(np.asarray(top.column(0)).view(np.uint64))


def postings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """token, digest, n, doc_id: a row per shingle of a document's reach, with the first number of its set's digest and its size.

    And a row per document with both numbers of its digest as token and digest
    and minus its size, less one, as n. Of copies that one task reads the first
    posts the shingles, so a cell holds a row per set and task at most.
    """
    remembered = REMEMBERED
    sent = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON_MOST hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        none = np.zeros(0, np.uint64)
        for batch in batches:
            has_id = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, sets in sets_of(batch.column(1)):
                keys = [set_digest(s) for s in sets]
                parts = []
                for k, s in enumerate(sets):
                    again = keys[k] in seen or not has_id[i + k]
                    parts.append(none if again else reach(s, sent.value))
                    if not again:
                        seen.add(keys[k])
                if len(seen) > remembered:
                    seen.clear()
                digests = np.array(keys, np.int64).reshape(-1, 2)
                n = np.array([len(s) for s in sets], np.int32)
                row = np.repeat(np.arange(len(sets)), [len(x) for x in parts])
                token = np.concatenate([*parts, digests[:, 0].view(np.uint64)]).view(np.int64)
                doc = batch.column(0).slice(i, len(sets))
                yield pa.record_batch(
                    [pa.array(token), pa.array(np.concatenate([digests[row, 0], digests[:, 1]])), pa.array(np.concatenate([n[row], -1 - n])), pa.concat_arrays([doc.take(pa.array(row)), doc])],
                    names=["token", "digest", "n", "doc_id"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "token long, digest long, n int, doc_id long")


def slab(n: np.ndarray) -> np.ndarray:
    """Linked sets are in the same slab or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(PART / LINK) + 1e-9).astype(np.int64)


def cells(posted: DataFrame) -> DataFrame:
    """kind, a, b, slab, c: pairs (0; a < b; the smaller size as slab) of small cells, members b of regions (1) around a, documents a with digest b, c and size slab (2), members b of cells a (3) that are too large to gather."""
    gathered = GATHERED

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in groups(batches, 1, 1 << 16, gathered):
            token, key, n, ids = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy().astype(np.int64), t.column(3)
            valid = ids.is_valid().to_numpy()
            doc = pc.fill_null(ids, 0).to_numpy()
            own = n < 0
            no_id, second = ~valid[own], key[own]
            a, b, s, kind = [doc[own]], [token[own]], [-1 - n[own]], [np.full(int(own.sum()), 2, np.int8)]
            # Rows of a token are sorted by set and doc_id: the first of a set stands for it.
            token, key, n, doc = (x[~own & valid] for x in (token, key, n, doc))
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])])[: len(token)]
            token, doc, n = token[first], doc[first], n[first]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            size = np.diff(start, append=len(token))
            count = np.repeat(size, size)
            place = np.arange(len(token)) - np.repeat(start, size)
            if not whole:
                for down in (0, 1):
                    a, b, s, kind = [*a, token], [*b, doc], [*s, slab(n) - down], [*kind, np.full(len(token), 3, np.int8)]
                size, count, place = size[:0], count[:0], place[:0]
            left = np.flatnonzero((count <= SMALL) & (count - place > 1))
            for step in range(1, SMALL):
                i = left = left[(count - place)[left] > step]
                if not len(i):
                    break
                x, y, p, q = doc[i], doc[i + step], n[i], n[i + step]
                near = PART * np.minimum(p, q) >= LINK * np.maximum(p, q)
                a.append(np.minimum(x, y)[near])
                b.append(np.maximum(x, y)[near])
                s.append(np.minimum(p, q)[near])
                kind.append(np.zeros(len(a[-1]), np.int8))
            for i in np.flatnonzero(size > SMALL):
                d, at = doc[start[i] : start[i] + size[i]], slab(n[start[i] : start[i] + size[i]])
                for k in np.unique(at):
                    members = d[(at == k) | (at == k + 1)]
                    if len(members) > 1:
                        a.append(np.full(len(members), members.min()))
                        b.append(members)
                        s.append(np.full(len(members), k))
                        kind.append(np.ones(len(members), np.int8))
            kind, a, b, s = map(np.concatenate, (kind, a, b, s))
            more = np.zeros(len(a) - len(no_id), np.int64)
            yield pa.record_batch([pa.array(kind), pa.array(a, mask=np.append(no_id, more > 0)), pa.array(b), pa.array(s), pa.array(np.append(second, more))], names=["kind", "a", "b", "slab", "c"])

    # Sets of documents are dealt by shingle; each cell is one run of rows, however many copies of a set there are.
    return posted.repartition("token").sortWithinPartitions("token", "digest", "n", "doc_id").mapInArrow(meet, "kind byte, a long, b long, slab long, c long")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of different numbers."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0


class Region:
    """Members of a region in a task: their sets in one array, so that a pivot meets all members at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, self.code = np.unique(flat, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.mark = np.zeros(int(self.code.max(initial=-1)) + 1, bool)

    def codes(self, i: int) -> np.ndarray:
        return self.code[self.at[i] : self.at[i + 1]]

    def shared(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Intersection sizes of the members with the pivot."""
        mine = self.codes(pivot)
        self.mark[mine] = True
        sizes = self.sizes[members]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[members] - (ends - sizes), sizes)
        hits = np.concatenate([[0], np.cumsum(self.mark[self.code[take]])])
        self.mark[mine] = False
        return hits[ends] - hits[ends - sizes]

    def hubs(self) -> np.ndarray:
        """Members in the order in which they are to be pivots: those whose shingles the others share most come first."""
        often = np.bincount(self.code, minlength=len(self.mark))[self.code]
        return np.argsort(-np.add.reduceat(often, self.at[:-1]) / self.sizes, kind="stable")

    def links(self) -> list[tuple[int, int]]:
        """Links that connect every component of the region. Sets are not empty.

        Every member is a pivot in its turn unless it is excused: by the triangle
        inequality a member links only with members whose distance to a pivot
        differs from its own by the radius at most, and where all of these are in
        its component already, nothing is left to find.
        """
        n = len(self.sizes)
        alive, label, out = np.ones(n, bool), np.arange(n), []
        for p in self.hubs().tolist():
            if not alive[p]:
                continue
            alive[p] = False
            rest = np.flatnonzero(alive)
            if not len(rest):
                break
            shared = self.shared(p, rest)
            union = self.sizes[rest] + self.sizes[p] - shared
            linked = rest[PART * shared >= LINK * union]
            new = linked[label[linked] != label[p]]
            _, one_each = np.unique(label[new], return_index=True)
            out += [(p, int(x)) for x in new[one_each]]
            label[np.isin(label, label[new])] = label[p]
            by = np.argsort(1 - shared / union, kind="stable")
            distance, at = (1 - shared / union)[by], label[rest][by]
            changes = np.concatenate([[0], np.cumsum(at[1:] != at[:-1])])
            low = np.searchsorted(distance, distance - RADIUS)
            high = np.searchsorted(distance, distance + RADIUS, "right") - 1
            alive[rest[by[changes[low] == changes[high]]]] = False
        return out


def join_pairs(pivot: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets link with the pivot's."""
    shared = np.array([overlap(pivot, s) for s in others])
    union = np.array([len(s) for s in others]) + len(pivot) - shared
    return PART * shared >= LINK * union


def with_sets(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of members (kind, a, slab, salt, b, digest) with the set of document b as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column(2).to_numpy()
            for i, sets in sets_of(batch.column(0)):
                # A doc_id may stand for several texts: only the one that was meant goes on.
                good = np.flatnonzero([set_digest(s)[0] == d for s, d in zip(sets, digests[i : i + len(sets)], strict=True)])
                if not len(good):
                    continue
                regions = batch.column(1).slice(i, len(sets)).take(pa.array(good))
                row = good[np.repeat(np.arange(len(good)), np.diff(np.asarray(regions.offsets)))]
                some, doc = regions.flatten(), batch.column(3).slice(i, len(sets))
                bounds = np.concatenate([[0], np.cumsum([8 * len(sets[k]) for k in row])])
                for j, k in slices(bounds, 4 << 20):
                    part = row[j:k]
                    out = [sets[k] for k in part]
                    yield pa.record_batch(
                        [*(some.field(k).slice(j, len(part)) for k in range(4)), doc.take(pa.array(part)), binary_rows(np.concatenate(out), np.cumsum([0, *map(len, out)]))],
                        names=["kind", "a", "slab", "salt", "b", "tokens"],
                    )

    wanted = members.groupBy("b", "digest").agg(F.collect_set(F.struct("kind", "a", "slab", "salt")).alias("regions"))
    joined = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("b")).select("text", "regions", "digest", "doc_id")
    return joined.mapInArrow(run, "kind byte, a long, slab long, salt int, b long, tokens binary")


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of whole regions (rows sorted by kind, a and slab); rows with a salt go on as they are."""
    names, nothing = ["u", "v", "a", "slab", "tokens"], lambda n, t: pa.nulls(n, t)
    for t in by_key(batches, 3, 256):
        salted = t.filter(pc.greater(t.column(3), 0)).combine_chunks()
        if len(salted):
            for batch in salted.to_batches():
                yield pa.record_batch([batch.column(4), nothing(len(batch), pa.int64()), batch.column(1), batch.column(2), batch.column(5)], names=names)
        t = t.filter(pc.equal(t.column(3), 0)).combine_chunks()
        if not len(t):
            continue
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)])
        start = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        end = np.append(start[1:], len(t))
        doc, tokens = t.column(4).to_numpy(), t.column(5).combine_chunks()
        u, v = [], []
        for i, j in zip(start.tolist(), end.tolist(), strict=True):
            sets = [np.frombuffer(tokens[k].as_buffer(), np.uint64) for k in range(i, j)]
            if key[0, i] == 0:
                linked = np.zeros(j - i, bool)
                for p in np.flatnonzero(doc[i:j] == key[1, i]).tolist():  # rows that share the doc_id with different texts
                    linked |= join_pairs(sets[p], sets)
                linked = np.flatnonzero(linked)
                u += [int(key[1, i])] * len(linked)
                v += doc[i + np.asarray(linked, np.int64)].tolist()
            else:
                for x, y in Region(sets).links():
                    u.append(int(doc[i + x]))
                    v.append(int(doc[i + y]))
        n = len(u)
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), nothing(n, pa.int64()), nothing(n, pa.int64()), nothing(n, pa.binary())], names=names)


def centres(pivots: list[np.ndarray]) -> list[int]:
    """Pivots so far from each other that no member is of two cores or of one core and another's boundary."""
    out: list[int] = []
    for i, s in enumerate(pivots):
        shared = np.array([overlap(s, pivots[j]) for j in out])
        union = np.array([len(s) + len(pivots[j]) for j in out]) - shared
        if (1 - shared / union > 2 * CORE + RADIUS).all():
            out.append(i)
    return out


def measured(region: DataFrame) -> DataFrame:
    """Members of large regions (region, b, label, tokens) with links, the pivots (p, l: its label) that they link with, and places, the Voronoi regions they go to (c: its pivot or null, d: distance, core)."""
    # The pivots are members that a hash gives, so that each round looks at other places.
    drawn = F.pmod(F.xxhash64("b", "region"), F.lit(PIVOTS))
    few = region.groupBy("region", drawn.alias("k")).agg(F.min("b").alias("b")).select("region", "b")
    salts = region.groupBy("region").agg(F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("salts"))
    pivots = region.join(few, ["region", "b"], "left_semi").join(salts, "region").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    members = region.join(few, ["region", "b"], "left_anti").join(salts, "region").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    columns = ["region", "salt", "member", "b", "label", "tokens"]
    both = pivots.withColumn("member", F.lit(0).cast("byte")).select(*columns).unionByName(members.withColumn("member", F.lit(1).cast("byte")).select(*columns))
    link, place = pa.list_(pa.struct([("p", pa.int64()), ("l", pa.int64())])), pa.list_(pa.struct([("c", pa.int64()), ("d", pa.float64()), ("core", pa.bool_())]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, labels, sets, voronoi = None, [], [], [], None
        for batch in batches:
            region, salt, member, b, label = (batch.column(k).to_numpy() for k in range(5))
            keep, links, places = [], [], []
            for i in range(len(batch)):
                if at != (region[i], salt[i]):
                    at, ids, labels, sets, voronoi = (region[i], salt[i]), [], [], [], None
                tokens = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint64)
                first = not member[i]
                if not first and voronoi is None:
                    voronoi = centres(sets)
                shared = np.array([overlap(tokens, s) for s in sets], np.int64)
                union = np.array([len(tokens) + len(s) for s in sets], np.int64) - shared
                hit = np.flatnonzero(PART * shared >= LINK * union)
                if first:  # pivots meet the pivots before them
                    ids.append(int(b[i]))
                    labels.append(int(label[i]))
                    sets.append(tokens.copy())
                    if salt[i] or not len(hit):
                        continue
                    where = []
                else:
                    d = (1 - shared / union)[voronoi]
                    near = int(d.argmin())
                    where = [{"c": ids[v], "d": float(x), "core": k == near and x <= CORE} for k, (v, x) in enumerate(zip(voronoi, d.tolist(), strict=True)) if x <= CORE + RADIUS and x <= d[near] + 2 * RADIUS]
                    if d[near] > CORE:
                        where.append({"c": None, "d": 0.0, "core": True})
                keep.append(i)
                links.append([{"p": ids[k], "l": labels[k]} for k in hit])
                places.append(where)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([some.column(0), some.column(3), some.column(4), some.column(5), pa.array(links, link), pa.array(places, place)], names=["region", "b", "label", "tokens", "links", "places"])

    dealt = both.repartition("region", "salt").sortWithinPartitions("region", "salt", "member", "b")
    return dealt.mapInArrow(measure, "region long, b long, label long, tokens binary, links array<struct<p:long,l:long>>, places array<struct<c:long,d:double,core:boolean>>")


def _merged_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of one region that links join, each with the smallest label of its group."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while to.setdefault(x, x) != x:
            x = to[x]
        return x

    for x, y in zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True):
        p, q = root(x), root(y)
        to[max(p, q)] = min(p, q)
    return pd.DataFrame({"region": pdf["region"].iloc[0], "old": list(to), "new": [root(x) for x in to]})


def step(region: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of the pivots of each large region, and the regions that are left (both from one written table)."""
    at = written(measured(region), "jaccard-step")
    each = at.select("region", "b", "label", (F.size("places") == 0).alias("pivot"), F.explode("links").alias("to"))
    links = each.select(F.col("to.p").alias("u"), F.col("b").alias("v"))
    # Labels that links join: of pivots, and of earlier pivots; a member's own label is its id, and nobody else has it.
    several = at.where(F.size("links") > 1).select("region", F.get("links", F.lit(0))["l"].alias("x"), F.explode("links.l").alias("y"))
    pairs = each.where("pivot or label <> b").select("region", F.col("label").alias("x"), F.col("to.l").alias("y")).unionByName(several).distinct()
    joined = pairs.groupBy("region").applyInPandas(_merged_labels, "region long, old long, new long")
    label = F.coalesce(F.get("links", F.lit(0))["l"], F.col("label"))
    now = at.where(F.size("places") > 0).withColumn("old", label).join(joined, ["region", "old"], "left").withColumn("label", F.coalesce("new", "old"))
    spread = now.select("region", "b", "label", "tokens", F.explode("places").alias("to"))
    apart = rare_cells(spread.where("to.c is null").select("region", "b", "label", "tokens"))
    rest = spread.where("to.c is not null").select(F.xxhash64("region", "to.c").alias("region"), "b", "label", "tokens", F.floor(F.col("to.d") * BINS).alias("bin"), F.col("to.core").alias("core"))
    by_bin = rest.groupBy("region", "bin").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("core").alias("core"))
    reach_bins = (PART - LINK) * BINS // PART + 1
    around = Window.partitionBy("region").orderBy("bin").rangeBetween(-reach_bins, reach_bins)
    some = by_bin.withColumns({"low": F.min("low").over(around), "high": F.max("high").over(around), "core": F.max("core").over(around)})
    open_bins = some.where("low <> high and core").select("region", "bin")
    return links, rest.join(open_bins, ["region", "bin"], "left_semi").select("region", "b", "label", "tokens").unionByName(apart)


def rare_cells(members: DataFrame) -> DataFrame:
    """Regions (region, b, label, tokens) of members that share one of the rarest shingles of each, rare by their counts within the old region.

    Of a set of n shingles no linked one lacks more than a fifth, so two that link
    share one of the first n - ceil(0.8 n) + 1 of each in any one order. A shingle
    that one member has alone stands first and makes no region. Labels that are all
    the same have nothing new to connect.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(2))
            n = np.diff(at) // 8
            row = pa.array(np.repeat(np.arange(len(batch)), n))
            yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(raw, np.int64))], names=["region", "b", "n", "token"])

    each = members.select("region", "b", "tokens").mapInArrow(tokens, "region long, b long, n long, token long")
    counts = each.groupBy("region", "token").agg(F.count("*").alias("f")).where("f > 1")
    shared = each.join(counts, ["region", "token"])
    own = Window.partitionBy("region", "b")
    # Shingles of one's own come before the shared ones.
    place = F.row_number().over(own.orderBy("f", "token")) + F.col("n") - F.count("*").over(own)
    first = shared.withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * (PART - LINK) / PART) + 1)
    met = members.join(first.select("region", "b", F.xxhash64("region", "token").alias("cell")), ["region", "b"])
    several = met.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("cell")
    return met.join(several, "cell", "left_semi").select(F.col("cell").alias("region"), "b", "label", "tokens")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) that connect the components of different sets, and doc_id, digest, n_shingles of every document."""
    common = common_shingles(docs)
    released(docs.sparkSession)
    found = written(cells(postings(docs, common)), "jaccard-cells")
    sets = found.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("digest"), F.col("c").alias("digest_2"), F.col("slab").alias("n_shingles"))
    released(docs.sparkSession)
    enough = SHARED + F.floor(F.col("n") * SHARED_PER_CENT / 100)
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("met"), F.min("slab").alias("n")).where(F.col("met") >= enough)
    around = pairs.select(F.lit(0).cast("byte").alias("kind"), "a", F.lit(0).cast("long").alias("slab"), "b")
    around = around.unionByName(around.select("kind", "a", "slab", F.col("a").alias("b")).distinct())
    regions = found.where("kind = 1").select("kind", "a", "slab", "b")
    large = found.where("kind = 3").select("a", "slab", "b")
    if not large.isEmpty():
        # A slab of a large cell becomes a region around its smallest document, too.
        low = large.groupBy("a", "slab").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high").drop("high")
        regions = regions.unionByName(large.join(low, ["a", "slab"]).select(F.lit(1).cast("byte").alias("kind"), F.col("low").alias("a"), "slab", "b"))
    regions = regions.distinct()
    weighed = regions.join(sets.select(F.col("doc_id").alias("b"), "n_shingles"), "b")
    size = weighed.groupBy("kind", "a", "slab").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > LOCAL).drop("n")
    large = regions.join(size, ["kind", "a", "slab"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 16)).cast("int") + 1)
    small = regions.join(size, ["kind", "a", "slab"], "left_anti").unionByName(around).withColumn("salt", F.lit(0))
    members = small.unionByName(large).join(sets.select(F.col("doc_id").alias("b"), "digest"), "b")
    dealt = with_sets(members, docs).repartition("kind", "a", "slab", "salt").sortWithinPartitions("kind", "a", "slab")
    solved = written(dealt.mapInArrow(solve, "u long, v long, a long, slab long, tokens binary"), "jaccard-links")
    released(docs.sparkSession)
    links = solved.where("a is null").select("u", "v")
    region = solved.where("a is not null").select(F.xxhash64("a", "slab").alias("region"), F.col("u").alias("b"), F.col("u").alias("label"), "tokens")
    more = not region.isEmpty()
    while more:
        got, rest = step(region)
        rest = written(rest, "jaccard-rest")
        size = rest.groupBy("region").agg((F.sum(F.octet_length("tokens")) / 8).alias("n"))
        left = rest.join(size.where(F.col("n") <= LOCAL).drop("n"), "region", "left_semi")
        last = left.select(F.lit(1).cast("byte").alias("kind"), F.col("region").alias("a"), F.lit(0).cast("long").alias("slab"), F.lit(0).alias("salt"), "b", "tokens").repartition("a").sortWithinPartitions("a")
        links = links.unionByName(got).unionByName(written(last.mapInArrow(solve, "u long, v long, a long, slab long, tokens binary").select("u", "v"), "jaccard-links"))
        region = written(rest.join(size.where(F.col("n") > LOCAL).drop("n"), "region", "left_semi"), "jaccard-region")
        more = not region.isEmpty()
    return links, sets


def joined_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Null texts, empty texts and texts without words have no shingles and are
    components of their own. Rows that share a doc_id are one document to the
    components, linked by any of their texts. Null doc_ids link with nothing and
    have a null component. An empty table gives no rows.
    """
    links, sets = linked(docs)
    of_set = ["digest", "digest_2", "n_shingles"]
    same = sets.where("n_shingles > 0").groupBy(*of_set).agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = sets.where("n_shingles > 0").join(same, of_set).where("doc_id <> u").select("u", F.col("doc_id").alias("v"))
    joined = components(links.unionByName(copies))
    return sets.join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under word-shingle links (the contract of ``joined_components``)."""
    return joined_components(table(spark, sf_dir, "documents"))
