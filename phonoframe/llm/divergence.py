"""How sources of a language differ, by inclusion and exclusion over the supports of their term counts.

A group (lang, source) gives every kept term of its language, with c occurrences,
p(c) = 1 + floor(10^9 (c + 1) / (N + V)), and two groups diverge by the sum over
all V terms of f(p, q) = floor((p - q)^2 / q). Terms that a group lacks all have
p(0), so no dense table of groups and terms is needed. With A and B the terms that
each of two groups has:

* A histogram of a group's counts prices all of A against q(0), and that of the
  other group all of B against p(0).
* Terms in A and B were priced twice: a join of the sparse postings adds
  f(p, q) - f(p, q(0)) - f(p(0), q) + f(p(0), q(0)) for each of them.
* The other V - |A| - |B| (this may be negative) count f(p(0), q(0)) each.

All numbers are whole numbers; sums beyond 64 bits would be errors, not results.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoframe.llm.common import slices, table, utf8, written

#: A term is kept in a language from so many of its documents on.
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
#: Ranks that a group's list of terms ends at: a report's length.
TOP_TERMS = 200
#: Bytes of text cut into terms at once, and different (group, term) pairs that a task holds before it hands them on.
_SLICE, _HELD = 1 << 20, 300_000
#: ASCII letters become small ones, other ASCII bytes separate; bytes of longer characters stay.
_TERMS = bytes(b | 32 if chr(b).isalpha() else 32 if b < 128 else b for b in range(128)) + bytes(range(128, 256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents): sums over parts of the tasks' rows, to be summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        d: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for group, own in n.items():
                rows = len(own)
                yield pa.record_batch(
                    [pa.array([x], pa.string()).take(pa.array(np.zeros(rows, np.int64))) for x in group]
                    + [pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([d[group][t] for t in own], pa.int64())],
                    names=["lang", "source", "term", "n", "d"],
                )
            n.clear()
            d.clear()

        for batch in batches:
            raw, at = utf8(batch.column(2))
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for i, j in slices(at, _SLICE):
                for k in range(i, j):
                    terms = raw[at[k] : at[k + 1]].tobytes().translate(_TERMS).split()
                    n[groups[k]].update(terms)
                    d[groups[k]].update(set(terms))
                if sum(map(len, n.values())) > _HELD:
                    yield from flushed()
        yield from flushed()

    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return own.mapInArrow(run, "lang string, source string, term string, n long, d long")


def postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, c and lang_c (the language's occurrences) of every kept term that a group has."""
    # Parts are summed where a term of a language meets, so that its documents are known in the same place.
    met = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("c"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    kept = met.withColumn("lang_c", F.sum("c").over(term)).withColumn("_d", F.sum("d").over(term)).where(F.col("_d") >= least)
    return kept.select("lang", "source", "term", "c", "lang_c")


def share(c: Column, total: Column) -> Column:
    """p of a count: 1 + floor(SCALE (c + 1) / total), total being N + V."""
    return (F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (c + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)")) + 1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def supports(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """lang, source, a (terms that the group has), v (terms that the language keeps), total (N + V), lang_total and p0, for every group; p0 is null where v is 0."""
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = posted.groupBy("lang", "source").agg(F.count("*").alias("a"), F.sum("c").alias("n"))
    whole = posted.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("c").alias("lang_n"))
    met = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["a", "n", "v", "lang_n"])
    with_totals = met.withColumn("total", F.col("n") + F.col("v")).withColumn("lang_total", F.col("lang_n") + F.col("v"))
    return with_totals.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total")))).drop("n", "lang_n")


def _both_ways(x: str, y: str, there: Column, back: Column) -> Column:
    """Two rows (source, item, value): x against y, and y against x."""
    row = lambda a, b, v: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), v.alias("value"))
    return F.inline(F.array(row(x, y, there), row(y, x, back)))


def pairs(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """lang, source, item, value: every group against every other one of its language. posted has p and p0 besides."""
    p, q, p0, q0 = (F.col(x) for x in ("p", "q", "p0", "q0"))
    # Terms that one group has, at a price for each different count.
    histogram = posted.groupBy("lang", "source", "p").agg(F.count("*").alias("h"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    faced = histogram.join(others, "lang").where("source <> other")
    one_sided = faced.select("lang", _both_ways("source", "other", F.col("h") * divergence(p, q0), F.col("h") * divergence(q0, p)))
    # Terms that both have.
    x = posted.select("lang", "term", "source", "p", "p0")
    y = posted.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = x.join(y, ["lang", "term"]).where("source < other")
    correction = lambda a, b, a0, b0: divergence(a, b) - divergence(a, b0) - divergence(a0, b) + divergence(a0, b0)
    corrected = shared.select("lang", _both_ways("source", "other", correction(p, q, p0, q0), correction(q, p, q0, p0)))
    # Terms that neither has, and a row for every pair.
    s = groups.select("lang", "source", "v", "a", "p0")
    t = groups.select("lang", F.col("source").alias("item"), F.col("a").alias("b"), F.col("p0").alias("q0"))
    neither = F.coalesce((F.col("v") - F.col("a") - F.col("b")) * divergence(p0, q0), F.lit(0))
    constant = s.join(t, "lang").where("source <> item").select("lang", "source", "item", neither.alias("value"))
    return constant.unionByName(one_sided).unionByName(corrected).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def ranked(values: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(order))
    if most is not None:
        out = out.where(F.col("rank") <= most)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank of every group.

    `pair`: the group's divergence from each other source of its language.
    `term`: terms that the group uses more than its language, by their part of the
    divergence, to rank `top`. Ties go to the smaller item by its UTF-8 bytes. Null
    lang, source and text are ''; a group without terms differs from others by
    p(0); where a language keeps no term, pairs have value 0. Repeated rows count
    one by one; an empty table gives no rows.
    """
    posted = written(postings(docs, least), "divergence-postings")
    groups = written(supports(docs, posted), "divergence-groups")
    shares = posted.join(groups.drop("a", "v"), ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("total")))
    priced = written(shares.select("lang", "source", "term", "p", "p0", share(F.col("lang_c"), F.col("lang_total")).alias("q")), "divergence-shares")
    own = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(pairs(groups, priced), "pair").unionByName(ranked(own, "term", top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (the contract of ``audited``)."""
    return audited(table(spark, sf_dir, "documents"))


#: Every group against every kept term, one by one.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term),
p AS (SELECT lang, source, term, c, CAST(1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER o + count(*) OVER o) AS BIGINT) AS p FROM dense WINDOW o AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (c + 1) // (sum(c) OVER o + count(*) OVER o) AS BIGINT) AS q FROM l WINDOW o AS (PARTITION BY lang)),
priced AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced ON priced.lang = a.lang AND priced.source = a.source AND priced.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
