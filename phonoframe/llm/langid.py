"""Language identification by prediction by partial matching (PPM).

A language's model is a tree of byte contexts of length 0 to 3; longer contexts
exist only where training saw them often enough. A byte that its longest
context has not seen costs an escape (method C, with exclusion) and is coded in
the next shorter one, at last uniformly over the bytes the language never used.
After training the statistics are frozen, so the exact code length of a byte
depends on its context and itself only: scoring is a lookup per byte, and a
text belongs to the language that codes it in the fewest bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm.common import kept, table, utf8

#: Labelled documents per language that training uses (in expectation; drawn by a hash of doc_id).
SAMPLE_DOCS = 1500
#: A context of one to three bytes is kept from this many occurrences on.
MIN_CONTEXT = 4
UNDETERMINED = "und"
_CHUNK = 1 << 18


def context_symbols(symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The symbols one, two and three places back; 0 before the start of a document."""
    out = []
    for back in (1, 2, 3):
        s = np.zeros_like(symbols)
        s[back:] = symbols[:-back]
        for near in range(back):
            at = starts + near
            s[at[(at >= 0) & (at < len(s))]] = 0
        out.append(s)
    return out


def chunks(raw: np.ndarray, at: np.ndarray, size: int = _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Stretches of the buffer of at most `size` bytes, whatever the lengths of documents.

    Each with up to three bytes before it (their number comes last), the starts of
    documents in it, the cuts between documents and the document after each cut.
    """
    for a in range(0, len(raw), size):
        b, lead = min(a + size, len(raw)), min(3, a)
        starts = at[np.searchsorted(at, a - lead) : np.searchsorted(at, b)] - (a - lead)
        inner = np.unique(at[np.searchsorted(at, a, "right") : np.searchsorted(at, b)])
        cuts = np.concatenate([[a], inner])
        yield raw[a - lead : b], starts, cuts - a, np.searchsorted(at, cuts, "right") - 1, lead


def four_grams(docs: DataFrame) -> DataFrame:
    """lang, code (a byte and the three before it) and n over texts of labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = batch.column(1)
            for lang in sorted(set(langs)):
                raw, at = utf8(texts.filter(pa.array([x == lang for x in langs])))
                for part, starts, _, _, lead in chunks(raw, at):
                    x = part.astype(np.uint32)
                    one, two, three = context_symbols(x, starts)
                    code, n = np.unique((three << 24 | two << 16 | one << 8 | x)[lead:], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """Frozen statistics of one language: cost[state, symbol] in bits; state = at3[at2[two, one], three]."""

    at2: np.ndarray
    at3: np.ndarray
    cost: np.ndarray


def alphabet(codes: list[np.ndarray]) -> np.ndarray:
    """Byte -> symbol. 0 is the start of a text (and the byte 0), the last symbol stands for all bytes that training never saw."""
    seen = np.zeros(256, bool)
    for c in codes:
        for shift in (0, 8, 16, 24):
            seen[np.unique(c >> shift & 255)] = True
    seen[0] = False
    out = np.full(256, seen.sum() + 1, np.int64)
    out[0] = 0
    out[seen] = np.arange(1, seen.sum() + 1)
    return out


def grow(code: np.ndarray, n: np.ndarray, symbol: np.ndarray, min_context: int = MIN_CONTEXT) -> Tree:
    """The context tree of one language from its 4-gram counts."""
    size = int(symbol.max()) + 1
    x, one, two, three = (symbol[code >> s & 255] for s in (0, 8, 16, 24))
    context = [np.zeros_like(x), one, two * size + one, (three * size + two) * size + one]
    keys, costs, after, counts, base = [], [], [], [], [0]
    for k in range(4):
        key, row = np.unique(context[k], return_inverse=True)
        total = np.bincount(row, n, len(key))
        kept = total >= (min_context if k else 1)
        place = np.cumsum(kept) - 1
        use = kept[row]
        count = np.zeros((int(kept.sum()), size))
        np.add.at(count, (place[row[use]], x[use]), n[use])
        key = key[kept]
        seen = count > 0
        every, kinds = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        if k == 0:
            unused = 256 - int(kinds[0, 0]) if len(count) else 256
            escaped = np.full(count.shape, np.log2(max(unused, 1)))
        else:
            parent = np.searchsorted(keys[k - 1], key % size ** (k - 1))
            above = np.where(seen, 0, counts[k - 1][parent])
            left, new = above.sum(1, keepdims=True), (above > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                down = np.where(new > 0, np.log2((left + new) / np.maximum(new, 1)), 0.0)
                escaped = np.where(above > 0, np.log2((left + new) / above), down + after[k - 1][parent])
        with np.errstate(divide="ignore"):
            cost = np.where(seen, np.log2((every + kinds) / np.where(seen, count, 1)), np.log2((every + kinds) / np.maximum(kinds, 1)) + escaped)
        keys.append(key)
        costs.append(cost)
        after.append(escaped)
        counts.append(count)
        base.append(base[-1] + len(key))
    # The longest kept context: of three symbols, else of two, of one, of none.
    by_one = np.zeros(size, np.int64)
    by_one[keys[1]] = base[1] + np.arange(len(keys[1]))
    by_two = np.tile(by_one, (size, 1)).ravel()
    by_two[keys[2]] = base[2] + np.arange(len(keys[2]))
    stems = np.unique(keys[3] % size**2)
    at2 = np.zeros(size * size, np.int64)
    # Rows of at3: one for each pair that a kept triple extends, and one for each state that other pairs end in.
    states, at2[:] = np.unique(by_two, return_inverse=True)
    rows = np.repeat(states[:, None], size, 1)
    extra = np.repeat(by_two[stems][:, None], size, 1)
    at2[stems] = len(rows) + np.arange(len(stems))
    extra[np.searchsorted(stems, keys[3] % size**2), keys[3] // size**2] = base[3] + np.arange(len(keys[3]))
    return Tree(at2 * size, np.concatenate([rows, extra]).ravel() * size, np.concatenate(costs).astype(np.float32).ravel())


class Model:
    """The trees of all languages. Small counts travel to the tasks; each Python worker grows the trees once.

    A language whose training texts hold no byte can't be learned and is left out.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], min_context: int = MIN_CONTEXT):
        self.counts, self.min_context = {k: v for k, v in counts.items() if len(v[0])}, min_context
        self.langs, self.mark = sorted(self.counts), uuid.uuid4().hex

    def trees(self) -> tuple[np.ndarray, list[Tree]]:
        def build():
            symbol = alphabet([c for c, _ in self.counts.values()])
            return symbol, [grow(*self.counts[x], symbol, self.min_context) for x in self.langs]

        return kept(f"trees {self.mark}", build)

    def bits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths in bits: a row per document, a column per language."""
        symbol, trees = self.trees()
        size, out = int(symbol.max()) + 1, np.zeros((len(at) - 1, len(trees)))
        for part, starts, cuts, docs, lead in chunks(raw, at):
            x = symbol[part]
            one, two, three = context_symbols(x, starts)
            pair = (two * size + one)[lead:]
            x, three = x[lead:], three[lead:]
            for k, t in enumerate(trees):
                cost = t.cost[t.at3[t.at2[pair] + three] + x]
                np.add.at(out[:, k], docs, np.add.reduceat(cost, cuts, dtype=np.float64))
        return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 by 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, min_context: int = MIN_CONTEXT) -> Model:
    """A model from doc_id, lang, text. Rows without a language are left out; each language gives about `sample_docs` documents at most.

    A language of which only null or empty texts are drawn isn't learned.
    """
    known = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    rates = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count("*")).alias("rate")).collect()  # a row per language
    if not rates:
        return Model({}, min_context)
    rate = F.element_at(F.create_map(*[F.lit(x) for r in rates for x in (r["lang"], r["rate"])]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < rate * (1 << 30)
    got = four_grams(known.where(drawn)).toArrow()  # bounded by the sample
    lang, code, n = (np.asarray(got.column(i)) for i in range(3))
    return Model({x: (code[lang == x], n[lang == x]) for x in sorted({r["lang"] for r in rates})}, min_context)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the winner's share of probability) and bits_per_byte of every document.

    Null texts and texts without a letter are `und` with score 0, as all are if
    the model knows no language. Equal code lengths go to the smaller language.
    Repeated rows are predicted one by one; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            raw, at = utf8(batch.column(1))
            bits = m.bits(raw, at) if m.langs else np.zeros((len(at) - 1, 1))
            best = bits.argmin(1)
            least = bits[np.arange(len(best)), best]
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            known = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool) & bool(m.langs)
            names = np.array(m.langs or [UNDETERMINED], object)
            yield pa.record_batch(
                [batch.column(0), pa.array(np.where(known, names[best], UNDETERMINED), pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(least / np.maximum(np.diff(at), 1))],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose language the model can tell: not `und`, and a score of `least_score` at least.

    A model without languages accepts every text with a letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = np.ones(len(batch), bool)
            if m.langs:
                bits = m.bits(*utf8(batch.column(text)))
                keep = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1) >= least_score
            yield batch.filter(pa.array(keep))

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled documents that aren't held out (the contract of ``predicted``)."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
