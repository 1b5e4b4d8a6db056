import re
from collections import Counter, defaultdict

from phonoframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=200):
    """Every group against every kept term, from (text, lang, source)."""
    docs = [(lang or "", source or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for x, s in counts if x == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_query(spark, sf_dir, rows):
    got = divergence.op12_source_divergence(spark, sf_dir)
    assert dict(got.dtypes) | {"value": "bigint", "rank": "int"} == dict(got.dtypes)
    want = plain([r[1:] for r in rows])
    assert rows_of(got) == want and {r[2] for r in want} == {"pair", "term"}


def test_parameters_ties_and_blanks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_HELD", 3)
    same = [("one two Two é", "en", s) for s in ("a", "b", "B", "ä")] * 2
    rows = same + [(None, "en", None), ("", "en", ""), ("... 123", None, "x"), (None, None, None), ("zwei drei", "de", "a"), ("ÉÉ É É", "fr", "a"), ("x" * 70_000, "en", "a")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'x' as term", "1 as n", "2 as item")
    for least, top in ((1, 2), (2, 200), (99, 5)):
        assert rows_of(divergence.audited(df, least, top)) == plain(rows, least, top)


def test_empty(spark, no_docs):
    assert divergence.audited(no_docs).count() == 0


def test_large_counts_stay_exact(spark):
    """Counts as a corpus of very many words has them."""
    rows = [(3_000_000_000, 9_000_000_000), (7, 10**12), (0, 10**15)]
    df = spark.createDataFrame(rows, "c long, total long")
    assert [r.p for r in df.select(divergence.share(df.c, df.total).alias("p")).collect()] == [1 + 10**9 * (c + 1) // t for c, t in rows]
