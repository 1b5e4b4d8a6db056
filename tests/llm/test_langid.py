import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from phonoframe.llm import langid


def code_length(text, counts, symbol_count, min_context):
    """PPM with method C and exclusion, byte by byte, from dictionaries of contexts."""
    total = 0.0
    padded = b"\0\0\0" + text
    for i, x in enumerate(text):
        context, seen = padded[i : i + 3], set()
        for k in range(3, -1, -1):
            table = counts.get(context[3 - k :] if k else b"")
            if table is None or (k and sum(table.values()) < min_context):
                continue
            left = {y: n for y, n in table.items() if y not in seen}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if x in left:
                total += math.log2(whole / left[x])
                break
            total += math.log2(whole / len(left))
            seen |= set(left)
        else:
            total += math.log2(max(256 - len(seen), 1))
    return total


def test_code_lengths_equal_a_plain_ppm():
    texts = {"a": [b"the cat sat on the mat and the rat", b"that hat"], "b": [b"le chat est sur la table", b"la la lait"]}
    models, plain = {}, {}
    for lang, ts in texts.items():
        grams, tables = {}, {}
        for t in ts:
            p = b"\0\0\0" + t
            for i, x in enumerate(t):
                code = int.from_bytes(p[i : i + 4], "big")
                grams[code] = grams.get(code, 0) + 1
                for k in range(4):
                    c = p[i + 3 - k : i + 3]
                    tables.setdefault(c, {}).setdefault(x, 0)
                    tables[c][x] += 1
        models[lang] = (np.array(list(grams)), np.array(list(grams.values())))
        plain[lang] = tables
    model = langid.Model(models, 3)
    tests = [b"the rat sat", b"la table", b"", b"zzz", b"t", "é".encode() + b" the"]
    at = np.cumsum([0, *map(len, tests)])
    got = model.bits(np.frombuffer(b"".join(tests), np.uint8), at)
    for i, t in enumerate(tests):
        for k, lang in enumerate(model.langs):
            assert abs(got[i, k] - code_length(t, plain[lang], 256, 3)) < 1e-3, (t, lang)


def test_query(spark, sf_dir, rows):
    got = langid.op2_language_id(spark, sf_dir).collect()
    assert len(got) == len(rows)
    lang = {i: (t, x) for i, t, x, _ in rows}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (99, 100, 101, 104):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    held = [r for r in got if r.held_out and r.doc_id < 99]
    assert held and sum(r.lang_pred == lang[r.doc_id][1] for r in held) >= 0.95 * len(held)


def test_no_labels_and_empty(spark, docs, no_docs):
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predicted(docs, model).collect()} == {"und"}
    assert langid.predicted(no_docs, model).count() == 0
    assert langid.train(no_docs).langs == []


def test_long_texts_in_chunks(monkeypatch):
    model = langid.Model({"a": (np.array([0x74686520, 0x00000074, 0x68652063]), np.array([5, 5, 5]))}, 1)
    text = b"the cat " * 50
    raw, at = np.frombuffer(text + b"the", np.uint8), np.array([0, len(text), len(text) + 3])
    whole = model.bits(raw, at)
    plain = langid.chunks
    monkeypatch.setattr(langid, "chunks", lambda r, a: plain(r, a, 7))
    assert np.allclose(model.bits(raw, at), whole)


def test_languages_without_bytes_are_left_out(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(8)] + [(i, None, "xx") for i in range(8, 16)] + [(i, "", "yy") for i in range(16, 24)] + [(i, "z", "zz") for i in range(24, 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["en", "zz"]
    assert {r.doc_id: r.lang_pred for r in langid.predicted(docs, model).collect()} == {i: "und" if not t else x for i, t, x in rows}
    assert langid.train(docs.where("lang in ('xx', 'yy')")).langs == []


def test_query_equals_a_plain_ppm(spark, sf_dir, rows):
    """Every row of the query, from dictionaries of contexts."""
    tables = {}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for i, t, lang, _ in rows:
        if lang is None or held(i):
            continue
        of = tables.setdefault(lang, {})
        text = (t or "").encode()
        padded = b"\0\0\0" + text
        for j, x in enumerate(text):
            for k in range(4):
                seen = of.setdefault(padded[j + 3 - k : j + 3], {})
                seen[x] = seen.get(x, 0) + 1
    short = {i: t for i, t, _, _ in rows if t and len(t.encode()) < 1500}
    checked = 0
    for r in langid.op2_language_id(spark, sf_dir).collect():
        assert r.held_out == held(r.doc_id)
        text = short.get(r.doc_id)
        if text is None or not any(c.isalpha() for c in text):
            continue
        bits = {lang: code_length(text.encode(), of, 256, langid.MIN_CONTEXT) for lang, of in tables.items()}
        best = min(bits, key=lambda x: (bits[x], x))
        share = 1 / sum(2.0 ** max(bits[best] - b, -1000) for b in bits.values())
        assert r.lang_pred == best and abs(r.score - share) < 1e-2, r.doc_id
        checked += 1
    assert checked > 80
