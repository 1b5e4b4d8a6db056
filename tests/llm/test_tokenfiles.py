import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phonoframe.llm import huffman, packing, tokenfiles


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_blocks(values, a, b):
    ids = np.array(values, np.uint32) ** 2
    symbols, n = np.unique(ids, return_counts=True)
    code = huffman.Code.of(symbols, n)
    block, table = code.encode(ids), code.table()
    assert huffman.decode(block, len(ids), code, table).tolist() == ids.tolist()
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert huffman.decode(block, len(ids), code, table, a, b).tolist() == ids[a:b].tolist()


def plain_cost(counts):
    """Bits of the best code without a limit, by joining the two lightest."""
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        both = heap[0] + heap[1]
        cost += both
        heap = sorted([*heap[2:], both])
    return cost


def best_cost(counts, limit):
    """Bits of the best code by trying every multiset of lengths that fits."""
    counts = sorted(counts, reverse=True)

    def tried(k, least, room):
        if k == len(counts):
            return 0 if room >= 0 else float("inf")
        return min((counts[k] * n + tried(k + 1, n, room - 2 ** (limit - n)) for n in range(least, limit + 1) if room >= 2 ** (limit - n)), default=float("inf"))

    return tried(0, 1, 2**limit)


def test_lengths():
    rng = np.random.default_rng(0)
    for n in (2, 3, 17, 300):
        counts = rng.integers(1, 1000, n)
        lengths = huffman.code_lengths(counts, 20)
        assert (counts * lengths).sum() == plain_cost(counts.tolist()) and sum(0.5**lengths) == 1
    for limit in (3, 4):
        for counts in ([1, 1, 2, 3, 5, 8, 13], [1, 1, 1, 1, 100], [1, 2, 4, 8, 16, 32, 64, 128][: 2**limit]):
            lengths = huffman.code_lengths(np.array(counts), limit)
            assert lengths.max() <= limit and (np.array(counts) * lengths).sum() == best_cost(counts, limit)
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)
    assert huffman.code_lengths(np.array([5]), 3).tolist() == [1]


def test_codes_are_canonical():
    code = huffman.Code(np.array([3, 7, 8, 20]), np.array([2, 1, 3, 3]))
    assert [(int(code.code_of[s]), int(code.length_of[s])) for s in (7, 3, 8, 20)] == [(0b0, 1), (0b10, 2), (0b110, 3), (0b111, 3)]
    assert code.encode(np.array([7, 20, 3, 3])) == struct.pack("<H", 8) + bytes([0b01111010])


def check(got, texts):
    """got: rows; texts: (doc_id, text) in the order of the files."""
    t, at = Tokenizer.from_file(packing.default_tokenizer()), 0
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    for r, (_, text) in zip(got, texts, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_query(spark, sf_dir, rows):
    got = sorted(tokenfiles.op13_huffman_tokens(spark, sf_dir).collect(), key=lambda r: r.start)
    check(got, sorted((r[:2] for r in rows), key=lambda r: r[0]))


@pytest.mark.parametrize("block, part_ids, piece, least", [(100, 700, 300, 10), (7, 3000, 1, 1)])
def test_small_blocks_shares_and_pieces(spark, docs, rows, monkeypatch, block, part_ids, piece, least):
    monkeypatch.setattr(tokenfiles, "LEAST_DOCUMENTS", least)
    got = tokenfiles.stored(docs, packing.default_tokenizer(), block=block, part_ids=part_ids, piece_bytes=piece).collect()
    check(sorted(got, key=lambda r: r.start), sorted((r[:2] for r in rows), key=lambda r: r[0]))


def test_null_and_repeated_ids(spark):
    rows = [(None, "b c"), (2, 'say "so"'), (None, None), (2, 'say "so"'), (1, "!" * 40), (-5, "<|endoftext|>")] + [(9, "hot")] * 40
    got = tokenfiles.stored(spark.createDataFrame(rows, "doc_id long, text string"), packing.default_tokenizer()).collect()
    got = sorted(got, key=lambda r: r.start)
    nulls = [(None, None), (None, "b c")] if got[0].n_tokens == 1 else [(None, "b c"), (None, None)]
    check(got, nulls + sorted(x for x in rows if x[0] is not None))


def test_empty(spark, no_docs):
    assert tokenfiles.stored(no_docs, packing.default_tokenizer()).count() == 0


def test_files_are_read_by_range_and_damage_is_found():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 5000) % 40_000
    out, code = io.BytesIO(), huffman.Code.of(*np.unique(ids, return_counts=True))
    writer = tokenfiles.Writer(out, code, 77, block=500)
    for i, part in enumerate(np.split(ids, [1, 1, 900, 4000])):
        writer.document(i or None)
        writer.add(part)
    writer.close()
    raw = out.getvalue()
    asked = []

    def read(at, n):
        asked.append(n)
        return raw[at : at + n]

    r = tokenfiles.Reader(read, len(raw))
    assert r.before == 77 and r.documents["ids"].tolist() == [1, 0, 899, 3100, 1000] and r.documents["known"].tolist() == [0, 1, 1, 1, 1]
    asked.clear()
    assert np.concatenate(list(r.ids(1490, 20))).tolist() == ids[1490:1510].tolist() and len(asked) == 2
    assert np.concatenate(list(r.ids(0, 5000))).tolist() == ids.tolist()
    for at in (int(r.blocks["at"][3]) + 20, len(raw) - 30, len(raw) - 60):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            list(tokenfiles.Reader(lambda a, n, bad=bad: bytes(bad[a : a + n]), len(bad)).ids(0, 5000))
    with pytest.raises(ValueError):
        tokenfiles.Reader(read, 10)
