import struct
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

from phonoframe.llm import packing


def check(got, texts, window):
    """got: pieces; texts: doc_id -> text, ids unique."""
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in texts.items()}
    cover, places = defaultdict(int), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.start == cover[r.doc_id]
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part))
        cover[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert cover == {i: len(x) for i, x in ids.items()}
    assert sorted(places) == list(range(len(places)))
    for s, parts in places.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or s == len(places) - 1 and at <= window


def test_query(spark, sf_dir, rows):
    got = packing.op9_packing(spark, sf_dir).collect()
    twice = [r for r in got if r.doc_id == 17]
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    total = sum(r.length for r in got)
    assert max(r.sequence_id for r in got) == (total - 1) // 4096


def test_pieces_and_small_windows(spark, docs, rows):
    texts = {i: t for i, t, _, _ in rows}
    for window in (7, 4096):
        check(packing.packed(docs.dropDuplicates(["doc_id"]), packing.default_tokenizer(), window).collect(), texts, window)


def test_ids_equal_the_tokenizers(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    texts = ["", " ", "Word, WORD word... it's they'll", "áb é", "x\x1cy \x85z", "Σας ΟΔΟΣ İstanbul ǅ", "<|endoftext|> a<|endoftext|>b", "日本語 テスト ½ 4５6", "a" * 5000, "hello*** É! d'été"]
    w, t = packing.WordIds(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    for _ in range(2):
        ids, cuts = w.encode([x.encode() for x in texts])
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_empty(spark, no_docs):
    assert packing.packed(no_docs, packing.default_tokenizer()).count() == 0
