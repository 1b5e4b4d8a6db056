import hashlib
import re

import numpy as np

from phonoframe.llm import secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_query(spark, sf_dir, rows):
    got = secrets.op7_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _, _ in rows}
    for r in got:
        want = base(text[r.doc_id])
        names = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",")) | {""}
    assert any("random" in r.spans for r in got if r.doc_id == 108)
    assert not any(r.spans for r in got if r.doc_id < 99)


def test_random_strings_but_no_digests_or_identifiers():
    path = secrets.default_vocabulary()
    for x in (b"zQ9xK2vR7tLm4WpB8nYc3JdF", b"fJ3k/9aXq+Lm20Zt7Rw1YbVc8==", b"ghp_x7Kq2ZmW9vRb4TnJ6yLc3PdF8sHa"):
        assert secrets.is_random(x, path), x
    for x in (b"d41d8cd98f00b204e9800998ecf8427e", b"123e4567-e89b-12d3-a456-426614174000", b"internationalization", b"some-long-and-ordinary-name", b"12345678901234567890123"):
        assert not secrets.is_random(x, path), x


def test_runs_end_at_documents():
    raw = np.frombuffer(b"abcdefabcdef", np.uint8)
    d, s, e = secrets.runs(raw, np.array([0, 6, 6, 12]), secrets.HEX_CHARS, 6)
    assert (d.tolist(), s.tolist(), e.tolist()) == ([0, 2], [0, 6], [6, 12])


def test_redaction_and_empty(spark, docs, no_docs):
    path = secrets.default_vocabulary()
    masked = {r.doc_id: r.t for r in docs.select("doc_id", secrets.redact(docs.text, path).alias("t")).collect()}
    plain = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert masked[108] == '[secret]" [secret] [secret] [secret]'  and masked[99] is None and masked[100] == ""
    assert all(masked[i] == plain[i] for i in plain if i < 99)
    assert secrets.scanned(no_docs, path).count() == 0


def test_random_strings_behind_words():
    path = secrets.default_vocabulary()
    for before in (b"/services/integration/webhook/production/", b"customer_session_identifier=", b"/download/customer/archive/" * 40):
        for x in (b"zQ9xK2vR7tLm4WpB8nYc3JdF", b"x7Kq2ZmW9vRb4TnJ6yLc"):
            for after in (b"", b"/download/customer/archive"):
                found = secrets.random_stretches(before + x + after, path)
                assert len(found) == 1 and found[0][0] <= len(before) and found[0][1] >= len(before + x), before + x
    for x in (b"/archive/d41d8cd98f00b204e9800998ecf8427e/customer", b"user/123e4567-e89b-12d3-a456-426614174000/archive", b"/archive/2024/01/05/1234567890/customer", b"production-+-+-+-+-+-+-+-+-+-+-+-archive"):
        assert not secrets.random_stretches(b"/services/integration/webhook/production/download/customer/" + x, path), x


def test_random_letters_but_no_words():
    path = secrets.default_vocabulary()
    for x in (b"zQxKvRtLmWpBnYcJdFgHsT", b"qxzjvkwpfhtrgmbcydnlsq", b"zQxKvRtLmWp-BnYcJdFgHsT", b"zQxKvRtLmWpBnYcJdFgHsT42"):
        assert secrets.is_random(x, path), x
        found = secrets.random_stretches(b"/download/customer/archive/" + x, path)
        assert len(found) == 1 and found[0][0] <= 27 and found[0][1] == 27 + len(x), x
    for x in (b"state-of-the-art-and-well-known-method", b"to-be-or-not-to-be-that-is-the-question", b"getElementByIdAndClassName", b"/usr/local/share/doc/python/examples", b"some_long_and_ordinary_name_2024"):
        assert not secrets.is_random(x, path) and not secrets.random_stretches(x, path), x


def test_measured_share_of_random_strings_and_of_words():
    """Of random strings of 20 to 40 characters from five alphabets almost all are found; of names, paths and camel case made of words, almost none."""
    path, rng = secrets.default_vocabulary(), np.random.default_rng(11)
    lower, upper, digits = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
    for alphabet, least in ((lower + upper + digits, 0.97), (lower + upper, 0.97), (upper + b"234567", 0.9), (lower + digits, 0.9), (lower + upper + digits + b"+/", 0.97)):
        strings = [bytes(rng.choice(list(alphabet), rng.integers(20, 41)).astype(np.uint8)) for _ in range(300)]
        assert np.mean([bool(secrets.random_stretches(x, path)) for x in strings]) >= least, alphabet
    words = "account archive backup build cache channel client cluster config content customer daemon data default deploy device document download editor engine event export factory feature filter folder gateway handler history image index install instance internal language library license manager message method module network number object option output package parser payment platform plugin process product profile project property provider query queue reader record release report request response result schedule search section server service session setting source status storage stream string system target template thread token update upload user value vector version window worker".split()
    joined = []
    for _ in range(600):
        some = [str(rng.choice(words)) for _ in range(rng.integers(3, 7))]
        joined.append([lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/" + "/".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:])][rng.integers(0, 4)](some).encode())
    assert np.mean([bool(secrets.random_stretches(x, path)) for x in joined if len(x) >= 20]) <= 0.02


def test_texts_longer_than_a_slice(spark):
    word = "zQ9xK2vR7tLm4WpB8nYc3JdF"
    text = "plain words " * 900_000 + word
    r = secrets.scanned(spark.createDataFrame([(1, text), (2, word)], "doc_id long, text string"), secrets.default_vocabulary()).orderBy("doc_id").collect()
    assert [x.spans for x in r] == [f"random:{len(text) - len(word)}:{len(text)}", f"random:0:{len(word)}"]
