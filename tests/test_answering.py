"""Question sets answered by one automaton, against the regular expressions that say what an answer is."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonoframe.functions.automaton import Automaton
from phonoframe.operators import linguistic
from phonoframe.operators.answering import Machine
from phonoframe.plans.aligned_labels import _full_set
from phonoframe.sources.questions import parse


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=4), max_size=12), st.lists(st.text("abcé", max_size=20), max_size=8))
def test_all_places_are_found(words, texts):
    words, raw = [w.encode() for w in sorted(words)], [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    hits = Automaton(words).hits(np.frombuffer(b"".join(raw), np.uint8), at)
    for k, w in enumerate(words):
        want = [(i, e) for i, t in enumerate(raw) for e in range(len(w), len(t) + 1) if t[e - len(w) : e] == w]
        assert list(zip(*(x.tolist() for x in hits.of(k)), strict=True)) == want


def plain(q, numeric, context):
    if not numeric:
        return float(context is not None and any(re.search(p.replace(r"\z", r"\Z"), context) for p in q.patterns))
    m = re.search(q.patterns[0], context) if context is not None else None
    if not m:
        return -50.0 if q.signed else -1.0
    return float(m[1][1:]) * (1 if m[1][0] == "p" else -1) if m[1][0] in "pm" else float(m[1])


def test_random_question_sets():
    r = random.Random(1)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    for _ in range(200):
        lines = []
        for k in range(12):
            items = ["*" * (r.random() < 0.5) + "".join(r.choice(["a", "b", "-", "+", "ab", "*", "?", "."]) for _ in range(r.randint(1, 6))) + "*" * (r.random() < 0.5) for _ in range(r.randint(1, 3))]
            lines.append(f'QS "{r.choice(["LL-", "C-"])}{k}" {{{",".join(items)}}}')
        lines += [f'CQS "n{k}" {{{text("ab-", r.randint(0, 2))}{r.choice([r"(\d+)", r"([pm]\d+)"])}{text("ab-", r.randint(0, 1))}}}' for k in range(4)]
        binary, numeric = parse("\n".join(lines))
        contexts = [text("ab-+.?p12", r.randint(0, 14)) for _ in range(40)] + [None, ""]
        got = Machine(binary, numeric).answers(pa.array(contexts, pa.string()))
        assert got.tolist() == [[plain(q, False, c) for q in binary] + [plain(q, True, c) for q in numeric] for c in contexts]


def test_rows_keep_their_place_and_nulls_answer_nothing(spark):
    binary, numeric = parse('QS "a" {*-a+*}\nQS "LL-x" {x^}\nQS "all" {*}\nCQS "n" {/N:([-\\d]+)_}\nCQS "m" {/M:(\\NOTE)!}')
    rows = [(i, c, "x") for i, c in enumerate(["x^-a+/N:-3_", None, "", "y-a+/N:7_/M:Bb4!", "x^-a+/N:-3_"] * 50)]
    df = spark.createDataFrame(rows, "utt long, context string, note string").repartition(3)
    got = linguistic.answered(df, binary, numeric)
    columns = [linguistic.binary_answer(q, df.context).cast("float") for q in binary]
    assert got.columns == ["utt", "context", "note", "answers"] and "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    answers = {r.utt: r.answers for r in got.collect()}
    assert len(answers) == len(rows)
    for r in df.select("utt", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect():
        assert answers[r.utt][:3] == [r.c0, r.c1, r.c2]
    assert [answers[k][3:] for k in range(4)] == [[-3.0, -1.0], [-50.0, -1.0], [-50.0, -1.0], [7.0, 70.0]]
    with pytest.raises(Exception, match="finds no number"):
        linguistic.answered(df.selectExpr("utt", "'/N:3-4_' as context"), [], numeric).collect()


def test_a_whole_set_has_416_questions():
    binary, numeric = parse(_full_set())
    assert (len(binary), len(numeric)) == (373, 43)
    machine = Machine(binary, numeric)
    assert len(machine.grouped) == 43 and len(machine.several) == 60 + 33


def test_digits_are_read_side_by_side(monkeypatch):
    """No regular expression runs but where a number is long or holds a minus inside; the first place that fits counts."""
    binary, numeric = parse('QS "has" {*/B:(\\d+)_*}\nCQS "a" {/A:(\\d+)_}\nCQS "b" {/B:([-\\d]+)}\nCQS "c" {/A:([-\\d]+)_x}\nCQS "digit" {/A:(\\d+)5}\nCQS "minus" {/B:([-\\d]+)-}\nCQS "nul" {/A:(\\d+)\0}')
    r = random.Random(5)
    pieces = ["/A:", "/B:", "_", "_x", "x", "7", "05", "5", "12345", "-3", "-0", "\0", "é", "99999999999999999999"]
    contexts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(4000)] + [None, "", "/A:", "/A:3", "/B:-", "/B:4/B:5-6"]
    bad = re.compile(r"/[AB]:(-[-\d]*-|\d+-|-(?!\d))")
    contexts = [c for c in contexts if c is None or not bad.search(c)]
    machine = Machine(binary, numeric)
    got = machine.answers(pa.array(contexts, pa.string()))
    want = np.array([[plain(q, False, c) for q in binary] + [plain(q, True, c) for q in numeric] for c in contexts], np.float32)
    assert len(contexts) > 2000 and (got == want).all() and (np.signbit(got) == np.signbit(want)).all()
    monkeypatch.setattr(Machine, "_group", None)
    monkeypatch.setattr(Machine, "_number", None)
    _, plain_ones = parse('CQS "a" {/A:(\\d+)_}\nCQS "b" {/B:([-\\d]+)}')
    assert Machine([], plain_ones).answers(pa.array(["/A:31_/B:-2", "/A:3", None])).tolist() == [[31.0, -2.0], [-1.0, -50.0], [-1.0, -50.0]]


def test_answers_are_packed(spark):
    binary, numeric = parse('QS "a" {*-a+*}\nQS "all" {*}\nCQS "n" {/N:([-\\d]+)_}')
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["-a+/N:-3_", None, "", "/N:7_"] * 3)], "utt long, context string")
    got = {r.utt: (r.bits, r.numbers) for r in linguistic.answered(df, binary, numeric, packed=True).collect()}
    assert got == {r.utt: ("".join(str(int(v)) for v in r.answers[:2]), r.answers[2:]) for r in linguistic.answered(df, binary, numeric).collect()}
