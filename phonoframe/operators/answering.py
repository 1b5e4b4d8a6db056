"""All questions of a set answered for many contexts at once.

The literal texts of all patterns go into one automaton, which reads each context
once. A question whose pattern is one text is answered by its hits; texts with
wildcards between them follow from the hits' places, earliest first; a group of
digits or a note is matched only where the text before it stands, digits for all
contexts side by side.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from phonoframe.functions.automaton import Automaton, Hits
from phonoframe.sources.questions import Pattern, Question

#: Groups of digits, and whether a minus may stand among them.
_DIGITS = {r"(\d+)": False, r"([-\d]+)": True}
#: Digits of a number that are read side by side; all numbers below 10^15 are exact as doubles.
_MOST_DIGITS = 15


def note_numbers() -> dict[str, int]:
    """Note name -> number, A0 (21) to G9 (127); flats only."""
    names = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
    return {f"{names[n % 12]}{n // 12 - 1}": n for n in range(21, 128)}


def _texts(p: Pattern) -> list[bytes] | None:
    """The literal texts between a pattern's wildcards; None if it has a group."""
    out = [b""]
    for kind, x in p.parts:
        if kind == "group":
            return None
        if kind == "*":
            out.append(b"")
        else:
            out[-1] += x.encode()
    return [x for k, x in enumerate(out) if x or (k == 0 and p.start) or (k == len(out) - 1 and p.end)]


def _digits(p: Pattern) -> tuple[bool, bytes] | None:
    """Of a text, digits, and a text that can't go on with them (or none): whether a minus may stand there, and the text after; None of other patterns."""
    kinds = [kind for kind, _ in p.parts]
    if p.start or p.end or kinds not in (["text", "group"], ["text", "group", "text"]) or p.parts[1][1] not in _DIGITS:
        return None
    minus, after = _DIGITS[p.parts[1][1]], "".join(x for _, x in p.parts[2:]).encode()
    return None if after[:1].isdigit() or (minus and after[:1] == b"-") else (minus, after)


class Machine:
    """Answers of a question set. Made on the driver, sent to the tasks."""

    def __init__(self, binary: list[Question], numeric: list[Question]):
        self.binary, self.numeric = binary, numeric
        patterns = [(k, p) for k, q in enumerate([*binary, *numeric]) for p in q.wanted]
        number: dict[bytes, int] = {}
        use = lambda text: number.setdefault(text, len(number))
        #: Questions that each word answers alone; patterns of several texts, or at an end; patterns with groups.
        alone: list[tuple[int, int]] = []
        self.several: list[tuple[int, Pattern, list[int | None], list[int]]] = []
        self.grouped: list[tuple[int, int | None, re.Pattern, tuple[bool, bytes] | None]] = []
        for k, p in patterns:
            texts = _texts(p)
            if texts is None or k >= len(binary):
                lead = p.parts[0][1].encode() if p.parts and p.parts[0][0] == "text" else None
                self.grouped.append((k, use(lead) if lead and not p.start else None, re.compile(p.regex().replace(r"\z", r"\Z").encode()), _digits(p)))
            elif len(texts) == 1 and texts[0] and not p.start and not p.end:
                alone.append((use(texts[0]), k))
            else:
                self.several.append((k, p, [use(x) if x else None for x in texts], [len(x) for x in texts]))
        self.automaton = Automaton(list(number))
        alone.sort()
        self.alone_word = np.array([w for w, _ in alone], np.int64)
        self.alone_question = np.array([q for _, q in alone], np.int64)
        self.notes = {name.encode(): n for name, n in note_numbers().items()}

    def answers(self, contexts: pa.Array) -> np.ndarray:
        """A row for each context, a column for each question (float32)."""
        known = contexts.is_valid().to_numpy(zero_copy_only=False)
        texts = [x.encode() if x is not None else b"" for x in contexts.to_pylist()]
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        hits = self.automaton.hits(raw, at)
        out = np.zeros((len(texts), len(self.binary) + len(self.numeric)), np.float32)
        out[:, len(self.binary) :] = [-50.0 if q.signed else -1.0 for q in self.numeric]
        for word, question in zip(self.alone_word.tolist(), self.alone_question.tolist(), strict=True):
            out[hits.of(word)[0], question] = 1
        for question, p, words, sizes in self.several:
            out[_in_order(p, words, sizes, hits, np.diff(at)) & known, question] = 1
        for question, word, regex, digits in self.grouped:
            if digits:
                self._number_group(out[:, question], question, word, regex, digits, hits, raw, at, texts)
            else:
                self._group(out[:, question], question, word, regex, hits, texts, known)
        return out

    def _number_group(self, column: np.ndarray, question: int, word: int, regex: re.Pattern, digits: tuple[bool, bytes], hits: Hits, raw: np.ndarray, at: np.ndarray, texts: list[bytes]) -> None:
        text, end = hits.of(word)
        value, fits, odd = _read(raw, at[text] + end, at[text + 1], *digits)
        size = len(self.automaton.words[word])
        matches = {k: regex.match(texts[text[k]], int(end[k]) - size) for k in np.flatnonzero(odd).tolist()}
        fits[list(matches)] = [m is not None for m in matches.values()]
        at_fit = np.flatnonzero(fits)
        first = at_fit[np.unique(text[at_fit], return_index=True)[1]]  # the first place that fits
        if question < len(self.binary):
            column[text[first]] = 1
            return
        column[text[first]] = value[first]
        for k in first[odd[first]].tolist():
            column[text[k]] = self._number(self.numeric[question - len(self.binary)], matches[k][1])

    def _group(self, column: np.ndarray, question: int, word: int | None, regex: re.Pattern, hits: Hits, texts: list[bytes], known: np.ndarray) -> None:
        if word is None:
            found = ((i, regex.search(texts[i])) for i in np.flatnonzero(known).tolist())
        else:
            text, end = hits.of(word)
            size = len(self.automaton.words[word])
            found = ((i, regex.match(texts[i], e - size)) for i, e in zip(text.tolist(), end.tolist(), strict=True))
        done = -1
        for i, m in found:
            if m and i != done:  # the first place that fits
                done = i
                column[i] = 1 if question < len(self.binary) else self._number(self.numeric[question - len(self.binary)], m[1])

    def _number(self, q: Question, got: bytes) -> float:
        if not got:
            return -50.0 if q.signed else -1.0
        if got in self.notes:
            return self.notes[got]
        sign = {b"p": 1.0, b"m": -1.0}.get(got[:1])
        try:
            return float(got) if sign is None else sign * float(got[1:])
        except ValueError:
            raise ValueError(f"{q.name} finds no number: {got.decode()}") from None


def _in_order(p: Pattern, words: list[int | None], sizes: list[int], hits: Hits, lengths: np.ndarray) -> np.ndarray:
    """Whether each context holds the words one after the other, without overlap, the first and last at its ends if the pattern says so. An earliest hit leaves most room for the next."""
    upto, fits = np.zeros(len(lengths), np.int64), np.ones(len(lengths), bool)
    for k, (word, size) in enumerate(zip(words, sizes, strict=True)):
        if word is None:
            continue  # nothing but an end of the context
        text, end = hits.of(word)
        good = fits[text] & (end - size >= upto[text])
        if p.start and k == 0:
            good &= end == size
        if p.end and k == len(words) - 1:
            good &= end == lengths[text]
        first, at = np.unique(text[good], return_index=True)
        fits = np.zeros(len(lengths), bool)
        fits[first] = True
        upto[first] = end[good][at]
    return fits


def _read(raw: np.ndarray, at: np.ndarray, stop: np.ndarray, minus: bool, after: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers that begin at bytes `at` and lie before `stop`: their values, whether there is one with `after` behind it, and where that can't be told here (long numbers, and a minus other than before digits)."""
    byte = lambda rows, place: np.where(place < stop[rows], raw[np.minimum(place, len(raw) - 1)].astype(np.int64), -1) if len(raw) else np.full(len(rows), -1)
    rows = np.arange(len(at))
    negative = (byte(rows, at) == ord("-")) & minus
    place, value, found = at + negative, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    running = rows
    for _ in range(_MOST_DIGITS):
        digit = byte(running, place[running]) - ord("0")
        good = (digit >= 0) & (digit <= 9)
        running = running[good]
        value[running] = value[running] * 10 + digit[good]
        found[running] += 1
        place[running] += 1
    odd = (found == _MOST_DIGITS) | (negative & (found == 0))
    if minus:
        odd |= byte(rows, place) == ord("-")
    fits = found > 0
    for k, c in enumerate(after):
        fits &= byte(rows, place + k) == c
    return np.where(negative, -value.astype(float), value), fits & ~odd, odd
