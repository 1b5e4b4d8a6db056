"""Many literal strings found in many texts at once: one machine of their common prefixes, run over all texts side by side."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Hits:
    """Where words stand, by word, then text, then end: text and end of each hit; hits of word w are first[w] to first[w + 1]."""

    text: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def of(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[word], self.first[word + 1]
        return self.text[a:b], self.end[a:b]


class Automaton:
    """Finds all places of all `words` (different, not empty).

    A state is the longest end of the text so far that begins a word. Where the
    next byte doesn't go on, the state goes on from its own longest proper end;
    these steps are written into one table, so a byte costs one look-up.
    """

    def __init__(self, words: list[bytes]):
        self.words = words
        letters = sorted(set(b"".join(words)))
        #: Byte -> column of the table; 0 for bytes in no word.
        self.column = np.zeros(256, np.int64)
        self.column[letters] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for w, word in enumerate(words):
            state = 0
            for c in self.column[list(word)].tolist():
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                    ends.append([])
                state = children[state][c]
            ends[state].append(w)
        self.next = np.zeros((len(children), len(letters) + 1), np.int32)
        shorter = [0] * len(children)  # the state of the longest proper end
        waiting = deque([0])
        while waiting:
            state = waiting.popleft()
            if state:
                self.next[state] = self.next[shorter[state]]
                ends[state] = ends[state] + ends[shorter[state]]
            for c, child in children[state].items():
                shorter[child] = int(self.next[state, c])
                self.next[state, c] = child
                waiting.append(child)
        self.n_found = np.array([len(e) for e in ends])
        self.found_at = np.concatenate([[0], np.cumsum(self.n_found)])
        self.found = np.array([w for e in ends for w in e], np.int64)

    def hits(self, raw: np.ndarray, at: np.ndarray) -> Hits:
        """Of the texts raw[at[i] : at[i + 1]] (bytes)."""
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")  # longest first: those that still run are always the first ones
        start, ordered = at[:-1][order], -lengths[order]
        columns = self.column[raw]
        state = np.zeros(len(order), np.int32)
        texts, places, states = [], [], []
        for k in range(int(lengths.max(initial=0))):
            running = int(np.searchsorted(ordered, -k))
            now = self.next[state[:running], columns[start[:running] + k]]
            state[:running] = now
            some = np.flatnonzero(self.n_found[now])
            if len(some):
                texts.append(order[some])
                places.append(np.full(len(some), k + 1))
                states.append(now[some])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        text, end, state = join(texts), join(places), join(states)
        n = self.n_found[state]
        word = self.found[np.repeat(self.found_at[state] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        text, end = np.repeat(text, n), np.repeat(end, n)
        by = np.lexsort((end, text, word))
        return Hits(text[by], end[by], np.searchsorted(word[by], np.arange(len(self.words) + 1)))
