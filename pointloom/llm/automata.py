"""Minimal acyclic automata over sorted words, with perfect-hash numbers, and searches of many words at once.

The automaton is built from words in order of code points: what two neighbours no longer share is frozen
from its end, and a frozen state equal to an earlier one is that one.  Each edge knows how many words
come before those it leads to, so the sum along a word's path is the word's place in the order, and
what belongs to a word lies in plain arrays under that number.
"""

from __future__ import annotations

import os

import numpy as np


class Automaton:
    """States and edges as arrays; ``words`` are sorted and distinct."""

    def __init__(self, words: list[str]):
        self.words = words
        register: dict[tuple, int] = {}
        counts: list[int] = []
        finals: list[bool] = []
        rows: list[tuple] = []
        frozen_edges: list[list] = [[]]  # the edges so far of each state on the path of the last word
        ends = [False]
        before = ""

        def freeze(depth: int) -> None:
            """The states below ``depth`` on the last word's path become final states of the automaton."""
            for d in range(len(before), depth, -1):
                key = (ends.pop(), *frozen_edges.pop())
                state = register.get(key)
                if state is None:
                    state = register[key] = len(rows)
                    rows.append(key)
                    finals.append(key[0])
                    counts.append(key[0] + sum(counts[t] for t in key[2::2]))
                frozen_edges[-1] += (before[d - 1], state)

        for word in words:
            shared = len(os.path.commonprefix((before, word)))
            freeze(shared)
            frozen_edges += [[] for _ in range(len(word) - shared)]
            ends += [False] * (len(word) - shared)
            ends[-1] = True
            before = word
        freeze(0)
        rows.append((ends[0], *frozen_edges[0]))
        finals.append(ends[0])

        self.root = len(rows) - 1
        self.final = np.array(finals)
        degree = np.array([len(r) // 2 for r in rows], np.int64)
        self.first = np.concatenate([[0], np.cumsum(degree)])
        letters = "".join(c for r in rows for c in r[1::2])
        self.letter = np.frombuffer(letters.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.target = np.fromiter((t for r in rows for t in r[2::2]), np.int64, len(letters))
        size = np.array([*counts, len(words)], np.int64)[self.target]
        upto = np.cumsum(size) - size
        source = np.repeat(np.arange(len(rows)), degree)
        #: Words of the edge's state that come before those behind the edge.
        self.skip = upto - upto[np.minimum(self.first[source], len(upto) - 1)] + self.final[source]
        self.keys = source << 21 | self.letter  # sorted: edges lie in the order of their letters

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge of each state with that letter, and whether there is one."""
        key = state << 21 | letter
        edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return edge, self.keys[edge] == key

    def edges_of(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of the states, and for each the place of its state in ``state``."""
        n = self.first[state + 1] - self.first[state]
        at = np.repeat(np.arange(len(state)), n)
        return np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[state], n), at


def one_error(automaton: Automaton, flat: np.ndarray, start: np.ndarray, length: np.ndarray, exact: np.ndarray, shrinks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number) of all words that differ from a query by one letter after its first ``exact``.

    Queries are words of the automaton: letters ``flat[start:start + length]``.  Where ``shrinks`` says so
    only words one letter shorter count, else words as long or one letter longer.  All queries walk together,
    place by place: the path of a query itself, and the paths with an error behind them.
    """
    n = len(start)
    state, number = np.full(n, automaton.root), np.zeros(n, np.int64)
    query, err_state, err_number = (np.zeros(0, np.int64) for _ in range(3))
    found_query, found_word = [query], [query]
    on = np.arange(n)
    for t in range(int(length.max(initial=-1)) + 1):
        # an inserted letter: the query's place stays
        grows = on[(t >= exact[on]) & ~shrinks[on]]
        edge, at = automaton.edges_of(state[grows])
        extra = grows[at]
        query = np.concatenate([query, extra])
        err_state = np.concatenate([err_state, automaton.target[edge]])
        err_number = np.concatenate([err_number, number[extra] + automaton.skip[edge]])
        # what has come to the query's end is found, where a word ends
        over = length[query] == t
        ends = over & automaton.final[err_state]
        found_query.append(query[ends])
        found_word.append(err_number[ends])
        query, err_state, err_number = query[~over], err_state[~over], err_number[~over]
        on = on[length[on] > t]
        letter = np.zeros(n, np.int64)
        letter[on] = flat[start[on] + t]
        # paths with an error go on along the query
        edge, there = automaton.step(err_state, letter[query])
        query, edge = query[there], edge[there]
        err_state, err_number = automaton.target[edge], err_number[there] + automaton.skip[edge]
        # a letter replaced, or left out
        swaps = on[(t >= exact[on]) & ~shrinks[on]]
        edge, at = automaton.edges_of(state[swaps])
        other = automaton.letter[edge] != letter[swaps[at]]
        edge, swapped = edge[other], swaps[at[other]]
        drops = on[(t >= exact[on]) & shrinks[on]]
        query = np.concatenate([query, swapped, drops])
        err_state = np.concatenate([err_state, automaton.target[edge], state[drops]])
        err_number = np.concatenate([err_number, number[swapped] + automaton.skip[edge], number[drops]])
        # the query's own path, which is always there
        edge, _ = automaton.step(state[on], letter[on])
        state[on], number[on] = automaton.target[edge], number[on] + automaton.skip[edge]
    pairs = np.unique(np.concatenate(found_query) * np.int64(len(automaton.words)) + np.concatenate(found_word))
    return pairs // max(1, len(automaton.words)), pairs % max(1, len(automaton.words))
