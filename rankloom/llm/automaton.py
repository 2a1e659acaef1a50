"""Suffix automata over sequences of numbers, and matching statistics of many sequences at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Automaton:
    """A suffix automaton of several sequences, each with a rank, in flat arrays.

    ``codes`` are the sorted distinct numbers of the sequences; ``steps`` holds
    state * (number of codes) + code of all transitions, sorted, and ``to``
    where each goes.  ``rank`` of a state is the least of the sequences that
    hold its strings; ``whole`` is the state on the way to the root that holds
    the suffix of exactly ``window`` numbers (-1 for shorter strings).
    """

    codes: np.ndarray
    steps: np.ndarray
    to: np.ndarray
    link: np.ndarray
    longest: np.ndarray
    rank: np.ndarray
    whole: np.ndarray

    PARTS = ("codes", "steps", "to", "link", "longest", "rank", "whole")

    def pack(self) -> bytes:
        parts = [getattr(self, name) for name in self.PARTS]
        head = np.array([len(p) for p in parts], np.int64)
        return b"".join([head.tobytes(), *(p.tobytes() for p in parts)])

    @classmethod
    def unpack(cls, raw: bytes) -> Automaton:
        sizes = np.frombuffer(raw, np.int64, len(cls.PARTS))
        kinds = (np.uint64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int32)
        at, parts = sizes.nbytes, []
        for n, kind in zip(sizes.tolist(), kinds):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        return cls(*parts)


def build(sequences: Sequence[np.ndarray], ranks: Sequence[int], window: int) -> Automaton:
    """The automaton of all sequences; time and size are linear in their total length."""
    codes, flat = np.unique(np.concatenate([np.empty(0, np.uint64), *sequences]), return_inverse=True)
    numbers, at = flat.tolist(), 0
    step: list[dict[int, int]] = [{}]
    link, longest, rank = [-1], [0], [max(ranks, default=0)]
    none = max(ranks, default=0) + 1
    for sequence, mine in zip(sequences, ranks):
        last = 0
        for c in numbers[at : at + len(sequence)]:
            state = last
            if c not in step[state]:
                new = len(step)
                step.append({})
                longest.append(longest[last] + 1)
                link.append(0)
                rank.append(none)
                while state >= 0 and c not in step[state]:
                    step[state][c] = new
                    state = link[state]
            else:
                new = -1
            if state >= 0:
                held = step[state][c]
                if longest[held] != longest[state] + 1:
                    copy = len(step)
                    step.append(step[held].copy())
                    longest.append(longest[state] + 1)
                    link.append(link[held])
                    rank.append(none)
                    link[held] = copy
                    while state >= 0 and step[state].get(c) == held:
                        step[state][c] = copy
                        state = link[state]
                    held = copy
                if new >= 0:
                    link[new] = held
                else:
                    new = held
            last = new
            if mine < rank[last]:
                rank[last] = mine
        at += len(sequence)
    links, lengths, least = np.array(link, np.int32), np.array(longest, np.int32), np.array(rank, np.int32)
    whole = np.full(len(links), -1, np.int32)
    up = links.tolist()
    order = np.argsort(lengths, kind="stable").tolist()
    low = least.tolist()
    for s in reversed(order[1:]):  # a state's strings lie wherever those of the states that link to it do
        if low[s] < low[up[s]]:
            low[up[s]] = low[s]
    for s in order[1:]:
        if longest[s] >= window:
            whole[s] = s if longest[up[s]] < window else whole[up[s]]
    number = np.fromiter((len(d) for d in step), np.int64, len(step))
    total = int(number.sum())
    state = np.repeat(np.arange(len(step), dtype=np.int64), number)
    code = np.fromiter((c for d in step for c in d), np.int64, total)
    to = np.fromiter((t for d in step for t in d.values()), np.int32, total)
    steps = state * len(codes) + code
    sort = np.argsort(steps)
    return Automaton(codes, steps[sort], to[sort], links, lengths, np.array(low, np.int32), whole)


def matching(automaton: Automaton, sequences: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics: for every place of every sequence, in one matrix with a row each, how long the longest
    string is that ends there and lies in the automaton, and the state it leads to.

    All sequences take a step together; places beyond a sequence's end have length 0.
    """
    counts = np.array([len(s) for s in sequences], np.int64)
    wide = int(counts.max(initial=0))
    flat = np.concatenate([np.empty(0, np.uint64), *sequences])
    spot = np.searchsorted(automaton.codes, flat)
    known = np.zeros(len(flat), bool)
    if len(automaton.codes):
        known = automaton.codes[np.minimum(spot, len(automaton.codes) - 1)] == flat
    code = np.full((len(counts), wide), -1, np.int64)
    code[np.arange(wide) < counts[:, None]] = np.where(known, spot, -1)
    state, length = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lengths, states = np.zeros((len(counts), wide), np.int32), np.zeros((len(counts), wide), np.int32)
    for t in range(wide):
        here = code[:, t]
        lost = here < 0
        state[lost], length[lost] = 0, 0
        open_ = np.flatnonzero(~lost)
        while len(open_):
            wanted = state[open_] * len(automaton.codes) + here[open_]
            at = np.minimum(np.searchsorted(automaton.steps, wanted), len(automaton.steps) - 1)
            found = automaton.steps[at] == wanted
            done = open_[found]
            state[done] = automaton.to[at[found]]
            length[done] += 1
            rest = open_[~found]
            root = rest[state[rest] == 0]
            length[root] = 0
            open_ = rest[state[rest] != 0]
            state[open_] = automaton.link[state[open_]]
            length[open_] = automaton.longest[state[open_]]
        lengths[:, t], states[:, t] = length, state
    return lengths, states


def window_ranks(automaton: Automaton, sequences: Sequence[np.ndarray], window: int) -> np.ndarray:
    """For each place (row, place) of the sequences the least rank that holds the ``window`` numbers ending there; -1 for none."""
    lengths, states = matching(automaton, sequences)
    return np.where(lengths >= window, automaton.rank[automaton.whole[states]], -1)
