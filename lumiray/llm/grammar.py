"""Probabilistic automata inferred from examples: compatible states of their prefix tree are merged."""

from __future__ import annotations

from collections import deque
from math import log, sqrt

import numpy as np

#: fixed values: characters of credentials by class; classes are what an unseen character falls back to
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", ".", "=")
ALPHABET = "".join(CLASSES)
CODE = np.full(256, -1, dtype=np.int64)
CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))
CLASS_OF = np.repeat(np.arange(len(CLASSES)), [len(c) for c in CLASSES])
PRIOR = 4.0
_SIZES = np.array([len(c) for c in CLASSES])


class Tree:
    """States with how many examples reach them, end there, and leave by each symbol. Starts as a prefix tree."""

    def __init__(self, examples: list[bytes]):
        self.reach, self.end, self.next, self.leave = [0], [0], [{}], [{}]
        for example in examples:
            at = 0
            for symbol in CODE[np.frombuffer(example, dtype=np.uint8)].tolist():
                self.reach[at] += 1
                self.leave[at][symbol] = self.leave[at].get(symbol, 0) + 1
                if symbol not in self.next[at]:
                    self.next[at][symbol] = len(self.reach)
                    for column, empty in ((self.reach, 0), (self.end, 0), (self.next, {}), (self.leave, {})):
                        column.append(empty)
                at = self.next[at][symbol]
            self.reach[at] += 1
            self.end[at] += 1

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether the shares that end or leave by each symbol differ by no more than chance (Hoeffding's bound), here and
        wherever both states lead. `b` is the root of a tree."""
        bound = sqrt(0.5 * log(2 / alpha))
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.reach[a], self.reach[b]
            if not n or not m:
                continue
            most = bound * (1 / sqrt(n) + 1 / sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > most:
                return False
            leave_a, leave_b = self.leave[a], self.leave[b]
            if any(abs(leave_a.get(s, 0) / n - leave_b.get(s, 0) / m) > most for s in leave_a.keys() | leave_b.keys()):
                return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below `b` to `a`."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.reach[a] += self.reach[b]
            self.end[a] += self.end[b]
            for symbol, n in self.leave[b].items():
                self.leave[a][symbol] = self.leave[a].get(symbol, 0) + n
                if symbol in self.next[a]:
                    todo.append((self.next[a][symbol], self.next[b][symbol]))
                else:
                    self.next[a][symbol] = self.next[b][symbol]


def infer(examples: list[bytes], alpha: float = 0.05) -> Tree:
    """States are taken breadth first; each is folded into the first kept state it is compatible with, or kept."""
    tree = Tree(sorted(examples))
    kept, known = [0], {0}
    todo = deque((0, s) for s in sorted(tree.next[0]))
    while todo:
        parent, symbol = todo.popleft()
        state = tree.next[parent][symbol]
        if state in known:
            continue
        into = next((k for k in kept if tree.compatible(k, state, alpha)), None)
        if into is None:
            kept.append(state)
            known.add(state)
            todo.extend((state, s) for s in sorted(tree.next[state]))
        else:
            tree.next[parent][symbol] = into
            tree.fold(into, state)
            # what the kept states lead to has changed
            todo.extend((k, s) for k in kept for s in sorted(tree.next[k]) if tree.next[k][s] not in known)
    order = {k: at for at, k in enumerate(kept)}
    tree.reach, tree.end, tree.leave = ([column[k] for k in kept] for column in (tree.reach, tree.end, tree.leave))
    tree.next = [{s: order[t] for s, t in tree.next[k].items()} for k in kept]
    return tree


class Automaton:
    """An inferred tree as tables of logarithms. Each state counts as many more symbols as `PRIOR`, spread like the symbols
    of all examples, so that states of few examples are not sure of what they saw. An unseen symbol leads where its
    class mostly leads."""

    def __init__(self, tree: Tree):
        states, symbols = len(tree.reach), len(ALPHABET)
        leave = np.zeros((states, symbols))
        for k, seen in enumerate(tree.leave):
            leave[k, list(seen)] = list(seen.values())
        total = max(leave.sum(), 1)
        by_class = np.bincount(CLASS_OF, weights=leave.sum(axis=0), minlength=len(CLASSES))
        prior = 0.8 * leave.sum(axis=0) / total + 0.15 * (by_class / _SIZES)[CLASS_OF] / total + 0.05 / symbols
        p = (leave + PRIOR * prior / prior.sum()) / (leave.sum(axis=1, keepdims=True) + PRIOR)
        ends = (np.array(tree.end) + 0.01) / (np.array(tree.reach) + 1)
        self.cost = np.log(p * (1 - ends)[:, None])
        self.stop = np.log(ends)
        self.to = np.zeros((states, symbols), dtype=np.int64)
        for k in range(states):
            for s in range(symbols):
                same = [(tree.leave[k].get(t, 0), -t) for t in tree.next[k] if CLASS_OF[t] == CLASS_OF[s]]
                self.to[k, s] = tree.next[k][s] if s in tree.next[k] else tree.next[k][-max(same)[1]] if same else k

    def score(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-likelihood of each slice of the symbols `data`; all slices advance together, finished ones drop out."""
        out = np.zeros(len(starts))
        who = np.flatnonzero(sizes > 0)
        state, total = np.zeros(len(who), dtype=np.int64), np.zeros(len(who))
        at, stop = starts[who].copy(), (starts + sizes)[who]
        while len(who):
            symbol = data[at]
            total += self.cost[state, symbol]
            state = self.to[state, symbol]
            at += 1
            done = at == stop
            if done.any():
                out[who[done]] = total[done] + self.stop[state[done]]
                go = ~done
                who, state, total, at, stop = who[go], state[go], total[go], at[go], stop[go]
        return out
