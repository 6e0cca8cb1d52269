"""Plain versions of operators: dictionaries and loops over whole tables, sharing no code with the operators."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def linked(sets, percent=80):
    """The number of the component of each set, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def _fold(i):
    return zlib.crc32(str(i).encode()) % 4


def _tokens(text):
    """Words, without those that repeat the one before."""
    return [w for w, _ in itertools.groupby(re.findall(r"[^\W_]+", (text or "").lower()))]


def _differences(docs, marks, ids, discount):
    """A function from texts to the differences of their words' log-likelihoods by two Kneser-Ney models of the documents ids."""
    share = Counter(marks.values())
    pairs = [set(), set()]
    for i in ids:
        w = _tokens(docs[i])
        pairs[marks[i]].update(zip([None, *w], w))
    n = [Counter(w for _, w in p) for p in pairs]
    size = [sum(c.values()) for c in n]
    d = [discount * share[k] / (share[0] + share[1]) for k in (0, 1)]
    back = [1 - sum(max(c - d[k], 0) for c in n[k].values()) / size[k] for k in (0, 1)]

    def p(k, w):
        return max(n[k][w] - d[k], 0) / size[k] + back[k] * (n[0][w] + n[1][w]) / sum(size)

    def of(text):
        # a word that neither class has: the shared factor, whatever it is, stands in both
        return [math.log(p(1, w) / p(0, w)) if n[0][w] + n[1][w] else math.log(back[1] / back[0]) for w in _tokens(text)]

    return of


def toxicity(docs, labels, discount=40.0, telling=4):
    """The score of each document (id to text); labels: pairs of id and class."""
    marks = {}
    for i, toxic in labels:
        if toxic is not None and i is not None and _fold(i) != 2:
            marks[i] = max(toxic, marks.get(i, 0))
    known = [i for i in marks if docs.get(i) is not None]
    first = _differences(docs, marks, [i for i in known if _fold(i) != 3], discount)
    final = _differences(docs, marks, known, discount)

    def inputs(values):
        best = sum(max(0, v) for v in sorted(values)[-telling:]) / telling
        return sum(values) / max(1, len(values)), best, math.log(max(1, len(values)))

    x = np.array([inputs(first(docs[i])) for i in known if _fold(i) == 3])
    y = np.array([marks[i] for i in known if _fold(i) == 3], float)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    scaled = lambda v: np.concatenate([[1.0], np.clip((np.array(v) - mean) / spread, -4, 4)])
    rows, weights = np.array([scaled(v) for v in x]), np.zeros(4)
    ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2])
    for _ in range(40):
        q = 1 / (1 + np.exp(-rows @ weights))
        weights = weights - np.linalg.inv(rows.T @ np.diag(q * (1 - q)) @ rows + ridge) @ (rows.T @ (q - y) + ridge @ weights)
    return {i: 1 / (1 + math.exp(-scaled(inputs(final(t))) @ weights)) for i, t in docs.items()}


def pair_means(docs, labels, pair_discount, discount=40.0):
    """The mean difference of the log-likelihoods of each document's words, each given the word before it, by the models of all labelled documents."""
    marks = {}
    for i, toxic in labels:
        if toxic is not None and i is not None and _fold(i) != 2:
            marks[i] = max(toxic, marks.get(i, 0))
    known = [i for i in marks if docs.get(i) is not None]
    share = Counter(marks.values())
    runs = [[w for i in known if marks[i] == k and (w := _tokens(docs[i]))] for k in (0, 1)]
    pairs = [Counter(p for w in run for p in zip([None, *w], [*w, None])) for run in runs]
    after = [Counter() for _ in pairs]
    for k, counts in enumerate(pairs):
        for (v, _), c in counts.items():
            after[k][v] += c
    n = [Counter(w for _, w in p if w is not None) for p in pairs]
    size = [sum(c.values()) for c in n]
    d = [discount * share[k] / (share[0] + share[1]) for k in (0, 1)]
    back = [1 - sum(max(c - d[k], 0) for c in n[k].values()) / size[k] for k in (0, 1)]
    spent = [Counter() for _ in pairs]
    for k, counts in enumerate(pairs):
        for (v, _), c in counts.items():
            spent[k][v] += max(c - pair_discount, 0)

    def p(k, v, w):
        shared = (n[0][w] + n[1][w]) / sum(size) or 1e-9  # a word of neither class: the factor stands in both
        word = max(n[k][w] - d[k], 0) / size[k] + back[k] * shared
        return max(pairs[k][v, w] - pair_discount, 0) / max(1, after[k][v]) + (1 - spent[k][v] / max(1, after[k][v])) * word

    def mean(w):
        return sum(math.log(p(1, v, x) / p(0, v, x)) for v, x in zip([None, *w], w)) / max(1, len(w))

    return {i: mean(_tokens(t)) for i, t in docs.items()}
