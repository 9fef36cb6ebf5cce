"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, num=75, den=100):
    """Per row (doc_id, text): size of its set, and the smallest doc_id of its component (its own when it has no words)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


BASE = (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, group, least) in enumerate(BASE)
             for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


class Katz:
    """Dictionary version of the model: the definition, word by word."""

    def __init__(self, texts, discounts, kept_above, cut):
        self.one, self.two, self.pairs, self.context = Counter(), None, Counter(), Counter()
        for t in texts:
            tokens = [*words(t), "</s>"]
            self.one.update(tokens)
            self.pairs.update(zip(["<s>", *tokens[:-1]], tokens, strict=True))
        for (v, _), c in self.pairs.items():
            self.context[v] += c
        self.tokens, self.cut, self.above = sum(self.one.values()), cut, kept_above
        seen, seen_two = Counter(self.one.values()), Counter(self.pairs.values())
        self.d1 = discounts([seen[r] for r in range(1, kept_above + 2)])
        self.d2 = [0.0] * (cut - 1) + discounts([seen_two[r] for r in range(1, kept_above + 2)])[cut - 1:]
        self.unknown = sum((1 - self.factor(self.d1, c)) * c for c in self.one.values()) / self.tokens if self.tokens else 1.0
        kept, mass = defaultdict(float), defaultdict(float)
        for (v, w), c in self.pairs.items():
            if c >= cut:
                kept[v] += self.factor(self.d2, c) * c
                mass[v] += self.unigram(w)
        self.alpha, self.scale = {}, {}
        for v, n in self.context.items():
            share, least = kept[v] / n, 0.5 / (n + 1)
            self.scale[v] = (1 - least) / share if 1 - share < least else 1.0
            self.alpha[v] = (1 - self.scale[v] * share) / (1 - mass[v])

    def factor(self, table, c):
        return table[c - 1] if c <= self.above else 1.0

    def unigram(self, w):
        return self.factor(self.d1, self.one[w]) * self.one[w] / self.tokens if w in self.one else self.unknown

    def p(self, v, w):
        c = self.pairs.get((v, w), 0)
        if c >= self.cut:
            return self.scale[v] * self.factor(self.d2, c) * c / self.context[v]
        return self.alpha.get(v, 1.0) * self.unigram(w)

    def scores(self, text):
        tokens = [*words(text), "</s>"]
        base = sum(math.log10((self.one[w] + 1) / (self.tokens + len(self.one) + 1)) for w in tokens)
        score = sum(math.log10(self.p(v, w)) for v, w in zip(["<s>", *tokens[:-1]], tokens, strict=True))
        return len(tokens), sum(w in self.one for w in tokens), base, score


def weighted_jaccard(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0
