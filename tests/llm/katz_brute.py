"""The same model as mnemo.llm.katz, written word by word in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(text or "")) + [None]


def held_out(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 10 == 0


def factors(counts):
    n = Counter(counts)
    out = {}
    rest = 6 * n[6] / n[1] if n[1] else 1
    for r in range(1, 6):
        out[r] = 1.0
        if n[1] and n[r] and rest < 1:
            d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest)
            if 0 < d < 1:
                out[r] = d
    return out


class Brute:
    def __init__(self, docs, order=2):
        self.order, self.one = order, Counter()
        self.after = [None, None] + [defaultdict(Counter) for _ in range(2, order + 1)]
        for doc_id, text in docs:
            if not held_out(doc_id):
                said = [None]
                for t in tokens_of(text):
                    self.one[t] += 1
                    for k in range(2, min(order, len(said) + 1) + 1):
                        self.after[k][tuple(said[1 - k :])][t] += 1
                    said.append(t)
        self.N, self.V = sum(self.one.values()), len(self.one)
        self.d1 = factors(self.one.values())
        self.d = [None, None] + [factors([c for x in self.after[k].values() for c in x.values()]) for k in range(2, order + 1)]
        kept = sum(self.d1.get(c, 1.0) * c for c in self.one.values())
        self.size = self.N if kept < self.N - 1e-9 else self.N + 1
        self.unknown = (self.size - kept) / self.size
        self.weights = {}

    def low(self, t):
        c = self.one.get(t, 0)
        return self.d1.get(c, 1.0) * c / self.size if c else self.unknown

    def p(self, h, t):
        """Probability of t after the words h, a tuple."""
        if not h:
            return self.low(t)
        seen, d = self.after[len(h) + 1].get(h), self.d[len(h) + 1]
        if not seen:
            return self.p(h[1:], t)
        total = sum(seen.values())
        kept = sum(d.get(c, 1.0) * c for c in seen.values())
        size = total if kept < total - 1e-9 else total + 1
        if t in seen:
            return d.get(seen[t], 1.0) * seen[t] / size
        if h not in self.weights:
            self.weights[h] = (size - kept) / size / (1 - sum(self.p(h[1:], w) for w in seen))
        return self.weights[h] * self.p(h[1:], t)

    def score(self, text):
        said, out, base, known = [None], 0.0, 0.0, 0
        for t in (ts := tokens_of(text)):
            out += math.log10(self.p(tuple(said[-(self.order - 1) :] if self.order > 1 else ()), t))
            base += math.log10((self.one.get(t, 0) + 0.1) / (self.N + 0.1 * (self.V + 1)))
            known += t in self.one
            said.append(t)
        return len(ts), known, base, out
