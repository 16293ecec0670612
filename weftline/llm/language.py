"""The language of a text by character n-grams, fitted on labelled texts of the corpus.

Labels may be spelled unevenly and be wrong at times: what counts is their first two letters, and a language needs
``LEAST_TEXTS`` labelled texts to take part. The model is naive Bayes on n-grams of one to three characters with
marks at both ends of a word. A word's grams are scored once and remembered, so a text costs one look-up a word and
language. Fitting reads a sample of a bounded number of labelled rows, drawn by hash over the whole table.
"""

from __future__ import annotations

import math
from collections import Counter

MARKS = frozenset(".!?;,:")
LEAST_TEXTS = 5
LONGEST = 3


def grams(word: str) -> list[str]:
    """The n-grams of a word between its marks."""
    w = f"<{word}>"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)]


def label_of(label: str | None) -> str | None:
    """The first two letters of a label in lower case, or None."""
    t = (label or "").strip().lower()[:2]
    return t if len(t) == 2 and t.isascii() and t.isalpha() else None


class _Scores(dict):
    """Words -> the logarithm of their probability in one language."""

    MOST = 400_000

    def __init__(self, known: dict[str, float], other: float) -> None:
        super().__init__()
        self.known, self.other = known, other

    def __missing__(self, word: str) -> float:
        got = self[word] = 0.0 if word in MARKS else sum(self.known.get(g, self.other) for g in grams(word))
        return got

    def __reduce__(self):  # noqa: ANN204
        return _Scores, (self.known, self.other)


class Languages:
    """A fitted model: for each language the logarithms of its grams' probabilities."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        every = len(set().union(*counts.values())) if counts else 0
        self.scores: dict[str, _Scores] = {}
        for lang, c in sorted(counts.items()):
            whole = sum(c.values()) + 0.5 * (every + 1)
            self.scores[lang] = _Scores({g: math.log((k + 0.5) / whole) for g, k in c.items()}, math.log(0.5 / whole))

    def of(self, tokens: list[str]) -> str | None:
        """The likeliest language of a text's words; ties by name; None without words or languages."""
        if not tokens or not self.scores:
            return None
        for s in self.scores.values():
            if len(s) > s.MOST:
                s.clear()
        return max(sorted(self.scores), key=lambda k: sum(map(self.scores[k].__getitem__, tokens)))


def fit(samples: list[tuple[list[str], str | None]]) -> Languages:
    """A model from (tokens, label)."""
    counts: dict[str, Counter] = {}
    texts: Counter = Counter()
    for tokens, label in samples:
        if (lang := label_of(label)) and tokens:
            texts[lang] += 1
            c = counts.setdefault(lang, Counter())
            for w, n in Counter(t for t in tokens if t not in MARKS).items():
                for g in grams(w):
                    c[g] += n
    return Languages({k: c for k, c in counts.items() if texts[k] >= LEAST_TEXTS})
