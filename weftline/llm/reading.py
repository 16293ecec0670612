"""Reading level of each document: a pairwise ranker on syntax and vocabulary, calibrated to levels.

1. Prose is separated from the rest of a text: code (fenced, indented or shaped like code), log
   lines, headings, names of code and added notices are no prose. A notice is a first or last
   paragraph that stands in at least ``notice_share`` of all different texts, counted over the
   whole corpus; the share bounds the number of notices.
2. Each graded text gives a vector of syntax features (sentence length, subordination, commas) and
   vocabulary features (word length, long words, mean grade of its words in the other graded texts).
3. A linear ranker is fitted on all pairs of graded texts of different level (logistic loss on the
   difference of the vectors, Newton's method).
4. Isotonic regression (pool adjacent violators) turns scores into levels.
5. Documents are scored in one pass; only numbers leave the pass.

Defined results
* null, blank and non-prose texts: ``n_words`` 0, ``level`` null, ``is_english`` false;
* language is judged by the text, never by its own label: by character n-grams fitted on labelled texts of the corpus, a
  sample of about ``language_rows`` rows drawn by hash; where labels are not given or name fewer than two languages, by
  function words of three languages;
* texts of any length are read whole; repeated texts get equal rows; extra columns are ignored;
* an empty table gives an empty result; fewer than two graded levels are refused.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import language
from weftline.llm.language import Languages

#: Frequent function words by language, to tell the language of a text.
FUNCTION_WORDS = {
    "en": "the a an of to and in is it that this each every any some no with for on by not when if which because from as its your our you we they",
    "de": "der die das den dem des und ist nicht ein eine einen mit von zu im für auf weil obwohl wenn dass sich wird sie er es auch oder",
    "es": "el la los las de que y en un una es por con para no se del al lo porque aunque su como más pero o",
}
#: Words that join or subordinate clauses.
JOINERS = frozenset(
    "because although though while since once unless until after before when whenever if whether which who whom whose whereas so but and or albeit insofar inasmuch notwithstanding provided that lest whereby wherein".split()
)
CODE_HINT = re.compile(r"[{}=;(]|//|/\*|\*/|::")
CODE_MARKS = re.compile(r"[{}]|\w\(|^\s*(?://|/\*|\*/)|;\s*$|[^=!<>]=[^=]|=>|::|^\s*(?:if|for|while|else|return|import|def|class|func|fn|let|var|const)\b.*[{:;]\s*$")
LOG_LINE = re.compile(r"\s*(?:\[\s*[\d:.\-T ]+\]|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:\S+\s+){0,2}(?:INFO|WARN|WARNING|ERROR|FAIL|DEBUG|TRACE|FATAL)\b)")
INLINE_CODE = re.compile(r"``.*?``|`[^`\n]*`")
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?;,:]")
#: A name of code: joined by _ . / \ or ::, with digits, mixed case inside, or in capitals.
CODE_NAME = re.compile(r"[_/\\\d@#$%&*<>|~^]|\w[.:]+\w|[a-z][A-Z]|[A-Z]{5}")
BULLET = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+")
HEADING = re.compile(r"\s{0,3}#{1,6}\s")
BLANK_LINE = re.compile(r"\n[ \t]*\n")


def paragraph_key(p: str) -> str:
    """A paragraph without regard to case and line breaks."""
    return " ".join(p.lower().split())


def split_paragraphs(text: str) -> list[str]:
    return [p for p in BLANK_LINE.split(text.replace("\r\n", "\n").replace("\r", "\n")) if p.strip()]


def prose_text(text: str, notices: frozenset[str] = frozenset()) -> str:
    """The prose of a text, each paragraph and bullet closed by a full stop; code, logs, headings, names of code and notices left out."""
    units: list[str] = []
    lines: list[str] = []
    fenced = False

    def close() -> None:
        if lines:
            u = " ".join(lines).rstrip()
            units.append(u if u[-1:] in (".", "!", "?") else u + " .")
            lines.clear()

    for p in split_paragraphs(text):
        if notices and not fenced and paragraph_key(p) in notices:
            continue
        for line in p.split("\n"):
            if "`" in line:
                if line.lstrip().startswith("```"):
                    fenced = not fenced
                    close()
                    continue
                line = INLINE_CODE.sub(" ", line)
            if fenced or not line.strip():
                continue
            bullet = BULLET.match(line)
            if HEADING.match(line) or LOG_LINE.match(line) or (line.startswith(("    ", "\t")) and not bullet) or (CODE_HINT.search(line) and CODE_MARKS.search(line)):
                close()
                continue
            if bullet:
                close()
                line = line[bullet.end() :]
            lines.append(line)
        close()
    return "\n".join(units)


class _Spelled(dict):
    """Pieces between blanks -> their tokens in lower case; a name of code leaves only its closing mark.

    A memory of spellings. ``tidy`` empties it between texts when it has grown past ``MOST``; what a spelling
    gives never depends on what was read before.
    """

    MOST = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.capital: set[str] = set()

    def tidy(self) -> None:
        if len(self) > self.MOST:
            self.clear()
            self.capital.clear()

    def __missing__(self, piece: str) -> list[str]:
        word = piece.strip("\"'()[]")
        if CODE_NAME.search(word):
            got = [word[-1]] if word[-1] in ".!?;,:" else []
        else:
            got = TOKEN.findall(piece.lower())
            if len(word) >= 8 and word[:1].isupper():
                self.capital.add(piece)
        self[piece] = got
        return got


def tokens_of(prose: str, spelled: _Spelled) -> list[str]:
    """Words and marks of a prose text; a long capitalised word inside a sentence is a name and left out."""
    pieces = prose.split()
    found = list(map(spelled.__getitem__, pieces))
    if not spelled.capital.isdisjoint(pieces):
        for i in range(1, len(pieces)):
            if pieces[i] in spelled.capital and pieces[i - 1][-1] not in ".!?:" and pieces[i - 1] not in BULLET_MARKS:
                found[i] = found[i][1:] if found[i] else []
    return list(chain.from_iterable(found))


BULLET_MARKS = frozenset("-*•+")


FEATURES = ("sentence_length", "joiners", "commas", "word_length", "long_words", "word_grade", "pair_grade")
_ENGLISH, _GERMAN, _SPANISH = (frozenset(FUNCTION_WORDS[k].split()) for k in ("en", "de", "es"))


class Grades:
    """Mean grade of the texts that hold a word or a pair of neighbours, as the distance from the mean of all.

    Each is pulled to the mean by as much as four texts weigh.
    """

    def __init__(self, samples: list[tuple[list[str], float]], least: int = 2) -> None:
        self.middle = float(np.mean([y for _, y in samples]))
        word: dict = defaultdict(lambda: [0.0, 0])
        pair: dict = defaultdict(lambda: [0.0, 0])
        for tokens, y in samples:
            for seen, to in ((set(tokens), word), (set(zip(tokens, tokens[1:])), pair)):
                for w in seen:
                    to[w][0] += y - self.middle
                    to[w][1] += 1
        mark = frozenset(".!?;,:")
        self.words = {w: s / (c + 4) for w, (s, c) in word.items() if c >= least and w not in mark}
        self.pairs = {w: s / (c + 4) for w, (s, c) in pair.items() if c >= least and not mark & set(w)}


def measure(tokens: list[str], grades: Grades) -> tuple[int, np.ndarray]:
    """Number of prose words and the feature vector of a text."""
    stops = tokens.count(".") + tokens.count("!") + tokens.count("?")
    commas = tokens.count(",") + tokens.count(";") + tokens.count(":")
    n = len(tokens) - stops - commas
    lengths = list(map(len, tokens))
    m = max(n, 1)
    at = [math.log(min(max(n / max(1, stops), 3.0), 60.0)), sum(map(JOINERS.__contains__, tokens)) / m, commas / m, (sum(lengths) - stops - commas) / m, sum(map((8).__lt__, lengths)) / m]
    pairs = list(zip(tokens, tokens[1:]))
    for known, seen in ((grades.words, tokens), (grades.pairs, pairs)):
        got = list(map(known.get, seen))
        at.append(sum(filter(None, got)) / max(1, len(got) - got.count(None)))
    return n, np.array(at)


def fit_ranker(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of the linear pairwise ranker: logistic loss over all pairs of different level."""
    i, j = np.nonzero(y[:, None] > y[None, :])
    d = x[i] - x[j]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = d.T @ p / len(d) - ridge / len(y) * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge / len(y) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, level), to be read by linear interpolation."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, s2 = blocks.pop()
            v1, n1, s1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, (s1 * n1 + s2 * n2) / (n1 + n2)])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


class Reader:
    """A fitted reading-level model; small enough to be sent to every task."""

    def __init__(self, graded: list[tuple[str, float]], folds: int = 10) -> None:
        if len({y for _, y in graded}) < 2:
            raise ValueError("graded texts of at least two levels are needed")
        spelled = _Spelled()
        tokens = [tokens_of(prose_text(t or ""), spelled) for t, _ in graded]
        y = np.array([float(v) for _, v in graded])
        fold = np.arange(len(y)) % folds
        # The grade features of a text come from the other folds, so that they mean the same for new texts.
        x = np.zeros((len(y), len(FEATURES)))
        for f in range(folds):
            rest = Grades([(u, v) for u, v, k in zip(tokens, y, fold) if k != f] or list(zip(tokens, y)))
            for k in np.flatnonzero(fold == f):
                x[k] = measure(tokens[k], rest)[1]
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-9
        self.weights = fit_ranker((x - self.shift) / self.scale, y)
        self.knots = isotonic(((x - self.shift) / self.scale) @ self.weights, y)
        self.grades = Grades(list(zip(tokens, y)))

    def read(self, text: str | None, notices: frozenset[str] = frozenset(), spelled: _Spelled | None = None, languages: Languages | None = None) -> tuple[int, bool, float | None, float | None]:
        """Prose words, whether the prose is English, score and level."""
        spelled = _Spelled() if spelled is None else spelled
        spelled.tidy()
        tokens = tokens_of(prose_text(text, notices), spelled) if text else []
        n, v = measure(tokens, self.grades)
        if not n:
            return 0, False, None, None
        s = float((v - self.shift) / self.scale @ self.weights)
        english = languages.of(tokens) == "en" if languages else is_english(tokens)
        return n, english, s, float(np.interp(s, *self.knots))


def is_english(tokens: list[str]) -> bool:
    """Whether English function words outnumber those of each other language."""
    en, de, es = (sum(map(ws.__contains__, tokens)) for ws in (_ENGLISH, _GERMAN, _SPANISH))
    return en > max(de, es)


def _gram_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """texts, labels -> grams counted by language, once per partition; the empty gram counts texts."""
    found: Counter = Counter()
    words: dict[str, Counter] = defaultdict(Counter)
    spelled = _Spelled()
    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            spelled.tidy()
            tokens = tokens_of(prose_text(text.as_py()), spelled)
            if (lang := language.label_of(label)) and tokens:
                found[lang, ""] += 1
                words[lang].update(tokens)
    for lang, seen in words.items():  # each word's grams once, as often as the word stands
        for w, n in seen.items():
            for g in language.grams(w) if w not in language.MARKS else ():
                found[lang, g] += n
    cols = [[k for k, _ in found], [g for _, g in found], list(found.values())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])


def fit_languages(docs: DataFrame, doc_id: str, text: str, label: str, rows: int = 2000) -> Languages | None:
    """A model from about ``rows`` labelled rows drawn by hash of their id; None where they name fewer than two languages or no English."""
    some = docs.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    n = some.count()
    if not n:
        return None
    drawn = some.filter(F.pmod(F.xxhash64(doc_id), F.lit(2**30)) < math.ceil(2**30 * min(1.0, rows / n))).select(text, label)
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in drawn.mapInArrow(_gram_counts, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():  # grams of a bounded sample
        counts[r["lang"]][r["gram"]] = r["n"]
    enough = {k: c for k, c in counts.items() if c.pop("", 0) >= language.LEAST_TEXTS}
    return Languages(enough) if len(enough) > 1 and "en" in enough else None


def edge_paragraphs(text: str) -> list[str]:
    """The first and the last paragraph."""
    p = [x for x in split_paragraphs(text)]
    return [p[0], p[-1]] if len(p) > 1 else []


def _key_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, texts = [], []
        for t in b.column(0):
            t = t.as_py()
            h = xxhash.xxh3_64_intdigest(t) - 2**63
            for k in {_key_hash(paragraph_key(p)) for p in edge_paragraphs(t)}:
                keys.append(k)
                texts.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.int64())], ["para", "text_hash"])


def _wording(wanted: frozenset[bytes]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The keys whose hashes are wanted, each once per partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = set(wanted)
        for b in batches:
            found = []
            for t in b.column(0) if left else ():
                for k in map(paragraph_key, edge_paragraphs(t.as_py())):
                    if (h := _key_hash(k)) in left:
                        left.discard(h)
                        found.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["para"])

    return run


def find_notices(docs: DataFrame, text: str, share: float = 0.005, least: int = 5) -> frozenset[str]:
    """First or last paragraphs that stand in at least ``share`` of the different texts: at most 2 / share of them."""
    some = docs.filter(F.col(text).isNotNull()).select(text)
    seen = some.mapInArrow(_edges, "para binary, text_hash bigint")
    n = some.select(F.xxhash64(text).alias("h")).distinct().count()
    # Counted by hash of the whole paragraph; only the wording of the few found travels.
    found = seen.groupBy("para", "text_hash").agg(F.lit(1).alias("one")).groupBy("para").count().filter(F.col("count") >= max(least, share * n))
    wanted = frozenset(bytes(r["para"]) for r in found.collect())
    if not wanted:
        return frozenset()
    return frozenset(r["para"] for r in some.mapInArrow(_wording(wanted), "para string").distinct().collect())


LEVELS = "n_words int, is_english boolean, score double, level double"


def read_levels(docs: DataFrame, graded: DataFrame, *, doc_id: str, text: str, sample_text: str, sample_level: str, keep: list[str] | None = None, notice_share: float = 0.005, label: str | None = None, language_rows: int = 2000) -> DataFrame:
    """(doc_id, kept columns, n_words, is_english, score, level) for every document.

    ``graded`` is the labelled sample; it is collected, so it must be of bounded size (thousands of texts).
    """
    spark = docs.sparkSession
    model = Reader([(r[0], float(r[1])) for r in graded.filter(F.col(sample_text).isNotNull() & F.col(sample_level).isNotNull()).select(sample_text, sample_level).collect()])
    languages = fit_languages(docs, doc_id, text, label, language_rows) if label else None
    sent = spark.sparkContext.broadcast((model, find_notices(docs, text, notice_share), languages))
    carried = [doc_id, *(keep or [])]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, notices, languages = sent.value
        spelled = _Spelled()
        for b in batches:
            got = [m.read(t.as_py(), notices, spelled, languages) for t in b.column(len(carried))]
            cols = list(zip(*got)) if got else [[], [], [], []]
            arrays = [b.column(i) for i in range(len(carried))] + [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.bool_(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, "n_words", "is_english", "score", "level"])

    return docs.select(*carried, text).mapInArrow(run, f"{kinds}, {LEVELS}")
