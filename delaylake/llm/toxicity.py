"""Operator 9: toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digit substitutions, combining marks),
reduced to words, and matched against word beginnings by one Aho-Corasick
automaton; accented words are matched as they are and without their accents.
Weights are log odds learned from labelled documents. Exception phrases, that is
words or neighbouring pairs that hold a term and were seen only in clean
documents, take the term's weight back. The sum is normalised by length (the weight itself,
by the logarithm of the number of words, and for each hundred words: syllables of a term
also turn up by chance in long clean texts), and a logistic curve turns it into a score.

Only labelled rows whose ``crc32(doc_id) mod 3`` is not 1 are learned from, at
most ``SAMPLE`` of them (those with the least hash): a bound that does not grow
with the corpus. Every document is scored over its whole text.

Defined results: null and empty texts have no words and get the score of a text
without matches; without labels of both kinds nothing can be told apart and
every score is 0.5 (only toxic ones) or 0; near copies (one least shingle) are one labelled
text, the least of them, toxic if one of them is; repeated labels of a document count as toxic if one of them is;
labels with a null doc_id or null toxic, and columns besides, are not used; rows
of documents that share a doc_id are scored each on its own text; a null doc_id
is not held out.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, ship, stored, strings, table, texts_of

SAMPLE = 20_000
THRESHOLD = 0.7
SHORTEST, LONGEST = 4, 14
MIN_DOCS = 3
MIN_ODDS = 2.0
#: Chance that any one of the candidate terms is chosen without cause.
FALSE_TERM = 0.05
ONCE_IN = 50

_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ß": "s", "æ": "a", "œ": "o", "ø": "o", "ł": "l", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e",
}


class _Fold(dict):
    """Code point to folded letter, a space for all that is no letter; filled as signs turn up.

    Accented letters stay as they are unless ``bare``: languages use them to tell
    words apart.
    """

    def __init__(self, bare: bool = False):
        super().__init__()
        self.bare = bare

    def __missing__(self, point: int) -> str:
        char = unicodedata.normalize("NFKC", chr(point)).lower()[:1]
        base = unicodedata.normalize("NFKD", char)[:1]
        if unicodedata.combining(chr(point)) or unicodedata.category(chr(point)) == "Cf":
            out = ""
        elif base != char and base.isascii() and base.isalpha() and not self.bare:
            out = char
        else:
            out = _LOOKALIKES.get(char) or _LOOKALIKES.get(base) or (base if base.isalpha() else " ")
        self[point] = out
        return out


_FOLD, _BARE = _Fold(), _Fold(bare=True)


def folded_words(text: str) -> list[str]:
    return text.translate(_FOLD).split()


def bared(words: list[str]) -> list[str]:
    """The accented words without their accents, which may hide a term."""
    return [w.translate(_BARE) for w in words if not w.isascii()]


@dataclass
class Lexicon:
    """Terms (word beginnings) and exceptions with their weights, and the logistic curve."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    constant: float | None = 0.0
    _automaton: ahocorasick.Automaton | None = None

    def automaton(self) -> ahocorasick.Automaton | None:
        if self._automaton is None and self.terms:
            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(f" {t}", (w, 1))
            for t, w in self.exceptions.items():
                a.add_word(f" {t} ", (-w, -1))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def sums(self, text: str) -> tuple[float, int, int]:
        """Weight of all matches, their number, and the number of words."""
        words = folded_words(text)
        automaton = self.automaton()
        weight, hits = 0.0, 0
        if automaton is not None and words:
            for line in (words, bared(words)):
                for _, (w, n) in automaton.iter(f" {' '.join(line)} "):
                    weight += w
                    hits += n
        return max(0.0, weight), max(0, hits), len(words)

    def scores(self, sums: list[tuple[float, int, int]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(sums), self.constant)
        return 1 / (1 + np.exp(-np.clip(_inputs(sums) @ np.array(self.curve), -30, 30)))


def _inputs(sums: list[tuple[float, int, int]]) -> np.ndarray:
    s = np.array(sums, dtype=np.float64).reshape(-1, 3)
    density = s[:, 0] / np.log2(s[:, 2] + 2.0)
    rate = np.log1p(100.0 * s[:, 0] / np.maximum(s[:, 2], 1.0))
    return np.stack([np.ones(len(s)), np.minimum(s[:, 0], 10.0), np.minimum(density, 10.0), rate], axis=1)


def _beginnings(words: list[str]) -> Counter:
    """How often each word beginning stands in a text."""
    found: Counter = Counter()
    for w, n in Counter(words).items():
        for size in range(SHORTEST, min(len(w), LONGEST) + 1):
            found[w[:size]] += n
    return found


def _count(kind):
    """Per task: how many toxic and clean sample documents hold each key of ``kind(words)``, and how often.

    In one document a key counts once, and once more for each ``ONCE_IN`` words at most. The
    empty key has the words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: tuple[Counter, Counter] = (Counter(), Counter())
        times: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                words = folded_words(text)
                found, side, most = kind(words), 0 if toxic else 1, 1 + len(words) // ONCE_IN
                docs[side].update(found.keys())
                times[side].update({k: min(n, most) for k, n in found.items()})
                docs[side][""] += 1
                times[side][""] += len(words)
        keys = list(docs[0].keys() | docs[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string())] + [pa.array([c[k] for k in keys], type=pa.int64()) for c in (*docs, *times)], _COUNTED)

    return run


_COUNTED = ["key", "pos", "neg", "pos_n", "neg_n"]


def _counts(sample: DataFrame, kind, least: int = 0) -> dict[str, tuple[int, int, int, int]]:
    found = sample.mapInArrow(_count(kind), "key string, pos long, neg long, pos_n long, neg_n long").groupBy("key").agg(*[F.sum(c).alias(c) for c in _COUNTED[1:]])
    return {r["key"]: tuple(r)[1:] for r in found.filter(F.col("pos") + F.col("neg") >= least).collect()}


def evidence(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """Likelihood ratio statistic of a term's counts against equal shares."""
    share = (pos + neg) / (n_pos + n_neg)
    cells = ((pos, n_pos * share), (neg, n_neg * share), (n_pos - pos, n_pos * (1 - share)), (n_neg - neg, n_neg * (1 - share)))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)


def choose(counts: dict[str, tuple[int, int, int, int]]) -> dict[str, float]:
    """The word beginnings that tell toxic from clean, none the beginning of another, with log odds of their rates.

    Whether a beginning is a term depends on the documents that hold it; which of several
    that overlap, and its weight, on how often it stands in how many words.
    """
    n_pos, n_neg, words_pos, words_neg = counts.get("", (0, 0, 0, 0))
    bar = 2 * math.log(max(2, len(counts)) / FALSE_TERM)
    ranked = []
    for key, (pos, neg, pos_n, neg_n) in counts.items():
        if not key or pos < MIN_DOCS or evidence(pos, neg, n_pos, n_neg) < bar:
            continue
        value = math.log((pos_n + 0.5) / (words_pos + 1)) - math.log((neg_n + 0.5) / (words_neg + 1))
        if value >= MIN_ODDS:
            ranked.append((evidence(pos_n, neg_n, words_pos, words_neg), len(key), key, value))
    ranked.sort(reverse=True)
    terms: dict[str, float] = {}
    covered: set[str] = set()
    for _, n, key, value in ranked:
        if key in covered or any(key[:i] in terms for i in range(SHORTEST, n)):
            continue
        terms[key] = value
        covered.update(key[:i] for i in range(SHORTEST, n + 1))
    return terms


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> tuple[float, ...]:
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + np.clip(step, -4, 4)
    return tuple(b)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of the text's 3-word shingles."""
    for batch in batches:
        least = []
        for text in strings(batch.column(0)):
            words = text.encode("utf-8", "surrogatepass").split()
            grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 3 else [b" ".join(words)]
            least.append(min(map(xxhash.xxh64_intdigest, grams)) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, type=pa.int64())], ["text", "toxic", "family"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The lexicon from at most ``sample`` labelled documents outside the held-out third."""
    doc_id = F.col("doc_id").cast("long")
    usable = (
        labels.select(doc_id.alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("_id").cast("string")) % 3 != 1))
        .groupBy("_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = bounded_sample(usable, ["_id"], sample)
    rows = texts_of(docs)
    # at most `sample` pairs of numbers are broadcast; copies and most near copies of a text
    # (those with the same least shingle) are no further evidence
    joined = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["_id"]).select("text", "toxic")
    families = joined.mapInArrow(_families, "text string, toxic int, family long").groupBy("family")
    picked = stored(families.agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("family"), "labelled")
    sizes = {bool(r["toxic"]): r["count"] for r in picked.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        return Lexicon(constant=0.5 if n_pos else 0.0)
    frequent = set(_counts(picked.filter("toxic != 0"), _beginnings, MIN_DOCS))
    terms = choose(_counts(picked, lambda words: {k: n for k, n in _beginnings(words).items() if k in frequent}))

    def around(words: list[str]) -> dict[str, int]:
        out = set()
        for i, w in enumerate(words):
            if any(w[:n] in terms for n in range(SHORTEST, len(w) + 1)):
                out.add(w)
                out.update(" ".join(p) for p in (words[i - 1 : i + 1] if i else [], words[i : i + 2]) if len(p) == 2)
        return dict.fromkeys(out, 1)

    phrases = {k: v for k, v in _counts(picked, around).items() if k and v[0] == 0 and v[1] >= 2}
    exceptions: dict[str, float] = {}
    for phrase in sorted(phrases, key=lambda p: (p.count(" "), p)):
        words = phrase.split()
        if len(words) == 2 and any(w in exceptions for w in words):
            continue
        exceptions[phrase] = sum(v for w in words for t, v in terms.items() if w.startswith(t))
    lexicon = Lexicon(terms, exceptions, constant=None)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.sums(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found) if found else [[]] * 3, (pa.float64(), pa.int64(), pa.int64()))] + [batch.column(1)], ["w", "hits", "n", "toxic"])

    got = picked.mapInArrow(sums, "w double, hits long, n long, toxic int").toPandas().sort_values(["w", "hits", "n", "toxic"])
    lexicon.curve = _logistic(_inputs(list(zip(got.w, got.hits, got.n))), (got.toxic != 0).to_numpy(float))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_terms, n_words`` for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.sums(t) for t in strings(batch.column(1))]
            hits, n = ([x[i] for x in found] for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lexicon.scores(found), type=pa.float64()), pa.array(hits, type=pa.int64()), pa.array(n, type=pa.int64())], ["doc_id", "score", "n_terms", "n_words"]
            )

    out = texts_of(docs).mapInArrow(run, "doc_id long, score double, n_terms long, n_words long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_terms", "n_words")


def accepted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = lexicon.scores([lexicon.sums(t) for t in strings(batch.column(at))]) < THRESHOLD
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
