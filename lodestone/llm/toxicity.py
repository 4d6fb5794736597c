"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first (case, compatibility forms, homoglyphs, digits and signs
that stand for letters, invisible characters; i, l and 1 become one letter), and
reduced to words between single spaces. Lexicon entries are whole words or word
beginnings with log-odds weights; a match inside an exception phrase counts
nothing. The weight found, by itself and in proportion to the length, goes
through a logistic function.

The lexicon and the function are fitted on at most ``FIT_ROWS`` labelled rows,
those with the smallest hash of doc_id. Every text is scored whole.

Defined results: a null or empty text has no matches and gets the score of such
a text; a doc_id labelled twice is toxic if either label says so; null labels
and ids are not learned from; without labels of both kinds every score is 0;
repeated rows are scored each; other columns are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound_arrow, staged, trim_memory

FIT_ROWS = 20_000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6, 7)
#: A beginning or word is an entry from this many times the odds of clean texts.
LEAST_ODDS = 30.0
LEAST_TOXIC = 3

_LOOKS = {
    "о": "o", "а": "a", "е": "e", "с": "c", "р": "p", "х": "x", "у": "y", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "һ": "h", "ӏ": "i",
    "ο": "o", "α": "a", "ε": "e", "ρ": "p", "χ": "x", "υ": "u", "κ": "k", "τ": "t", "ν": "v", "ι": "i", "η": "n", "ω": "w", "ϲ": "c", "ı": "i", "ł": "i", "ɑ": "a", "ɡ": "g", "ʟ": "i", "ɪ": "i", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i",
}
_FOLD = str.maketrans(_LOOKS | {c: None for c in "­​‌‍⁠﻿"})
_NOT_WORD = re.compile(r"[\W_]+")


def fold_text(text: str | None) -> str:
    """Words of the folded text between single spaces, one at either end."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
    return " " + _NOT_WORD.sub(" ", text.translate(_FOLD)).strip() + " "


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: set[str] = field(default_factory=set)  # " word word "
    coefficients: tuple[float, float, float] = (-50.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found

    def matched(self, automaton, folded: str) -> float:
        """Weight of all matches; of those in one word, only the heaviest."""
        if automaton is None:
            return 0.0
        at: dict[int, float] = {}
        for end, (n, weight) in automaton.iter(folded):
            start = end - n + 1
            if weight > at.get(start, 0.0):
                at[start] = weight
        if self.exceptions:
            for start in list(at):
                before, after = _phrases(folded, start)
                if before in self.exceptions or after in self.exceptions:
                    del at[start]
        return sum(at.values())


def _phrases(folded: str, start: int) -> tuple[str, str]:
    """The word at ``start`` with the word before it, and with the one after."""
    end = folded.find(" ", start + 1)
    before = folded.rfind(" ", 0, start) if start > 0 else start
    after = folded.find(" ", end + 1) if end >= 0 else -1
    return folded[max(before, 0) : end + 1], folded[start : after + 1] if after > 0 else ""


def _features(folded: str) -> set[str]:
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update(" " + w[:k] for k in PREFIXES if len(w) > k)
    return out


def _entries(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """From each tree of beginnings, the most specific that lose no toxic texts,
    and the most general that hold no more than stray clean ones."""

    def odds(f: str) -> float:
        return (toxic[f] + 0.5) / (n_toxic + 1) / ((clean[f] + 0.5) / (n_clean + 1))

    least = max(LEAST_TOXIC, math.ceil(0.002 * n_toxic))
    strong = {f for f, n in toxic.items() if n >= least and odds(f) >= LEAST_ODDS}
    children: dict[str, list[str]] = {}
    for f in strong:
        stem = f.strip()
        for k in PREFIXES:
            if len(stem) > k:
                children.setdefault(" " + stem[:k], []).append(f)
    skip, chosen = set(), {}
    for f in sorted(strong, key=lambda f: (len(f.strip()), f)):
        if f in skip:
            continue
        below = children.get(f, []) if not f.endswith(" ") else []
        if any(toxic[c] >= 0.95 * toxic[f] for c in below):
            continue  # one longer entry says the same
        chosen[f] = min(6.0, math.log(odds(f)))
        skip.update(below)
    return chosen


def _shape(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Regressors: a constant, the weight, and the weight per root of length."""
    return np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(weight / np.sqrt(1 + words / 50))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn from the labelled rows given (callers leave held-out ones away)."""
    spark = documents.sparkSession
    bound_arrow(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # the bound makes it fit to broadcast
    rows = staged(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-fit")

    def count(wanted: int, only: frozenset | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, n = Counter(), 0
            for batch in batches:
                for text in batch.text:
                    f = _features(fold_text(text))
                    seen.update(f if only is None else f & only)
                    n += 1
                    if len(seen) > 200_000:
                        yield _counted(seen)
                        seen = Counter()
            yield _counted(Counter({"": n}) + seen if n else seen)

        return rows.where((F.col("toxic") > 0) if wanted else (F.col("toxic") <= 0)).mapInPandas(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    # What occurs in few toxic texts is no entry, so it never reaches the driver.
    toxic = Counter({r.f: r.n for r in count(1, None).where((F.col("n") >= LEAST_TOXIC) | (F.col("f") == "")).toLocalIterator()})
    n_toxic = toxic.pop("", 0)
    least = max(LEAST_TOXIC, math.ceil(0.002 * n_toxic))
    frequent = frozenset(f for f, n in toxic.items() if n >= least)
    clean = Counter({r.f: r.n for r in count(0, frequent).toLocalIterator()})
    n_clean = clean.pop("", 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    lexicon = Lexicon(weights=_entries(toxic, clean, n_toxic, n_clean))
    lexicon.exceptions = _exceptions(rows, lexicon)
    seen = _weigh(rows, lexicon, ["toxic int"]).toPandas()
    x = _shape(seen.weight.to_numpy(), seen.words.to_numpy(dtype=float))
    lexicon.coefficients = tuple(map(float, _logistic(x, (seen.toxic > 0).to_numpy(dtype=float))))
    return lexicon


def _counted(seen: Counter) -> pd.DataFrame:
    """Columns of a fixed type, also where a task has seen nothing: an empty list
    would become a column of floats, which no longer is a string column."""
    return pd.DataFrame({"f": np.array(list(seen), dtype=object), "n": np.array(list(seen.values()), dtype=np.int64)})


def _exceptions(rows: DataFrame, lexicon: Lexicon) -> set[str]:
    """Phrases of two words, one of them matched, that clean texts hold at
    least three times and more often than toxic ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, seen = lexicon.automaton(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.text, batch.toxic):
                folded = fold_text(text)
                for end, (n, _) in automaton.iter(folded) if automaton else ():
                    for phrase in _phrases(folded, end - n + 1):
                        if phrase.count(" ") == 3:
                            seen[phrase] += -1 if toxic > 0 else 1
        yield _counted(seen)

    sums = rows.mapInPandas(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    return {r.f for r in sums.where(F.col("n") >= 3).toLocalIterator()}


def _weigh(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    names = [k.split(" ")[0] for k in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            weight, words = [], []
            for text in batch.text:
                folded = fold_text(text)
                weight.append(lexicon.matched(automaton, folded))
                words.append(max(0, folded.count(" ") - 1))
            yield batch[names].assign(weight=np.array(weight, dtype=float), words=np.array(words, dtype=np.int64))

    return rows.mapInPandas(run, ", ".join([*keep, "weight double", "words long"]))


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents' columns, with score and predicted (which replace columns
    of these names)."""
    bound_arrow(documents.sparkSession)
    b = np.array(lexicon.coefficients)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            folded = [fold_text(t) for t in texts]
            weight = np.array([lexicon.matched(automaton, f) for f in folded], dtype=float)
            words = np.array([max(0, f.count(" ") - 1) for f in folded], dtype=float)
            trim_memory()
            yield pd.Series(1 / (1 + np.exp(-np.clip(_shape(weight, words) @ b, -30, 30))))

    scored = documents.withColumn("score", toxicity("text"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
