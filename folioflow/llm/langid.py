"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that training hasn't seen is
covered from left to right by the longest known character n-grams (4 down to 1 characters, with
word marks), each scoring by its log frequency among n-grams of its length, and counts as their
mean. A text's score for a language is the sum over its words; the predicted language has the
greatest sum, and ``score`` is its share of the normalised likelihoods of the mean word.

The model is fitted on a sample of labelled rows: of each language about ``sample_rows``, taken by a
hash of id and text, or all where there are fewer, so a rare language is learned at any size of the
corpus. It keeps all words of the sample, whose size is bounded by its rows. Prediction reads every
whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if
there are no labelled rows; a text of any length is read in whole; ties go to the language that sorts
first; a null label is not learned from; a null id hashes like an empty one; repeated rows are rows
like others; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import bounded_batches, materialise, scratch

_TOKENS = re.compile(r"[^\W\d_]+").findall
LONGEST = 4
#: Log frequencies are of counts with this much added, per known item.
ADDED = 0.5


def words_of(text: str | None) -> list[str]:
    """Runs of letters and numerals with a letter among them; numerals alone (as ½ or Ⅻ) are none."""
    return [w for w in _TOKENS(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and n-grams; one column for each language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        vocabulary = sorted({w for c in counts.values() for w in c})
        self.words = {w: i for i, w in enumerate(vocabulary)}
        table = np.zeros((len(vocabulary), len(self.langs)))
        for k, lang in enumerate(self.langs):
            for w, c in counts[lang].items():
                table[self.words[w], k] = c
        self.table = self._logs(table)
        self.rows: list[dict[str, int]] = [{}]
        self.parts = [table[:0]]
        for n in range(1, LONGEST + 1):
            rows: dict[str, int] = {}
            at = np.fromiter((rows.setdefault(g, len(rows)) for w in vocabulary for g in grams(w, n)), dtype=np.int64)
            of = np.repeat(np.arange(len(vocabulary)), [max(0, len(w) + 3 - n) for w in vocabulary])
            summed = np.zeros((len(rows), len(self.langs)))
            np.add.at(summed, at, table[of])
            self.rows.append(rows)
            self.parts.append(self._logs(summed))
        self.unseen: dict[str, np.ndarray] = {}

    @staticmethod
    def _logs(table: np.ndarray) -> np.ndarray:
        return np.log((table + ADDED) / (table.sum(axis=0) + ADDED * max(1, len(table)))).astype("float64") if len(table) else table

    def back_off(self, word: str) -> np.ndarray:
        """The mean over the longest known n-grams that cover the word from left to right; zeros if none is known."""
        found = self.unseen.get(word)
        if found is None:
            marked, at, seen = f"^{word}$", 0, []
            while at < len(marked):
                for n in range(min(LONGEST, len(marked) - at), 0, -1):
                    if (i := self.rows[n].get(marked[at : at + n])) is not None:
                        seen.append(self.parts[n][i])
                        at += n
                        break
                else:
                    at += 1
            found = np.mean(seen, axis=0) if seen else np.zeros(len(self.langs))
            if len(self.unseen) > 200_000:
                self.unseen.clear()
            self.unseen[word] = found
        return found

    def scores(self, word: str) -> np.ndarray:
        i = self.words.get(word)
        return self.back_off(word) if i is None else self.table[i]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; each distinct word of the texts is looked up once."""
        tokens: list[str] = []
        ends = [0]
        for t in texts:
            tokens += words_of(t)
            ends.append(len(tokens))
        out = [("und", 0.0)] * len(texts)
        if not tokens or not self.langs:
            return out
        of, words = pd.factorize(np.array(tokens, dtype=object))
        table = np.stack([self.scores(w) for w in words])
        n = np.diff(ends)
        some = np.flatnonzero(n)
        total = np.add.reduceat(table[of], np.array(ends[:-1])[some])
        best = total.argmax(axis=1)
        each = np.exp((total - total[np.arange(len(some)), best][:, None]) / n[some][:, None])
        share = each[np.arange(len(some)), best] / each.sum(axis=1)
        for i, k, s in zip(some.tolist(), best.tolist(), share.tolist()):
            out[i] = (self.langs[k], s)
        return out


def train(labelled: DataFrame) -> dict[str, dict[str, int]]:
    """Word counts by language. ``labelled`` has lang, text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b["lang"], b["text"]):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, c) for lang, ws in found.items() for w, c in ws.items()]
            yield pd.DataFrame(rows, columns=["lang", "word", "n"]).astype({"n": "int64"})

    counted = labelled.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found: dict[str, dict[str, int]] = {}
    for b in counted.toArrow().to_batches():
        for lang, w, n in zip(b["lang"].to_pylist(), b["word"].to_pylist(), b["n"].to_pylist()):
            found.setdefault(lang, {})[w] = n
    # A language may have labelled texts without a word.
    return found


def sample(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` rows of each language. ``labelled`` has lang, text, _id."""
    many = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "language-sizes")
    draw = F.shiftrightunsigned(F.xxhash64("_id", "text"), 11) / F.lit(float(1 << 53))
    return labelled.join(many, "lang").where(draw * F.col("_n") < sample_rows).select("lang", "text")


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 3,
    held_fold: int = 1,
    sample_rows: int = 2500,
) -> DataFrame:
    """One row per document: the id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    mark = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    held = (mark % folds) == held_fold
    labelled = docs.where(docs[lang_col].isNotNull() & ~held).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), docs[id_col].alias("_id"))
    with scratch(spark):
        model = spark.sparkContext.broadcast(Model(train(sample(labelled, sample_rows))))
    slim = docs.select(docs[id_col].alias("_id"), held.alias("held_out"), docs[text_col].cast("string").alias("_text"))
    kind = pa.schema([(id_col, to_arrow_type(slim.schema["_id"].dataType)), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.value.predict
        for b in batches:
            said = predict(b["_text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["_id"], b["held_out"], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], schema=kind)

    return slim.mapInArrow(run, from_arrow_schema(kind))
