"""Quality rules with verdicts on hosts.

Rules are measured on each document, over its whole text. Failures of each rule are then added up
by host, and a host's failure rate is shrunk by a beta prior that is fitted to all hosts. The fit takes
off what the hosts' rates differ by chance alone: of the spread of the rates, weighted by documents, what
equal hosts of these sizes would show is subtracted, and only the rest is a difference of hosts
(the correlation within hosts, by moments). Two verdicts follow, both relative to the corpus' own rate of
a rule, and both only where the host's rate is beyond the limit by ``sure`` standard deviations of its
posterior, so that few documents alone judge no host, and chance no large one:

* a host is rejected with all its documents if its odds of failing a rule are over ``host_odds`` times
  the corpus', and its rate over ``host_least``;
* a host is held to a soft rule, and its documents that fail it go, if its rate is over ``strict`` times
  the corpus'. Elsewhere a soft failure alone rejects nothing.

Documents that fail a base rule themselves are rejected wherever they come from. Where hosts don't
differ beyond chance, no host is judged, whatever their sizes.

Defined cases: a null text has no words, and so fails; a text of any length is read in whole; a null
host is a host of its own; a null id and repeated rows are rows like others; further columns are
passed on by :func:`judge_rows`; an empty table gives an empty result. With fewer than two hosts, or
hosts that don't differ beyond chance, the prior has ``most_prior`` pseudo-documents, and it never has fewer than
``least_prior``; a rate equal to a limit is within it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, bounded_batches, materialise

_WORDS = re.compile(WORD).findall
#: Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rules that count only against documents of hosts that are held to them.
SOFT = ["symbols", "repeated_lines", "word_length"]


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = _WORDS(text)
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif _WORDS(line):
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([counts_of(t) for t in texts], columns=COUNTS, dtype="int64")


def rules(c: Column) -> dict[str, Column]:
    """Failures of each rule, from a struct of counts; the first two are the base rules."""
    n = c["n_words"]
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * c["n_symbols"] > n,
        "repeated_lines": 20 * c["n_dup_lines"] > n,
        "word_length": (c["word_chars"] < 2 * n) | (c["word_chars"] > 15 * n),
    }


def prior_of(failed: float, n: int, hosts: int, squares: float, spread: float, least_prior: float, most_prior: float) -> float:
    """The prior's pseudo-documents, from the failures, the documents, the hosts, the sums over hosts of squared documents and of squared failures by documents."""
    mean = failed / max(1, n)
    noise, room = mean * (1 - mean), n - hosts - squares / max(1, n) + 1
    if noise <= 0 or room <= 0:
        return most_prior
    alike = ((spread - failed * mean) / noise - (hosts - 1)) / room  # how much more than chance rows of one host are alike
    return min(max(1 / alike - 1, least_prior), most_prior) if alike > 0 else most_prior


def host_verdicts(counted: DataFrame, host_odds: float, host_least: float, strict: float, sure: float, least_prior: float = 10.0, most_prior: float = 1000.0) -> DataFrame:
    """One row per host that is judged: _bad (the host), _all (rejected as a whole), and the soft rules it is held to. ``counted`` has _host, _c."""
    fails = {k: F.sum(v.cast("long")).alias(k) for k, v in rules(F.col("_c")).items()}
    hosts = materialise(counted.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *fails.values()), "quality-hosts")
    over = hosts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count(F.lit(1)).alias("hosts"),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("squares"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in fails],
        *[F.coalesce(F.sum(F.col(k).cast("double") * F.col(k) / F.col("n")), F.lit(0.0)).alias(f"{k}_spread") for k in fails],
    ).first()
    whole, held = F.lit(False), {}
    for k in fails:
        mean = over[k] / max(1, over["n"])
        prior = prior_of(over[k], over["n"], over["hosts"], over["squares"], over[f"{k}_spread"], least_prior, most_prior)
        rate = (F.col(k) + mean * prior) / (F.col("n") + prior)
        surely = rate - sure * F.sqrt(rate * (1 - rate) / (F.col("n") + prior + 1))
        whole = whole | (surely > max(host_least, host_odds * mean / (1 - mean + host_odds * mean)))
        if k in SOFT:
            held[k] = surely > strict * mean
    told = hosts.select(F.col("_host").alias("_bad"), whole.alias("_all"), *[v.alias(f"_{k}") for k, v in held.items()])
    return told.where(F.col("_all") | F.greatest(*[F.col(f"_{k}") for k in SOFT]))


def judge_rows(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    host_odds: float = 20.0,
    host_least: float = 0.25,
    strict: float = 1.25,
    sure: float = 3.0,
    broadcast_rows: int = 50_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row (the columns ``keep``, or all), counts, base_failed, host_rejected (the host's verdict on it), kept."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.struct(*(keep or docs.columns)).alias("row"), docs[host_col].cast("string").alias("_host"), text_counts(docs[text_col].cast("string")).alias("_c"))
    counted = materialise(counted, "quality-counts")
    judged = materialise(host_verdicts(counted, host_odds, host_least, strict, sure), "quality-judged")
    if judged.count() <= broadcast_rows:  # checked; else Spark joins by shuffle, and splits frequent hosts
        judged = F.broadcast(judged)
    failed = rules(F.col("_c"))
    base = failed["few_words"] | failed["repeats"]
    told = counted.join(judged, F.col("_host").eqNullSafe(F.col("_bad")), "left")
    host = F.coalesce("_all", F.lit(False))
    for k in SOFT:
        host = host | (F.coalesce(f"_{k}", F.lit(False)) & failed[k])
    return told.select("row", F.col("_c").alias("counts"), base.alias("base_failed"), host.alias("host_rejected"), (~base & ~host).alias("kept"))


def keep_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that pass."""
    return judge_rows(docs, **how).where("kept").select("row.*")
