"""Periodic runs of words, by Lyndon arrays in the manner of Ellert and Fischer.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
keeping that period. Words are only ever compared (equal, or less and greater by their bytes): there
are no suffix arrays, trees or automata, and no hashes.

1. For one order of the words and for its reverse, :func:`lyndon_edges` finds the next smaller suffix
   of every position, from left to right along the chain of previous smaller suffixes. What two suffixes have
   in common is known from the links of the chain but where both of its links are equally long; then
   it is extended by comparing words, and only there.
2. The stretch that was matched furthest right is kept with its distance. A pair of positions inside
   it lies over an earlier pair at that distance, whose extension was stored with its link and is
   taken over; words are compared only beyond the stretch. So repeated words, loops and nested loops
   cost a bounded number of comparisons a word, which the tests count.
3. By the runs theorem every run shows up in one of the two orders: the longest Lyndon word at the
   first of its roots has the run's period as its length, and its extension reaches the run's end. What is
   left is to go back from that root, by less than a period.

Texts are independent, so nothing is shuffled: a batch of whole texts at a time, of bounded bytes.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a text of any
length is read in whole, in memory and time linear in its words; of equally long runs the longest of
least start, then least period is named; repeated rows and null ids have results of their own; an
empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import WORD, bounded_batches

#: Least words of a run, and least periods.
LEAST, TIMES = 6, 4


def lyndon_edges(w: Sequence, falling: bool = False, factor: int = 1) -> list[tuple[int, int, int]]:
    """(i, j, n): j starts the next smaller suffix after i, and n words from i on equal those from j on, if n > factor * (j - i).

    ``falling`` reverses the order of the words; the end of the text is less than any word.
    """
    n = len(w)
    found: list[tuple[int, int, int]] = []
    after, before = [n] * n, [-1] * n  # next and previous smaller suffix
    with_after, with_before = [0] * n, [0] * n  # words in common with it
    at = right = gap = 0  # w[at:right] equals what lies gap words before it
    for i in range(1, n):
        c = w[i]
        j = i - 1
        while j >= 0:
            v = w[j]
            if v != c:
                if (v < c) is not falling:
                    before[i] = j
                    break
                # Suffix i is less than suffix j, and than those that begin as suffix j does.
                after[j] = i
                k, j = with_before[j], before[j]
                while k and j >= 0:
                    after[j] = i
                    k, j = with_before[j], before[j]
                continue
            # From here on whatever is met begins with the same word.
            k = 0
            while j >= 0:
                # k words from j on equal those from i on; how many more?
                m = k
                if i + m < right and j >= at:
                    a, b = j - gap, i - gap
                    known = with_after[a] if after[a] == b else with_before[b] if before[b] == a else -1
                    if known >= 0:
                        m = min(known, right - i)
                x, y = i + m, j + m
                while x < n and w[x] == w[y]:
                    x += 1
                    y += 1
                m = x - i
                if x > right:
                    right, at, gap = x, i, i - j
                if x < n and (w[y] < w[x]) is not falling:
                    before[i], with_before[i] = j, m
                    break
                after[j], with_after[j] = i, m
                if m > factor * (i - j):
                    found.append((j, i, m))
                # What comes before j has k words in common with it, and is less.
                k, j = with_before[j], before[j]
                while j >= 0 and k > m:  # so it has m in common with i, too, and differs from i where j does
                    after[j], with_after[j] = i, m
                    if m > factor * (i - j):
                        found.append((j, i, m))
                    k, j = with_before[j], before[j]
                if j >= 0 and k < m:  # it has k in common with i, too, and is less
                    before[i], with_before[i] = j, k
                    break
            break
    return found


def runs(w: Sequence, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``times`` periods (two or more), by start, then period."""
    found = set()
    for falling in (False, True):
        # With less than a period before its first root, a run has more than times - 2 periods in common from there.
        edges = lyndon_edges(w, falling, times - 2)
        roots = {(i, j) for i, j, n in edges if n >= j - i}
        for i, j, n in edges:
            period = j - i
            if (i - period, i) in roots:
                continue  # not the first root of its run
            start = i
            while start > 0 and w[start - 1] == w[start - 1 + period]:
                start -= 1
            length = j + n - start
            if length >= max(least, times * period):
                found.add((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence, found: list[tuple[int, int, int]]) -> list:
    """The words that stay: of every run its first period."""
    if not found:
        return list(words)
    gone = bytearray(len(words))
    for start, length, period in found:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: the id, n_words, runs (start, length, period of each, by start, then period), collapsed_text (kept words joined by one space)."""
    bounded_batches(docs.sparkSession)
    text = docs[text_col] if isinstance(text_col, str) else text_col
    slim = docs.select(docs[id_col].alias("_id"), text.cast("string").cast("binary").alias("_text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.schema([(id_col, to_arrow_type(slim.schema["_id"].dataType)), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed_text", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, all_runs, kept = [], [], []
            for raw in b["_text"].to_pylist():
                words = (raw or b"").split()  # at ASCII white space
                found = runs(words, least, times)
                n.append(len(words))
                all_runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                kept.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(n, pa.int64()), pa.array(all_runs, kind.field("runs").type), pa.array(kept, pa.string())], schema=kind)

    return slim.mapInArrow(each, from_arrow_schema(kind))


def looped(id_col: Column, text: Column) -> Column:
    """The text with loops planted by id: fixed by the contract of op12. A null id plants none."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
    told = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(told, " ")).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of op12: counts, the longest run, checksums of all runs and of the collapsed text."""
    named = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(named)
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
