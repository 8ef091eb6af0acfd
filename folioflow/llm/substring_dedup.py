"""Substring deduplication by suffix automata of reference shards.

A window is ``length`` consecutive words of a document; a word goes if a window that covers it also
occurs in a document with a smaller id. Documents are streamed through suffix automata of reference
passages, whose matching statistics (the longest match that ends at each word, and the least id it
occurs under) tell the maximal spans to remove; words are compared, not hashes.

What keeps this from comparing every document with every shard:

1. Every window has an anchor, its run of ``anchor`` words of least hash; a document's anchors are
   few. Only windows whose anchor occurs in two documents or more are looked at further (regions).
2. Windows of regions are hashed and added up by hash: their first document and position. Windows
   of two documents or more make the reference, each under its first document.
3. Regions are dealt into blocks by document, and each block receives, as its own shard, the
   reference pieces that hold first occurrences of its windows, and no others. A piece that many
   blocks need is sent to each once; no block grows with how often a passage occurs.
4. In each block an automaton is built over the shard, and the block's regions are streamed.

Hashes only choose what a block gets to see. Sums run on the map side first, so a passage that a
third of all documents hold is counted without gathering its occurrences.

Documents are told apart by id and a 64-bit hash of id and text.

Defined cases: a null text has no words; a text of any length is read in whole; a null id ranks after
all others, and such documents don't count as earlier than each other; rows that share an id never remove words from each other (so
repeated rows have equal results); further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import NO_ID, WORD, bounded_batches, materialise, partitions, scratch
from .fingerprints import hashed_words, windows

_WORDS = re.compile(WORD).findall
LENGTH, ANCHOR, PIECE = 50, 10, 64


def _sliding(a: np.ndarray, size: int, least: bool) -> np.ndarray:
    """Least or greatest of every run of ``size`` values, by doubling."""
    pick = np.minimum if least else np.maximum
    done = 1
    while done < size:
        step = min(done, size - done)
        a = pick(a[:-step], a[step:])
        done += step
    return a


class Batch:
    """Anchors and windows of a batch of texts."""

    def __init__(self, texts: list[str | None], length: int, anchor: int):
        self.length, self.anchor = length, anchor
        self.words, self.counts = hashed_words(texts)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        self.of = np.repeat(np.arange(len(self.counts)), self.counts)
        n = len(self.words)
        self.any = n >= length
        if not self.any:
            return
        self.grams = windows(self.words, anchor)
        self.whole = self.of[: n - length + 1] == self.of[length - 1 :]  # windows inside one text
        self.least = _sliding(self.grams, length - anchor + 1, True)

    def anchors(self) -> np.ndarray:
        """Positions of the runs that are the least of some window."""
        if not self.any:
            return np.zeros(0, dtype=np.int64)
        wide = self.length - self.anchor
        told = np.zeros(len(self.least) + 2 * wide, dtype=np.uint64)
        held = np.zeros(len(told), dtype=bool)
        told[wide : wide + len(self.least)] = np.where(self.whole, self.least, 0)
        held[wide : wide + len(self.least)] = self.whole
        most = _sliding(told, wide + 1, False)  # over the windows that hold each run
        some = _sliding(held, wide + 1, False)
        return np.flatnonzero(some & (most == self.grams))

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Which windows have their anchor at one of the positions ``at``."""
        marked = np.full(len(self.grams), np.iinfo(np.uint64).max, dtype=np.uint64)
        marked[at] = self.grams[at]
        return self.whole & (_sliding(marked, self.length - self.anchor + 1, True) == self.least)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


class Automaton:
    """The suffix automaton of several passages of words, each under a document's id."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.least = [NO_ID]

    def add(self, words: list[str], doc: int) -> None:
        nxt, link, length, least = self.next, self.link, self.len, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q  # the passage goes along one that is known
                least[q] = min(least[q], doc)
                continue
            if q is not None:
                last = self._split(last, w, q)
                least[last] = min(least[last], doc)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            least.append(doc)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w: str, q: int) -> int:
        nxt, link = self.next, self.link
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        self.least.append(NO_ID)
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """A state occurs wherever those do that link to it."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def spans(self, words: list[str], doc: int, size: int) -> list[tuple[int, int]]:
        """Maximal spans (first word, words) covered by windows of ``size`` words that occur under a smaller id."""
        nxt, link, length, least = self.next, self.link, self.len, self.least
        out: list[list[int]] = []
        state = match = 0
        for i, w in enumerate(words):
            q = nxt[state].get(w)
            while q is None and state:
                state = link[state]
                match = length[state]
                q = nxt[state].get(w)
            if q is None:
                continue
            state = q
            match += 1
            if match >= size:
                while length[link[state]] >= size:  # the window itself occurs where its shortest state does
                    state = link[state]
                    match = length[state]
                if least[state] < doc:
                    if out and i - size + 1 <= out[-1][1]:
                        out[-1][1] = i + 1
                    else:
                        out.append([i - size + 1, i + 1])
        return [(a, b - a) for a, b in out]


def removed_spans(slim: DataFrame, length: int, anchor: int) -> DataFrame:
    """_id, _k, _spans: the spans of words to remove, of the documents that have any. ``slim`` has _id, _k, _text."""
    spark = slim.sparkSession

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = Batch(b["_text"].tolist(), length, anchor)
            at = found.anchors()
            of = found.of[at] if len(at) else at
            yield pd.DataFrame({"_a": found.grams[at].view(np.int64) if len(at) else at, "_id": b["_id"].to_numpy()[of], "_k": b["_k"].to_numpy()[of], "_p": (at - found.starts[of]).astype(np.int32)})

    marks = materialise(slim.mapInPandas(anchors, "_a long, _id long, _k long, _p int"), "substring-anchors")
    shared = marks.groupBy("_a").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo < _hi").select("_a")
    shared = materialise(shared, "substring-shared")  # a table of its own, so that Spark can split frequent anchors in the join
    held = materialise(marks.join(shared, "_a").groupBy("_id", "_k").agg(F.collect_set("_p").alias("_at")), "substring-held")

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["_text"].tolist()
            found = Batch(texts, length, anchor)
            rows = []
            if found.any:
                at = np.concatenate([found.starts[i] + np.asarray(p, dtype=np.int64) for i, p in enumerate(b["_at"])])
                first, n = runs(found.covered(at))
                cut: dict[int, list[str]] = {}
                for f, k in zip(first.tolist(), n.tolist()):
                    # Windows inside a text never run over into the next text's, as the last ones are none.
                    i = int(found.of[f])
                    if i not in cut:
                        cut = {i: _WORDS(texts[i])}
                    s = f - int(found.starts[i])
                    rows.append((b["_id"].iloc[i], b["_k"].iloc[i], s, " ".join(cut[i][s : s + k + length - 1])))
            yield pd.DataFrame(rows, columns=["_id", "_k", "_s", "_text"]).astype({"_id": "int64", "_k": "int64", "_s": "int64"})

    region = slim.join(held, ["_id", "_k"]).mapInPandas(regions, "_id long, _k long, _s long, _text string")
    region = materialise(region, "substring-regions")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, counts = hashed_words(b["_text"].tolist())
            if not len(words):
                continue
            full = windows(words, length)
            ends = np.cumsum(counts)
            within = np.arange(len(full)) - np.repeat(ends - counts, counts)[: len(full)]
            of = np.repeat(np.arange(len(counts)), counts)[: len(full)]
            ok = within <= counts[of] - length
            of = of[ok]
            yield pd.DataFrame({"_w": full[ok].view(np.int64), "_id": b["_id"].to_numpy()[of], "_k": b["_k"].to_numpy()[of], "_s": b["_s"].to_numpy()[of] + within[ok]})

    seen = region.mapInPandas(hashed, "_w long, _id long, _k long, _s long")
    firsts = seen.groupBy("_w").agg(F.min(F.struct("_id", "_s")).alias("_f"), F.max("_id").alias("_hi")).where("_f._id < _hi")
    firsts = materialise(firsts.select("_w", F.col("_f._id").alias("_first"), F.floor(F.col("_f._s") / PIECE).alias("_g")), "substring-firsts")
    # A block streams about 1 MB of regions, so that its automaton stays small.
    blocks = max(partitions(spark), -(-(region.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0]) // (1 << 20)))
    block = F.pmod(F.xxhash64("_id", "_k"), F.lit(blocks)).cast("int")
    wanted = seen.join(firsts, "_w").where("_first < _id").select(block.alias("_b"), "_first", "_g").distinct()
    wanted = materialise(wanted, "substring-wanted")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pieces of regions on a grid of window positions, each with all words of its windows."""
        for b in batches:
            rows = []
            for doc, s, text in zip(b["_id"], b["_s"], b["_text"]):
                words = text.split(" ")
                last = s + len(words) - length
                for g in range(s // PIECE, last // PIECE + 1):
                    lo, hi = max(s, g * PIECE), min(last, g * PIECE + PIECE - 1)
                    rows.append((doc, g, " ".join(words[lo - s : hi - s + length])))
            yield pd.DataFrame(rows, columns=["_d", "_g", "_text"]).astype({"_d": "int64", "_g": "int64"})

    leading = region.join(wanted.select(F.col("_first").alias("_id")).distinct(), "_id", "left_semi")
    piece = leading.select("_id", "_s", "_text").mapInPandas(pieces, "_d long, _g long, _text string").withColumnRenamed("_g", "_pg")
    shard = wanted.join(piece, (F.col("_first") == F.col("_d")) & (F.col("_g") == F.col("_pg"))).select(F.col("_b").alias("_sb"), "_d", "_text")

    def stream(key: tuple, own: pd.DataFrame, reference: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(reference):
            automaton = Automaton()
            for doc, text in zip(reference["_d"], reference["_text"]):
                automaton.add(text.split(" "), doc)
            automaton.finish()
            for doc, k, s, text in zip(own["_id"], own["_k"], own["_s"], own["_text"]):
                out += [(doc, k, s + a, n) for a, n in automaton.spans(text.split(" "), doc, length)]
        return pd.DataFrame(out, columns=["_id", "_k", "start", "length"]).astype("int64")

    dealt = region.withColumn("_b", block)
    spans = dealt.groupBy("_b").cogroup(shard.groupBy("_sb")).applyInPandas(stream, "_id long, _k long, start long, length long")
    return spans.groupBy("_id", "_k").agg(F.collect_set(F.struct("start", "length")).alias("_spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: the id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    order = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    slim = docs.select(docs[id_col].alias("_own"), order.alias("_id"), F.xxhash64(order, docs[text_col]).alias("_k"), docs[text_col].cast("string").alias("_text"))
    with scratch(spark):
        spans = materialise(removed_spans(slim.drop("_own"), length, anchor), "substring-spans", keep=True)
    # Joined by shuffle at every size: how many documents have spans grows with the input.
    told = slim.join(spans.hint("merge"), ["_id", "_k"], "left").select("_own", "_text", "_spans")
    kind = pa.schema([(id_col, to_arrow_type(told.schema["_own"].dataType)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_kept, kept = [], [], []
            for text, spans in zip(b["_text"].to_pylist(), b["_spans"].to_pylist()):
                words = _WORDS(text or "")
                n_words.append(len(words))
                if spans:
                    stays = np.ones(len(words), dtype=bool)
                    for x in spans:
                        stays[x["start"] : x["start"] + x["length"]] = False
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_kept.append(len(words))
                kept.append(" ".join(words))
            gone = [n - k for n, k in zip(n_words, n_kept)]
            yield pa.RecordBatch.from_arrays([b["_own"], *[pa.array(v, f.type) for v, f in zip((n_words, gone, kept), list(kind)[1:])]], schema=kind)

    return told.mapInArrow(keep, from_arrow_schema(kind))
