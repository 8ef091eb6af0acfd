"""Ranked lexical search by MaxScore, shard by shard.

A document's score for an item is the sum, over the item's terms with repeats, of the term's weight
times a saturated share of its occurrences, in integers (see :func:`weight` and :func:`impacts`).

1. Items are taken in blocks of bounded bytes, so that a block's terms are all that a task holds of the
   items, however many there are. Each block is one pass over the documents.
2. Documents become rows of postings: their number of terms, and the block's terms that they hold with
   their occurrences. Frequencies are added up from these rows, within each task first, by term of the block.
3. Postings are gathered into shards of bounded size: lists by term with the greatest impact of each.
   For every item the lists are ranked by upper bounds. From the greatest down they are essential:
   all their documents are scored, until what is left can't lift an unseen document to the least
   of the best ``k`` so far. The rest is non-essential, and is only probed, by binary search, for documents
   that can still qualify. The least score carries over to the next shard of a task.
4. The best ``k`` of each shard are ranked over all shards; Spark limits them on both sides of the shuffle.

Defined cases: a null or empty text has no terms and ranks nowhere; an item without terms, or none of
whose terms occur, has no rows; a text of any length is read in whole; equal scores rank by ascending
id, null ids last; repeated rows rank each by itself, and so do repeated items, whose ranks then
are told apart by nothing else; empty tables give an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, materialise, scratch

#: Bytes that are no part of a term become spaces, A-Z small letters; every byte above 127 is part of a character that is.
_TERMS = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: How many best documents, and what bounds a block of items and a shard.
BEST, BLOCK_BYTES, SHARD_POSTINGS, SHARD_DOCS = 20, 4 << 20, 1 << 20, 1 << 14


def terms(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    """A term's weight: fixed by the contract of op13."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied with, by its occurrences and the document's size: fixed by the contract of op13."""
    m = 100 - 25 + (25 * size * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Block:
    """Items whose terms a task can hold: their ids, term numbers and repeats."""

    def __init__(self) -> None:
        self.ids: list = []
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        self.terms: dict[bytes, int] = {}

    def add(self, item, text: bytes) -> None:
        said = Counter(terms(text))
        self.ids.append(item)
        self.items.append((np.array([self.terms.setdefault(t, len(self.terms)) for t in said], dtype=np.int64), np.array(list(said.values()), dtype=np.int64)))


def blocks(items: DataFrame, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of at most ``block_bytes`` of text, or of one longer item. ``items`` has _item, _text."""
    block, size = Block(), 0
    for r in items.toLocalIterator():
        raw = bytes(r["_text"] or b"")
        if block.ids and size + len(raw) > block_bytes:
            yield block
            block, size = Block(), 0
        block.add(r["_item"], raw)
        size += len(raw) + 64
    if block.ids:
        yield block


class Shard:
    """Postings by term: places of documents, ascending, with impacts."""

    def __init__(self, ids: pa.Array, at: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        self.ids = ids.take(pa.array(order))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[at], term))
        term = term[by]
        self.place, self.impact = place[at][by], impact[by]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
        top = np.maximum.reduceat(self.impact, first) if len(first) else first
        self.lists = {t: (a, b, m) for t, a, b, m in zip(term[first].tolist(), first.tolist(), [*first[1:].tolist(), len(term)], top.tolist())}

    def best(self, item: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best ``k`` documents that score ``least`` or more, and the least score that the best ``k`` now have."""
        held = [(w * self.lists[t][2], w, *self.lists[t][:2]) for t, w in zip(item.tolist(), weights.tolist()) if w > 0 and t in self.lists]
        held.sort()
        bound = np.cumsum([h[0] for h in held])  # what the lists up to here can add
        total = np.zeros(len(self.ids), dtype=np.int64)
        deep = len(total) >= k
        left = len(held)
        while left and bound[left - 1] >= least:
            left -= 1
            _, w, a, b = held[left]
            total[self.place[a:b]] += w * self.impact[a:b]
            if deep and left:
                least = max(least, int(np.partition(total, len(total) - k)[len(total) - k]))
        found = np.flatnonzero(total)
        while left:
            found = found[total[found] + bound[left - 1] >= least]
            left -= 1
            _, w, a, b = held[left]
            at = a + np.searchsorted(self.place[a:b], found)
            hit = np.flatnonzero(at < b)
            hit = hit[self.place[at[hit]] == found[hit]]
            total[found[hit]] += w * self.impact[at[hit]]
        found = found[total[found] >= max(least, 1)]
        found = found[np.lexsort((found, -total[found]))[:k]]
        scores = total[found]
        return found, scores, max(least, int(scores[-1])) if len(found) == k else least


def postings(slim: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """_id, size (terms with repeats), terms, times, of documents with any term. ``slim`` has _id, _text."""
    held = slim.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items
    kind = pa.schema([("_id", to_arrow_type(slim.schema["_id"].dataType)), ("size", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for b in batches:
            size, which, times = [], [], []
            for raw in b["_text"].to_pylist():
                said = terms(raw)
                known = np.fromiter((i for t in said if (i := number(t)) is not None), dtype=np.int32)
                ids, n = np.unique(known, return_counts=True)
                size.append(len(said))
                which.append(ids)
                times.append(n.astype(np.int32))
            made = pa.RecordBatch.from_arrays([b["_id"], pa.array(size, pa.int64()), pa.array(which, kind.field("terms").type), pa.array(times, kind.field("times").type)], schema=kind)
            yield made.filter(pc.greater(made["size"], 0))

    return slim.mapInArrow(run, from_arrow_schema(kind))


def frequencies(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and in how many documents each of the block's terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms + 2, dtype=np.int64)
        for b in batches:
            sums[:n_terms] += np.bincount(b["terms"].flatten().to_numpy(), minlength=n_terms)
            sums[n_terms:] += (b.num_rows, pc.sum(b["size"]).as_py() or 0)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "n"])

    told = held.select("size", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(n_terms + 2, dtype=np.int64)  # as many as a block's terms, whatever the documents
    sums[told["term"].to_numpy()] = told["n"].to_numpy()
    return int(sums[-2]), int(sums[-1]), sums[:-2]


def _sharded(batches: Iterator[pa.RecordBatch], shard_postings: int, shard_docs: int) -> Iterator[pa.Table]:
    """Rows of postings, up to the bounds of a shard at a time, or one row beyond."""
    held: list[pa.RecordBatch] = []
    docs = size = 0
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b["terms"]).to_numpy())
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            n = min(b.num_rows - at, max(0, shard_docs - docs), max(0, int(np.searchsorted(ends, done + shard_postings - size, side="right")) - at))
            if not n and not docs:
                n = 1
            if n:
                held.append(b.slice(at, n))
                docs += n
                size += int(ends[at + n - 1]) - done
                at += n
            else:
                yield pa.Table.from_batches(held)
                held, docs, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def ranked_in_shards(held: DataFrame, block: Block, k: int, shard_postings: int, shard_docs: int) -> DataFrame:
    """_item (its number in the block), _id, score: the best of every shard."""
    n_docs, n_terms, df = frequencies(held, len(block.terms))
    each = np.array([weight(n_docs, int(d)) for d in df], dtype=np.int64)
    items = held.sparkSession.sparkContext.broadcast([(t, n * each[t]) for t, n in block.items])
    kind = pa.schema([("_item", pa.int64()), ("_id", to_arrow_type(held.schema["_id"].dataType)), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [1] * len(items.value)
        for rows in _sharded(batches, shard_postings, shard_docs):
            rows = rows.combine_chunks()
            many = pc.list_value_length(rows["terms"]).to_numpy()
            at = np.repeat(np.arange(len(many)), many)
            tf = pc.list_flatten(rows["times"]).to_numpy().astype(np.int64)
            impact = impacts(tf, rows["size"].to_numpy()[at], n_docs, n_terms)
            ids = rows["_id"].combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            shard = Shard(ids, at, pc.list_flatten(rows["terms"]).to_numpy(), impact)
            number, places, scores = [], [], []
            for i, (which, weights) in enumerate(items.value):
                found, score, least[i] = shard.best(which, weights, k, least[i])
                number.append(np.full(len(found), i))
                places.append(found)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number), pa.int64()), shard.ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], schema=kind)

    return held.mapInArrow(run, from_arrow_schema(kind))


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The best ``k`` documents of every item: the item's id, rank (from 1), the document's id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").cast("binary").alias("_text"))
    asked = items.select(items[item_col].alias("_item"), items[item_text_col].cast("string").cast("binary").alias("_text"))
    named = StructType([StructField("_item", LongType(), False), StructField("_own", asked.schema["_item"].dataType)])
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"))
    found = None
    for block in blocks(asked, block_bytes):
        with scratch(spark):
            rows = materialise(postings(slim, block.terms), "lexical-postings")
            told = ranked_in_shards(rows, block, k, shard_postings, shard_docs)
            told = told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            told = materialise(told.join(F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), named)), "_item"), "lexical-ranked", keep=True)
        told = told.select(F.col("_own").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
        found = told if found is None else found.unionByName(told)
    if found is None:
        kind = StructType([StructField(item_col, named["_own"].dataType), *StructType.fromDDL("rank int"), StructField(id_col, slim.schema["_id"].dataType), StructField("score", LongType())])
        return spark.createDataFrame([], kind)
    return found
