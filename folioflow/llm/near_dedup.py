"""Near-duplicate detection by improved consistent weighted sampling.

Documents are weighted sets of five-word shingles; a shingle weighs its count times an inverse
document frequency, which goes by the share of all documents that hold it: ``idf`` for shares of
``rare`` or less, 1 for a share of one, in proportion to the logarithm between. Shares are counted
over all documents, in ``2**df_bits`` buckets of the shingle's hash, so the table has a bound that
doesn't depend on the corpus; a bucket's share by chance (a document's shingles over the number of
buckets) is far below ``rare``, and neither it nor any weight changes as a corpus grows alike. ``idf``
is near 1, as the shared text of a large group of near copies is frequent, and what sets them apart
rare: with undamped weights (``log(documents / frequency)``) a group of a third of all documents of
plain similarity 0.9 would have one of 0.3 to 0.5.

1. Every document gets ``bands * rows`` consistent weighted samples. Identical texts collapse to
   one representative, by digest.
2. In every band's bucket, and in every pair of neighbouring bands' buckets, all members are paired
   with one centre, the one that meets most others in all its buckets (of several, that of the least
   id). So the pairs grow with the members, not with their square.
3. Pairs are verified: weighted Jaccard similarity of whole texts of ``threshold`` or more.
4. Verified links make classes, by contraction to smaller labels until nothing changes.
5. Buckets whose members are of several classes have pairs that no centre has settled. Their members
   are keyed anew by the shingles at the rare end of each text, so that every pair that is similar
   enough has a key in common and passes the bounds of its lengths (prefix filtering, which loses
   none). Pairs of different classes with a common key are verified, and classes are made again.

Defined cases: a null text is empty; texts are cut into words at ASCII white space and compared
without A-Z case; a text of fewer than five words is one shingle; identical texts are always one
class, and texts without a word, which have no shingle, are alike only if identical; a null id
ranks after all others; repeated rows are copies of each other, and rows of one id but several texts
belong to one class if both texts are representatives; a text of any length is compared in whole;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bounded_batches, materialise, scratch
from .fingerprints import hashed_words, mixed_hash, windows

SHINGLE = 5
#: Rows without an id get one of the last so many, by their text.
_NO_IDS = 1 << 40


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, one after the other, and how many each text has."""
    words, counts = hashed_words(texts, lower=True)
    if not len(words):
        return words, counts
    full = windows(words, size)
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    keep = np.zeros(len(words), dtype=bool)
    within = np.arange(len(words)) - np.repeat(starts, counts)
    keep[within < np.repeat(n, counts)] = True
    out = np.zeros(len(words), dtype=np.uint64)
    out[: len(full)] = full
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        out[starts[i]] = windows(words[starts[i] : ends[i]], int(counts[i]))[0]
    return out[keep], n


def weighted(hashes: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their weights, and how many each text has."""
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, of))
    h, of = hashes[order], of[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(h)))
    h = h[at]
    return h, times * idf[bucket(h, len(idf))], np.bincount(of[at], minlength=len(n))


def bucket(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


class Sampler:
    """Improved consistent weighted sampling, with its random variables drawn from a hash of (shingle, sample)."""

    def __init__(self, samples: int, seed: int = 11):
        self.keys = np.random.default_rng(seed).integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, n: np.ndarray) -> np.ndarray:
        """One row per text, one column per sample: the least value (upper half), a hash of its shingle and step (lower half)."""
        logs = np.log(weights).astype(np.float32)
        starts = np.cumsum(n) - n
        out = np.empty((len(n), len(self.keys)), dtype=np.int64)
        with np.errstate(over="ignore"):
            for j, key in enumerate(self.keys):
                h = mixed_hash(hashes * key + key)
                g = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                # Gamma(2, 1) is the sum of two exponentials.
                r = -np.log(_uniform(h, 40) * _uniform(h, 16))
                log_c = np.log(-np.log(_uniform(g, 40) * _uniform(g, 16)))
                beta = _uniform((h ^ g) * np.uint64(0xC4CEB9FE1A85EC53), 40)
                steps = np.floor(logs / r + beta)
                least = (log_c - r * (steps - beta + np.float32(1))).view(np.int32)
                least = (least ^ (least >> 31 & 0x7FFFFFFF)).astype(np.int64)  # in the order of the values
                step = steps.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                out[:, j] = np.minimum.reduceat(least << 32 | ((h + step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).view(np.int64), starts)
        return out.view(np.uint64)


def _uniform(h: np.ndarray, shift: int) -> np.ndarray:
    """24 bits of the hash, as a number above 0 and below 1."""
    return ((h >> np.uint64(shift) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)).clip(0.5, 2**24 - 1) * np.float32(2**-24)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(i) else 0.0


def document_frequencies(docs: DataFrame, bits: int) -> np.ndarray:
    """In how many documents each bucket of shingles occurs. ``docs`` has _text."""
    size, shard = 1 << bits, 1 << 10

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            hashes, n = shingles(b["_text"].tolist())
            pairs = np.unique(np.repeat(np.arange(len(n)), n) * size + bucket(hashes, size))
            total += np.bincount(pairs % size, minlength=size)
        for s in range(0, size, shard):
            if total[s : s + shard].any():
                yield pd.DataFrame({"s": [s], "n": [total[s : s + shard].astype("<i4").tobytes()]})

    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shard, dtype=np.int64)
        for b in parts:
            for n in b["n"]:
                total += np.frombuffer(n, "<i4")
        yield pd.DataFrame({"s": [key[0]], "n": [total.tobytes()]})

    out = np.zeros(size, dtype=np.int64)
    for r in docs.select("_text").mapInPandas(count, "s int, n binary").groupBy("s").applyInPandas(add, "s int, n binary").collect():
        out[r["s"] : r["s"] + shard] = np.frombuffer(r["n"], "<i8")
    return out


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    bands: int = 10,
    rows: int = 3,
    df_bits: int = 18,
    idf: float = 1.25,
    rare: float = 1 / 64,
) -> DataFrame:
    """One row per row of ``docs``: the id, rep_id, class_id (least id of the class), n_links of the representative, kept."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with scratch(spark):
        told = _classes(docs, id_col, text_col, threshold, bands, rows, df_bits, idf, rare)
    label = F.coalesce("label", "_rep")
    return told.select(
        F.col("_own").alias(id_col),
        _real("_rep").alias("rep_id"),
        _real(label).alias("class_id"),
        F.coalesce("_links", F.lit(0)).alias("n_links"),
        (F.col("_id") == label).alias("kept"),
    )


def idf_weights(df: np.ndarray, n_docs: int, idf: float, rare: float) -> np.ndarray:
    """What a shingle of each bucket weighs."""
    share = np.minimum(1.0, np.maximum(df, 1) / max(1, n_docs))
    return 1.0 + (idf - 1.0) * np.minimum(1.0, np.log(share) / math.log(rare))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int, df_bits: int, idf: float, rare: float) -> DataFrame:
    """_own, _id, _digest of every row, with _rep, label and _links of its text."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    order = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID) - F.pmod(F.xxhash64(text), F.lit(_NO_IDS)))
    slim = docs.select(docs[id_col].alias("_own"), order.alias("_id"), text.alias("_text"))
    df = document_frequencies(slim, df_bits)
    weights = spark.sparkContext.broadcast(idf_weights(df, slim.count(), idf, rare))
    sampler = spark.sparkContext.broadcast(Sampler(bands * rows))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes, n = shingles(b["_text"].tolist())
            some = n > 0
            h, w, n = weighted(hashes, n[some], weights.value)
            keys = np.zeros((len(b), bands), dtype=np.int64)
            if len(h):
                keys[some] = _bands(sampler.value(h, w, n), bands)
            yield b[["_id", "_digest"]].assign(_keys=[k.tolist() if s else [] for k, s in zip(keys, some)])

    signed = slim.select("_id", F.unhex(F.sha2("_text", 256)).alias("_digest"), "_text").mapInPandas(sign, "_id long, _digest binary, _keys array<long>")
    reps = materialise(signed.groupBy("_digest").agg(F.min("_id").alias("_rep"), F.first("_keys").alias("_keys")), "near-reps")
    pairs, member = candidates(reps)
    links = materialise(verified(slim, pairs, weights, threshold), "near-links")
    labels = components(links)
    more = materialise(verified(slim, unsettled(slim, reps, member, labels, weights, df_bits, threshold), weights, threshold), "near-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("_links"))
    known = reps.select("_digest", "_rep").join(labels.withColumnRenamed("id", "_rep"), "_rep", "left").join(degree.withColumnRenamed("a", "_rep"), "_rep", "left")
    known = materialise(known, "near-classes", keep=True)
    return slim.select("_own", "_id", F.unhex(F.sha2("_text", 256)).alias("_digest")).join(known, "_digest")


def _real(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c <= NO_ID - _NO_IDS, c)


def _bands(samples: np.ndarray, bands: int) -> np.ndarray:
    rows = samples.shape[1] // bands
    out = np.zeros((len(samples), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands):
            h = np.full(len(samples), k + 1, dtype=np.uint64)
            for j in range(rows):
                h = mixed_hash(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, k * rows + j])
            out[:, k] = h
    return out.view(np.int64)


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a, b: in each bucket, and in each bucket of two neighbouring bands, all members with the centre. And who is in which bucket of several."""
    n = F.size("_keys")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get("_keys", i), F.get("_keys", (i + 1) % n)))
    member = reps.where(n > 0).select("_rep", F.explode(F.concat("_keys", pairs)).alias("_key"))
    member = materialise(member, "near-buckets")
    # Tables of their own, so that Spark can split frequent buckets in the joins.
    sizes = materialise(member.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "near-sizes")
    # Joined by shuffle at every size, as each side grows with the input.
    met = member.join(sizes.hint("merge"), "_key")
    popular = met.groupBy("_rep").agg(F.sum("_n").alias("_p"))
    met = materialise(met.select("_rep", "_key").join(popular.hint("merge"), "_rep"), "near-members")
    centres = materialise(met.groupBy("_key").agg(F.max_by("_rep", F.struct("_p", -F.col("_rep"))).alias("_centre")), "near-centres")
    linked = met.join(centres.hint("merge"), "_key").where("_rep != _centre")
    return linked.select(F.least("_rep", "_centre").alias("a"), F.greatest("_rep", "_centre").alias("b"), F.col("_centre").alias("c")).groupBy("a", "b").agg(F.min("c").alias("c")), met.select("_key", "_rep")


def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``df`` with the _label of each _rep, which is its own where it has no link."""
    return df.join(labels.select(F.col("id").alias("_rep"), "label"), "_rep", "left").withColumn("_label", F.coalesce("label", "_rep")).drop("label")


def unsettled(slim: DataFrame, reps: DataFrame, member: DataFrame, labels: DataFrame, weights, df_bits: int, threshold: float) -> DataFrame:
    """Pairs a, b (and c, which is b) of different classes that may be similar enough, among members of buckets of several classes.

    Let a text's shingles be in one order for all texts, rare ones first. What a pair has in common
    is at most what either text weighs from the first common shingle on, and must be
    threshold / (1 + threshold) of both weights. So that shingle lies where a text has ``threshold``
    of its weight still to come, and, in the lighter text, 2 * threshold / (1 + threshold) of it.
    """
    least = 2 * threshold / (1 + threshold)
    told = labelled(member, labels)
    mixed = told.groupBy("_key").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi")).where("_lo != _hi").select("_key")
    rest = told.join(mixed.hint("merge"), "_key").select("_rep", "_label").distinct()
    rest = materialise(rest.join(reps.select("_rep", "_digest"), "_rep"), "near-rest")
    texts = slim.select(F.col("_id").alias("_rep"), "_text").join(rest, "_rep").where(F.unhex(F.sha2("_text", 256)) == F.col("_digest"))
    texts = materialise(texts.dropDuplicates(["_rep", "_digest"]).select("_rep", "_label", "_text"), "near-rest-texts")
    df = slim.sparkSession.sparkContext.broadcast(document_frequencies(texts, df_bits))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes, n = shingles(b["_text"].tolist())
            h, w, n = weighted(hashes, n, weights.value)
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, df.value[bucket(h, len(df.value))], of))
            h, w = h[order], w[order]
            total = np.bincount(of, w, minlength=len(n))
            before = np.cumsum(w) - w
            before -= np.repeat(before[np.cumsum(n) - n], n)
            left = total[of] - before
            at = np.flatnonzero(left >= threshold * total[of] * (1 - 1e-9))
            yield pd.DataFrame({"_shingle": h[at].view(np.int64), "_rep": b["_rep"].to_numpy()[of[at]], "_label": b["_label"].to_numpy()[of[at]], "_all": total[of[at]], "_left": left[at]})

    keys = materialise(texts.mapInPandas(keyed, "_shingle long, _rep long, _label long, _all double, _left double"), "near-keys")
    # Of a shingle's classes the largest is met by the others, and not by itself.
    early = F.col("_left") >= F.lit(least * (1 - 1e-9)) * F.col("_all")
    by_class = keys.groupBy("_shingle", "_label").agg(F.count(F.lit(1)).alias("_n"), F.max(early).alias("_e"))
    shared = by_class.groupBy("_shingle").agg(F.count(F.lit(1)).alias("_classes"), F.max("_e").alias("_e"), F.max_by("_label", F.struct("_n", "_label")).alias("_most"))
    met = materialise(keys.join(shared.where("_classes > 1 and _e").select("_shingle", "_most").hint("merge"), "_shingle").withColumn("_early", early), "near-met")
    x = met.where("_label != _most").select("_shingle", *[F.col(c).alias(c + "_x") for c in ("_rep", "_label", "_all", "_left", "_early")])
    y = met
    close = (
        (F.col("_label") != F.col("_label_x"))
        & ((F.col("_label") == F.col("_most")) | (F.col("_rep") < F.col("_rep_x")))
        & (F.least("_left", "_left_x") >= F.lit(least / 2 * (1 - 1e-9)) * (F.col("_all") + F.col("_all_x")))
    )
    # One of the two is early, so shingles that come late in all texts pair none.
    first = x.where("_early_x").join(y.hint("merge"), "_shingle").where(close)
    second = x.where("not _early_x").join(y.where("_early").hint("merge"), "_shingle").where(close)
    a, b = F.least("_rep", "_rep_x").alias("a"), F.greatest("_rep", "_rep_x").alias("b")
    return first.select(a, b).unionByName(second.select(a, b)).distinct().withColumn("c", F.col("b"))


def verified(slim: DataFrame, pairs: DataFrame, weights, threshold: float) -> DataFrame:
    """The pairs whose texts are similar enough, with their similarity."""
    texts = slim.select("_id", "_text")
    other = F.when(F.col("a") == F.col("c"), F.col("b")).otherwise(F.col("a"))
    # The texts of the members first, each of them few times; the centre's text comes last.
    one = pairs.withColumn("_o", other).hint("merge").join(texts.select(F.col("_id").alias("_o"), F.col("_text").alias("_x")), "_o")
    both = one.join(texts.select(F.col("_id").alias("c"), F.col("_text").alias("_y")), "c").select("a", "b", "_x", "_y")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = pd.unique(pd.concat([b["_x"], b["_y"]]))
            sets = {}
            for at in range(0, len(texts), 100):
                some = list(texts[at : at + 100])
                hashes, n = shingles(some)
                h, w, n = weighted(hashes, n, weights.value)
                ends = np.cumsum(n)
                sets |= {t: (h[e - k : e], w[e - k : e]) for t, e, k in zip(some, ends, n)}
            like = np.array([similarity(sets[x], sets[y]) for x, y in zip(b["_x"], b["_y"])])
            yield b[["a", "b"]].assign(similarity=like)[like >= threshold]

    return both.mapInPandas(check, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """id, label (least id of its component) of every linked id, by alternating large and small stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "near-stars")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        small = materialise(small, "near-stars")
        same = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if same:
            break
    else:
        raise RuntimeError("the classes did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def keep_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    bands: int = 10,
    rows: int = 3,
    df_bits: int = 18,
    idf: float = 1.25,
    rare: float = 1 / 64,
) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class.

    Of each class the rows of the least id and its text stay, so repeated rows of it all do; so does,
    of a class without any id, the row whose text ranks first. Only ids and digests of rows that go
    are joined to the texts.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        told = _classes(docs, id_col, text_col, threshold, bands, rows, df_bits, idf, rare)
        gone = told.where(F.col("_id") != F.coalesce("label", "_rep")).select(F.col("_own").alias("_gone"), F.col("_digest").alias("_d")).distinct()
        gone = materialise(gone, "near-gone", keep=True)
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("_gone")) & (digest == F.col("_d")), "left_anti")
