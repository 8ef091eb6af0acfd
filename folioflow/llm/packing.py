"""Mixture-controlled packing of token sequences by deficit round-robin.

Every source has a queue of its documents' ids. In every round each queue's deficit counter grows by
its target proportion of ``window`` ids; the queue then gives as many ids as the counter holds, in
units of ``grain``, and the rest is carried to the next round (counters begin at different parts of a
unit). Documents are cut wherever that falls.
Rounds are laid end to end and cut into windows, so all windows but the last are full.

What a queue has given after a number of rounds is a closed form of that number: its counter's sum,
rounded down to units, or all it has. The place of any id of any queue follows from the sums over
queues, so every task cuts its own documents without seeing another's, and rounds, deficits and
windows run on across partitions as if packed in one row. A queue's order is that of partitions, then
rows; where a partition's rows of a source begin is known from sums.

Over any run of rounds a queue gives its target to within ``grain`` ids, and a window holds at most
what two rounds give. Targets default to the sources' shares of all ids, so that all queues end
together; given ones hold for as long as queues last, and the rest keep their proportions. Sources
without a target come last. Sources of which the target is below ``own_share`` share queues by hash of
their name, with the sum of their targets, so there are at most ``1 / own_share + POOLS`` queues with
a target, and as many without, whatever the corpus: that bounds the table that every task gets.

Defined cases: a null text is empty and has the end id alone; a text of any length is cut like
others; a null source is a source of its own; a null id and repeated rows are documents like others;
sources of equal targets give in order of their names; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import bounded_batches, materialise

GRAIN, OWN_SHARE, POOLS = 8, 1 / 4096, 256
PIECES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@cache
def encoder(path: str):
    """text -> ids, as ``tokenizers`` gives them for a ``.json`` file, or of a file of ranks (``.tiktoken``).

    Of a byte-level vocabulary that also lies beside as ranks, the ranks give the same ids several
    times faster; only texts that hold an added token go to the library itself.
    """
    ranks = Path(path).with_suffix(".tiktoken")
    plain = None
    if ranks.exists():
        import base64

        import public_tokenizers
        import tiktoken

        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={}).encode_ordinary
    if not path.endswith(".json"):
        return plain
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    said = json.loads(Path(path).read_text())
    cut = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain is None or said["normalizer"] is not None or said["pre_tokenizer"] != cut:
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    added = [t["content"] for t in said["added_tokens"]]
    return lambda text: whole.encode(text, add_special_tokens=False).ids if any(a in text for a in added) else plain(text)


@cache
def stored_as(path: str) -> str:
    """The type in which ids are stored on the way: two bytes where they fit, else four."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    return "<u2" if max(int(line.split()[1]) for line in Path(path).read_bytes().splitlines()) < 1 << 16 else "<u4"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, end_id: int) -> DataFrame:
    """_id, _s (the source, marked, as null is one too), _part, _before (ids of the source earlier in the partition), _n, _ids (little-endian)."""
    source = docs[source_col].cast("string")
    slim = docs.select(docs[id_col].alias("_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_s"), docs[text_col].cast("string").alias("_text"))
    kind = pa.schema([("_id", to_arrow_type(slim.schema["_id"].dataType)), ("_s", pa.string()), ("_part", pa.int64()), ("_before", pa.int64()), ("_n", pa.int64()), ("_ids", pa.binary())])
    kept_as = stored_as(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, given = encoder(path), TaskContext.get().partitionId(), {}
        for b in batches:
            before, n, ids = [], [], []
            for s, t in zip(b["_s"].to_pylist(), b["_text"].to_pylist()):
                x = np.array([*encode(t or ""), end_id], kept_as)
                before.append(given.get(s, 0))
                given[s] = before[-1] + len(x)
                n.append(len(x))
                ids.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b["_id"], b["_s"], *[pa.array(v, t) for v, t in (([part] * len(n), pa.int64()), (before, pa.int64()), (n, pa.int64()), (ids, pa.binary()))]], schema=kind)

    return slim.mapInArrow(run, from_arrow_schema(kind))


class Schedule:
    """Where deficit round-robin puts the ids of queues of given lengths and rates (their sum is at most 1)."""

    def __init__(self, lengths: list[int], rates: list[float], window: int, grain: int):
        self.lengths = np.array(lengths, dtype=np.float64)
        self.quantum = np.array(rates, dtype=np.float64) * window
        self.grain = grain
        # Counters begin spread over a unit, so that queues of like rates don't give in the same rounds.
        self.begun = grain * np.floor(np.modf(np.arange(1, len(lengths) + 1) * 0.6180339887498949)[0] * 1024) / 1024
        # Queues without a rate come one after the other, when all others are empty.
        idle = np.where(self.quantum > 0, 0, self.lengths)
        self.last = (self.lengths.sum() - idle.sum() + np.cumsum(idle) - idle).astype(np.int64)

    def given(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """What queues have given after so many rounds."""
        return np.minimum(self.lengths[queue], self.grain * self._units(queue, rounds))

    def _units(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        return np.floor((rounds * self.quantum[queue] + self.begun[queue]) / self.grain)

    def round_of(self, queue: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The round in which a queue gives its unit of ``grain`` ids."""
        r = np.maximum(np.ceil(((unit + 1) * self.grain - self.begun[queue]) / self.quantum[queue]) - 1, 0)
        for _ in range(2):  # what division rounds the other way
            r += self._units(queue, r + 1) < unit + 1
            r -= (r > 0) & (self._units(queue, r) >= unit + 1)
        return r

    def begins(self, queue: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Where what a queue gives in a round begins in the row of all ids."""
        out = np.empty(len(queue))
        every = np.arange(len(self.lengths))
        step = max(1, (1 << 20) // len(every))
        for at in range(0, len(queue), step):
            q, r = queue[at : at + step, None], rounds[at : at + step, None]
            out[at : at + step] = self.given(every, r + (every < q)).sum(axis=1)
        return out

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents at ``first`` of their queues with ``n`` ids: document, start in it, length and place of each piece, cut at windows."""
        idle = self.quantum[queue] == 0
        units = np.where(idle, 1, (first + n - 1) // self.grain - first // self.grain + 1)
        doc = np.repeat(np.arange(len(n)), units)
        unit = first[doc] // self.grain + np.arange(len(doc)) - np.repeat(np.cumsum(units) - units, units)
        q, still = queue[doc], idle[doc]
        r = np.zeros(len(doc))
        r[~still] = self.round_of(q[~still], unit[~still])
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (r[1:] != r[:-1])
        doc, q, r, still = doc[new], q[new], r[new], still[new]
        lo = np.maximum(first[doc], np.where(still, 0, self.given(q, r)))
        hi = np.minimum((first + n)[doc], np.where(still, np.inf, self.given(q, r + 1)))
        place = np.empty(len(doc), dtype=np.int64)
        place[still] = self.last[q[still]] + first[doc[still]]
        go = ~still
        place[go] = (self.begins(q[go], r[go]) + lo[go] - self.given(q[go], r[go])).astype(np.int64)
        lo, size = lo.astype(np.int64), (hi - lo).astype(np.int64)
        # Pieces of one document that stand together are one.
        joined = np.zeros(len(doc), dtype=bool)
        joined[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + size[:-1])
        head = np.flatnonzero(~joined)
        size = np.add.reduceat(size, head) if len(head) else size
        doc, lo, place = doc[head], lo[head], place[head]
        cuts = (place + size - 1) // window - place // window + 1
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        doc, lo, size, place = (np.repeat(x, cuts) for x in (doc, lo, size, place))
        begin = np.maximum(place, (place // window + k) * window)
        end = np.minimum(place + size, (place // window + k + 1) * window)
        return doc, lo + begin - place - first[doc], end - begin, begin


def queues_of(sums: DataFrame, targets: dict[str | None, float] | None, own_share: float) -> DataFrame:
    """_s, _n, _rate, _queue of each source. ``sums`` has _s, _n."""
    total = sums.groupBy("_s").agg(F.sum("_n").alias("_n"))
    if targets is None:
        rated = total.withColumn("_rate", F.col("_n") / F.sum("_n").over(Window.partitionBy()))
    else:
        weights = [("" if s is None else "=" + s, float(v) / sum(targets.values())) for s, v in targets.items()]
        given = sums.sparkSession.createDataFrame(weights, "_s string, _rate double")
        rated = total.join(given, "_s", "left").select("_s", "_n", F.coalesce("_rate", F.lit(0.0)).alias("_rate"))
    pooled = F.concat(F.when(F.col("_rate") > 0, "#").otherwise("~"), F.pmod(F.xxhash64("_s"), F.lit(POOLS)).cast("string"))
    return rated.withColumn("_queue", F.when(F.col("_rate") >= own_share, F.concat(F.lit("!"), "_s")).otherwise(pooled))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer: str | None = None,
    window: int = 1024,
    end_id: int = 0,
    targets: dict[str | None, float] | None = None,
    grain: int = GRAIN,
    own_share: float = OWN_SHARE,
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer or default_tokenizer()
    kept_as = stored_as(path)
    tokens = materialise(tokenised(docs, id_col, text_col, source_col, path, end_id), "packing-ids")
    sums = materialise(tokens.groupBy("_s", "_part").agg(F.sum("_n").alias("_n")), "packing-sums")
    queued = materialise(queues_of(sums, targets, own_share), "packing-queues")
    # At most 1 / own_share + 2 * POOLS rows.
    table = queued.groupBy("_queue").agg(F.sum("_n").alias("_n"), F.sum("_rate").alias("_rate")).orderBy("_queue").collect()
    number = {r["_queue"]: k for k, r in enumerate(table)}
    schedule = Schedule([r["_n"] for r in table], [r["_rate"] for r in table], window, grain)
    along = Window.partitionBy("_queue").orderBy("_part", "_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(queued.select("_s", "_queue"), "_s").select("_s", "_part", "_queue", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    placed = tokens.join(materialise(starts, "packing-starts"), ["_s", "_part"]).select("_id", "_queue", (F.col("_start") + F.col("_before")).alias("_first"), "_n", "_ids")
    kind = pa.schema([(id_col, to_arrow_type(tokens.schema["_id"].dataType)), *[(c, pa.int64()) for c in PIECES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            queue = np.array([number[q] for q in b["_queue"].to_pylist()])
            n = b["_n"].to_numpy()
            doc, start, size, place = schedule.pieces(queue, b["_first"].to_numpy(), n, window)
            crc, at, raw = [], -1, b""
            for d, s, e in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + size)).tolist()):
                if d != at:
                    at, raw = d, memoryview(np.frombuffer(b["_ids"][d].as_py(), kept_as).astype("<u4").tobytes())
                crc.append(zlib.crc32(raw[s:e]))
            columns = [start, size, np.array(crc, dtype=np.int64), n[doc], place // window, place % window]
            yield pa.RecordBatch.from_arrays([b["_id"].take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in columns]], schema=kind)

    return placed.mapInArrow(run, from_arrow_schema(kind))
