"""Language-model scoring by context-tree weighting.

A text is coded as its words, A-Z lower-cased, each followed by a space, and an end byte. Every byte
is eight binary decisions; each decision (255 of them, by the bits before it) has a context tree over
the ``DEPTH`` bytes before, nearest first. Each node has a Krichevsky-Trofimov estimate, and weighs
it half against the product of its children, which after training amounts to a posterior weight for
every depth; a node at ``DEPTH`` has its estimate alone. A text's probability is the product of what
the weighted trees, as training left them, predict for its decisions.

Counts are of whole contexts with the byte that follows (a gram, ``DEPTH + 1`` bytes in a long) and
are exact; contexts never share a count, and what is kept grows with the corpus:

1. Documents are dealt into blocks of bounded bytes. Every block asks for its own distinct grams,
   with the counts of its training documents; asks are packed arrays, dealt by a hash of the gram.
2. Asks are added up by gram, then dealt by the nearest three bytes, whose trees are whole there:
   from depth ``DEPTH`` up to 3, each adds its part to the nodes of depth 2.
3. These are added up and gathered; there are 2**16 contexts at most, whatever the corpus. The top of
   the trees is broadcast, and every shard predicts its grams, down from it.
4. Predictions go back by the gram's hash to the blocks that asked.

Word counts, for the base score, go the same way: every block asks for the words it holds, and the
totals are joined to these requests. No step gathers a frequent gram's or word's occurrences: a block
asks once for each.

Defined cases: a null text is empty, and has the end alone; a text of any length is read in whole; a
null id hashes like an empty one; repeated rows are rows like others, and are learned from as often;
further columns are ignored; an empty table gives an empty result. With nothing to learn from, every
decision has probability 1/2.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from .common import bounded_batches, materialise, partitions, scratch
from .fingerprints import mixed_hash

_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = b"\n"
DEPTH = 5
#: Bytes of text in a block, and asked for by a shard.
BLOCK_BYTES = 16 << 20
_CHUNK = 1 << 20
_8 = np.uint64(8)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_AZ).split()  # bytes split at 20, 09 to 0D


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join([*words, END]) if words else END


def chunked(streams: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for s in streams:
        held.append(s)
        size += len(s)
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams(streams: list[bytes]) -> np.ndarray:
    """The gram of each byte of the streams: its context, nearest byte first, then the byte; before a stream stand ends."""
    lead = END * DEPTH
    raw = np.frombuffer(lead + lead.join(streams), dtype=np.uint8)
    out = np.zeros(len(raw) - DEPTH, dtype=np.uint64)
    for d in range(1, DEPTH + 1):
        out = out << _8 | raw[DEPTH - d : len(raw) - d]
    out = out << _8 | raw[DEPTH:]
    sizes = np.array([len(s) for s in streams])
    inside = np.ones(len(out), dtype=bool)
    after = np.cumsum(sizes + DEPTH)[:-1]
    inside[(after[:, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    return out[inside]


def summed(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes in order, with the sums of their values."""
    found, of = np.unique(codes, return_inverse=True)
    return found, *[np.bincount(of, v, minlength=len(found)) for v in values]


def tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def packed(codes: np.ndarray) -> bytes:
    """Sorted codes as planes of the bytes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(codes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel().cumsum(dtype=np.uint64)


def dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards of sorted codes, by a hash of the keys: each shard's number and where its codes stand."""
    with np.errstate(over="ignore"):
        of = (mixed_hash(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.diff(of[order])) + 1
    for at in np.split(order, edges) if len(order) else []:
        yield int(of[at[0]]), at


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1/2 or more: Stirling's series after eight steps of the recurrence."""
    steps = np.ones_like(x)
    for k in range(8):
        steps = steps * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Nodes:
    """The nodes of one depth: codes (context, then decision 1 to 255), counts, own estimates, weighted probabilities."""

    def __init__(self, codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, kids: np.ndarray | None):
        self.codes, self.zeros, self.ones = codes, zeros, ones
        own = log_kt(zeros, ones)
        if kids is None:
            self.weighted, self.weight = own, np.ones(len(own))
        else:
            self.weighted = np.logaddexp(own, kids) + math.log(0.5)
            self.weight = np.exp(own + math.log(0.5) - self.weighted)
        self.up: np.ndarray | None = None

    def above(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, counts and children's products of the nodes one byte up."""
        parents, self.up = np.unique(self.codes >> np.uint64(16) << _8 | self.codes & np.uint64(255), return_inverse=True)
        zeros, ones, kids = (np.bincount(self.up, v, minlength=len(parents)) for v in (self.zeros, self.ones, self.weighted))
        return parents, zeros, ones, kids

    def mixed(self, said: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the trees say down to here of a one, and the weight left to greater depths, from what they say above."""
        estimate = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        return said + left * self.weight * estimate, left * (1 - self.weight)


def leaves(codes: np.ndarray, counts: np.ndarray) -> tuple[Nodes, list[np.ndarray], list[np.ndarray]]:
    """The nodes at ``DEPTH`` of sorted grams, and for each of the eight decisions which node and what bit a gram has."""
    symbol = codes & np.uint64(255)
    nodes, zeros, ones, ats, bits, first = [], [], [], [], [], 0
    for b in range(8):
        node = codes >> _8 << _8 | np.uint64(1 << b) | symbol >> np.uint64(8 - b)
        bit = (symbol >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
        new = np.ones(len(node), dtype=bool)
        new[1:] = node[1:] != node[:-1]  # nodes stand in order, as grams do
        at = np.cumsum(new) - 1
        nodes.append(node[new])
        ones.append(np.bincount(at, counts * bit, minlength=len(nodes[-1])))
        zeros.append(np.bincount(at, counts * (1 - bit), minlength=len(nodes[-1])))
        ats.append(at + first)
        bits.append(bit)
        first += len(nodes[-1])
    return Nodes(np.concatenate(nodes), np.concatenate(zeros), np.concatenate(ones), None), ats, bits


def grown(codes: np.ndarray, counts: np.ndarray) -> tuple[list[Nodes], tuple, list[np.ndarray], list[np.ndarray]]:
    """Nodes from ``DEPTH`` up to depth 3, what they tell the nodes of depth 2, and where grams decide."""
    here, ats, bits = leaves(codes, counts)
    levels = [here]
    for _ in range(DEPTH - 3):
        levels.append(Nodes(*levels[-1].above()))
    return levels, levels[-1].above(), ats, bits


class Top:
    """The trees down to depth 2: what they say there, and the weight left below."""

    def __init__(self, codes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, kids: np.ndarray):
        levels = [Nodes(codes, zeros, ones, kids)]
        for _ in range(2):
            levels.append(Nodes(*levels[-1].above()))
        said, left = np.zeros(len(levels[-1].codes)), np.ones(len(levels[-1].codes))
        for k in (2, 1, 0):
            if k < 2:
                said, left = said[levels[k].up], left[levels[k].up]
            said, left = levels[k].mixed(said, left)
        self.codes, self.said, self.left = codes, said, left

    def predict(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's byte after its context, of all grams with the same nearest three bytes as any."""
        if not len(codes):
            return np.zeros(0)
        levels, (above, *_), ats, bits = grown(codes, counts)
        at = np.searchsorted(self.codes, above)
        said, left = self.said[at], self.left[at]
        for nodes in reversed(levels):
            said, left = nodes.mixed(said[nodes.up], left[nodes.up])
        one = said[np.concatenate(ats)].reshape(8, -1)
        return np.log10(np.where(np.stack(bits) == 1, one, 1 - one)).sum(axis=0)


_ASKS = pa.schema([("_b", pa.int64()), ("_w", pa.binary()), ("_n", pa.int64()), ("_g", pa.int32()), ("_codes", pa.binary()), ("_counts", pa.binary())])
_MERGED = pa.schema([("_leaf", pa.int32()), ("_codes", pa.binary()), ("_counts", pa.binary())])
_UP = pa.schema([("_mid", pa.int32()), ("_codes", pa.binary()), ("_zeros", pa.binary()), ("_ones", pa.binary()), ("_kids", pa.binary())])
_DOWN = pa.schema([("_g", pa.int32()), ("_codes", pa.binary()), ("_logs", pa.binary())])
_TOLD = pa.schema([("_b", pa.int64()), ("_w", pa.binary()), ("_c", pa.int64()), ("_codes", pa.binary()), ("_logs", pa.binary())])


def _table(rows: list[tuple], kind: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)


def _arrays(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table[column].to_pylist()])


def _codes(table: pa.Table) -> np.ndarray:
    return np.concatenate([unpacked(x) for x in table["_codes"].to_pylist()])


def blocked(docs: DataFrame, id_col: str, text_col: str, folds: int, held_fold: int) -> DataFrame:
    """_id, held_out, _text, _block (rows of a block stand together), _size."""
    mark = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    slim = docs.select(docs[id_col].alias("_id"), ((mark % folds) == held_fold).alias("held_out"), docs[text_col].cast("string").alias("_text"))
    kind = pa.schema([("_id", to_arrow_type(slim.schema["_id"].dataType)), ("held_out", pa.bool_()), ("_text", pa.string()), ("_block", pa.int64()), ("_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            size = pc.fill_null(pc.binary_length(b["_text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            upto = done + np.cumsum(size)
            done += int(size.sum())
            yield pa.RecordBatch.from_arrays([*[b[c].cast(kind.field(c).type) for c in ("_id", "held_out", "_text")], pa.array(part + (upto - size) // BLOCK_BYTES), pa.array(size)], schema=kind)

    return slim.mapInArrow(run, from_arrow_schema(kind))


def asked(slim: DataFrame, shards: int) -> DataFrame:
    """What each block asks for: words with their counts in its training documents, and packed grams with theirs. A block may ask twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, others, parts = 0, Counter(), set(), []
        streams: tuple[list[bytes], list[bytes]] = ([], [])
        size = 0

        def some() -> None:
            for out, held in enumerate(streams):
                if held:
                    codes, n = np.unique(grams(held), return_counts=True)
                    parts.append((codes, np.zeros(len(codes)) if out else n))
                    held.clear()

        def words() -> Iterator[pa.RecordBatch]:
            if counts or others:
                others.difference_update(counts)
                k = len(counts) + len(others)
                n = pa.array([*counts.values(), *[0] * len(others)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([at] * k, pa.int64()), pa.array([*counts, *others], pa.binary()), n, *[pa.nulls(k, f.type) for f in list(_ASKS)[3:]]], schema=_ASKS)
            counts.clear()
            others.clear()

        def told() -> Iterator[pa.RecordBatch]:
            yield from words()
            some()
            codes, n = tally(parts)
            parts.clear()
            rows = [(at, None, None, g, packed(codes[k]), n[k].astype("<u4").tobytes()) for g, k in dealt(codes, shards)]
            yield from _table(rows, _ASKS).to_batches()

        for b in batches:
            for block, out, text in zip(b["_block"].to_pylist(), b["held_out"].to_pylist(), b["_text"].to_pylist()):
                if block != at:
                    yield from told()
                    at = block
                ws = tokens_of(text)
                if out:
                    others.update(ws)
                    others.add(END)
                else:
                    counts.update(ws)
                    counts[END] += 1
                streams[out].append(stream_of(ws))
                size += len(streams[out][-1])
                if size > _CHUNK:
                    some()
                    size = 0
                if len(counts) + len(others) > 400_000:
                    yield from words()
        yield from told()

    return slim.select("_block", "held_out", "_text").mapInArrow(run, from_arrow_schema(_ASKS))


def predicted(asks: DataFrame, shards: int) -> DataFrame:
    """_b, and the log10 probabilities of the packed grams that the block asked for. ``asks`` is stored, and has packed grams."""

    def merge(table: pa.Table) -> pa.Table:
        codes, n = summed(_codes(table), _arrays(table, "_counts", "<u4"))
        return _table([(leaf, packed(codes[k]), n[k].astype("<i8").tobytes()) for leaf, k in dealt(codes >> np.uint64(8 * (DEPTH - 2)), shards)], _MERGED)

    merged = materialise(asks.groupBy("_g").applyInArrow(merge, from_arrow_schema(_MERGED)), "lm-grams")

    def up(table: pa.Table) -> pa.Table:
        codes, n = summed(_codes(table), _arrays(table, "_counts", "<i8"))
        codes, *values = grown(codes, n)[1]
        return _table([(mid, packed(codes[k]), *[v[k].astype("<f8").tobytes() for v in values]) for mid, k in dealt(codes >> _8, shards)], _UP)

    def add(table: pa.Table) -> pa.Table:
        codes, *values = summed(_codes(table), *[_arrays(table, c, "<f8") for c in ("_zeros", "_ones", "_kids")])
        return _table([(0, packed(codes), *[v.astype("<f8").tobytes() for v in values])], _UP)

    parts = merged.groupBy("_leaf").applyInArrow(up, from_arrow_schema(_UP)).groupBy("_mid").applyInArrow(add, from_arrow_schema(_UP)).toArrow()
    if parts.num_rows:
        codes = _codes(parts)
        order = np.argsort(codes)
        top = Top(codes[order], *[_arrays(parts, c, "<f8")[order] for c in ("_zeros", "_ones", "_kids")])
    else:
        top = Top(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0), np.zeros(0))
    shared = asks.sparkSession.sparkContext.broadcast(top)

    def down(table: pa.Table) -> pa.Table:
        codes, n = summed(_codes(table), _arrays(table, "_counts", "<i8"))
        logs = shared.value.predict(codes, n).astype("<f8")
        return _table([(g, packed(codes[k]), logs[k].tobytes()) for g, k in dealt(codes, shards)], _DOWN)

    def answer(asking: pa.Table, said: pa.Table) -> pa.Table:
        codes, logs = _codes(said), _arrays(said, "_logs", "<f8")
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        rows = [(b, None, None, raw, logs[np.searchsorted(codes, unpacked(raw))].astype("<f4").tobytes()) for b, raw in zip(asking["_b"].to_pylist(), asking["_codes"].to_pylist())]
        return _table(rows, _TOLD)

    said = merged.groupBy("_leaf").applyInArrow(down, from_arrow_schema(_DOWN))
    return asks.select("_g", "_b", "_codes").groupBy("_g").cogroup(said.groupBy("_g")).applyInArrow(answer, from_arrow_schema(_TOLD))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = materialise(blocked(docs, id_col, text_col, folds, held_fold), "lm-blocks")
    size = slim.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    shards = max(partitions(spark), -(-size // BLOCK_BYTES))
    with scratch(spark):
        asks = materialise(asked(slim, shards), "lm-asks")
        words = asks.where("_w is not null").select("_b", "_w", "_n")
        totals = materialise(words.groupBy("_w").agg(F.sum("_n").alias("_c")), "lm-totals")
        n, v = totals.agg(F.coalesce(F.sum("_c"), F.lit(0)), F.count_if(F.col("_c") > 0)).first()
        known = words.select("_b", "_w").join(totals, "_w").select("_b", "_w", "_c", F.lit(None).cast("binary").alias("_codes"), F.lit(None).cast("binary").alias("_logs"))
        answers = materialise(known.unionByName(predicted(asks.where("_codes is not null"), shards)), "lm-answers", keep=True)
    kind = pa.schema([
        (id_col, to_arrow_type(slim.schema["_id"].dataType)), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")],
        ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64()),
    ])

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        asked_words = told.filter(pc.is_valid(told["_w"]))
        at = dict(zip(asked_words["_w"].to_pylist(), range(asked_words.num_rows)))
        c = asked_words["_c"].to_numpy()
        logs = np.log10((c + 1) / (n + 1 * (v + 1)))
        packs = told.filter(pc.is_valid(told["_codes"]))
        codes, first = np.unique(_codes(packs), return_index=True)
        said = _arrays(packs, "_logs", "<f4")[first].astype(np.float64)
        end = at[END]
        rows: list[list] = [[] for _ in range(5)]
        texts = own["_text"]
        for k in range(0, own.num_rows, 128):  # few documents' words are held at a time
            words_of = [tokens_of(t) for t in texts.slice(k, 128).to_pylist()]
            streams = [stream_of(ws) for ws in words_of]
            for ws in words_of:
                ids = np.fromiter((at[w] for w in ws), dtype=np.int64, count=len(ws))
                rows[0].append(len(ws) + 1)
                rows[1].append(int(np.count_nonzero(c[ids])) + int(c[end] > 0))
                rows[2].append(float(logs[ids].sum() + logs[end]))
            for some in chunked(streams):
                sizes = np.array([len(s) for s in some])
                each = said[np.searchsorted(codes, grams(some))]
                rows[3] += np.add.reduceat(each, np.cumsum(sizes) - sizes).tolist()
                rows[4] += sizes.tolist()
        bits = [-x * math.log2(10) / s for x, s in zip(rows[3], rows[4])]
        values = [rows[0], rows[1], [n] * own.num_rows, rows[2], rows[3], rows[4], bits]
        return pa.table([own["_id"], own["held_out"], *[pa.array(x, f.type) for x, f in zip(values, list(kind)[2:])]], schema=kind)

    return slim.select("_block", "_id", "held_out", "_text").groupBy("_block").cogroup(answers.groupBy("_b")).applyInArrow(run, from_arrow_schema(kind))
