"""GIF media columns, periodic runs and ranked search: against plain definitions, on odd cases, and their contracts."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import gif, lexical, periodic_runs
from folioflow.llm import queries as Q

from .test_cases import BIG, KIND, ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").toPandas().sort_values("doc_id")


# ---- GIF

#: A file of 10 x 10 pixels in four colours, as often printed to explain the format.
KNOWN = bytes.fromhex(
    "47494638 3961 0a00 0a00 91 00 00 ffffff ff0000 0000ff 000000 21f904 00 0000 00 00"
    "2c 0000 0000 0a00 0a00 00 02 16 8c2d99872a1cdc33a00275ec95faa8de608c04914c01 00 3b"
)


def plain_lzw(data, least):
    """The textbook's decoder: one code after the other."""
    clear = 1 << (least - 1)
    bits, at, width, known, before, out = int.from_bytes(data, "little"), 0, least, [], None, []
    while at + width <= 8 * len(data):
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            known, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least, None
            continue
        if code == clear + 1:
            break
        said = known[code] if code < len(known) else before + before[:1]
        out.append(said)
        if before is not None and len(known) < 4096:
            known.append(before + said[:1])
        if len(known) == 1 << width and width < 12:
            width += 1
        before = said
    return b"".join(out)


def coded(codes, least):
    """Codes as bits, the width told by counting; clear codes anywhere."""
    clear = 1 << (least - 1)
    value = at = 0
    known, width, fresh = clear + 2, least, True
    for c in codes:
        value |= c << at
        at += width
        if c == clear:
            known, width, fresh = clear + 2, least, True
            continue
        if not fresh and known < 4096:
            known += 1
        fresh = False
        if known == 1 << width and width < 12:
            width += 1
    return value.to_bytes(-(-at // 8), "little")


def file_of(frames, width, height, palette, transparent=None):
    """A file of frames (left, top, rows of samples, disposal, interlaced, clear, colours of its own or None) with codes of single samples."""
    def colours(p):
        return b"".join(bytes(c) for c in p)

    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (len(palette).bit_length() - 2), 0, 0), colours(palette), b"\x21\xfe\x03abc\0"]
    for left, top, rows, disposal, interlaced, clear, own in frames:
        order = range(len(rows))
        if interlaced:
            order = [r for a, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, len(rows), step)]
        codes = [8]
        for n, s in enumerate(s for r in order for s in rows[r]):
            codes += [8, s] if n % 5 == 4 else [s]
        data = coded([*codes, 9], 4)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0), b"\0\x2c"]
        out += [struct.pack("<HHHHB", left, top, len(rows[0]), len(rows), (0x40 if interlaced else 0) | (0x80 | (len(own).bit_length() - 2) if own else 0)), colours(own or []), b"\x03", bytes([len(data)]), data, b"\0"]
    return b"".join([*out, b"\x3b"])


RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
PALETTE = [RED, GREEN, BLUE, WHITE, *[(0, 0, 0)] * 4]


def test_known_file():
    file = gif.opened([KNOWN])[0]
    assert file.reason is None and (file.width, file.height, len(file.frames)) == (10, 10, 1)
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert ["".join(map(str, r)) for r in file.frames[0].samples] == rows


@pytest.mark.parametrize("letters", [1, 2, 20, 256])
def test_codes_round_trip(letters):
    draw = random.Random(letters)
    for n in (1, 2, 7, 500, 5_000, 30_000):
        raw = bytes(draw.randrange(letters) for _ in range(n))
        data = gif.packed(gif.codes_of(raw))
        assert plain_lzw(data, 9) == raw
        assert gif.decoded([(data, 9, n)])[0].tobytes() == raw
    assert gif.decoded([(gif.packed(gif.codes_of(b"")), 9, 0)])[0].tobytes() == b""


def test_streams_are_decoded_together():
    """With clear codes anywhere, codes that stand for themselves, other widths, and broken ones between."""
    draw = random.Random(7)
    streams, right = [], []
    for least in (3, 4, 6, 9) * 8:
        clear, codes, known = 1 << (least - 1), [1 << (least - 1)], 0
        for _ in range(draw.choice([3, 50, 6_000])):
            if draw.random() < 0.002:
                codes, known = [*codes, clear], 0
                continue
            top = min(4095, clear + 1 + max(0, known))
            c = draw.randrange(top + 1) if known else draw.randrange(clear)
            codes.append(c if c not in (clear, clear + 1) else 0)
            known += 1
        data = coded([*codes, clear + 1], least)
        raw = plain_lzw(data, least)
        streams.append((data, least, len(raw)))
        right.append(raw)
    streams[5:5] = [(coded([8, 1, 14, 9], 4), 4, 9), (b"", 9, 3), (streams[0][0], 3, len(right[0]) + 1)]
    found = gif.decoded(streams)
    assert [str(x) for x in found[5:8]] == ["bad code", "truncated", "truncated"]
    assert [x.tobytes() for x in found[:5] + found[8:]] == right


def shown_of(raw):
    file = gif.opened([raw])[0]
    return file, [x.copy() for x in file.shown()]


def test_disposal_transparency_and_palettes():
    one = [[0] * 4] * 4
    dot = [[1, 3], [3, 1]]
    frames = [
        (0, 0, one, 1, False, None, None),  # red all over, stays
        (1, 1, dot, 3, False, 3, None),  # green dots over it, what was there comes back
        (2, 2, dot, 2, False, None, [BLUE, BLUE, BLUE, WHITE]),  # its own palette, taken away
        (3, 3, [[2, 2], [2, 2]], 0, False, None, None),  # partly off the screen
    ]
    file, shown = shown_of(file_of(frames, 4, 4, PALETTE))
    assert file.reason is None and [f.start_ms for f in file.frames] == [0, 70, 140, 210]
    at = lambda k, y, x: tuple(shown[k][y, x].tolist())
    assert at(0, 3, 3) == (*RED, 255)
    assert at(1, 1, 1) == (*GREEN, 255) and at(1, 1, 2) == (*RED, 255) and at(1, 2, 2) == (*GREEN, 255)
    assert at(2, 1, 1) == (*RED, 255) and at(2, 2, 2) == (*BLUE, 255) and at(2, 2, 3) == (*WHITE, 255)
    assert at(3, 2, 2) == (0, 0, 0, 0) and at(3, 3, 3) == (*BLUE, 255) and at(3, 0, 0) == (*RED, 255)
    told = gif.taken_apart([file_of(frames, 4, 4, PALETTE)])[0]
    counts = [Counter({i: n for i, n in enumerate(f["histogram"].tolist()) if n}) for f in told["frames"]]
    assert counts == [{48: 16}, {48: 14, 12: 2}, {48: 12, 3: 2, 63: 2}, {48: 12, 3: 1}]
    assert [f["unpainted"] for f in told["frames"]] == [0, 0, 0, 3]
    assert [f["disposal"] for f in told["frames"]] == [1, 3, 2, 0] and [f["transparent"] for f in told["frames"]] == [None, 3, None, None]


def test_interlaced_rows():
    rows = [[r % 4, (r // 4) % 4, 1] for r in range(13)]
    for interlaced in (False, True):
        file, _ = shown_of(file_of([(0, 0, rows, 0, interlaced, None, None)], 3, 13, PALETTE))
        assert file.frames[0].samples.tolist() == rows and file.frames[0].interlaced == interlaced


def test_broken_files():
    whole = gif.gif_of(b"abc" * 64 * 300)
    many = len(gif.opened([whole])[0].frames)
    assert many > 1
    seen = Counter()
    for end in (0, 3, 6, 12, 400, 781, 800, 1_000, len(whole) // 2, len(whole) - 1):
        file = gif.opened([whole[:end]])[0]
        assert file.reason == ("not a gif" if end < 6 else "truncated") and len(file.frames) <= many
        seen[len(file.frames)] += 1
    assert seen[0] and seen[many]  # only the last byte is missing
    no_palette = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x08\x01\0\0\x3b"
    assert gif.opened([no_palette])[0].reason == "no palette"
    for at in (6, whole.index(b"\x2c", 781) + 5):  # the screen, and the first frame
        huge = gif.opened([whole[:at] + b"\xff\xff\xff\xff" + whole[at + 4 :]])[0]
        assert huge.reason == "too large" and not huge.frames
    assert gif.taken_apart([None, b""])[0] is None and gif.taken_apart([None, b""])[1]["reason"] == "not a gif"


def test_media_of_odd_rows(spark, odd, empty):
    media = gif.stored(odd, gif.payload(F.col("text")), ["doc_id", "text", "_id"])
    told = gif.read(media, "media", ["doc_id", "text", "_id"]).collect()
    assert len(told) == len(ROWS)
    for r in told:
        raw = (r.text or "").encode()
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert bytes(r.gif.samples) == want and r.gif.reason is None and r.gif.width == 192
        assert sum(sum(f.histogram) for f in r.gif.frames) == len(want) and [f.start_ms for f in r.gif.frames] == [100 * k for k in range(len(r.gif.frames))]
    assert len({(r.text, str(r.gif)) for r in told}) == len({r.text for r in told})
    assert gif.stored(empty, gif.payload(F.col("text")), ["doc_id"]).count() == 0
    assert gif.read(gif.stored(empty, gif.payload(F.col("text")), ["doc_id"]), "media", ["doc_id"]).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, b"")], "id int, raw binary")
    assert [r.gif and r.gif.frames for r in gif.read(gif.stored(nulls, F.col("raw"), ["id"]), "media", ["id"]).orderBy("id").collect()] == [None, []]
    with pytest.raises(ValueError):
        gif.stored(odd.withColumn("media", F.lit(1)), gif.payload(F.col("text")), ["media"])


def test_op11(spark, data, docs):
    found = {r.doc_id: r for r in Q.op11_media_gif(spark, data).collect()}
    assert len(found) == len(docs)
    by_text = {}
    for i, t in zip(docs.doc_id, docs.text):
        raw, r = (t or "").encode(), found[i]
        want = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.reason) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]), None)
        media = gif.gif_of(want)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        by_text.setdefault(t, set()).add((r.media_sha256, r.feature))
        # Samples are 3-3-2 bits of colour; the histogram has two of each.
        b = np.frombuffer(want, dtype=np.uint8).astype(int)
        bins = np.bincount((((b >> 5) * 255 // 7) >> 6) << 4 | (((b >> 2 & 7) * 255 // 7) >> 6) << 2 | b & 3, minlength=64) * 100
        assert r.feature.split(" ")[2] == ",".join(map(str, bins))
    assert all(len(v) == 1 for v in by_text.values())


# ---- periodic runs


def brute_runs(w, least=6, times=4):
    """Every stretch by its definition."""
    out = []
    for q in range(1, len(w) // times + 1):
        s = 0
        while s < len(w) - q:
            e = s
            while e < len(w) - q and w[e] == w[e + q]:
                e += 1
            n = e + q - s
            if e > s and n >= max(least, times * q) and not any(w[s + p : s + n] == w[s : s + n - p] for p in range(1, q)):
                out.append((s, n, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, times", [(6, 4), (3, 3), (2, 2)])
def test_runs_equal_brute_force(least, times):
    draw = random.Random(times)
    for _ in range(3_000):
        n, k = draw.randint(0, 40), draw.choice([1, 2, 2, 3, 4])
        w = []
        while len(w) < n:
            w += [draw.randrange(k) for _ in range(draw.randint(1, 6))] * (draw.randint(1, 7) if draw.random() < 0.5 else 1)
        assert periodic_runs.runs(w, least, times) == brute_runs(w, least, times), w


class Counted:
    """A word that counts comparisons, and has no hash."""

    made = 0
    __hash__ = None

    def __init__(self, v):
        self.v = v

    def _told(self, yes):
        Counted.made += 1
        return yes

    def __eq__(self, o):
        return self._told(self.v == o.v)

    def __ne__(self, o):
        return self._told(self.v != o.v)

    def __lt__(self, o):
        return self._told(self.v < o.v)


def _fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def _nested(n):
    s, c = "a", 98
    while len(s) < n:
        s, c = s * 4 + chr(c), c + 1
    return s[:n]


FAMILIES = {
    "one": lambda n: "a" * n, "pair": lambda n: "ab" * (n // 2), "five": lambda n: "abcde" * (n // 5), "fibonacci": _fibonacci, "backwards": lambda n: _fibonacci(n)[::-1], "nested": _nested,
    "thue": lambda n: "".join("ab"[i.bit_count() & 1] for i in range(n)), "ruler": lambda n: "".join(chr(97 + (i & -i).bit_length()) for i in range(1, n)),
    "random": lambda n: "".join(random.Random(1).choices("ab", k=n)), "blocks": lambda n: "".join(random.Random(2).choices("abc", k=n // 10)) * 10,
    "growing": lambda n: "".join("a" * k + "b" for k in range(int((2 * n) ** 0.5))), "shrinking": lambda n: "".join("a" * k + "b" for k in range(int((2 * n) ** 0.5), 0, -1)), "thue blocks": lambda n: "".join("ab"[i.bit_count() & 1] for i in range(n // 8)) * 8,
}


@pytest.mark.parametrize("name", FAMILIES)
def test_comparisons_are_linear(name):
    for n in (3_000, 12_000):
        w = [Counted(x) for x in FAMILIES[name](n)]
        Counted.made = 0
        periodic_runs.runs(w)
        assert Counted.made <= 13 * n


def test_runs_of_odd_rows(spark, odd, empty):
    found = periodic_runs.periodic_runs(odd).collect()
    assert len(found) == len(ROWS) and periodic_runs.periodic_runs(empty).count() == 0
    by_text = {}
    for r in found:
        by_text.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.runs, r.collapsed_text) for r in by_text[3]] == [(0, [], "")] == [(r.n_words, r.runs, r.collapsed_text) for r in by_text[5]]
    assert len(by_text[2]) == 2 and by_text[2][0] == by_text[2][1]
    assert [tuple(x) for x in by_text[6][0].runs] == [(0, 20_000, 977)] and len(by_text[6][0].collapsed_text.split()) == 977
    assert [tuple(x) for x in by_text[7][0].runs] == [(0, 20_000, 977)] and by_text[7][0].collapsed_text.endswith("w976 end")
    texts = ["a " * 7, "x a b a b a b a b a y " + "z\t" * 6, "ä b " * 12, "a b " * 3 + "c"]
    told = {r.doc_id: r for r in periodic_runs.digests(periodic_runs.periodic_runs(spark.createDataFrame([(BIG + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, runs int"))).collect()}
    assert tuple(told[BIG])[1:6] == (1, 0, 7, 1, 7000) and tuple(told[BIG + 1])[1:6] == (2, 1, 9, 2, 4500) and tuple(told[BIG + 2])[1:6] == (1, 0, 12, 1, 12000)
    assert tuple(told[BIG + 3])[1:6] == (0, None, None, None, None) and told[BIG + 3].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert told[BIG + 1].collapsed_sha256 == hashlib.sha256(b"x a b y z").hexdigest()


def test_op12(spark, data, docs):
    found = {r.doc_id: tuple(r)[1:] for r in Q.op12_periodic_runs(spark, data).collect()}
    assert len(found) == len(docs)
    some = 0
    for i, t in zip(docs.doc_id, docs.text):
        w = WORD.findall(t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if n > 1_500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        rs = brute_runs(w)
        some += len(rs)
        best = min(rs, key=lambda r: (-r[1], r[0], r[2])) if rs else None
        gone = {k for s, m, q in rs for k in range(s + q, s + m)}
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in rs)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert found[i] == (len(rs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    assert some > 20


# ---- ranked search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERMS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=20):
    """(item, rank, doc, score) of every document's score for every item. Ids are numbers or null."""
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found_by(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _texts(draw, n, letters):
    return [(i if draw.random() < 0.97 else None, " ".join(draw.choices(letters, weights=[1 / (k + 1) for k in range(len(letters))], k=draw.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("shard", [{}, {"shard_docs": 1}, {"shard_docs": 7, "block_bytes": 40}, {"shard_postings": 25}])
def test_search_equals_brute_force(spark, shard):
    """Whatever the shards and blocks; many scores are equal."""
    draw = random.Random(4)
    letters = [f"T{k}" for k in range(12)] + ["É", "漢字", "a-b"]
    rows = _texts(draw, 120, letters) + [(500, None), (501, "..."), (3, "T1 T1"), (None, "T9 É")]
    items = [(i, " ".join(draw.choices(letters, k=draw.randint(1, 9)))) for i in range(9)] + [(90, None), (None, "t3 t3 é"), (91, "none of these"), (92, "T1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    assert found_by(lexical.search(docs, asked, k=6, **shard)) == brute_search(rows, items, 6)


def test_non_essential_lists_are_only_probed(monkeypatch):
    """A frequent term's list is searched for the candidates of rare terms, not added up."""
    import pyarrow as pa

    n = 2_000
    at = np.r_[np.arange(n), np.arange(0, n, 100), np.arange(0, n, 100)]
    term = np.r_[np.zeros(n, int), np.ones(20, int), np.full(20, 2)]
    impact = np.r_[np.arange(n) % 7 + 1, np.full(20, 50) + np.arange(20), np.full(20, 50)]
    shard = lexical.Shard(pa.array(np.arange(n)), at, term, impact)
    total = np.bincount(at, weights=impact * np.array([1, 10, 10])[term], minlength=n).astype(int)
    best = sorted(range(n), key=lambda i: (-total[i], i))[:5]
    sought = []
    search = np.searchsorted
    monkeypatch.setattr(lexical.np, "searchsorted", lambda a, v, **k: sought.append((len(a), len(v))) or search(a, v, **k))
    places, scores, least = shard.best(np.array([0, 1, 2]), np.array([1, 10, 10]), 5, 1)
    assert places.tolist() == best and scores.tolist() == total[best].tolist() and least == total[best[-1]]
    assert sought and sought[-1][0] == n and sought[-1][1] <= 20  # the frequent term comes last, for few documents
    assert shard.best(np.array([0]), np.array([1]), 5, 10**6)[0].tolist() == []


def test_search_of_odd_rows(spark, odd, empty):
    items = odd.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("score"), F.lit("x").alias("rank"))
    found = lexical.search(odd, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows = found.collect()
    for i in (1, 6, 9):
        mine = [r for r in rows if r.item_id == i]
        assert mine[0].rank == 1 and i in {r.doc_id for r in mine if r.score == mine[0].score}
    # Of equal copies the lesser ids come first; the repeated row ranks twice.
    assert [r.doc_id for r in sorted((r for r in rows if r.item_id == 1), key=lambda r: r.rank)][:3] == [1, 2, 2]
    assert not [r for r in rows if r.item_id in (3, 4, 5)]
    for docs, asked in ((empty, items), (odd, empty.withColumnRenamed("doc_id", "item_id")), (empty, empty.withColumnRenamed("doc_id", "item_id"))):
        none = lexical.search(docs, asked)
        assert none.count() == 0 and none.columns == found.columns
    named = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    assert [tuple(r) for r in lexical.search(named, spark.createDataFrame([(BIG, "x")], "item_id long, text string")).orderBy("rank").collect()][0][:3] == (BIG, 1, "a")


def test_op13(spark, data, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert found_by(Q.op13_ranked_search(spark, data)) == brute_search(list(zip(docs.doc_id, docs.text)), items)
