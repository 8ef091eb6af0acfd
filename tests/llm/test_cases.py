"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute force on small fixtures."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, exact_dedup, langid, lm_scoring, mixing, near_dedup, packing, quality, substring_dedup, url_rules
from .test_contracts import brute_substrings, check_pieces

KIND = "doc_id long, text string, lang string, source string, n_chars long, _text string, kept boolean, size int, _id string"
LONG = " ".join(f"w{k % 977}" for k in range(20_000))
PASSAGE = " ".join(f"p{k}" for k in range(60))


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, "clash", None, 7, None)


ROWS = [
    _row(1, "same text of some words"), _row(2, "same text of some words"), _row(2, "same text of some words"), _row(3, None, None, None), _row(4, ""), _row(5, " \n\t "),
    _row(6, LONG), _row(7, LONG + " end"), _row(8, "Größe 漢字 emoji 😀 #$%"), _row(9, PASSAGE + " tail one"), _row(10, "head " + PASSAGE), _row(None, PASSAGE + " no id", "fr", "b"), _row(None, None), _row(11, "1 2 3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


OPERATORS = {
    "substring": substring_dedup.remove_repeats, "near": near_dedup.near_classes, "score": lm_scoring.score, "language": langid.identify, "exact": exact_dedup.exact_groups,
    "mix": mixing.mix, "quality": quality.judge_rows, "quality of ids": lambda d: quality.judge_rows(d, keep=["doc_id"]),
}
KEEPERS = {"exact": exact_dedup.exact_dedup, "near": near_dedup.keep_rows, "quality": quality.keep_rows, "mixed": mixing.mixed}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(name, odd, empty):
    assert OPERATORS[name](odd).count() == len(ROWS)
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", KEEPERS)
def test_keepers_return_the_columns(name, odd, empty):
    kept = KEEPERS[name](odd)
    assert kept.columns == odd.columns
    assert KEEPERS[name](empty).count() == 0
    times = Counter((r.doc_id, r.text) for r in kept.collect())
    if name == "exact":
        assert sorted(times.values()) == [1] * 10 and times[2, ROWS[1][1]] == 1 and times[4, ""] == 1
    if name == "near":
        assert times[2, ROWS[1][1]] == 0 and times[1, ROWS[0][1]] == 1 and times[6, LONG] == 1 and times[7, LONG + " end"] == 0
    if name == "quality":
        assert set(times) == {(9, ROWS[9][1]), (10, ROWS[10][1]), (None, ROWS[11][1])}
    if name == "mixed":
        assert times[6, LONG] in (1, 2) and times[4, ""] == 0


BIG = 2**53 + 1
HOLDERS = {"substring": substring_dedup.remove_repeats, "score": lm_scoring.score, "language": langid.identify, "packing": packing.pack}


@pytest.mark.parametrize("name", HOLDERS)
def test_ids_stay_what_they_are(spark, name):
    """Beside a null, which would make floats of them."""
    rows = [(BIG, "a b", "en", "s"), (None, "c d", "en", "s"), (BIG + 2, None, None, None)]
    for kind, cast in (("long", int), ("int", lambda i: i % 1000), ("string", str)):
        df = spark.createDataFrame([(None if i is None else cast(i), *r) for i, *r in rows], f"doc_id {kind}, text string, lang string, source string").coalesce(1)
        found = HOLDERS[name](df)
        assert found.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
        assert {r.doc_id for r in found.collect()} == {None, cast(BIG), cast(BIG + 2)}


def test_exact(odd):
    found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_groups(odd).collect()}
    same = [r for r in found.values() if r.keep_id == 2]
    assert {r.group_size for r in same} == {3}
    assert sorted(r.doc_id for r in same if r.kept) == [2]
    nothing = [r for r in found.values() if r.keep_id == 4]
    assert sorted(str(r.doc_id) for r in nothing) == ["3", "4", "None"] and nothing[0].group_size == 3
    assert exact_dedup.exact_dedup(odd).where("doc_id = 2").count() == 1


def test_exact_tells_clashing_digests_apart(spark, monkeypatch):
    """With a digest that says nothing, contents decide."""
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00"))
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(df).collect()) == [2, 3, 4]


def test_substrings(odd):
    found = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).where("doc_id is not null").collect()}
    assert found[7].n_removed == 20_000 and found[7].kept_text == "end"
    assert found[10].kept_text == "head" and found[9].n_removed == 0 and found[6].n_removed == 0
    none = [r for r in substring_dedup.remove_repeats(odd).where("doc_id is null").collect()]
    assert sorted(r.kept_text for r in none) == ["", "no id"]


@pytest.mark.parametrize("seed", range(4))
def test_substrings_by_brute_force(spark, seed):
    """Random texts that share passages of about the threshold, within and across documents."""
    g = random.Random(seed)
    pool = [[f"x{g.randrange(60)}" for _ in range(g.choice([49, 50, 51, 70, 120]))] for _ in range(6)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(g.randrange(5)):
            words += g.choice(pool) if g.random() < 0.6 else [f"y{g.randrange(10**6)}" for _ in range(g.randrange(40))]
            if g.random() < 0.2:
                words += ["z"] * g.randrange(120)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_words, r.n_removed, r.h) for r in substring_dedup.remove_repeats(df).withColumn("h", F.sha2("kept_text", 256)).collect()}
    assert found == brute_substrings(rows)


def test_automaton():
    a = substring_dedup.Automaton()
    a.add("a b c a b d".split(), 5)
    a.add("b c a b e".split(), 3)
    a.finish()
    assert a.spans("q b c a b d".split(), 9, 3) == [(1, 5)]
    assert a.spans("a b d".split(), 5, 3) == [] and a.spans("a b d".split(), 6, 3) == [(0, 3)]
    assert a.spans("b c a".split(), 5, 3) == [(0, 3)] and a.spans("b c a".split(), 3, 3) == []


def test_near(spark):
    g = random.Random(3)
    base = [f"w{g.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        words = list(base)
        for k in g.sample(range(400), 4):
            words[k] = f"e{i}{k}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{g.randrange(10**6)}" for _ in range(200))) for i in range(30)] + [(500, "one two"), (501, "One  TWO"), (502, "")]
    found = {r.doc_id: r for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i].class_id for i in range(30)} == {0}
    assert all(found[100 + i].class_id == 100 + i for i in range(30))
    assert found[501].class_id == 500 and found[502].class_id == 502
    assert [i for i in range(30) if found[i].kept] == [0]


def weighted_pairs(texts, at_least, df_bits=18, idf=1.25, rare=1 / 64):
    """All pairs of texts whose weighted Jaccard similarity, with the operator's weights, reaches ``at_least``."""
    import numpy as np

    sets = []
    for t in texts:
        w = substring_dedup._WORDS(t.lower())
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    of_bucket = {s: int(near_dedup.bucket(near_dedup.shingles([" ".join(s)])[0], 1 << df_bits)[0]) for s in {s for c in sets for s in c}}
    df = Counter(b for c in sets for b in {of_bucket[s] for s in c})
    weight = {s: 1 + (idf - 1) * min(1.0, math.log(df[b] / len(texts)) / math.log(rare)) for s, b in of_bucket.items()}
    total = [sum(n * weight[s] for s, n in c.items()) for c in sets]
    index, both = defaultdict(list), Counter()
    for i, c in enumerate(sets):
        for s, n in c.items():
            for j, m in index[s]:
                both[j, i] += min(n, m) * weight[s]
            index[s].append((i, n))
    return {p: x / (total[p[0]] + total[p[1]] - x) for p, x in both.items() if x / (total[p[0]] + total[p[1]] - x) >= at_least}


def test_weights_go_by_shares():
    """Not by the number of documents."""
    import numpy as np

    small, large = (near_dedup.idf_weights(np.array([1, 5, 50, 100]) * k, 100 * k, 1.25, 1 / 64) for k in (1, 10**6))
    assert np.allclose(small, large) and small[0] == 1.25 and small[-1] == 1.0


@pytest.fixture(scope="module")
def template_heavy():
    """Texts of one template and words of their own, and near copies of 40 of them."""
    g = random.Random(5)
    template = [f"t{g.randrange(10**6)}" for _ in range(260)]
    words = [template + [f"o{i}x{k}" for k in range(45)] for i in range(600)]
    for i in range(40):
        words.append(list(words[i]))
        for k in g.sample(range(260), 6):
            words[-1][k] = f"c{i}x{k}"
    texts = [" ".join(w) for w in words]
    pairs = weighted_pairs(texts, 0.8)
    assert set(pairs) == {(i, 600 + i) for i in range(40)}
    return list(enumerate(texts)), set(pairs)


def test_recall_of_pairs(spark):
    """Of all pairs of weighted similarity 0.8 or more, by brute force, short and long texts and edges of the threshold: all are in one class."""
    g = random.Random(12)
    texts = []
    for size in [60] * 30 + [300] * 20 + [2000] * 6 + [20_000] * 2:
        base = [f"b{len(texts)}x{g.randrange(size * 4)}" for _ in range(size)]
        texts.append(" ".join(base))
        for share in (0.004, 0.012, 0.02, 0.024):
            words = list(base)
            for k in g.sample(range(size), max(1, int(share * size))):
                words[k] = f"e{g.randrange(10**9)}"
            texts.append(" ".join(words))
    pairs = weighted_pairs(texts, 0.8)
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(pairs) > 250 and sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs)
    linked = weighted_pairs(texts, 0.7999)
    for i, c in found.items():  # a class is what links connect
        assert c == i or any((min(i, j), max(i, j)) in linked for j in found if j != i and found[j] == c)


def test_rows_go_by_id_and_text(spark):
    """A row that shares its id with a copy, but not its text, stays."""
    copy = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, copy), (2, copy), (2, " ".join(f"u{k}" for k in range(60)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:1]) for r in near_dedup.keep_rows(docs).collect()) == [(1, "w"), (2, "u")]


def test_near_copies_under_a_template(spark, template_heavy):
    """Pairs of which neither is the centre of a bucket that others of the template fill."""
    rows, pairs = template_heavy
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i for i, _ in rows} | {b: a for a, b in pairs}


def test_near_copies_under_a_template_in_the_pipeline(spark, data, template_heavy):
    import corpus_pipeline as P

    rows, pairs = template_heavy
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(P.STAGES)["near dedup"](spark, docs, data).collect()
    assert sorted(r.doc_id for r in kept) == sorted({i for i, _ in rows} - {b for _, b in pairs})


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1, 1.0) for k in range(20)] + [(50, 60, 1.0), (55, 60, 1.0)], "a long, b long, similarity double")
    found = {r.id: r.label for r in near_dedup.components(links).collect()}
    assert {found[k] for k in range(21)} == {0} and {found[50], found[55], found[60]} == {50}


def test_sampling_follows_similarity():
    """The share of equal samples is near the weighted Jaccard similarity."""
    import numpy as np

    g = np.random.default_rng(1)
    h = np.sort(g.integers(0, 2**63, 300, dtype=np.uint64))
    a, b = (h[:250], np.ones(250)), (h[50:], np.full(250, 2.0))
    s = near_dedup.Sampler(2000)
    out = s(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([250, 250]))
    expected = near_dedup.similarity(a, b)
    assert abs((out[0] == out[1]).mean() - expected) < 0.05 and 0.3 < expected < 0.5


def test_samples_of_very_long_texts_differ():
    """Unrelated texts of more shingles than any table of random variables has, and a near copy."""
    import numpy as np

    h = np.random.default_rng(4).integers(0, 2**63, 600_000, dtype=np.uint64)
    a, b, c = h[:300_000], h[300_000:], h[15_000:315_000]
    s = near_dedup.Sampler(30)(np.concatenate([a, b, c]), np.ones(900_000), np.full(3, 300_000))
    assert (s[0] == s[1]).sum() == 0 and (s[0] == s[2]).mean() > 0.7


def brute_context_trees(training, stream):
    """Log10 probability of the stream's bytes, each by the ratio of the weighted trees with and without it."""
    depth = lm_scoring.DEPTH
    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def path(text, i):
        before = (lm_scoring.END * depth + text[:i])[::-1][:depth]
        return [before[:d] for d in range(depth + 1)]

    def steps(byte):
        return [((1 << b) | byte >> (8 - b), byte >> (7 - b) & 1) for b in range(8)]

    for text in training:
        for i, byte in enumerate(text):
            for node, bit in steps(byte):
                for c in path(text, i):
                    counts[c, node][bit] += 1
                    if c:
                        kids[c[:-1], node].add(c)

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def weighted(c, node, extra, bit, known={}):
        n0, n1 = counts.get((c, node), (0, 0))
        on_path = extra is not None and extra[len(c)] == c
        if on_path:
            n0, n1 = n0 + (bit == 0), n1 + (bit == 1)
        own = kt(n0, n1)
        if len(c) == depth:
            return own
        below = kids.get((c, node), set()) | ({extra[len(c) + 1]} if on_path else set())
        product = sum(weighted(k, node, extra if on_path and extra[len(c) + 1] == k else None, bit) for k in below)
        return math.log(0.5) + max(own, product) + math.log1p(math.exp(-abs(own - product)))

    total = 0.0
    for i, byte in enumerate(stream):
        for node, bit in steps(byte):
            total += weighted(b"", node, path(stream, i), bit) - weighted(b"", node, None, bit)
    return total / math.log(10)


def test_context_trees_by_brute_force(spark):
    texts = ["the cat sat on the mat", "the cat ate the rat", "Größe der Häuser", None, "the hat that sat", "a cat", "漢字 cat", "the the the"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    assert any(held) and not all(held)
    found = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    streams = [lm_scoring.stream_of(lm_scoring.tokens_of(t)) for t in texts]
    training = [s for s, h in zip(streams, held) if not h]
    for i, s in enumerate(streams):
        assert found[i].held_out == held[i] and found[i].n_bytes == len(s)
        assert found[i].score == pytest.approx(brute_context_trees(training, s), rel=1e-5)


def test_grams_of_blocks_are_those_of_the_whole(spark, monkeypatch):
    """Blocks of few bytes and one block give the same scores."""
    g = random.Random(8)
    rows = [(i, " ".join(g.choice(["red", "blue", "green", "houses", "trees"]) for _ in range(g.randrange(60)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    one = {r.doc_id: (r.score, r.base_score) for r in lm_scoring.score(df).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 2048)
    many = {r.doc_id: (r.score, r.base_score) for r in lm_scoring.score(df).collect()}
    assert all(one[i] == pytest.approx(many[i], rel=1e-6) for i in one)


def test_with_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_scoring.score(spark.createDataFrame([(held, "a")], "doc_id long, text string")).first()
    assert row.score == pytest.approx(3 * 8 * math.log10(0.5), rel=1e-5) and row.train_tokens == 0 and row.base_score == 0


def test_language(odd, empty):
    found = {r.doc_id: r for r in langid.identify(odd).collect() if r.doc_id is not None}
    assert found[3].lang_pred == found[5].lang_pred == found[11].lang_pred == "und" and found[11].score == 0
    model = langid.Model({"en": {"the": 9, "house": 2}, "de": {"das": 8, "haus": 3}})
    said = [x[0] for x in model.predict(["the the house", "das haus", None, "hausdas", "12"])]
    assert said == ["en", "de", "und", "de", "und"]
    for text in ("½ ² Ⅻ", "①", "²", "Ⅻ", "٣ 12", "̈ _ 🙂"):
        assert not any(map(str.isalpha, text)) and model.predict([text]) == [("und", 0.0)]
    assert model.predict(["½ the"])[0][0] == "en" and langid.words_of("x² ½ Ⅻ a") == ["x²", "a"]


def test_language_by_brute_force():
    """Known words by log frequency, others by the longest known n-grams from left to right."""
    g = random.Random(9)
    letters = {"a": "abcde", "b": "cdefg", "c": "aegxy"}
    counts = {k: Counter("".join(g.choice(v) for _ in range(g.randrange(1, 7))) for _ in range(80)) for k, v in letters.items()}
    model = langid.Model(counts)
    vocabulary = {w for c in counts.values() for w in c}

    def logs(of):
        items = {x for c in of.values() for x in c}
        return {x: [math.log((of[k][x] + 0.5) / (sum(of[k].values()) + 0.5 * len(items))) for k in "abc"] for x in items}

    words = logs(counts)
    parts = {}
    for n in range(1, 5):
        parts[n] = logs({k: sum((Counter({x: m * langid.grams(w, n).count(x) for x in set(langid.grams(w, n))}) for w, m in c.items()), Counter()) for k, c in counts.items()})

    def backed(w):
        marked, at, seen = f"^{w}$", 0, []
        while at < len(marked):
            n = next((n for n in range(4, 0, -1) if marked[at : at + n] in parts[n] and at + n <= len(marked)), 0)
            seen += [parts[n][marked[at : at + n]]] if n else []
            at += max(n, 1)
        return [sum(x) / len(seen) for x in zip(*seen)] if seen else [0.0] * 3

    for _ in range(200):
        text = [g.choice(sorted(vocabulary)) if g.random() < 0.5 else "".join(g.choice("abcdefgxyz") for _ in range(g.randrange(1, 8))) for _ in range(g.randrange(1, 12))]
        total = [sum(x) for x in zip(*[words[w] if w in vocabulary else backed(w) for w in text])]
        best = max(range(3), key=lambda k: (total[k], -k))
        share = 1 / sum(math.exp((t - total[best]) / len(text)) for t in total)
        assert model.predict([" ".join(text)])[0] == ("abc"[best], pytest.approx(share))


def test_language_sample(spark):
    """So many rows of each language, also of a rare one, whatever the others' number."""
    rows = [(i, f"text {i}", "en") for i in range(3000)] + [(i, f"rare {i}", "xx") for i in range(3000, 3020)] + [(None, f"none {i}", "yy") for i in range(2000)]
    df = spark.createDataFrame(rows, "_id long, text string, lang string")
    many = {r.lang: r["count"] for r in langid.sample(df, 200).groupBy("lang").count().collect()}
    assert many["xx"] == 20 and 140 < many["en"] < 270 and 140 < many["yy"] < 270


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), "abc"[i % 3]) for i in range(600)] + [(None, None, None), (700, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = mixing.mix(docs).select("doc.source", "size", "source_size", "target", "copies").toPandas()
    total = told["size"].sum()
    assert told.groupby("source", dropna=False).target.first().sum() == pytest.approx(1.5 * total)
    assert told.copies.max() <= 2
    for _, g in told.groupby("source", dropna=False):
        assert (g.copies * g["size"]).sum() == pytest.approx(g.target.iloc[0], abs=2.0 * int(g["size"].max()))
        assert g.target.iloc[0] <= 2 * g["size"].sum() + 1e-9
    again = mixing.mix(docs.repartition(5)).select("doc.doc_id", "copies").toPandas().sort_values("doc_id")
    assert again.copies.tolist() == mixing.mix(docs).select("doc.doc_id", "copies").toPandas().sort_values("doc_id").copies.tolist()


def test_quality_counts():
    assert quality.counts_of("a b c a b c\nx\nx\n\n") == (8, 8, 0, 1, 6)
    assert quality.counts_of("# a|b") == (2, 4, 2, 0, 0)
    assert quality.repeated_words("a a a a".split()) == 4


def test_quality_hosts(spark):
    """A host of bad documents goes as a whole; one that breaks a soft rule often is held to it; others are spared."""
    good, bad = " ".join(f"word{k}" for k in range(80)), "too few"
    soft = good + " " + "# " * 30
    rows = [(i, soft if i % 50 == 0 else good, f"fine{i % 37}") for i in range(4000)]
    rows += [(5000 + i, bad if i % 5 else good, "poor") for i in range(60)] + [(6000 + i, good if i % 5 else soft, "noisy") for i in range(60)]
    rows += [(7000, good, "new"), (7001, bad, "new2"), (7002, soft, None)]
    found = {r.doc_id: r for r in quality.judge_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("row.doc_id", "base_failed", "host_rejected", "kept").collect()}
    assert found[0].kept and found[1].kept and found[50].kept
    assert found[5000].host_rejected and not found[5000].base_failed and not found[5000].kept
    assert found[6000].host_rejected and not found[6000].base_failed and not found[6000].kept and found[6001].kept
    assert found[7000].kept and found[7001].base_failed and not found[7001].host_rejected


def test_equal_hosts_are_spared(spark):
    good, bad = " ".join(f"word{k}" for k in range(80)), "too few"
    rows = [(i, bad if i // 10 % 10 == 0 else good, f"h{i % 10}") for i in range(1000)]
    told = quality.judge_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert told.where("host_rejected").count() == 0 and told.where("kept").count() == 900


@pytest.mark.parametrize("size", [50, 300])
def test_hosts_that_differ_by_chance_are_spared(spark, size):
    """Whatever their sizes; and planted bad hosts among them are found."""
    good, bad, noisy = " ".join(f"word{k}" for k in range(80)), "too few", " ".join(f"word{k}" for k in range(80)) + " " + "# " * 30
    draw = random.Random(size)
    one = lambda: draw.choices([good, bad, noisy], [0.9, 0.04, 0.06])[0]
    rows = [(h * 10_000 + i, one(), f"h{h}") for h in range(20) for i in range(size)] + [(900_000 + i, one(), "large") for i in range(5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.judge_rows(docs).where("host_rejected").count() == 0
    planted = [(950_000 + i, draw.choices([good, bad], [0.1, 0.9])[0], "bad") for i in range(size)] + [(970_000 + i, draw.choices([good, noisy], [0.55, 0.45])[0], "noisy") for i in range(size)]
    told = quality.judge_rows(docs.unionByName(spark.createDataFrame(planted, docs.schema))).select("row.doc_id", "row.source", "row.text", "host_rejected").collect()
    assert {r.doc_id for r in told if r.host_rejected} == {i for i, t, h in planted if h == "bad" or t == noisy}


URLS = [
    ("https://Example.com/en/a", "example.com", "/en/a", "example.com/en/", "block"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/x?y#z", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://x.net/de/", "x.net", "/de/", None, "allow"),
    ("http://example.com", "example.com", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://com.evil.org/en/", "com.evil.org", "/en/", None, "allow"), ("http:///p", "", "/p", None, "allow"),
]


def test_urls(spark):
    from folioflow.llm.queries import URL_RULES

    pages = spark.createDataFrame([(k, u[0], "h", "clash") for k, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, host string, _key string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found = url_rules.judge_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict").collect()
    assert {r.page_id: tuple(r)[1:] for r in found} == {k: u[1:] for k, u in enumerate([*URLS, URLS[0]])}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_urls_by_brute_force(spark):
    g = random.Random(5)
    label = lambda: g.choice(["a", "b", "c", "a-b", "ab"])
    host = lambda: ".".join(label() for _ in range(g.randrange(1, 5)))
    path = lambda: g.choice(["", "/", "/x", "/x/y", "/z"])
    rules = sorted({(host(), path()): g.choice(["allow", "block"]) for _ in range(60)}.items())
    urls = [(k, f"http://{host()}{path()}{g.choice(['', 'q', '/r'])}") for k in range(500)]
    found = url_rules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string"))
    for r in found.select("row.page_id", "host", "path", "rule", "verdict").collect():
        fit = [(-len(h + p), -len(h), h + p, v != "block", v) for (h, p), v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = min(fit, default=None)
        assert (r.rule, r.verdict) == ((best[2], best[4]) if best else (None, "allow"))


def test_chat(spark):
    rows = [
        (1, 0, "system", "rules", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", None, 1), (1, 3, None, "x", 1), (1, 40, "ann", "late", 1), (2, 0, "system", "alone", 1),
        (None, 0, "ann", "no id", 1), (3, 0, "ann", "same", 1), (3, 0, "ann", "same", 1), (4, None, "ann", "when", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    found = {(r.conv_id, r.perspective, r.piece): r for r in chat.rotate(df).collect()}
    ann = found[1, "ann", 0]
    assert ann.rendered == (
        "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n"
    )
    assert [ann.rendered[m.start : m.start + m.length] for m in ann.mask] == ["hi<|im_end|>\n"]
    assert ann.n_chars == len(ann.rendered) and found[1, "bob", 1].mask == []
    assert {k[1] for k in found if k[0] == 1} == {"ann", "bob", "unknown"} and not any(k[0] == 2 for k in found)
    assert found[None, "ann", 0].n_turns == 1 and found[3, "ann", 0].n_turns == 2 and found[4, "ann", -1].n_turns == 1
    assert chat.rotate(df.limit(0)).count() == 0


SPECIAL = "before <|endoftext|> after<|endoftext|>"


def test_packing(spark, odd, empty):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 2] + [_row(20, SPECIAL)]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    found = packing.pack(docs).collect()
    check_pieces(found, [(r[0], r[1]) for r in rows])
    assert packing.pack(empty).count() == 0
    pieces = packing.pack(odd).collect()
    ids = packing.encoder(packing.default_tokenizer())
    assert sum(r.length for r in pieces) == sum(len(ids(r[1] or "")) + 1 for r in ROWS)
    assert {r.doc_id for r in pieces} == {r[0] for r in ROWS}


def test_ids_are_those_of_the_library():
    """Also of added tokens, which are one id, and of all kinds of characters."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, ours = Tokenizer.from_file(path), packing.encoder(path)
    g = random.Random(6)
    texts = [SPECIAL, "", " ", "a  b\n\n c\t", "x" * 5000, "<|endoftext|", "it's 1234 we'LL"] + ["".join(chr(g.choice([32, 10, g.randrange(33, 127), g.randrange(160, 0x3000), g.randrange(0x1F300, 0x1FA00)])) for _ in range(60)) for _ in range(300)]
    assert whole.encode(SPECIAL, add_special_tokens=False).ids.count(50256) == 2
    for t in texts:
        assert ours(t) == whole.encode(t, add_special_tokens=False).ids


def brute_round_robin(queues, rates, window, grain):
    """(document, start, place) of every id: counters grow by the quantum each round, and queues give whole units. A queue without a rate is last."""
    at, place, out = dict.fromkeys(queues, 0), 0, []
    counter = dict(zip(sorted(queues), packing.Schedule([0] * len(queues), [0.0] * len(queues), window, grain).begun.tolist()))
    flat = {q: [(d, k) for d, n in docs for k in range(n)] for q, docs in queues.items()}
    while any(at[q] < len(flat[q]) for q in queues if rates[q]):
        for q in sorted(queues):
            counter[q] += rates[q] * window
            units = int(counter[q] // grain)
            counter[q] -= units * grain
            for d, k in flat[q][at[q] : at[q] + units * grain]:
                out.append((d, k, place))
                place += 1
            at[q] += units * grain
    for q in sorted(queues):
        if not rates[q]:
            for d, k in flat[q]:
                out.append((d, k, place))
                place += 1
    return sorted(out)


@pytest.mark.parametrize("grain", [1, 8, 40])
def test_round_robin_by_brute_force(spark, grain):
    g = random.Random(grain)
    rates = {"a": 0.5, "b": 0.25, "c": 0.1875, "d": 0.0625, "e": 0.0}
    rows = [(i, "w" + " w" * g.randrange(400), g.choice("abcde")) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    found = packing.pack(df, window=128, grain=grain, targets=rates, own_share=1 / 64).collect()
    sizes = {r.doc_id: r.doc_tokens for r in found}
    queues = {s: [(i, sizes[i]) for i, _, t in rows if t == s] for s in rates}
    expected = brute_round_robin(queues, rates, 128, grain)
    assert sorted((r.doc_id, r.start + k, r.sequence_id * 128 + r.offset + k) for r in found for k in range(r.length)) == expected


def test_windows_keep_to_targets(spark):
    """Of rows sorted by source, and shuffled ones: every full window is within a twentieth of the sources' shares, on average, and a tenth, in all."""
    rows = [(i, "some words of a text " * (2 + i % 7), f"s{i // 600:02}") for i in range(12_000)]
    for order in (rows, random.Random(1).sample(rows, len(rows))):
        found = packing.pack(spark.createDataFrame(order, "doc_id long, text string, source string")).toPandas()
        found["source"] = found.doc_id // 600
        shares = found.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0) / 1024
        shares = shares[shares.sum(axis=1) == 1].iloc[:-1]
        target = found.groupby("source").length.sum() / found.length.sum()
        away = abs(shares - target).sum(axis=1) / 2
        assert shares.shape[1] == 20 and away.mean() < 0.05 and away.max() < 0.1


def test_rare_sources_share_queues(spark):
    rows = [(i, "a text of words", f"s{i}") for i in range(3000)] + [(10_000 + i, "a text of words", "big") for i in range(3000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), own_share=0.01).toPandas()
    check_pieces(list(found.itertuples()), [(i, t) for i, t, _ in rows])
    big = found[found.doc_id >= 10_000].groupby("sequence_id").length.sum()
    assert ((big.iloc[:-1] - 512).abs() < 100).all()


def test_pipeline_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as P

    from folioflow.llm.common import materialise

    for docs, left in ((odd, True), (empty, False)):
        for name, f in P.STAGES[:-1]:
            docs = materialise(f(spark, docs, ""), "test-odd")
            assert docs.columns == KIND.replace(",", "").split()[::2]
        assert (P.STAGES[-1][1](spark, docs, "").count() > 0) == left
