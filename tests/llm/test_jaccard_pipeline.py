"""The Jaccard join against brute force, and the pipeline's stages."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import jaccard
from millrace.llm.common import Scratch


def shingle_set(text, k):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def components(rows, k, num, den):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        s, t = sets[a][1], sets[b][1]
        if s and t and len(s & t) * den >= len(s | t) * num:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted((str(i), len(s), str(least.get(find(a))) if s else str(i)) for a, (i, s) in enumerate(sets))


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def put(text):
        nonlocal n
        rows.append((n * 7 % 1009, text))
        n += 1

    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 6, 11, 40, 150]))]
        put(" ".join(base))
        for _ in range(r.randint(0, 8)):
            now = list(base)
            for _ in range(r.randint(0, max(1, len(now) // 40))):
                now[r.randrange(len(now))] = r.choice(words)
            put("  ".join(now).upper() if r.random() < 0.3 else "\n".join(now))
            if r.random() < 0.5:
                base = now  # chains: ends need not link
    for t in (None, "", "   ", None, "one", "ONE", "two words", "Two  Words", "É é", "é É", "long " * 3 + " ".join(words * 30), "long " * 3 + " ".join(words * 30) + " end"):
        put(t)
    return rows


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 3, 9, 10), (2, 5, 4, 5), (3, 1, 1, 2)])
def test_components_match_brute_force(spark, seed, k, num, den):
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    out = jaccard.linked(d, Scratch(spark), k, num, den).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == components(rows, k, num, den)


def test_pairs_that_stay_open_are_joined(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = corpus(4)
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 3, 4, 5).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == components(rows, 3, 4, 5)


def test_rows_that_share_ids_and_null_ids(spark):
    t = " ".join(f"v{i}" for i in range(50))
    rows = [(5, t), (5, t), (None, t + " z"), (None, "alone here now"), (9, "alone here now"), (3, t + " y")]
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 3, 9, 10).collect()
    assert sorted((str(x["doc_id"]), x["component_id"]) for x in out) == [("3", 3), ("5", 3), ("5", 3), ("9", 9), ("None", 3), ("None", 9)]
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark)).count() == 0


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_keys_of_any_similar_pair_meet(num, den):
    rng = np.random.default_rng(5)
    draw = lambda n: np.frombuffer(rng.bytes(8 * n), np.uint64)
    schemes, pairs = jaccard.Schemes(num, den, 0.5), 0
    for t in range(3000):
        n = int(rng.integers(1, 30 if t % 2 else 400))
        a = draw(n)
        apart = int(2 * n * (den - num) / (den + num)) + 1
        gone = int(rng.integers(0, apart + 1))
        b = np.concatenate([a[gone:], draw(max(0, apart - gone))])
        a, b = np.unique(a), np.unique(b)
        i = len(np.intersect1d(a, b))
        if len(b) and i * den >= (len(a) + len(b) - i) * num:
            pairs += 1
            large, small = (a, b) if len(a) >= len(b) else (b, a)
            own, _, spare = schemes.keys(large)
            other = np.concatenate(schemes.keys(small)[:2])
            # whichever keys the larger set leaves out of its lookups, as many as it can spare, one is left
            assert len(np.intersect1d(own, other)) > spare >= 0
    assert pairs > 300


def near_copies(n, edits, seed):
    r = random.Random(seed)
    base, fresh = [f"b{i}" for i in range(220)], iter(range(10**9))
    out = []
    for _ in range(n):
        now = list(base)
        for at in r.sample(range(220), r.randint(*edits)):
            now[at] = f"e{next(fresh)}"
        out.append(" ".join(now))
    return out


def test_near_copies_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """A group whose sets share most of their keys but don't link, and among them some that do."""
    texts = near_copies(400, (4, 10), 1)
    r = random.Random(2)
    linked = [f"{t} tail{i}" for i, t in enumerate(r.sample(texts, 40))]
    rows = list(enumerate(r.sample(texts + linked, 440)))
    made, plain = [], jaccard.Join.candidates
    monkeypatch.setattr(jaccard.Join, "candidates", lambda self, rows: made.append((pairs := plain(self, rows)).count()) or pairs)
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 3, 9, 10).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == components(rows, 3, 9, 10)
    assert len({x["component_id"] for x in out}) == 400
    assert len(made) == 1 and made[0] < 1000  # of 96,580


@pytest.mark.parametrize("seed", range(3))
def test_groups_by_their_differences_match_brute_force(spark, monkeypatch, seed):
    """Copies around the threshold, by words that are replaced, dropped and shared by families."""
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    r = random.Random(seed)
    base, texts = [f"b{i}" for i in range(60)], []
    for _ in range(150):
        now = list(base)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(now))
            now[at : at + 1] = r.choice([[], [f"x{r.randrange(12)}"], [f"y{r.random()}"], [now[at], "z"]])
        texts.append(" ".join(now))
    rows = list(enumerate(texts))
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 3, 9, 10).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == components(rows, 3, 9, 10)


def test_components_of_a_chain(spark):
    s = Scratch(spark)
    edges = s.put(spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (103, 101)], "a long, b long")), "e")
    out = {x["x"]: x["root"] for x in jaccard.components(edges, s, "t").collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}


def test_pipeline_stages(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(3, 8))) for _ in range(120)) + "."
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(150)]
    copies = [(500 + i, rows[i][1], "en", "s0", 0) for i in range(10)] + [(600 + i, rows[i][1] + " tail", "en", "s1", 0) for i in range(10)]
    junk = [(700, "too short", "en", "s0", 0), (701, None, None, None, None), (702, "Und " * 300, "en", "s0", 0)]
    docs, seen = spark.createDataFrame(rows + copies + junk, "doc_id long, text string, lang string, source string, n_chars long"), []
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = scratch.put(stage(spark, docs, ""), f"s{i}")
        seen.append(docs)
    assert [c.columns for c in seen[:4]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    ids = [{x["doc_id"] for x in d.collect()} for d in seen[:4]]
    assert ids[0] == ids[1] == {x[0] for x in rows + copies}
    assert ids[2] == {x[0] for x in rows}
    words = sum(len(x[1].split()) for x in rows)
    assert abs(seen[3].select(F.sum(F.size(F.split("text", " ")))).first()[0] - 1.5 * words) <= 6
    assert seen[4].agg(F.sum("length")).first()[0] == sum(x["doc_tokens"] for x in seen[4].where("start = 0").collect())


def test_first_of_each_decides_by_row(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    a, b, c, d, e, f = map(text, "abcdef")
    rows = [(3, a), (5, a + " z"), (5, b), (9, c), (9, d), (7, e), (7, e), (None, f), (None, f + " z"), (None, f), (None, a), (1, None), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("x")).withColumn("row", F.lit(1)).repartition(3)
    out = jaccard.first_of_each(docs, Scratch(spark))
    got = sorted(((x["doc_id"], x["text"]) for x in out.collect() if x["doc_id"] is not None), key=str)
    assert out.columns == docs.columns
    assert got == sorted([(3, a), (5, b), (9, c), (9, d), (7, e), (1, None), (2, "")], key=str)
    assert [x["text"] in (f, f + " z") for x in out.where("doc_id is null").collect()] == [True]


def count_tried(monkeypatch, made):
    plain = jaccard.Join.sifted
    monkeypatch.setattr(jaccard.Join, "sifted", lambda self, pairs: made.append(pairs.count()) or plain(self, pairs))


def test_rounds_end_when_they_link_nothing(spark, monkeypatch):
    """A group that stays open as it is isn't tried again and again, which made nodes times keys of rows a round."""
    rows, tried = list(enumerate(near_copies(150, (4, 10), 3))), []
    count_tried(monkeypatch, tried)
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 3, 9, 10).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == components(rows, 3, 9, 10)
    assert len(tried) < 3


def test_sets_near_the_consensus_link_without_pairs(spark, monkeypatch):
    """Copies that lack the same passages: the pairs of those that share one grow with the square of the group."""
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    r, texts, made = random.Random(5), [], []
    for i in range(160):
        now = [f"b{j}" for j in range(140)]
        for at in sorted(r.sample(range(140), r.randint(1, 2) if i % 2 else r.randint(3, 5)), reverse=True):
            now[at] = f"e{i}x{at}"
        texts.append(" ".join(now))
    rows, plain = list(enumerate(texts)), jaccard.Join.candidates
    monkeypatch.setattr(jaccard.Join, "candidates", lambda self, rows: made.append((pairs := plain(self, rows)).count()) or pairs)
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), 5, 4, 5).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in out) == components(rows, 5, 4, 5)
    assert len(made) == 1 and made[0] < 150  # 189 with the pairs of sets that link with the nearest anyway
