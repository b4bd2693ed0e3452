"""Toxicity by noisy-channel deobfuscation.

Spans that may be disguised (letters with leetspeak signs, spaced-out letters, repeated
letters) are lattices: each character read may stand for itself, for letters that look like
it, or for nothing, at a cost each. Viterbi's path of least cost under a character 3-gram
model restores the span; all else is kept. The restored text's words are then scored by a
logistic classifier. The search is exact: no state is pruned, whatever the span's length.

The language model's counts come from all documents. The classifier learns from a bounded
sample of labelled rows, at most about ``per_label`` texts of each label, and takes the
``most_words`` words whose document counts differ most between the labels (G test of GIVES_WAY or
more). Its weights start at half the words' log ratios, so that words that mostly stand
beside others are worth something alone. Both labels weigh alike in its loss, so 0.5 is where the evidence is even.

Null and empty texts have no words and get the score of no evidence; where no row is labelled
toxic, or none clean, all scores are 0. A document is toxic where any of its label rows says
so; null labels and labels of no document are left out. Equal texts get equal scores,
whatever their ids; repeated rows are scored one by one. An empty table gives an empty result.
Further columns may have any name; labels, lang, source and doc_id take no part in a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, lookup

# The letters that a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
# Costs in nats: a sign for a letter, a sign for no letter, a letter the second time, the third time and on, a joint between words, a joint within.
SIGN, LITERAL, TWICE, AGAIN, BREAK, JOIN = 1.0, 6.0, 1.5, 0.3, 2.0, 0.1

PER_LABEL, MOST_WORDS = 10_000, 500
GIVES_WAY, LEAST_TEXTS = 10.83, 3  # a chance of one in a thousand
STEPS, RATE, DECAY = 100, 0.1, 1e-4
CACHED, CACHED_LENGTH = 50_000, 64
CHUNK = 1 << 20

SYMBOLS = 28  # 0: no letter, 1 to 26: a to z, 27: bytes of other letters
CODES = bytes(b - 96 if 97 <= b <= 122 else 27 if b >= 128 else 0 for b in range(256))
WORD = re.compile(r"[^\W_]+")
_SIGNS = r"0-9@$!|+€*"
#: Letters with signs among or before them; letters three times or more, or three in a row twice each; single letters or signs, or pairs of them, kept apart by marks.
SUSPECT = re.compile(
    rf"(?<![^\W_])(?:(?P<spaced>[^\W_@$!](?:[ \t][^\W_@$!]){{2,}})|(?P<marked>[^\W_]{{1,2}}(?:[.\-_*/·~][^\W_]{{1,2}}){{2,}}))(?![^\W_])"
    rf"|(?<![^\W_])(?:[{_SIGNS}]*[^\W\d_]+[{_SIGNS}]+(?=[^\W\d_])|[0-9@$|+€]+(?=[^\W\d_]))[^\W_{_SIGNS}]*(?:[{_SIGNS}]+(?=[^\W_])|[^\W_])*[0-9]*"
    r"|(?<![^\W_])[^\W\d_]*?(?:([^\W\d_])\3\3|(?:([^\W\d_])\4){3})[^\W_]*"
)


def symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def letter_counts(docs: DataFrame) -> np.ndarray:
    """How often each three symbols follow one another, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                raw = f"  {(text.as_py() or '').lower()} ".encode("utf-8", "replace").translate(CODES)
                for at in range(0, len(raw) - 2, CHUNK):
                    c = np.frombuffer(raw[at : at + CHUNK + 2], np.uint8).astype(np.int32)
                    n += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["gram", "n"])

    counts = np.zeros(SYMBOLS**3)
    for gram, n in docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect():  # at most 28 ** 3 rows
        counts[gram] = n
    return counts.reshape((SYMBOLS,) * 3)


def letter_costs(counts: np.ndarray, weight: float = 5.0) -> list[float]:
    """Negated logarithms of each symbol's probability after two others, backed off to one and none."""
    c1 = counts.sum((0, 1)) + 1
    p1 = c1 / c1.sum()
    c2 = counts.sum(0)
    p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
    p3 = (counts + weight * p2) / (counts.sum(2, keepdims=True) + weight)
    return (-np.log(p3)).ravel().tolist()


class Restorer:
    """Restores lower-case texts under a model of letters."""

    def __init__(self, costs: list[float]):
        self.costs = costs
        self.cached = lru_cache(CACHED)(self.decoded)

    def choices(self, ch: str, times: int, apart: bool) -> list[tuple[str, float]]:
        """What a character may stand for, each at its cost; an empty string is nothing."""
        if apart:
            return [(" ", BREAK), ("", JOIN)]
        own = [(ch, 0.0)] if ch.isalpha() else [(" ", LITERAL)]
        return own + [(x, SIGN) for x in LOOKS_LIKE.get(ch, "")] + ([("", TWICE if times == 2 else AGAIN)] if times > 1 else [])

    def decoded(self, span: str, joints: bool) -> str:
        """The cheapest reading of a span; ``joints`` tells that marks and spaces keep its letters apart."""
        costs, states, before, times = self.costs, {0: (0.0, None)}, "", 0
        for ch in span:
            apart = joints and not (ch.isalnum() or ch in "@$!")
            if not apart:
                before, times = ch, times + 1 if ch == before else 1
            reached: dict[int, tuple[float, tuple | None]] = {}
            for out, extra in self.choices(ch, times, apart):
                s = symbol(out) if out else 0
                for state, (cost, path) in states.items():
                    if out:
                        total, to, way = cost + extra + costs[state * SYMBOLS + s], state % SYMBOLS * SYMBOLS + s, (out, path)
                    else:
                        total, to, way = cost + extra, state, path
                    if to not in reached or total < reached[to][0]:
                        reached[to] = total, way
            states = reached
        path = min((cost + costs[state * SYMBOLS], i, path) for i, (state, (cost, path)) in enumerate(states.items()))[2]
        read = []
        while path:
            read.append(path[0])
            path = path[1]
        return "".join(reversed(read))

    def text(self, text: str) -> str:
        """The whole text in lower case, its suspect spans restored."""

        def read(m: re.Match) -> str:
            joints = m["spaced"] is not None or m["marked"] is not None
            return (self.cached if len(m[0]) <= CACHED_LENGTH else self.decoded)(m[0], joints)

        return SUSPECT.sub(read, text.lower())

    def words(self, text: str | None) -> set[str]:
        return set(WORD.findall(self.text(text or "")))


def restored_words(docs: DataFrame, costs: list[float], keep: str) -> DataFrame:
    """``keep`` and the distinct words of each restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [sorted(restorer.words(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.string()))], [keep, "words"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} int, words array<string>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def drawn(rows: DataFrame, of: Column, by: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``by``, drawn by a hash; rows are few enough to be counted by value."""
    rates = {v: min(1.0, most / n) for v, n in rows.groupBy(by).agg(F.count(F.lit(1))).collect()}
    rate = F.coalesce(*[F.when(F.col(by) == v, F.lit(p)) for v, p in rates.items()], F.lit(0.0))
    return rows.where(F.pmod(of, F.lit(1 << 30)) / float(1 << 30) < rate)


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """toxic and text of the rows to learn from: ids are drawn first, then rows, as an id may have many."""
    flags = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    scratch = Scratch(docs.sparkSession)
    ids = scratch.put(drawn(flags, F.xxhash64(F.lit(13), "doc_id"), "toxic", per_label), "ids")
    rows = lookup(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), ids, "doc_id", "inner")
    rows = scratch.put(rows, "rows")
    return drawn(rows, F.xxhash64(F.lit(17), "doc_id", "text"), "toxic", per_label).select("toxic", "text")


def telling(found: DataFrame, most_words: int) -> list[str]:
    """The words whose counts of texts differ most between toxic and other rows."""
    total = found.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    t, n = total[0] or 0, total[1]
    if not 0 < t < n:
        return []
    counts = found.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("k"))
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, k = F.col("a"), F.col("k")
    g = 2 * (cell(a, k * t / n) + cell(k - a, k * (n - t) / n) + cell(t - a, (n - k) * t / n) + cell(n - t - k + a, (n - k) * (n - t) / n))
    best = counts.where(k >= LEAST_TEXTS).withColumn("g", g).where(F.col("g") >= GIVES_WAY).orderBy(F.desc("g"), "word").limit(most_words)
    return [r["word"] for r in best.collect()]


def fitted(found: DataFrame, most_words: int) -> dict | None:
    """Words, weights and bias of the classifier; None where one of the labels is missing."""
    words = telling(found, most_words)
    rows = found.select("toxic", F.array_intersect("words", F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("words")).collect()
    y = np.array([r["toxic"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    at = {w: i for i, w in enumerate(words)}
    x = np.zeros((len(rows), len(words)), np.float32)
    for i, r in enumerate(rows):
        x[i, [at[w] for w in r["words"]]] = 1
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    seen = [(x[y == v].sum(0) + 0.5) / ((y == v).sum() + 1) for v in (0, 1)]
    w, b, gw, gb = (np.log(seen[1] / seen[0]) / 2).astype(np.float32), -1.0, np.full(len(words), 1e-8, np.float32), 1e-8
    for _ in range(STEPS):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        dw, db = x.T @ g + DECAY * w, float(g.sum())
        gw += dw * dw
        gb += db * db
        w -= RATE * dw / np.sqrt(gw)
        b -= RATE * db / gb**0.5
    return {"weights": dict(zip(words, w.tolist(), strict=True)), "bias": b}


def trained(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_words: int = MOST_WORDS) -> dict:
    """The model of letters of all docs and the classifier of the labelled ones."""
    costs = letter_costs(letter_counts(docs))
    found = Scratch(docs.sparkSession).put(restored_words(sample(docs, labels, per_label), costs, "toxic"), "words")
    return {"costs": costs, "classifier": fitted(found, most_words)}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a last column, the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value["classifier"]
        restorer = Restorer(shared.value["costs"])
        for texts in parts:
            if not m:
                yield pd.Series(np.zeros(len(texts)))
                continue
            weights = m["weights"]
            sums = [sum(sorted(weights[w] for w in restorer.words(t) & weights.keys())) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float) + m["bias"], -30, 30))))

    return docs.withColumn(fresh(docs, "score"), score(F.col("text")))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; four of five are learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
