"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a logistic classifier over hashed byte 3-grams
learns which languages have it. A text's language is the one whose codeword has the least
logistic loss under the classifiers' margins, and the score is the softmax of the negated
losses. A text is ambiguous where that is below AMBIGUOUS.

Up to six languages have all splits as their bits; of more, codewords are drawn, the draw with
the largest least distance of fifty, with bits in proportion to the logarithm of their number.

The classifiers are fitted on the driver on a bounded sample: about ``per_lang`` labelled
texts of each language, and ``most`` of all, chosen by a hash of doc_id and text. Of a text of more
than ``max_chars`` characters, that many from its first letter on are taken.
Prediction reads whole texts, lower-cased, with ASCII characters that are not letters taken
as spaces. Texts that are null or have no letter, and all texts where nothing is labelled,
are ``und`` with score 0. Null langs are never learned from. Codewords that tie give the first
of the languages by name. Equal texts have equal predictions, whatever their ids, repeated rows
count as often as they are there, and an empty table gives an empty result. Further columns
may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, lookup

FEATURES = 1 << 13
PER_LANG, MOST, MAX_CHARS = 400, 8_000, 20_000  # 8,000 texts are 260 MB of features
STEPS, RATE, DECAY = 60, 0.3, 1e-5
AMBIGUOUS = 0.5
CHUNK = 1 << 20
MULTIPLIER = 2654435761
BLANK = ((0x202020 * MULTIPLIER) & 0xFFFFFFFF) >> 19  # three spaces
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Square roots of the frequencies of the hashed byte 3-grams."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace").translate(SPACED)
    b, n = np.frombuffer(raw, np.uint8), np.zeros(FEATURES, np.int64)
    for at in range(0, max(1, len(b) - 2), CHUNK):
        c = b[at : at + CHUNK + 2].astype(np.uint32)
        code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
        n += np.bincount((code * np.uint32(MULTIPLIER)) >> np.uint32(19), minlength=FEATURES)
    n[BLANK] = 0
    return np.sqrt(n / max(1, n.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n languages: all splits of few, well-spread ones of many."""
    if n <= 6:
        rows = np.array([[(k >> i) & 1 for k in range(1, 1 << max(1, n - 1))] for i in range(n - 1)] + [[0] * ((1 << max(1, n - 1)) - 1)]) if n > 1 else np.ones((1, 1))
        return rows.astype(np.float32) * 2 - 1
    bits, best, apart = 15 + ceil(10 * log2(n)), None, -1
    rng = np.random.default_rng(7)
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        split = np.abs(m.sum(0)) < n
        d = min(int((m[i, split] != m[j, split]).sum()) for i in range(n) for j in range(i))
        if d > apart:
            best, apart = m[:, split], d
    return best


def fitted(texts: list[str], langs: list[str]) -> dict:
    """Weights of the classifiers, by full-batch steps of an adaptive gradient."""
    names = sorted(set(langs))
    code = codewords(len(names))
    x = np.stack([grams(t) for t in texts])
    own = np.array([names.index(v) for v in langs])
    y = code[own]
    weight = (1 / np.bincount(own))[own][:, None].astype(np.float32) / len(names)  # languages count alike
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(STEPS):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * weight
        dw, db = x.T @ g + DECAY * w, g.sum(0)
        gw += dw * dw
        gb += db * db
        w -= RATE * dw / np.sqrt(gw)
        b -= RATE * db / np.sqrt(gb)
    return {"names": names, "code": code, "w": w, "b": b}


def decoded(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best codeword of each row and its score."""
    loss = np.logaddexp(0, -model["code"][None] * (x @ model["w"] + model["b"])[:, None, :]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    at = loss.argmin(1)
    return at, p[np.arange(len(p)), at]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def trained(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS, most: int = MOST) -> dict | None:
    """The model of the labelled documents; None without any."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = Scratch(docs.sparkSession).put(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang")), "langs")
    langs = counts.count()
    if not langs:
        return None
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    window = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{max_chars - 1}}}", 0)
    text = F.when(F.char_length("text") <= max_chars, F.col("text")).otherwise(window)
    drawn = lookup(rows, counts, "lang", "inner").where(draw < min(per_lang, most / langs) / F.col("n_lang"))
    sample = sorted(r for r in drawn.select(text.alias("text"), "lang").collect() if LETTER.search(r["text"]))
    return fitted([r["text"] for r in sample], [r["lang"] for r in sample]) if sample else None


def predicted(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with a last column, the struct of lang_pred, score and ambiguous."""
    name = fresh(docs, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if m and t is not None and LETTER.search(t)]
            for k in range(0, len(at), 256):
                own = at[k : k + 256]
                best, p = decoded(m, np.stack([grams(texts.iloc[i]) for i in own]))
                lang[own], score[own] = np.array(m["names"], object)[best], p
            yield pd.DataFrame({"lang_pred": lang, "score": score, "ambiguous": score < AMBIGUOUS})

    return docs.withColumn(name, predict(F.col("text")))


def spoken_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is told without ambiguity, with the columns of docs; a null lang is filled."""
    out = predicted(docs, trained(docs))
    name = out.columns[-1]
    out = out.where((F.col(f"{name}.lang_pred") != UND) & ~F.col(f"{name}.ambiguous"))
    return out.withColumn("lang", F.coalesce("lang", F.col(f"{name}.lang_pred"))).select(*docs.columns)


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document; only two of three documents are learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predicted(docs.select("doc_id", "text"), trained(docs))
    return out.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")
