"""Grouping of spelling variants by rolling-hash deletions.

Two words are near if one code point inserted, deleted or replaced makes one the other. They
then share a string that is left by deleting one code point: of both at one place, if it was
replaced, or of the longer one alone. Polynomial hashes of a word's prefixes and suffixes give
the keys of all its deletions at once, H(prefix) + H(suffix) / B, in a few NumPy operations
for all words of one length. A task's keys, with places and words beside them, are dealt out
by their leading bits as packed arrays, sorted, and keys that meet are verified on the strings.

Words that share a key and a place differ only there, so at most as many as there are letters
meet; a key's own word and those one longer are at most letters times length. Of each such
group a word takes the number of the others and the best of them, never all pairs, so work and
shuffle are linear in the letters of the vocabulary.

A word's form is its near word with the largest count (ties: the smallest), if that is ``lead``
times the word's own or more; roots follow forms to their end by pointer doubling. Null texts
have no words. A null doc_id counts as an empty string where occurrences are damaged. Words
may be as long as a text. Repeated rows count as often as they are there. An empty table gives
an empty result. Only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LEAST_LENGTH, LEAST_COUNT, LEAD = 7, 2, 10
BLOCK_WORDS = 400_000  # distinct words that a task counts before it sends them on
BLOCK_KEYS = 2_000_000  # keys that a task makes or sorts at a time
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
OWN = -1  # the place of a key that is the whole word's
NEAR = "word string, n long, near long, best struct<n long, word string>"
PACKED = "bucket int, keys binary, places binary, owners binary, counts binary, words string"
BEST = pa.struct([("n", pa.int64()), ("word", pa.string())])

Damage = Callable[[object, str], str]


def lowered(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(LOWER)


def one_of_31(doc_id, word: str) -> str:
    """The word without one code point where 31 divides the CRC-32 of its id and itself."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, damage: Damage | None = None) -> DataFrame:
    """Words of LEAST_LENGTH code points and LEAST_COUNT occurrences or more, with their counts n.

    Occurrences of one word in one document are damaged alike, by ``damage(doc_id, word)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                own: Counter = Counter()
                for run_, n in Counter(WORD.findall(text.as_py() or "")).items():
                    if len(run_) >= LEAST_LENGTH:
                        own[lowered(run_)] += n
                doc_id = doc_id.as_py()
                for w, n in own.items():
                    w = damage(doc_id, w) if damage else w
                    if len(w) >= LEAST_LENGTH:
                        total[w] += n
                if len(total) >= BLOCK_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length, the keys of the whole word and of each deletion: both arrays have a row a word, the first column is the word's own."""
    length = len(words[0])
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)
    power = np.full(length, BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    prefix = np.zeros((len(words), length + 1), np.uint64)
    np.cumsum(c * power, 1, out=prefix[:, 1:])
    suffix = prefix[:, -1:] - prefix[:, 1:]  # of what follows each place
    keys = np.concatenate([prefix[:, -1:], prefix[:, :-1] + suffix * np.uint64(INVERSE)], 1)
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    keys ^= keys >> np.uint64(29)
    places = np.broadcast_to(np.arange(OWN, length, dtype=np.int32), keys.shape)
    return keys, places


def packed(words: list[str], counts: np.ndarray, tasks: int) -> Iterator[pa.RecordBatch]:
    """The keys of the words, sorted, a row for each task that they go to."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    parts = []
    for own in by_length.values():
        k, p = deletion_keys([words[i] for i in own])
        parts.append((k.ravel(), p.ravel(), np.repeat(np.array(own, np.int32), k.shape[1])))
    keys, places, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
    bucket = ((keys >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(tasks + 1))
    for b in range(tasks):
        at = order[ends[b] : ends[b + 1]]
        if len(at):
            used, owner = np.unique(owners[at], return_inverse=True)
            arrays = keys[at], places[at], owner.astype(np.int32), counts[used]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays), pa.array(["\n".join([words[i] for i in used])])], [x.split()[0] for x in PACKED.split(", ")])


def met(keys: np.ndarray, places: np.ndarray, owners: np.ndarray, words: list[str], counts: np.ndarray) -> Iterator[tuple[str, int, int, tuple | None]]:
    """(word, n, near, best) of the keys of a task; a word's rows add up over tasks. Each word's own key gives a row, with near 0.

    Members of a key are sorted by place, so those of a run of one letter follow its first.
    """
    order = np.lexsort((places, keys))
    same = keys[order][1:] == keys[order][:-1]
    together = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    n = counts.tolist()
    better = lambda i: (-n[i], words[i])

    def group(members: list[tuple[int, int]]) -> Iterator[tuple[str, int, int, tuple | None]]:
        rests: dict[str, dict[int, list[int]]] = {}
        left: dict[int, str] = {}
        for place, i in members:
            w = words[i]
            if place == OWN:
                rest = w
            elif place == 0 or w[place] != w[place - 1]:
                rest = left[i] = w[:place] + w[place + 1 :]
            else:  # within a run of one letter all deletions leave the same
                rest = left[i]
            rests.setdefault(rest, {}).setdefault(place, []).append(i)
        for spots in rests.values():
            whole = spots.pop(OWN, None)
            longer = {i for own in spots.values() for i in own}
            if whole and longer:
                (base,), top = whole, min(longer, key=better)
                yield words[base], n[base], len(longer), (-n[top], words[top])
                for i in longer:
                    yield words[i], n[i], 1, (-n[base], words[base])
            for own in spots.values():
                if len(own) > 1:
                    first, second = sorted(own, key=better)[:2]
                    for i in own:
                        other = second if i == first else first
                        yield words[i], n[i], len(own) - 1, (-n[other], words[other])

    for i in owners[places == OWN].tolist():
        yield words[i], n[i], 0, None
    at = order[together]
    members, last = [], None
    for key, place, i in zip(keys[at].tolist(), places[at].tolist(), owners[at].tolist(), strict=True):
        if key != last:
            yield from group(members)
            members, last = [], key
        members.append((place, i))
    yield from group(members)


def near_words(vocab: DataFrame) -> DataFrame:
    """word, n, n_near and best (the near word's negated count and itself; null if none) of a written vocabulary."""
    letters = vocab.agg(F.sum(F.char_length("word") + 1)).first()[0] or 0
    tasks = max(1, ceil(letters / BLOCK_KEYS), int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, size = [], [], 0
        for batch in batches:
            for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.append(w)
                counts.append(k)
                size += len(w) + 1
                if size >= BLOCK_KEYS:
                    yield from packed(words, np.array(counts), tasks)
                    words, counts, size = [], [], 0
        if words:
            yield from packed(words, np.array(counts), tasks)

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, known = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                own = row["words"].split("\n")
                parts.append([np.frombuffer(row[c], t) for c, t in (("keys", np.uint64), ("places", np.int32), ("owners", np.int32), ("counts", np.int64))])
                parts[-1][2] = parts[-1][2] + known
                words += own
                known += len(own)
        if not words:
            return
        rows, found = [], met(*(np.concatenate(x) for x in list(zip(*parts, strict=True))[:3]), words, np.concatenate([p[3] for p in parts]))

        def block() -> pa.RecordBatch:
            w, k, near, best = zip(*rows, strict=True)
            best = [b and {"n": b[0], "word": b[1]} for b in best]
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int64()), pa.array(near, pa.int64()), pa.array(best, BEST)], ["word", "n", "near", "best"])

        for row in found:
            rows.append(row)
            if len(rows) >= 50_000:
                yield block()
                rows = []
        if rows:
            yield block()

    dealt = vocab.select("word", "n").mapInArrow(keyed, PACKED).repartitionById(tasks, F.col("bucket"))
    return dealt.mapInArrow(sorted_out, NEAR).groupBy("word").agg(F.first("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def grouped(vocab: DataFrame, lead: int = LEAD) -> DataFrame:
    """word, form, root, n, n_near and form_n of a vocabulary (word, n) of distinct words."""
    scratch = Scratch(vocab.sparkSession)
    near = near_words(scratch.put(vocab, "vocabulary"))
    taken = -F.col("best.n") >= lead * F.col("n")
    forms = scratch.put(near.select("word", "n", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n")), "forms")
    linked = forms.where("form is not null")
    roots = linked.select("word", F.col("form").alias("root"))
    most = linked.agg(F.max("form_n")).first()[0] or 1
    for i in range(ceil(log2(max(2, 1 + log(most) / log(lead))))):  # counts grow by lead with each link
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = scratch.put(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), f"roots{i}")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return forms.where("form is null").withColumn("root", F.col("word")).select(columns).union(linked.join(roots, "word").select(columns))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Variants among the damaged words of all documents."""
    return grouped(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), one_of_31))


#: CRC-32 is linear: a string's is the exclusive or of what each byte gives at its distance from the end, and of what its length gives.
OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lowered AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM words WHERE length(run) >= 7 GROUP BY ALL
), messages AS (
  SELECT id, w, k, encode(id || ':' || w) AS m FROM lowered
), shifts AS (
  SELECT b, 0 AS bits, CAST(b AS BIGINT) AS v FROM range(256) t(b)
  UNION ALL SELECT b, bits + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM shifts WHERE bits < 8
), step AS (
  SELECT b, v FROM shifts WHERE bits = 8
), gives AS (
  SELECT 0 AS far, b, v FROM step
  UNION ALL SELECT far + 1, g.b, xor(g.v >> 8, s.v) FROM gives g JOIN step s ON s.b = (g.v & 255) WHERE far < (SELECT max(octet_length(m)) FROM messages)
), starts AS (
  SELECT 0 AS len, 4294967295 AS v
  UNION ALL SELECT len + 1, xor(t.v >> 8, s.v) FROM starts t JOIN step s ON s.b = (t.v & 255) WHERE len < (SELECT max(octet_length(m)) FROM messages)
), numbered AS (
  SELECT row_number() OVER () AS r, id, w, k, m FROM messages
), bytes AS (
  SELECT r, octet_length(m) AS len, unnest(range(octet_length(m))) AS i, hex(m) AS h FROM numbered
), linear AS (
  SELECT r, any_value(len) AS len, bit_xor(g.v) AS v FROM bytes JOIN gives g
    ON g.far = len - 1 - i AND g.b = (position(h[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(h[2 * i + 2] IN '0123456789ABCDEF') - 1
  GROUP BY r
), hashed AS (
  SELECT w, k, xor(xor(l.v, s.v), 4294967295) AS crc FROM numbered JOIN linear l USING (r) JOIN starts s ON s.len = l.len
), damaged AS (
  SELECT CASE WHEN crc % 31 = 0 THEN w[:crc % length(w)] || w[crc % length(w) + 2:] ELSE w END AS word, k FROM hashed
), vocab AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), places AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM vocab
), rests AS MATERIALIZED (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM places
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM rests a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM rests a JOIN vocab b ON a.rest = b.word
), ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM near
), forms AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 10 * v.n THEN r.other END AS form, CASE WHEN r.other_n >= 10 * v.n THEN r.other_n END AS form_n
  FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND r.place = 1
), steps AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL
), roots AS (
  SELECT s.word, s.at AS root FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
