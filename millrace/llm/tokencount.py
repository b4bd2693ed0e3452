"""Token counts by trie-shared dynamic programming.

A text's tokens are those of its pre-tokens (runs without white space, each with the space
mark in front), segmented so that the sum of piece scores is largest; ties go to fewer
tokens. Distinct pre-tokens form a trie whose nodes hold the forward score of their prefix,
so a prefix is scored once for all words that share it, and a word's count is read at its
terminal node. The trie is walked depth-first over the sorted words, so only the nodes on the
path from the root are held; terminal counts are kept in a bounded cache.

Pieces are those of a public vocabulary file of the byte-pair kind. The scores in that file
are negated ranks of merges, not logarithms of probabilities, and their sums would favour
long runs of early merges whatever the text; a piece therefore scores the logarithm of its
Zipf frequency by rank, so these are counts under that model, not the ones that the file's
own merges give. A character without a piece costs UNKNOWN and counts its UTF-8 bytes, as
byte fallback does.

Null texts are empty and have no tokens. Counts are exact for every whole text. Words of more
than LONG_WORD characters, as in very long texts without spaces, are scored outside the trie
by a window of the longest piece. Repeated rows and rows that share an id or have none are
counted one by one. An empty table gives an empty result. Only doc_id and text are read, so
further columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN = -30.0
CACHE_WORDS = 200_000  # about 25 MB, and as much of older ones
LONG_WORD = 1000
CHARS = 1 << 21  # of the texts whose words are walked together
SCHEMA = "doc_id long, n_pretokens long, n_tokens long"
FIELDS = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scores(path: str) -> dict[str, float]:
    """Score of each piece: the logarithm of a Zipf frequency by its rank in the file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = sum(1 / (r + 1) for r in range(len(usable)))
    return {sp.id_to_piece(i): -log((r + 1) * total) for r, i in enumerate(usable)}


class Trie:
    """Forward scores along the path to the current word; of sorted words each prefix is scored once."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        ends: dict[str, set[int]] = {}
        for p in pieces:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v)) for k, v in ends.items()}  # of the pieces that end so

    def _extended(self, word: str, n: int, score: list[float], count: list[int], shift: int = 0) -> None:
        """Add the node of word[:n]; the lists hold the prefixes from length ``shift`` on."""
        pieces, last = self.pieces, n - 1 - shift
        best, fewest = score[last] + UNKNOWN, count[last] + len(word[n - 1].encode("utf-8", "surrogatepass"))
        s = pieces.get(word[n - 1])
        if s is not None:
            total, k = score[last] + s, count[last] + 1
            if total > best or (total == best and k < fewest):
                best, fewest = total, k
        if n > 1:
            for size in self.lengths.get(word[n - 2 : n], ()):
                if size > n:
                    break
                s = pieces.get(word[n - size : n])
                if s is not None:
                    at = n - size - shift
                    total, k = score[at] + s, count[at] + 1
                    if total > best or (total == best and k < fewest):
                        best, fewest = total, k
        score.append(best)
        count.append(fewest)

    def walk(self, words: list[str]) -> Iterator[int]:
        """Counts of sorted words."""
        score, count, before = [0.0], [0], ""
        for w in words:
            n, most = 0, min(len(before), len(w))
            while n < most and before[n] == w[n]:
                n += 1
            del score[n + 1 :], count[n + 1 :]
            for end in range(n + 1, len(w) + 1):
                self._extended(w, end, score, count)
            before = w
            yield count[-1]

    def rolled(self, word: str) -> int:
        """The count of a long word, with no more than the last prefixes held."""
        score, count, shift = [0.0], [0], 0
        for end in range(1, len(word) + 1):
            self._extended(word, end, score, count, shift)
            if len(score) > 4 * self.longest:
                gone = len(score) - self.longest
                del score[:gone], count[:gone]
                shift += gone
        return count[-1]

    def counts(self, words: set[str]) -> dict[str, int]:
        """Counts of these words."""
        found, fresh = {}, []
        for w in words:
            n = self.known.get(w) or self.older.get(w)
            if n:
                found[w] = n
            elif len(w) > LONG_WORD:
                found[w] = self.rolled(w)
            else:
                fresh.append(w)
        fresh.sort()
        found.update(zip(fresh, self.walk(fresh), strict=True))
        if len(self.known) >= CACHE_WORDS:
            self.known, self.older = {}, self.known
        self.known.update((w, n) for w, n in found.items() if len(w) <= 64)
        return found


_LOADED: dict[str, dict[str, float]] = {}


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Pre-tokens and tokens of every document (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = scores(vocabulary)
        trie = Trie(_LOADED[vocabulary])

        def block(ids: list, found: list[Counter]) -> pa.RecordBatch:
            known = trie.counts({MARK + w for c in found for w in c})
            tokens = [sum(k * known[MARK + w] for w, k in c.items()) for c in found]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, [sum(c.values()) for c in found], tokens)], schema=FIELDS)

        ids, found, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id)
                found.append(Counter(WORD.findall(text)))
                chars += len(text) + 100
                if chars >= CHARS:
                    yield block(ids, found)
                    ids, found, chars = [], [], 0
        if ids:
            yield block(ids, found)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    from .packing import tokenizer_path

    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
