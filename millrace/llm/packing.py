"""Packing documents into windows by sum of squares.

Each task packs the documents of its partition as they come. Full windows of a document are
cut off first; what is left goes to the fill level h that minimises the sum of squares of
the counts N(h) of partly filled windows, which a level array of the window's length tracks.
One array operation a document finds it. When the partition ends, the windows still open
are poured together, cut at the window's length, and the last one is cut into lengths that
are powers of two, which need no padding. Nothing is shuffled or sorted.

Ids are the tokenizer's, from a bounded cache of words: its expressions never cross white
space, so a word's ids don't depend on its neighbours.

Null texts are empty; both, like an empty text, give the end id alone. Very long texts are
tokenized whole, and so are very long words; a task holds one such text, and of the documents
in its open windows their rests. Repeated rows, and rows that share an id or have none, are
packed one by one; among levels that tie the fullest is taken. An empty table gives an empty
result. Only doc_id and text are read, so further columns may have any name. A sequence's
number is its task's and one of its own; reruns over the same files agree.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, END_ID = 2048, 1
CACHE_WORDS = 400_000  # about 80 MB, and as much of older ones
LONG_WORD = 64  # longer words are not kept
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


AFTER = ",.!?;:%&$*#"  # each a word of its own after letters


def plain(w: str) -> bool:
    """Whether the tokenizer takes w as one word, as it is."""
    return w.isalpha() and (w.isascii() or unicodedata.is_normalized("NFC", w)) and w == w.lower()


class WordIds(dict):
    """Ids of words, and of texts, as bytes, little-endian and four a token.

    Only distinct words are tokenized: letters and the punctuation after them are words of
    their own to the tokenizer, and case is lost, so "Word," shares the entry of "word". Words
    of letters go to the tokenizer's model at once, as its normalizer and splitter would leave
    them as they are; all others take the whole way. Long words are not kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__({"": b""})
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytewise = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, w: str) -> bytes:
        if len(w) > LONG_WORD:
            return self.encoded(w)
        ids = self.older.get(w)
        if ids is None:
            stem = w.rstrip(AFTER)
            if not plain(stem):
                ids = self.encoded(w)
            elif stem != w:
                ids = self[stem] + self[w[len(stem) :]]
            else:
                pieces = self.model.tokenize(w if w.isascii() else self.bytewise.pre_tokenize_str(w)[0][0])
                ids = struct.pack(f"<{len(pieces)}I", *[x.id for x in pieces])
        if len(self) >= CACHE_WORDS:  # of a full cache the words that were used since the last turn are found again
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[w] = ids
        return ids

    def encoded(self, w: str) -> bytes:
        return np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        # the tokenizer lowers each letter by itself, which is what lower() does but for the final sigma
        text = text if "\u03a3" in text else text.lower()
        # these four are white space to the tokenizer; rarer kinds stay inside a word
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


class Packer:
    """Sum-of-squares packing; pieces are (document, start, length)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)  # N(h); 0 and the window itself stay 0
        self.open: dict[int, list[list[tuple]]] = {}

    def level(self, size: int) -> int:
        """The level that the item should go to; 0 opens a window. Ties: the fullest."""
        n, top = self.levels, self.window - size
        # moving a window from h to h + size changes the sum of squares by this much
        after = np.where(np.arange(size, self.window + 1) == self.window, 0, 2 * n[size:] + 1)
        cost = after - 2 * n[: top + 1] + 1
        cost[0] = after[0]
        usable = n[: top + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return top - int(np.argmin(cost[::-1]))

    def add(self, doc, n: int) -> tuple[list[list[tuple]], bool]:
        """Place a document of n tokens: the windows that this fills, and whether its rest is in an open one."""
        w = self.window
        full = [[(doc, at, w)] for at in range(0, n - w + 1, w)]
        size = n % w
        if not size:
            return full, False
        h = self.level(size)
        pieces = []
        if h:
            same = self.open[h]
            pieces = same.pop()
            self.levels[h] -= 1
            if not same:
                del self.open[h]
        pieces.append((doc, n - size, size))
        if h + size == w:
            return [*full, pieces], False
        self.levels[h + size] += 1
        self.open.setdefault(h + size, []).append(pieces)
        return full, True

    def close(self) -> Iterator[list[tuple]]:
        """Pour the open windows together."""
        row, fill = [], 0
        for h in sorted(self.open, reverse=True):
            for pieces in self.open[h]:
                for doc, start, n in pieces:
                    while n:
                        k = min(n, self.window - fill)
                        row.append((doc, start, k))
                        start, n, fill = start + k, n - k, fill + k
                        if fill == self.window:
                            yield row
                            row, fill = [], 0
        self.open, self.levels[:] = {}, 0
        yield from binary_cuts(row, fill)


def binary_cuts(row: list[tuple], fill: int) -> Iterator[list[tuple]]:
    """Cut a window into lengths that are powers of two, the largest first."""
    rest = list(row)
    while fill:
        want = 1 << (fill.bit_length() - 1)
        fill -= want
        out = []
        while want:
            doc, start, n = rest.pop(0)
            k = min(n, want)
            out.append((doc, start, k))
            want -= k
            if k < n:
                rest.insert(0, (doc, start + k, n - k))
        yield out


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents (doc_id, text) with their place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, packer, number = word_ids(tokenizer), Packer(window), TaskContext.get().partitionId() << 40
        end = np.asarray([END_ID], "<u4").tobytes()
        held: dict[int, list] = {}  # of documents in open windows: id, bytes of their rest and where it starts, tokens
        out, serial = [array("q") for _ in FIELDS], 0
        null_ids: list[int] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for key, start, n in pieces:
                doc_id, data, base, total = held[key]
                row = (0 if doc_id is None else doc_id, start, n, zlib.crc32(data[(start - base) * 4 : (start - base + n) * 4]), total, number, offset)
                if doc_id is None:
                    null_ids.append(len(out[0]))
                for c, v in zip(out, row, strict=True):
                    c.append(v)
                offset += n
            number += 1

        def flush() -> pa.RecordBatch:
            nonlocal out
            cols = [pa.array(np.frombuffer(c, np.int64).copy() if len(c) else np.zeros(0, np.int64)) for c in out]
            if null_ids:
                mask = np.zeros(len(out[0]), bool)
                mask[null_ids] = True
                cols[0] = pa.array(cols[0].to_numpy(), mask=mask)
                null_ids.clear()
            out = [array("q") for _ in FIELDS]
            return pa.RecordBatch.from_arrays(cols, schema=FIELDS)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = ids.of(text or "") + end
                total, serial = len(data) // 4, serial + 1
                held[serial] = (doc_id, data, 0, total)
                filled, stays = packer.add(serial, total)
                for pieces in filled:
                    emit(pieces)
                    for key in {p[0] for p in pieces} - {serial}:
                        del held[key]
                if stays:
                    rest = total - total % window
                    held[serial] = (doc_id, data[rest * 4 :], rest, total)
                else:
                    del held[serial]
            if len(out[0]) > 20_000:
                yield flush()
        for pieces in packer.close():
            emit(pieces)
        if len(out[0]):
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(pack, SCHEMA)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
