"""Packing tokenised documents into fixed windows by best-fit decreasing.

A document is its token ids and a final end id. While it is longer than a window, full windows are cut
off its front; what remains is packed. Remainders are dealt into shards by a hash, each of some thousand pieces whatever the corpus' size, and a shard is packed by itself: longest piece
first, each into the open window with the least room that still holds it. A segment tree over the room
left (0 to the window's length) counts open windows; descending it finds that room in a logarithmic
number of steps.

Token ids are looked up by white-space word. The tokenizer never lets a token cross ASCII white space, so
the ids of a text are the ids of its words in order; a word is tokenised by the tokenizer when it is
first met and remembered. Texts with special-token marks go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import staged, table

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces a shard holds on average.
SHARD = 1500
#: Words a worker remembers before it starts afresh, and the longest word that it remembers.
REMEMBER, LONGEST = 300_000, 64
#: A character that is a token of its own; it stands between words that are tokenised together.
BETWEEN = b"\x01"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Letters, then punctuation without an apostrophe: what the tokenizer splits into these two parts at most.
PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)")


#: Words that the shortcuts are tried on.
TRIED = "the quick, brown: fox; (jumps) isn't 42 3.14 naïve straße über-alles! señor... élan?! x1y2 日本 ok. déjà-vu AND and e.g. \u00bfqué? word_s".lower().split()


def byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: printable Latin-1 for itself, the
    other bytes in order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = sorted({*range(256)} - printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds(dict):
    """Word (lower-cased in ASCII) -> its ids as bytes of unsigned 32-bit integers.

    Plain words go to the tokenizer's merges in parts, without its normaliser and splitting, which change
    nothing in them; all others go through the tokenizer. Both shortcuts are tried when the vocabulary is
    loaded: one whose tokens cross white space gets whole texts, one that treats plain words otherwise, all words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {"": b""}
        self.characters = byte_characters()
        between = self._encode(BETWEEN.decode())
        self.between = between[0] if len(between) == 1 else -1
        whole = lambda texts: [self._encode(t).tobytes() for t in texts]
        self.by_word = all((whole([w.upper()]) == whole([w])) for w in TRIED if w.isascii()) and all(self._encode(f"{a}{gap}{b}").tobytes() == b"".join(whole((a, b))) for a, b in zip(TRIED, TRIED[1:], strict=False) for gap in (" ", "\n", "  ", "\t\r\n"))
        self.plain = all(self._part(p[1]) + self._part(p[2]) == self._encode(w).tobytes() for w in TRIED if (p := PLAIN.fullmatch(w)))
        self.parts = {"": b""}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def __missing__(self, word: bytes) -> bytes:
        return self._encode(word.decode()).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            mapped = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.characters)
            ids = self.parts[part] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids

    def _learn(self, words: list[bytes]) -> None:
        rest = []
        for w in words:
            s = w.decode()
            plain = PLAIN.fullmatch(s)
            if self.plain and plain and plain[1].isalpha() and (s.isascii() or s.lower() == s and unicodedata.is_normalized("NFC", s)):
                self[w] = self._part(plain[1]) + self._part(plain[2])
            else:
                rest.append(w)
        for at in range(0, len(rest), 2000):
            self._joined(rest[at : at + 2000])

    def _joined(self, words: list[bytes]) -> None:
        """Tokenises words in one go; where one of them holds the separating token, each by itself later."""
        ids = self._encode((b" " + BETWEEN + b" ").join(words).decode())
        cuts = np.flatnonzero(ids == self.between)
        if self.between >= 0 and len(cuts) == len(words) - 1:
            raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            starts = [0, *(4 * cuts + 4).tolist()]
            self.update(zip(words, map(raw.__getitem__, map(slice, starts, ends)), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBER:
            self.clear()
            self.parts = {"": b""}
        if not self.by_word:
            return [self._encode(t).tobytes() for t in texts]
        raw = [t.encode().lower() for t in texts]
        words = [None if b"<|" in r else r.split() for r in raw]
        self._learn([w for w in set().union(*filter(None, words)).difference(self) if len(w) <= LONGEST and BETWEEN not in w])
        return [self._encode(t).tobytes() if w is None else b"".join(map(self.__getitem__, w)) for t, w in zip(texts, words, strict=True)]


@functools.cache
def known(path: str) -> WordIds:
    """One for each worker and vocabulary: tasks go on with what earlier ones have met."""
    return WordIds(path)


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows and the remainder of each document."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known(path or tokenizer_path())
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out: tuple[list, ...] = ([], [], [], [], [])
            texts = [x or "" for x in part.column(1).to_pylist()]
            for doc, found in zip(part.column(0).to_pylist(), words.ids(texts), strict=True):
                ids = memoryview(found + end)
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


class Rooms:
    """Open windows by the room that they have left, under a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, which: int) -> None:
        if room:
            self.open[room].append(which)
            self._add(room, 1)

    def tightest(self, least: int) -> int | None:
        """The least room of at least ``least``: up while nothing lies to the right, then down to the left."""
        node, count = least + self.leaves, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """For each length, in the order given (descending), its window and its offset there."""
    rooms, placed, windows = Rooms(window), [], 0
    for n in lengths:
        room = rooms.tightest(n)
        if room is None:
            which, room = windows, window
            windows += 1
        else:
            which = rooms.take(room)
        placed.append((which, window - room))
        rooms.put(room - n, which)
    return placed


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives an
    empty result; columns other than doc_id and text are ignored.
    """
    pieces = staged(cut(docs, path, window, end_id), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    # the row's number tells repeated rows and rows without ids apart, so no shard gets all of them
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def packed(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = np.array(best_fit_decreasing(batch["length"].to_pylist(), window), "int64").reshape(-1, 2)
        first = (batch["_shard"][0].as_py() or 0) << 32
        return batch.drop_columns(["_shard"]).append_column("sequence_id", pa.array(placed[:, 0] + first)).append_column("offset", pa.array(placed[:, 1]))

    return sharded.groupBy("_shard").applyInArrow(packed, PIECES + ", sequence_id long, offset long")


def op2_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
