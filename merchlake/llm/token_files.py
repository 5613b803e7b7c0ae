"""Token-id files with a minimal perfect hash index.

*Format.* A folder with two Parquet tables, written by Spark, so any file system serves and a lost task is redone whole.
``layout`` holds the shards' id bounds and the number width. ``segments`` holds rows of at most ``SEGMENT_BYTES`` of
payload (more only for a single document that is longer), in ascending id order within a shard, shards in order:

* ``payload``: token ids of the segment's documents one after the other, little-endian unsigned numbers of ``width``
  bytes, each document closed by the end id;
* ``ids``: document ids in the same order;
* ``index``: a minimal perfect hash of the distinct ids: levels of bit arrays, in each of which an id owns the bit that
  no other id left at that level hashes to. The number of bits set before it is the id's entry;
* ``marks``: per entry a 32-bit fingerprint of the id, the place of its first document, how many follow it, and where
  their ids start in the payload.

An access hashes the key, reads one entry, compares the fingerprint and slices the payload: constant time, no scan. A
key that was never stored is refused unless its fingerprint collides, which the stored ids then settle.

Null texts count as empty and give the end id alone. Rows of a null id are stored first and are not indexed. Rows that
share an id are stored side by side under one entry. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from merchlake.llm.batches import map_rows
from merchlake.llm.bpe import SETTLED, byte_alphabet
from merchlake.llm.components import saved
from merchlake.session import temporary_conf

SEGMENT_BYTES = 1 << 20
#: Whole segments are rows; a task holds a few of them at a time.
READ_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4",
    "spark.sql.parquet.columnarReaderBatchSize": "8",
}
SHARD_BYTES = 8 << 20
MAX_SHARDS = 1 << 16
END_ID = 0
#: Distinct pieces of each of the two generations that a Python worker remembers (about 200 bytes each).
WORD_MEMORY = 250_000
#: Marks that may follow words, and the number and length of their runs that a Python worker remembers.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MARK_MEMORY = 10_000
MARK_LENGTH = 16
#: Characters of texts that are encoded together (more only for a single text that is longer).
TOGETHER = 1 << 15
_GAMMA = 1.5
_MAX_LEVELS = 40


class Encoder:
    """Token ids of whole texts, as the tokenizer gives them.

    A byte-level BPE cuts text into words before it merges, and always cuts before a space that stands alone, around a
    line feed that stands alone and between letters and marks. So what stands between spaces can be encoded by itself,
    and of it the words without the marks and line feeds after them, and remembered. What is new in a text goes to the
    tokenizer in one call for words, which it only has to merge, and one for all else. Memory has two generations: what is
    in use moves to the younger one, the older one is let go when that is full. Where the tokenizer works differently, or
    a text has other spacing or a special token in it, the tokenizer gets the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_word = (
            model["type"] == "BPE"
            and spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not model.get("dropout")
        )
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        # Whether a token begins with a space or a line feed, which byte-level vocabularies write as U+0120 and U+010A.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.spaced[number] = token.startswith("\u0120")
            self.opens[number] = token.startswith(("\u0120", "\u010a"))
        self.newline = self._whole("\n")
        # The model without the splitting, for words already split: it has to merge nothing over their bounds.
        self.merger = Tokenizer(self.tokenizer.model) if self.by_word and _merges_apart(model) else None
        self.alphabet = dict(enumerate(byte_alphabet()))
        # Ids of runs of marks.
        self.marks: dict[str, bytes] = {}
        # Words and other pieces that follow a space, words that begin a line (named with a space before them) and
        # their ids, in two generations.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _merged(self, text: str) -> np.ndarray:
        """Ids of words that each follow a space or a line feed."""
        if self.merger is None:
            return self._ids(text)
        if text.isascii():
            text = text.replace(" ", "\u0120").replace("\n", "\u010a")
        else:
            text = text.encode().decode("latin-1").translate(self.alphabet)
        return np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _of_marks(self, run: str) -> bytes:
        if len(run) > MARK_LENGTH:
            return self._whole(run)
        ids = self.marks.get(run)
        if ids is None:
            if len(self.marks) >= MARK_MEMORY:
                self.marks.clear()
            ids = self.marks[run] = self._whole(run)
        return ids

    def _words(self, piece: str, settled: bool) -> list[tuple[str, bytes]] | None:
        """Words of a piece, one a line, by their names in memory, each with the ids of the marks after it; None if there is more to it."""
        parts = []
        begins = piece[0] == " "
        for line in piece[begins:].split("\n"):
            word = line.rstrip(MARKS)
            # Versions of Unicode must agree on what a letter is.
            if not word.isalpha() or not (settled or SETTLED.fullmatch(word)):
                return None
            parts.append((" " + word if begins else word, self._of_marks(line[len(word) :]) if line != word else b""))
            begins = True
        return parts

    def _learn(self, new: set[str], words: bool) -> None:
        """Remember words, or other pieces, that are not known."""
        known, older = self.known, self.older
        after, begin = [], []
        for name in new:
            ids = older.get(name)
            if ids is not None:
                known[name] = ids
            elif name[0] == " ":
                begin.append(name)
            else:
                after.append(name)
        if not (after or begin):
            return
        text = (" " + " ".join(after) if after else "") + "".join(begin).replace(" ", "\n")
        # The only spaces and, around words, line feeds are those before them, so a token that begins with one begins a piece.
        ids, opens = (self._merged(text), self.opens) if words else (self._ids(text), self.spaced)
        starts = np.flatnonzero(opens[ids])
        ends = [*(starts[1:] * self.width).tolist(), len(ids) * self.width]
        # Of a line's first word, the line feed is left out.
        starts[len(after) :] += 1
        packed = ids.tobytes()
        known.update(zip(after + begin, [packed[a:b] for a, b in zip((starts * self.width).tolist(), ends)]))

    def _fill(self, pieces: list[str], found: list[bytes | None]) -> list[int]:
        """Find the ids of the pieces that are not known by name; the places of those that need the rest of their text."""
        if len(self.known) >= WORD_MEMORY:
            self.older, self.known = self.known, {}
        known = self.known
        missing = [at for at, ids in enumerate(found) if ids is None]
        new = {pieces[at] for at in missing}
        letters = "".join(new)
        settled = letters.isascii() or SETTLED.fullmatch(letters) is not None
        plain, others, cut = set(), set(), {}
        made: dict[str, bytes | None] = {}
        for piece in new:
            if settled and piece.isalpha():
                plain.add(piece)
            elif piece and (parts := self._words(piece, settled)):
                cut[piece] = parts
            elif piece[:1] == " ":
                made[piece] = self._whole(piece[1:])
            elif not piece or piece[0].isspace():
                # A space before other white space or the end may belong to either side. No such piece is ever known.
                made[piece] = None
            else:
                others.add(piece)
        # A word met before with marks after it is remembered with them, too.
        again = [piece for piece, parts in cut.items() if len(parts) == 1 and piece[0] != " " and parts[0][0] in known]
        self._learn(plain.union([name for parts in cut.values() for name, _ in parts if name not in known]), True)
        self._learn(others, False)
        join = self.newline.join
        for piece, parts in cut.items():
            made[piece] = join([known[name] + marks for name, marks in parts]) if len(parts) > 1 else known[parts[0][0]] + parts[0][1]
        known.update([(piece, made[piece]) for piece in again])
        made.update([(piece, known[piece]) for piece in plain | others])
        for at in missing:
            found[at] = made[pieces[at]]
        return [at for at in missing if found[at] is None] if None in made.values() else []

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        pieces, ends = [], []
        for text in texts:
            at = len(pieces)
            pieces += text.split(" ")
            # What begins a text is remembered as what begins a line.
            pieces[at] = " " + pieces[at]
            ends.append(len(pieces))
        found = list(map(self.known.get, pieces))
        odd = self._fill(pieces, found) if None in found else ()
        whole = {bisect_right(ends, at) for at in odd}
        return [
            self._whole(text) if at in whole else b"".join(found[a:b])
            for at, (text, a, b) in enumerate(zip(texts, [0, *ends], ends))
        ]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, part, size = [], [], 0
        for text in texts:
            by_word = self.by_word and not any(s in text for s in self.special)
            if part and (not by_word or size + len(text) > TOGETHER):
                out += self._together(part)
                part, size = [], 0
            if by_word:
                part.append(text)
                size += len(text)
            else:
                out.append(self._whole(text))
        return out + self._together(part)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _merges_apart(model: dict) -> bool:
    """Whether merging words that follow a space or a line feed, all in one, is merging each of them."""
    if any(model.get(k) for k in ("unk_token", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}

    def in_word(token: str) -> bool:
        if not to_byte.keys() >= set(token):
            return True
        text = bytes([to_byte[c] for c in token]).decode(errors="replace").strip(" \n")
        # Part of a character may be part of a letter.
        return all(c.isalpha() or c == "\ufffd" for c in text)

    white = {"\u0120", "\u010a"}
    return not any(
        (b[0] in white and a[-1] not in white and in_word(a)) or (a[-1] == "\u010a" and b[0] not in white and in_word(b))
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    )


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, whatever number of tasks it runs.

    Functions travel to the workers by value, module variables included, so what is to outlast a task is held by a
    module that each process makes for itself.
    """
    held = sys.modules.setdefault("merchlake_encoders", ModuleType("merchlake_encoders"))
    encoders = held.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Minimal perfect hash of distinct integers; ``bits`` and ``ranks`` of all levels one after the other."""

    sizes: list[int]
    bits: np.ndarray  # one byte for eight bits
    ranks: np.ndarray  # bits set before each group of 64
    rest: np.ndarray  # keys that no level could place, in order

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys, [], []
        while len(left) and len(sizes) < _MAX_LEVELS:
            size = max(64, -(-int(_GAMMA * len(left)) // 64) * 64)
            at = (_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        ranks = np.concatenate(([0], np.cumsum(flat.reshape(-1, 64).sum(axis=1)))).astype(np.uint32)
        return cls(sizes, np.packbits(flat, bitorder="little"), ranks, np.sort(left))

    def __len__(self) -> int:
        return int(self.ranks[-1]) + len(self.rest)

    def entry(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key; keys that were not built in may get any entry, or -1."""
        found = np.full(len(keys), -1)
        open_keys = np.arange(len(keys))
        words = self.bits.view("<u8") if len(self.bits) else np.zeros(0, np.uint64)
        start = 0
        for level, size in enumerate(self.sizes):
            at = start + (_hash(keys[open_keys], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_keys[hit]] = (self.ranks[at >> 6] + before)[hit]
            open_keys = open_keys[~hit]
            start += size
        if len(self.rest) and len(open_keys):
            at = np.searchsorted(self.rest, keys[open_keys]).clip(0, len(self.rest) - 1)
            same = self.rest[at] == keys[open_keys]
            found[open_keys[same]] = int(self.ranks[-1]) + at[same]
        return found

    def dump(self) -> bytes:
        head = struct.pack("<III", len(self.sizes), len(self.ranks), len(self.rest))
        sizes = np.array(self.sizes, "<u4").tobytes()
        return head + sizes + self.bits.tobytes() + self.ranks.astype("<u4").tobytes() + self.rest.astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        levels, ranks, rest = struct.unpack_from("<III", data)
        sizes = np.frombuffer(data, "<u4", levels, 12)
        at = 12 + 4 * levels
        bits = np.frombuffer(data, np.uint8, int(sizes.sum()) // 8, at)
        at += len(bits)
        return cls(
            sizes.tolist(), bits, np.frombuffer(data, "<u4", ranks, at), np.frombuffer(data, "<i8", rest, at + 4 * ranks)
        )


_MARK = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("count", "<u4"), ("start", "<u8")])


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def index_segment(ids: list[int | None], sizes: list[int]) -> tuple[bytes, bytes]:
    """Index and marks of a segment with these document ids, in order, and numbers of token ids."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    indexed = np.array([i for i in ids if i is not None], np.int64)
    nulls = len(ids) - len(indexed)
    keys, first, count = np.unique(indexed, return_index=True, return_counts=True)
    table = PerfectHash.build(keys)
    marks = np.zeros(len(table), _MARK)
    at = table.entry(keys)
    marks["fingerprint"][at] = _fingerprint(keys)
    marks["first"][at], marks["count"][at] = first + nulls, count
    marks["start"][at] = starts[first + nulls]
    return table.dump(), marks.tobytes()


@dataclass
class Segment:
    """A stored segment, opened for access by key."""

    ids: list[int | None]
    sizes: np.ndarray
    payload: np.ndarray
    table: PerfectHash
    marks: np.ndarray

    @classmethod
    def open(cls, ids, sizes, payload: bytes, width: int, index: bytes, marks: bytes) -> Segment:
        return cls(
            ids,
            np.asarray(sizes, np.int64),
            np.frombuffer(payload, f"<u{width}"),
            PerfectHash.load(index),
            np.frombuffer(marks, _MARK),
        )

    def places(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(key number, document number, start in the payload)`` of every document stored under the keys."""
        entry = self.table.entry(keys)
        good = np.flatnonzero(entry >= 0)
        good = good[self.marks["fingerprint"][entry[good]] == _fingerprint(keys[good])]
        for number in good.tolist():
            mark = self.marks[entry[number]]
            document, start = int(mark["first"]), int(mark["start"])
            # Fingerprints may collide for keys that are not stored.
            if self.ids[document] == keys[number]:
                for document in range(document, document + int(mark["count"])):
                    yield number, document, start
                    start += int(self.sizes[document])


_SEGMENTS = (
    "shard int, segment int, width int, n_tokens long, low long, high long, ids array<long>, sizes array<int>,"
    " payload binary, index binary, marks binary"
)


def _tokenise(path: str, bounds: list[int], end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            shards = [0 if i is None else bisect_left(bounds, i) for i in ids]
            data = [tokens + end for tokens in own.encode_all([text or "" for text in texts])]
            columns = zip((shards, ids, data), _TOKENS)
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in columns], schema=_TOKENS)

    return run


_TOKENS = pa.schema([("shard", pa.int32()), ("id", pa.int64()), ("data", pa.binary())])


def _pack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment = None, 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            sizes = [len(p) // width for p in parts]
            index, marks = index_segment(ids, sizes)
            known = [i for i in ids if i is not None]
            row = {
                "shard": [shard],
                "segment": [segment],
                "width": [width],
                "n_tokens": [sum(sizes)],
                "low": [min(known, default=None)],
                "high": [max(known, default=None)],
                "ids": [list(ids)],
                "sizes": [sizes],
                "payload": [b"".join(parts)],
                "index": [index],
                "marks": [marks],
            }
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        for batch in batches:
            for own, doc_id, data in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (own != shard or size + len(data) > SEGMENT_BYTES):
                    yield close()
                    segment = segment + 1 if own == shard else 0
                    ids, parts, size = [], [], 0
                elif own != shard:
                    segment = 0
                shard = own
                ids.append(doc_id)
                parts.append(data)
                size += len(data)
        if ids:
            yield close()

    return run


_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("width", pa.int32()),
        ("n_tokens", pa.int64()),
        ("low", pa.int64()),
        ("high", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())),
        ("payload", pa.binary()),
        ("index", pa.binary()),
        ("marks", pa.binary()),
    ]
)


def write_token_files(
    documents: DataFrame,
    folder: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> None:
    """Encode whole texts and write them to ``folder``, in ascending order of their integer ids."""
    spark = documents.sparkSession
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-size // SHARD_BYTES)))
    cuts = [i / shards for i in range(1, shards)]
    # At most MAX_SHARDS numbers, from the ids alone.
    bounds = sorted({int(b) for b in texts.select("id").na.drop().approxQuantile("id", cuts, 0.1 / shards)}) if cuts else []
    width = encoder(tokenizer_path).width
    spark.createDataFrame([(width, end_id, bounds)], "width int, end_id int, bounds array<long>").coalesce(
        1
    ).write.parquet(f"{folder}/layout")
    tokens = texts.mapInArrow(_tokenise(tokenizer_path, bounds, end_id), "shard int, id long, data binary")
    (
        tokens.repartition(shards, "shard")
        .sortWithinPartitions("shard", "id", "data")
        .mapInArrow(_pack(width), _SEGMENTS)
        .write.parquet(f"{folder}/segments")
    )


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SEGMENTS).parquet(f"{folder}/segments")


def segment_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``shard``, ``segment`` and the token ids of everything before it."""
    sizes = read_segments(spark, folder).select("shard", "segment", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per shard, at most MAX_SHARDS.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(bases), "shard")
        .select("shard", "segment", (F.col("base") + F.col("inside")).cast("long").alias("segment_start"))
    )


def _fetch(shard, segment, width, ids, sizes, payload, index, marks, keys=None) -> Iterator[tuple]:
    """Documents of a segment, reached through its index; all of them where no keys are given."""
    opened = Segment.open(ids, sizes, payload, width, index, marks)
    nulls = sum(i is None for i in ids) if keys is None else 0
    start = 0
    for document in range(nulls):
        yield _found(shard, segment, opened, document, start)
        start += int(opened.sizes[document])
    wanted = np.unique(np.array([i for i in (ids if keys is None else keys) if i is not None], np.int64))
    for _, document, start in opened.places(wanted):
        yield _found(shard, segment, opened, document, start)


def _found(shard: int, segment: int, opened: Segment, document: int, start: int) -> tuple:
    tokens = opened.payload[start : start + int(opened.sizes[document])].astype("<u4")
    return shard, segment, opened.ids[document], start, tokens.tobytes()


_ROW = "shard int, segment int, id long, offset long, tokens binary"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored document: ``id``, its ``offset`` in its segment and its ``tokens`` as 32-bit numbers."""
    columns = ["shard", "segment", "width", "ids", "sizes", "payload", "index", "marks"]
    return map_rows(read_segments(spark, folder).select(*columns), lambda: _fetch, _ROW)


def look_up(keys: DataFrame, folder: str, key_col: str = "doc_id") -> DataFrame:
    """Stored documents of the given keys. Only segments that may hold one are opened, each once."""
    spark = keys.sparkSession
    segments = read_segments(spark, folder)
    layout = spark.read.schema("width int, end_id int, bounds array<long>").parquet(f"{folder}/layout").first()
    edges = layout["bounds"]

    def shard_of(key) -> Iterator[tuple]:
        yield key, int(np.searchsorted(np.array(edges, np.int64), key, side="left"))

    asked = keys.select(F.col(key_col).cast("long").alias("key")).na.drop().distinct()
    asked = map_rows(asked, lambda: shard_of, "key long, shard int")
    near = asked.join(segments.select("shard", "segment", "low", "high"), "shard").filter(F.col("key").between(F.col("low"), F.col("high")))
    lists = near.groupBy("shard", "segment").agg(F.collect_list("key").alias("keys"))
    columns = ["shard", "segment", "width", "ids", "sizes", "payload", "index", "marks", "keys"]
    return map_rows(segments.join(lists, ["shard", "segment"]).select(*columns), lambda: _fetch, _ROW)


def _digest(shard, segment, width, ids, sizes, payload, index, marks) -> Iterator[tuple]:
    for _, _, doc_id, offset, tokens in _fetch(shard, segment, width, ids, sizes, payload, index, marks):
        yield shard, segment, doc_id, offset, len(tokens) // 4, zlib.crc32(tokens)


def documents_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Per stored document: ``id``, ``start`` among all token ids, ``n_tokens`` and ``ids_crc32``."""
    columns = ["shard", "segment", "width", "ids", "sizes", "payload", "index", "marks"]
    with temporary_conf(spark, READ_CONF):
        found = map_rows(
            read_segments(spark, folder).select(*columns),
            lambda: _digest,
            "shard int, segment int, id long, offset long, n_tokens long, ids_crc32 long",
        )
        found = saved(found, "token-digest")
    return found.join(segment_starts(spark, folder), ["shard", "segment"]).select(
        "id", (F.col("segment_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
