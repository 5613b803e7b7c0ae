"""Byte-level BPE encoding by a segment tree over pair ranks, and decoding.

*Encoding.* A text is cut at special tokens, then into words by the splitting rule of byte-level vocabularies. The bytes
of a word are its first symbols. A segment tree holds, for every pair of neighbouring symbols, its merge rank with its
place; the root is the leftmost pair of the lowest rank. That pair is merged, which changes three leaves and their paths
to the root, until the root holds no mergeable pair. A word of n bytes takes n log n steps, however long it is. Word ids
are remembered by each Python worker in two generations, so words in use stay and memory is bounded.

*Decoding.* The bytes of all tokens are joined and read as UTF-8; invalid sequences become U+FFFD.

One row comes out for each row that goes in; there is no shuffle. Null texts count as empty: no ids, empty decoded text.
Texts are encoded whole, of any length. Repeated rows and ids give repeated rows; null ids stay. An empty table gives an
empty table. Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.batches import map_rows

#: Words of each of the two generations that a Python worker remembers, about 250 bytes each.
WORD_MEMORY = 300_000

# Fixed value: the splitting rule of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on whose classes (letter, number, space) all versions of Unicode in use agree. Texts with others are split
#: by the tokenizer itself, so that its version decides.
SETTLED = re.compile(
    "[\x00-\u0557\u0590-\u085f\u0900-\u0b7f\u0d00-\u1fff\u2000-\u205f\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u2500-\u2b73"
    "\u3000-\u312f\u3400-\u4db5\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uffef\U0001f300-\U0001f64f]*"
)

_NONE = sys.maxsize


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merger:
    """Merges the symbols of one word."""

    def __init__(self, ranks: dict[tuple[int, int], int], merged: list[int]):
        #: Rank of each mergeable pair, and by rank the symbol it becomes.
        self.ranks = ranks
        self.merged = merged

    def merge(self, symbols: list[int]) -> list[int]:
        last = len(symbols) - 1
        if last < 1:
            return symbols
        ranks, merged = self.ranks, self.merged
        # A leaf is rank and place in one number: its order is that of ranks, ties from left to right.
        shift = last.bit_length()
        place = (1 << shift) - 1
        size = 1 << (last - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for at, pair in enumerate(zip(symbols, symbols[1:])):
            rank = ranks.get(pair)
            if rank is not None:
                tree[size + at] = rank << shift | at
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

        def put(at: int, value: int) -> None:
            node = size + at
            while tree[node] != value:
                tree[node] = value
                if node == 1:
                    return
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1

        after = list(range(1, last + 2))
        before = list(range(-1, last))
        while (top := tree[1]) != _NONE:
            at = top & place
            gone = after[at]
            symbols[at] = own = merged[top >> shift]
            symbols[gone] = -1
            follows = after[at] = after[gone]
            if gone < last:
                put(gone, _NONE)
            if follows <= last:
                before[follows] = at
                rank = ranks.get((own, symbols[follows]))
                put(at, _NONE if rank is None else rank << shift | at)
            else:
                put(at, _NONE)
            precedes = before[at]
            if precedes >= 0:
                rank = ranks.get((symbols[precedes], own))
                put(precedes, _NONE if rank is None else rank << shift | precedes)
        return [s for s in symbols if s >= 0]


class Words(dict):
    """Packed ids of words: looked up, else taken from the older generation, else made."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, word_memory: int = WORD_MEMORY):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = (
            model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback"))
            and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
            and spec.get("normalizer") is None
            and spec.get("post_processor") is None
            and (split.get("type"), split.get("use_regex", True), split.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError(f"{path} holds no plain byte-level BPE vocabulary")
        vocabulary: dict[str, int] = model["vocab"]
        alphabet = byte_alphabet()
        self.first = [vocabulary[c] for c in alphabet]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(pairs):
            ranks[vocabulary[a], vocabulary[b]] = rank
        self.merger = Merger(ranks, [vocabulary[a + b] for a, b in pairs])
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.find = regex.compile(SPLIT).findall
        # Whole strings that are one token wherever they stand; the longest counts.
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.words = Words(self._word, word_memory)

        to_byte = {c: bytes([b]) for b, c in enumerate(alphabet)}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, number in (vocabulary | self.special).items():
            known = all(c in to_byte for c in token)
            self.bytes_of[number] = b"".join(to_byte[c] for c in token) if known else token.encode()

    def _word(self, word: str) -> bytes:
        first = self.first
        return np.array(self.merger.merge([first[b] for b in word.encode()]), "<u4").tobytes()

    def _split(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self._split(text)))
        out = []
        for number, part in enumerate(self.cut.split(text)):
            if number % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.extend(map(self.words.__getitem__, self._split(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec for each Python worker, kept over its tasks in a module that the process makes for itself."""
    held = sys.modules.setdefault("merchlake_bpe_codecs", ModuleType("merchlake_bpe_codecs"))
    codecs = held.__dict__.setdefault("codecs", {})
    if path not in codecs:
        codecs[path] = Codec(path)
    return codecs[path]


def _id_type(df: DataFrame, column: str) -> str:
    return df.select(F.col(column)).schema[0].dataType.simpleString()


def encode_texts(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``tokens``, the ids of the whole text as little-endian 32-bit numbers."""

    def make():
        encode = codec(tokenizer_path).encode

        def row(key, text) -> Iterator[tuple]:
            yield key, encode(text or "")

        return row

    return map_rows(documents.select(id_col, text_col), make, f"id {_id_type(documents, id_col)}, tokens binary")


def decode_tokens(encoded: DataFrame, tokenizer_path: str, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """``id`` and the decoded ``text``; null tokens give a null text."""

    def make():
        decode = codec(tokenizer_path).decode

        def row(key, tokens) -> Iterator[tuple]:
            yield key, None if tokens is None else decode(tokens)

        return row

    return map_rows(encoded.select(id_col, tokens_col), make, f"id {_id_type(encoded, id_col)}, text string")


def round_trip(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``tokens`` and what they decode to, in one pass."""

    def make():
        own = codec(tokenizer_path)

        def row(key, text) -> Iterator[tuple]:
            tokens = own.encode(text or "")
            yield key, tokens, own.decode(tokens)

        return row

    schema = f"id {_id_type(documents, id_col)}, tokens binary, decoded string"
    return map_rows(documents.select(id_col, text_col), make, schema)


def tokens_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "id",
        (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
