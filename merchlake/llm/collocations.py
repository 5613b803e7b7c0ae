"""Phrase collocations by best-first branch and bound over phrase counts.

A text, with A-Z lower-cased, is split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs.
``f(phrase)`` counts contiguous occurrences within pieces, overlaps included, in one language. Candidates have 2 to
``longest`` words and ``a = f(phrase) >= min_count``. Cutting one after its first k words gives ``l`` and ``r``, the counts
of both parts, and the score ``floor(2000000 * a / (l + r))``; its lowest-scoring cut counts. A candidate inside a longer
one that has at least ``cover`` percent of its occurrences is dropped.

*Bounds.* No phrase scores more than ``2000000 * f(p) / (f(first word) + f(p))`` for any of its prefixes p, since it occurs
at most as often as p and the part after its first word at least as often as itself. The same holds for its suffixes.

*Search.* Hashes of words and pairs are counted first, then the words and pairs whose hashes are frequent enough: hashes
may fall together, so they only tell what to count. Then the frontier is expanded in waves, best bounds first: each language has a threshold, phrases whose bound reaches it are grown by a word, phrases whose score reaches it
get the counts of everything that may cover them. Once ``limit`` candidates at or above the threshold survive, nothing
left unexpanded can be among the first ``limit``, ties included, and the language is settled. Else its threshold falls,
down to 0, where everything is expanded.

*Size.* The texts are read twice, and by a wave once for each length above 2. Tasks count in bounded tables before the shuffle. What they
look for is told them by bit filters of at most ``FILTER_BITS`` bits, which let through all that is wanted and little
else; filters only spare shuffling, counts are exact for whatever passes. Tables stay tables, languages included.

Null texts count as empty, null languages as ``und``. Repeated rows count each. Ties after flooring go to the earliest cut;
ties of score and count are ordered by the phrase's UTF-8 bytes. Texts are read whole; very long ones are counted part by
part, parted between pieces. Empty tables, and languages without candidates, give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from merchlake.llm.components import saved

LIMIT = 2000
MIN_COUNT = 30
LONGEST = 4
COVER_PERCENT = 80
SCALE = 2_000_000
#: Distinct phrases that a task counts before it hands them on, and bytes of texts that it looks at together.
HELD_PHRASES = 1 << 19
BLOCK_BYTES = 1 << 20
#: Phrases of one batch that a task hands on, so that neither side holds all of them a second time.
HANDED_ROWS = 1 << 14
#: Most bits of a filter, and bits for each phrase below that.
FILTER_BITS = 1 << 27
BITS_PER_PHRASE = 24
#: Bytes after which a text is parted at the next end of a piece.
PART_BYTES = 1 << 20
#: Candidates at or above the first threshold, as a multiple of the limit, and the growth of that number by wave.
FIRST_WAVE, WAVE_GROWTH = 2, 8
_BUCKET = 1000

_END = re.compile(rb"[.,;:!?\n-\r]")
_BLANKS = re.compile(rb"[ \t]+")

# What a byte is: part of a word, a blank, or the end of a piece.
_WORD, _BLANK, _STOP = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _STOP

_MIX = np.uint64(0x9FB21C651E98DF25)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


_BYTE_HASH = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64)))


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


class Block:
    """Some texts, A-Z in lower case, as UTF-8 bytes one after the other, and where their words are."""

    def __init__(self, languages: list[str], texts: list[bytes]):
        self.languages = languages
        self.data = b"\n".join(texts).lower()
        codes = np.frombuffer(self.data, np.uint8)
        kind = _KIND[codes]
        inside = kind == _WORD
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == _STOP), self.starts)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.text = np.searchsorted(begins, self.starts, side="right") - 1
        # Whether something else than one space stands between a word and the next.
        gap = codes[self.ends[:-1]] if len(self.ends) else codes[:0]
        self.odd = (self.starts[1:] - self.ends[:-1] != 1) | (gap != ord(" "))

        lengths = self.ends - self.starts
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        powers = np.full(int(lengths.max(initial=0)) + 1, _MIX)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        parts = _BYTE_HASH[codes[inside]] * powers[place]
        self.words = _mixed(np.add.reduceat(parts, firsts)) if len(firsts) else np.zeros(0, np.uint64)
        self.own = np.array([text_hash(g) for g in languages], np.uint64)[self.text]

    def hashes(self, size: int) -> np.ndarray:
        """Hash of the phrase of ``size`` words at every place, 0 where a piece ends inside. Never misses an equal phrase."""
        places = max(len(self.words) - size + 1, 0)
        out = self.own[:places]
        for j in range(size):
            out = _mixed(out ^ self.words[j : j + places])
        whole = self.piece[:places] == self.piece[size - 1 :][:places]
        return np.where(whole, out | np.uint64(1), np.uint64(0))

    def phrases(self, at: np.ndarray, size: int) -> list[bytes]:
        """The phrases of ``size`` words at the given places, single spaces between their words."""
        data = self.data
        found = [data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist())]
        if size > 1:
            odd = np.logical_or.reduce([self.odd[at + j] for j in range(size - 1)])
            for i in np.flatnonzero(odd).tolist():
                found[i] = _BLANKS.sub(b" ", found[i])
        return found


class Sieve:
    """A bit filter of phrases: says yes for every phrase put in, and for a few others."""

    def __init__(self, bits: int):
        self.shift = np.uint64(65 - bits.bit_length())
        self.words = np.zeros(bits // 64, np.uint64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes >> self.shift, (hashes * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = hashes != 0
        for at in self.places(hashes):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def hashed(phrases: DataFrame, size: int) -> DataFrame:
    """With the ``hash`` of each phrase of ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("phrase").cast(pa.binary()).to_pylist()
            if texts:
                found = Block(batch.column("lang").to_pylist(), texts).hashes(size)
                found = pa.array(found[found != 0].view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "hash"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in phrases.schema)
    return phrases.mapInArrow(run, f"{fields}, hash long")


def sieves(phrases: DataFrame, flags: list[str]) -> list[Sieve]:
    """A sieve for each flag, of the ``hash`` of the rows for which it holds."""
    counts = phrases.agg(*[F.count_if(F.col(flag)).alias(flag) for flag in flags]).first()
    made = []
    for flag in flags:
        wanted = max(counts[flag] * BITS_PER_PHRASE, 1 << 12)
        made.append(Sieve(min(FILTER_BITS, 1 << (wanted - 1).bit_length())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, sieve in enumerate(made):
                chosen = found[batch.column(1 + number).to_numpy(zero_copy_only=False)]
                at = np.unique(np.concatenate(sieve.places(chosen)))
                if len(at):
                    blocks, first = np.unique(at >> np.uint64(6), return_index=True)
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                    columns = [pa.array(np.full(len(blocks), number, np.int32)), pa.array(blocks.astype(np.int64)), pa.array(bits.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["sieve", "block", "bits"])

    blocks = phrases.select("hash", *flags).mapInArrow(run, "sieve int, block long, bits long")
    # At most FILTER_BITS / 64 rows for each flag.
    found = blocks.groupBy("sieve", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    number, block = found.column("sieve").to_numpy(), found.column("block").to_numpy()
    bits = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    for i, sieve in enumerate(made):
        sieve.words[block[number == i]] = bits[number == i]
    return made


def _parts(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > PART_BYTES:
        end = _END.search(text, start + PART_BYTES)
        if not end:
            break
        yield text[start : end.end()]
        start = end.end()
    yield text[start:] if start else text


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    languages, texts, size = [], [], 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for part in _parts(text):
                languages.append(language)
                texts.append(part)
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield Block(languages, texts)
                    languages, texts, size = [], [], 0
    if texts:
        yield Block(languages, texts)


def count_hashes(texts: DataFrame, min_count: int) -> DataFrame:
    """``size``, ``hash`` and ``a`` of hashes of words and pairs that are frequent enough, and by ``lang``, with size 0,
    the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for block in _blocks(batches):
            for name, n in zip(block.languages, np.bincount(block.text, minlength=len(block.languages)).tolist()):
                totals[name] += n
            for size in (1, 2):
                found = block.hashes(size)
                values, a = np.unique(found[found != 0], return_counts=True)
                columns = [
                    pa.array(np.full(len(values), size, np.int32)),
                    pa.array(values.view(np.int64)),
                    pa.nulls(len(values), pa.string()),
                    pa.array(a.astype(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["size", "hash", "lang", "a"])
        names = list(totals)
        columns = [
            pa.array([0] * len(names), pa.int32()),
            pa.nulls(len(names), pa.int64()),
            pa.array(names, pa.string()),
            pa.array([totals[g] for g in names], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "hash", "lang", "a"])

    found = texts.select("lang", "text").mapInArrow(run, "size int, hash long, lang string, a long")
    return found.groupBy("size", "hash", "lang").agg(F.sum("a").alias("a")).filter((F.col("a") >= min_count) | (F.col("size") == 0))


#: The places of a block at which a phrase is to be counted.
Gate = Callable[[Block], np.ndarray]


def count_phrases(texts: DataFrame, gates: dict[int, Gate], min_count: int) -> DataFrame:
    """``lang``, ``phrase`` and ``a`` of frequent phrases of the given numbers of words that their gates admit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for name, own in counts.items():
                found = iter(own.items())
                while part := list(islice(found, HANDED_ROWS)):
                    phrases, a = zip(*part)
                    columns = [
                        pa.array([name] * len(part), pa.string()),
                        pa.array(phrases, pa.binary()).cast(pa.string()),
                        pa.array(a, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])
            counts.clear()

        for block in _blocks(batches):
            codes = {name: number for number, name in enumerate(dict.fromkeys(block.languages))}
            language = np.array([codes[name] for name in block.languages])[block.text]
            for size, gate in gates.items():
                at = gate(block)
                for name, code in codes.items():
                    counts.setdefault(name, Counter()).update(block.phrases(at[language[at] == code], size))
            if sum(map(len, counts.values())) > HELD_PHRASES:
                yield from handed_on()
        yield from handed_on()

    found = texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)


def _ratio(part: Column, whole: list[Column]) -> Column:
    """``floor(SCALE * part / sum(whole))``; products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    total = reduce(lambda a, b: a + b, map(wide, whole))
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide(part), total)


def _bounded(phrases: DataFrame, size: int) -> DataFrame:
    """With score, its cut and the bounds of what may be grown; ``heads`` and ``tails`` hold the counts of the first and
    the last 1, 2, .. words. Null where a count it takes is unknown, as its own bounds then keep it out."""
    cuts = [
        F.struct(
            _ratio(F.col("a"), [F.col("heads")[k - 1], F.col("tails")[size - k - 1]]).alias("score"),
            F.lit(k).alias("k"),
            F.col("heads")[k - 1].alias("l"),
            F.col("tails")[size - k - 1].alias("r"),
        )
        for k in range(1, size)
    ]
    known = F.col("heads").isNotNull() & F.col("tails").isNotNull()
    return phrases.withColumn("best", F.when(known, F.array_min(F.array(*cuts)))).select(
        "lang",
        "phrase",
        "a",
        "heads",
        "tails",
        "best.score",
        "best.l",
        "best.r",
        _ratio(F.col("a"), [F.col("heads")[0], F.col("a")]).alias("head_bound"),
        _ratio(F.col("a"), [F.col("tails")[0], F.col("a")]).alias("tail_bound"),
    )


def _joined(counted: DataFrame, shorter: DataFrame, size: int) -> DataFrame:
    """Counted phrases with the counts of their first and last words, from the phrases one word shorter."""
    head = shorter.select(
        F.col("lang"), F.col("phrase").alias("head"), F.concat("heads", F.array("a")).alias("heads")
    )
    tail = shorter.select(
        F.col("lang"), F.col("phrase").alias("tail"), F.concat("tails", F.array("a")).alias("tails")
    )
    return (
        counted.withColumn("head", F.substring_index("phrase", " ", size - 1))
        .withColumn("tail", F.substring_index("phrase", " ", 1 - size))
        .join(head, ["lang", "head"], "left")
        .join(tail, ["lang", "tail"], "left")
        .drop("head", "tail")
    )


def _thresholds(pairs: DataFrame, target: int) -> DataFrame:
    """``lang`` and ``tau``: the highest round score that at least ``target`` pairs reach, else 0."""
    bucket = F.col("score") - F.col("score") % _BUCKET
    sizes = pairs.groupBy("lang", bucket.alias("bucket")).count()
    # At most a thousand rows per language.
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("bucket")))
    reached = sizes.select("lang", "bucket", above.alias("above"))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= target, F.col("bucket"))), F.lit(0)).alias("tau"))


def _survivors(chosen: DataFrame, longer: DataFrame | None, size: int, cover: int) -> DataFrame:
    """Chosen phrases of ``size`` words that no phrase one word longer covers."""
    if longer is None:
        return chosen
    covers = longer.select("lang", F.substring_index("phrase", " ", size).alias("phrase"), F.col("a").alias("most")).union(
        longer.select("lang", F.substring_index("phrase", " ", -size), "a")
    )
    most = covers.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    covered = 100 * wide("most") >= cover * wide("a")
    return chosen.join(most, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("most")


def _frequent_gate(frequent: Sieve, size: int) -> Gate:
    return lambda block: np.flatnonzero(frequent(block.hashes(size)))


def _growth_gate(size: int, pairs: Sieve, grown: list[Sieve], last: bool) -> Gate:
    heads, tails, chosen = grown

    def gate(block: Block) -> np.ndarray:
        frequent = pairs(block.hashes(2))
        places = max(len(block.words) - size + 1, 0)
        # Few places have frequent pairs only, so the rest is looked up there alone.
        at = np.flatnonzero(np.logical_and.reduce([frequent[j : j + places] for j in range(size - 1)]))
        shorter = block.hashes(size - 1)
        front, back = shorter[at], shorter[at + 1]
        if last:
            # Not grown any more: what may reach the threshold itself, and what may cover what does.
            return at[(heads(front) & tails(back)) | chosen(front) | chosen(back)]
        return at[heads(front) | tails(back)]

    return gate


def _wave(
    texts: DataFrame, pairs: DataFrame, known: Sieve, taus: DataFrame, longest: int, min_count: int, cover: int
) -> DataFrame:
    """Every surviving candidate that reaches the threshold of its language."""
    kept = ["lang", "phrase", "a", "l", "r", "score"]
    own = texts.join(taus.select("lang"), "lang", "left_semi")
    levels, shorter = [], pairs
    for size in range(2, longest + 1):
        flagged = shorter.join(taus, "lang").select(
            *shorter.columns,
            (F.coalesce("head_bound", F.lit(0)) >= F.col("tau")).alias("grow_head"),
            (F.coalesce("tail_bound", F.lit(0)) >= F.col("tau")).alias("grow_tail"),
            F.coalesce(F.col("score") >= F.col("tau"), F.lit(False)).alias("chosen"),
        )
        longer = None
        if size < longest:
            flags = ["grow_head", "grow_tail", "chosen"]
            grown = sieves(hashed(flagged.select("lang", "phrase", *flags), size), flags)
            gate = _growth_gate(size + 1, known, grown, size + 1 == longest)
            counted = saved(count_phrases(own, {size + 1: gate}, min_count), "phrases")
            longer = saved(_bounded(_joined(counted, shorter, size + 1), size + 1), "candidates")
        levels.append(_survivors(flagged.filter("chosen").select(*kept), longer, size, cover))
        shorter = longer
    return reduce(DataFrame.unionByName, levels)


def mine_collocations(
    documents: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    limit: int = LIMIT,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    cover: int = COVER_PERCENT,
) -> DataFrame:
    """The first ``limit`` collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    texts = documents.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    hashes = saved(count_hashes(texts, min_count), "hashes")
    sizes = hashes.select("hash", (F.col("size") == 1).alias("words"), (F.col("size") == 2).alias("pairs"))
    frequent = sieves(sizes.na.drop(), ["words", "pairs"])
    gates = {size: _frequent_gate(sieve, size) for size, sieve in enumerate(frequent, 1)}
    counted = saved(count_phrases(texts, gates, min_count), "phrases")
    none = F.array().cast("array<bigint>")
    single = F.instr("phrase", " ") == 0
    singles = counted.filter(single).select("lang", "phrase", "a", none.alias("heads"), none.alias("tails"))
    pairs = saved(_bounded(_joined(counted.filter(~single), singles, 2), 2), "candidates")
    known = frequent[1]

    settled: list[DataFrame] = []
    target, open_pairs = FIRST_WAVE * limit, pairs
    while True:
        taus = saved(_thresholds(open_pairs, target), "thresholds")
        found = saved(_wave(texts, pairs, known, taus, longest, min_count, cover), "survivors")
        numbers = found.groupBy("lang").count()
        enough = (F.coalesce("count", F.lit(0)) >= limit) | (F.col("tau") == 0)
        state = saved(taus.join(numbers, "lang", "left").select("lang", enough.alias("enough")), "settled")
        settled.append(found.join(state.filter("enough"), "lang", "left_semi"))
        left = state.filter("NOT enough")
        if left.isEmpty():
            break
        target *= WAVE_GROWTH
        open_pairs = pairs.join(left, "lang", "left_semi")
    totals = hashes.filter("size = 0").select("lang", F.col("a").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        reduce(DataFrame.unionByName, settled)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
    )
