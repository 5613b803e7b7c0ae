"""Exact n-gram Jaccard join by a blocked sparse matrix product of document by n-gram incidence.

Each document is a row of the incidence matrix: its distinct n-grams of words, hashed to 64 bits. Equal rows are
merged into one before anything else, so exact copies cost nothing further.

*Column blocks.* Two rows of sizes ``a <= b`` whose Jaccard similarity reaches the threshold differ in at most
``d(a, b) = (a + b)(1 - t) / (1 + t)`` columns. For rows of a size class, the columns are dealt into ``d + 1`` blocks and
a few more, so such rows agree entirely in at least one block that is not empty in both. Only rows that share a
block row (its hash) can therefore reach the bound; all other pairs are discarded without being formed.

*Discarding.* Every filled block in which two rows do not agree holds a difference, so linked rows agree in at least
``max(filled) - d(a, b)`` blocks. A row that shares too few block rows with all others together is dropped. Each row's
block rows are then ordered, those of the fewest rows first. If a row must share ``need`` of them with any linked row, the
first one that two linked rows share is not among the last ``need - 1`` of either, so pairs meet in the others alone: a line
that stands in many documents connects only what is made of such lines. Where at most ``PAIR_GROUP`` rows share a block
row, pairs are counted, and dropped if they share too few even with all larger groups of theirs; larger groups are
tied to one of their rows and decided by the product.

*Row blocks.* Rows connected by what is left form groups. Each group is cut into row blocks of at most
``ROW_BLOCK`` rows, and each pair of row blocks is one sparse product in one task: overlap counts are
accumulated over column slices, a pair is given up as soon as what is left cannot lift it to the bound derived from
the two sizes, and what reaches it is a link. A product hands on one edge per linked row, never its pairs.

Null, empty and blank texts have no n-grams and link with nothing. A text of fewer than ``n`` words is one n-gram as
a whole. Repeated rows and repeated ids are documents of their own; a null id takes part but never names a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from merchlake.llm.components import components, saved

ROW_BLOCK = 512
PAIR_GROUP = 16
#: Times that rows with too few shared block rows are dropped. A drop may uncover others, but hardly ever many.
DROP_ROUNDS = 1
COLUMN_SLICE = 8192
#: Sizes of a class differ by at most this factor.
CLASS_RATIO = 1.5
#: Bytes of text that are hashed at once.
_CHUNK = 1 << 19

_U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_COPY_MEMORY = 50_000
#: Size classes that keys tell apart: enough for rows of 10^11 columns.
CLASSES = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_known_powers: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    if (base, count) not in _known_powers:
        steps = np.full(count, base, _U64)
        steps[0] = 1
        _known_powers[base, count] = np.cumprod(steps, dtype=_U64)
    return _known_powers[base, count]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of bytes other than ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    room = 1 << max(16, (len(raw) + 1).bit_length())
    sums = np.zeros(len(raw) + 1, _U64)
    np.cumsum((raw.astype(_U64) + _U64(1)) * _powers(_MULTIPLIER, room)[: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, room)[starts]
    return starts, _mix(hashes + (ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def _ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; short rows are one n-gram."""
    n = min(n, len(words))
    count = len(words) - n + 1
    grams = _mix(words[n - 1 :] + _U64(n))
    for back in range(n - 2, -1, -1):
        grams = _mix(grams * _U64(3) + words[back : back + count])
    return grams


def ngram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    sets: list[np.ndarray] = []
    none = np.empty(0, _U64)
    chunk: list[bytes] = []
    size = 0

    def finish() -> None:
        starts, hashes = _word_hashes(b"\n".join(chunk))
        bounds = np.cumsum([0] + [len(x) + 1 for x in chunk])
        cuts = np.searchsorted(starts, bounds)
        for first, last in zip(cuts[:-1], cuts[1:]):
            sets.append(np.unique(_ngram_hashes(hashes[first:last], n)) if last > first else none)

    for text in texts:
        chunk.append((text or b"").lower())
        size += len(chunk[-1]) + 1
        if size >= _CHUNK:
            finish()
            chunk, size = [], 0
    if chunk:
        finish()
    return sets


def row_name(columns: np.ndarray) -> int:
    """A 64-bit name of a row that is the same for equal rows."""
    total = np.add.reduce(_mix(columns ^ _U64(0xA0761D6478BD642F)), dtype=_U64)
    return int(_mix(np.array([total + _U64(len(columns))], _U64)).view(np.int64)[0])


class BlockScheme:
    """How the columns of rows of each size are dealt into blocks, for the threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]
        self.blocks: list[tuple[int, int]] = []

    def _reach(self, size_class: int) -> None:
        while len(self.blocks) <= size_class:
            low = self.starts[-1]
            high = max(low + 1, int(low * CLASS_RATIO))
            self.starts.append(high)
            differ = 2 * (high - 1) * (self.den - self.num) // (self.den + self.num)
            least = -(-self.num * low // self.den)
            count = differ + 1
            # Blocks to spare for those that are empty in both rows.
            spare = min(math.ceil(1.5 * count * math.exp(-least / (1.2 * count))), count // 2) + 1
            # Rows that differ in no column are equal, and merged already.
            self.blocks.append((count + spare, spare) if differ else (0, 0))

    def classes(self, size: int) -> Iterator[tuple[int, int, int]]:
        """Classes in which a row of this size may have a partner no smaller than itself: class, blocks, spare."""
        size_class = 0
        while True:
            self._reach(size_class)
            if self.num * self.starts[size_class] > self.den * size:
                return
            if size < self.starts[size_class + 1]:
                count, spare = self.blocks[size_class]
                if count:
                    yield size_class, count, spare
            size_class += 1

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def fills(self, columns: np.ndarray) -> list[dict]:
        """Per class: blocks filled, and how many of them a linked row must share."""
        found, size = [], len(columns)
        for size_class, count, _ in self.classes(size):
            filled = len(np.unique(columns % _U64(count)))
            largest = min(self.starts[size_class + 1] - 1, size * self.den // self.num)
            found.append({"class": size_class, "filled": filled, "need": filled - self.differ(size, largest)})
        return found

    def keys(self, columns: np.ndarray) -> np.ndarray:
        """Hashes of the block rows of one row, over all its classes; the class is in the lowest bits."""
        keys = []
        for size_class, count, spare in self.classes(len(columns)):
            block = (columns % _U64(count)).astype(np.intp)
            sums = np.zeros(count, _U64)
            np.add.at(sums, block, _mix(columns))
            filled = np.bincount(block, minlength=count) > 0
            number = np.arange(count, dtype=_U64) + _U64(size_class << 32)
            own = [_mix(sums[filled] ^ _mix(number[filled]))]
            if count - filled.sum() > spare:
                # Too few columns for its blocks: any other row like it may agree in empty blocks only.
                own.append(_mix(np.array([(size_class << 32) + (1 << 31)], _U64)))
            keys.append((np.concatenate(own) & ~_U64(CLASSES - 1)) | _U64(size_class % CLASSES))
        return np.concatenate(keys) if keys else np.empty(0, _U64)


_FILLS = pa.list_(pa.struct([("class", pa.int32()), ("filled", pa.int32()), ("need", pa.int32())]))


def _incidence(num: int, den: int, n: int):
    """Size and name of each document's row, and what its blocks are like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = BlockScheme(num, den)
        for batch in batches:
            sets = ngram_sets(batch.column(1).cast(pa.binary()).to_pylist(), n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([row_name(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([scheme.fills(s) for s in sets], _FILLS),
                ],
                names=["id", "n_shingles", "row", "fills"],
            )

    return run


def _block_rows(num: int, den: int, n: int):
    """Every block row of every document, with the name of its row; of copies in one task, mostly one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = BlockScheme(num, den)
        seen: set[int] = set()
        for batch in batches:
            for columns in ngram_sets(batch.column(0).cast(pa.binary()).to_pylist(), n):
                name = row_name(columns) if len(columns) else None
                if name is None or name in seen:
                    continue
                if len(seen) >= _COPY_MEMORY:
                    seen.clear()
                seen.add(name)
                keys = scheme.keys(columns)
                if len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), name, np.int64))], names=["key", "row"]
                    )

    return run


def _rows_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ngram_sets(batch.column(1).cast(pa.binary()).to_pylist(), n)
            same = [i for i, (s, row) in enumerate(zip(sets, batch.column(0).to_pylist())) if row_name(s) == row]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(same, pa.int64())),
                    pa.array([sets[i].tobytes() for i in same], pa.binary()),
                ],
                names=["row", "columns"],
            )

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which rows of ``left`` and ``right`` link: a blocked product, accumulated over slices of common columns."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    # den * i >= num * (a + b - i) for an overlap of i.
    bound = -(-num * (a[:, None] + b[None, :]) // (num + den))
    columns, at = np.unique(np.concatenate(left + right), return_inverse=True)
    split = int(a.sum())
    on_left = np.bincount(at[:split], minlength=len(columns))
    on_right = np.bincount(at[split:], minlength=len(columns))
    common = np.flatnonzero((on_left > 0) & (on_right > 0))
    place = np.full(len(columns), -1)
    place[common] = np.arange(len(common))
    at = place[at]
    rows_left, rows_right = np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)
    at_left, at_right = at[:split], at[split:]
    counts = np.zeros(bound.shape, np.int64)
    open_pairs = np.minimum(a[:, None], b[None, :]) >= bound
    for start in range(0, len(common), COLUMN_SLICE):
        width = min(COLUMN_SLICE, len(common) - start)
        part = []
        for rows, places, size in ((rows_left, at_left, len(a)), (rows_right, at_right, len(b))):
            inside = (places >= start) & (places < start + width)
            block = np.zeros((size, width), np.float32)
            block[rows[inside], places[inside] - start] = 1
            part.append(block)
        use_left, use_right = open_pairs.any(axis=1), open_pairs.any(axis=0)
        if not use_left.any():
            break
        product = part[0][use_left] @ part[1][use_right].T
        counts[np.ix_(use_left, use_right)] += product.astype(np.int64)
        open_pairs &= counts + (len(common) - start - width) >= bound
    return open_pairs & (counts >= bound)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row of its component."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] < 0:
            root[start] = start
            waiting = [start]
            while waiting:
                new = np.flatnonzero(linked[waiting.pop()] & (root < 0))
                root[new] = start
                waiting.extend(new.tolist())
    return root


def _product(num: int, den: int):
    """Links inside one bin: small groups whole, or one pair of row blocks of a large group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for _, group in frame.drop_duplicates(["group", "row"]).groupby("group", sort=False):
            rows = group["row"].to_numpy()
            sets = [np.frombuffer(x, _U64) for x in group["columns"]]
            copies = group["copies"].to_numpy()
            block, first, second = group["block"].to_numpy(), group["first"].iloc[0], group["second"].iloc[0]
            left = np.flatnonzero(block == first)
            right = left if first == second else np.flatnonzero(block == second)
            if not len(left) or not len(right):
                continue
            linked = overlaps([sets[i] for i in left], [sets[i] for i in right], num, den)
            if first == second:
                np.fill_diagonal(linked, False)
            elif linked.any():
                left, right = np.concatenate((left, right)), None
                whole = np.zeros((len(left), len(left)), bool)
                whole[: len(linked), len(linked) :] = linked
                linked = whole | whole.T
            if linked.any():
                # One edge for each linked row, to the first row of its component in this product.
                root, links = _roots(linked), linked @ copies[left]
                out.extend(
                    (rows[left[i]], rows[left[root[i]]], links[i]) for i in np.flatnonzero(linked.any(axis=1))
                )
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    return run


def _shared(keys: DataFrame) -> DataFrame:
    """Rows ``(key, row)`` whose key more than one row has, with ``size``, their number, and ``least``, one of them."""
    keys = keys.repartition("key")
    groups = keys.groupBy("key").agg(
        F.min("row").alias("least"), F.max("row").alias("most"), F.count("*").alias("size")
    )
    groups = groups.filter("least <> most").select("key", "least", "size")
    # Both sides read the same shuffle.
    return keys.join(groups, "key")


def candidate_edges(keys: DataFrame, fills: DataFrame, num: int, den: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all rows that can link, from ``(key, row)`` and the rows' fills.

    ``fills`` has ``row``, ``n``, ``class``, ``filled`` and ``need``.
    """
    # Copies in several tasks name a row more than once.
    shared = saved(_shared(keys).select("key", "row").distinct(), "shared-blocks")
    of_class = F.col("key").bitwiseAND(CLASSES - 1).cast("int")
    for _ in range(DROP_ROUNDS):
        counts = shared.groupBy("row", of_class.alias("class")).agg(F.count("*").alias("held"))
        kept = counts.join(fills, ["row", "class"]).filter("held >= need").select("row", "class")
        shared = shared.select("key", "row", of_class.alias("class")).join(kept, ["row", "class"], "left_semi")
        shared = saved(_shared(shared.select("key", "row")), "shared-blocks")

    # Of the block rows of a row, those of the most rows come first; linked rows meet beyond the first ``need - 1``.
    back = F.row_number().over(Window.partitionBy("row", "class").orderBy(F.desc("size"), F.desc("key")))
    ranked = (
        shared.select("key", "row", of_class.alias("class"), "size")
        .join(fills.select("row", "class", "need"), ["row", "class"])
        .select("key", "row", "class", (F.col("size") > PAIR_GROUP).alias("large"), (back >= F.col("need")).alias("meets"))
    )
    ranked = saved(ranked, "ranked-blocks")

    small = ranked.filter("not large")
    pairs = (
        small.select("key", F.col("row").alias("a"), F.col("meets").alias("meets_a"))
        .join(small.select("key", F.col("row").alias("b"), F.col("meets").alias("meets_b")), "key")
        .filter("a < b")
        .groupBy("a", "b", of_class.alias("class"))
        .agg(F.count("*").alias("agree"), F.max(F.col("meets_a") & F.col("meets_b")).alias("meet"))
        .filter("meet")
    )
    large = ranked.filter("large")
    kinds = fills.join(large.groupBy("row", "class").agg(F.count("*").alias("large")), ["row", "class"], "left")

    def side(name: str) -> DataFrame:
        return kinds.select(
            F.col("row").alias(name),
            "class",
            F.col("n").alias(f"n_{name}"),
            F.col("filled").alias(f"filled_{name}"),
            F.coalesce("large", F.lit(0)).alias(f"large_{name}"),
        )

    total = F.col("n_a") + F.col("n_b")
    differ = F.floor(total * (den - num) / (den + num))
    small_edges = (
        pairs.join(side("a"), ["a", "class"])
        .join(side("b"), ["b", "class"])
        .filter(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
        .filter(F.col("agree") + F.least("large_a", "large_b") >= F.greatest("filled_a", "filled_b") - differ)
        .select("a", "b")
    )
    large_edges = _shared(large.filter("meets").select("key", "row")).filter("row <> least")
    return small_edges.union(large_edges.select(F.col("row").alias("a"), F.col("least").alias("b"))).distinct()


def ngram_join(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id`` (least id reachable by links, itself included)
    and ``n_links`` (documents linked with it, copies counted one by one).

    Two documents link when ``den * overlap >= num * union``.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(texts.dtypes)["id"]
    fills = "array<struct<class:int,filled:int,need:int>>"
    incidence = saved(
        texts.mapInArrow(_incidence(num, den, n), f"id {kind}, n_shingles long, row long, fills {fills}"), "incidence"
    )
    rows = incidence.filter("row is not null").groupBy("row").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = (
        incidence.filter("row is not null")
        .groupBy("row")
        .agg(F.first("n_shingles").alias("n"), F.first("fills").alias("fills"))
        .select("row", "n", F.inline("fills"))
    )
    keys = texts.select("text").mapInArrow(_block_rows(num, den, n), "key long, row long")
    groups = saved(components(candidate_edges(keys, saved(classes, "classes"), num, den)), "groups")

    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bins = max(1, -(-total // ROW_BLOCK))
    members = (
        groups.join(sizes, "component")
        .join(rows, groups["node"] == rows["row"])
        .select(
            F.col("component").alias("group"),
            "row",
            "id",
            "copies",
            F.ceil(F.col("size") / ROW_BLOCK).cast("int").alias("blocks"),
        )
    )
    members = saved(members, "members")
    # The members grow with the input, so they are never broadcast, small as they may be.
    carriers = members.select("row", F.col("id").alias("rep")).hint("merge")
    content = texts.join(carriers, texts["id"].eqNullSafe(F.col("rep"))).select("row", "text")
    content = content.mapInArrow(_rows_of(n), "row long, columns binary")
    blocked = members.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    blocked = blocked.select(
        "group",
        "row",
        "copies",
        "block",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(bins))).otherwise(F.lit(-1)).alias("bin"),
        F.when(F.col("blocks") > 1, F.col("group")).alias("large"),
    )
    linked = saved(
        blocked.join(content, "row")
        .groupBy("bin", "large", "first", "second")
        .applyInPandas(_product(num, den), "a long, b long, links long"),
        "links",
    )
    found = components(linked.select("a", "b").distinct())

    by_row = (
        rows.join(found, rows["row"] == found["node"], "left")
        .join(linked.groupBy("a").agg(F.sum("links").alias("links")), F.col("row") == F.col("a"), "left")
        .select("row", "id", "copies", F.coalesce("component", "row").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    named = by_row.groupBy("component").agg(F.min("id").alias("component_id"))
    named = by_row.join(named, "component").select("row", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return incidence.select("id", "n_shingles", "row").join(named, "row", "left").select(
        "id",
        "n_shingles",
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
