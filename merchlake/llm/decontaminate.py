"""Benchmark decontamination by matching training text against a generalised suffix automaton.

Test items are cut into words (ASCII lower case; letters, digits and everything beyond ASCII) and put into one
automaton. Training words are streamed through it; wherever the longest match reaches the window of
``window`` words, the last ``window`` words stand in some item, and all of them are hit. An item shorter
than the window counts when it occurs as a whole. Hit words join into spans.

The test set is read in blocks of at most ``BLOCK_WORDS`` words, the only data sent to every task; a larger
set takes several passes over the documents with the same result.

Null and empty texts have no words. Items of a null text or without words match nothing; an item id that occurs
twice counts once. A null item id is an id like another, counted among a document's items and left out of the digest. Repeated rows are each judged. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.batches import WORD, map_rows, words
from merchlake.llm.components import saved
from merchlake.llm.suffix_automaton import SuffixAutomaton

WINDOW = 10
#: Words of one block of test items (about 30 MB as an automaton).
BLOCK_WORDS = 200_000
#: A document is dropped when more than this share of its words is hit; otherwise its spans are cut out.
MAX_COVERAGE = 0.5

Span = tuple[int, int]
Item = tuple[str | None, list[str]]

_FOUND = "id {id}, text string, n_words long, spans array<struct<first:int,last:int>>, items array<string>"


def item_automaton(items: list[Item], window: int) -> SuffixAutomaton:
    """Automaton of the items with each distinct window marked once; ``holders`` has the items of every mark."""
    automaton = SuffixAutomaton(item for _, item in items)
    numbers: dict[tuple[str, ...], int] = {}
    automaton.holders = []
    for item_id, item in items:
        size = min(window, len(item))
        for start in range(len(item) - size + 1 if size else 0):
            run = tuple(item[start : start + size])
            if run not in numbers:
                numbers[run] = len(numbers)
                automaton.holders.append(set())
                automaton.mark(list(run), numbers[run])
            automaton.holders[numbers[run]].add(item_id)
    automaton.settle()
    return automaton


def merge_spans(spans: list[Span]) -> list[Span]:
    """Disjoint spans, in order; both ends inclusive. Spans that touch become one."""
    merged: list[Span] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            if last > merged[-1][1]:
                merged[-1] = merged[-1][0], last
        else:
            merged.append((first, last))
    return merged


def find_spans(automaton: SuffixAutomaton, stream: list[str], least: int) -> tuple[list[Span], set[str | None]]:
    """Hit spans of a word stream and the items whose windows they hold."""
    spans: list[Span] = []
    marks: set[int] = set()
    for position, state, matched in automaton.matching(stream, least):
        for length, mark in automaton.marks_at(state, matched):
            first = position - length + 1
            if spans and spans[-1][0] <= first <= spans[-1][1] + 1:
                spans[-1] = spans[-1][0], max(position, spans[-1][1])
            else:
                spans.append((first, position))
            marks.add(mark)
    return merge_spans(spans), set().union(*(automaton.holders[mark] for mark in marks))


def _shortest(items: list[Item], window: int) -> int:
    return min((min(window, len(item)) for _, item in items if item), default=window)


def _scan(shared: Broadcast, window: int) -> Callable[[], Callable[..., Iterator[tuple]]]:
    def make() -> Callable[..., Iterator[tuple]]:
        automaton = item_automaton(shared.value, window)
        least = _shortest(shared.value, window)

        def row(doc_id, text, _, spans, items) -> Iterator[tuple]:
            stream = words(text)
            found, hit = find_spans(automaton, stream, least)
            if spans:
                found = merge_spans(found + [(s["first"], s["last"]) for s in spans])
            spans = [{"first": first, "last": last} for first, last in found]
            yield doc_id, text, len(stream), spans, sorted(hit.union(items or ()), key=lambda i: (i is None, i or ""))

        return row

    return make


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter(
        "text is not null"
    )


def count_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> int:
    """How many blocks of about ``block_words`` words the test items make."""
    size = _items(benchmark, id_col, text_col).agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    return max(1, -(-size // (4 * block_words)))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, count: int) -> Iterator[list[Item]]:
    """Test items in ``count`` blocks, each fetched when it is asked for."""
    items = _items(benchmark, id_col, text_col)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    for i in range(count):
        yield [(r["item"], words(r["text"])) for r in items.filter(block == i).distinct().collect()]


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: ``id``, ``text``, ``n_words``, hit ``spans`` (word numbers) and matched ``items``."""
    spark = documents.sparkSession
    schema = _FOUND.format(id=dict(documents.dtypes)[id_col])
    found = documents.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(null as array<struct<first:int,last:int>>)").alias("spans"),
        F.expr("cast(null as array<string>)").alias("items"),
    )
    count = count_blocks(benchmark, item_col, item_text_col, block_words)
    for number, block in enumerate(item_blocks(benchmark, item_col, item_text_col, count)):
        if number:
            found = saved(found, "decontaminate")
        found = map_rows(found, _scan(spark.sparkContext.broadcast(block), window), schema)
    return found


def hit_counts(found: DataFrame) -> DataFrame:
    """Counts and a digest of the matched items, from the result of :func:`find_contamination`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[Span]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(_UPPER))]
    kept, start = [], 0
    for first, last in spans:
        kept.append(text[start : at[first][0]].rstrip(" "))
        start = at[last][1]
    kept.append(text[start:])
    return "\n".join(part for part in kept if part)


# Upper-case ASCII letters are words' letters too once lowered; positions stay the same.
_UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _clean(shared: Broadcast, window: int, max_span: int, max_coverage: float):
    def make() -> Callable[..., Iterator[tuple]]:
        automaton = item_automaton(shared.value, window)
        least = _shortest(shared.value, window)

        def row(number, text) -> Iterator[tuple]:
            stream = words(text)
            total, cut = len(stream), 0
            while True:
                spans, _ = find_spans(automaton, stream, least)
                spans = [s for s in spans if s[1] - s[0] + 1 > max_span]
                if not spans:
                    break
                cut += sum(last - first + 1 for first, last in spans)
                text = cut_spans(text, spans)
                stream = words(text)
            # Cutting may join what stood apart, hence the loop.
            yield number, text, cut > max_coverage * total, cut

        return row

    return make


def _cut(max_span: int, max_coverage: float):
    """Cuts the spans found in all blocks; ``again`` where what is left must be looked through once more."""

    def make() -> Callable[..., Iterator[tuple]]:
        def row(number, text, total, spans, cut) -> Iterator[tuple]:
            found = [(s["first"], s["last"]) for s in spans or () if s["last"] - s["first"] + 1 > max_span]
            cut += sum(last - first + 1 for first, last in found)
            drop = cut > max_coverage * total
            yield number, cut_spans(text, found) if found else text, total, cut, drop, bool(found) and not drop

        return row

    return make


def _collect(shared: Broadcast, window: int):
    """Adds the spans of one block of items to those found before; ``total`` is the first count of words."""

    def make() -> Callable[..., Iterator[tuple]]:
        automaton = item_automaton(shared.value, window)
        least = _shortest(shared.value, window)

        def row(number, text, total, spans, cut) -> Iterator[tuple]:
            stream = words(text)
            found, _ = find_spans(automaton, stream, least)
            found = merge_spans(found + [(s["first"], s["last"]) for s in spans or ()])
            spans = [{"first": first, "last": last} for first, last in found]
            yield number, text, len(stream) if total is None else total, spans, cut

        return row

    return make


def remove_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_span: int = 0,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents, all columns, with contaminated spans cut out of the text.

    Spans of more than ``max_span`` words go; so does a whole document when more than ``max_coverage`` of
    its words were in such spans. Documents without hits come back unchanged.
    """
    spark = documents.sparkSession
    columns = documents.columns
    names = {c: f"c{i}" for i, c in enumerate(columns) if c != text_col}
    # A field of its own, as there may be no other column.
    rows = documents.select(
        F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(name) for c, name in names.items())).alias("row"),
        F.col(text_col).alias("t"),
    )
    kind = dict(rows.dtypes)["row"]
    count = count_blocks(benchmark, item_col, item_text_col, block_words)
    if count == 1:
        (block,) = item_blocks(benchmark, item_col, item_text_col, count)
        shared = spark.sparkContext.broadcast(block)
        cleaned = map_rows(rows, _clean(shared, window, max_span, max_coverage), f"row {kind}, t string, drop boolean, cut long")
    else:
        # The same in rounds: all blocks see the same text, and only texts that were cut are looked through again.
        state = f"row {kind}, t string, total long, spans array<struct<first:int,last:int>>, cut long"
        no_spans = F.expr("cast(null as array<struct<first:int,last:int>>)").alias("spans")
        live = rows.select("row", "t", F.lit(None).cast("long").alias("total"), no_spans, F.lit(0).cast("long").alias("cut"))
        cleaned = None
        while cleaned is None or not live.isEmpty():
            for number, block in enumerate(item_blocks(benchmark, item_col, item_text_col, count)):
                if number:
                    live = saved(live, "decontaminate")
                live = map_rows(live, _collect(spark.sparkContext.broadcast(block), window), state)
            result = f"row {kind}, t string, total long, cut long, drop boolean, again boolean"
            judged = saved(map_rows(live, _cut(max_span, max_coverage), result), "decontaminate")
            settled = judged.filter("not again").select("row", "t", "drop", "cut")
            cleaned = settled if cleaned is None else cleaned.union(settled)
            live = judged.filter("again").select("row", "t", "total", no_spans, "cut")
    return cleaned.filter("not drop").select(
        *(F.col("t").alias(c) if c == text_col else F.col(f"row.{names[c]}").alias(c) for c in columns)
    )
