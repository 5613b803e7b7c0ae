"""Mixing sources to target weights by temperature.

Each source's share of all tokens is raised to an exponent and normalised. At 1 the mixture is proportional, at 0 every
source weighs the same. The exponent is bisected (several points a round, evaluated over the table of sources by one
aggregation): the largest one whose mixture reaches the target entropy, raised where it must be so that no source is
repeated more often than the limit. Without a token budget the mixture is as large as it takes for every document to
be drawn at least once.

*Drawing.* A source's allotment is whole passes over its documents and a remainder. Its documents are dealt into
``BLOCKS`` blocks; each pass orders the blocks, and the documents in a block, by a hash of seed and pass. The remainder
takes whole blocks of its permutation while they fit the budget, then documents of the next block.

Tokens are runs of characters other than white space. Null texts have none; documents of sources without any tokens
are drawn once. A null source is a source of its own. Repeated rows are drawn one by one; all columns are kept, and
the new ones may be left out with :func:`drawn_documents`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from merchlake.llm.components import saved

BLOCKS = 1024
TARGET_ENTROPY = 0.98
MAX_REPETITION = 1.5
SEED = 17
POINTS = 16
ROUNDS = 7
#: Rows of a table that may be broadcast (about 50 bytes each); larger ones are joined by key.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Mixture:
    exponent: float
    entropy: float
    repetition: float
    budget: float


def source_key(source_col: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))


def token_count(text_col: str) -> F.Column:
    text = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " "))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, " ", "")) + 1).cast("long")


def evaluate(sources: DataFrame, exponents: list[float], budget: float | None) -> list[Mixture]:
    """Entropy and largest repetition of the mixtures at some exponents, in one pass over the sources.

    ``sources`` has ``tokens``, all positive, and ``share``.
    """
    log = F.log("share")
    columns = []
    for i, exponent in enumerate(exponents):
        raised = F.exp(log * exponent)
        columns += [F.sum(raised).alias(f"z{i}"), F.sum(raised * log).alias(f"l{i}")]
        columns += [F.max(raised / F.col("tokens")).alias(f"m{i}"), F.min(raised / F.col("tokens")).alias(f"n{i}")]
    r = sources.agg(*columns).first()
    found = []
    for i, exponent in enumerate(exponents):
        z = r[f"z{i}"]
        entropy = math.log(z) - exponent * r[f"l{i}"] / z
        # Without a budget, the least repeated source is drawn exactly once.
        tokens = budget if budget is not None else z / r[f"n{i}"]
        found.append(Mixture(exponent, entropy, tokens * r[f"m{i}"] / z, tokens))
    return found


def fit_exponent(
    sources: DataFrame, target_entropy: float, max_repetition: float, budget: float | None = None
) -> Mixture:
    """The mixture nearest to proportional with the target share of the highest entropy, within the repetition limit."""
    count = sources.count()
    target = target_entropy * math.log(count) if count > 1 else 0.0

    def search(good_at_zero: bool, good) -> float:
        """Bisect [0, 1] for where ``good`` changes; the side on which it holds."""
        low, high = 0.0, 1.0
        ends = evaluate(sources, [low, high], budget)
        if good_at_zero:
            if good(ends[1]):
                return high
        elif good(ends[0]) or not good(ends[1]):
            return low if good(ends[0]) else high
        for _ in range(ROUNDS):
            inner = [low + (high - low) * i / (POINTS + 1) for i in range(1, POINTS + 1)]
            holds = [good(m) for m in evaluate(sources, inner, budget)]
            edges = [low, *inner, high]
            first = holds.index(not good_at_zero) if (not good_at_zero) in holds else POINTS
            low, high = edges[first], edges[first + 1]
        return low if good_at_zero else high

    slack = 1e-9
    by_entropy = search(True, lambda m: m.entropy >= target - slack)
    by_repetition = search(False, lambda m: m.repetition <= max_repetition + slack)
    return evaluate(sources, [max(by_entropy, by_repetition)], budget)[0]


def _small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its checked size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix_sources(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float = TARGET_ENTROPY,
    max_repetition: float = MAX_REPETITION,
    budget: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One row per draw: ``row`` (the document's columns), ``n_tokens``, ``weight`` of its source, ``epoch``, and
    ``block`` and ``place``, by which the draws of a source and epoch are ordered.
    """
    spark = documents.sparkSession
    keyed = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"),
        source_key(source_col).alias("source"),
        token_count(text_col).alias("n_tokens"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(BLOCKS)).cast("int").alias("block"),
        F.xxhash64(F.col(id_col), F.lit(seed + 1)).alias("mark"),
    )
    blocks = saved(keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "mix-blocks")
    tokens = blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens"))
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    sources = saved(tokens.withColumn("share", F.col("tokens") / F.lit(max(total, 1))), "mix-sources")
    some = sources.filter("tokens > 0")
    if total:
        mixture = fit_exponent(some, target_entropy, max_repetition, budget)
        z = some.agg(F.sum(F.exp(F.log("share") * mixture.exponent))).first()[0]
        weight = F.exp(F.log("share") * mixture.exponent) / z
        size = mixture.budget
    else:
        weight, size = F.lit(0.0), 0.0
    weight = F.when(F.col("tokens") > 0, weight).otherwise(0.0)
    allotment = F.col("weight") * F.lit(float(size))
    sources = sources.withColumn("weight", weight).withColumn(
        # A hair above whole passes is rounding, not a remainder.
        "passes",
        F.when(F.col("tokens") > 0, F.floor(allotment / F.col("tokens") + 1e-9)).otherwise(1).cast("int"),
    )
    sources = sources.withColumn(
        "rest", F.greatest(F.lit(0), F.floor(allotment - F.col("passes") * F.col("tokens") + 1e-6)).cast("long")
    )
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", "passes", F.lit(seed)), "block")
    # A window over the blocks of a source, of which there are at most BLOCKS.
    plan = (
        blocks.join(sources.select("source", "weight", "passes", "rest"), "source")
        .withColumn("filled", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("left", F.col("rest") - F.col("filled") + F.col("block_tokens"))
        .select("source", "block", "weight", "passes", F.greatest("left", F.lit(0)).alias("left"), "block_tokens")
    )
    plan = saved(plan, "mix-plan")
    drawn = keyed.join(_small(plan), ["source", "block"])
    whole = F.col("left") >= F.col("block_tokens")
    none = F.col("left") <= 0
    sure = drawn.filter(whole | none).withColumn("times", F.col("passes") + F.when(none, 0).otherwise(1))
    # One block of a source at most is cut.
    in_block = Window.partitionBy("source", "block").orderBy("mark", "n_tokens")
    cut = (
        drawn.filter(~(whole | none))
        .withColumn("filled", F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("times", F.col("passes") + F.when(F.col("filled") <= F.col("left"), 1).otherwise(0))
        .select(*sure.columns)
    )
    return (
        sure.unionByName(cut)
        .filter("times > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
        .select(
            "row",
            "n_tokens",
            "weight",
            "epoch",
            F.xxhash64("block", "epoch", F.lit(seed)).alias("block"),
            F.xxhash64("mark", "epoch").alias("place"),
        )
    )


def drawn_documents(draws: DataFrame) -> DataFrame:
    """The drawn documents with their own columns only."""
    return draws.select("row.*")
