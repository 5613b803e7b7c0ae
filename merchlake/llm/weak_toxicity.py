"""Toxicity scores by weak supervision: many voters, a generative label model, a linear classifier.

1. *Lexicon.* From a bounded sample of labelled training rows (``SAMPLE_ROWS``, documented bound), words and word
   beginnings that stand far more often in toxic texts than in others. A fifth of the sample is kept apart.
2. *Voters.* Each looks at a text and fires or not: parts of the word lexicon, beginnings of each length, a general
   list of insults, patterns of address and shouting, and voters for the absence of evidence. At most 2^16
   patterns of votes exist, so their counts over *all* documents are a small table.
3. *Label model.* Expectation maximisation over those counts estimates, without labels, how often each voter fires on
   toxic and on other texts (its accuracy), and how strongly voters agree beyond what the label explains (their
   correlation). Correlated voters share their weight. The labelled rows kept apart anchor the two classes.
4. *Classifier.* Logistic regression on lexicon entries and their density, fitted on the posterior labels of the
   sampled labelled rows, scores every whole text.

Rows whose ``crc32(id) mod 3`` is 1 are held out: their labels are never read. Source, language, id and labels are
never inputs of a score. Null and empty texts have no evidence and get the score of the bias. Without any toxic
training row every score is 0. Repeated rows are scored alike, and rows that tie in id or text are each scored; texts of
any length are read whole, and words of any length are entries. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.batches import least_hashed, map_rows
from merchlake.llm.components import saved

#: Labelled rows that the lexicon and the classifier are fitted on, at most.
SAMPLE_ROWS = 12_000
#: Distinct features that a task counts before it hands them on, and how many of them in one batch.
HELD_FEATURES = 1 << 16
HANDED_ROWS = 1 << 14
LEAST_SUPPORT = 3
LEAST_ODDS = 40.0
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"\byou(?:'re| are| r)?(?: all| such)?(?: an?| the)? \w+", re.IGNORECASE)
_SHOUT = re.compile(r"!{2,}|\b[A-Z]{4,}\b")
INSULTS = frozenset(
    "ass asshole bastard bitch clown crap creep cretin disgusting dumb dumbass fool freak garbage idiot imbecile jerk"
    " loser moron pathetic pig psycho scum shit shut stupid sucker trash ugly vermin worthless".split()
)

WORD_PARTS = 4
VOTERS = [
    *(f"words_{i}" for i in range(WORD_PARTS)),
    *(f"begin_{k}" for k in PREFIXES),
    "insult",
    "address",
    "shout",
    "two_hits",
    "many_hits",
    "dense_hits",
    "no_hits",
]


@dataclass(frozen=True)
class Lexicon:
    """Entries by number; a whole word ends with ``$``, a beginning does not."""

    entries: tuple[str, ...]

    def index(self) -> tuple[dict[str, list[tuple[int, str]]], int]:
        """Entries by their first characters, as many as the shortest beginning has (or fewer, for short words)."""
        head = min(PREFIXES)
        by_head: dict[str, list[tuple[int, str]]] = {}
        for number, entry in enumerate(self.entries):
            by_head.setdefault(entry.rstrip("$")[:head], []).append((number, entry))
        return by_head, head


def features(text: str | None) -> set[str]:
    """Distinct words and word beginnings of a text."""
    found: set[str] = set()
    for word in set(_WORD.findall(text.lower())) if text else ():
        found.add(word + "$")
        found.update(word[:k] for k in PREFIXES if k <= len(word))
    return found


def _count_features(batches):
    """Per task: in how many toxic and other texts each feature of its toxic texts and others stands."""
    import pyarrow as pa

    counts: tuple[Counter, Counter] = Counter(), Counter()

    def handed_on() -> Iterator[pa.RecordBatch]:
        names = iter(counts[0].keys() | counts[1].keys())
        while part := list(islice(names, HANDED_ROWS)):
            yield pa.RecordBatch.from_pydict(
                {
                    "feature": pa.array(part, pa.string()),
                    "pos": pa.array([counts[1][f] for f in part], pa.int64()),
                    "neg": pa.array([counts[0][f] for f in part], pa.int64()),
                }
            )
        for own in counts:
            own.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(features(text))
            if len(counts[0]) + len(counts[1]) > HELD_FEATURES:
                yield from handed_on()
    yield from handed_on()


def training_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id``, ``text`` and ``toxic`` of at most ``SAMPLE_ROWS`` labelled rows that are not held out."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = least_hashed(known, F.xxhash64("id"), SAMPLE_ROWS)
    # The broadcast side is bounded by SAMPLE_ROWS.
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries that mark toxic texts; none if the rows are of one class only."""
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    total, positive = size["n"] or 0, size["pos"] or 0
    if not positive or positive == total:
        return Lexicon(())
    counted = (
        rows.select("text", "toxic")
        .mapInArrow(_count_features, "feature string, pos long, neg long")
        .groupBy("feature")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    counted = saved(counted.filter(F.col("pos") >= LEAST_SUPPORT), "toxicity-features")
    tested = counted.count()
    odds = ((F.col("pos") + 0.5) / (positive + 1)) / ((F.col("neg") + 0.5) / (total - positive + 1))
    share = positive / total
    seen = F.col("pos") + F.col("neg")
    # Likelihood ratio against chance; its floor grows with the number of features tried.
    gain = 2 * (
        F.col("pos") * F.log(F.col("pos") / (seen * share))
        + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (seen * (1 - share)))).otherwise(0.0)
    )
    # Entries pass a test against chance on at most SAMPLE_ROWS rows, so their number is bounded by those rows' words.
    best = counted.filter((odds >= LEAST_ODDS) & (gain >= 2 * math.log(max(tested, 2)))).select("feature")
    return Lexicon(tuple(sorted(r["feature"] for r in best.collect())))


def _evidence(shared: Broadcast):
    """Votes as bits, and the lexicon entries found, of one text."""

    def make():
        lexicon = Lexicon(shared.value)
        by_head, head = lexicon.index()
        voter = {name: 1 << i for i, name in enumerate(VOTERS)}
        part = [
            voter[f"words_{sum(entry.encode()) % WORD_PARTS}"] if entry.endswith("$") else voter[f"begin_{len(entry)}"]
            for entry in lexicon.entries
        ]

        def row(doc_id, text) -> Iterator[tuple]:
            votes, hits, matched, size = 0, [], 0, 0
            if text:
                found = _WORD.findall(text.lower())
                distinct, size = set(found), len(found)
                seen: set[int] = set()
                for word in distinct:
                    near = by_head.get(word[:head])
                    if near:
                        own = [
                            number
                            for number, entry in near
                            if entry == word + "$" or (entry[-1] != "$" and word.startswith(entry))
                        ]
                        matched += bool(own)
                        seen.update(own)
                hits = sorted(seen)
                for number in hits:
                    votes |= part[number]
                if not distinct.isdisjoint(INSULTS):
                    votes |= voter["insult"]
                    if any(m[0].split()[-1].lower() in INSULTS for m in _ADDRESS.finditer(text)):
                        votes |= voter["address"]
                if _SHOUT.search(text):
                    votes |= voter["shout"]
            if matched >= 2:
                votes |= voter["two_hits"]
            if matched >= 4:
                votes |= voter["many_hits"]
            if matched * 200 > size:
                votes |= voter["dense_hits"]
            if not hits:
                votes |= voter["no_hits"]
            yield doc_id, votes, hits, matched, size

        return row

    return make


@dataclass
class LabelModel:
    """How voters fire given the label, and the weight left to each after correlations."""

    prior: float
    fires: np.ndarray  # 2 x voters: probability of firing on other and on toxic texts
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic label for rows of votes (0 or 1)."""
        log = np.where(votes[:, None, :] == 1, np.log(self.fires), np.log1p(-self.fires))
        odds = ((log[:, 1] - log[:, 0]) * self.weight).sum(axis=1) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def fit_label_model(
    votes: np.ndarray, counts: np.ndarray, anchored: np.ndarray, labels: np.ndarray, rounds: int = 60
) -> LabelModel:
    """Expectation maximisation over distinct vote patterns and how many rows have each.

    ``anchored`` are vote rows whose labels are known; they keep their class, and weigh as much as all others together.
    """
    voters = votes.shape[1]
    total = counts.sum()
    patterns = np.concatenate([votes, anchored])
    weights = np.concatenate([counts, np.full(len(anchored), total / max(len(anchored), 1))])
    known = np.stack([1 - labels, labels])
    fires = (known @ anchored + 0.5) / (known.sum(axis=1, keepdims=True) + 1)
    prior = float(np.clip(labels.mean() if len(labels) else 0.1, 1e-3, 0.5))
    model = LabelModel(prior, fires, np.full(voters, 1 / 3), np.eye(voters))
    for _ in range(rounds):
        share = np.concatenate([model.posterior(votes), labels])
        mass = np.stack([(1 - share) * weights, share * weights])
        model.fires = np.clip((mass @ patterns + 0.5) / (mass.sum(axis=1, keepdims=True) + 1), 1e-3, 1 - 1e-3)
        model.prior = float(np.clip(mass[1].sum() / weights.sum(), 1e-3, 0.5))
        # Agreement beyond the label: correlation of the residuals within each class.
        spread = np.zeros((voters, voters))
        for label in (0, 1):
            rest = patterns - model.fires[label]
            spread += (rest * mass[label][:, None]).T @ rest
        scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        model.correlation = spread / np.outer(scale, scale)
        tied = np.abs(model.correlation)
        np.fill_diagonal(tied, 1.0)
        model.weight = 1 / tied.sum(axis=1)
    return model


def classifier_inputs(hits: list[list[int]], matched: np.ndarray, size: np.ndarray, entries: int) -> np.ndarray:
    """Lexicon entries present, then how many words matched, how dense they are, and a bias."""
    x = np.zeros((len(hits), entries + 4), np.float32)
    for i, found in enumerate(hits):
        x[i, found] = 0.25
    x[:, -4] = np.minimum(matched, 10) / 5
    x[:, -3] = np.log1p(matched)
    x[:, -2] = np.minimum(100 * matched / np.maximum(size, 20), 2)
    x[:, -1] = 1
    return x


def fit_classifier(x: np.ndarray, target: np.ndarray, penalty: float = 1e-4, rounds: int = 500) -> np.ndarray:
    """Weights of a logistic regression, the bias last; gradient descent with momentum."""
    y = target.astype(np.float32)
    weights, momentum = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        ahead = weights + 0.9 * momentum
        share = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = x.T @ (share - y) / np.float32(len(y)) + np.float32(penalty) * np.append(ahead[:-1], 0).astype(np.float32)
        momentum = 0.9 * momentum - 0.5 * slope
        weights = weights + momentum
    return weights


def _score(shared: Broadcast):
    def make():
        weights: np.ndarray = shared.value

        def row(doc_id, hits, matched, size) -> Iterator[tuple]:
            x = classifier_inputs([hits], np.array([matched]), np.array([size]), len(weights) - 4)
            yield doc_id, 1 / (1 + math.exp(-min(max(float((x @ weights)[0]), -60), 60)))

        return row

    return make


def vote_bits(votes: list[int]) -> np.ndarray:
    return ((np.array(votes, np.int64).reshape(-1, 1) >> np.arange(len(VOTERS))) & 1).astype(np.float64)


def vote_patterns(evidence: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns over all documents (at most 2 to the number of voters) and their counts."""
    counted = evidence.groupBy("votes").agg(F.count("*").alias("n")).collect()
    return vote_bits([r["votes"] for r in counted]), np.array([r["n"] for r in counted], float)


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: ``id``, ``held_out``, ``score`` and ``predicted`` (1 from ``THRESHOLD`` on).

    Ids need not be unique; where rows must be told apart, ``row_col`` is handed on as ``row``.
    """
    spark = documents.sparkSession
    key, doc_id = F.col(id_col), "id"
    if row_col is not None:
        key, doc_id = F.struct(F.col(id_col).alias("doc"), F.col(row_col).alias("row")), "id.doc"
    train = saved(training_rows(documents, labels, id_col, text_col, label_col), "toxicity-train")
    apart = F.pmod(F.xxhash64("id", F.lit("apart")), F.lit(5)) == 0
    lexicon = learn_lexicon(train.filter(~apart))
    texts = documents.select(key.alias("id"), F.col(text_col))
    kind = dict(texts.dtypes)["id"]
    find = _evidence(spark.sparkContext.broadcast(lexicon.entries))
    shape = "votes int, hits array<int>, matched int, size int"
    evidence = saved(map_rows(texts, find, f"id {kind}, {shape}"), "toxicity-evidence")
    if lexicon.entries:
        votes, counts = vote_patterns(evidence)
        anchors = map_rows(train.filter(apart).select("toxic", "text"), find, f"id int, {shape}").select("id", "votes").collect()
        model = fit_label_model(votes, counts, vote_bits([r["votes"] for r in anchors]), np.array([r["id"] for r in anchors], float))
        # At most SAMPLE_ROWS labelled rows (more only where documents share an id).
        sample = map_rows(train.select(F.lit(0).alias("id"), "text"), find, f"id int, {shape}").toPandas()
        inputs = classifier_inputs(
            sample["hits"].tolist(), sample["matched"].to_numpy(), sample["size"].to_numpy(), len(lexicon.entries)
        )
        weights = fit_classifier(inputs, model.posterior(vote_bits(sample["votes"].tolist())))
        scored = map_rows(
            evidence.select("id", "hits", "matched", "size"),
            _score(spark.sparkContext.broadcast(weights)),
            f"id {kind}, score double",
        )
    else:
        scored = evidence.select("id", F.lit(0.0).alias("score"))
    return scored.select(
        F.col(doc_id).alias("id"),
        held_out(doc_id).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        *([] if row_col is None else [F.col("id.row").alias("row")]),
    )
