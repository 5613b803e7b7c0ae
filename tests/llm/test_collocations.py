"""Collocations against a plain count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from merchlake.llm import collocations
from merchlake.llm.batches import ascii_lower

SHAPE = "doc_id long, text string, lang string, phrase string, n int, count int, tau long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, 2, 3) for i, (g, t) in enumerate(rows)], SHAPE).repartition(5)


def plain(rows, limit, min_count, longest, cover):
    counts = {}
    for language, text in rows:
        own = counts.setdefault(language or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", ascii_lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for language, own in counts.items():
        n = sum(a for p, a in own.items() if len(p) == 1)
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inner = p[i : i + size]
                    if 100 * a >= cover * own[inner]:
                        covered.add(inner)
        ranked = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, left, right = min(
                    (2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))
                )
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:limit], 1):
            out.append((language, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed, size=250):
    rng = random.Random(seed)
    common = ["the", "of", "and", "a", "è", "中", "x", "y"]
    fixed = ["new york city hall", "machine learning model", "red a red a red", "of the of the", "once upon a time there"]
    rows = []
    for _ in range(size):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(fixed) if rng.random() < 0.15 else rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(40)}")
        text = rng.choice([" ", "  ", "\t"]).join(words)
        text = "".join(rng.choice(".,;:!?\n\r\x0b") if c == " " and rng.random() < 0.06 else c for c in text)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text.upper() if rng.random() < 0.2 else text))
    return rows


def mined(spark, rows, **options):
    return sorted(map(tuple, collocations.mine_collocations(frame(spark, rows), **options).collect()))


@pytest.mark.parametrize("limit, longest", [(2000, 4), (12, 4), (3, 4), (12, 3), (12, 5), (5, 2)])
def test_equals_a_plain_count(spark, limit, longest):
    rows = corpus(limit + longest)
    options = {"limit": limit, "min_count": 6, "longest": longest, "cover": 80}
    assert mined(spark, rows, **options) == plain(rows, **options)


def test_filters_that_let_everything_through_change_nothing(spark, monkeypatch):
    rows = corpus(7, 120)
    options = {"limit": 10, "min_count": 5, "longest": 4, "cover": 80}
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 10)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 200)
    monkeypatch.setattr(collocations, "PART_BYTES", 40)
    assert mined(spark, rows, **options) == plain(rows, **options)


def test_thresholds_fall_until_the_limit_is_settled(spark, monkeypatch):
    # Hundreds of pairs inside one long passage: all of them are covered, so the first wave finds too few.
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [("en", passage)] * 40 + [("en", " ".join(rng.choices(["a", "b", "c", "d"], k=50))) for _ in range(30)]
    waves = []
    plain_wave = collocations._wave
    monkeypatch.setattr(collocations, "_wave", lambda *args: waves.append(1) or plain_wave(*args))
    options = {"limit": 320, "min_count": 5, "longest": 3, "cover": 80}
    assert mined(spark, rows, **options) == plain(rows, **options)
    monkeypatch.setattr(collocations, "FIRST_WAVE", 0.2)
    first = len(waves)
    assert mined(spark, rows, **options) == plain(rows, **options)
    assert len(waves) - first > 1


def test_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", None), (None, ""), ("de", "a b c")], min_count=1, limit=10, longest=4, cover=80) == plain(
        [("en", None), (None, ""), ("de", "a b c")], 10, 1, 4, 80
    )
    long_text = [(None, "Alpha Beta " * 60_000), ("en", "alpha beta. " * 60_000)]
    options = {"limit": 5, "min_count": 30, "longest": 4, "cover": 80}
    assert mined(spark, long_text, **options) == plain(long_text, **options)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**18
    df = spark.createDataFrame([("en", "a b", big, [big], [big - 1])], "lang string, phrase string, a long, heads array<long>, tails array<long>")
    row = collocations._bounded(df, 2).first()
    assert row["score"] == 2_000_000 * big // (2 * big - 1) and row["head_bound"] == 1_000_000


def test_sieve_never_misses():
    sieve = collocations.Sieve(1 << 12)
    rng = np.random.default_rng(1)
    inside = rng.integers(1, 1 << 63, 100, dtype=np.uint64) | np.uint64(1)
    for at in sieve.places(inside):
        np.bitwise_or.at(sieve.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    assert sieve(inside).all()
    assert sieve(rng.integers(1, 1 << 63, 1000, dtype=np.uint64) | np.uint64(1)).mean() < 0.05


def test_tasks_hand_phrases_on_in_pieces(monkeypatch):
    """What a task holds leaves it in bounded batches, all counts complete."""
    monkeypatch.setattr(collocations, "HANDED_ROWS", 7)

    class Texts:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def __getattr__(self, name):
            return lambda *args: self

        def __ge__(self, other):
            return self

    texts = Texts()
    monkeypatch.setattr(collocations, "F", Texts())
    collocations.count_phrases(texts, {1: lambda block: np.flatnonzero(block.hashes(1) != 0)}, 1)
    rows = [("en", " ".join(f"w{n % 40}" for n in range(100))), ("de", "eins zwei eins")]
    names, words = (list(column) for column in zip(*rows))
    batches = list(texts.run(iter([pa.RecordBatch.from_pydict({"lang": names, "text": words})])))
    assert max(batch.num_rows for batch in batches) <= 7
    found = {(r["lang"], r["phrase"]): r["a"] for batch in batches for r in batch.to_pylist()}
    want = Counter((name, word) for name, text in rows for word in text.split())
    assert found == want and sum(batch.num_rows for batch in batches) == len(want)
