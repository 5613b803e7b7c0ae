"""Toxicity, mixing, sharding, token files and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from merchlake.llm import mixing, slots, token_files, weak_toxicity
from merchlake.llm.batches import prepare

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, votes int, block int, tree int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3) for i, t, s in rows], SHAPE)


# --- toxicity ---------------------------------------------------------------------------------------------------------


def toxic_corpus(seed=1, size=1500):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("la", "mo", "ti", "ren", "sou", "ka") for b in ("ra", "den", "lis", "po", "vin")]
    marks = ["grobnik", "zalmuth", "perfidot", "idiot", "scum", "trash"]
    rows, labels = [], []
    for i in range(size):
        words, toxic = rng.choices(vocabulary, k=rng.choice([5, 20, 60, 200])), int(rng.random() < 0.12)
        if toxic:
            for _ in range(rng.randint(3, 6)):
                words[rng.randrange(len(words))] = rng.choice(marks)
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    prepare(spark)
    rows, labels = toxic_corpus()
    rows += [(9001, None, "s"), (9002, "", "s"), (None, "la ra", "s"), (9003, "mora " * 100_000, "s"), (9003, "mora", "s")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = weak_toxicity.score_toxicity(frame(spark, rows), table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["id"] is not None and zlib.crc32(str(r["id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    truth = {i: t for i, _, t in labels}
    seen = Counter((truth[r["id"]], r["predicted"]) for r in got if r["held_out"] and r["id"] in truth)
    assert seen[0, 1] == 0 and seen[1, 0] <= 0.05 * (seen[1, 0] + seen[1, 1])
    assert {r["predicted"] for r in got if r["id"] is None or r["id"] > 9000} == {0}


def test_held_out_labels_are_never_read(spark):
    rows, labels = toxic_corpus(3, 600)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    scores = []
    for given in (labels, flipped):
        table = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
        got = weak_toxicity.score_toxicity(frame(spark, rows), table).collect()
        scores.append(sorted((r["id"], round(r["score"], 9)) for r in got))
    assert scores[0] == scores[1]


def test_toxicity_without_toxic_labels_or_rows(spark):
    rows, labels = toxic_corpus(4, 30)
    clean = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in weak_toxicity.score_toxicity(frame(spark, rows), clean).collect()} == {0.0}
    assert weak_toxicity.score_toxicity(frame(spark, []), clean.limit(0)).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    voters = len(weak_toxicity.VOTERS)
    truth = rng.random(20_000) < 0.1
    fires = np.stack([rng.uniform(0.01, 0.1, voters), rng.uniform(0.4, 0.9, voters)])
    votes = (rng.random((20_000, voters)) < fires[truth.astype(int)]).astype(float)
    votes[:, 1] = votes[:, 0]  # two voters that always agree
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_toxicity.fit_label_model(patterns, counts, votes[:3000], truth[:3000].astype(float))
    assert abs(model.prior - 0.1) < 0.02
    assert np.abs(model.fires[:, 2:] - fires[:, 2:]).max() < 0.08
    assert model.correlation[0, 1] > 0.9 and model.weight[0] < model.weight[2]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.98


# --- mixing -----------------------------------------------------------------------------------------------------------


def mixed_rows():
    rng = random.Random(7)
    sizes = {"big": 400, "mid": 120, "small": 40, None: 30}
    rows = []
    for source, count in sizes.items():
        rows += [(len(rows) + i, "w " * rng.randint(1, 60), source) for i in range(count)]
    return rows + [(5000, None, "empty"), (5001, "", "empty"), (5002, " \n ", "big"), (5003, "x", "big"), (5003, "x", "big")]


def test_mixture_meets_entropy_or_repetition_limit(spark):
    rows = mixed_rows()
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    total = sum(tokens.values())

    def entropy(exponent):
        raised = [(n / total) ** exponent for n in tokens.values() if n]
        return -sum(x / sum(raised) * math.log(x / sum(raised)) for x in raised)

    for target, limit in ((0.9, 100.0), (0.999, 1.5), (0.1, 100.0)):
        draws = mixing.mix_sources(frame(spark, rows), target_entropy=target, max_repetition=limit).collect()
        weight = {r["row"]["source"]: r["weight"] for r in draws if r["n_tokens"]}
        assert sum(weight.values()) == pytest.approx(1)
        shares = {s: tokens[s] / total for s in weight}
        exponent = math.log(weight["big"] / weight["small"]) / math.log(shares["big"] / shares["small"])
        drawn = Counter()
        for r in draws:
            drawn[r["row"]["source"]] += r["n_tokens"]
        repetition = max(drawn[s] / tokens[s] for s in weight)
        if target == 0.9:
            assert entropy(exponent) == pytest.approx(0.9 * math.log(len(weight)), abs=1e-4)
        elif limit == 1.5:
            assert 1.4 < repetition <= 1.5
        else:
            assert exponent == pytest.approx(1)
        for s in weight:
            assert drawn[s] / sum(drawn.values()) == pytest.approx(weight[s], abs=0.02)
        # Every document at least once; copies only differ in epoch.
        ids = Counter(r["row"]["doc_id"] for r in draws)
        assert set(ids) == {r[0] for r in rows}
        for r in draws:
            assert r["n_tokens"] == len((r["row"]["text"] or "").split())


def test_budget_is_kept_and_draws_are_repeatable(spark):
    rows = mixed_rows()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    runs = []
    for _ in range(2):
        draws = mixing.mix_sources(frame(spark, rows), max_repetition=50.0, budget=total / 3).collect()
        runs.append(sorted((r["row"]["doc_id"], r["epoch"], r["block"], r["place"]) for r in draws))
        assert 0.9 * total / 3 < sum(r["n_tokens"] for r in draws) <= total / 3 + 1
    assert runs[0] == runs[1]


def test_mixing_of_empty_tables_keeps_columns(spark):
    table = frame(spark, [])
    assert mixing.drawn_documents(mixing.mix_sources(table)).columns == table.columns
    assert mixing.mix_sources(table).count() == 0
    assert mixing.mix_sources(frame(spark, [(1, None, None)])).count() == 1


# --- sharding ---------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_places_gapless(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randint(0, 400), "s") for i in range(3000)]
    rows += [(None, None, "s"), (None, "x", "s"), (7, "y", "s"), (7, "y", "s")]
    folder = str(tmp_path / "map")
    got = slots.shard_records(frame(spark, rows), folder).collect()
    assert len(got) == len(rows)
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == expected
    load, places = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["place"])
    assert len(load) == slots.SHARDS and max(load.values()) - min(load.values()) <= 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    stored = spark.read.parquet(folder)
    assert sorted(r[0] for r in stored.select("version").distinct().collect()) == [0, 1]
    carried = slots.shard_records(frame(spark, rows), str(tmp_path / "other"), carry=True).collect()
    assert Counter((r["record"]["doc_id"], r["record"]["text"], r["id"]) for r in carried) == Counter((i, t, i) for i, t, _ in rows)
    assert slots.shard_records(frame(spark, []), str(tmp_path / "none")).count() == 0


def test_a_later_run_edits_the_stored_map(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300), "s") for i in range(2500)]
    folder = str(tmp_path / "map")

    def run(rows, shards=slots.SHARDS):
        got = slots.shard_records(frame(spark, rows), folder, shards=shards).collect()
        assert Counter(r["id"] for r in got) == Counter(i for i, _, _ in rows)
        load = Counter()
        for r in got:
            load[r["shard"]] += r["size"]
        assert len(load) == shards and max(load.values()) - min(load.values()) <= 8
        newest = slots.read_map(spark, folder)
        assert newest.count() == slots.SLOTS
        return {r["vslot"]: r["shard"] for r in newest.collect()}, newest.first()["version"]

    first, version = run(rows)
    assert version == 1 and run(rows) == (first, 1)
    more = rows + [(i, "y" * rng.randint(0, 300), "s") for i in range(2500, 3400)]
    second, version = run(more)
    assert version == 2 and sum(first[v] != second[v] for v in first) < 0.1 * slots.SLOTS
    # A plain rebalance of the stored map gives the same map.
    weight = np.zeros(slots.SLOTS)
    for r in slots.slot_records(frame(spark, more), "doc_id", "text").collect():
        weight[r["vslot"]] += r["size"]
    plain = slots.rebalance(np.array([first[v] for v in range(slots.SLOTS)]), weight)
    assert [second[v] for v in range(slots.SLOTS)] == plain.tolist()
    fewer, version = run(more, slots.SHARDS - 4)
    assert version == 3 and {v for v in second if fewer[v] != second[v]} >= {v for v in second if second[v] >= slots.SHARDS - 4}


def test_rebalancing_edits_little():
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 1000, slots.SLOTS).astype(float)
    first = slots.first_map()
    second = slots.rebalance(first, weight)
    load = np.bincount(second, weights=weight)
    assert load.max() - load.min() <= 2 and (first != second).mean() < 0.05
    # One more shard: it is filled from all others.
    grown = slots.rebalance(second, weight, slots.SHARDS + 1)
    load = np.bincount(grown, weights=weight)
    assert load.max() - load.min() <= 2 and (grown != second).mean() < 0.08


# --- token files ------------------------------------------------------------------------------------------------------

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_what_the_tokenizer_gives(name):
    plain, encoder = tokenizers.Tokenizer.from_file(public.path(name)), token_files.Encoder(public.path(name))
    rng = random.Random(3)
    alphabet = "ab 'stremvld\n\t\x1c\x85\xa0  éàß12²½_-!?.​‐…€\x00ªǅ漢字😀١"
    for i in range(5000):
        size = rng.choice([12, 20, 40, len(alphabet)])
        text = "".join(rng.choice(alphabet[:size]) for _ in range(rng.randint(0, 25)))
        text += "<|endoftext|> q" if i % 97 == 0 else ""
        ids = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_known_words_are_not_asked_again(monkeypatch):
    path = public.path("byte_bpe_50k.json")
    plain, encoder = tokenizers.Tokenizer.from_file(path), token_files.Encoder(path)
    encoder.encode("Haus vier Haus\nvier\nHaus zwölf zwölf.")
    asked = []
    for name in ("_ids", "_merged"):
        own = getattr(encoder, name)
        monkeypatch.setattr(encoder, name, lambda text, own=own: asked.append(text) or own(text))
    # Other marks after the same words, and other lines, as a text's first, inner and last words.
    text = "vier, Haus.\nvier*** (vier\nHaus; zwölf?! zwölf, Haus,\nHaus"
    ids = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
    assert ids == plain.encode(text, add_special_tokens=False).ids
    assert {a for a in asked if any(c.isalpha() for c in a)} == {" (vier\nHaus;"}


def test_texts_encoded_together(monkeypatch):
    path = public.path("byte_bpe_50k.json")
    plain, encoder = tokenizers.Tokenizer.from_file(path), token_files.Encoder(path)
    assert encoder.merger is not None
    monkeypatch.setattr(token_files, "TOGETHER", 60)
    monkeypatch.setattr(token_files, "WORD_MEMORY", 40)
    rng = random.Random(8)
    words = ["the", "Haus", "été", "漢字", "ǅa", "don't", "a1", "x.", "y,***", "\xa0z", "", "\n", "\n\nb", "c\n", "d\n\ne", "f.\ng", "\r\n", "<|endoftext|>"]
    texts = [" ".join(rng.choices(words[: rng.choice([6, 10, 18])], k=rng.randint(0, 9))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) + rng.choice(["", ",", "\nk", " é!"]) for _ in range(500)]
    got = encoder.encode_all(texts)
    assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_vocabularies_that_merge_over_words():
    model = {"merges": ["\u0120 t", "h e", "\u010a \u010a", ["\u0120", "\u0120"], "\u0120\u00c2\u0142 \u0120\u00c2\u0142"]}
    assert token_files._merges_apart(model)
    for merge in ("e \u0120", "e \u0120t", "\u0120t \u010a", "\u010a t", "\u0143 \u0120"):
        assert not token_files._merges_apart({"merges": [*model["merges"], merge]}), merge
    assert not token_files._merges_apart(model | {"ignore_merges": True})


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 4000)
    rng = random.Random(4)
    rows = [(i * 7 - 900, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(40))), "s") for i in range(400)]
    rows += [(100_000, None, "s"), (100_001, "", "s"), (None, "null id", "s"), (5, "same id", "s"), (5, "same id", "s")]
    rows += [(99, "long text " * 100_000, "s")]
    folder = str(tmp_path / "tokens")
    path = public.path("byte_bpe_50k.json")
    token_files.write_token_files(frame(spark, rows), folder, path)
    assert spark.read.parquet(folder + "/segments").select("shard").distinct().count() > 3

    plain = tokenizers.Tokenizer.from_file(path)
    encoded = [(i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows]
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, expected = 0, []
    for i, ids in encoded:
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.documents_digest(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected

    keys = spark.createDataFrame([(5,), (100_000,), (-900,), (4,), (None,), (5,), (10**12,)], "doc_id long")
    found = token_files.look_up(keys, folder).collect()
    by_id = sorted((r["id"], np.frombuffer(r["tokens"], "<u4").tolist()) for r in found)
    assert by_id == sorted((i, ids) for i, ids in encoded if i in (5, 100_000, -900))


def test_token_files_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    token_files.write_token_files(frame(spark, []), folder, public.path("byte_bpe_50k.json"))
    assert token_files.documents_digest(spark, folder).count() == 0


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(count):
    keys = np.unique(np.random.default_rng(count).integers(-(2**62), 2**62, count))
    table = token_files.PerfectHash.load(token_files.PerfectHash.build(keys).dump())
    assert sorted(table.entry(keys).tolist()) == list(range(len(keys))) and len(table) == len(keys)


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages_decide_and_keep_columns(spark, tmp_path):
    rows, labels = toxic_corpus(5, 700)
    rng = random.Random(8)

    def prose(size):
        return " ".join(f"v{rng.randrange(4000)}" for _ in range(size))

    original, passage = prose(150), prose(30)
    near = original.split()
    near[70] = "changed"
    toxic = {i for i, _, t in labels if t}
    rows += [(2000, original, "a"), (2001, original, "b"), (2002, " ".join(near), "a"), (2003, prose(80) + " " + passage, "c")]
    rows += [(2004, prose(90), None), (2005, None, "a"), (2006, "", "a")]
    documents = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")

    docs, kept = documents, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if number + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = docs
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in kept.items()}
    assert len(ids["toxicity"] & toxic) <= 0.1 * len(toxic) and ids["toxicity"] >= {i for i, _, _ in rows} - toxic
    assert ids["ngram_jaccard"] & {2000, 2001, 2002} == {2000}
    texts = {r["doc_id"]: r for r in kept["decontamination"].collect()}
    assert passage not in texts[2003]["text"] and texts[2003]["n_chars"] == len(texts[2003]["text"])
    assert ids["mixing"] == ids["decontamination"] and ids["sharding"] == ids["mixing"]
    assert ids["sharding"] >= {2004, 2005, 2006}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["sharding"].count()
    drawn = Counter(tuple(r) for r in kept["mixing"].collect())
    assert Counter(tuple(r["record"]) for r in kept["sharding"].collect()) == drawn


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    shape = "doc_id long, text string, `__row` string, `__ROW_` int, size long, record string, row int, tau int"
    docs = spark.createDataFrame([(i, f"a text of its own number {i}", "r", 1, 2, "z", 3, 4) for i in range(5)], shape)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    placed = corpus_pipeline.shard(spark, docs, str(tmp_path))
    assert sorted(tuple(r["record"]) for r in placed.collect()) == sorted(map(tuple, docs.collect()))


def test_pipeline_on_empty_documents(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("written", [True, False])
def test_pipeline_stages_judge_rows_and_not_ids(spark, tmp_path, written):
    rows, labels = toxic_corpus(5, 700)
    rng = random.Random(9)

    def prose(size):
        return " ".join(f"v{rng.randrange(4000)}" for _ in range(size))

    toxic = [t for (i, t, _), (j, _, bad) in zip(rows, labels) if bad and i == j]
    clean = [prose(90) for _ in range(6)]
    near = [prose(150) for _ in range(2)]
    changed = [" ".join(["changed", *t.split()[1:]]) for t in near]
    shape = "doc_id long, text string"
    docs = spark.createDataFrame(
        # Toxic texts and clean ones under one id and under none; a blank text twice.
        [(i, t) for i, t, _ in rows]
        + [(3000, t) for t in toxic[:20] + clean[:3]]
        + [(None, t) for t in toxic[20:40] + clean[3:]]
        # Near copies under a null id, and one whose id a clean text has as well.
        + [(None, near[0]), (None, changed[0]), (4000, near[1]), (4001, changed[1]), (4001, clean[0] + " end")]
        + [(5000, " "), (5000, " ")],
        shape,
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    if written:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    calm = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert calm.columns == docs.columns
    kept = Counter(r["text"] for r in calm.collect())
    assert all(kept[t] for t in clean + near + changed) and kept[" "] == 2
    assert sum(kept[t] for t in toxic[:40]) <= 8

    single = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in single.collect())
    assert all(kept[3000, t] == 1 for t in clean[1:3]) and all(kept[None, t] == 1 for t in clean[3:])
    assert kept[None, near[0]] + kept[None, changed[0]] == 1
    assert kept[4000, near[1]] == 1 and not kept[4001, changed[1]] and kept[5000, " "] == 2
    # A text and its near copy under different ids: the least id stays.
    assert kept[3000, clean[0]] == 1 and not kept[4001, clean[0] + " end"]


def test_toxicity_features_are_handed_on_in_pieces(monkeypatch):
    """A task holds a bounded number of features; partial counts add up to those of all texts."""
    import pyarrow as pa

    from merchlake.llm import weak_toxicity

    monkeypatch.setattr(weak_toxicity, "HELD_FEATURES", 50, raising=False)
    monkeypatch.setattr(weak_toxicity, "HANDED_ROWS", 16, raising=False)
    texts = [f"alpha word{n % 30} word{n % 7} tail{n}" for n in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": [n % 2 for n in range(200)]})
    parts = list(weak_toxicity._count_features(iter([batch])))
    assert len(parts) > 1 and max(part.num_rows for part in parts) <= 16
    found, want = {}, {}
    for part in parts:
        for row in part.to_pylist():
            pos, neg = found.get(row["feature"], (0, 0))
            found[row["feature"]] = pos + row["pos"], neg + row["neg"]
    for n, text in enumerate(texts):
        for feature in weak_toxicity.features(text):
            pos, neg = want.get(feature, (0, 0))
            want[feature] = pos + n % 2, neg + 1 - n % 2
    assert found == want
