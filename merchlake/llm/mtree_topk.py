"""Exact top-k inner-product search with M-trees.

Vectors become integers, ``floor(64 * x)``. The largest inner product is the nearest neighbour once every vector gets
one more coordinate that lifts it to the common length ``M`` (queries get 0 there): ``d^2 = |q|^2 + M^2 - 2 q.x``.

*Build.* A bounded sample (``SAMPLE``) gives pivots. Every vector goes to its nearest pivot's region; a region of more
than ``TREE_ROWS`` vectors, be they equal or not, is dealt into as many trees as it needs. A task builds one tree:
pages of routing objects with covering radius and distance to the parent, down to leaf pages of vectors with their
distances to the page's centre. The pages are stored as a table.

*Search.* Blocks of queries meet every tree. Pages are taken best first; a page is left out for the queries whose k-th
score its covering radius cannot reach, and the stored distances to the parent rule out entries by the triangle
inequality before any distance to them is computed. The best of all trees are merged per query.

*Long vectors.* Where squared lengths reach ``EXACT``, products are no longer exact in 64 bits. Such vectors stay out of
the trees: they meet every query, and as queries every vector, in whole numbers of any size, which is slow but meant for
few. A score beyond 64 bits is ranked by its exact value and comes out null, as it has no place in the result.

Vectors that are null, hold null or non-finite components take no part. Shorter vectors are padded with zeros. Ties go to the smaller id. Ids name rows: a query never finds a row of its own id, and
repeated queries give one result. Long texts and other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from merchlake.llm.batches import least_hashed, map_rows
from merchlake.llm.components import saved

SAMPLE = 1024
PIVOTS = 32
TREE_ROWS = 4096
FANOUT = 16
LEAF_ROWS = 128
QUERY_BLOCK = 1024
#: Squared length (after scaling) from which vectors are scored in whole numbers of any size.
EXACT = 2.0**48

_PAGES = (
    "tree int, page int, leaf boolean, count int, ids array<long>, children array<int>, vectors binary, radius binary,"
    " to_parent binary"
)


def integers(vector: list[float | None] | None) -> list[int] | None:
    """The integer vector, or None if it takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    # Beyond 2^53 every float is whole.
    return [int(x) * 64 if abs(x) >= 2**53 else math.floor(x * 64) for x in vector]


def _quantised(vec_id, vector) -> Iterator[tuple]:
    own = integers(vector)
    if own is not None:
        squared = sum(x * x for x in own)
        if squared < EXACT:
            yield vec_id, np.array(own, "<i4").tobytes(), float(squared), False
        else:
            yield vec_id, ",".join(map(str, own)).encode(), None, True


def slack(norm: float, width: int) -> float:
    """Added to every bound, for rounding: what computed distances of lifted points may be off by, with a margin."""
    return max(1e-6, 4 * math.sqrt((width + 8) * np.finfo(float).eps * norm))


def stack(packed: list[bytes], width: int | None = None) -> np.ndarray:
    """Packed vectors as one matrix, padded with zeros."""
    width = width or max((len(p) // 4 for p in packed), default=0)
    if all(len(p) == 4 * width for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), width).astype(np.float64)
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        own = np.frombuffer(p, "<i4")[:width]
        out[i, : len(own)] = own
    return out


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that gives each the squared length ``norm``."""
    own = np.einsum("ij,ij->i", vectors, vectors)
    return np.column_stack([vectors, np.sqrt(np.maximum(norm - own, 0))])


def distances(a: np.ndarray, b: np.ndarray, squared_a: np.ndarray | float, squared_b: np.ndarray | float) -> np.ndarray:
    return np.sqrt(np.maximum(np.reshape(squared_a, (-1, 1)) + squared_b - 2 * (a @ b.T), 0))


def build_pages(points: np.ndarray, norm: float) -> list[dict]:
    """Pages of one tree over lifted points; page 0 is the root. Entries are numbers of points."""
    pages: list[dict] = []
    least = slack(norm, points.shape[1])

    def grow(members: np.ndarray, centre: np.ndarray | None) -> int:
        number = len(pages)
        pages.append({})
        to_parent = distances(points[members], centre[None], norm, norm)[:, 0] if centre is not None else np.zeros(len(members))
        if len(members) <= LEAF_ROWS:
            pages[number] = {"leaf": True, "entries": members, "children": [], "radius": None, "to_parent": to_parent}
            return number
        # Routing objects: one far from the centre, then always the farthest from those taken.
        first = members[to_parent.argmax()]
        routers = [first]
        nearest = distances(points[members], points[first][None], norm, norm)[:, 0]
        near = np.zeros(len(members), np.int64)
        while len(routers) < FANOUT and nearest.max() > least:
            routers.append(members[nearest.argmax()])
            apart = distances(points[members], points[routers[-1]][None], norm, norm)[:, 0]
            closer = apart < nearest
            near[closer], nearest = len(routers) - 1, np.minimum(nearest, apart)
        used = [i for i in range(len(routers)) if (near == i).any()]
        if len(used) == 1:
            # Equal points: dealt out in order.
            parts = np.array_split(members, min(FANOUT, -(-len(members) // LEAF_ROWS)))
            routers = [part[0] for part in parts]
        else:
            parts = [members[near == i] for i in used]
            routers = [routers[i] for i in used]
        radius = [distances(points[part], points[r][None], norm, norm).max() for part, r in zip(parts, routers)]
        to_parent = distances(points[routers], centre[None], norm, norm)[:, 0] if centre is not None else np.zeros(len(routers))
        children = [grow(part, points[router]) for part, router in zip(parts, routers)]
        pages[number] = {
            "leaf": False,
            "entries": np.array(routers),
            "children": children,
            "radius": np.array(radius),
            "to_parent": to_parent,
        }
        return number

    grow(np.arange(len(points)), None)
    return pages


def _builder(norm: float):
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        vectors = stack(frame["vector"].tolist())
        ids = frame["id"].to_numpy()
        rows = []
        for number, page in enumerate(build_pages(lifted(vectors, norm), norm)):
            entries = page["entries"]
            rows.append(
                (
                    frame["tree"].iloc[0],
                    number,
                    page["leaf"],
                    len(entries),
                    ids[entries].tolist(),
                    page["children"],
                    vectors[entries].astype("<i4").tobytes(),
                    b"" if page["radius"] is None else page["radius"].tobytes(),
                    page["to_parent"].tobytes(),
                )
            )
        return pd.DataFrame(rows, columns=[part.split()[0] for part in _PAGES.split(", ")])

    return build


class Tree:
    """A stored tree, ready to be searched by blocks of queries."""

    def __init__(self, pages: pd.DataFrame, norm: float):
        self.norm = norm
        self.pages: dict[int, tuple] = {}
        for r in pages.itertuples():
            vectors = np.frombuffer(r.vectors, "<i4").reshape(r.count, -1).astype(np.float64)
            self.pages[r.page] = (
                r.leaf,
                np.asarray(r.ids, np.int64),
                list(r.children),
                vectors,
                np.frombuffer(r.radius),
                np.frombuffer(r.to_parent),
            )
        self.ids = np.sort(np.concatenate([p[1] for p in self.pages.values() if p[0]]))
        self.width = max(p[3].shape[1] for p in self.pages.values())

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of each query's best k rows other than its own."""
        count = len(queries)
        squared = np.einsum("ij,ij->i", queries, queries)
        spare = slack(max(self.norm, squared.max(initial=0)), queries.shape[1] + 1)
        # Score and smaller id in one number; the rank of an id stands for it.
        scale = len(self.ids) + 1
        none = np.iinfo(np.int64).min // 2
        best = np.full((count, k), none)
        reach = np.full(count, np.inf)  # distance beyond which nothing can enter a query's best k
        computed = 0
        # Least bound, page, queries that may find something in it, their distances to its centre, their bounds.
        heap = [(0.0, 0, np.arange(count), np.full(count, np.nan), np.zeros(count))]
        while heap:
            _, number, asked, from_parent, bound = heapq.heappop(heap)
            leaf, ids, children, vectors, radius, to_parent = self.pages[number]
            # The k-th scores may have risen since the page was queued.
            live = bound <= reach[asked] + spare
            asked, from_parent = asked[live], from_parent[live]
            if not len(asked):
                continue
            if number:
                lower = np.abs(from_parent[:, None] - to_parent[None]) - (0 if leaf else radius[None])
                entry = np.flatnonzero((lower <= reach[asked][:, None] + spare).any(axis=0))
            else:
                entry = np.arange(len(ids))
            if not len(entry):
                continue
            block = queries[asked]
            scores = block @ vectors[entry].T
            computed += scores.size
            if leaf:
                rank = np.searchsorted(self.ids, ids[entry])
                keys = scores.astype(np.int64) * scale - rank[None]
                keys[ids[entry][None] == own[asked][:, None]] = none
                merged = np.concatenate([best[asked], keys], axis=1)
                merged = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
                best[asked] = merged
                least = merged.min(axis=1)
                worst = -(-least // scale)
                full = least > none
                reach[asked[full]] = (
                    np.sqrt(np.maximum(squared[asked[full]] + self.norm - 2 * worst[full], 0)) + spare
                )
            else:
                apart = np.sqrt(np.maximum(squared[asked][:, None] + self.norm - 2 * scores, 0))
                for column, e in enumerate(entry):
                    lower = np.maximum(apart[:, column] - radius[e], 0)
                    live = lower <= reach[asked] + spare
                    if live.any():
                        entry_page = (float(lower[live].min()), children[e], asked[live], apart[live, column], lower[live])
                        heapq.heappush(heap, entry_page)
        self.computed = computed
        order = np.argsort(-best, axis=1)
        best = np.take_along_axis(best, order, axis=1)
        who, _ = np.nonzero(best > none)
        found = best[best > none]
        score = -(-found // scale)
        return who, self.ids[score * scale - found], score


def _searcher(norm: float, k: int):
    def search(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        tree = Tree(pages, norm)
        width = max([tree.width, *(len(v) // 4 for v in queries["vector"])])
        if width > tree.width:
            for number, page in list(tree.pages.items()):
                padded = np.zeros((len(page[3]), width))
                padded[:, : page[3].shape[1]] = page[3]
                tree.pages[number] = (*page[:3], padded, *page[4:])
        own = queries["query_id"].to_numpy()
        who, ids, scores = tree.search(stack(queries["vector"].tolist(), width), own, k)
        return pd.DataFrame({"query_id": own[who], "vec_id": ids, "score": scores}).astype("int64")

    return search


def _exact(k: int):
    """The best k of some vectors for some queries, in whole numbers of any size."""

    def whole(packed: bytes, large: bool) -> list[int]:
        if large:
            return [int(x) for x in packed.decode().split(",")]
        return np.frombuffer(packed, "<i4").tolist()

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        known = [(i, whole(v, large)) for i, v, large in zip(vectors["id"], vectors["vector"], vectors["large"])]
        rows = []
        for query, packed, large in zip(queries["query_id"], queries["vector"], queries["large"]):
            own = whole(packed, large)
            scored = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in known if i != query]
            # Too large for the column: any place outside of 64 bits will do.
            rows += [(query, i, Decimal(max(-(10**37), min(10**37, -s)))) for s, i in heapq.nsmallest(k, scored)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return search


def _exact_pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Blocks of queries meet blocks of vectors."""
    parts = max(1, -(-vectors.count() // TREE_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    left = vectors.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    )
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(
        _exact(k), "query_id long, vec_id long, score decimal(38,0)"
    )


def choose_pivots(sample: np.ndarray, count: int, norm: float) -> np.ndarray:
    """Sampled vectors far from each other, in the lifted space."""
    points = lifted(sample, norm)
    taken = [0]
    nearest = distances(points, points[:1], norm, norm)[:, 0]
    while len(taken) < count and nearest.max() > slack(norm, points.shape[1]):
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(points, points[taken[-1:]], norm, norm)[:, 0])
    return points[taken]


def build_trees(vectors: DataFrame, norm: float, total: int) -> DataFrame:
    """The pages of all trees over ``id`` and ``vector``."""
    spark = vectors.sparkSession
    sample = least_hashed(vectors, F.xxhash64("id"), SAMPLE).collect()
    pivots = choose_pivots(stack([r["vector"] for r in sample]), min(PIVOTS, -(-total // TREE_ROWS)), norm)
    shared = spark.sparkContext.broadcast(pivots)

    def nearest():
        points = shared.value

        def row(vec_id, packed) -> Iterator[tuple]:
            own = lifted(stack([packed], points.shape[1] - 1), norm)
            yield vec_id, packed, int(distances(own, points, norm, norm)[0].argmin())

        return row

    placed = saved(map_rows(vectors.select("id", "vector"), nearest, "id long, vector binary, region int"), "mtree-regions")
    # At most PIVOTS rows.
    sizes = {r["region"]: r["count"] for r in placed.groupBy("region").count().collect()}
    first, trees = {}, 0
    for region in sorted(sizes):
        first[region], trees = trees, trees - (-sizes[region] // TREE_ROWS)
    layout = F.create_map(*(F.lit(x) for r in first for x in (r, first[r])))
    parts = F.create_map(*(F.lit(x) for r in sizes for x in (r, -(-sizes[r] // TREE_ROWS))))
    tree = layout[F.col("region")] + F.pmod(F.xxhash64("id"), parts[F.col("region")].cast("long"))
    return saved(
        placed.select(tree.cast("int").alias("tree"), "id", "vector").groupBy("tree").applyInPandas(_builder(norm), _PAGES),
        "mtree-pages",
    )


def top_k(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's best k rows other than itself."""
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    asked = asked.filter("id is not null and v is not null")
    whole = map_rows(asked.select("id", "v"), lambda: _quantised, "id long, vector binary, squared double, large boolean")
    whole = saved(whole, "mtree-vectors")
    size = whole.agg(F.count("squared").alias("n"), F.max("squared").alias("m"), F.count_if("large").alias("large")).first()
    total, norm = size["n"], size["m"] or 0.0
    empty = "query_id long, vec_id long, score long"
    queries = whole.join(asked.filter("q").select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    found = vectors.sparkSession.createDataFrame([], empty)
    if total:
        pages = build_trees(whole.filter("not large"), norm, total)
        trees = pages.agg(F.max("tree")).first()[0] + 1
        near = queries.filter("not large")
        blocks = max(1, -(-near.count() // QUERY_BLOCK))
        near = near.select(
            F.col("id").alias("query_id"), "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
        )
        # Every block of queries meets every tree.
        left = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = near.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        found = left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInPandas(_searcher(norm, k), empty)
    if size["large"]:
        asking = saved(queries.select(F.col("id").alias("query_id"), "vector", "large"), "mtree-queries")
        held = whole.select("id", "vector", "large")
        found = found.withColumn("score", F.col("score").cast("decimal(38,0)")).union(
            _exact_pairs(held.filter("large"), asking, k)
        ).union(_exact_pairs(held.filter("not large"), asking.filter("large"), k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.col("score")
    if size["large"]:
        fits = score.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
        score = F.when(fits, score.cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
