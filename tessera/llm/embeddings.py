"""Embedding near-duplicates: tiles in principal-component order, compared leading dimensions first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, cut, forest, small

THRESHOLD = 0.95
#: Vectors of a tile's chunk; two chunks meet in one task.
CHUNK = 4096
#: Tiles (leaves of a tree of median cuts) grow in number with the vectors up to this; the driver and tasks hold their boxes, tasks find the near pairs.
MAX_LEAVES = 8192
#: Vectors per tile that the cuts are taken from, drawn by hash. Cuts only balance tiles; every vector is compared.
LEAF_SAMPLE = 32
#: Dimensions added to the partial products at a time.
STEP = 16
#: Room for rounding in bounds; survivors are checked exactly.
SLACK = 1e-9


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, not all zero, and of a length above zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Columns: axes of the unit vectors by falling variance.

    A partition sends its size x size sum in bands of rows, which meet band by band; the driver
    gets one matrix, 134 MB at 4,096 dimensions.
    """
    band = 64

    def packed(bands: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        some = [(k, m.tobytes()) for k, m in bands]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([m for _, m in some], pa.binary())], ["band", "m"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            units = _unit(_matrix(batch["v"], size)) if batch.num_rows else np.zeros((0, size))
            total += units.T @ units
        yield packed((k, total[k * band : (k + 1) * band]) for k in range(-(-size // band)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch["band"].to_pylist(), batch["m"], strict=True):
                part = np.frombuffer(m.as_py()).reshape(-1, size)
                held[k] = held[k] + part if k in held else part
        yield packed(held.items())

    gram = np.zeros((size, size))
    for row in vectors.select("v").mapInArrow(sums, "band int, m binary").repartition("band").mapInArrow(add, "band int, m binary").collect():
        gram[row["band"] * band : (row["band"] + 1) * band] = np.frombuffer(row["m"]).reshape(-1, size)
    values, axes = np.linalg.eigh(gram)
    return axes[:, np.argsort(-values)]


def median_cuts(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A tree in heap order: per inner node the dimension of most spread and its median."""
    tree: list[tuple[int, float]] = []
    groups = [points]
    for _ in range(depth):
        below = []
        for group in groups:
            axis = int(np.argmax(group.max(0) - group.min(0))) if len(group) else 0
            at = float(np.median(group[:, axis])) if len(group) else 0.0
            tree.append((axis, at))
            below += [group[group[:, axis] <= at], group[group[:, axis] > at]]
        groups = below
    return tree


def leaf_of(points: np.ndarray, tree: list[tuple[int, float]], depth: int) -> np.ndarray:
    axes, cuts = np.array([t[0] for t in tree] or [0]), np.array([t[1] for t in tree] or [0.0])
    node = np.zeros(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - ((1 << depth) - 1)


def _compare(left: pd.DataFrame, right: pd.DataFrame | None, size: int, axes: np.ndarray, threshold: float) -> pd.DataFrame:
    """Links between two chunks (or inside one): per vector the copies it links to, and a forest of links."""
    a_ids, a_copies, a = _chunk(left, size)
    b_ids, b_copies, b = (a_ids, a_copies, a) if right is None else _chunk(right, size)
    a_turned, b_turned = a @ axes, b @ axes
    a_tail, b_tail = (np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], 1)[:, ::-1])) for x in (a_turned, b_turned))
    a_links, b_links = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    edges: list[np.ndarray] = []

    tile = 1024
    for i in range(0, len(a), tile):
        for j in range(i if right is None else 0, len(b), tile):
            x, y = a_turned[i : i + tile], b_turned[j : j + tile]
            x_tail, y_tail = a_tail[i : i + tile], b_tail[j : j + tile]
            done, partial = 0, np.zeros((len(x), len(y)))
            while done < size:  # stop as soon as no pair can reach the threshold
                upto = min(size, done + STEP)
                partial += x[:, done:upto] @ y[:, done:upto].T
                rest = x_tail[:, upto, None] * y_tail[None, :, upto] if upto < size else 0.0
                alive = partial + rest >= threshold - SLACK
                done = upto
                if np.count_nonzero(alive) * 20 < alive.size:
                    break
            p, q = np.nonzero(alive)
            p, q = p + i, q + j
            if right is None:
                p, q = p[p < q], q[p < q]
            hit = np.zeros((len(x), len(y)), bool)
            for at in range(0, len(p), 1 << 16):  # survivors, exactly
                pp, qq = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                near = (a[pp] * b[qq]).sum(1) >= threshold
                pp, qq = pp[near], qq[near]
                np.add.at(a_links, pp, b_copies[qq])
                np.add.at(b_links if right is not None else a_links, qq, a_copies[pp])
                hit[pp - i, qq - j] = True
            if hit.any():  # what connects the tile's vectors as all its links do
                edges.append(np.stack(forest(a_ids[i : i + tile], b_ids[j : j + tile], hit), 1))
    joined = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    edges_out = [(int(u), int(v), 0) for u, v in joined if u != v]
    counts = [(int(k), int(k), int(n)) for ids, found in ((a_ids, a_links), (b_ids, b_links)) for k, n in zip(ids, found, strict=True) if n]
    if right is None:
        counts = [(int(k), int(k), int(n)) for k, n in zip(a_ids, a_links, strict=True) if n]
    return pd.DataFrame(edges_out + counts, columns=["a", "b", "n"], dtype="int64")


def _chunk(rows: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    matrix = np.frombuffer(b"".join(rows["packed"]), np.float32 if rows["single"].iloc[0] else np.float64) if len(rows) else np.zeros(0)
    return rows["rep"].to_numpy(), rows["copies"].to_numpy(), _unit(matrix.astype(np.float64).reshape(-1, size)) if len(rows) else np.zeros((0, size))


def _links_of_size(distinct: DataFrame, size: int, count: int, threshold: float) -> DataFrame:
    """Rows ``(a, b, n)`` for the distinct vectors of one length: links (n = 0) and counts of linked copies (n > 0)."""
    axes = principal_axes(distinct, size)
    single = dict(distinct.dtypes)["v"] == "array<float>"
    depth = min(MAX_LEAVES, max(1, count // CHUNK)).bit_length() - 1
    lead = min(size, 8)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                turned = _unit(_matrix(batch["v"], size)) @ axes[:, :lead]
                yield pa.RecordBatch.from_arrays([pa.array(turned.tolist(), pa.list_(pa.float64()))], ["p"])

    drawn = distinct.orderBy(F.xxhash64("rep")).limit(LEAF_SAMPLE << depth).select("v").mapInArrow(leading, "p array<double>").toPandas()["p"] if depth else []
    tree = median_cuts(np.array([np.asarray(p) for p in drawn]).reshape(-1, lead), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch["v"], size)
            turned = _unit(rows) @ axes[:, :lead]
            packed = [r.tobytes() for r in rows.astype(np.float32 if single else np.float64)]
            yield pa.RecordBatch.from_arrays(
                [batch["rep"], batch["copies"], pa.array(leaf_of(turned, tree, depth)), pa.array(packed, pa.binary()),
                 pa.array([single] * len(rows)), pa.array(turned.tolist(), pa.list_(pa.float64()))],
                ["rep", "copies", "leaf", "packed", "single", "lead"],
            )

    placed = cut(
        distinct.select("rep", "copies", "v").mapInArrow(
            place, "rep long, copies long, leaf long, packed binary, single boolean, lead array<double>"
        )
    )
    ends = [f(F.element_at("lead", k + 1)).alias(f"{name}{k}") for k in range(lead) for name, f in (("low", F.min), ("high", F.max))]
    boxed = cut(placed.groupBy("leaf").agg(F.count("*").alias("n"), *ends))
    boxes = boxed.collect()  # at most MAX_LEAVES rows
    low = np.array([[b[f"low{k}"] for k in range(lead)] for b in boxes]).reshape(-1, lead)
    high = np.array([[b[f"high{k}"] for k in range(lead)] for b in boxes]).reshape(-1, lead)
    leaves = np.array([b["leaf"] for b in boxes], np.int64)
    chunks = np.array([-(-b["n"] // CHUNK) for b in boxes], np.int64)
    reach = 2 - 2 * threshold + SLACK  # squared distance of unit vectors at the threshold

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf in batch["leaf"].to_pylist():
                i = int(np.flatnonzero(leaves == leaf)[0])
                gap = np.maximum(0, np.maximum(low[i] - high, low - high[i]))
                hit = (gap * gap).sum(1) <= reach
                columns = (np.full(hit.sum(), leaf), leaves[hit], np.full(hit.sum(), chunks[i]), chunks[hit])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["leaf", "partner", "own_chunks", "chunks"])

    # tasks find the near pairs of tiles, which stay with them unless they are few
    table = boxed.select("leaf").mapInArrow(near, "leaf long, partner long, own_chunks long, chunks long")
    here = F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("own_chunks"))
    sent = (
        placed.join(small(table), "leaf")
        .withColumn("chunk", here)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("mine", F.struct(F.col("leaf").alias("leaf"), F.col("chunk").alias("chunk")))
        .withColumn("theirs", F.struct(F.col("partner").alias("leaf"), F.col("other").alias("chunk")))
        .select(
            F.least("mine", "theirs").alias("low"),
            F.greatest("mine", "theirs").alias("high"),
            (F.col("mine") > F.col("theirs")).alias("second"),
            "rep", "copies", "packed", "single",
        )
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        same = tuple(key[:2]) == tuple(key[2:])
        left, right = (rows, None) if same else (rows[~rows["second"]], rows[rows["second"]])
        if right is not None and (left.empty or right.empty):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        return _compare(left, right, size, axes, threshold)

    return sent.groupBy(
        F.col("low.leaf").alias("l1"), F.col("low.chunk").alias("c1"), F.col("high.leaf").alias("l2"), F.col("high.chunk").alias("c2")
    ).applyInPandas(compare, "a long, b long, n long")


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links of cosine >= ``threshold`` among all rows of ``embeddings(vec_id, embedding)``.

    Returns one row per row: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable), kept (vec_id = component_id). Cosines are in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths never link. Equal vectors are one vector with copies, which link
    with each other and with all that one links with. vec_id must not be null; a repeated one
    stands for its rows one by one, which share what is said of that vector. Other columns are
    ignored.

    Unit vectors are turned to principal axes; median cuts over the leading ones give compact
    tiles. Pairs of tiles whose boxes are further apart than the threshold allows are never sent.
    Inside a pair, products are summed over leading dimensions first and bounded by the norms of
    the rest; survivors are checked exactly.
    """
    rows = embeddings.select("vec_id", F.col("embedding").alias("v"))
    good = rows.where(usable(F.col("v")))
    distinct = cut(
        good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    )
    links = None
    for row in distinct.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect():
        part = _links_of_size(distinct.where(F.size("v") == row["size"]), row["size"], row["n"], threshold)
        links = part if links is None else links.unionByName(part)
    if links is None:
        return embeddings.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links)
    counts = links.where("n > 0").groupBy(F.col("a").alias("l_rep")).agg(F.sum("n").alias("linked"))
    roots = components(links.where("n = 0").select("a", "b"))
    classes = (
        distinct.join(counts, F.col("rep") == F.col("l_rep"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("v").alias("c_v"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    # reps are the smallest of their copies and roots the smallest reps, so a root is its class's smallest vec_id
    linked = good.join(classes, F.col("v") == F.col("c_v")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
