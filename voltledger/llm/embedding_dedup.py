"""Near-duplicate vectors by sorted projection passes (operator 9).

Vectors with equal labels and a cosine of 0.93 or more (in double precision) are linked. Equal vectors
of a label form a class and one stands for all. The classes of one label and length are a team.

Each pass writes a vector's signs against random hyperplanes, from the centre of its team, as one number,
orders the team by it and verifies every vector against the ``WINDOW`` that follow. One pass compares all
pairs of a team of up to ``WINDOW`` + 1 vectors. In a larger one a pair is found in a pass when it agrees on
the signs that leave a window of vectors. How many signs that takes is measured: trial orders tell for each
vector how many signs it shares with the vector a window away, and its distance from the centre how likely a
partner at the threshold is to agree on one more. The passes are as many as find the pairs of the team with the
target probability. Vectors in runs of equal numbers longer than a window, or so crowded that they would need
``CROWDED`` times the passes that evenly spread vectors need, are verified against their whole team, in
blocks; crowding moves cost, not recall.

The verified pairs are united to components. Links of crowds that no window holds are counted exactly in
a last step, which verifies the members of each component among one another, in chunks, and counts links
without listing them.

Defined cases: null labels and vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths do not link; rows with a null vec_id link with nothing;
rows with the same vec_id are one node; equal rows count as copies; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voltledger.llm.components import components
from voltledger.sources.staging import Staging

THRESHOLD = 0.93
WINDOW = 64
SIGNS = 48
TARGET_RECALL = 0.9995
CHUNK = 512
BLOCK = 2048
TRIALS = 8
CENTRE_ROWS = 1000
CROWDED = 8

_CLASSED = "vec_id long, label string, key string, vector array<double>"
_PASSED = "label string, place long, node long, vector array<double>"
_TRIED = "label string, team string, place long, node long, agree double"
NEVER = 200
_SEEN = "u long, v long, border long, side int, place int, label string, node long, vector array<double>"
_COUNTED = "node long, links long"


def passes_for(rows: int, recall: float = TARGET_RECALL) -> int:
    """Passes after which a pair at the threshold has met in a window with this probability."""
    agree = 1 - math.acos(THRESHOLD) / math.pi
    signs = max(0.0, math.log2(max(rows, 1) / WINDOW))
    once = min(agree**signs, 0.999)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def plan(rows: int, counts: dict[int, int], recall: float = TARGET_RECALL) -> tuple[int, int]:
    """(passes, cut) of a team by its vectors per step of ``_step``: vectors of step ``cut`` or a later one
    are verified against all others."""
    limit = CROWDED * passes_for(rows, recall)
    easy = []
    for step in sorted(s for s in counts if s < NEVER):
        once = min(2.0 ** (-(step + 1) / 4), 0.999)
        if math.log(1 - recall) / math.log(1 - once) <= limit:
            easy.append((once, counts[step], step))
    number = sum(c for _, c, _ in easy)
    if not number:
        return 0, 0

    def missed(n: int) -> float:
        return sum(c * (1 - once) ** n for once, c, _ in easy)

    passes = 1
    while missed(passes) > (1 - recall) * number:
        passes += 1
    return passes, easy[-1][2] + 1


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plan of each team from its numbers of vectors per step."""
    for batch in batches:
        found = [
            plan(row["n"], {s["step"]: s["count"] for s in row["steps"]}) for row in batch.to_pylist()
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("team"), pa.array([p for p, _ in found], pa.int32()),
             pa.array([c for _, c in found], pa.int32())],
            names=["team", "passes", "cut"],
        )


def _hyperplanes(number: int, width: int) -> np.ndarray:
    return np.random.default_rng([9, number]).standard_normal((width, SIGNS))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components in a row and the bounds of each vector, for arrays without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(lengths)])


def _list_array(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)), pa.array(np.asarray(flat, np.float64))
    )


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("label").to_pylist()
        keys, units = [], []
        for label, vector in zip(labels, batch.column("embedding").to_pylist()):
            unit = None
            if label is not None and vector and None not in vector:
                raw = np.array(vector, np.float64)
                if np.isfinite(raw).all() and raw.any():
                    raw = raw / np.abs(raw).max()  # before the norm, which could overflow
                    unit = raw / np.sqrt(raw @ raw)
            units.append(unit)
            named = None if unit is None else label.encode() + b"\0" + np.array(vector).tobytes()
            keys.append(None if named is None else hashlib.blake2b(named, digest_size=16).hexdigest())
        bounds = np.cumsum([0, *(0 if u is None else len(u) for u in units)])
        flat = np.concatenate([np.empty(0), *(u for u in units if u is not None)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.string()),
             _list_array(flat, bounds)],
            names=["vec_id", "label", "key", "vector"],
        )


def _projected(flat: np.ndarray, bounds: np.ndarray, passes: np.ndarray):
    """(pass, rows, their signs as numbers) for vectors that take part in this many passes each."""
    weights = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
    widths = np.diff(bounds)
    for number in range(int(passes.max(initial=0))):
        live = passes > number
        for width in np.unique(widths[live]):
            rows = np.flatnonzero(live & (widths == width))
            matrix = flat[bounds[rows][:, None] + np.arange(width)]
            yield number, rows, ((matrix @ _hyperplanes(number, int(width))) > 0) @ weights


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bounds = _vectors(batch.column("centred"))
        teams = np.array(batch.column("team").to_pylist(), object)
        passes = batch.column("passes").to_numpy(zero_copy_only=False)
        for number, rows, place in _projected(flat, bounds, passes):
            label = [f"{number}:{x}" for x in teams[rows]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.string()), pa.array(place), batch.column("node").take(pa.array(rows)),
                 batch.column("vector").take(pa.array(rows))],
                names=["label", "place", "node", "vector"],
            )


def _try(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the trial orders, and the chance that a partner at the threshold agrees on a sign."""
    for batch in batches:
        flat, bounds = _vectors(batch.column("centred"))
        teams = np.array(batch.column("team").to_pylist(), object)
        squares = np.concatenate([[0.0], np.cumsum(flat * flat)])
        squares = np.maximum(squares[bounds[1:]] - squares[bounds[:-1]], 1e-12)
        # Vector and partner are as far from the centre, and 2 - 2 * THRESHOLD (squared) from each other.
        agree = 1 - np.arccos(np.clip(1 - (1 - THRESHOLD) / squares, -1, 1)) / math.pi
        for number, rows, place in _projected(flat, bounds, np.full(len(teams), TRIALS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{number}:{x}" for x in teams[rows]], pa.string()),
                 pa.array(list(teams[rows]), pa.string()), pa.array(place),
                 batch.column("node").take(pa.array(rows)), pa.array(agree[rows])],
                names=["label", "team", "place", "node", "agree"],
            )


def _once(places: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """The chance of each vector of an order to meet a partner at the threshold in a window."""
    here, total = np.arange(len(places)), 0.0
    for away in (-WINDOW, WINDOW):
        other = places[np.clip(here + away, 0, len(places) - 1)]
        shared = SIGNS - np.frexp((places ^ other).astype(np.float64))[1]
        total = total + np.where(shared >= SIGNS, 0.0, agree ** (shared + 1.0)) / 2
    return total


def _crowding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_once`` of the vectors of trial orders, which come sorted. At the ends of a partition the last
    vector stands for those beyond, which share no more signs."""
    key, parts = None, []

    def finished() -> pa.RecordBatch:
        places, nodes, agree = (np.concatenate(c) for c in zip(*parts))
        team = pa.array([key.split(":", 1)[1]] * len(nodes), pa.string())
        return pa.RecordBatch.from_arrays(
            [team, pa.array(nodes), pa.array(_once(places, agree))], names=["team", "node", "once"]
        )

    for batch in batches:
        labels = np.array(batch.column("label").to_pylist(), object)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "node", "agree")]
        cuts = np.flatnonzero(labels[1:] != labels[:-1]) + 1 if len(labels) else []
        for a, b in zip([0, *cuts], [*cuts, len(labels)]):
            if a == b:
                continue
            if labels[a] != key:
                if parts:
                    yield finished()
                key, parts = labels[a], []
            parts.append([c[a:b] for c in columns])
    if parts:
        yield finished()


class _Window:
    """Verifies sorted rows of one label against those that follow, as they arrive."""

    def __init__(self):
        self.label, self.nodes, self.rows = None, np.empty(0, np.int64), None

    def push(self, label: str, nodes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        old = 0
        if label == self.label:
            old = len(self.nodes)
            nodes, rows = np.concatenate([self.nodes, nodes]), np.concatenate([self.rows, rows])
        for step in range(1, min(WINDOW, len(nodes) - 1) + 1):
            first = max(0, old - step)
            a, b = rows[first : len(rows) - step], rows[first + step :]
            for i in np.flatnonzero(np.einsum("ij,ij->i", a, b) >= THRESHOLD) + first:
                if nodes[i] != nodes[i + step]:
                    yield int(nodes[i]), int(nodes[i + step])
        self.label, self.nodes, self.rows = label, nodes[-WINDOW:], rows[-WINDOW:]


def _forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """node: smallest node that these pairs tie it to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def _seen_batch(edges: dict[int, int], border: list[tuple]) -> pa.RecordBatch:
    """Links and border rows in one table: the links first."""
    edges = [(u, v) for u, v in edges.items() if u != v]
    none = [None] * len(edges)
    blank = [None] * len(border)
    side = list(zip(*border)) or [()] * 6
    vectors = [None] * len(edges) + [v.tolist() for v in side[5]]
    columns = [
        ([e[0] for e in edges] + blank, pa.int64()),
        ([e[1] for e in edges] + blank, pa.int64()),
        (none + list(side[0]), pa.int64()),
        (none + list(side[1]), pa.int32()),
        (none + list(side[2]), pa.int32()),
        (none + list(side[3]), pa.string()),
        (none + list(side[4]), pa.int64()),
        (vectors, pa.list_(pa.float64())),
    ]
    names = ["u", "v", "border", "side", "place", "label", "node", "vector"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Stretches of one label of a sorted batch, as matrices."""
    labels = np.array(batch.column("label").to_pylist(), object)
    if not len(labels):
        return
    flat, bounds = _vectors(batch.column("vector"))
    nodes = batch.column("node").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(labels)]):
        yield labels[a], nodes[a:b], flat[bounds[a] : bounds[b]].reshape(b - a, -1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within a partition of the order, and its first and last rows for its neighbours."""
    part = TaskContext.get().partitionId()
    window, head, tail = _Window(), [], []
    for batch in batches:
        edges = {}
        for label, nodes, rows in _runs(batch):
            for at in range(0, len(nodes), 4096):
                pairs = window.push(label, nodes[at : at + 4096], rows[at : at + 4096])
                edges.update(_forest(pairs).items())
                if edges:
                    yield _seen_batch(edges, [])
                    edges = {}
            need = WINDOW - len(head)
            head += [(label, int(n), r) for n, r in zip(nodes[:need], rows[:need])]
            tail = (tail + [(label, int(n), r) for n, r in zip(nodes[-WINDOW:], rows[-WINDOW:])])[-WINDOW:]
    border = [(part - 1, 1, i, *row) for i, row in enumerate(head)]
    border += [(part, 0, i, *row) for i, row in enumerate(tail)]
    if border:
        yield _seen_batch({}, border)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the last rows of a partition and the first ones of the next."""
    window, key = _Window(), None
    for batch in batches:
        marks = batch.column("border").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        edges = {}
        for a, b in zip([0, *cuts], [*cuts, len(marks)]):
            if a == b:
                continue
            if marks[a] != key:
                window, key = _Window(), marks[a]
            for label, nodes, rows in _runs(batch.slice(a, b - a)):
                edges = _forest([*edges.items(), *window.push(label, nodes, rows)])
        pairs = [(u, v) for u, v in edges.items() if u != v]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
            names=["u", "v"],
        )


def _units(batches: Iterator[pa.RecordBatch], keys: tuple, columns: tuple):
    """(key, columns, vectors) of the rows of each key; rows come sorted by key."""
    last, parts = None, []
    for batch in batches:
        found = list(zip(*(batch.column(c).to_pylist() for c in keys)))
        flat, bounds = _vectors(batch.column("vector"))
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(found)]):
            if a == b:
                continue
            if found[a] != last:
                if parts:
                    yield last, *(np.concatenate(c) for c in zip(*parts))
                last, parts = found[a], []
            parts.append((*(c[a:b] for c in values), flat[bounds[a] : bounds[b]].reshape(b - a, -1)))
    if parts:
        yield last, *(np.concatenate(c) for c in zip(*parts))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links of two blocks of a team. Rows come sorted by (team, low, high)."""
    for (_, low, high), nodes, blocks, rows in _units(batches, ("team", "low", "high"), ("node", "chunk")):
        ours, theirs = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        root = np.arange(len(nodes))
        for at in range(0, len(ours), CHUNK):
            near = rows[ours[at : at + CHUNK]] @ rows[theirs].T >= THRESHOLD
            for i in np.flatnonzero(near.any(axis=1)):
                tied = np.append(root[theirs[near[i]]], root[ours[at + i]])
                if (tied != tied[0]).any():
                    root[np.isin(root, tied)] = tied.min()
        apart = nodes != nodes[root]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[apart]), pa.array(nodes[root[apart]])], names=["u", "v"]
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of the partners of each member, chunk against chunk. Rows come sorted by
    (component, low, high)."""
    units = _units(batches, ("component", "low", "high"), ("node", "chunk", "weight"))
    for key, nodes, chunks, weights, rows in units:
        _, first = np.unique(nodes, return_index=True)
        nodes, chunks, weights, rows = nodes[first], chunks[first], weights[first], rows[first]
        near = rows @ rows.T >= THRESHOLD
        np.fill_diagonal(near, False)
        if key[1] != key[2]:
            near &= chunks[:, None] != chunks[None, :]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(near @ weights)], names=["node", "links"])


def _step(once):
    """Quarters of a power of two by which a chance falls short of one."""
    step = F.least(F.floor(F.log2(F.lit(1.0) / once) * 4), F.lit(NEVER - 1))
    return F.when(once > 0, F.greatest(step, F.lit(0))).otherwise(F.lit(NEVER)).cast("int")


def _planned(teams: DataFrame, sizes: DataFrame, staging: Staging) -> DataFrame:
    """The classes with the passes of their team, whether they are verified against all of it (hard),
    and the vector as seen from the centre of the team."""
    small = sizes.where(F.col("n") <= WINDOW + 1).select("team")
    small = teams.join(small, "team", "left_semi").select(
        "team", "node", "vector", F.lit(1).alias("passes"), F.lit(False).alias("hard"),
        F.col("vector").alias("centred"),
    )
    large = sizes.where(F.col("n") > WINDOW + 1).select("team", "n")
    if large.isEmpty():
        return staging.write(small)
    members = teams.join(large, "team")
    every = F.ceil(F.col("n") / F.lit(CENTRE_ROWS))
    sample = members.where(F.pmod(F.xxhash64("node", F.lit(9)), every) == 0)
    centre = sample.select("team", F.posexplode("vector")).groupBy("team", "pos").agg(F.avg("col").alias("x"))
    centre = centre.groupBy("team").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"))
    centre = staging.write(centre.select("team", F.col("c.x").alias("centre")))
    members = members.join(centre, "team", "left").withColumn(
        "centred",
        F.when(F.col("centre").isNull(), F.col("vector"))
        .otherwise(F.zip_with("vector", "centre", lambda x, c: x - c)),
    )
    tried = members.select("team", "node", "centred").mapInArrow(_try, _TRIED)
    order = ["label", "place", "node"]
    tried = staging.write(tried).repartitionByRange(*order).sortWithinPartitions(*order)
    once = tried.mapInArrow(_crowding, "team string, node long, once double")
    steps = staging.write(once.groupBy("team", "node").agg(_step(F.avg("once")).alias("step")))
    counts = steps.groupBy("team", "step").agg(F.count("*").alias("count"))
    counts = counts.groupBy("team").agg(F.collect_list(F.struct("step", "count")).alias("steps"))
    plans = counts.join(large, "team").mapInArrow(_plans, "team string, passes int, cut int")
    easy = members.join(steps, ["team", "node"]).join(plans, "team")
    easy = easy.withColumn("hard", F.col("step") >= F.col("cut")).select(small.columns)
    return staging.write(small.unionByName(easy))


def _block_links(planned: DataFrame) -> DataFrame:
    """Links of the hard vectors with all of their team. Hard ones have the first blocks of a team and
    meet every block; the others meet those of the hard ones only."""
    counts = planned.groupBy("team").agg(
        F.sum(F.col("hard").cast("long")).alias("hards"), F.count("*").alias("n")
    ).where("hards > 0")
    first = F.ceil(F.col("hards") / F.lit(BLOCK)).cast("int")
    rest = F.ceil((F.col("n") - F.col("hards")) / F.lit(BLOCK)).cast("int")
    counts = counts.select("team", first.alias("first"), rest.alias("rest"))
    dealt = F.xxhash64("node")
    rows = planned.join(counts, "team").withColumn(
        "chunk",
        F.when(F.col("hard"), F.pmod(dealt, F.col("first")))
        .otherwise(F.col("first") + F.pmod(dealt, F.greatest("rest", F.lit(1)))).cast("int"),
    )
    last = F.col("first") - 1 + F.when(F.col("hard"), F.col("rest")).otherwise(F.lit(0))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    keys = ["team", "low", "high"]
    work = rows.select(
        "team", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "node", "chunk", "vector",
    )
    return work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_between, "u long, v long")


def embedding_dedup(vectors: DataFrame, staging: Staging | None = None) -> DataFrame:
    """One row per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable by links, itself included) and kept (whether the row stands for its component)."""
    spark = vectors.sparkSession
    staging = staging or Staging(spark, "embedding-dedup")
    typed = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    signed = staging.write(typed.mapInArrow(_classed, _CLASSED))
    named = signed.where("vec_id IS NOT NULL AND key IS NOT NULL")
    classes = staging.write(
        named.groupBy("key").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("weight"),
            F.first("label").alias("label"), F.first("vector").alias("vector"),
        )
    )
    team = F.concat(F.size("vector").cast("string"), F.lit(":"), F.col("label"))
    teams = classes.select(team.alias("team"), "node", "vector")
    sizes = staging.write(teams.groupBy("team").agg(F.count("*").alias("n")))
    if sizes.isEmpty():
        return signed.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"),
        )
    planned = _planned(teams.join(sizes.where("n > 1").select("team"), "team", "left_semi"), sizes, staging)
    passed = planned.where("passes > 0").select("team", "node", "vector", "passes", "centred")
    passed = passed.mapInArrow(_project, _PASSED)
    order = ["label", "place", "node"]
    ordered = staging.write(passed).repartitionByRange(*order).sortWithinPartitions(*order)
    seen = staging.write(ordered.mapInArrow(_windows, _SEEN))
    border = seen.where("border IS NOT NULL").repartition("border")
    border = border.sortWithinPartitions("border", "side", "place")
    links = seen.where("u IS NOT NULL").select("u", "v").unionByName(
        border.mapInArrow(_borders, "u long, v long")
    ).unionByName(_block_links(planned))
    found = staging.write(components(links, staging))
    members = classes.select("node", "weight", "vector").join(found, "node")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    members = members.join(sizes, "component")
    members = members.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    work = members.select(
        "component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "node", "chunk", "weight", "vector",
    )
    keys = ["component", "low", "high"]
    counted = work.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_count, _COUNTED)
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("key", "node", "weight").join(found, "node", "left").join(counted, "node", "left")
    known = known.select(
        "key",
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    key = F.when(F.col("vec_id").isNotNull(), F.col("key"))
    rows = signed.select("vec_id", key.alias("key")).join(known, "key", "left")
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )
