"""Near-duplicate vectors: shards around fitted centres, each scored whole for all who may have a partner in it.

1. Vectors that cannot be compared are set aside, equal ones collapsed to one representative with a weight.
2. Centres of clusters are fitted on a bounded sample. Every vector is *stored* in the shard of its nearest centre. A shard that a hot cluster
   makes too large is dealt into slices by id; whoever asks the shard asks all its slices.
   Those who ask are dealt into blocks by id, and a slice's rows are sent to each block, so neither side of a task grows with the data.
3. Every vector asks all shards but those that two exact bounds (angles to the centre, planes half-way between centres) show to hold no partner
   of it; of two shards only one asks the other. It is scored, in double precision, against every vector stored there. No walk over a
   graph of neighbours stands between: it cannot enter a tight group that has no edge to the rest, and scoring a slice is one product of matrices.
   Clustered vectors ask few shards. Directions without clusters leave nothing to rule out, and all pairs are scored.
4. A pair is met in one place and counts for both its ends, and none is sent as a pair: a task sends counts and links that join the same parts.
5. Components of the links.

``audit`` measures the recall of links by brute force from a sample of vectors against all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions.staging import staged
from quotemill.llm.components import components, one_per_id

THRESHOLD = 0.9
SHARD = 2_000
#: Added to the bounds for rounding, and rows of a batch that is sent.
SLACK, ROWS = 1e-6, 8_000
#: The sample that centres are fitted on, and centres at most (their broadcast is bounded by that).
SAMPLE, CENTRES = 20_000, 2_048


def comparable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows whose vector is not null, not empty, has no null or non-finite component and is not zero; v in double precision."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine & some, F.lit(False)))


def of_common_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the most frequent length, of equally frequent ones the longest."""
    common = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return rows.where(F.size("v") == common["length"]) if common else rows


def unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def _columns(table, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(table[k], t) if k != "v" else table[k] for k, t in kinds.items()], names=list(kinds))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))


def _matrix(column, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(rows, -1)


def _house(middles: np.ndarray):
    """Each vector's home, the shard of its nearest centre, and its angle to that centre."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(1).to_pylist())
                near = x @ middles.T
                home = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(home, pa.int32()), pa.array(angle), _lists(x)], names=["vec_id", "n", "home", "angle", "v"])

    return run


def _asked(x: np.ndarray, home: np.ndarray, middles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which shards each vector has to ask, as a boolean matrix: all but those that surely hold no partner of it, or ask it themselves.

    Two bounds leave a shard out, both exact. The angles to its centre differ by the angle between two vectors at most, and its vectors'
    angles lie between ``low`` and ``high``. And its vectors are nearer to its centre than to the vector's own, so they lie beyond the plane
    half-way between, whose distance from the vector must not exceed the chord of the range.
    """
    near = x @ middles.T
    angle = np.arccos(np.clip(near, -1, 1))
    reach = math.acos(THRESHOLD) + SLACK
    may = (angle - reach <= high) & (angle + reach >= low)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (middles[home] @ middles.T)))
    may &= near[np.arange(len(x)), home][:, None] - near <= (math.sqrt(2 - 2 * THRESHOLD) + SLACK) * apart + SLACK
    # of two shards, one asks the other: each asks about half of the rest
    shards = np.arange(len(middles))
    turn = (home[:, None] > shards) == ((home[:, None] + shards) % 2 == 0)
    may &= turn
    may[np.arange(len(x)), home] = True
    return may


def _demand(middles: np.ndarray, low: np.ndarray, high: np.ndarray):
    """How many vectors ask each shard, a row per batch and shard."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                home = np.asarray(batch.column(2))
                total = _asked(_matrix(batch.column(4), len(home)), home, middles, low, high).sum(axis=0)
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["shard", "m"])

    return run


def _mixed(ids: np.ndarray, times: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(times) >> np.uint64(20)).astype(np.int64)


KINDS = {"shard": pa.int32(), "slice": pa.int32(), "block": pa.int32(), "role": pa.int32(), "vec_id": pa.int64(), "n": pa.int64(), "v": pa.list_(pa.float64())}


def _route(middles: np.ndarray, low: np.ndarray, high: np.ndarray, slices: np.ndarray, blocks: np.ndarray):
    """A row for each slice that a vector asks (role 0), and one for each block of those who ask the slice where it is stored (role 1).
    Of two slices of a shard, the later asks the earlier."""

    def run(batches):
        for batch in batches:
            ids, w, home = (np.asarray(batch.column(k)) for k in range(3))
            if not len(ids):
                continue
            x = _matrix(batch.column(4), len(ids))
            own = _mixed(ids, 2654435761) % slices[home]
            who, shard = np.nonzero(_asked(x, home, middles, low, high))
            times = np.where(shard == home[who], own[who] + 1, slices[shard])
            who, shard = np.repeat(who, times), np.repeat(shard, times)
            part = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
            block = _mixed(ids, 2246822519)[who] % blocks[shard]
            role = np.zeros(len(who), dtype=int)
            to = np.repeat(np.arange(len(ids)), blocks[home])
            each = np.arange(len(to)) - np.repeat(np.cumsum(blocks[home]) - blocks[home], blocks[home])
            who, shard, part, block, role = (np.concatenate(z) for z in ((who, to), (shard, home[to]), (part, own[to]), (block, each), (role, np.ones(len(to), dtype=int))))
            for a in range(0, len(who), ROWS):
                k = who[a : a + ROWS]
                yield _columns({"shard": shard[a : a + ROWS], "slice": part[a : a + ROWS], "block": block[a : a + ROWS], "role": role[a : a + ROWS], "vec_id": ids[k], "n": w[k], "v": _lists(x[k])}, KINDS)

    return run


def _search(table: pa.Table) -> pa.Table:
    """Every question of one block against every stored row of one slice. A pair is met once and counts for both; two rows stored here are met from the larger id."""
    ids, role, n = (np.asarray(table[c]) for c in ("vec_id", "role", "n"))
    x = _matrix(table["v"], len(ids))
    nodes, asks = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    nodes, asks = nodes[np.argsort(ids[nodes], kind="stable")], asks[np.argsort(ids[asks], kind="stable")]
    points, met, weight = x[nodes], ids[nodes], n[nodes]
    back = np.zeros(len(nodes), dtype=np.int64)
    label = np.arange(len(nodes))
    counts: list[tuple[np.ndarray, np.ndarray]] = []
    links: list[tuple[int, int]] = []
    step = max(1, 4_000_000 // max(1, len(nodes)))
    for a in range(0, len(asks) if len(nodes) else 0, step):
        k = asks[a : a + step]
        hit = x[k] @ points.T >= THRESHOLD
        here = np.isin(ids[k], met)
        hit[here] &= met < ids[k][here][:, None]
        who, what = np.nonzero(hit)
        if not len(who):
            continue
        total = np.bincount(who, weights=weight[what], minlength=len(k)).astype(np.int64)
        back += np.bincount(what, weights=n[k][who], minlength=len(nodes)).astype(np.int64)
        some = np.flatnonzero(total)
        counts.append((ids[k][some], total[some]))
        # one link to each part of the stored rows that a question meets, which makes them one part
        ends = np.searchsorted(who, [some, some + 1])
        for i, first, last in zip(some, *ends, strict=True):
            js = what[first:last]
            parts, at = np.unique(label[js], return_index=True)
            links += [(int(ids[k[i]]), int(met[j])) for j in js[at]]
            if len(parts) > 1:
                label[np.isin(label, parts)] = parts[0]
    some = np.flatnonzero(back)
    counts.append((met[some], back[some]))
    found_id, found_n = (np.concatenate(z) for z in zip(*counts, strict=True))
    return pa.table(
        {
            "vec_id": pa.array(found_id.tolist() + [a for a, _ in links], pa.int64()),
            "n": pa.array(found_n.tolist() + [0] * len(links), pa.int64()),
            "other": pa.array([None] * len(found_id) + [b for _, b in links], pa.int64()),
        }
    )


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Ids are whole numbers; rows with a null id are left out. Rows that share an id are one vector, the smallest of theirs that can be compared, and come out
    once each. A vector that is null, empty or zero, or holds a null or non-finite component, links with nothing; nor does one of another length than the
    most frequent one (of equally frequent ones the longest). Copies link with each other and share the links of their representative.
    An empty table gives no rows. Labels and other columns are not read.
    """
    everything = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"))
    usable = of_common_length(one_per_id(comparable(vectors, id_col, vector_col)))
    one = staged(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    count = one.count()
    if not count:
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1.0, SAMPLE / count)
    sample = unit([r["v"] for r in one.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("v").limit(2 * SAMPLE).collect()] or [one.select("v").first()["v"]])
    k = max(1, min(CENTRES, len(sample), math.ceil(count / SHARD)))
    middles = centres(sample, k)
    flat = one.select(F.col("rep").alias("vec_id"), "v", "n")
    housed = staged(flat.mapInArrow(_house(middles), "vec_id long, n long, home int, angle double, v array<double>"), "housed")
    # what each shard stores gives its bounds and the number of its slices; one small row per shard
    low, high, slices = np.full(k, 9.0), np.full(k, -9.0), np.ones(k, dtype=int)
    for r in housed.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():
        low[r["home"]], high[r["home"]], slices[r["home"]] = r["low"], r["high"], math.ceil(r["m"] / (4 * SHARD))
    blocks = np.ones(k, dtype=int)
    for r in housed.mapInArrow(_demand(middles, low, high), "shard int, m long").groupBy("shard").agg(F.sum("m").alias("m")).collect():
        blocks[r["shard"]] = math.ceil(r["m"] / (4 * SHARD))
    routed = housed.mapInArrow(_route(middles, low, high, slices, blocks), "shard int, slice int, block int, role int, vec_id long, n long, v array<double>")
    found = staged(routed.groupBy("shard", "slice", "block").applyInArrow(_search, "vec_id long, n long, other long"), "found")
    counts = found.where("other is null").groupBy("vec_id").agg(F.sum("n").alias("met"))
    parts = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    reps = one.join(counts, one["rep"] == counts["vec_id"], "left").join(parts, F.col("rep") == F.col("id"), "left")
    reps = reps.select("v", F.coalesce("met", F.lit(0)).alias("met"), "n", F.coalesce("component", "rep").alias("component_id"))
    linked = usable.join(reps, "v").select("vec_id", (F.col("met") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    out = everything.join(linked, "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def audit(vectors: DataFrame, linked: DataFrame, sample: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Recall of links: links found from a bounded sample of vectors, as a share of those that brute force against all vectors finds."""
    usable = comparable(vectors, id_col, vector_col)
    asked = usable.orderBy(F.xxhash64("vec_id")).limit(sample).collect()
    if not asked:
        return 1.0
    questions, ids = unit([r["v"] for r in asked]), np.array([r["vec_id"] for r in asked])

    def run(batches):
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                hit = (questions @ unit(batch.column(1).to_pylist()).T) >= THRESHOLD
                total += (hit & (ids[:, None] != np.asarray(batch.column(0))[None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "true_links"])

    truth = usable.mapInArrow(run, "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("true_links"))
    row = truth.join(linked, "vec_id").agg(F.sum(F.least("true_links", "n_links")).alias("found"), F.sum("true_links").alias("there")).first()
    return 1.0 if not row["there"] else row["found"] / row["there"]
