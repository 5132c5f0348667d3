"""Hard-negative mining over anchor-clustered shared lists (as MAXIMUS walks them).

Anchors are clustered by the direction of their vectors. For a cluster, every candidate of a slab gets one upper bound
of its inner product with any member of the cluster, for a member of length one: its own length times the cosine of its
angle to the cluster's centre less the cluster's angular radius. The slab is sorted by this bound once and all members
walk the list together, some candidates at a time; a member stops when the bound of what is left, times the member's
length, is below what it still could take. That is certified: nothing behind can enter its result.

Two searches follow one another. The first finds each anchor's positives (the best rows of its label); the second finds,
for each positive's score p, the best rows of other labels with a score between ``low`` percent of p and p. Each is run
on a sixteenth of the slabs at first, whose results are lower bounds of what the whole table has; they are carried by the
anchors, so a slab returns little that is not in the result.

Candidates lie in slabs by the hash of their row; anchors of one cluster travel in bounded groups, one copy a slab, and
meet the slab's candidates by its number. A task holds one slab and reads the groups as they come. Nothing is broadcast
but the cluster centres, which are fitted on a bounded sample (``SAMPLE_ANCHORS``) and decide only how fast the walk
ends, never its result.

Scores are inner products of whole numbers (components times ``SCALE``, rounded down), so ties are exact: the smaller
vec_id comes first.

Cases: rows with a null vec_id or label, a null vector, or a null or non-finite component take no part, nor do rows with
components so large that a score needs more than 64 bits (beyond 2**28 / SCALE; 2**24 / SCALE when there are more than 64)
or with 2**14 components; vectors of different lengths never meet; an empty vector scores 0 with others; rows that repeat
a vec_id are rows of their own, and an anchor that is repeated is answered once for each row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import arrow_map, release, staged

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: a negative scores between LOW and HIGH percent of the positive
LOW, HIGH = 80, 100
#: anchors that the centres are fitted on, centres, and rounds of fitting
SAMPLE_ANCHORS, CENTRES, ROUNDS = 2048, 16, 8
#: anchors that travel together, components in a slab about, slabs at least, and the part of the slabs of the first search
GROUP, SLAB_VALUES, LEAST_SLABS, PART = 64, 1 << 22, 16, 16
#: candidates that are scored at once in a walk
STEP = 512
#: whole numbers below this are exact in double precision
EXACT = 1 << 53


def usable(vec_id: Column, label: Column, vector: Column) -> Column:
    limit = F.when(F.size(vector) <= 64, F.lit(2.0**28)).otherwise(F.lit(2.0**24)) / SCALE
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)
    return vec_id.isNotNull() & label.isNotNull() & vector.isNotNull() & (F.size(vector) < 1 << 14) & F.forall(vector, fits)


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """uid (a row's own number), vec_id, label, dim and the whole-number vector of every row that takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.coalesce(usable(F.col("vec_id"), F.col("label"), F.col("vector")), F.lit(False)))
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.size("vector").alias("dim"), whole.alias("vector"))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one (a zero row stays zero), and their lengths."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return np.divide(vectors, length[:, None], out=np.zeros_like(vectors), where=length[:, None] > 0), length


def fit_centres(vectors: np.ndarray, centres: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of clusters, by spherical k-means from evenly spread rows."""
    rows, _ = unit(vectors)
    found = rows[np.linspace(0, len(rows) - 1, min(centres, len(rows))).astype(int)]
    for _ in range(rounds):
        own = np.argmax(rows @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, rows)
        fresh, length = unit(sums)
        found = np.where(length[:, None] > 0, fresh, found)
    return found


def centres_of(anchors: DataFrame) -> dict[int, np.ndarray]:
    """Centres by the vectors' length (dim), from at most SAMPLE_ANCHORS anchors."""
    order = F.xxhash64("vec_id", "vector")
    sample = anchors.select("dim", "vector").orderBy(order, "vec_id").limit(SAMPLE_ANCHORS).collect()
    found = {}
    for dim, rows in itertools.groupby(sorted(sample, key=lambda r: r["dim"]), key=lambda r: r["dim"]):
        held = [r["vector"] for r in rows]
        found[dim] = fit_centres(np.array(held, np.float64).reshape(len(held), dim))
    return found


def assigned(anchors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``anchors`` with the cluster whose centre is nearest (0 where no centre has the vector's length)."""

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.zeros(batch.num_rows, np.int32)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in centres and dim:
                    at = np.flatnonzero(dims == dim)
                    flat = batch.column("vector").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                    own[at] = np.argmax(flat.astype(np.float64).reshape(-1, dim) @ centres[dim].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "cluster"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return arrow_map(anchors, nearest, f"{kinds}, cluster int")


class Slab:
    """Candidates of one length, and their order for one cluster."""

    def __init__(self, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, vector: np.ndarray):
        self.uid, self.vec_id, self.label, self.vector = uid, vec_id, label, vector
        self.unit, self.length = unit(vector)
        self.size = np.abs(vector).max(initial=0.0)
        self.cluster: tuple | None = None
        self.scored = 0  # pairs of a member and a candidate

    def shared_list(self, cluster: int, centre: np.ndarray, radius: float) -> None:
        """Sort the candidates by the bound; members of one cluster's groups share the order of the widest one so far."""
        if self.cluster is not None and self.cluster[0] == cluster and self.cluster[1] >= radius:
            return
        angle = np.arccos(np.clip(self.unit @ centre, -1.0, 1.0))
        bound = self.length * np.cos(np.maximum(0.0, angle - radius))
        bound += 1e-7 * self.length  # more than the rounding of both angles
        self.order = np.argsort(-bound, kind="stable")
        self.bound = np.append(bound[self.order], -np.inf)
        self.cluster = (cluster, radius)

    def scores(self, members: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products, members x candidates."""
        other = self.vector[at]
        self.scored += len(members) * len(at)
        if members.shape[1] * self.size * np.abs(members).max(initial=0.0) < EXACT:
            return np.rint(members @ other.T).astype(np.int64)
        return members.astype(np.int64) @ other.astype(np.int64).T


def best_rows(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` rows of each group: score descending, vec_id, uid."""
    order = np.lexsort((uid, vec_id, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < n]


def walk(slab: Slab, anchors: dict, centre: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
    """Walk the cluster's list with all ``anchors`` (uid, label, vector, cluster, and per row ``windows`` of [lowest,
    highest score, floor]): (anchor row, window, score, candidate) of the first NEGATIVES or POSITIVES of each window."""
    vector, windows = anchors["vector"], anchors["windows"]
    turned, length = unit(vector)
    angle = np.arccos(np.clip(turned @ centre, -1.0, 1.0))
    slab.shared_list(anchors["cluster"], centre, float(angle.max(initial=0.0)) + 1e-9)
    n, wide = (POSITIVES if same else NEGATIVES), windows.shape[1]
    lowest, highest, floor = windows[:, :, 0], windows[:, :, 1], np.maximum(windows[:, :, 0], windows[:, :, 2])
    held = [np.zeros(0, np.int64)] * 3  # window (row * wide + number), score, candidate
    alive = np.flatnonzero((floor <= highest).any(axis=1))
    for at in range(0, len(slab.vec_id), STEP):
        # what is left cannot reach the floor of any open window
        reach = np.ceil(length[alive] * slab.bound[at] + 1e-6)
        need = np.where(floor[alive] <= highest[alive], floor[alive], np.iinfo(np.int64).max).min(axis=1)
        alive = alive[reach >= need]
        if not len(alive):
            break
        who = slab.order[at : at + STEP]
        score = slab.scores(vector[alive], who)
        fits = slab.label[who][None, :] == anchors["label"][alive][:, None]
        fits = fits & (slab.uid[who][None, :] != anchors["uid"][alive][:, None]) if same else ~fits
        for w in range(wide):
            a, c = np.nonzero(fits & (score >= floor[alive, w][:, None]) & (score <= highest[alive, w][:, None]))
            if not len(a):
                continue
            held = [np.concatenate([h, new]) for h, new in zip(held, (alive[a] * wide + w, score[a, c], who[c]), strict=True)]
        if len(held[0]):
            kept = best_rows(held[0], held[1], slab.vec_id[held[2]], slab.uid[held[2]], n)
            held = [h[kept] for h in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=floor.size) >= n)
            last = np.searchsorted(held[0], full, side="right") - 1
            floor[full // wide, full % wide] = np.maximum(floor[full // wide, full % wide], held[1][last])
    return held[0] // wide, held[0] % wide, held[1], held[2]


_ROW = "uid long, vec_id long, label long, dim int, vector array<int>"
_FOUND = "anchor_uid long, window int, score long, vec_id long, uid long"


def meet(candidates: DataFrame, anchors: DataFrame, slabs: int, part: int, centres: dict[int, np.ndarray], same: bool) -> DataFrame:
    """One search: (anchor_uid, window, score, vec_id, uid) of every slab; ``part`` > 1 takes the first of that many parts."""
    used = max(1, slabs // part)
    rows = candidates.filter(F.col("slab") < used).select(
        "slab", "dim", F.lit(-1).alias("cluster"), F.lit(0).alias("group"), "uid", "vec_id", "label", "vector", F.lit(None).cast("array<array<bigint>>").alias("windows")
    )
    sizes = anchors.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = anchors.join(F.broadcast(sizes), ["dim", "cluster"]).withColumn("group", F.pmod(F.xxhash64("uid"), F.col("groups")).cast("int"))
    packed = dealt.groupBy("dim", "cluster", "group").agg(F.collect_list(F.struct("uid", "label", "vector", "windows")).alias("members"))
    copies = packed.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(used - 1))))
    empty = lambda kind: F.lit(None).cast(kind)
    rows = rows.withColumn("members", empty(packed.schema["members"].dataType))
    copies = copies.select("slab", "dim", "cluster", "group", empty("long").alias("uid"), empty("long").alias("vec_id"), empty("long").alias("label"), empty("array<int>").alias("vector"), empty("array<array<bigint>>").alias("windows"), "members")
    both = rows.unionByName(copies).repartition(min(used, 4096), "slab", "dim").sortWithinPartitions("slab", "dim", "cluster", "group")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, key, waiting = None, None, []
        for batch in batches:
            for start, stop, here, is_anchor in runs(batch):
                rows = batch.slice(start, stop - start)
                if here != key:
                    slab, key, waiting = None, here, []
                if not is_anchor:
                    waiting.append(rows)
                    continue
                if slab is None and waiting:
                    slab, waiting = slab_of(waiting, here[1]), []
                if slab is not None:
                    for k in range(rows.num_rows):
                        yield from answer(slab, rows, k, here[1])
        release()

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple, bool]]:
        s, d, c = (batch.column(n).to_numpy() for n in ("slab", "dim", "cluster"))
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | ((c[1:] < 0) != (c[:-1] < 0))
        for a, b in itertools.pairwise([*np.flatnonzero(new).tolist(), len(s)]):
            yield a, b, (int(s[a]), int(d[a])), bool(c[a] >= 0)

    def slab_of(parts: list[pa.RecordBatch], dim: int) -> Slab:
        table = pa.Table.from_batches(parts)
        column = lambda n: table.column(n).to_numpy()
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vector").chunks])
        return Slab(column("uid"), column("vec_id"), column("label"), flat.astype(np.float64).reshape(table.num_rows, dim))

    def answer(slab: Slab, rows: pa.RecordBatch, k: int, dim: int) -> Iterator[pa.RecordBatch]:
        cluster = rows.column("cluster")[k].as_py()
        members = rows.column("members").slice(k, 1).flatten()
        flat = lambda n: members.field(n)
        n = len(members)
        anchors = {
            "cluster": cluster, "uid": flat("uid").to_numpy(), "label": flat("label").to_numpy(),
            "vector": flat("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim),
            "windows": flat("windows").flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1, 3),
        }
        centre = centres[dim][cluster] if dim in centres and dim else np.zeros(dim)
        row, window, score, who = walk(slab, anchors, centre, same)
        if len(row):
            columns = [anchors["uid"][row], window.astype(np.int32), score, slab.vec_id[who], slab.uid[who]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_uid", "window", "score", "vec_id", "uid"])

    found = arrow_map(both, run, _FOUND)
    order = Window.partitionBy("anchor_uid", "window").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (POSITIVES if same else NEGATIVES))


def _with_floors(anchors: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Raise the floor of each window to its n-th score found so far."""
    last = found.filter(F.col("rank") == n).groupBy("anchor_uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors"))
    rows = anchors.join(last, anchors["uid"] == last["anchor_uid"], "left")
    floor = lambda w, i: F.array(w[0], w[1], F.greatest(w[2], F.coalesce(F.col("floors")[i], w[2])))
    rows = rows.withColumn("floors", F.coalesce("floors", F.create_map().cast("map<int,bigint>")))
    return rows.withColumn("windows", F.transform("windows", floor)).drop("floors", "anchor_uid")


def mine(vectors: DataFrame, anchor: Column, label: Column | None = None) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. ``anchor`` and ``label`` are expressions over vec_id and label."""
    rows = staged(prepared(vectors, F.col("label") if label is None else label), "candidates")
    values = rows.agg(F.sum("dim")).first()[0] or 0
    slabs = max(LEAST_SLABS, -(-values // SLAB_VALUES))
    rows = rows.withColumn("slab", F.pmod(F.xxhash64("uid"), F.lit(slabs)).cast("int"))
    anchors = rows.filter(anchor).drop("slab")
    lowest, highest = F.lit(-(1 << 62)).cast("long"), F.lit(1 << 62).cast("long")
    centres = centres_of(anchors)
    anchors = staged(assigned(anchors.withColumn("windows", F.array(F.array(lowest, highest, lowest))), centres), "anchors")
    first = staged(meet(rows, anchors, slabs, PART, centres, same=True), "positive-floors")
    positives = staged(meet(rows, _with_floors(anchors, first, POSITIVES), slabs, 1, centres, same=True), "positives")
    # a window for each positive: scores between LOW and HIGH percent of the positive's, rounded inwards
    none = F.array(F.lit(1), F.lit(0), F.lit(0)).cast("array<bigint>")
    percent = lambda n, way: F.expr(f"CAST({way}(CAST(score AS DECIMAL(22, 0)) * {n} / 100) AS BIGINT)")
    least, most = percent(LOW, "CEIL"), percent(HIGH, "FLOOR")
    windows = positives.select("anchor_uid", F.col("rank").alias("positive"), F.when(F.col("score") < 0, none).otherwise(F.array(least, most, least)).alias("w"))
    windows = windows.groupBy("anchor_uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive", "w"))), lambda x: x["w"]).alias("own"))
    padded = F.slice(F.concat("own", F.array_repeat(none, POSITIVES)), 1, POSITIVES)
    asked = anchors.drop("windows").join(windows.withColumn("windows", padded).drop("own"), F.col("uid") == F.col("anchor_uid")).drop("anchor_uid")
    asked = staged(asked.select(anchors.columns), "asked")
    first = staged(meet(rows, asked, slabs, PART, centres, same=False), "negative-floors")
    negatives = meet(rows, _with_floors(asked, first, NEGATIVES), slabs, 1, centres, same=False)
    named = positives.select("anchor_uid", (F.col("rank") - 1).cast("int").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select(F.col("uid").alias("anchor_uid"), F.col("vec_id").alias("anchor_id")), "anchor_uid")
    found = negatives.select("anchor_uid", "window", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    return named.join(found, ["anchor_uid", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """The same rows for ``embeddings``, by scoring every pair with an anchor."""
    return """
WITH r AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.uid AS a, a.vec_id AS anchor_id, b.uid AS b, b.vec_id AS vec_id, a.label = b.label AS same,
      CAST(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS score
    FROM r a JOIN r b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
  p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS k FROM s WHERE same),
  n AS (SELECT p.a, p.anchor_id, p.k, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
      row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id, s.b) AS rank
    FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
