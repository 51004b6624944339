"""Near-duplicate vectors: exact threshold pairs by a dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.components import components, forest
from airgrid.session import cut_lineage

BLOCK = 2048  # vectors of a cell that are handled together
CENTRES = 16  # top-level centres of a label, expected number
TOP_LABELS = 2048  # so many labels get centres, the largest; the others are cut without
SLACK = 1e-9  # for rounding in bounds; links themselves are compared exactly


class Tree:
    """Nested levels over unit vectors: each node's members lie within its radius, its children's nets halve the radius.

    A node is (members, centre, radius); children are made when the traversal asks for them.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.kids = x, {}
        centre = 0
        self.root = (np.arange(len(x)), centre, float(distance(x @ x[centre]).max()) if len(x) else 0.0)

    def children(self, node):
        members, centre, radius = node
        key = (centre, len(members), radius)
        if key not in self.kids:
            self.kids[key] = self.net(members, radius / 2)
        return self.kids[key]

    def net(self, members: np.ndarray, reach: float) -> list:
        """Centres more than ``reach`` apart, chosen in order, each with the members within reach not taken before."""
        left, out = members, []
        while len(left):
            some = left[:256]
            near = distance(self.x[some] @ self.x[left].T)
            free = np.ones(len(left), bool)
            for i in range(len(some)):
                if free[i]:
                    own = np.flatnonzero(free & (near[i] <= reach))
                    own = own if len(own) else np.array([i])  # rounding may put a vector off itself
                    free[own] = False
                    free[i] = False
                    out.append((left[own], int(some[i]), float(near[i][own].max())))
            left = left[free]
        return out


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def dual_traversal(p: Tree, q: Tree, same: bool, least: float):
    """Yields (members of p, members of q, mask of linked pairs, or None if all are); ``same``: p is q, each pair once or both ways."""
    reach = float(np.sqrt(2 - 2 * least))
    todo = [(p.root, q.root)] if len(p.x) and len(q.x) else []
    while todo:
        a, b = todo.pop()
        apart = float(distance(p.x[a[1]] @ q.x[b[1]]))
        if apart - a[2] - b[2] > reach + SLACK:
            continue
        if apart + a[2] + b[2] < reach - SLACK:
            yield a[0], b[0], None
            continue
        if len(a[0]) * len(b[0]) <= 4096:
            yield a[0], b[0], linked(p.x[a[0]], q.x[b[0]], least)
            continue
        left = p.children(a) if a[2] > 0 else [a]
        right = q.children(b) if b[2] > 0 else [b]
        if a[2] == 0 and b[2] == 0:  # equal unit vectors on both sides
            yield a[0], b[0], linked(p.x[a[0]], q.x[b[0]], least)
            continue
        cosines = p.x[[n[1] for n in left]] @ q.x[[n[1] for n in right]].T
        radius_a, radius_b = (np.array([n[2] for n in side]) for side in (left, right))
        close = distance(cosines) - radius_a[:, None] - radius_b[None, :] <= reach + SLACK
        points_a, points_b = (np.array([len(n[0]) == 1 for n in side]) for side in (left, right))
        ends = close & points_a[:, None] & points_b[None, :]
        for i in np.flatnonzero(ends.any(1)):  # pairs of single vectors end here
            js = np.flatnonzero(ends[i])
            others = np.array([right[j][0][0] for j in js])
            yield left[i][0], others, linked(p.x[left[i][0]], q.x[others], least)
        todo += [(left[i], right[j]) for i, j in np.argwhere(close & ~ends)]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is scaled by its largest component first, as the length of a large vector is no double."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    return x @ y.T >= least


def join_blocks(least: float):
    """For a group of one or two blocks: links of each vector and a forest of links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf.side == s].sort_values("rep") for s in (0, 1)]
        same = not len(sides[1])
        trees = []
        for s in sides[: 1 if same else 2]:
            v = np.stack(s.vector.to_numpy()).astype("float64") if len(s) else np.zeros((0, 1))
            trees.append(Tree(unit(v) if len(v) else v))
        p, q = trees[0], trees[-1]
        a, b = sides[0], sides[0 if same else 1]
        ids, weights = (a.rep.to_numpy(), b.rep.to_numpy()), (a.copies.to_numpy(), b.copies.to_numpy())
        counts = [np.zeros(len(a), "int64"), np.zeros(len(b), "int64")]
        xs, ys, held = [], [], 0
        for i, j, mask in dual_traversal(p, q, same, least):
            mask = np.ones((len(i), len(j)), bool) if mask is None and same else mask
            if same:
                mask = mask & (i[:, None] != j[None, :])
            if mask is None:  # all are linked: a star through the first of each side connects them
                counts[0][i] += weights[1][j].sum()
                counts[1][j] += weights[0][i].sum()
                u, w = np.concatenate([i, np.full(len(j), i[0])]), np.concatenate([np.full(len(i), j[0]), j])
            else:
                counts[0][i] += mask @ weights[1][j]
                if not same:
                    counts[1][j] += weights[0][i] @ mask
                u, w = (z[k] for z, k in zip((i, j), np.nonzero(mask)))
            if len(u):
                xs.append(ids[0][u])
                ys.append(ids[1][w])
                held += len(u)
            if held > 1 << 20:
                kept = forest(np.concatenate(xs), np.concatenate(ys))
                xs, ys, held = [kept[0]], [kept[1]], len(kept[0])
        x, y = forest(np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, "int64"), np.zeros(0, "int64"))
        rows = [pd.DataFrame({"rep": ids[k], "links": counts[k], "other": pd.array([None] * len(ids[k]), "Int64")}) for k in range(1 if same else 2)]
        rows = [r[r.links > 0] for r in rows]
        return pd.concat([*rows, pd.DataFrame({"rep": x, "links": 0, "other": pd.array(y, "Int64")})], ignore_index=True)

    return run


def usable(vector: str):
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Two vectors with the same label (not null) and number of components link when their cosine, in double precision, is at
    least ``least``. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id reachable,
    ``kept`` marks the row that bears it. Vectors that are null, zero or hold a null or a number that is not finite link with
    nothing. Repeated rows link with each other, and rows of one id with different vectors are rows of their own. A row without an
    id takes part; it is kept only where no linked row has an id, and ``component_id`` is null then. Vectors of any
    length link by their direction. An empty table gives an empty table.

    Equal vectors are one class. Each large label has a top level of about ``CENTRES`` centres, which go to all tasks; the
    cells around them, with their exact covering radii, are cut into blocks. Pairs of cells that lie too far apart are pruned;
    each remaining pair of blocks is a task of its own that joins two cover trees, so neither a label nor a dense group is
    one task. Tasks give counts and a forest of links, never all pairs of a group.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    fit = rows.filter(usable("vector") & F.col("label").isNotNull()).withColumn("group", F.struct("label", F.size("vector").alias("n")))
    classes = cut_lineage(
        # A class has a number of its own, as ids may repeat or be null.
        fit.groupBy("group", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumns({"group": F.to_json("group"), "rep": F.monotonically_increasing_id(), "hash": F.xxhash64("vector")})
    )
    sizes = classes.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.filter(F.col("size") > BLOCK).orderBy(F.desc("size"), "group").limit(TOP_LABELS)
    share = F.pmod("hash", F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = classes.join(F.broadcast(large), "group").filter(share < F.lit(CENTRES) / F.col("size")).select("group", "vector").collect()
    tops: dict[str, list] = {}
    for r in chosen:
        tops.setdefault(r.group, []).append(r.vector)
    sent = classes.sparkSession.sparkContext.broadcast({g: unit(np.array(sorted(v))) for g, v in tops.items()})

    def place(batches):
        for pdf in batches:
            pdf = pdf.assign(cell=0, apart=2.0)
            for group, part in pdf.groupby("group"):
                if group in sent.value:
                    d = distance(unit(np.stack(part.vector.to_numpy())) @ sent.value[group].T)
                    pdf.loc[part.index, "cell"] = d.argmin(1)
                    pdf.loc[part.index, "apart"] = d.min(1)
            yield pdf[["group", "cell", "apart", "rep", "copies", "hash", "vector"]]

    placed = cut_lineage(classes.mapInPandas(place, "group STRING, cell INT, apart DOUBLE, rep LONG, copies LONG, hash LONG, vector ARRAY<DOUBLE>"))
    cells = placed.groupBy("group", "cell").agg(F.max("apart").alias("radius"), F.expr(f"cast((count(1) + {BLOCK - 1}) div {BLOCK} AS INT)").alias("blocks"))
    nodes = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = nodes.select("group", *[F.col(c).alias(f"{c}_a") for c in ("cell", "block", "radius")])
    right = nodes.select("group", *[F.col(c).alias(f"{c}_b") for c in ("cell", "block", "radius")])
    reach = float(np.sqrt(2 - 2 * least))

    def near(batches):
        for pdf in batches:
            keep = []
            for r in pdf.itertuples():
                c = sent.value.get(r.group)
                keep.append(c is None or distance(c[r.cell_a] @ c[r.cell_b]) - r.radius_a - r.radius_b <= reach + SLACK)
            yield pdf[keep]

    pairs = left.join(right, "group").filter("cell_a < cell_b OR cell_a = cell_b AND block_a <= block_b")
    pairs = cut_lineage(pairs.mapInPandas(near, pairs.schema))
    sides = pairs.withColumn("pair", F.struct("cell_a", "block_a", "cell_b", "block_b"))
    ends = sides.select("group", "pair", F.col("cell_a").alias("cell"), F.col("block_a").alias("block"), F.lit(0).alias("side")).union(
        sides.filter("cell_a <> cell_b OR block_a <> block_b").select("group", "pair", "cell_b", "block_b", F.lit(1))
    )
    members = placed.join(cells.select("group", "cell", "blocks"), ["group", "cell"]).withColumn("block", F.pmod("hash", F.col("blocks")).cast("int"))
    tasks = members.join(ends, ["group", "cell", "block"]).select("group", "pair", "side", "rep", "copies", "vector")
    found = cut_lineage(tasks.groupBy("group", "pair").applyInPandas(join_blocks(least), "rep LONG, links LONG, other LONG"))

    counts = found.filter("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("other IS NOT NULL").select("rep", "other"), "rep", "other").withColumnRenamed("node", "rep")
    named = classes.select("rep", "least").join(joined, "rep").groupBy("component").agg(F.min("least").alias("smallest"))
    by_class = classes.select("group", "vector", "rep", "copies", "least").join(counts, "rep", "left").join(joined.join(named, "component"), "rep", "left")
    by_class = by_class.select(
        "group", F.xxhash64("vector").alias("hash"), "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"),
    )
    # Rows find their class by its hash and vector; the rows that take no part find none.
    fitting = rows.withColumns({
        "group": F.when(usable("vector") & F.col("label").isNotNull(), F.to_json(F.struct("label", F.size("vector").alias("n")))), "hash": F.xxhash64("vector"),
    })
    return fitting.join(by_class, ["group", "hash", "vector"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
