"""Exact top-k by inner product: a walk down two cover trees at once.

Vectors are whole numbers (floor of a multiple of each component), so scores are exact integers. Questions come in blocks and data in blocks of
bounded size, dealt out by id; every block of questions meets every block of data (a stated set of questions against all rows). Within a meeting both
blocks are cover trees: nodes are rows of the block, with the radius that covers what is below them. The walk starts with the pair of roots. The inner
product of any two rows below a pair (q, x) differs from <q, x> by at most |q| r_x + |x| r_q + r_q r_x, and that of any question below q with the row x itself
by at most |x| r_q. What the k best of either kind surely give, every question of a node reaches already; pairs whose upper bound stays below it are dropped,
and only the children of the others are looked at, on both sides. What is left where the trees end is scored exactly. Each meeting sends the k best per question; the
best k of those are the answer, ties to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.components import one_per_id

SCALE, K, EVERY = 1024, 10, 100
#: Rows of a block of data and of a block of questions.
BLOCK, QUESTIONS = 8_192, 2_048


def cover_tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the root down as (row of each node, its covering radius, index of its parent on the level above).

    Nodes of a level are further apart than the level's radius; every row lies within that radius of a node of the level. Radii halve; a node is its own
    first child. The last level has one node per row (equal rows each have their own), with radius 0.
    """
    n = len(x)
    square = (x * x).sum(axis=1)
    distance = lambda i, rows: np.sqrt(np.maximum(0.0, square[rows] + square[i] - 2 * (x[rows] @ x[i])))
    owner = np.zeros(n, dtype=int)  # node of the level above that covers each row
    to_owner = distance(0, np.arange(n))
    radius = float(to_owner.max(initial=0.0))
    levels = [(np.array([0]), np.array([radius]), np.array([0]))]
    for _ in range(12):
        radius /= 2
        if radius < 1:
            break
        nodes: list[int] = []
        parents: list[int] = []
        new_owner = np.full(n, -1)
        new_to = np.zeros(n)
        for p, centre in enumerate(levels[-1][0]):
            rows = np.flatnonzero(owner == p)
            gap = distance(centre, rows)
            at = int(centre)
            left = rows
            while True:  # greedy: a row not covered yet becomes a node
                near = gap <= radius
                near |= left == at
                new_owner[left[near]] = len(nodes)
                new_to[left[near]] = gap[near]
                nodes.append(at)
                parents.append(p)
                left = left[~near]
                if not len(left):
                    break
                at = int(left[0])
                gap = distance(at, left)
        reach = np.zeros(len(nodes))
        np.maximum.at(reach, new_owner, new_to)
        levels.append((np.array(nodes), reach, np.array(parents)))
        owner = new_owner
        if len(nodes) > n // 2:  # the next level is the rows themselves
            break
    levels.append((np.arange(n), np.zeros(n), owner))
    return levels


class _Tree:
    """A cover tree with children in one stretch: per level the nodes' rows and radii, and where their children lie on the next level."""

    def __init__(self, x: np.ndarray):
        self.rows, self.radius, self.ends = [], [], []
        place = np.zeros(1, dtype=int)  # where each node of the level above went
        for nodes, radius, parent in cover_tree(x):
            parent = place[parent]
            order = np.argsort(parent, kind="stable")
            if self.rows:
                self.ends.append(np.searchsorted(parent[order], np.arange(len(self.rows[-1]) + 1)))
            self.rows.append(nodes[order])
            self.radius.append(radius[order])
            place = np.empty(len(order), dtype=int)
            place[order] = np.arange(len(order))
        #: the last level whose nodes have rows below them
        self.last = len(self.rows) - 2
        self.count = [np.ones(len(self.rows[-1]), dtype=int)]  # rows below each node
        for ends in reversed(self.ends):
            self.count.insert(0, np.diff(np.concatenate([[0], np.cumsum(self.count[0])])[ends]))

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of the given nodes one after the other, and how many each has."""
        first, n = self.ends[level][nodes], self.ends[level][nodes + 1] - self.ends[level][nodes]
        return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _expand(a: np.ndarray, b: np.ndarray, tree_a: _Tree, tree_b: _Tree, level_a: int, level_b: int):
    """Pairs of children of pairs; a side that has reached its last level stays."""
    if level_a < tree_a.last:
        children, n = tree_a.below(level_a, a)
        a, b = children, np.repeat(b, n)
    if level_b < tree_b.last:
        children, n = tree_b.below(level_b, b)
        a, b = np.repeat(a, n), children
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def meet(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """The k best of each question in one block, as lists of (question, row, score), and how many inner products were taken. A question never meets
    its own id."""
    tree_q, tree_x = _Tree(q), _Tree(x)
    norm_q, norm_x = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    a, b = np.zeros(1, dtype=int), np.zeros(1, dtype=int)
    level_q = level_x = 0
    reached = np.full(1, -np.inf)  # what every question of a node is known to reach k times
    taken = 0
    while True:
        rows_q, rows_x = tree_q.rows[level_q][a], tree_x.rows[level_x][b]
        r_q, r_x = tree_q.radius[level_q][a], tree_x.radius[level_x][b]
        ends = np.searchsorted(a, np.arange(len(reached) + 1))
        product = np.empty(len(a))
        for first, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if first < end:
                product[first:end] = x[rows_x[first:end]] @ q[rows_q[first]]
        taken += len(a)
        # one more than k: one of the rows may be the question itself
        spread = norm_q[rows_q] * r_x + norm_x[rows_x] * r_q + r_q * r_x
        for least, rows in ((product - norm_x[rows_x] * r_q, np.ones(len(a), dtype=int)), (product - spread, tree_x.count[level_x][b])):
            order = np.lexsort((-least, a))
            total = np.cumsum(rows[order])
            before = np.concatenate([[0], total])[ends[:-1]]
            place = np.searchsorted(total, before + k + 1)
            enough = np.flatnonzero(place < ends[1:])
            reached[enough] = np.maximum(reached[enough], least[order[place[enough]]])
        most = product + spread
        alive = most >= reached[a] - 1e-6
        a, b = a[alive], b[alive]
        if level_q >= tree_q.last and level_x >= tree_x.last:
            break
        if level_q < tree_q.last:
            inherited = np.repeat(reached, np.diff(tree_q.ends[level_q]))
        else:
            inherited = reached
        a, b = _expand(a, b, tree_q, tree_x, level_q, level_x)
        level_q, level_x, reached = min(level_q + 1, tree_q.last), min(level_x + 1, tree_x.last), inherited
    found_q, found_x, scores = [], [], []
    ends = np.searchsorted(a, np.arange(len(reached) + 1))
    for g in np.flatnonzero(np.diff(ends)).tolist():
        asked = tree_q.rows[-1][tree_q.ends[tree_q.last][g] : tree_q.ends[tree_q.last][g + 1]]
        rows = tree_x.rows[-1][tree_x.below(tree_x.last, b[ends[g] : ends[g + 1]])[0]]
        taken += len(asked) * len(rows)
        s = np.where(q_ids[asked][:, None] == x_ids[rows][None, :], -np.inf, q[asked] @ x[rows].T)
        for i, one in enumerate(asked.tolist()):
            order = np.lexsort((x_ids[rows], -s[i]))[:k] if len(rows) <= 4 * k else _first(s[i], x_ids[rows], k)
            order = order[s[i][order] > -np.inf]
            found_q += [int(q_ids[one])] * len(order)
            found_x += x_ids[rows[order]].tolist()
            scores += s[i][order].astype(np.int64).tolist()
    return found_q, found_x, scores, taken


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    cut = np.partition(score, len(score) - k)[len(score) - k]
    some = np.flatnonzero(score >= cut)
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by ``every``, itself left out.

    Ids are whole numbers; rows with a null id, a null or empty vector, or a null or non-finite component take no part. Zero vectors do. Of rows that share an id the
    one with the smallest vector counts. Vectors of another length than the most frequent one (of equally frequent ones the longest) take no part. Equal
    vectors tie and rank by id. An empty table, or one without questions, gives no rows; fewer candidates than k give all.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(v) > 0)
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    rows = one_per_id(rows).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("v"))
    is_asked = F.pmod("vec_id", F.lit(every)) == 0
    sizes = rows.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_asked).alias("m"))
    common = sizes.orderBy(F.desc("n"), F.desc("length")).first()
    length, n, m = common or (0, 0, 0)
    rows = rows.where(F.size("v") == length)
    asked = rows.where(is_asked)
    data_blocks, question_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUESTIONS))
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    data = rows.select(deal(data_blocks).alias("i"), each(question_blocks).alias("j"), "vec_id", "v", F.lit(False).alias("asks"))
    questions = asked.select(each(data_blocks).alias("i"), deal(question_blocks).alias("j"), "vec_id", "v", F.lit(True).alias("asks"))

    def work(t: pa.Table) -> pa.Table:
        ids, asks = np.asarray(t["vec_id"]), np.asarray(t["asks"])
        x = np.array(t["v"].to_pylist(), dtype=float)
        order = np.argsort(ids, kind="stable")
        ids, asks, x = ids[order], asks[order], x[order]
        out = meet(x[asks], ids[asks], x[~asks], ids[~asks], k)[:3] if asks.any() and (~asks).any() else ([], [], [])
        return pa.table({c: pa.array(o, pa.int64()) for c, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = data.unionByName(questions).groupBy("i", "j").applyInArrow(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
