"""The k most similar vectors for every vector: an inverted file with product-quantised residuals.

1. The current vector of each key is taken from the write log and scaled to length 1 (cosine similarity). Equal vectors
   become one, known by a 64-bit hash that is checked for collisions.
2. The coarse centroids form a tree. Its first level is fitted by k-means on a sample of about ``sample`` vectors; as long as a
   leaf holds more than twice ``cell_rows`` vectors, it is fitted again by k-means in a task of its own, on a sample of
   its own vectors. So leaves keep their size whatever the number of vectors and however dense a region is.
3. Every vector is indexed: it goes to its nearest leaf, and its residual there is coded to ``m`` bytes.
4. Every vector is also a query of its ``probes`` nearest leaves. It is shipped once to be stored and searched in its own
   leaf, and once for each other leaf.
5. In a leaf, asymmetric distance tables rank the codes for each query; the best ``keep`` are scored again exactly, and
   so is everything tied with the last of those by code. Leaves send k ids and similarities for each query.
6. The best k of a query over its leaves are kept.

A leaf that k-means cannot divide (it gave nine tenths to one side) is cut into blocks by hash, each of which its queries
visit; queries that crowd one leaf are cut into parts, each of which gets the stored vectors.

Sizes: the driver and the tasks hold the tree, 256 bytes for each leaf and ``MAX_CENTRES`` nodes at most (64 MB), and about
``sample`` vectors. From 13 million vectors on that bound makes leaves larger, to a thousand vectors for 100 million.

Defined results
  * a key's row with the highest order counts, and only if it has ``dim`` numbers, none null or NaN or infinite, not all
    zero; null keys are left out; the length of a vector does not matter;
  * equal vectors under different keys are each other's neighbours, by key; with k or fewer others, all come out; which of
    several different, equally similar vectors takes the last place is decided by a hash of the vectors;
  * empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

DIM, K = 64, 5
#: Rows of the sample that the first level and the codebooks are fitted on, and of a leaf on average.
SAMPLE_ROWS, CELL_ROWS = 40_000, 128
MAX_CENTRES = 1 << 18
#: Children of one node at most, and vectors that each of them is fitted on.
_CHILDREN, _FIT_ROWS = 256, 64
PROBES, KEEP, SUBSPACES = 4, 64, 16
#: Nodes that a query goes on from at each level of the tree, at least.
_BEAM = 8


def current_vectors(df: DataFrame, dim: int = DIM, key: str = "key", order: str = "put_no", vector: str = "data.float32") -> DataFrame:
    """key, v (float32 bytes of the unit vector). The log is reduced per key map-side."""
    log = df.select(F.col(key).alias("key"), F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**62))).alias("ord"), F.col(vector).alias("v")).filter("key IS NOT NULL")
    last = log.groupBy("key").agg(F.max_by("v", "ord").alias("v")).select("key", F.transform("v", lambda x: x.cast("double")).alias("v"))
    fit = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = last.filter(F.coalesce(fit, F.lit(False)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), dim)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"key": pdf["key"], "v": [r.tobytes() for r in x.astype(np.float32)]})

    return good.mapInPandas(pack, "key string, v binary")


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.float32).reshape(len(col), dim)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from random rows; an empty cluster keeps its centre. Works in slices of bounded size."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[0][:, 0]
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.cumsum(n) - n
        sums = np.add.reduceat(x[order], np.minimum(starts, len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the p nearest centres of each row, nearest first, and how near: half the square of x's length less half that of the distance."""
    out, value = np.empty((len(x), p), dtype=np.int32), np.empty((len(x), p), dtype=np.float32)
    half = (c * c).sum(axis=1) / 2
    step = max(1, 4_000_000 // max(1, len(c)))
    for s in range(0, len(x), step):
        score = x[s : s + step] @ c.T - half
        if p == 1:
            out[s : s + step, 0] = score.argmax(axis=1)
            value[s : s + step, 0] = score.max(axis=1)
        else:
            top = np.argpartition(-score, p - 1, axis=1)[:, :p]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
            out[s : s + step], value[s : s + step] = top, np.take_along_axis(score, top, 1)
    return out, value


class Tree:
    """Centroids as nodes; a node's children lie next to each other, and nodes without any are the leaves."""

    def __init__(self, dim: int) -> None:
        self.centres = np.zeros((1, dim), np.float32)
        self.first, self.number = np.zeros(1, np.int32), np.zeros(1, np.int32)

    def split(self, node: int, centres: np.ndarray) -> None:
        self.first[node], self.number[node] = len(self.centres), len(centres)
        self.centres = np.concatenate([self.centres, centres])
        self.first, self.number = (np.concatenate([a, np.zeros(len(centres), np.int32)]) for a in (self.first, self.number))

    def leaves(self, x: np.ndarray, p: int) -> np.ndarray:
        """The p nearest leaves of each row, nearest first, found going down from the nearest nodes of each level; -1 if fewer."""
        beam = max(_BEAM, p)
        rows, nodes, score = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
        while (inner := self.number[nodes] > 0).any():
            done = ~inner
            parts = [(rows[done], nodes[done], score[done])]
            order = np.flatnonzero(inner)
            order = order[np.argsort(nodes[order], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
                node = nodes[part[0]]
                children = self.centres[self.first[node] : self.first[node] + self.number[node]]
                near, value = nearest(x[rows[part]], children, min(beam, len(children)))
                parts.append((np.repeat(rows[part], near.shape[1]), (self.first[node] + near).ravel(), value.ravel()))
            rows, nodes, score = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((-score, rows))
            rows, nodes, score = rows[order], nodes[order], score[order]
            rank = _rank(rows)
            rows, nodes, score = rows[rank < beam], nodes[rank < beam], score[rank < beam]
        rank = _rank(rows)
        out = np.full((len(x), p), -1, np.int32)
        out[rows[rank < p], rank[rank < p]] = nodes[rank < p]
        return out


def _ranked(q: np.ndarray, centre: np.ndarray, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate similarity of each query (rows) to each code (columns), from one table of products per subspace."""
    m = len(words)
    score = np.repeat((q @ centre)[:, None], len(codes), axis=1)
    for j, part in enumerate(np.split(q, m, axis=1)):
        table = part @ words[j].T
        score += table[:, codes[:, j]]
    return score


def _rank(groups: np.ndarray) -> np.ndarray:
    """Place of each element within its run of equal ones."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])[: len(groups)]
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def _slices(pdf: pd.DataFrame, dim: int, rows: int = 2_000) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for s in range(0, len(pdf), rows):
        part = pdf.iloc[s : s + rows]
        yield part, _matrix(part["v"], dim)


def _picked(share: np.ndarray | float, ids: pd.Series) -> np.ndarray:
    """A share of the rows, by the hash that their ids are: the same rows in every run."""
    return (ids.to_numpy().astype(np.uint64) >> np.uint64(32)) < np.asarray(share) * 2.0**32


def _grown(uniq: DataFrame, tree: Tree, dim: int, probes: int, cell_rows: int, children: int, max_centres: int) -> tuple[Tree, dict[int, int], dict[int, int]]:
    """The tree with its large leaves split, and for each leaf the vectors stored and the queries from other leaves."""
    sc = uniq.sparkSession.sparkContext
    whole: dict[int, int] = {}  # the rows of a leaf's parent
    while True:
        shared = sc.broadcast(tree)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                near = np.concatenate([shared.value.leaves(x, probes) for _, x in _slices(pdf, dim)]) if len(pdf) else np.zeros((0, probes), np.int32)
                own, other = np.unique(near[:, 0], return_counts=True), np.unique(near[:, 1:][near[:, 1:] >= 0], return_counts=True)
                yield pd.DataFrame({"leaf": np.r_[own[0], other[0]], "own": np.r_[own[1], 0 * other[1]], "other": np.r_[0 * own[1], other[1]]})

        counts = uniq.select("v").mapInPandas(count, "leaf int, own bigint, other bigint").groupBy("leaf").agg(F.sum("own").alias("own"), F.sum("other").alias("other")).collect()
        stored, asked = {r.leaf: r.own for r in counts}, {r.leaf: r.other for r in counts}
        large = {leaf: n for leaf, n in stored.items() if n > 2 * cell_rows and 10 * n < 9 * whole.get(leaf, 2 * n)}
        wanted = {leaf: min(children, -(-n // cell_rows)) for leaf, n in large.items()}
        if not large or len(tree.centres) + sum(wanted.values()) > max_centres:
            return tree, stored, asked
        share = np.zeros(len(tree.centres))
        for leaf, k in wanted.items():
            share[leaf] = min(1.0, _FIT_ROWS * k / large[leaf])
        share = sc.broadcast(share)

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                leaf = np.concatenate([shared.value.leaves(x, 1)[:, 0] for _, x in _slices(pdf, dim)]) if len(pdf) else np.zeros(0, np.int32)
                take = _picked(share.value[leaf], pdf["id"])
                yield pd.DataFrame({"leaf": leaf[take], "v": pdf["v"][take]})

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            c = k_means(_matrix(pdf["v"].sort_values(), dim), wanted[key[0]], 8, 11)
            return pd.DataFrame({"leaf": key[0], "centre": [r.tobytes() for r in c]})

        fitted: dict[int, list[bytes]] = {}
        for r in uniq.mapInPandas(pick, "leaf int, v binary").groupBy("leaf").applyInPandas(fit, "leaf int, centre binary").collect():
            fitted.setdefault(r.leaf, []).append(bytes(r.centre))
        for leaf, centres in sorted(fitted.items()):
            tree.split(leaf, _matrix(pd.Series(sorted(centres)), dim))
            whole |= {int(tree.first[leaf]) + i: large[leaf] for i in range(len(centres))}


_FOUND = "id bigint, near array<bigint>, similarity array<float>"


def _nearest_distinct(uniq: DataFrame, n: int, k: int, dim: int, probes: int, keep: int, m: int, sample: int, cell_rows: int, children: int, max_centres: int) -> DataFrame:
    """id, near, similarity: of each of the n different vectors of ``uniq`` (id, v), the best k of each leaf searched."""
    sc = uniq.sparkSession.sparkContext
    cell_rows = max(cell_rows, -(-5 * n // (2 * max_centres)))
    share = min(1.0, sample / n)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[_picked(share, pdf["id"])]

    x = _matrix(uniq.mapInPandas(pick, "id bigint, v binary").toPandas().sort_values("id")["v"], dim)
    if not len(x):  # few vectors, and the hash picked none
        x = _matrix(uniq.toPandas().sort_values("id")["v"], dim)
    tree = Tree(dim)
    tree.split(0, k_means(x, max(1, min(children, -(-n // cell_rows), len(x) // 4)), 8, 7))
    tree, stored, asked = _grown(uniq, tree, dim, probes, cell_rows, children, max_centres)
    residual = x - tree.centres[np.concatenate([tree.leaves(x[s : s + 2_000], 1)[:, 0] for s in range(0, len(x), 2_000)])]
    words = np.stack([k_means(np.ascontiguousarray(part), min(256, len(x)), 6, 8 + j) for j, part in enumerate(np.split(residual, m, axis=1))])
    # Blocks of stored vectors and parts of queries for the leaves that need more than one.
    blocks = {leaf: -(-c // (16 * cell_rows)) for leaf, c in stored.items() if c > 16 * cell_rows}
    parts = {leaf: -(-c // (256 * cell_rows)) for leaf, c in asked.items() if c > 256 * cell_rows}
    shared = sc.broadcast((tree, words, blocks, parts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, words, blocks, parts = shared.value
        for pdf in batches:
            for rows, y in _slices(pdf, dim):
                near = tree.leaves(y, probes)
                code = np.stack([nearest(np.ascontiguousarray(r), words[j], 1)[0][:, 0] for j, r in enumerate(np.split(y - tree.centres[near[:, 0]], m, axis=1))], axis=1).astype(np.uint8)
                ids, v = rows["id"].to_numpy(), rows["v"].to_numpy()
                row, place = np.nonzero(near >= 0)
                out = {"leaf": near[row, place], "block": np.zeros(len(row), np.int32), "part": np.zeros(len(row), np.int32), "id": ids[row], "v": v[row]}
                out["code"] = [code[r].tobytes() if p == 0 else None for r, p in zip(row, place)]
                out = pd.DataFrame(out)
                split = out["leaf"].isin(blocks.keys() | parts.keys()).to_numpy()
                if split.any():
                    more = []
                    for leaf, i, vec, c in out.loc[split, ["leaf", "id", "v", "code"]].itertuples(index=False):
                        b, q = blocks.get(leaf, 1), parts.get(leaf, 1)
                        home, mine = i % b, (i >> 20) % q
                        if c is not None:
                            more += [(leaf, home, part, i, vec, c) for part in range(q)]
                        more += [(leaf, block, mine, i, vec, None) for block in range(b) if c is None or block != home]
                    out = pd.concat([out[~split], pd.DataFrame(more, columns=out.columns)])
                yield out

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, words, _, parts = shared.value
        leaf, _, part = key
        is_stored = pdf["code"].notna().to_numpy()
        queries = ~is_stored | ((pdf["id"].to_numpy() >> 20) % parts.get(leaf, 1) == part)
        names, asks = pdf["id"].to_numpy()[is_stored], pdf["id"].to_numpy()[queries]
        x = _matrix(pdf["v"], dim)
        v, q = x[is_stored], x[queries]
        none = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("id", "near", "similarity")})
        if not len(v) or not len(q):
            return none
        codes = np.frombuffer(b"".join(pdf["code"][is_stored]), dtype=np.uint8).reshape(len(v), len(words))
        out, some = [], min(keep, len(v))
        step = max(1, 2_000_000 // len(v))
        for s in range(0, len(q), step):
            ask = q[s : s + step]
            score = _ranked(ask, tree.centres[leaf], words, codes)
            floor = np.partition(score, len(v) - some, axis=1)[:, len(v) - some]
            qi, vi = np.nonzero(score >= floor[:, None] - 1e-6)
            if 4 * len(qi) > score.size:  # small leaf, or many equal codes
                exact = (ask.astype(np.float64) @ v.astype(np.float64).T)[qi, vi]
            else:
                exact = np.einsum("ij,ij->i", ask[qi].astype(np.float64), v[vi].astype(np.float64))
            other = asks[s + qi] != names[vi]
            qi, vi, exact = qi[other], vi[other], exact[other]
            order = np.lexsort((names[vi], -exact, qi))
            best = order[_rank(qi[order]) < k]
            starts = np.flatnonzero(np.r_[True, qi[best][1:] != qi[best][:-1]])[: len(best)]
            near, similarity = (np.split(a, starts[1:]) for a in (names[vi[best]], exact[best].astype(np.float32)))
            if len(best):
                out.append(pd.DataFrame({"id": asks[s + qi[best][starts]], "near": near, "similarity": similarity}))
        return pd.concat(out) if out else none

    placed = uniq.mapInPandas(place, "leaf int, block int, part int, id bigint, v binary, code binary")
    return placed.groupBy("leaf", "block", "part").applyInPandas(search, _FOUND)


def _distinct(members: DataFrame) -> tuple[DataFrame, int]:
    """id, v of every different vector, and the seed of the hash that ids are: the first that gives no two the same."""
    seed = 0
    while True:
        hashed = members.select(F.xxhash64(F.lit(seed), "v").alias("id"), "v", F.xxhash64("v", F.lit(seed)).alias("check"))
        uniq = materialise(hashed.groupBy("id").agg(F.first("v").alias("v"), (F.min("check") != F.max("check")).alias("collides")), "vectors-distinct")
        if not uniq.filter("collides").limit(1).count():
            return uniq.select("id", "v"), seed
        seed += 1


def similar_vectors(
    vectors: DataFrame,
    k: int = K,
    dim: int = DIM,
    probes: int = PROBES,
    keep: int = KEEP,
    m: int = SUBSPACES,
    sample: int = SAMPLE_ROWS,
    cell_rows: int = CELL_ROWS,
    children: int = _CHILDREN,
    max_centres: int = MAX_CENTRES,
) -> DataFrame:
    """key, other, rank, similarity: the k most similar other keys of every key of ``vectors`` (key, v).

    Equal vectors are searched once. Of the keys that share one, only the k + 1 smallest can be anyone's neighbours, as
    ties go by key; those stand for the rest on the stored side, while every key gets its own row of results.
    """
    members = materialise(vectors.select("key", "v"), "vectors")
    uniq, seed = _distinct(members)
    keys = members.select("key", F.xxhash64(F.lit(seed), "v").alias("id"))
    first = keys.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("key"))).filter(F.col("r") <= k + 1)
    names = materialise(first.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("names")), "vector-names")
    n = uniq.count()
    if n > 1:
        found = _nearest_distinct(uniq, n, k, dim, probes, keep, m, sample, cell_rows, children, max_centres)
    else:
        found = vectors.sparkSession.createDataFrame([], _FOUND)
    both = F.zip_with("similarity", "near", lambda s, o: F.struct((-s).alias("d"), o.alias("near")))
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(both))), 1, k).alias("best")).select("id", F.explode("best").alias("x"))
    others = best.select("id", "x.d", F.col("x.near").alias("near")).join(names.withColumnsRenamed({"id": "near", "names": "others"}), "near").select("id", "d", "others")
    own = names.filter(F.size("names") > 1).select("id", F.lit(-1.0).cast("float").alias("d"), F.col("names").alias("others"))
    named = F.transform("others", lambda o: F.struct("d", o.alias("other")))
    ranked = own.unionByName(others).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(named))).alias("near"))
    pick = F.slice(F.filter("near", lambda x: x["other"] != F.col("key")), 1, k)
    rows = keys.join(ranked, "id").select("key", F.posexplode(pick).alias("pos", "x"))
    return rows.select("key", F.col("x.other").alias("other"), (F.col("pos") + 1).alias("rank"), (-F.col("x.d")).cast("double").alias("similarity"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """key_a < key_b of which at least one is among the other's nearest."""
    return neighbours.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()
