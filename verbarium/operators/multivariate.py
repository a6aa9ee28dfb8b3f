"""Multivariate methods on the matrix of documents by top terms: Spark counts and selects, numpy decomposes.

SVD, principal components, LSA and correspondence come from the term x term cross-products of all documents, which one
distributed aggregation makes; k-means and coordinates are worked out where the documents lie. NMF and hierarchical
clustering run on documents summed up by a grouping column. The numpy kernels take small dense matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.corpus import round6, table, terms
from verbarium.operators.ranking import top_terms

TOP, SEED = 50, 20260918
#: Points in a block of pairwise distances.
BLOCK = 1024


def matrix(docs: DataFrame, by: str = "source", k: int = TOP) -> tuple[list, list[str], np.ndarray]:
    """Row names, terms and counts of the groups by the k top terms."""
    top = top_terms(docs, k).select("term")
    rows = docs.select(F.col(by).alias("g"), F.explode(terms(F.col("text"))).alias("term")).join(F.broadcast(top), "term").groupBy("g", "term").agg(F.count(F.lit(1)).alias("n")).collect()
    names, columns = sorted({r.g for r in rows}, key=str), sorted({r.term for r in rows})
    x = np.zeros((len(names), len(columns)))
    for r in rows:
        x[names.index(r.g), columns.index(r.term)] = r.n
    return names, columns, x


def signed_svd(x: np.ndarray, rank: int | None = None):
    """SVD with signs fixed: of each right vector the first value beyond 1e-12 is positive."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    for i, v in enumerate(vt):
        big = np.flatnonzero(np.abs(v) > 1e-12)
        if len(big) and v[big[0]] < 0:
            vt[i], u[:, i] = -v, -u[:, i]
    return (u, s, vt) if rank is None else (u[:, :rank], s[:rank], vt[:rank])


def truncated_svd(x: np.ndarray, rank: int, oversampling: int = 15, seed: int = SEED, iterations: int = 6):
    """Randomised block subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(rank + oversampling, min(x.shape))))
    for _ in range(iterations):
        q, _ = np.linalg.qr(x.T @ np.linalg.qr(x @ q)[0])
    u, s, vt = signed_svd(x @ q)
    return u[:, :rank], s[:rank], (vt @ q.T)[:rank]


def correspondence(x: np.ndarray) -> dict:
    """Masses, inertias and principal coordinates of rows and columns."""
    x = x[x.sum(1) > 0][:, x.sum(0) > 0]
    p = x / x.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, vt = signed_svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)))
    keep = s > 1e-12
    return {"inertia": s[keep] ** 2, "rows": u[:, keep] * s[keep] / np.sqrt(r)[:, None], "columns": vt[keep].T * s[keep] / np.sqrt(c)[:, None], "masses": r}


def pca(x: np.ndarray, scaled: bool = False) -> dict:
    """Variances, scores and loadings; constant columns are left out of a scaled analysis."""
    z = x - x.mean(0)
    if scaled:
        sd = z.std(0, ddof=1)
        z = z[:, sd > 0] / sd[sd > 0]
    u, s, vt = signed_svd(z)
    return {"variance": s**2 / (len(x) - 1), "scores": u * s, "loadings": vt}


def lsa(x: np.ndarray, rank: int = 3) -> dict:
    """SVD of n ln(D / df), with the norm of what is left over."""
    w = x * np.log(len(x) / np.maximum((x > 0).sum(0), 1))
    u, s, vt = signed_svd(w, rank)
    return {"values": s, "documents": u * s, "terms": vt, "residual": float(np.linalg.norm(w - u * s @ vt))}


def nmf(x: np.ndarray, rank: int = 3, seed: int = SEED, restarts: int = 3, iterations: int = 2000, tolerance: float = 1e-10) -> dict:
    """Multiplicative updates, best of several starts."""
    best = None
    for r in range(restarts):
        rng = np.random.default_rng(seed + r)
        w, h, last = rng.random((len(x), rank)) + 1e-3, rng.random((rank, x.shape[1])) + 1e-3, np.inf
        for _ in range(iterations):
            h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-300)
            w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-300)
            error = np.linalg.norm(x - w @ h)
            if last - error < tolerance * max(last, 1):
                break
            last = error
        if best is None or error < best["error"]:
            best = {"w": w, "h": h, "error": float(error)}
    return best


def hierarchical(points: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size); ties go to the smallest ids. Ward heights are sqrt(2 delta)."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    if linkage == "ward":
        d = d * d
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), len(d))
        i, j = min(i, j), max(i, j)
        h, a, b = d[i, j], size[i], size[j]
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(np.sqrt(h) if linkage == "ward" else h), a + b))
        if linkage == "ward":
            c = np.array(size)
            new = ((a + c) * d[i] + (b + c) * d[j] - c * h) / (a + b + c)
        else:
            new = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (a * d[i] + b * d[j]) / (a + b)}[linkage]
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        ids[i], size[i] = n + step, a + b
        del ids[j], size[j]
    return out


def cut(merges: list, n: int, clusters: int) -> list[int]:
    """Cluster of each point, numbered by first appearance."""
    up = list(range(n + len(merges)))
    for k, (a, b, _, _) in enumerate(merges[: n - clusters]):
        up[a] = up[b] = n + k

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen)) for i in range(n)]


def kmeans(x: np.ndarray, k: int, seed: int = SEED, restarts: int = 5, iterations: int = 300) -> tuple[list[int], float]:
    """k-means++ starts, Lloyd's rounds, clusters numbered by first appearance."""
    best = (None, np.inf)
    for r in range(restarts):
        rng = np.random.default_rng(seed + r)
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]])
        for _ in range(iterations):
            at = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[at == c].mean(0) if (at == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres, atol=0, rtol=0):
                break
            centres = new
        inertia = float(((x - centres[at]) ** 2).sum())
        if inertia < best[1]:
            seen: dict[int, int] = {}
            best = ([seen.setdefault(int(c), len(seen)) for c in at], inertia)
    return best


def silhouette(points: DataFrame) -> DataFrame:
    """(id, cluster, width) of points (id, cluster, v): Euclidean, 0 in a cluster of one.

    Every point meets every other, as the definition asks: points are packed into blocks of BLOCK rows, every block
    is dealt to every block, and numpy sums distances by cluster, so only (point, cluster) sums leave a task.
    """
    import pyarrow as pa

    a = points.select("id", "cluster", F.col("v").cast("array<double>").alias("v"))
    n = max(1, -(-a.count() // BLOCK))
    packed = a.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("b").agg(F.collect_list(F.struct("id", "cluster", "v")).alias("rows"))
    left = packed.select(F.col("b").alias("lb"), F.col("rows").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    pairs = left.join(packed, "b").select("l", "rows")

    def run(batches):
        for batch in batches:
            for l, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = (np.array([p["v"] for p in z]) for z in (l, r))
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
                other = np.array([p["id"] for p in l])[:, None] != np.array([p["id"] for p in r])[None]
                clusters = sorted({p["cluster"] for p in r})
                of = np.array([p["cluster"] for p in r])
                out = [(p["id"], p["cluster"], c, float((d[i] * other[i])[of == c].sum()), int(other[i][of == c].sum())) for i, p in enumerate(l) for c in clusters]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["id", "cluster", "c2", "s", "n"])

    sums = pairs.mapInArrow(run, "id long, cluster int, c2 int, s double, n long")
    means = sums.groupBy("id", "cluster", "c2").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    s = means.groupBy("id", "cluster").agg(F.max(F.when(F.col("c2") == F.col("cluster"), F.col("m"))).alias("a"), F.min(F.when(F.col("c2") != F.col("cluster"), F.col("m"))).alias("b"))
    return s.select("id", "cluster", round6(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))).alias("width"))


def cross_products(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products of all vectors (and their sum): one aggregation of dim * dim numbers, for PCA at scale."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(-1, dim)
            x = np.column_stack([np.ones(len(x)), x])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "x"])

    rows = vectors.select("embedding").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((dim + 1) ** 2)
    for r in rows:
        out[r.i] = r.x
    return out.reshape(dim + 1, dim + 1)


def embedding_pca(vectors: DataFrame, dim: int = 64, k: int = 10) -> list[float]:
    m = cross_products(vectors, dim)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return np.sort(np.linalg.eigvalsh((m[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)))[::-1][:k].tolist()


def document_matrix(docs: DataFrame, form: str = "count", k: int = TOP) -> tuple[list, DataFrame]:
    """The k top terms (term, df, f) by name, and (doc_id, v) of all documents with the terms' counts as they are, over the
    document's length (relative; zeros without tokens), over their sum (profile) or over its root (root).

    For profile and root, documents without any of the terms are left out, as correspondence analysis does.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    top = sorted(top_terms(docs, k).collect(), key=lambda r: r.term)
    names = [r.term for r in top]
    words = docs.select("doc_id", terms(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size("t").cast("long").alias("len"), F.filter("t", lambda x: x.isin(names)).alias("t"))

    def run(batches):
        for batch in batches:
            lists, n = batch.column(2), len(batch)
            row, col = pc.list_parent_indices(lists).to_numpy(), pc.index_in(lists.flatten(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
            x = np.bincount(row.astype(np.int64) * len(names) + col, minlength=n * len(names)).reshape(n, len(names)).astype(float)
            size, total, ids = batch.column(1).to_numpy()[:, None], x.sum(1, keepdims=True), batch.column(0)
            x = x / {"count": 1, "relative": np.maximum(size, 1), "profile": np.maximum(total, 1), "root": np.sqrt(np.maximum(total, 1))}[form]
            if form in ("profile", "root"):
                keep = total[:, 0] > 0
                x, ids = x[keep], ids.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "v"])

    return top, words.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, v array<double>")


def _moments(rows: DataFrame, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, sums and cross-products of the rows."""
    m = cross_products(rows.select(F.col("v").alias("embedding")), dim)
    return m[0, 0], m[0, 1:], m[1:, 1:]


def _eigen(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, what is only rounding set to 0, and vectors as rows, signed as in signed_svd."""
    e, v = np.linalg.eigh(m)
    e, v = e[::-1], v.T[::-1].copy()
    e = np.where(e > len(m) * np.finfo(float).eps * max(e[0], 0), e, 0.0)
    for i, x in enumerate(v):
        big = np.flatnonzero(np.abs(x) > 1e-12)
        if len(big) and x[big[0]] < 0:
            v[i] = -x
    return e, v


def document_svd(docs: DataFrame, k: int = TOP) -> np.ndarray:
    """Singular values of the counts of all documents."""
    top, rows = document_matrix(docs, "count", k)
    n, _, m = _moments(rows, len(top))
    return np.sqrt(_eigen(m)[0])[: int(n)]


def document_pca(docs: DataFrame, k: int = TOP) -> np.ndarray:
    """Variances of the relative frequencies in all documents."""
    top, rows = document_matrix(docs, "relative", k)
    n, s, m = _moments(rows, len(top))
    return _eigen((m - np.outer(s, s) / n) / (n - 1))[0]


def _project(rows: DataFrame, scale: np.ndarray, shift: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(doc_id, at): coordinates (v * scale - shift) on the axes."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = (np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1) * scale - shift) @ axes.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(axes), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "at"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, at array<double>")


def document_lsa(docs: DataFrame, rank: int = 3, k: int = TOP) -> tuple[np.ndarray, DataFrame]:
    """Singular values of n ln(D / df) over all documents, and (doc_id, at) with their coordinates u * s."""
    top, rows = document_matrix(docs, "count", k)
    n, _, m = _moments(rows, len(top))
    idf = np.log(n / np.array([r.df for r in top]))
    e, v = _eigen(m * np.outer(idf, idf))
    return np.sqrt(e)[:rank], _project(rows, idf, np.zeros(len(top)), v[:rank])


def document_correspondence(docs: DataFrame, axes: int = 2, k: int = TOP) -> tuple[np.ndarray, DataFrame]:
    """Inertias, and (doc_id, at) with principal coordinates, of all documents that have a top term."""
    top, rows = document_matrix(docs, "root", k)
    _, _, m = _moments(rows, len(top))
    f = np.array([r.f for r in top], float)
    c = f / f.sum()
    e, v = _eigen((m / f.sum() - np.outer(c, c)) / np.sqrt(np.outer(c, c)))
    return e[np.sqrt(e) > 1e-7], _project(document_matrix(docs, "profile", k)[1], 1 / np.sqrt(c), np.sqrt(c), v[:axes])


def document_kmeans(rows: DataFrame, dim: int, k: int, seed: int = SEED, restarts: int = 5, iterations: int = 300) -> DataFrame:
    """(doc_id, cluster) of all rows (doc_id, v): k-means++ starts and Lloyd's rounds of all restarts in one pass each,
    clusters numbered by their smallest doc_id.

    A start takes the row with the least -ln(u) / d2, u being a hash of its id: a draw with weights d2 in one pass.
    """
    import pyarrow as pa

    rows = rows.persist()
    kind = rows.schema["doc_id"].dataType.simpleString()
    points = lambda column: np.asarray(column.flatten(), float).reshape(-1, dim)
    far = lambda x, c: np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
    centres: list = [np.zeros((0, dim))] * restarts

    for step in range(k):

        def race(batches, at=centres):
            for batch in batches:
                if len(batch):
                    x, h = points(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(-1, restarts)
                    u = ((h.astype(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                    for r, c in enumerate(at):
                        d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1) if len(c) else np.ones(len(x))
                        key = np.where(d > 0, -np.log(u[:, r]) / np.where(d > 0, d, 1), np.inf)
                        i = int(key.argmin())
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([key[i]]), pa.array([x[i].tolist()])], names=["r", "key", "v"])

        drawn = rows.select("v", F.array(*(F.xxhash64("doc_id", F.lit(seed + r), F.lit(step)) for r in range(restarts)))).mapInArrow(race, "r int, key double, v array<double>")
        best = {x.r: x.v for x in drawn.groupBy("r").agg(F.min_by("v", F.struct("key", "v")).alias("v")).collect()}
        if not best:
            return rows.select("doc_id", F.lit(0).alias("cluster"))
        centres = [np.vstack([c, best[r]]) for r, c in enumerate(centres)]

    at, inertia = np.array(centres), np.full(restarts, np.inf)
    for _ in range(iterations):

        def lloyd(batches, at=at):
            total = np.zeros((restarts, k, dim + 2))
            for batch in batches:
                x = points(batch.column(0))
                for r in range(restarts):
                    d = far(x, at[r])
                    mine = np.eye(k)[d.argmin(1)]
                    total[r] += mine.T @ np.column_stack([x, np.ones(len(x)), d.min(1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "x"])

        total = np.zeros(restarts * k * (dim + 2))
        for x in rows.select("v").mapInArrow(lloyd, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            total[x.i] = x.x
        total = total.reshape(restarts, k, dim + 2)
        inertia, n = total[..., -1].sum(1), total[..., -2:-1]
        new = np.where(n > 0, total[..., :dim] / np.maximum(n, 1), at)
        if np.allclose(new, at, atol=1e-12, rtol=0):
            break
        at = new
    chosen = at[int(inertia.argmin())]

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far(points(batch.column(1)), chosen).argmin(1), pa.int32())], names=["doc_id", "c"])

    out = rows.select("doc_id", "v").mapInArrow(assign, f"doc_id {kind}, c int")
    order = [x.c for x in out.groupBy("c").agg(F.min("doc_id").alias("first")).orderBy("first").collect()]
    return out.select("doc_id", (F.array_position(F.array(*map(F.lit, order)), F.col("c")) - 1).cast("int").alias("cluster"))


def clusters(docs: DataFrame, clusters: int = 4, k: int = TOP) -> DataFrame:
    top, rows = document_matrix(docs, "relative", k)
    return document_kmeans(rows, len(top), clusters)


def _values(f, name: str = "value"):
    def run(spark, sf):
        _, _, x = matrix(table(spark, sf, "documents"))
        return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(f(x))], f"i int, {name} double")

    return run


def _relative(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(1, keepdims=True), 1)


def _points(spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("v"))


def _numbers(f):
    return lambda spark, sf: spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(f(table(spark, sf, "documents")))], "i int, value double")


def _coordinates(f, *names: str, key: str = "doc_id"):
    return lambda spark, sf: f(table(spark, sf, "documents"))[1].select(F.col("doc_id").cast("string").alias(key) if key != "doc_id" else F.col(key), *(round6(F.col("at")[i]).alias(c) for i, c in enumerate(names)))


QUERIES = {
    "svd_jacobi": _numbers(document_svd), "svd_truncated": _numbers(lambda d: document_svd(d)[:5]), "ca": _numbers(lambda d: document_correspondence(d)[0]), "pca": _numbers(lambda d: document_pca(d)[:10]),
    "lsa": _numbers(lambda d: document_lsa(d)[0]), "lsa_documents": _coordinates(document_lsa, "d1", "d2", "d3"), "nmf": _values(lambda x: [nmf(x)["error"]]), "hac": _values(lambda x: [m[2] for m in hierarchical(_relative(x))]), "hac_ward": _values(lambda x: [m[2] for m in hierarchical(_relative(x), "ward")]),
    "hac_cut": _values(lambda x: cut(hierarchical(_relative(x)), len(x), 4)), "kmeans": lambda s, sf: clusters(table(s, sf, "documents")), "silhouette": lambda s, sf: silhouette(_points(s, sf)),
    "pca_embeddings": lambda s, sf: s.createDataFrame([(i, round(v, 6)) for i, v in enumerate(embedding_pca(table(s, sf, "embeddings")))], "i int, value double"),
    "multivariate": _coordinates(document_correspondence, "x", "y", key="row"),
}
ORACLES = {
    "silhouette": """WITH p AS (SELECT vec_id AS id, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings),
      m AS (SELECT a.id, a.cluster, b.cluster AS c2, avg(list_distance(a.v, b.v)) AS m FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
      s AS (SELECT id, cluster, max(CASE WHEN c2 = cluster THEN m END) AS a, min(CASE WHEN c2 <> cluster THEN m END) AS b FROM m GROUP BY ALL)
      SELECT id, cluster, round(coalesce((b - a) / greatest(a, b), 0), 6) AS width FROM s""",
}
