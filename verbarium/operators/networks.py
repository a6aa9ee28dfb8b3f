"""Networks of weighted directed edges: degrees, ranks, components, paths, communities.

An edge list is a DataFrame (src, dst, weight). Degrees, PageRank, components and modularity are DataFrame plans;
path and community kernels run on graphs that an analysis has reduced (top terms, thresholds), in numpy and heapq.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.corpus import cut, round6, table
from verbarium.operators.cooccurrence import SCORED, doc_colloc, scored_pairs

DAMPING = 0.85


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """In and out degree, plain and weighted: one pass over both ends of every edge."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("wo"), F.lit(0.0).alias("wi")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("wo"), F.col("weight").alias("wi")))))
    return ends.groupBy("id").agg(F.sum("o").alias("out"), F.sum("i").alias("in"), round6(F.sum("wo")).alias("w_out"), round6(F.sum("wi")).alias("w_in"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = DAMPING, tolerance: float = 0.0) -> DataFrame:
    """Weighted PageRank, mass of dangling nodes spread uniformly; stops at an L1 change under tolerance.

    Transition weights are partitioned by source once; each round is a join on it and one aggregation, whose result is
    written to the checkpoint folder, so that a round's plan is as long as the first one's.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("t")).where("t > 0")
    steps = edges.join(total, "src").groupBy("src", "dst").agg((F.sum("weight") / F.first("t")).alias("p")).repartition("src").persist()
    ids = nodes(edges).persist()
    n = ids.count()
    ranks = ids.withColumn("r", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations if n else 0):
        moved = cut(steps.join(ranks, steps["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("m")))
        lost = 1 - (moved.agg(F.sum("m")).first()[0] or 0.0)
        before = ranks
        ranks = ids.join(moved, "id", "left").select("id", ((1 - damping) / n + damping * (F.coalesce("m", F.lit(0.0)) + lost / n)).alias("r"))
        if tolerance > 0 and ranks.join(before.select("id", F.col("r").alias("q")), "id").agg(F.sum(F.abs(F.col("r") - F.col("q")))).first()[0] < tolerance:
            break
    return ranks.select("id", round6("r").alias("rank"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id that is connected, directions ignored. Minimum propagation with pointer jumping, each round
    written to the checkpoint folder."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().persist()
    labels = cut(nodes(edges).withColumn("comp", F.col("id")))
    while True:
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["id"] == near["src"], "left").select("id", F.least("comp", F.coalesce("m", "comp")).alias("c"))
        jump = cut(step.join(step.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c").select("id", "cc").withColumnRenamed("cc", "comp"))
        if jump.join(labels.select("id", F.col("comp").alias("old")), "id").where("comp <> old").isEmpty():
            return jump
        labels = jump


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Modularity of an undirected reading: each edge's weight counts half in either direction."""
    a, b = communities.select(F.col("id").alias("src"), F.col("comp").alias("ca")), communities.select(F.col("id").alias("dst"), F.col("comp").alias("cb"))
    x = edges.join(a, "src").join(b, "dst")
    inside = x.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("m"))
    part = x.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), F.col("weight")), F.struct(F.col("cb").alias("c"), F.col("weight"))))).groupBy("c").agg(F.sum("weight").alias("k"))
    return part.agg(F.sum(F.col("k") * F.col("k")).alias("s")).crossJoin(inside).select(round6(F.col("i") / F.col("m") - F.col("s") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


class Graph:
    """A reduced graph on the driver, nodes in order."""

    def __init__(self, edges: list[tuple]):
        self.names = sorted({v for e in edges for v in e[:2]})
        at = {v: i for i, v in enumerate(self.names)}
        self.n = len(self.names)
        self.out: list[dict[int, float]] = [defaultdict(float) for _ in range(self.n)]
        self.near: list[dict[int, float]] = [{} for _ in range(self.n)]
        for a, b, w in edges:
            i, j = at[a], at[b]
            self.out[i][j] += w
            if w > 0 and i != j:  # of parallel edges the nearest counts
                self.near[i][j] = min(self.near[i].get(j, math.inf), 1 / w)

    def paths(self, source: int, weighted: bool) -> tuple[list[int], list[float], list[float], list[list[int]]]:
        """Nodes by distance, distances, numbers of shortest paths, predecessors. Distance is 1 / weight, or 1."""
        dist, count, before, order, done = [math.inf] * self.n, [0.0] * self.n, [[] for _ in range(self.n)], [], set()
        dist[source], count[source], heap = 0.0, 1.0, [(0.0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, length in self.near[v].items():
                new = d + (length if weighted else 1.0)
                if new < dist[u] - 1e-12:
                    dist[u], count[u], before[u] = new, count[v], [v]
                    heapq.heappush(heap, (new, u))
                elif abs(new - dist[u]) <= 1e-12 and u not in done:
                    count[u] += count[v]
                    before[u].append(v)
        return order, dist, count, before

    def centrality(self, weighted: bool) -> tuple[list[float], list[float]]:
        """Betweenness (dependency accumulation) and harmonic closeness."""
        between, harmonic = [0.0] * self.n, [0.0] * self.n
        for s in range(self.n):
            order, dist, count, before = self.paths(s, weighted)
            harmonic[s] = sum(1 / dist[v] for v in order if v != s)
            owed = [0.0] * self.n
            for v in reversed(order):
                for u in before[v]:
                    owed[u] += count[u] / count[v] * (1 + owed[v])
                if v != s:
                    between[v] += owed[v]
        return between, harmonic

    def strong(self) -> list[int]:
        """Strongly connected component of each node, by two depth-first passes."""
        seen, order = [False] * self.n, []
        for s in range(self.n):
            stack = [(s, iter(self.out[s]))] if not seen[s] else []
            seen[s] = True
            while stack:
                v, rest = stack[-1]
                nxt = next((u for u in rest if not seen[u]), None)
                if nxt is None:
                    order.append(v)
                    stack.pop()
                else:
                    seen[nxt] = True
                    stack.append((nxt, iter(self.out[nxt])))
        back = [[] for _ in range(self.n)]
        for v in range(self.n):
            for u in self.out[v]:
                back[u].append(v)
        comp = [-1] * self.n
        for s in reversed(order):
            pool = [s] if comp[s] < 0 else []
            while pool:
                v = pool.pop()
                if comp[v] < 0:
                    comp[v] = s
                    pool += [u for u in back[v] if comp[u] < 0]
        least: dict[int, int] = {}
        for v in range(self.n):
            least.setdefault(comp[v], v)
        return [least[c] for c in comp]

    def eigenvector(self, tolerance: float = 1e-13, most: int = 10_000) -> np.ndarray:
        """Power iteration on A + I over incoming edges, largest value 1."""
        x = np.ones(self.n)
        for _ in range(most):
            y = x.copy()
            for v in range(self.n):
                for u, w in self.out[v].items():
                    y[u] += w * x[v]
            y /= y.max() or 1
            if np.abs(y - x).max() < tolerance:
                break
            x = y
        return y

    def louvain(self, gain: float = 1e-12, passes: int = 1000) -> list[int]:
        """Communities by modularity, nodes in order, levels until nothing moves."""
        w = [defaultdict(float) for _ in range(self.n)]
        for v in range(self.n):
            for u, x in self.out[v].items():
                w[v][u] += x / 2
                w[u][v] += x / 2
        member = list(range(self.n))
        while True:
            n = len(w)
            k = [sum(x.values()) for x in w]
            m2, comm, total = sum(k), list(range(n)), list(k)
            moved_any = False
            for _ in range(passes):
                moved = False
                for v in range(n):
                    links: dict[int, float] = defaultdict(float)
                    for u, x in w[v].items():
                        if u != v:
                            links[comm[u]] += x
                    own = comm[v]
                    total[own] -= k[v]
                    best, most = own, links.get(own, 0.0) - total[own] * k[v] / m2
                    for c in sorted(links):
                        value = links[c] - total[c] * k[v] / m2
                        if value > most + gain:
                            best, most = c, value
                    total[best] += k[v]
                    if best != own:
                        comm[v], moved, moved_any = best, True, True
                if not moved:
                    break
            if not moved_any:
                break
            names = {c: i for i, c in enumerate(dict.fromkeys(comm))}
            member = [names[comm[c]] for c in member]
            nxt = [defaultdict(float) for _ in names]
            for v in range(n):
                for u, x in w[v].items():
                    nxt[names[comm[v]]][names[comm[u]]] += x
            w = nxt
        first: dict[int, int] = {}
        return [first.setdefault(c, len(first)) for c in member]


def measures(spark, edges: DataFrame) -> DataFrame:
    """All node measures of a reduced graph."""
    g = Graph([(r.src, r.dst, float(r.weight)) for r in edges.collect()])
    if not g.n:
        return spark.createDataFrame([], "id string, betweenness double, harmonic double, w_betweenness double, w_harmonic double, eigenvector double, strong int, community int")
    (b, h), (wb, wh), e, s, c = g.centrality(False), g.centrality(True), g.eigenvector(), g.strong(), g.louvain()
    return spark.createDataFrame([(str(g.names[i]), b[i], h[i], wb[i], wh[i], float(e[i]), s[i], c[i]) for i in range(g.n)], "id string, betweenness double, harmonic double, w_betweenness double, w_harmonic double, eigenvector double, strong int, community int")


def user_events(spark, sf: str) -> DataFrame:
    """A driver-table graph: users to event types, weight the number of events, and nation to region keys."""
    e = table(spark, sf, "events")
    return e.groupBy(F.concat(F.lit("u"), F.col("user_id") % 200).alias("src"), F.concat(F.lit("t"), F.col("event_type")).alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def term_graph(spark, sf: str) -> DataFrame:
    """Document collocations of the top terms that are commoner than chance, both directions."""
    x = doc_colloc(table(spark, sf, "documents")).where("pmi > 0").select(F.col("x").alias("src"), F.col("y").alias("dst"), F.col("joint").cast("double").alias("weight"))
    return x.union(x.select("dst", "src", "weight"))


def window_graph(spark, sf: str, least_log_dice: float = 6.0) -> DataFrame:
    """Edges (src, dst, weight) of all window pairs that are that strong."""
    x = scored_pairs(table(spark, sf, "documents")).where(F.col("logdice") >= least_log_dice)
    return x.select(F.col("node").alias("src"), F.col("collocate").alias("dst"), F.col("joint").cast("double").alias("weight"))


def _m(*names: str):
    return lambda spark, sf: measures(spark, term_graph(spark, sf)).select("id", *(round6(n).alias(n) if n not in ("strong", "community") else F.col(n) for n in names))


def _modularity(spark, sf: str) -> DataFrame:
    e = user_events(spark, sf)
    return modularity(e, nodes(e).withColumn("comp", F.when(F.col("id").isin("tclick", "tview") | (F.col("id").startswith("u") & (F.substring("id", -1, 1) < "5")), 0).otherwise(1)))


QUERIES = {
    "degree": lambda s, sf: degree(user_events(s, sf)), "pagerank": lambda s, sf: pagerank(user_events(s, sf)), "weak_cc": lambda s, sf: weak_components(user_events(s, sf)),
    "modularity": _modularity, "betweenness": _m("betweenness"), "harmonic": _m("harmonic"), "w_betweenness": _m("w_betweenness"), "w_harmonic": _m("w_harmonic"), "eigenvector": _m("eigenvector"),
    "strong_cc": _m("strong"), "louvain": _m("community"), "doc_network": lambda s, sf: measures(s, term_graph(s, sf)), "win_network": window_graph, "win_network_nodes": lambda s, sf: degree(window_graph(s, sf)),
}
_E = "WITH RECURSIVE e AS (SELECT 'u' || (user_id % 200) AS src, 't' || event_type AS dst, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY ALL), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
ORACLES = {
    "degree": _E + """, d AS (SELECT src AS id, 1 AS o, 0 AS i, weight AS wo, 0.0::DOUBLE AS wi FROM e UNION ALL SELECT dst, 0, 1, 0.0, weight FROM e)
      SELECT id, CAST(sum(o) AS BIGINT) AS out, CAST(sum(i) AS BIGINT) AS "in", round(sum(wo), 6) AS w_out, round(sum(wi), 6) AS w_in FROM d GROUP BY id""",
    "win_network": SCORED + " SELECT node AS src, collocate AS dst, CAST(joint AS DOUBLE) AS weight FROM s WHERE logdice >= 6",
    "win_network_nodes": SCORED + """, e AS (SELECT node AS src, collocate AS dst, CAST(joint AS DOUBLE) AS weight FROM s WHERE logdice >= 6),
      d AS (SELECT src AS id, 1 AS o, 0 AS i, weight AS wo, 0.0::DOUBLE AS wi FROM e UNION ALL SELECT dst, 0, 1, 0.0, weight FROM e)
      SELECT id, CAST(sum(o) AS BIGINT) AS out, CAST(sum(i) AS BIGINT) AS "in", round(sum(wo), 6) AS w_out, round(sum(wi), 6) AS w_in FROM d GROUP BY id""",
    "weak_cc": _E + """, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r(id, m) AS (SELECT id, id FROM v UNION SELECT b.y, r.m FROM r JOIN b ON b.x = r.id WHERE r.m < b.y)
      SELECT id, min(m) AS comp FROM r GROUP BY id""",
    "modularity": _E + """, c AS (SELECT id, CASE WHEN id IN ('tclick', 'tview') OR (id LIKE 'u%' AND right(id, 1) < '5') THEN 0 ELSE 1 END AS comp FROM v),
      x AS (SELECT weight, a.comp AS ca, b.comp AS cb FROM e JOIN c a ON src = a.id JOIN c b ON dst = b.id), k AS (SELECT c, sum(weight) AS k FROM (SELECT ca AS c, weight FROM x UNION ALL SELECT cb, weight FROM x) GROUP BY c)
      SELECT round((SELECT sum(weight) FILTER (ca = cb) FROM x) / (SELECT sum(weight) FROM x) - sum(k * k) / (4 * (SELECT sum(weight) FROM x) ** 2), 6) AS modularity FROM k""",
}


def _pagerank_sql(iterations: int = 10) -> str:
    out = _E + ", t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM e), n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, 1.0 / n AS r FROM v, n)"
    for k in range(iterations):
        out += f", m{k} AS (SELECT dst AS id, sum(r * p) AS m FROM t JOIN r{k} ON src = id GROUP BY dst), r{k + 1} AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce(m, 0) + (1 - (SELECT coalesce(sum(m), 0) FROM m{k})) / n) AS r FROM v LEFT JOIN m{k} USING (id), n)"
    return out + f" SELECT id, round(r, 6) AS rank FROM r{iterations}"


ORACLES["pagerank"] = _pagerank_sql()
