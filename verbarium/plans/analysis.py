"""Planner, artifact graph and store, support policies, findings, investigations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.corpus import table
from verbarium.operators import cooccurrence
from verbarium.sources.text import canonical_json

#: Capabilities with their intents, least number of sources, whether they compare groups, and cost
#: beyond bytes and 64 per source as (fixed, per source).
CAPABILITIES = {
    "corpus.profile": ({"characterize.group", "discover.contents", "review.completely", "understand.collection"}, 1, False, (0, 0)),
    "keyness": ({"characterize.group", "compare.objects", "review.completely"}, 2, True, (0, 0)),
    "association": ({"explore.relationships", "review.completely"}, 2, False, (0, 256)),
    "window.collocation": ({"discover.contents", "explore.relationships", "review.completely"}, 1, False, (512, 0)),
    "window.network": ({"explore.relationships", "identify.themes", "review.completely"}, 1, False, (1024, 0)),
    "correspondence": ({"explore.relationships", "identify.themes", "review.completely"}, 2, False, (512, 0)),
    "clustering": ({"find.similar", "identify.themes", "review.completely"}, 3, False, (512, 0)),
    "group.similarity": ({"compare.objects", "find.similar", "review.completely"}, 2, True, (128, 0)),
    "group.location": ({"compare.objects", "review.completely"}, 2, True, (2048, 0)),
}
INTENTS = sorted({i for c in CAPABILITIES.values() for i in c[0]} | {"trace.change", "explore.object", "search.sources"})
BUDGET = 1 << 30


@dataclass
class Plan:
    steps: list[str] = field(default_factory=list)
    decisions: list[tuple[str, str, str]] = field(default_factory=list)
    cost: int = 0

    @property
    def status(self) -> str:
        if not self.steps:
            return "notExecutable"
        return "readyWithCaveats" if any(a in ("conditional", "deferred", "unavailable") for _, a, _ in self.decisions) else "ready"


def plan(intents: set[str], sizes: dict[str, int], groups: tuple[set, set] | None = None, budget: int = BUDGET) -> Plan:
    """Which capabilities run, in catalogue order, and why the others do not."""
    out = Plan()
    for name, (serves, least, grouped, (fixed, each)) in CAPABILITIES.items():
        cost = sum(sizes.values()) + 64 * len(sizes) + fixed + each * len(sizes)
        if not serves & intents:
            verdict = ("notApplicable", "intent")
        elif grouped and not groups:
            verdict = ("conditional", "groups-missing")
        elif grouped and groups and groups[0] & groups[1]:
            verdict = ("unavailable", "groups-overlap")
        elif len(sizes) < least:
            verdict = ("unavailable", "too-few-sources")
        elif out.cost + cost > budget:
            verdict = ("deferred", "budget")
        else:
            verdict = ("applicable", "selected")
            out.steps.append(name)
            out.cost += cost
        out.decisions.append((name, *verdict))
    return out


def node_id(kind: str, version: str, parameters: dict, inputs: list[str]) -> str:
    """A content address: equal analyses of equal inputs have equal ids."""
    return "sha256:" + hashlib.sha256(canonical_json([kind, version, parameters, sorted(inputs)]).encode()).hexdigest()


def order(graph: dict[str, list[str]]) -> list[str]:
    """Nodes after their inputs; a cycle or an unknown input raises."""
    out, state = [], {}

    def visit(n: str) -> None:
        if state.get(n) == 1:
            raise ValueError("graph.cycle")
        if n not in graph:
            raise ValueError("graph.unknown-input")
        if n not in state:
            state[n] = 1
            for i in sorted(graph[n]):
                visit(i)
            state[n] = 2
            out.append(n)

    for n in sorted(graph):
        visit(n)
    return out


def retained(artifacts: dict[str, list[str]], sources: dict[str, str], changed: set[str]) -> set[str]:
    """Artifacts whose inputs, through other artifacts too, hold no changed source."""
    keep: set[str] = set()
    for a in order({**artifacts, **{s: [] for s in sources}}):
        if a in artifacts and not any(i in changed or (i in artifacts and i not in keep) for i in artifacts[a]):
            keep.add(a)
    return keep


class Store:
    """Artifacts as Parquet folders named by their node id: a hit is read, a miss is computed and written."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, node: str) -> str:
        return f"{self.root}/{node.replace(':', '-')}"

    def has(self, node: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path(node)}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def reuse(self, node: str, compute) -> DataFrame:
        if not self.has(node):
            compute().write.mode("overwrite").parquet(self.path(node))
        return self.spark.read.parquet(self.path(node))


def support_contingency(v: Column, k: Column, p: Column, low: Column) -> Column:
    scale = F.sqrt(F.greatest(k - 1, F.lit(1)))
    c = F.when((p > 0.05) | (v < 0.1 / scale), "insufficient").when((v >= 0.5 / scale) & (p <= 0.01), "strong").when(v >= 0.3 / scale, "moderate").otherwise("weak")
    return F.when((c != "insufficient") & (low > 0.2), "caution").otherwise(c)


def support_location(g: Column, p: Column, smallest: Column) -> Column:
    c = F.when((p > 0.05) | (F.abs(g) < 0.2), "insufficient").when((F.abs(g) >= 0.8) & (p <= 0.01), "strong").when(F.abs(g) >= 0.5, "moderate").otherwise("weak")
    return F.when((c != "insufficient") & (smallest < 5), "caution").otherwise(c)


def support_collocation(joint: Column, t: Column, npmi: Column) -> Column:
    c = F.when(~((joint >= 3) & (t >= 2) & (npmi > 0)), "insufficient").when((npmi >= 0.5) & (joint >= 5), "strong").when(npmi >= 0.25, "moderate").otherwise("weak")
    return F.when((c != "insufficient") & (joint < 5), "caution").otherwise(c)


def support_community(q: Column, nodes: Column) -> Column:
    c = F.when(q < 0.3, "insufficient").when(q >= 0.5, "strong").otherwise("moderate")
    return F.when((c != "insufficient") & (nodes < 10), "caution").otherwise(c)


def support_clustering(s: Column, smallest: Column) -> Column:
    c = F.when(s <= 0.25, "insufficient").when(s > 0.7, "strong").when(s > 0.5, "moderate").otherwise("weak")
    return F.when((c != "insufficient") & (smallest < 2), "caution").otherwise(c)


def support_axis(share: Column, axes: Column, inertia: Column) -> Column:
    c = F.when(share <= 1 / axes, "insufficient").when(share >= 2 / axes, "strong").otherwise("moderate")
    return F.when((c != "insufficient") & (inertia < 0.05), "caution").otherwise(c)


def support_similarity(shared: Column) -> Column:
    return F.when(shared < 10, "caution").otherwise("descriptive")


def support_keyness(q: Column, log2: Column, least_expected: Column) -> Column:
    c = F.when((q > 0.05) | (F.abs(log2) < 1), "insufficient").when((q <= 0.01) & (F.abs(log2) >= 2), "strong").otherwise("moderate")
    return F.when((c != "insufficient") & (least_expected < 5), "caution").otherwise(c)


_ORDER = {"strong": 5, "moderate": 4, "descriptive": 3, "weak": 2, "caution": 1}


def findings(docs: DataFrame, most: int = 100) -> DataFrame:
    """The best of all window collocations that are supported: a report of `most` rows, ranked over every pair."""
    x = cooccurrence.scored_pairs(docs)
    s = x.withColumn("support", support_collocation(F.col("joint"), F.col("tscore"), F.col("npmi"))).where("support <> 'insufficient'")
    key = F.create_map(*(F.lit(v) for kv in _ORDER.items() for v in kv))[F.col("support")]
    return s.orderBy(key.desc(), F.abs("logdice").desc(), "node", "collocate").limit(most).select("node", "collocate", "joint", "support", "logdice")


def heads(log: DataFrame) -> DataFrame:
    """Entries of an append-only log (id, predecessor) that no other entry names as predecessor."""
    return log.join(log.select(F.col("predecessor").alias("id")).where("id IS NOT NULL").distinct(), "id", "left_anti").select("id")


def _grid(spark, sf: str) -> DataFrame:
    """Values over a wide range, out of line items."""
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", (F.col("l_discount").cast("double") * 10).alias("x"), (F.col("l_tax").cast("double") * 10).alias("y"), F.col("l_quantity").cast("long").alias("n"))


def _policy(make):
    return lambda s, sf: _grid(s, sf).select("l_orderkey", "l_linenumber", make(F.col("x"), F.col("y") / 10, F.col("n")).alias("support"))


_POLICIES = {
    "support_contingency": (lambda x, p, n: support_contingency(x, n % 4 + 2, p, x), ""), "support_location": (lambda x, p, n: support_location(x - 0.2, p, n), ""), "support_collocation": (lambda x, p, n: support_collocation(n % 9, n / 5, x - 0.2), ""),
    "support_community": (lambda x, p, n: support_community(x, n), ""), "support_clustering": (lambda x, p, n: support_clustering(x, n % 4), ""), "support_axis": (lambda x, p, n: support_axis(x, n % 5 + 1, p * 2), ""), "support_similarity": (lambda x, p, n: support_similarity(n), ""),
    "support_keyness": (lambda x, p, n: support_keyness(p, x * 4 - 1, n % 10), ""),
}


def _events_log(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.selectExpr("event_id AS id", "CASE WHEN event_id % 5 <> 0 THEN event_id - 2 END AS predecessor")


def execute(spark, sf: str) -> DataFrame:
    """The decisions of a plan over the documents by language; its steps are not run."""
    docs = table(spark, sf, "documents")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    p = plan({"review.completely"}, sizes, ({"en"}, {"de"}))
    return spark.createDataFrame([(i, *d, p.status) for i, d in enumerate(p.decisions)], "i int, capability string, applicability string, reason string, status string")


QUERIES = {
    **{k: _policy(m) for k, (m, _) in _POLICIES.items()}, "findings": lambda s, sf: findings(table(s, sf, "documents")), "investigation": lambda s, sf: heads(_events_log(s, sf)), "plan": execute,
}
_GRID = "WITH g AS (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) * 10 AS x, CAST(l_tax AS DOUBLE) * 10 / 10 AS p, CAST(l_quantity AS BIGINT) AS n FROM lineitem), c AS (SELECT *, {c} AS c FROM g) SELECT l_orderkey, l_linenumber, CASE WHEN c <> 'insufficient' AND {low} THEN 'caution' ELSE c END AS support FROM c"


def _case(bad: str, strong: str, moderate: str | None, rest: str, low: str) -> str:
    middle = f"WHEN {moderate} THEN 'moderate' " if moderate else ""
    return _GRID.format(c=f"CASE WHEN {bad} THEN 'insufficient' WHEN {strong} THEN 'strong' {middle}ELSE '{rest}' END", low=low)


_SC = "sqrt(greatest(n % 4 + 1, 1))"
ORACLES = {
    "support_contingency": _case(f"p > 0.05 OR x < 0.1 / {_SC}", f"x >= 0.5 / {_SC} AND p <= 0.01", f"x >= 0.3 / {_SC}", "weak", "x > 0.2"),
    "support_location": _case("p > 0.05 OR abs(x - 0.2) < 0.2", "abs(x - 0.2) >= 0.8 AND p <= 0.01", "abs(x - 0.2) >= 0.5", "weak", "n < 5"),
    "support_collocation": _case("NOT (n % 9 >= 3 AND n / 5 >= 2 AND x - 0.2 > 0)", "x - 0.2 >= 0.5 AND n % 9 >= 5", "x - 0.2 >= 0.25", "weak", "n % 9 < 5"),
    "support_community": _case("x < 0.3", "x >= 0.5", None, "moderate", "n < 10"), "support_clustering": _case("x <= 0.25", "x > 0.7", "x > 0.5", "weak", "n % 4 < 2"),
    "support_axis": _case("x <= 1 / (n % 5 + 1)", "x >= 2 / (n % 5 + 1)", None, "moderate", "p * 2 < 0.05"), "support_keyness": _case("p > 0.05 OR abs(x * 4 - 1) < 1", "p <= 0.01 AND abs(x * 4 - 1) >= 2", None, "moderate", "n % 10 < 5"),
    "findings": cooccurrence.SCORED + """, c AS (SELECT *, CASE WHEN NOT (joint >= 3 AND tscore >= 2 AND npmi > 0) THEN 'insufficient' WHEN npmi >= 0.5 AND joint >= 5 THEN 'strong' WHEN npmi >= 0.25 THEN 'moderate' ELSE 'weak' END AS c FROM s),
      f AS (SELECT *, CASE WHEN joint < 5 THEN 'caution' ELSE c END AS support FROM c WHERE c <> 'insufficient')
      SELECT node, collocate, joint, support, logdice FROM f
      ORDER BY CASE support WHEN 'strong' THEN 5 WHEN 'moderate' THEN 4 WHEN 'descriptive' THEN 3 WHEN 'weak' THEN 2 ELSE 1 END DESC, abs(logdice) DESC, node, collocate LIMIT 100""",
    "support_similarity": "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_quantity AS BIGINT) < 10 THEN 'caution' ELSE 'descriptive' END AS support FROM lineitem",
    "investigation": "WITH l AS (SELECT event_id AS id, CASE WHEN event_id % 5 <> 0 THEN event_id - 2 END AS predecessor FROM events) SELECT id FROM l WHERE id NOT IN (SELECT predecessor FROM l WHERE predecessor IS NOT NULL)",
}
