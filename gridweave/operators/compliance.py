"""The rules of a result. Each rule is a table of checks (variant, id, ok): passed checks count too, as rows or as COUNTED says.

A result is tables as gridweave.sources.results describes them. Rules of one variant's parts look only at variants with
exactly one summary. Paths run from a connection point to the tie-in point.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import catalogue as C
from gridweave.operators import geometry as G
from gridweave.operators import obstacles as O
from gridweave.operators import sequences, trees
from gridweave.operators.storage import Workspace
from gridweave.sources import dimensions as D

# Tolerances of money, score and length (cm, and share of the length).
MONEY, SCORE, LENGTH, SHARE = 3, 0.002, 50, 0.002
#: Node keys: variant times this plus the node; a variant's nodes are numbered below it.
NODES = 1_000_000_000

RULES: dict[str, Callable[[Result], DataFrame]] = {}


@dataclass
class Result:
    segments: DataFrame
    chambers: DataFrame
    points: DataFrame
    summaries: DataFrame
    features: DataFrame
    attributes: dict[str, list[str]]
    geometries: dict[str, str | None]
    #: (variant, node) of tie-in points where a variant has several; with one, it is node 0.
    ties: DataFrame | None = None
    #: Whether many rules read the lines, so that they are written; a single rule reads its own columns of them only.
    shared: bool = False

    @cached_property
    def work(self) -> Workspace:
        return Workspace(self.segments.sparkSession, "compliance")

    @cached_property
    def whole(self) -> DataFrame:
        """Variants with one summary."""
        return single(self.summaries)

    @cached_property
    def lines(self) -> DataFrame:
        rows = self.segments.join(self.whole, "variant", "left_semi")
        return self.work.write(rows, "lines") if self.shared else rows

    @cached_property
    def summary(self) -> DataFrame:
        return self.summaries.join(self.whole, "variant", "left_semi")

    @cached_property
    def tree(self) -> DataFrame:
        """(node, parent) over keys of all nodes that segments name."""
        key = lambda n: F.col("variant") * NODES + F.col(n)
        down = self.lines.select(key("b").alias("node"), key("a").alias("parent"))
        if self.ties is not None:
            down = down.unionByName(self.ties.join(self.whole, "variant", "left_semi").select(key("node").alias("node"), (F.col("variant") * NODES).alias("parent")))
        tops = down.select(F.col("parent").alias("node")).distinct().join(down.select("node"), "node", "left_anti")
        return self.work.write(down.unionByName(tops.withColumn("parent", F.lit(None).cast("long"))), "tree")

    @cached_property
    def reached(self) -> DataFrame:
        """(variant, node, reached) of all nodes that segments name."""
        r = trees.roots(self.tree).select(F.expr(f"node div {NODES}").alias("variant"), (F.col("node") % NODES).alias("node"), (F.col("root") % NODES == 0).alias("reached"))
        return self.work.write(r, "reached")

    @cached_property
    def paths(self) -> DataFrame:
        """(variant, point, steps, node, dn, length): the segments from each reached connection point up, in order."""
        ends = self.points.join(self.reached.where("reached"), ["variant", "node"], "left_semi").select((F.col("variant") * NODES + F.col("node")).alias("node"))
        up = trees.ancestors(self.tree, ends)
        line = self.lines.select((F.col("variant") * NODES + F.col("b")).alias("ancestor"), "variant", F.col("b").alias("at"), "dn", "length")
        return self.work.write(up.join(line, "ancestor").select("variant", (F.col("node") % NODES).alias("point"), "steps", F.col("at").alias("node"), "dn", "length"), "paths")


def single(summaries: DataFrame) -> DataFrame:
    """(variant) of those with one summary."""
    return summaries.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("variant")


def rule(f):
    RULES[f.__name__] = f
    return f


def _checks(df: DataFrame, ident: Column, ok: Column) -> DataFrame:
    return df.select(F.col("variant").cast("long").alias("variant"), ident.cast("string").alias("id"), F.coalesce(ok, F.lit(False)).alias("ok"))


def _price() -> Column:
    return C.of_diameter(F.col("dn"), 3)


@rule
def object_type_allowed(r):
    return _checks(r.features, F.col("id"), F.col("object_type").isin(list(r.attributes)))


@rule
def required_attributes(r):
    needs = F.create_map(*[x for t, keys in r.attributes.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in keys]))])[F.col("object_type")]
    return _checks(r.features.where(F.col("object_type").isin(list(r.attributes))), F.col("id"), F.size(F.array_except(needs, "keys")) == 0)


@rule
def geometry_kind(r):
    kinds = F.create_map(*[x for t, g in r.geometries.items() for x in (F.lit(t), F.lit(g))])[F.col("object_type")]
    return _checks(r.features.where(F.col("object_type").isin(list(r.attributes))), F.col("id"), F.col("geometry").eqNullSafe(kinds))


@rule
def no_z_coordinate(r):
    return _checks(r.features.where("geometry IS NOT NULL"), F.col("id"), F.col("dims") == 2)


@rule
def one_summary_per_variant(r):
    n = r.segments.select("variant").distinct().join(r.summaries.groupBy("variant").agg(F.count(F.lit(1)).alias("n")), "variant", "left")
    return _checks(n, F.lit(""), F.col("n") == 1)


@rule
def node_references(r):
    """Both ends are the tie-in point, a node below a segment, or a connection point."""
    known = r.lines.select("variant", F.col("b").alias("node")).union(r.points.select("variant", "node"))
    known = (known if r.ties is None else known.union(r.ties.select("variant", "node"))).distinct()
    named = r.lines.select("variant", "i", F.explode(F.array("a", "b")).alias("node"))
    met = named.join(known.withColumn("k", F.lit(True)), ["variant", "node"], "left")
    return _checks(met.groupBy("variant", "i").agg(F.min(F.coalesce("k", F.col("node") == 0)).alias("all")), F.col("i"), F.col("all"))


@rule
def length_matches_geometry(r):
    return _checks(r.lines, F.col("i"), F.abs(F.col("geom") - F.col("length")) <= F.greatest(F.lit(float(LENGTH)), F.col("geom") * SHARE))


@rule
def turn_angle(r):
    c = F.col
    turn = G.angle(c("xm") - c("xa"), c("ym") - c("ya"), c("xb") - c("xm"), c("yb") - c("ym"))
    return _checks(r.lines.withColumn("turn", turn).where("turn IS NOT NULL"), F.col("i"), F.col("turn") <= 90 + 1e-6)


@rule
def laying_method(r):
    return _checks(r.lines, F.col("i"), F.col("method").isin("base", "special"))


@rule
def diameter_capacity(r):
    return _checks(r.lines, F.col("i"), C.of_diameter(F.col("dn"), 1) >= F.col("flow") / 100.0 - 1e-9)


@rule
def segment_cost(r):
    """Plain laying costs length times price; any other must cost more."""
    due = F.col("geom") / 100 * _price()
    plain = F.abs(F.col("cost") - due) <= F.greatest(F.lit(2.0), due * SHARE)
    return _checks(r.lines.where(_price().isNotNull()), F.col("i"), F.when(F.col("method") == "base", plain).otherwise(F.col("cost") > due))


def _attached(r) -> DataFrame:
    ends = r.lines.select("variant", "dn", F.explode(F.array("a", "b")).alias("node"))
    met = ends.groupBy("variant", "node").agg(F.count(F.lit(1)).alias("attached"), F.max("dn").alias("widest"))
    return r.chambers.join(r.whole, "variant", "left_semi").join(met, ["variant", "node"], "left").na.fill(0, ["attached", "widest"])


@rule
def chamber_degree(r):
    return _checks(_attached(r), F.col("node"), F.col("attached") + F.col("slots") <= D.MAX_DEGREE)


@rule
def chamber_diameter(r):
    return _checks(_attached(r), F.col("node"), F.col("dn") == F.greatest("widest", "host_dn"))


@rule
def chamber_cost(r):
    return _checks(_attached(r), F.col("node"), F.abs(F.col("cost") - C.chamber_cost(F.col("dn"))) < 1)


@rule
def network_connected(r):
    return _checks(r.reached, F.col("node"), F.col("reached"))


@rule
def diameter_monotonic(r):
    before = F.lag("dn").over(Window.partitionBy("variant", "point").orderBy("steps"))
    return _checks(r.paths.withColumn("before", before).where("before IS NOT NULL"), F.concat_ws(":", "point", "node"), F.col("dn") >= F.col("before"))


@rule
def run_length_limit(r):
    runs = sequences.runs(r.paths, ["variant", "point"], ["steps"], "dn", "length")
    most = C.of_diameter(F.col("dn"), 2) * 100
    return _checks(runs.where(most.isNotNull()), F.concat_ws(":", "point", "run"), F.col("total") <= most)


@rule
def no_self_intersection(r):
    """Segments without a common node whose links cross: only these pairs are rows, COUNTED says how many pairs there are.

    Links meet in grid cells as wide as they are long on average, so pairs that are far apart never meet; a link without coordinates crosses
    nothing.
    """
    c = F.col
    link = lambda x, y: F.struct(*[c(f"x{x}").alias("x0"), c(f"y{x}").alias("y0"), c(f"x{y}").alias("x1"), c(f"y{y}").alias("y1")])
    links = r.lines.select("variant", "i", "a", "b", F.explode(F.array(link("a", "m"), link("m", "b"))).alias("l")).select("variant", "i", "a", "b", "l.*").dropna()
    links = r.work.write(links, "links")
    size = links.agg(F.avg(F.greatest(F.abs(c("x1") - c("x0")), F.abs(c("y1") - c("y0"))))).first()[0]
    if not size:
        return _checks(r.lines.where("false"), F.lit(""), F.lit(True))
    low = {"l0": F.least("x0", "x1"), "l1": F.least("y0", "y1"), "h0": F.greatest("x0", "x1"), "h1": F.greatest("y0", "y1")}
    dealt = O.dealt(links.withColumns(low), size, "l0", "l1", "h0", "h1")
    side = lambda s: dealt.select("variant", "cx", "cy", *[c(n).alias(s + n) for n in ("i", "a", "b", "x0", "y0", "x1", "y1", *low)])
    met = side("p").join(side("q"), ["variant", "cx", "cy"]).where((c("pi") < c("qi")) & ~c("pa").isin(c("qa"), c("qb")) & ~c("pb").isin(c("qa"), c("qb")))
    met = met.where("pl0 <= qh0 AND ql0 <= ph0 AND pl1 <= qh1 AND ql1 <= ph1")
    ends = lambda s: [c(s + n) for n in ("x0", "y0", "x1", "y1")]
    apart = lambda l, m: F.signum(G.side(*l, m[0], m[1])) * F.signum(G.side(*l, m[2], m[3])) < 0
    crossed = met.where(apart(ends("p"), ends("q")) & apart(ends("q"), ends("p"))).select("variant", "pi", "qi").distinct()
    return _checks(crossed, F.concat_ws(":", "pi", "qi"), F.lit(False))


def _pairs_apart(r: Result) -> DataFrame:
    """(variant, n): pairs of segments without a common node: all pairs less those that share a node, those that share both counted once."""
    two = lambda n: n * (n - 1) / 2
    every = r.lines.groupBy("variant").agg(two(F.count(F.lit(1))).alias("n"))
    ends = r.lines.select("variant", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
    share = ends.groupBy("variant", "node").count().groupBy("variant").agg(F.sum(two(F.col("count"))).alias("one"))
    twins = r.lines.where("a <> b").groupBy("variant", F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_h")).count()
    twins = twins.groupBy("variant").agg(F.sum(two(F.col("count"))).alias("both"))
    n = F.col("n") - F.coalesce("one", F.lit(0)) + F.coalesce("both", F.lit(0))
    return every.join(share, "variant", "left").join(twins, "variant", "left").select("variant", n.cast("long").alias("n"))


#: How many checks a rule makes, where its passed ones are too many to be rows.
COUNTED: dict[str, Callable[[Result], DataFrame]] = {"no_self_intersection": _pairs_apart}


@rule
def summary_sums(r):
    """Four checks a summary: chambers, construction, total, length."""
    s = r.lines.groupBy("variant").agg(F.sum("cost").alias("pipes"), F.sum("length").alias("metres"))
    ch = r.chambers.groupBy("variant").agg(F.sum("cost").alias("built"))
    t = r.summary.join(s, "variant").join(ch, "variant", "left").na.fill(0, ["built"])
    c = F.col
    near = lambda a, b: F.abs(a - b) < MONEY
    four = {
        "chambers": near(c("chamber_cost"), c("built")), "construction": near(c("construction"), c("pipes") + c("built") + c("tie_cost")), "total": near(c("total"), c("construction") + c("penalty")),
        "length": F.abs(c("length") - c("metres")) <= F.greatest(F.lit(float(LENGTH)), c("metres") * SHARE),
    }
    each = t.select("variant", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("ok")) for k, v in four.items()])).alias("e"))
    return _checks(each, F.col("e.what"), F.col("e.ok"))


@rule
def tie_in_cost(r):
    return _checks(r.summary, F.lit(""), F.abs(F.col("tie_cost") - F.col("tie_count") * D.TIE_IN_COST) < 1)


@rule
def score_formula(r):
    return _checks(r.summary, F.lit(""), F.abs(C.score(F.col("total"), F.col("length") / 100.0) - F.col("score")) < SCORE)


@rule
def penalty_formula(r):
    due = r.points.where("listed").groupBy("variant").agg(F.sum(D.PENALTY + D.PENALTY_PER_FLOW // 100 * F.col("flow")).alias("due"))
    return _checks(r.summary.join(due, "variant", "left"), F.lit(""), F.abs(F.coalesce("due", F.lit(0)) - F.col("penalty")) < 1)


@rule
def unconnected_consistent(r):
    """Two checks a connection point: not both listed and reached; listed or reached."""
    p = r.points.join(r.whole, "variant", "left_semi").join(r.reached, ["variant", "node"], "left").na.fill(False, ["reached"])
    both = p.select("variant", "node", F.explode(F.array(F.struct(F.lit("both").alias("what"), (~(F.col("listed") & F.col("reached"))).alias("ok")), F.struct(F.lit("neither").alias("what"), (F.col("listed") | F.col("reached")).alias("ok")))).alias("e"))
    return _checks(both, F.concat_ws(":", "node", "e.what"), F.col("e.ok"))


@rule
def ranks_sequential(r):
    """A check a job, named by it: its ranks, sorted, are 1 to n. They are if they are distinct, begin at 1 and end at n."""
    job = r.summaries.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("k"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return job.select(F.lit(None).cast("long").alias("variant"), F.col("job").cast("string").alias("id"), ((F.col("n") == F.col("k")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("ok"))


def report(result: Result, rules: list[str] | None = None) -> DataFrame:
    """(rule, checks, findings) of the rules, all where None."""
    out, result.shared = None, True
    for name in rules or list(RULES):
        one = RULES[name](result).agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok")).alias("findings")).select(F.lit(name).alias("rule"), "checks", "findings")
        if name in COUNTED:
            n = COUNTED[name](result).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            one = one.crossJoin(n).select("rule", F.col("n").alias("checks"), "findings")  # a row each
        out = one if out is None else out.unionByName(one)
    return out
