"""Queries over whole tables, one for each operator, and DuckDB SQL for the same rows where SQL can say it.

The pool is mostly part, with p_size and p_retailprice as features; the parts of
one brand count as evaluated. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftpool.functions import metrics as M
from siftpool.functions.frames import anti, by_key, checkpointed, semi, top
from siftpool.functions.metrics import Tracker
from siftpool.functions.resampling import holdout, window_folds
from siftpool.operators import acquisition as acq
from siftpool.operators import proposers as P
from siftpool.operators.design import grid, grid_size, lhs_design, sobol_design
from siftpool.operators.gaussian import GaussianProcess, HeteroskedasticProcess, Kernel, normal_sums
from siftpool.operators.distance import DISTANCES, Affine, Gower, Standardize
from siftpool.operators.extent import occupancy, spanned
from siftpool.operators.nearest import nearest
from siftpool.operators.modifiers import Diversity, LocalPenalization
from siftpool.operators.quantiles import LinearQuantiles
from siftpool.operators.samplers import SAMPLERS, farthest_first, picked_rows, sampler
from siftpool.operators.surrogates import Bootstrap, Constant, Linear, NearestNeighbours, QuantileNeighbours, Trees, ensemble_summary
from siftpool.operators.vectors import nearest_vector
from siftpool.plans.optimizers import ActiveLearning, PoolRandom, PoolSample, active_learning, optimize_active, pool_active_learning
from siftpool.plans.search import Evals, Search
from siftpool.sources.objectives import Dataset, Learned, PoolFunction, PoolWrapper, RowFunction, lookup
from siftpool.space import Codomain, Needs, Space, p_dbl, p_fct, p_int, p_lgl

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
EVALUATED = "Brand#11"
_Y = Codomain({"y": "minimize"})
PART = Space((p_int("p_size", 1, 50), p_dbl("p_retailprice", 900, 1000)))
SIZE = Space((p_int("p_size", 1, 50),))
SUPPLIER = Space((p_dbl("s_acctbal", -1000, 10000), p_int("s_nationkey", 0, 24)))
CUSTOMER = Space((p_dbl("c_acctbal", -1000, 10000), p_int("c_nationkey", 0, 24), p_fct("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])))


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All parts, the evaluated ones with their price as output, and the rest."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return part, part.where(F.col("p_brand") == EVALUATED).withColumn("y", F.col("p_retailprice")), part.where(F.col("p_brand") != EVALUATED)


# --- distances

_STATS = "st AS (SELECT avg(p_size) ms, stddev_samp(p_size) ss, avg(p_retailprice) mr, stddev_samp(p_retailprice) sr FROM part)"
_D = "sqrt(pow((c.p_size - e.p_size) / ss, 2) + pow((c.p_retailprice - e.p_retailprice) / sr, 2))"
_GSX = f"WITH {_STATS}, sc AS (SELECT c.p_partkey, c.p_size, c.p_retailprice, min({_D}) score FROM part c, part e, st WHERE c.p_brand <> '{EVALUATED}' AND e.p_brand = '{EVALUATED}' GROUP BY ALL)"


@query(f"{_GSX} SELECT p_partkey, round(score, 6) score FROM sc")
def acq_gsx(spark, sf_dir):
    part, done, rest = _parts(spark, sf_dir)
    score = acq.GSx("standardize").fit(part, PART).update(done, "y")
    return score.score(rest).select("p_partkey", r6("score"))


@query(f"{_GSX} SELECT p_partkey, round(score, 6) score FROM sc ORDER BY round(score, 9) DESC, p_partkey LIMIT 20")
def propose_topk(spark, sf_dir):
    part, done, rest = _parts(spark, sf_dir)
    rows = acq.GSx("standardize").fit(part, PART).update(done, "y").score(rest).withColumn("score", F.round("score", 9))
    return top(rows, "score", 20, ["p_partkey"]).select("p_partkey", r6("score"))


def _six(d: Column) -> Column:
    """d, not negative, rounded to six places by the arithmetic of SQL's round(); Spark's makes a decimal of each double."""
    y = d * 1e6
    low = F.floor(y).cast("double")
    near = (low + (y - low >= 0.5).cast("double")) / 1e6
    return F.when(y < float(1 << 52), near).when(y < float("inf"), y / 1e6).otherwise(d)  # NaN is above all


def _supplier_pairs(spark, sf_dir, dist) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", *SUPPLIER.ids)
    return dist.fit(s, SUPPLIER).set_references(s, ("s_suppkey",)).pairs(s.withColumnRenamed("s_suppkey", "a"), {"s_suppkey": "b"}, of=_six).select("a", "b", "distance")


@query("WITH st AS (SELECT (max(s_acctbal) - min(s_acctbal)) / 2 ra, (max(s_nationkey) - min(s_nationkey)) / 2.0 rn FROM supplier) SELECT x.s_suppkey a, y.s_suppkey b, round(sqrt(pow((x.s_acctbal - y.s_acctbal) / ra, 2) + pow((x.s_nationkey - y.s_nationkey) / rn, 2)), 6) distance FROM supplier x, supplier y, st")
def dist_affine_pairs(spark, sf_dir):
    return _supplier_pairs(spark, sf_dir, Affine())


@query("WITH st AS (SELECT stddev_samp(s_acctbal) ra, stddev_samp(s_nationkey) rn FROM supplier) SELECT x.s_suppkey a, y.s_suppkey b, round(sqrt(pow((x.s_acctbal - y.s_acctbal) / ra, 2) + pow((x.s_nationkey - y.s_nationkey) / rn, 2)), 6) distance FROM supplier x, supplier y, st")
def dist_standardize_pairs(spark, sf_dir):
    return _supplier_pairs(spark, sf_dir, Standardize())


@query("WITH st AS (SELECT max(s_acctbal) - min(s_acctbal) ra, max(s_nationkey) - min(s_nationkey) rn FROM supplier) SELECT x.s_suppkey a, y.s_suppkey b, round((abs(x.s_acctbal - y.s_acctbal) / ra + abs(x.s_nationkey - y.s_nationkey) / rn) / 2, 6) distance FROM supplier x, supplier y, st")
def dist_gower_pairs(spark, sf_dir):
    return _supplier_pairs(spark, sf_dir, Gower())


_MODES = {"minmax_auto": ("max(c_acctbal) - min(c_acctbal)", "max(c_nationkey) - min(c_nationkey)"), "minmax_space": ("11000.0", "24.0"), "minmax_empirical": ("max(c_acctbal) - min(c_acctbal)", "max(c_nationkey) - min(c_nationkey)"), "standardize": ("stddev_samp(c_acctbal)", "stddev_samp(c_nationkey)"), "off": ("1.0", "1.0")}


@query(
    " UNION ALL ".join(
        f"SELECT '{m}' AS scale, c.c_custkey, round(min((abs(c.c_acctbal - e.s_acctbal) / ra + abs(c.c_nationkey - e.s_nationkey) / rn) / 2), 6) distance FROM customer c, supplier e, (SELECT {a} ra, {b} rn FROM customer) st GROUP BY ALL" for m, (a, b) in _MODES.items()
    )
)
def dist_gower_modes(spark, sf_dir):
    c, out = table(spark, sf_dir, "customer"), None
    space = CUSTOMER.select(["c_acctbal", "c_nationkey"])
    refs = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey"))
    told: dict[tuple, DataFrame] = {}  # by scales, which two modes share where there is a pool
    for mode in Gower.MODES:
        dist = Gower(mode).fit(c, space).set_references(refs)
        scales = tuple(dist.spread.items())
        if scales not in told:
            told[scales] = checkpointed(dist.nearest(c).select("c_custkey", r6("distance")))
        one = told[scales].select(F.lit(mode).alias("scale"), "c_custkey", "distance")
        out = one if out is None else out.unionByName(one)
    return out


_LEVELS = CUSTOMER["c_mktsegment"].levels


@query(
    "WITH st AS (SELECT avg(c_acctbal) ma, stddev_samp(c_acctbal) sa, avg(c_nationkey) mn, stddev_samp(c_nationkey) sn, "
    + ", ".join(f"avg((c_mktsegment = '{v}')::INT) m{i}, stddev_samp((c_mktsegment = '{v}')::INT) s{i}" for i, v in enumerate(_LEVELS))
    + " FROM customer) SELECT c_custkey, round((c_acctbal - ma) / sa, 6) e0, round((c_nationkey - mn) / sn, 6) e1, "
    + ", ".join(f"round(((c_mktsegment = '{v}')::INT - m{i}) / s{i}, 6) e{i + 2}" for i, v in enumerate(_LEVELS))
    + " FROM customer, st"
)
def embed_standardize(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", *(r6(e, f"e{i}") for i, e in enumerate(Standardize().fit(c, CUSTOMER).embedding())))


@query("SELECT c.vec_id, round(min(sqrt(list_sum([pow(x[1]::DOUBLE - x[2]::DOUBLE, 2) for x in list_zip(c.embedding, e.embedding)]))), 5) distance FROM embeddings c, embeddings e WHERE c.label <> 0 AND e.label = 0 GROUP BY ALL")
def embedding_gsx(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest_vector(rows.where("label <> 0"), rows.where("label = 0"), "embedding").select("vec_id", F.round("distance", 5).alias("distance"))


# --- acquisition scores with a model of price by size

_MODEL = f"m AS (SELECT regr_slope(p_retailprice, p_size) b, regr_intercept(p_retailprice, p_size) a FROM part WHERE p_brand = '{EVALUATED}')"
_PAIRS = f"WITH {_MODEL}, st AS (SELECT (max(p_size) - min(p_size)) / 2.0 h FROM part), pr AS (SELECT c.p_partkey, abs(c.p_size - e.p_size) / h d, abs(a + b * c.p_size - e.p_retailprice) r FROM part c, part e, m, st WHERE c.p_brand <> '{EVALUATED}' AND e.p_brand = '{EVALUATED}')"


def _modelled(spark, sf_dir, score) -> DataFrame:
    part, done, rest = _parts(spark, sf_dir)
    model = Linear().fit(done, SIZE, "y")
    return score.fit(part, SIZE).update(done, "y").score(model.predict(rest)).select("p_partkey", r6("score"))


@query(f"{_PAIRS} SELECT p_partkey, round(min(r), 6) score FROM pr GROUP BY ALL")
def acq_gsy(spark, sf_dir):
    return _modelled(spark, sf_dir, acq.GSy())


@query(f"{_PAIRS} SELECT p_partkey, round(min(d * r), 6) score FROM pr GROUP BY ALL")
def acq_igs(spark, sf_dir):
    return _modelled(spark, sf_dir, acq.IGS("affine"))


@query(
    f"{_PAIRS}, w AS (SELECT p_partkey, count(*) FILTER (d * d <= 1e-12) n, sum(r * r) FILTER (d * d <= 1e-12) ex, sum(exp(-d * d) / (d * d)) FILTER (d * d > 1e-12) s, sum(exp(-d * d) / (d * d) * r * r) FILTER (d * d > 1e-12) sr FROM pr GROUP BY ALL) "
    "SELECT p_partkey, round(CASE WHEN n > 0 THEN ex / n ELSE sr / s + 2 / pi() * atan(1 / s) END, 6) score FROM w"
)
def acq_ideal(spark, sf_dir):
    return _modelled(spark, sf_dir, acq.Ideal("affine"))


@query(
    "WITH p AS (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier), st AS (SELECT (max(s_acctbal) - min(s_acctbal)) / 2 ra, (max(s_nationkey) - min(s_nationkey)) / 2.0 rn FROM p), "
    "pr AS (SELECT x.s_acctbal, x.s_nationkey, sqrt(pow((x.s_acctbal - y.s_acctbal) / ra, 2) + pow((x.s_nationkey - y.s_nationkey) / rn, 2)) d FROM p x, p y, st WHERE (x.s_acctbal, x.s_nationkey) <> (y.s_acctbal, y.s_nationkey)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY s_acctbal, s_nationkey ORDER BY d) n FROM pr), q AS (SELECT s_acctbal, s_nationkey, pow(avg(d), 2) m FROM k WHERE n <= 2 GROUP BY ALL) "
    "SELECT s_acctbal, s_nationkey, round(CASE WHEN m > 0 THEN (SELECT min(m) FROM q WHERE m > 0) / m ELSE 1 END, 6) density FROM q"
)
def ideal_density(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return acq.density(s, Affine().fit(s, SUPPLIER), SUPPLIER).select("s_acctbal", "s_nationkey", r6("density"))


@query(
    "WITH p AS (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier), st AS (SELECT (max(s_acctbal) - min(s_acctbal)) / 2 ra, (max(s_nationkey) - min(s_nationkey)) / 2.0 rn FROM p), "
    "al AS (SELECT x.s_acctbal, x.s_nationkey, y.s_acctbal ya, y.s_nationkey yn, sqrt(pow((x.s_acctbal - y.s_acctbal) / ra, 2) + pow((x.s_nationkey - y.s_nationkey) / rn, 2)) d FROM p x, p y, st), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY s_acctbal, s_nationkey ORDER BY d) n FROM al WHERE (s_acctbal, s_nationkey) <> (ya, yn)), q AS (SELECT s_acctbal, s_nationkey, pow(avg(d), 2) m FROM k WHERE n <= 2 GROUP BY ALL), "
    "de AS (SELECT s_acctbal, s_nationkey, CASE WHEN m > 0 THEN (SELECT min(m) FROM q WHERE m > 0) / m ELSE 1 END density FROM q), "
    "pr AS (SELECT s_acctbal, s_nationkey, d, (SELECT avg(s_acctbal * 0.5 + s_nationkey) FROM p WHERE s_nationkey < 5) - (ya * 0.5 + yn) r FROM al WHERE yn < 5 AND s_nationkey >= 5), "
    "w AS (SELECT s_acctbal, s_nationkey, count(*) FILTER (d * d <= 1e-12) n, sum(r * r) FILTER (d * d <= 1e-12) ex, sum(exp(-d * d) / (d * d)) FILTER (d * d > 1e-12) s, sum(exp(-d * d) / (d * d) * r * r) FILTER (d * d > 1e-12) sr FROM pr GROUP BY ALL) "
    "SELECT s_acctbal, s_nationkey::BIGINT s_nationkey, round((CASE WHEN n > 0 THEN ex / n ELSE sr / s + 2 / pi() * atan(1 / s) END) * (1 + 2 * density), 2) score FROM w JOIN de USING (s_acctbal, s_nationkey)"
)
def acq_ideal_density(spark, sf_dir):
    pool = _suppliers(spark, sf_dir)
    done = pool.where("s_nationkey < 5").withColumn("y", F.col("s_acctbal") * 0.5 + F.col("s_nationkey"))
    score = acq.Ideal("affine", omega=2.0).fit(pool, SUPPLIER).update(done, "y")
    return score.score(Constant().fit(done, SUPPLIER, "y").predict(pool.where("s_nationkey >= 5"))).select("s_acctbal", F.col("s_nationkey").cast("bigint").alias("s_nationkey"), F.round("score", 2).alias("score"))


# --- batches

_CAND = f"cand AS (SELECT DISTINCT p_size, p_retailprice FROM part WHERE (p_size, p_retailprice) NOT IN (SELECT (p_size, p_retailprice) FROM part WHERE p_brand = '{EVALUATED}'))"
_SCORED = f"WITH {_STATS}, {_CAND}, s0 AS (SELECT c.p_size, c.p_retailprice, min({_D}) u FROM cand c, part e, st WHERE e.p_brand = '{EVALUATED}' GROUP BY ALL)"
_GOWER = "(abs(s.p_size - q.p_size) / 49.0 + abs(s.p_retailprice - q.p_retailprice) / 100.0) / 2"


def _picks(n: int, utility: Callable[[int], str]) -> str:
    """n picks, each the first of the highest utility(k) given the k picks before; utility() is SQL over s0 s for rows of s."""
    out = ""
    for k in range(n):
        taken = "".join(f" AND (s.p_size, s.p_retailprice) <> (SELECT (p_size, p_retailprice) FROM t{j})" for j in range(k))
        out += f", t{k} AS (SELECT s.p_size, s.p_retailprice FROM ({utility(k)}) s WHERE u > '-inf'::DOUBLE{taken} ORDER BY round(u, 9) DESC, s.p_size, s.p_retailprice LIMIT 1)"
    return out


def _chosen(k: int) -> str:
    return "(" + " UNION ALL ".join(f"SELECT * FROM t{j}" for j in range(k)) + ")"


def _all(n: int) -> str:
    return " UNION ALL ".join(f"SELECT p_size::BIGINT p_size, p_retailprice FROM t{j}" for j in range(n))


def _context(spark, sf_dir) -> P.Context:
    part, done, _ = _parts(spark, sf_dir)
    pool = part.select("p_size", "p_retailprice").distinct()
    return P.Context(spark, PART, done.select("p_size", "p_retailprice", "y"), "y", pool)


class _OverAllParts(acq.GSx):
    """Scaled by all parts, as they are stored, rather than by distinct feature rows."""

    def __init__(self, part: DataFrame):
        super().__init__("standardize")
        self.part = part

    def fit(self, pool, space):
        return super().fit(self.part, space)


def _proposed(spark, sf_dir, make, n) -> DataFrame:
    part = _parts(spark, sf_dir)[0]
    return make(_OverAllParts(part)).propose(_context(spark, sf_dir), n).select(F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice")


@query(_SCORED + _picks(5, lambda k: "SELECT * FROM s0" if not k else f"SELECT s.p_size, s.p_retailprice, CASE WHEN min({_GOWER}) <= 0.1 THEN '-inf'::DOUBLE ELSE any_value(s.u) END u FROM s0 s, {_chosen(k)} q GROUP BY ALL") + " " + _all(5))
def propose_local_penalization(spark, sf_dir):
    return _proposed(spark, sf_dir, lambda a: P.SequentialScore(a, LocalPenalization(0.1)), 5)


@query(
    _SCORED
    + _picks(4, lambda k: "SELECT * FROM s0" if not k else f"SELECT p_size, p_retailprice, 0.5 * (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) + 0.5 * (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) u FROM (SELECT s.p_size, s.p_retailprice, any_value(s.u) u, min({_GOWER}) g FROM s0 s, {_chosen(k)} q GROUP BY ALL)")
    + " "
    + _all(4)
)
def propose_diversity(spark, sf_dir):
    return _proposed(spark, sf_dir, lambda a: P.SequentialScore(a, Diversity(0.5)), 4)


@query(_SCORED + ", few AS (SELECT * FROM cand ORDER BY md5('3:' || p_size || ':' || p_retailprice), p_size, p_retailprice LIMIT 50) SELECT p_size::BIGINT p_size, p_retailprice FROM s0 WHERE (p_size, p_retailprice) IN (SELECT (p_size, p_retailprice) FROM few) ORDER BY u DESC, p_size, p_retailprice LIMIT 5")
def propose_few_candidates(spark, sf_dir):
    """A sampler first reduces the pool to 50 candidates, as large pools need it; those are scored."""
    return _proposed(spark, sf_dir, lambda a: P.Score(a, sampler("uniform", seed=3), 50), 5)


_NEARER = "SELECT s.p_size, s.p_retailprice, least(any_value(s.u), min(sqrt(pow((s.p_size - q.p_size) / ss, 2) + pow((s.p_retailprice - q.p_retailprice) / sr, 2)))) u FROM s0 s, {} q, st GROUP BY ALL"


@query(_SCORED + _picks(5, lambda k: "SELECT * FROM s0" if not k else _NEARER.format(_chosen(k))) + " " + _all(5))
def propose_seq_reference(spark, sf_dir):
    return _proposed(spark, sf_dir, lambda a: P.SequentialReference(a), 5)


_LINE = f"ln AS (SELECT regr_slope(p_retailprice, p_size) b, regr_intercept(p_retailprice, p_size) a FROM part WHERE p_brand = '{EVALUATED}')"
_IGS = f"WITH {_STATS}, {_CAND}, {_LINE}, s0 AS (SELECT c.p_size, c.p_retailprice, min({_D} * abs(a + b * c.p_size - e.p_retailprice)) u FROM cand c, part e, st, ln WHERE e.p_brand = '{EVALUATED}' GROUP BY ALL)"
_IGS_NEXT = "SELECT s.p_size, s.p_retailprice, least(any_value(s.u), min(sqrt(pow((s.p_size - q.p_size) / ss, 2) + pow((s.p_retailprice - q.p_retailprice) / sr, 2)) * abs(b * (s.p_size - q.p_size)))) u FROM s0 s, {} q, st, ln GROUP BY ALL"


class _LineBySize(Linear):
    """A line of the price by size alone."""

    def fit(self, archive, space, target):
        return super().fit(archive, SIZE, target)


@query(_IGS + _picks(4, lambda k: "SELECT * FROM s0" if not k else _IGS_NEXT.format(_chosen(k))) + " " + _all(4))
def propose_seq_igs(spark, sf_dir):
    """Each pick is a reference of the next, at its predicted price."""
    part, done, _ = _parts(spark, sf_dir)

    class OverAllParts(acq.IGS):
        def fit(self, pool, space):
            return super().fit(part, space)

    pool = part.select("p_size", "p_retailprice").distinct()
    context = P.Context(spark, PART, done.select("p_size", "p_retailprice", "y"), "y", pool, surrogate=_LineBySize())
    return P.SequentialReference(OverAllParts()).propose(context, 4).select(F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice")


@query(_SCORED + _picks(4, lambda k: "SELECT p_size, p_retailprice, " + ("u" if k % 2 == 0 else "p_retailprice * 1.0 AS u") + " FROM s0") + " " + _all(4))
def portfolio_round_robin(spark, sf_dir):
    class Dear(acq.Acquisition):
        def score(self, cands, out="score"):
            return cands.withColumn(out, F.col("p_retailprice"))

    return _proposed(spark, sf_dir, lambda a: P.Portfolio([P.Score(a), P.Score(Dear())]), 4)


@query()
def propose_pseudo_label(spark, sf_dir):
    part = _parts(spark, sf_dir)[0]
    score = acq.IGS("affine")
    return P.PseudoLabel(score).propose(P.Context(spark, PART, _parts(spark, sf_dir)[1].select("p_size", "p_retailprice", "y"), "y", part.select("p_size", "p_retailprice").distinct(), surrogate=Linear()), 3)


# --- pools, lookups, spaces


@query(f"SELECT p_partkey, p_size::BIGINT p_size, p_retailprice FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#1', 'Brand#2', '{EVALUATED}') AND p_retailprice <= 950")
def pool_filter_space(spark, sf_dir):
    space = Space((p_int("p_size", 5, 20), p_dbl("p_retailprice", 0, 950), p_fct("p_brand", ["Brand#1", "Brand#2", EVALUATED])))
    return space.pool_candidates(table(spark, sf_dir, "part")).select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice")


@query("SELECT (o_totalprice BETWEEN 1000 AND 250000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR (o_totalprice > 250000 AND o_orderpriority IS NULL) valid, count(*) n FROM orders GROUP BY ALL")
def valid_mask(spark, sf_dir):
    space = Space((p_dbl("o_totalprice", 1000, 250000), p_fct("o_orderpriority", ["1-URGENT", "2-HIGH"])))
    o = table(spark, sf_dir, "orders")
    return o.groupBy(space.valid(o).alias("valid")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey::BIGINT END c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3) THEN c_acctbal END c_acctbal FROM customer")
def design_apply(spark, sf_dir):
    space = Space(CUSTOMER.params, (Needs("c_nationkey", "c_mktsegment", ("BUILDING",)), Needs("c_acctbal", "c_nationkey", (1, 2, 3))))
    return space.apply_design(table(spark, sf_dir, "customer")).select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_acctbal")


@query("SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, o_totalprice y FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def pool_lookup_strict(spark, sf_dir):
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("y"))
    return lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), pool, ["l_orderkey"]).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "y")


@query("SELECT s_suppkey, s_nationkey::BIGINT s_nationkey, s_acctbal + s_nationkey y FROM supplier")
def pool_wrapper(spark, sf_dir):
    from siftpool.sources.objectives import Function

    s = table(spark, sf_dir, "supplier")
    inner = Function(lambda df: df.withColumn("y", F.col("s_acctbal") + F.col("s_nationkey")), SUPPLIER, Codomain({"y": "minimize"}))
    wrapped = PoolWrapper(s, inner, Space((p_int("s_suppkey"),)))
    return wrapped.evaluate(s.select("s_suppkey")).join(s.select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("s_nationkey")), "s_suppkey").select("s_suppkey", "s_nationkey", "y")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_custkey IS NOT DISTINCT FROM c.c_custkey)")
def unevaluated_antijoin(spark, sf_dir):
    """Customers without an order in progress; every customer has some order."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return anti(table(spark, sf_dir, "customer"), seen, ["c_custkey"]).select("c_custkey")


# --- samplers


def _suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_acctbal", "s_nationkey").distinct()


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("s_acctbal", F.col("s_nationkey").cast("bigint").alias("s_nationkey"))


_S0 = "WITH p AS (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier), st AS (SELECT avg(s_acctbal) ma, stddev_samp(s_acctbal) ra, avg(s_nationkey) mn, stddev_samp(s_nationkey) rn FROM {})"
_SD = "pow((s.s_acctbal - q.s_acctbal) / ra, 2) + pow((s.s_nationkey - q.s_nationkey) / rn, 2)"


def _farthest(n: int, first: str, known: str = "") -> str:
    out = f", t0 AS ({first})"
    for k in range(1, n):
        refs = " UNION ALL ".join([f"SELECT * FROM t{j}" for j in range(k)] + ([known] if known else []))
        taken = "".join(f" AND (s.s_acctbal, s.s_nationkey) <> (SELECT (s_acctbal, s_nationkey) FROM t{j})" for j in range(k))
        out += f", t{k} AS (SELECT s.s_acctbal, s.s_nationkey FROM p s, ({refs}) q, st WHERE true{taken} GROUP BY s.s_acctbal, s.s_nationkey ORDER BY round(sqrt(min({_SD})), 9) DESC, s.s_acctbal, s.s_nationkey LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT s_acctbal, s_nationkey::BIGINT s_nationkey FROM t{j}" for j in range(n))


@query(_S0.format("p") + _farthest(5, "SELECT s_acctbal, s_nationkey FROM p, st ORDER BY round(pow((s_acctbal - ma) / ra, 2) + pow((s_nationkey - mn) / rn, 2), 9), s_acctbal, s_nationkey LIMIT 1"))
def sampler_gsx(spark, sf_dir):
    return _told(sampler("gsx").sample(5, SUPPLIER, _suppliers(spark, sf_dir)))


_KNOWN = "SELECT c_acctbal s_acctbal, c_nationkey s_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 0"


@query(
    f"{_S0.format(f'(SELECT * FROM p UNION ALL {_KNOWN})')}, kn AS ({_KNOWN})"
    + _farthest(4, f"SELECT s.s_acctbal, s.s_nationkey FROM p s, kn q, st GROUP BY ALL ORDER BY round(sqrt(min({_SD})), 9) DESC, s.s_acctbal, s.s_nationkey LIMIT 1", "SELECT * FROM kn")
)
def sampler_gsx_known(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal < 0").select(F.col("c_acctbal").alias("s_acctbal"), F.col("c_nationkey").alias("s_nationkey"))
    pool = _suppliers(spark, sf_dir)
    dist = Standardize().fit(pool.unionByName(known), SUPPLIER)
    return _told(picked_rows(spark, farthest_first(pool, SUPPLIER, dist, 4, known), SUPPLIER))


@query("SELECT p_partkey FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 50")
def sampler_uniform_md5(spark, sf_dir):
    return sampler("uniform", seed=7).sample(50, Space((p_int("p_partkey"),)), table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("bigint").alias("p_partkey"))


@query(
    "WITH n AS (SELECT count(*) n FROM part), a AS (SELECT p_partkey FROM part, n ORDER BY md5('1:' || p_partkey), p_partkey LIMIT (SELECT greatest(8, round_even(n * pow(8.0 / n, 0.5), 0))::BIGINT FROM n)) "
    "SELECT p_partkey FROM a ORDER BY md5('2:' || p_partkey), p_partkey LIMIT 8"
)
def sampler_chain(spark, sf_dir):
    both = sampler("chain", samplers=[sampler("uniform", seed=1), sampler("uniform", seed=2)])
    return both.sample(8, Space((p_int("p_partkey"),)), table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("bigint").alias("p_partkey"))


@query(
    "WITH p AS (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier), st AS (SELECT max(s_acctbal) - min(s_acctbal) ra, max(s_nationkey) - min(s_nationkey) rn FROM p) "
    "SELECT x.s_acctbal, x.s_nationkey::BIGINT s_nationkey FROM p x, p y, st GROUP BY ALL ORDER BY round(sum((abs(x.s_acctbal - y.s_acctbal) / ra + abs(x.s_nationkey - y.s_nationkey) / rn) / 2), 9), 1, 2 LIMIT 1"
)
def sampler_kmedoids_single(spark, sf_dir):
    return _told(sampler("kmedoids").sample(1, SUPPLIER, _suppliers(spark, sf_dir)))


def _medoids(n: int, rounds: int) -> str:
    """Building and so many rounds of exchanges; a round without a better exchange changes nothing."""
    sql = (
        "WITH p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY s_acctbal, s_nationkey) i, * FROM (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier)), st AS (SELECT max(s_acctbal) - min(s_acctbal) ra, max(s_nationkey) - min(s_nationkey) rn FROM p), "
        "d AS MATERIALIZED (SELECT x.i i, y.i j, (abs(x.s_acctbal - y.s_acctbal) / ra + abs(x.s_nationkey - y.s_nationkey) / rn) / 2 d FROM p x, p y, st), m0 AS (SELECT 0 k, 0 j WHERE false)"
    )
    for b in range(n):
        sql += f", w{b} AS (SELECT d.i, min(d.d) base FROM m{b} m JOIN d USING (j) GROUP BY 1), m{b + 1} AS MATERIALIZED (SELECT * FROM m{b} UNION ALL (SELECT {b} k, j FROM d LEFT JOIN w{b} w USING (i) WHERE j NOT IN (SELECT j FROM m{b}) GROUP BY j ORDER BY round(sum(least(d, coalesce(base, d))), 9), j LIMIT 1))"
    for r in range(n, n + rounds):
        sql += (
            f", c{r} AS (SELECT sum(x) cost FROM (SELECT min(d) x FROM m{r} JOIN d USING (j) GROUP BY i)), o{r} AS (SELECT g.k, d.i, min(d.d) base FROM m{r} g, m{r} m, d WHERE m.k <> g.k AND d.j = m.j GROUP BY ALL), "
            f"e{r} AS (SELECT o.k, d.j, sum(least(d.d, o.base)) cost FROM o{r} o JOIN d USING (i) WHERE d.j NOT IN (SELECT j FROM m{r}) GROUP BY ALL ORDER BY round(cost, 9), k, j LIMIT 1), "
            f"m{r + 1} AS MATERIALIZED (SELECT m.k, CASE WHEN e.k = m.k AND e.cost < c.cost - 1e-9 THEN e.j ELSE m.j END j FROM m{r} m, e{r} e, c{r} c)"
        )
    return sql + f" SELECT s_acctbal, s_nationkey::BIGINT s_nationkey FROM m{n + rounds} m JOIN p ON p.i = m.j"


@query(_medoids(3, 8))
def sampler_kmedoids(spark, sf_dir):
    return _told(sampler("kmedoids").sample(3, SUPPLIER, _suppliers(spark, sf_dir)))


@query()
def sampler_kmeans(spark, sf_dir):
    return _told(sampler("kmeans").sample(4, SUPPLIER, _suppliers(spark, sf_dir)))


@query()
def sampler_relational_kmeans(spark, sf_dir):
    return _told(sampler("relational_kmeans").sample(4, SUPPLIER, _suppliers(spark, sf_dir)))


@query()
def sampler_relational_gower(spark, sf_dir):
    """Mixed columns: balance and the name of the nation."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    pool = table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select("s_acctbal", "n_name").distinct()
    levels = [r.n_name for r in nations.orderBy("n_name").collect()]  # levels of a space
    return sampler("relational_kmeans", dist="gower").sample(3, Space((p_dbl("s_acctbal", -1000, 10000), p_fct("n_name", levels))), pool).select("s_acctbal", "n_name")


@query()
def sampler_lhs(spark, sf_dir):
    return lhs_design(spark, PART, 1000).select(F.col("p_size").cast("bigint").alias("p_size"), r6("p_retailprice"))


@query()
def sampler_sobol(spark, sf_dir):
    return sobol_design(spark, PART, 1000).select(F.col("p_size").cast("bigint").alias("p_size"), r6("p_retailprice"))


# --- grids


@query("SELECT r_name, n_name, (1 + k)::BIGINT k, round(q / 4.0, 6) q FROM region, nation, range(0, 3) a(k), range(0, 5) b(q)")
def grid_full(spark, sf_dir):
    names = lambda t, c: [r[0] for r in table(spark, sf_dir, t).select(c).distinct().orderBy(c).collect()]  # noqa: E731  levels of a space
    space = Space((p_fct("r_name", names("region", "r_name")), p_fct("n_name", names("nation", "n_name")), p_int("k", 1, 3), p_dbl("q", 0, 1)))
    return grid(spark, space, 5).select("r_name", "n_name", "k", r6("q"))


_DEPENDENT = Space((p_lgl("gate"), p_int("x", 1, 10), p_fct("mode", ["a", "b", "c"]), p_dbl("z", 0, 1)), (Needs("x", "gate", (True,)), Needs("z", "mode", ("a", "b"))))


@query("SELECT gate, CASE WHEN gate THEN x::BIGINT END x, mode, CASE WHEN mode IN ('a', 'b') THEN round(z / 9.0, 6) END z FROM (VALUES (true), (false)) g(gate), range(1, 11) a(x), (VALUES ('a'), ('b'), ('c')) m(mode), range(0, 10) c(z) WHERE (gate OR x = 1) AND (mode <> 'c' OR z = 0)")
def grid_dependent(spark, sf_dir):
    return grid(spark, _DEPENDENT, 10).select("gate", "x", "mode", r6("z"))


@query("SELECT 231::BIGINT AS n, 73::BIGINT AS chain")
def grid_sizes(spark, sf_dir):
    ids = [f"i{k}" for k in range(8)]
    chain = Space(tuple(p_int(i, 1, 10) for i in ids), tuple(Needs(b, a, (1,)) for a, b in zip(ids, ids[1:])))
    return spark.createDataFrame([(grid_size(_DEPENDENT, 10), grid_size(chain, 10))], "n bigint, chain bigint")


# --- spaces that tables span

_ORDER_CELLS = (
    "WITH b AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders), v AS (SELECT DISTINCT lo + k::DOUBLE / 7 * (hi - lo) v FROM b, range(0, 8) t(k)), "
    "a AS (SELECT v, coalesce((v + lag(v) OVER (ORDER BY v)) / 2, '-inf'::DOUBLE) m0, coalesce((v + lead(v) OVER (ORDER BY v)) / 2, 'inf'::DOUBLE) m1 FROM v), "
    "l AS (SELECT DISTINCT o_orderstatus s, p FROM orders, (SELECT DISTINCT o_orderpriority p FROM orders) WHERE o_orderstatus IS NOT NULL AND p IS NOT NULL), "
    "g AS (SELECT DISTINCT s, CASE WHEN s IN ('F', 'O') THEN p END p, CASE WHEN s IN ('F', 'O') AND p IN ('1-URGENT', '2-HIGH') THEN v END v FROM l, v), "
    "n AS (SELECT o_orderstatus s, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority END p, CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN v END v, count(*) n FROM orders JOIN a ON o_totalprice > m0 AND o_totalprice <= m1 GROUP BY ALL) "
)


def _orders_space(spark, sf_dir) -> tuple[DataFrame, Space]:
    """Orders with a priority where the status asks for one, and a price where the priority does."""
    orders = table(spark, sf_dir, "orders")
    deps = (Needs("o_orderpriority", "o_orderstatus", ("F", "O")), Needs("o_totalprice", "o_orderpriority", ("1-URGENT", "2-HIGH")))
    return orders, spanned(orders, ["o_orderstatus", "o_orderpriority", "o_totalprice"], deps)


@query(_ORDER_CELLS + "SELECT g.s o_orderstatus, g.p o_orderpriority, round(g.v, 6) o_totalprice, coalesce(n, 0)::BIGINT n_rows FROM g LEFT JOIN n ON g.s IS NOT DISTINCT FROM n.s AND g.p IS NOT DISTINCT FROM n.p AND g.v IS NOT DISTINCT FROM n.v")
def grid_occupied(spark, sf_dir):
    """All orders at the points of a grid with conditions, over bounds and levels of the table."""
    orders, space = _orders_space(spark, sf_dir)
    return occupancy(orders, space, 8).select("o_orderstatus", "o_orderpriority", r6("o_totalprice"), "n_rows")


@query(_ORDER_CELLS + "SELECT count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderstatus IS NOT NULL) n_rows FROM g")
def grid_sizes_spanned(spark, sf_dir):
    """The size of that grid, counted without making it, beside the rows that span it."""
    orders, space = _orders_space(spark, sf_dir)
    return orders.agg(F.lit(grid_size(space, 8)).cast("bigint").alias("n"), F.count("o_orderstatus").alias("n_rows"))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "WITH n AS (SELECT count(*) n FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{c}' param, n n_points, n n_slices, 0::BIGINT first_slice, n - 1 last_slice, (SELECT count(DISTINCT least(floor(({c} - lo) / (hi - lo) * n)::BIGINT, n - 1)) FROM lineitem, (SELECT min({c}) lo, max({c}) hi FROM lineitem)) row_slices FROM n"
        for c in _LINE
    )
)
def lhs_lineitem(spark, sf_dir):
    """A Latin hypercube of as many points as lineitem has rows, over its bounds: the slices that hold a point, and those that hold a row."""
    rows = table(spark, sf_dir, "lineitem").select(_LINE)
    n = rows.count()
    space = spanned(rows, _LINE)

    def slices(df: DataFrame) -> DataFrame:
        at = [F.struct(F.lit(p.id).alias("param"), F.least(F.floor((F.col(p.id) - F.lit(p.lower)) / F.lit(p.upper - p.lower) * F.lit(n)), F.lit(n - 1)).cast("bigint").alias("slice")) for p in space.params]
        return df.select(F.explode(F.array(*at)).alias("at")).select("at.*")

    points = slices(lhs_design(spark, space, n)).groupBy("param").agg(F.count("*").alias("n_points"), F.countDistinct("slice").alias("n_slices"), F.min("slice").alias("first_slice"), F.max("slice").alias("last_slice"))
    return points.join(slices(rows).groupBy("param").agg(F.countDistinct("slice").alias("row_slices")), "param")


@query(
    "WITH RECURSIVE v(b, v1, v2) AS (SELECT 0, 1::BIGINT << 31, 1::BIGINT << 31 UNION ALL SELECT b + 1, v1 >> 1, xor(v2, v2 >> 1) FROM v WHERE b < 31), "
    "e AS (SELECT count(*) n, min(l_quantity) l1, max(l_quantity) h1, min(l_extendedprice) l2, max(l_extendedprice) h2 FROM lineitem), "
    "x AS (SELECT i, bit_xor(CASE WHEN (i >> b) & 1 = 1 THEN v1 ELSE 0 END) x1, bit_xor(CASE WHEN (i >> b) & 1 = 1 THEN v2 ELSE 0 END) x2 FROM (SELECT unnest(range(1, n + 1)) i FROM e), v GROUP BY i) "
    "SELECT floor((x1 / 4294967296.0::DOUBLE * (h1 - l1) + l1) * 1000000)::BIGINT l_quantity, floor((x2 / 4294967296.0::DOUBLE * (h2 - l2) + l2) * 1000000)::BIGINT l_extendedprice FROM x, e"
)
def sobol_lineitem(spark, sf_dir):
    """As many Sobol points as lineitem has rows, over its bounds, in millionths (rounding would differ on ties, of which dyadic numbers have many)."""
    rows = table(spark, sf_dir, "lineitem")
    ids = ["l_quantity", "l_extendedprice"]
    return sampler("sobol").sample(rows.count(), spanned(rows, ids), spark=spark).select(*(F.floor(F.col(c) * 1000000.0).cast("bigint").alias(c) for c in ids))


def _nearest_mean(key: str, d: str) -> str:
    return f"SELECT 'distance' kind, '{key}' \"key\", round(avg(score), 6) \"value\" FROM (SELECT min({d}) score FROM part c, part e, st WHERE c.p_brand <> '{EVALUATED}' AND e.p_brand = '{EVALUATED}' GROUP BY c.p_partkey)"


@query(
    "WITH st AS (SELECT stddev_samp(p_size) ss, stddev_samp(p_retailprice) sr, max(p_size) - min(p_size) rs, max(p_retailprice) - min(p_retailprice) rr FROM part) "
    + " UNION ALL ".join((
        _nearest_mean("standardize", _D),
        _nearest_mean("affine", "sqrt(pow((c.p_size - e.p_size) / rs * 2, 2) + pow((c.p_retailprice - e.p_retailprice) / rr * 2, 2))"),
        _nearest_mean("gower", "(abs(c.p_size - e.p_size) / rs + abs(c.p_retailprice - e.p_retailprice) / rr) / 2"),
        "SELECT 'sampler', unnest(['chain', 'conditional', 'gsx', 'kmeans', 'kmedoids', 'relational_kmeans', 'uniform']), least(2, count(*))::DOUBLE FROM (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier)",
    ))
)
def registry_on_tables(spark, sf_dir):
    """Each registered distance by its key: the mean distance of a part to the nearest evaluated one. Each registered sampler of pools: the suppliers among its picks."""
    part, done, rest = _parts(spark, sf_dir)
    told = None
    for key in sorted(DISTANCES):
        one = acq.GSx(key).fit(part, PART).update(done, "y").score(rest).agg(F.lit("distance").alias("kind"), F.lit(key).alias("key"), F.round(F.avg("score"), 6).alias("value"))
        told = one if told is None else told.unionByName(one)
    pool, args = _suppliers(spark, sf_dir), {"chain": {"samplers": [sampler("uniform"), sampler("gsx")]}, "conditional": {"with_pool": sampler("uniform"), "without_pool": sampler("lhs")}}
    for key in sorted(SAMPLERS):
        own = sampler(key, **args.get(key, {}))
        if own.takes_pool:
            picks = semi(own.sample(2, SUPPLIER, pool), pool, SUPPLIER.ids)
            told = told.unionByName(picks.distinct().agg(F.lit("sampler").alias("kind"), F.lit(key).alias("key"), F.count("*").cast("double").alias("value")))
    return told


# --- surrogates, metrics

_NEAR = (
    "WITH st AS (SELECT stddev_samp(s_acctbal) ra, stddev_samp(s_nationkey) rn FROM supplier), pr AS (SELECT c_custkey, s_acctbal * 0.5 + s_nationkey y, row_number() OVER (PARTITION BY c_custkey ORDER BY round(sqrt(pow((c_acctbal - s_acctbal) / ra, 2) + pow((c_nationkey - s_nationkey) / rn, 2)), 9), s_acctbal, s_nationkey) k FROM customer, supplier, st) "
)


def _near(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    archive = table(spark, sf_dir, "supplier").withColumn("y", F.col("s_acctbal") * 0.5 + F.col("s_nationkey"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("s_acctbal"), F.col("c_nationkey").alias("s_nationkey"))
    return archive, asked


@query("SELECT c_acctbal s_acctbal, c_nationkey::BIGINT s_nationkey, round(c_acctbal * 0.5 + c_nationkey, 4) y, count(*) n FROM customer GROUP BY ALL")
def learned_objective(spark, sf_dir):
    """A fitted line of the suppliers as the objective, evaluated on all customers."""
    archive, asked = _near(spark, sf_dir)
    told = Learned(Linear().fit(archive, SUPPLIER, "y"), SUPPLIER, _Y).evaluate(asked.select("s_acctbal", "s_nationkey"))
    return told.groupBy("s_acctbal", F.col("s_nationkey").cast("bigint").alias("s_nationkey"), F.round("y", 4).alias("y")).agg(F.count("*").alias("n"))


@query(_NEAR + "SELECT c_custkey, round(avg(y), 6) mean, round(stddev_samp(y), 6) se FROM pr WHERE k <= 5 GROUP BY ALL")
def surrogate_knn(spark, sf_dir):
    archive, asked = _near(spark, sf_dir)
    return NearestNeighbours(5).fit(archive, SUPPLIER, "y").predict(asked).select("c_custkey", r6("mean"), r6("se"))


@query(_NEAR + "SELECT c_custkey, round(quantile_cont(y, 0.5), 6) mean, round((quantile_cont(y, 0.9) - quantile_cont(y, 0.1)) * 0.5, 6) se FROM pr WHERE k <= 5 GROUP BY ALL")
def quantile_se(spark, sf_dir):
    archive, asked = _near(spark, sf_dir)
    return QuantileNeighbours(5).fit(archive, SUPPLIER, "y").predict(asked).select("c_custkey", r6("mean"), r6("se"))


@query("SELECT q, n n_rows, q share, q share_quantity, q share_discount FROM (SELECT count(*) n FROM lineitem), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(q)")
def quantile_planes(spark, sf_dir):
    """Planes of three quantiles through all of lineitem, and what marks the least loss: the rows below a plane are that share of all rows, also by the sum of each parameter."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    model = LinearQuantiles().fit(rows, Space((p_dbl("l_quantity", 1, 50), p_dbl("l_discount", 0, 1))), "l_extendedprice")
    planes = [F.struct(F.lit(q).alias("q"), (sum((F.lit(float(w)) * F.col(i) for w, i in zip(b[1:], model.ids)), F.lit(float(b[0])))).alias("plane")) for q, b in zip(model.at, model.coef)]
    below = F.col("l_extendedprice") < F.col("p.plane")
    share = lambda x: F.round(F.sum(F.when(below, x).otherwise(0.0)) / F.sum(x), 2)
    told = rows.withColumn("p", F.explode(F.array(*planes))).groupBy("p.q")
    return told.agg(F.count("*").alias("n_rows"), share(F.lit(1.0)).alias("share"), share(F.col("l_quantity")).alias("share_quantity"), share(F.col("l_discount")).alias("share_discount"))


@query("SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, round((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity, 2) mean FROM lineitem")
def surrogate_linear(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    model = Linear().fit(rows, Space((p_dbl("l_quantity", 1, 50),)), "l_extendedprice")
    return model.predict(rows.select("l_orderkey", "l_linenumber", "l_quantity")).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.round("mean", 2).alias("mean"))


@query("SELECT o_orderkey, round((SELECT avg(o_totalprice) FROM orders), 2) mean, round((SELECT stddev_samp(o_totalprice) FROM orders), 2) se FROM orders")
def surrogate_constant(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return Constant().fit(rows, Space((p_dbl("o_totalprice"),)), "o_totalprice").predict(rows.select("o_orderkey")).select("o_orderkey", F.round("mean", 2).alias("mean"), F.round("se", 2).alias("se"))


_B = 5


@query(
    "WITH s AS (SELECT s_acctbal y, row_number() OVER (ORDER BY s_acctbal, s_nationkey, s_suppkey) - 1 place, count(*) OVER () n FROM supplier), "
    f"d AS (SELECT b, ('0x' || substr(md5('1:' || b || ':' || j), 1, 12))::BIGINT % (SELECT max(n) FROM s) place FROM range(0, {_B}) t(b), range(0, (SELECT max(n) FROM s)) u(j)), "
    "m AS (SELECT b, avg(y) mean FROM d JOIN s USING (place) GROUP BY b) SELECT round(avg(mean), 6) mean, round(stddev_samp(mean), 6) se FROM m"
)
def bootstrap_se(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_acctbal", "s_nationkey", F.col("s_acctbal").alias("y"))
    return Bootstrap(Constant, _B).fit(s, SUPPLIER, "y").predict(spark.range(1)).select(r6("mean"), r6("se"))


_SLOTS = "d AS (SELECT b, ('0x' || substr(md5('1:' || b || ':' || j), 1, 12))::BIGINT % (SELECT max(n) FROM s) place FROM range(0, {}) t(b), range(0, (SELECT max(n) FROM s)) u(j))"


@query(
    f"WITH s AS (SELECT l_quantity x, l_extendedprice y, row_number() OVER (ORDER BY l_quantity, l_extendedprice) - 1 place, count(*) OVER () n FROM lineitem), {_SLOTS.format(_B)}, "
    "m AS (SELECT b, regr_intercept(y, x) c, regr_slope(y, x) w FROM d JOIN s USING (place) GROUP BY b) "
    "SELECT x l_quantity, round(avg(c + w * x), 3) mean, round(stddev_samp(c + w * x), 3) se FROM m, (SELECT DISTINCT l_quantity x FROM lineitem) GROUP BY x"
)
def bootstrap_linear(spark, sf_dir):
    """Lines through resamples of all of lineitem, fitted together."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model = Bootstrap(Linear, _B).fit(rows, Space((p_dbl("l_quantity", 1, 50),)), "l_extendedprice")
    return model.predict(rows.select("l_quantity").distinct()).select("l_quantity", F.round("mean", 3).alias("mean"), F.round("se", 3).alias("se"))


@query(
    f"WITH s AS (SELECT s_acctbal, s_nationkey, s_acctbal * 0.5 + s_nationkey y, row_number() OVER (ORDER BY s_acctbal, s_nationkey, s_acctbal * 0.5 + s_nationkey) - 1 place, count(*) OVER () n FROM supplier), {_SLOTS.format(3)}, "
    "r AS (SELECT * FROM d JOIN s USING (place)), st AS (SELECT b, stddev_samp(s_acctbal) ra, stddev_samp(s_nationkey) rn FROM r GROUP BY b), "
    "k AS (SELECT b, c_custkey, y, row_number() OVER (PARTITION BY b, c_custkey ORDER BY round(sqrt(pow((c_acctbal - s_acctbal) / ra, 2) + pow((c_nationkey - s_nationkey) / rn, 2)), 9), s_acctbal, s_nationkey) k FROM customer, r JOIN st USING (b)), "
    "m AS (SELECT b, c_custkey, avg(y) y FROM k WHERE k <= 3 GROUP BY ALL) SELECT c_custkey, round(avg(y), 6) mean, round(stddev_samp(y), 6) se FROM m GROUP BY ALL"
)
def bootstrap_knn(spark, sf_dir):
    archive, asked = _near(spark, sf_dir)
    model = Bootstrap(lambda: NearestNeighbours(3), 3).fit(archive.select("s_acctbal", "s_nationkey", "y"), SUPPLIER, "y")
    return model.predict(asked).select("c_custkey", r6("mean"), r6("se"))


@query("SELECT l_suppkey, round(avg(l_discount), 6) mean, round(sqrt(avg(l_tax) + coalesce(var_samp(l_discount), 0)), 6) se FROM lineitem GROUP BY ALL")
def total_variance(spark, sf_dir):
    return ensemble_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_tax").select("l_suppkey", r6("mean"), r6("se"))


@query()
def surrogate_tree(spark, sf_dir):
    archive, asked = _near(spark, sf_dir)
    return Trees().fit(archive, SUPPLIER, "y").predict(asked).select("c_custkey", r6("mean"))


@query("SELECT min(o_totalprice) best_y, max(o_totalprice) worst_y, min(o_totalprice) - 1000 regret FROM orders")
def metrics_best_worst_regret(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"))
    return spark.createDataFrame([(M.best_y(rows), M.worst_y(rows), M.regret(rows, optimum=1000.0))], "best_y double, worst_y double, regret double").select("best_y", "worst_y", "regret")


@query(
    "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a, avg(l_extendedprice) c FROM lineitem) "
    "SELECT round(sqrt(avg(pow(a + b * l_quantity - l_extendedprice, 2))), 4) rmse, round(avg(abs(a + b * l_quantity - l_extendedprice)), 4) mae, round(1 - sum(pow(a + b * l_quantity - l_extendedprice, 2)) / sum(pow(l_extendedprice - c, 2)), 6) r2 FROM lineitem, m"
)
def metrics_model_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("y"))
    model = Linear().fit(rows, Space((p_dbl("l_quantity", 1, 50),)), "y")
    got = (M.model_rmse(rows, model, rows), M.model_mae(rows, model, rows), M.model_r2(rows, model, rows))
    return spark.createDataFrame([got], "rmse double, mae double, r2 double").select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), r6("r2"))


@query(_NEAR + ", v AS (SELECT c_custkey, var_samp(y) v FROM pr WHERE k <= 5 GROUP BY ALL) SELECT round(avg(v), 2) mean_variance, round(max(v), 2) max_variance, round(avg(v) / 1000 * 264000 / 1000, 2) integrated FROM v".replace(") , v", "), v"))
def metrics_variance(spark, sf_dir):
    archive, asked = _near(spark, sf_dir)
    model = NearestNeighbours(5).fit(archive, SUPPLIER, "y")
    mean, most, whole = M.variances(archive, model, SUPPLIER, asked)
    return spark.createDataFrame([(mean, most, whole / 1e6)], "a double, b double, c double").select(F.round("a", 2).alias("mean_variance"), F.round("b", 2).alias("max_variance"), F.round("c", 2).alias("integrated"))


@query("WITH d AS (SELECT event_type, date_trunc('day', ts) batch, min(value) lo, max(value) hi, count(*) n FROM events GROUP BY ALL) SELECT event_type, strftime(batch, '%Y-%m-%d') batch, min(lo) OVER w best_y, max(hi) OVER w worst_y, (sum(n) OVER w)::BIGINT n_evals FROM d WINDOW w AS (PARTITION BY event_type ORDER BY batch)")
def metrics_history_cumulative(spark, sf_dir):
    from pyspark.sql import Window

    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    return days.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("batch"), F.min("lo").over(w).alias("best_y"), F.max("hi").over(w).alias("worst_y"), F.sum("n").over(w).alias("n_evals"))


@query(
    "WITH st AS (SELECT stddev_samp(s_acctbal) ra, stddev_samp(s_nationkey) rn FROM supplier), pr AS (SELECT c_custkey, s_suppkey, round(sqrt(pow((c_acctbal - s_acctbal) / ra, 2) + pow((c_nationkey - s_nationkey) / rn, 2)), 9) d FROM customer, supplier, st), "
    "kn AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) k FROM pr) SELECT c_custkey, k, s_suppkey, round(d, 6) distance FROM kn WHERE k <= 3"
)
def nearest_by_pivots(spark, sf_dir):
    """The three nearest suppliers of every customer, by balls that the triangle inequality leaves."""
    archive, asked = _near(spark, sf_dir)
    d = Standardize().fit(archive, SUPPLIER)
    got = nearest(asked, d.coordinates(), archive.withColumn("place", F.col("s_suppkey")), d.coordinates(), 3, ("place",), True)
    rows = got.select("c_custkey", F.posexplode("near").alias("k", "x"))
    return rows.select("c_custkey", (F.col("k") + 1).cast("bigint").alias("k"), F.col("x.place").cast("bigint").alias("s_suppkey"), r6("x.d", "distance"))


_WHERE = Space((p_dbl("c_acctbal", -1000, 10000), p_int("c_nationkey", 0, 24)))


@query(
    "WITH p AS (SELECT DISTINCT c_acctbal, c_nationkey FROM customer), st AS (SELECT (max(c_acctbal) - min(c_acctbal)) / 2 ra, (max(c_nationkey) - min(c_nationkey)) / 2.0 rn FROM p), "
    "pr AS (SELECT x.c_acctbal, x.c_nationkey, sqrt(pow((x.c_acctbal - y.c_acctbal) / ra, 2) + pow((x.c_nationkey - y.c_nationkey) / rn, 2)) d FROM p x, p y, st WHERE (x.c_acctbal, x.c_nationkey) <> (y.c_acctbal, y.c_nationkey)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY c_acctbal, c_nationkey ORDER BY d) n FROM pr), q AS (SELECT c_acctbal, c_nationkey, pow(avg(d), 2) m FROM k WHERE n <= 2 GROUP BY ALL) "
    "SELECT c_acctbal, c_nationkey, round(CASE WHEN m > 0 THEN (SELECT min(m) FROM q WHERE m > 0) / m ELSE 1 END, 6) density FROM q"
)
def customer_density(spark, sf_dir):
    """The density of all customers, by nearest neighbours within the table itself."""
    pool = table(spark, sf_dir, "customer")
    return acq.density(pool, Affine().fit(pool, _WHERE), _WHERE).select("c_acctbal", "c_nationkey", r6("density"))


_QUANTITY = Space((p_dbl("l_quantity", 1, 50), p_dbl("l_discount", 0, 0.1)))
_CORNERS = [(0.0, 0.0), (0.0, 1.0), (0.5, 0.5), (1.0, 0.0), (1.0, 1.0)]


def _matern(z: str) -> str:
    r = f"sqrt(5 * (pow((a - {z}.a) / 0.5, 2) + pow((b - {z}.b) / 0.8, 2)))"
    return f"(1 + {r} + {r} * {r} / 3) * exp(-{r})"


@query(
    f"""WITH x AS (SELECT (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) a, (l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()) b,
            (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () y FROM lineitem),
        p AS (SELECT a, b, count(*) n, sum(y) sy FROM x GROUP BY ALL), z AS (FROM (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_CORNERS))}) v(i, a, b)),
        k AS (SELECT z.i, p.a, p.b, n, sy, {_matern('z').replace('(a -', '(p.a -').replace('(b -', '(p.b -')} k FROM p, z)
        SELECT u.i::BIGINT i, v.i::BIGINT j, round(sum(u.n * u.k * v.k), 4) products, round(sum(CASE WHEN u.i = v.i THEN u.sy * u.k ELSE 0 END), 4) told FROM k u JOIN k v ON u.a = v.a AND u.b = v.b GROUP BY ALL"""
)
def gp_normal_sums(spark, sf_dir):
    """What a Gaussian process reads of all rows: sums of products of kernel values with five inducing points, and of those with the target."""
    import numpy as np

    points = GaussianProcess()._prepared(table(spark, sf_dir, "lineitem"), _QUANTITY, "l_extendedprice").withColumn("noise", F.lit(1.0))
    got = normal_sums(points, np.array(_CORNERS), [np.array([0.5, 0.8])], Kernel(), slopes=False)[0]
    rows = [(i, j, float(got.a[i, j]), float(got.b[i]) if i == j else 0.0) for i in range(len(_CORNERS)) for j in range(len(_CORNERS))]
    return spark.createDataFrame(rows, "i bigint, j bigint, products double, told double").select("i", "j", F.round("products", 4).alias("products"), F.round("told", 4).alias("told"))


@query()
def surrogate_gp(spark, sf_dir):
    """Prices of all line items by quantity and discount, from a process on all of them."""
    items = table(spark, sf_dir, "lineitem")
    model = GaussianProcess(inducing=60, steps=6).fit(items, _QUANTITY, "l_extendedprice")
    return model.predict(items.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")).select("l_orderkey", "l_linenumber", "mean", "se")


@query()
def surrogate_het_gp(spark, sf_dir):
    """The same with noise that depends on the place: prices spread more with the quantity."""
    items = table(spark, sf_dir, "lineitem")
    model = HeteroskedasticProcess(inducing=60, steps=4, rounds=1).fit(items, _QUANTITY, "l_extendedprice")
    return model.predict(items.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")).select("l_orderkey", "l_linenumber", "mean", "se")


@query("SELECT l_returnflag, round(avg((l_quantity BETWEEN l_discount * 100 AND 40)::INT), 6) coverage, round(avg(40 - l_discount * 100 + CASE WHEN l_quantity < l_discount * 100 THEN (l_discount * 100 - l_quantity) * 20 WHEN l_quantity > 40 THEN (l_quantity - 40) * 20 ELSE 0 END), 6) winkler FROM lineitem GROUP BY ALL")
def metrics_intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("lower", F.col("l_discount") * 100).withColumn("upper", F.lit(40.0))
    return rows.groupBy("l_returnflag").agg(r6(M.interval_coverage("l_quantity"), "coverage"), r6(M.winkler_score("l_quantity"), "winkler"))


@query("SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.75 THEN 'train' ELSE 'test' END \"role\" FROM orders")
def resample_holdout(spark, sf_dir):
    return holdout(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.75, 3)


@query(
    "WITH m AS (SELECT event_id, day(ts)::BIGINT d, max(day(ts)) OVER () z FROM events), f AS (SELECT *, z - k * 3 hi FROM m, range(0, 3) t(k)) "
    "SELECT k::BIGINT fold, CASE WHEN d > hi - 3 THEN 'test' ELSE 'train' END \"role\", count(*) n, min(d) first_day, max(d) last_day FROM f WHERE d <= hi AND d > hi - 3 - 7 GROUP BY ALL"
)
def resample_rolling(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").cast("bigint").alias("d"))
    folds = window_folds(days, "d", 3, 3, 7)
    return folds.groupBy(F.col("fold").cast("bigint").alias("fold"), "role").agg(F.count("*").alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query("SELECT s_suppkey::BIGINT s_suppkey, CASE WHEN s_acctbal IS NULL THEN 0 ELSE s_acctbal * 2 END y FROM supplier")
def row_function(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    space = Space((p_int("s_suppkey"), p_dbl("s_acctbal")))
    return RowFunction(lambda r: {"y": r.get("s_acctbal", 0) * 2}, space, _Y).evaluate(rows).select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "y")


# --- whole searches over the suppliers


def _search(spark, sf_dir, n) -> Search:
    rows = _suppliers(spark, sf_dir).withColumn("y", F.col("s_acctbal") * 0.5 + F.col("s_nationkey"))
    return Search(Dataset(rows, SUPPLIER, _Y), Evals(n))


def _found(instance: Search) -> DataFrame:
    return instance.rows().select("s_acctbal", F.col("s_nationkey").cast("bigint").alias("s_nationkey"), r6("y"), F.col("batch_nr").cast("bigint").alias("batch_nr"))


def _random_batches(batches: int, size: int) -> str:
    out = "WITH p AS (SELECT DISTINCT s_acctbal, s_nationkey FROM supplier)"
    for k in range(1, batches + 1):
        seen = "".join(f" AND (s_acctbal, s_nationkey) NOT IN (SELECT (s_acctbal, s_nationkey) FROM b{j})" for j in range(1, k))
        out += f", b{k} AS (SELECT * FROM p WHERE true{seen} ORDER BY md5('1:{k}:' || s_acctbal || ':' || s_nationkey), s_acctbal, s_nationkey LIMIT {size})"
    return out


def _random_run(batches: int, size: int) -> str:
    return _random_batches(batches, size) + " " + " UNION ALL ".join(f"SELECT s_acctbal, s_nationkey::BIGINT s_nationkey, round(s_acctbal * 0.5 + s_nationkey, 6) y, {k}::BIGINT batch_nr FROM b{k}" for k in range(1, batches + 1))


@query(_random_run(3, 2))
def pool_random_run(spark, sf_dir):
    instance = _search(spark, sf_dir, 5)
    PoolRandom(batch_size=2).optimize(instance)
    return _found(instance)


@query(
    "WITH p AS (SELECT DISTINCT c_acctbal, c_nationkey FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_nationkey) - 1 place FROM p), "
    "s AS (SELECT b, ('0x' || md5('1:' || b || ':' || id)[1:12])::BIGINT % (SELECT count(*) FROM p) place FROM range(1, 4) r(b), range(0, 500) i(id)) "
    "SELECT b::BIGINT batch_nr, c_acctbal, c_nationkey::BIGINT c_nationkey, count(*) n, round(min(c_acctbal * 0.5 + c_nationkey), 6) y FROM s JOIN o USING (place) GROUP BY ALL"
)
def pool_draws(spark, sf_dir):
    """Three batches of 500 slots from all customers, with replacement within a batch: the pool is sorted and numbered once."""
    pool = table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey").distinct()
    told = PoolFunction(pool, lambda rows: rows.withColumn("y", F.col("c_acctbal") * 0.5 + F.col("c_nationkey")), _WHERE, _Y)
    instance = Search(told, Evals(1500))
    PoolRandom(batch_size=500, replace="within_batches").optimize(instance)
    return instance.rows().groupBy(F.col("batch_nr").cast("bigint").alias("batch_nr"), "c_acctbal", F.col("c_nationkey").cast("bigint").alias("c_nationkey")).agg(F.count("*").alias("n"), F.round(F.min("y"), 6).alias("y"))


_SEQ = _S0.format("p") + _farthest(5, "SELECT s_acctbal, s_nationkey FROM p, st ORDER BY round(pow((s_acctbal - ma) / ra, 2) + pow((s_nationkey - mn) / rn, 2), 9), s_acctbal, s_nationkey LIMIT 1").rpartition(" SELECT s_acctbal, s_nationkey::BIGINT s_nationkey FROM t0")[0]


@query(_SEQ + " " + " UNION ALL ".join(f"SELECT s_acctbal, s_nationkey::BIGINT s_nationkey, round(s_acctbal * 0.5 + s_nationkey, 6) y, {1 + (k + 1) // 2}::BIGINT batch_nr FROM t{k}" for k in range(5)))
def al_gsx_run(spark, sf_dir):
    instance = _search(spark, sf_dir, 5)
    ActiveLearning(P.SequentialReference(acq.GSx()), init=sampler("gsx"), n_init=1, batch_size=2).optimize(instance)
    return _found(instance)


@query(_random_batches(3, 2) + ", h AS (" + " UNION ALL ".join(f"SELECT {k}::BIGINT batch_nr, s_acctbal * 0.5 + s_nationkey y FROM b{k}" for k in range(1, 4)) + ") SELECT b batch_nr, count(*) n_evals, round(min(y), 6) best_y, round(max(y), 6) worst_y FROM range(1, 4) t(b), h WHERE batch_nr <= b GROUP BY ALL")
def tracker_history(spark, sf_dir):
    """The tracker's table over a random search of three batches."""
    log = Tracker({"best_y": M.best_y, "worst_y": M.worst_y})
    optimize_active(_search(spark, sf_dir, 5).objective, n_evals=5, tracker=log, optimizer=PoolRandom(batch_size=2))
    return log.data(spark).select(F.col("batch_nr").cast("bigint").alias("batch_nr"), "n_evals", r6("best_y"), r6("worst_y"))


@query(
    "WITH e AS (SELECT date_trunc('day', ts) d, value y, value * 0.9 + 1 mean FROM events), b AS (SELECT DISTINCT d, dense_rank() OVER (ORDER BY d) batch_nr FROM e) "
    "SELECT batch_nr, (SELECT count(*) FROM e WHERE e.d <= b.d) n_evals, (SELECT round(min(y), 6) FROM e WHERE e.d <= b.d) best_y, (SELECT round(sqrt(avg(pow(y - mean, 2))), 6) FROM e WHERE e.d <= b.d) rmse, (SELECT round(1 - sum(pow(y - mean, 2)) / (var_pop(y) * count(y)), 6) FROM e WHERE e.d <= b.d) r2 FROM b"
)
def tracker_merged(spark, sf_dir):
    """Metrics of all events up to each day, each day's rows read once: states of batches are merged."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("d"), F.col("value").alias("y"), (F.col("value") * 0.9 + 1).alias("mean"))
    log = Tracker({"best_y": M.best_y, "rmse": M.archive_rmse, "r2": M.archive_r2})
    days = [r.d for r in rows.select("d").distinct().orderBy("d").collect()]
    for k, day in enumerate(days, 1):
        log.log_batch(k, rows.where(F.col("d") <= day), batch=rows.where(F.col("d") == day))
    return log.data(spark).select(F.col("batch_nr").cast("bigint").alias("batch_nr"), "n_evals", r6("best_y"), r6("rmse"), r6("r2"))


_SIX = _S0.format("p") + _farthest(6, "SELECT s_acctbal, s_nationkey FROM p, st ORDER BY round(pow((s_acctbal - ma) / ra, 2) + pow((s_nationkey - mn) / rn, 2), 9), s_acctbal, s_nationkey LIMIT 1").rpartition(" SELECT s_acctbal, s_nationkey::BIGINT s_nationkey FROM t0")[0]


@query(_SIX + " " + " UNION ALL ".join(f"SELECT s_acctbal, s_nationkey::BIGINT s_nationkey, round(s_acctbal * 0.5 + s_nationkey, 6) y, {1 + k // 3}::BIGINT batch_nr FROM t{k}" for k in range(6)))
def pool_sample_run(spark, sf_dir):
    instance = _search(spark, sf_dir, 6)
    PoolSample(sampler("gsx"), 3).optimize(instance)
    return _found(instance)


@query()
def al_igs_run(spark, sf_dir):
    instance = _search(spark, sf_dir, 6)
    pool_active_learning("igs", lambda: NearestNeighbours(3), n_init=3).optimize(instance)
    return _found(instance)


@query()
def al_uncertainty_run(spark, sf_dir):
    instance = _search(spark, sf_dir, 6)
    active_learning(NearestNeighbours(3), batch_size=2, method="diversity").optimize(instance)
    return _found(instance)


@query("SELECT * FROM (VALUES ('distance', 'affine'), ('distance', 'gower'), ('distance', 'standardize'), ('sampler', 'chain'), ('sampler', 'conditional'), ('sampler', 'gsx'), ('sampler', 'kmeans'), ('sampler', 'kmedoids'), ('sampler', 'lhs'), ('sampler', 'relational_kmeans'), ('sampler', 'sobol'), ('sampler', 'uniform')) t(kind, \"key\")")
def registry(spark, sf_dir):
    rows = [("distance", k) for k in DISTANCES] + [("sampler", k) for k in SAMPLERS]
    return spark.createDataFrame(rows, "kind string, key string").orderBy("kind", *by_key(["key"]))
