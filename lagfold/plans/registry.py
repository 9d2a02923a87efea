"""The queries of the trajectory engine on the standard tables, and their DuckDB SQL.

Queries are DataFrame plans; the SQL is written on its own, from the definitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagfold.operators import bound, counts, frames, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EV = """ev0 AS (SELECT user_id AS run_id, ts, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS state,
    value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events),
  ev AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS t FROM ev0)"""
HALVES = EV + """,
  hv AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half FROM ev),
  hp AS (SELECT half, state AS i, lead(state) OVER (PARTITION BY run_id, half ORDER BY ts, event_id) AS j FROM hv),
  hc AS (SELECT half, i, j, count(*) AS c FROM hp WHERE j IS NOT NULL GROUP BY ALL),
  hs AS (SELECT half, i, j, sum(c) / 2 AS c FROM (SELECT half, i, j, c FROM hc UNION ALL SELECT half, j, i, c FROM hc) GROUP BY ALL),
  grid AS (SELECT h.half, a.i, b.j FROM (SELECT unnest([0, 1]) AS half) h, (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(5)) AS j) b),
  hd AS (SELECT g.half, g.i, g.j, coalesce(c, 0) AS c FROM grid g LEFT JOIN hs USING (half, i, j)),
  tm AS (SELECT half, i, j, CASE WHEN sum(c) OVER (PARTITION BY half, i) > 0 THEN c / sum(c) OVER (PARTITION BY half, i) ELSE 0 END AS p FROM hd),
  pi AS (SELECT half, i, sum(c) / sum(sum(c)) OVER (PARTITION BY half) AS pi FROM hd GROUP BY half, i),
  pc AS (SELECT half, i, greatest(pi, 1e-12) / sum(greatest(pi, 1e-12)) OVER (PARTITION BY half) AS w FROM pi),
  ens AS (SELECT sum(a.w * ln(a.w / b.w)) AS ensemble FROM pc a JOIN pc b USING (i) WHERE a.half = 0 AND b.half = 1),
  tra AS (SELECT sum(pi.pi * greatest(a.p, 1e-12) * ln(greatest(a.p, 1e-12) / greatest(b.p, 1e-12))) AS transition FROM tm a JOIN tm b USING (i, j) JOIN pi USING (i) WHERE a.half = 0 AND b.half = 1 AND pi.half = 0),
  sup AS (SELECT count(*) = 0 AS support_ok FROM tm a JOIN tm b USING (i, j) WHERE a.half = 0 AND b.half = 1 AND a.p > 1e-12 AND NOT b.p > 1e-12),
  len AS (SELECT count(*) AS length FROM events)"""
COUNTS = EV + """,
  pairs AS (SELECT run_id, state AS i, lead(state) OVER (PARTITION BY run_id ORDER BY t) AS j FROM ev),
  c AS (SELECT i, j, count(*) AS c FROM pairs WHERE j IS NOT NULL GROUP BY ALL),
  s AS (SELECT i, j, sum(c) / 2 AS c FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY ALL)"""
EM = """em AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS t, vec_id, label AS state, [x::DOUBLE for x in embedding[1:63]] AS xyz FROM embeddings),
  atm AS (SELECT t, state, a AS atom, xyz[a * 3 + 1] AS x, xyz[a * 3 + 2] AS y, xyz[a * 3 + 3] AS z FROM em, (SELECT unnest(range(21)) AS a))"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c, digits: int = 6):
    """Rounded, without a negative zero, so that engines that sum in another order agree."""
    return F.round(c, digits) + F.lit(0.0)


def queries() -> dict[str, Query]:
    from lagfold.plans import learned  # noqa: F401  (registers its queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lagfold.plans import learned  # noqa: F401

    return dict(SQL)


# --- rows, order, predicates -------------------------------------------------------------------------------------


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in topology from the events: an element and a residue name for each row."""
    ev = frames.events(spark, sf_dir)
    element = F.when(F.col("k") % 3 == 0, "H").when(F.col("k") % 3 == 1, "C")
    names = F.element_at(F.array(*map(F.lit, ("ala", "HOH", "Na+", "LIG", "Gly"))), F.col("state") + 1)
    return ev.select("event_id", element.alias("element"), names.alias("resname"))


TOPO = EV + """,
  topo AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'C' END AS element, ['ala', 'HOH', 'Na+', 'LIG', 'Gly'][state + 1] AS resname FROM ev)"""


@query("heavy_filter_classify", f"""WITH {TOPO}
SELECT CASE WHEN upper(resname) IN ('ALA', 'GLY') THEN 'protein' WHEN upper(resname) = 'HOH' THEN 'water' WHEN upper(resname) = 'NA+' THEN 'ion' ELSE 'other' END AS class, resname, count(*) AS n
FROM topo WHERE element IS NOT NULL AND element <> 'H' GROUP BY ALL""")
def heavy_filter_classify(spark, d):
    return frames.heavy(topology(spark, d)).groupBy(frames.classify(F.col("resname")).alias("class"), "resname").agg(F.count("*").alias("n"))


@query("selection_probes", f"""WITH {TOPO} SELECT count(*) FILTER (upper(resname) IN ('ALA', 'GLY')) AS protein, count(*) FILTER (upper(resname) = 'HOH') AS water,
count(*) FILTER (upper(resname) <> 'HOH') AS not_water, count(*) FILTER (element IS NOT NULL AND element <> 'H' AND upper(resname) = 'ALA') AS heavy_ala FROM topo""")
def selection_probes(spark, d):
    c = frames.classify(F.col("resname"))
    heavy = F.col("element").isNotNull() & (F.col("element") != "H") & (F.upper("resname") == "ALA")
    return topology(spark, d).agg(*[F.count_if(p).alias(n) for n, p in (("protein", c == "protein"), ("water", c == "water"), ("not_water", c != "water"), ("heavy_ala", heavy))])


@query("stride_decimate", f"WITH {EV} SELECT run_id, t, event_id, CAST(state AS INTEGER) AS state, value FROM ev WHERE t % 10 = 0")
def stride_decimate(spark, d):
    return frames.stride(frames.events(spark, d), 10, number=False).select("run_id", "t", "event_id", "state", "value")


@query("lag_pairs", f"""WITH {EV}, p AS (SELECT run_id, t, CAST(state AS INTEGER) AS state, CAST(lead(state, 5) OVER (PARTITION BY run_id ORDER BY t) AS INTEGER) AS next_state FROM ev)
SELECT * FROM p WHERE next_state IS NOT NULL""")
def lag_pairs(spark, d):
    return counts.lag_pairs(frames.events(spark, d), 5).select("run_id", "t", "state", "next_state")


@query("run_offsets", f"""WITH {EV}, n AS (SELECT run_id, count(*) AS length FROM ev GROUP BY 1)
SELECT run_id, length, CAST(coalesce(sum(length) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM n""")
def run_offsets(spark, d):
    n = frames.events(spark, d).groupBy("run_id").agg(F.count("*").alias("length"))
    return frames.offsets(n, "run_id", "length", "begin").select("run_id", "length", "begin")


@query("block_split", f"""WITH {EV}, b AS (SELECT run_id, ntile(20) OVER (PARTITION BY run_id ORDER BY t) AS block FROM ev)
SELECT run_id, CAST(block AS INTEGER) AS block, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 2""")
def block_split(spark, d):
    ev = frames.events(spark, d).select("run_id", F.ntile(20).over(frames.run_window()).alias("block"))
    return ev.groupBy("run_id", "block").agg(F.count("*").alias("n")).where("n > 2")


@query("dt_median_uniform", f"""WITH {EV}, x AS (SELECT CAST(t AS DOUBLE) * 2.5 AS time, run_id, t FROM ev), f AS (SELECT time - lag(time) OVER (PARTITION BY run_id ORDER BY t) AS dt FROM x),
m AS (SELECT median(dt) AS median_dt FROM f WHERE dt IS NOT NULL)
SELECT median_dt, max(abs(dt - median_dt) - (1e-6 + 1e-5 * abs(median_dt))) <= 0 AS uniform FROM f, m WHERE dt IS NOT NULL GROUP BY 1""")
def dt_median_uniform(spark, d):
    return frames.uniform_dt(frames.events(spark, d).withColumn("time", F.col("t").cast("double") * 2.5), "time")


@query("composition", f"WITH {TOPO} SELECT upper(resname) AS resname, count(*) AS n FROM topo GROUP BY ALL")
def composition(spark, d):
    return topology(spark, d).groupBy(F.upper("resname").alias("resname")).agg(F.count("*").alias("n"))


# --- counts and Markov models ------------------------------------------------------------------------------------


@query("transition_counts", f"WITH {COUNTS} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, c FROM c")
def transition_counts(spark, d):
    return counts.transition_counts(frames.events(spark, d))


@query("counts_multi_lag", f"WITH {EV}, p AS (" + " UNION ALL ".join(f"SELECT {n} AS lag, state AS i, lead(state, {n}) OVER (PARTITION BY run_id ORDER BY t) AS j FROM ev" for n in (1, 2, 5, 10)) + """)
SELECT CAST(lag AS INTEGER) AS lag, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS c FROM p WHERE j IS NOT NULL GROUP BY ALL""")
def counts_multi_lag(spark, d):
    return counts.counts_by_lag(frames.events(spark, d), [1, 2, 5, 10])


@query("counts_union", f"WITH {HALVES} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(sum(c) AS BIGINT) AS c FROM hc GROUP BY ALL")
def counts_union(spark, d):
    c = counts.transition_counts(frames.halves(spark, d), keys=("half",))
    return c.groupBy("i", "j").agg(F.sum("c").alias("c"))


@query("symmetrized_tmatrix", f"WITH {COUNTS} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(c / sum(c) OVER (PARTITION BY i), 9) AS p FROM s")
def symmetrized_tmatrix(spark, d):
    s = counts.symmetrised(counts.transition_counts(frames.events(spark, d)))
    return counts.transition_matrix(s).select("i", "j", F.round("p", 9).alias("p"))


@query("stationary_pi", f"WITH {COUNTS} SELECT CAST(i AS INTEGER) AS i, round(sum(c) / sum(sum(c)) OVER (), 9) AS pi FROM s GROUP BY i")
def stationary_pi(spark, d):
    return counts.stationary(counts.symmetrised(counts.transition_counts(frames.events(spark, d)))).select("i", F.round("pi", 9).alias("pi"))


@query("entropy_rate", f"""WITH {COUNTS}, t AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM s), p AS (SELECT i, sum(c) / sum(sum(c)) OVER () AS pi FROM s GROUP BY i)
SELECT round(-sum(pi * p * log2(p)), 6) AS bits FROM t JOIN p USING (i) WHERE p > 0""")
def entropy_rate(spark, d):
    s = counts.symmetrised(counts.transition_counts(frames.events(spark, d)))
    return counts.entropy_rate(counts.transition_matrix(s), counts.stationary(s)).select(r6(F.col("bits")).alias("bits"))


@query("markov_entropy_bits", f"""WITH {COUNTS}, t AS (SELECT i, c / sum(c) OVER (PARTITION BY i) AS p, c / sum(c) OVER () AS w FROM c)
SELECT round(-sum(w * log2(p)), 6) AS bits FROM t""")
def markov_entropy_bits(spark, d):
    c = counts.transition_counts(frames.events(spark, d))
    p, w = F.col("c") / F.sum("c").over(W.partitionBy("i")), F.col("c") / F.sum("c").over(stats.everything())
    return c.select(p.alias("p"), w.alias("w")).agg(r6(-F.sum(F.col("w") * F.log2("p"))).alias("bits"))


OD_T = """od AS (SELECT o_custkey AS run_id, o_orderdate, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS state FROM orders),
  p AS (SELECT state AS i, lead(state) OVER (PARTITION BY run_id ORDER BY o_orderdate, o_orderkey) AS j FROM od),
  c AS (SELECT i, j, count(*) AS c FROM p WHERE j IS NOT NULL GROUP BY ALL),
  s AS (SELECT i, j, sum(c) / 2 AS c FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY ALL),
  t AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM s)"""


@query("its_three_state", f"""WITH {OD_T}, m AS (SELECT {", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN p ELSE 0 END) AS m{i}{j}" for i in range(3) for j in range(3))} FROM t),
e AS (SELECT m00 + m11 + m22 - 1 AS s, m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20) AS q FROM m),
l AS (SELECT unnest([s / 2 + sqrt(greatest(s * s / 4 - q, 0)), s / 2 - sqrt(greatest(s * s / 4 - q, 0))]) AS l, unnest([1, 2]) AS k FROM e)
SELECT CAST(k AS INTEGER) AS k, round(-1 / ln(least(greatest(l, 1e-12), 0.999999)), 6) AS timescale FROM l""")
def its_three_state(spark, d):
    """Closed form: the two eigenvalues besides 1 have the sum trace - 1 and the product det."""
    t = counts.transition_matrix(counts.symmetrised(counts.transition_counts(frames.orders(spark, d))))
    m = {(i, j): F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("p")).otherwise(0.0)).alias(f"m{i}{j}") for i in range(3) for j in range(3)}
    e = t.agg(*m.values()).select(F.expr("m00 + m11 + m22 - 1").alias("s"), F.expr("m00*(m11*m22-m12*m21) - m01*(m10*m22-m12*m20) + m02*(m10*m21-m11*m20)").alias("q"))
    root = F.sqrt(F.greatest(F.expr("s*s/4 - q"), F.lit(0.0)))
    rows = e.select(F.posexplode(F.array(F.col("s") / 2 + root, F.col("s") / 2 - root)).alias("k", "l"))
    return rows.select((F.col("k") + 1).alias("k"), r6(-1 / F.ln(F.least(F.greatest("l", F.lit(1e-12)), F.lit(0.999999)))).alias("timescale"))


@query("active_set_restrict", f"WITH {COUNTS}, a AS (SELECT i FROM c GROUP BY i HAVING sum(c) > (SELECT 0.9 * avg(n) FROM (SELECT sum(c) AS n FROM c GROUP BY i))) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, c FROM c WHERE i IN (FROM a) AND j IN (FROM a)")
def active_set_restrict(spark, d):
    c = counts.transition_counts(frames.events(spark, d))
    rows = c.groupBy("i").agg(F.sum("c").alias("n"))
    active = rows.withColumn("m", F.avg("n").over(stats.everything())).where("n > 0.9 * m").select(F.col("i").alias("state"))
    return counts.restricted(c, active)


@query("truncate_states", f"WITH {COUNTS} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, c FROM c WHERE i < 3 AND j < 3")
def truncate_states(spark, d):
    return counts.transition_counts(frames.events(spark, d)).where("i < 3 AND j < 3")


@query("bootstrap_counts", f"""WITH {EV}, draw AS (SELECT r AS replicate, (r * 7919 + n * 104729 + 13) % 20 AS pick FROM (SELECT unnest(range(5)) AS r), (SELECT unnest(range(20)) AS n)),
g AS (SELECT DISTINCT run_id, dense_rank() OVER (ORDER BY run_id) - 1 AS nth FROM ev), w AS (SELECT replicate, pick, count(*) AS w FROM draw GROUP BY ALL),
p AS (SELECT run_id, state AS i, lead(state) OVER (PARTITION BY run_id ORDER BY t) AS j FROM ev)
SELECT CAST(replicate AS INTEGER) AS replicate, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(sum(w) AS BIGINT) AS c FROM p JOIN g USING (run_id) JOIN w ON nth % 20 = pick WHERE j IS NOT NULL GROUP BY ALL""")
def bootstrap_counts(spark, d):
    """Counts by bootstrap replicate: runs, in 20 groups, are drawn with replacement; a multiplicity join, no copies."""
    draw = spark.range(100).select((F.col("id") / 20).cast("int").alias("replicate"), ((F.floor(F.col("id") / 20) * 7919 + F.col("id") % 20 * 104729 + 13) % 20).alias("pick"))
    weights = draw.groupBy("replicate", "pick").agg(F.count("*").alias("w"))
    ev = frames.events(spark, d)
    ids = ev.select("run_id").distinct()
    nth = frames.offsets(ids.withColumn("one", F.lit(1).cast("long")), "run_id", "one", "nth").select("run_id", (F.col("nth") % 20).alias("pick"))
    c = counts.lag_pairs(ev, 1).groupBy("run_id", F.col("state").alias("i"), F.col("next_state").alias("j")).agg(F.count("*").alias("c"))
    return c.join(nth, "run_id").join(F.broadcast(weights), "pick").groupBy("replicate", "i", "j").agg(F.sum(F.col("c") * F.col("w")).alias("c"))


# --- the path-space bound ----------------------------------------------------------------------------------------


def models(spark, d):
    c = counts.dense(counts.symmetrised(counts.transition_counts(frames.halves(spark, d), keys=("half",)), ("half",)), 5, ("half",))
    t, pi = counts.transition_matrix(c, ("half",)), counts.stationary(c, ("half",))
    return [x.where(F.col("half") == h).drop("half") for x in (t, pi) for h in (0, 1)]


@query("kinetic_fidelity_report", f"""WITH {HALVES} SELECT round(ensemble, 9) AS ensemble, round(transition, 9) AS transition, round(ensemble + transition, 9) AS two_slice,
round(ensemble + greatest(length - 1, 0) * transition, 6) AS path_kl, CASE WHEN support_ok THEN round(sqrt(greatest(ensemble + transition, 0) / 2), 9) ELSE CAST('inf' AS DOUBLE) END AS pair_bound,
round(sqrt(greatest(ensemble, 0) / 2), 9) AS ensemble_bound, CASE WHEN support_ok THEN round(least(sqrt(greatest(ensemble + greatest(length - 1, 0) * transition, 0) / 2), 1), 9) ELSE 1.0::DOUBLE END AS path_bound,
support_ok, NOT support_ok AS lower_bound FROM ens, tra, sup, len""")
def kinetic_fidelity_report(spark, d):
    """Both halves' counts in one pass over the events, all terms from their one table."""
    length = frames.table(spark, d, "events").agg(F.count("*").alias("length"))
    c = counts.transition_counts(frames.halves(spark, d), keys=("half",))
    r = bound.fidelity_report(bound.fidelity_terms(c, "half", 0, 1, 5), length)
    return r.select(*[c if c in ("support_ok", "lower_bound") else r6(F.col(c), 6 if c == "path_kl" else 9).alias(c) for c in r.columns])


@query("ensemble_kl", f"WITH {HALVES} SELECT round(ensemble, 9) AS ensemble FROM ens")
def ensemble_kl(spark, d):
    _, _, pi_p, pi_q = models(spark, d)
    return bound.ensemble_kl(pi_p, pi_q).select(r6(F.col("ensemble"), 9).alias("ensemble"))


@query("transition_kl", f"WITH {HALVES} SELECT round(transition, 9) AS transition FROM tra")
def transition_kl(spark, d):
    p, q, pi_p, _ = models(spark, d)
    return bound.transition_kl(p, q, pi_p).select(r6(F.col("transition"), 9).alias("transition"))


@query("path_kl", f"WITH {HALVES} SELECT CAST(l AS INTEGER) AS length, round(ensemble + greatest(l - 1, 0) * transition, 6) AS path_kl FROM ens, tra, (SELECT unnest([1, 2, 10, 1000]) AS l)")
def path_kl(spark, d):
    p, q, pi_p, pi_q = models(spark, d)
    one = bound.ensemble_kl(pi_p, pi_q).join(F.broadcast(bound.transition_kl(p, q, pi_p)))
    rows = one.withColumn("length", F.explode(F.array(*map(F.lit, (1, 2, 10, 1000)))))
    return rows.select("length", r6(bound.path_kl(F.col("ensemble"), F.col("transition"), F.col("length"))).alias("path_kl"))


@query("pinsker_bounds", f"WITH {HALVES} SELECT round(sqrt(greatest(ensemble, 0) / 2), 9) AS ensemble_bound, round(sqrt(greatest(ensemble + transition, 0) / 2), 9) AS pair_bound FROM ens, tra")
def pinsker_bounds(spark, d):
    p, q, pi_p, pi_q = models(spark, d)
    one = bound.ensemble_kl(pi_p, pi_q).join(F.broadcast(bound.transition_kl(p, q, pi_p)))
    return one.select(r6(bound.pinsker(F.col("ensemble")), 9).alias("ensemble_bound"), r6(bound.pinsker(F.col("ensemble") + F.col("transition")), 9).alias("pair_bound"))


@query("support_violations", f"""WITH {EV}, f AS (SELECT run_id, t, state * 20 + k // 5 AS state FROM ev), p AS (SELECT run_id % 2 AS half, state AS i, lead(state) OVER (PARTITION BY run_id ORDER BY t) AS j FROM f),
c AS (SELECT DISTINCT half, i, j FROM p WHERE i IS NOT NULL AND j IS NOT NULL)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM c a WHERE half = 0 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.half = 1 AND a.i = b.i AND a.j = b.j)""")
def support_violations(spark, d):
    """Transitions between 100 fine states that even runs have and odd ones lack."""
    fine = frames.events(spark, d).select("run_id", "t", (F.col("state") * 20 + F.expr("k div 5")).cast("int").alias("state"), (F.col("run_id") % 2).alias("half"))
    t = counts.transition_matrix(counts.transition_counts(fine, keys=("half",)).where("i IS NOT NULL AND j IS NOT NULL"), ("half",))
    return bound.support_violations(t.where("half = 0"), t.where("half = 1"))


@query("shuffle_contrast", f"""WITH {EV}, n AS (SELECT run_id, count(*) AS n FROM ev GROUP BY 1),
x AS (SELECT 0 AS kind, run_id, t, state FROM ev UNION ALL SELECT 1, e.run_id, e.t, f.state FROM ev e JOIN n USING (run_id) JOIN ev f ON f.run_id = e.run_id AND f.t = (e.t * 1103515245 + 12345 + e.run_id) % n),
p AS (SELECT kind, state AS i, lead(state) OVER (PARTITION BY kind, run_id ORDER BY t) AS j FROM x)
SELECT CAST(kind AS INTEGER) AS kind, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS c FROM p WHERE j IS NOT NULL GROUP BY ALL""")
def shuffle_contrast(spark, d):
    """Counts of the runs and of a resampling with replacement within each run: frequencies stay, kinetics don't."""
    ev = frames.events(spark, d)
    n = ev.groupBy("run_id").agg(F.count("*").alias("n"))
    pick = ev.join(n, "run_id").select("run_id", "t", ((F.col("t") * 1103515245 + 12345 + F.col("run_id")) % F.col("n")).alias("from"))
    other = pick.join(ev.select("run_id", F.col("t").alias("from"), "state"), ["run_id", "from"])
    both = ev.select(F.lit(0).alias("kind"), "run_id", "t", "state").union(other.select(F.lit(1), "run_id", "t", "state"))
    return counts.transition_counts(both, keys=("kind",))


# --- distributions, quantisation, code lengths ------------------------------------------------------------------


@query("histogram", f"WITH {EV}, h AS (SELECT CASE WHEN value = 100 THEN 19 ELSE CAST(floor(value / 5) AS INTEGER) END AS bin FROM ev WHERE value BETWEEN 0 AND 100) SELECT CAST(b AS INTEGER) AS bin, count(h.bin) AS n FROM (SELECT unnest(range(20)) AS b) LEFT JOIN h ON h.bin = b GROUP BY b")
def histogram(spark, d):
    return stats.histogram(frames.events(spark, d), F.col("value"), 0.0, 100.0, 20)


HIST = HALVES + """,
  hh AS (SELECT half, CASE WHEN value = 100 THEN 19 ELSE CAST(floor(value / 5) AS INTEGER) END AS bin FROM hv WHERE value BETWEEN 0 AND 100),
  hb AS (SELECT h.half, b.bin, count(hh.bin) AS n FROM (SELECT unnest([0, 1]) AS half) h CROSS JOIN (SELECT unnest(range(20)) AS bin) b LEFT JOIN hh ON hh.half = h.half AND hh.bin = b.bin GROUP BY ALL),
  hq AS (SELECT half, bin, greatest(n / sum(n) OVER (PARTITION BY half), 1e-8) AS w FROM hb),
  hr AS (SELECT half, bin, w / sum(w) OVER (PARTITION BY half) AS w FROM hq)"""


@query("histogram_kl", f"WITH {HIST} SELECT round(sum(a.w * ln(a.w / b.w)), 9) AS kl FROM hr a JOIN hr b USING (bin) WHERE a.half = 0 AND b.half = 1")
def histogram_kl(spark, d):
    hv = frames.halves(spark, d)
    h = [stats.histogram(hv.where(F.col("half") == k), F.col("value"), 0.0, 100.0, 20) for k in (0, 1)]
    return stats.histogram_kl(*h).select(r6(F.col("kl"), 9).alias("kl"))


@query("free_energy_profile", f"""WITH {EV}, h AS (SELECT CASE WHEN value = 100 THEN 19 ELSE CAST(floor(value / 5) AS INTEGER) END AS bin FROM ev WHERE value BETWEEN 0 AND 100),
n AS (SELECT b, count(h.bin) AS n FROM (SELECT unnest(range(20)) AS b) LEFT JOIN h ON h.bin = b GROUP BY b)
SELECT CAST(b AS INTEGER) AS bin, round(-ln(greatest(n / (sum(n) OVER () * 5.0), 1e-8)), 6) AS free_energy FROM n""")
def free_energy_profile(spark, d):
    h = stats.histogram(frames.events(spark, d), F.col("value"), 0.0, 100.0, 20)
    return stats.free_energy(h, 5.0).select("bin", r6(F.col("free_energy")).alias("free_energy"))


@query("bounded_observable", f"""WITH {HIST}, g AS (SELECT abs(avg(CASE WHEN half = 0 THEN (value > 50)::INT END) - avg(CASE WHEN half = 1 THEN (value > 50)::INT END)) AS gap FROM hv), k AS (SELECT sqrt(greatest(sum(a.w * ln(a.w / b.w)), 0) / 2) AS bound FROM hr a JOIN hr b USING (bin) WHERE a.half = 0 AND b.half = 1)
SELECT round(gap, 9) AS gap, round(bound, 9) AS bound, gap <= bound + 1e-9 AS ok FROM g, k""")
def bounded_observable(spark, d):
    """The share of high values in both halves differs by no more than the divergence of their histograms allows."""
    hv = frames.halves(spark, d)
    part = lambda h: F.avg(F.when(F.col("half") == h, (F.col("value") > 50).cast("double")))
    kl = stats.histogram_kl(*[stats.histogram(hv.where(F.col("half") == k), F.col("value"), 0.0, 100.0, 20) for k in (0, 1)])
    one = hv.agg(F.abs(part(0) - part(1)).alias("gap")).join(F.broadcast(kl.select(bound.pinsker(F.col("kl")).alias("bound"))))  # one row each
    return one.select(r6(F.col("gap"), 9).alias("gap"), r6(F.col("bound"), 9).alias("bound"), (F.col("gap") <= F.col("bound") + 1e-9).alias("ok"))


@query("percentile_range", f"WITH {EV} SELECT " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{str(p).replace('.', '_')}" for p in (0.005, 0.01, 0.025, 0.5, 0.975, 0.995)) + " FROM ev")
def percentile_range(spark, d):
    ps = (0.005, 0.01, 0.025, 0.5, 0.975, 0.995)
    got = stats.percentiles(frames.events(spark, d), "value", list(ps))
    return spark.range(1).select(*[r6(F.lit(v)).alias(f"p{str(p).replace('.', '_')}") for p, v in zip(ps, got)])


Z = "(value - 50) / 25"


@query("quantize_levels", f"WITH {EV} SELECT event_id, CAST(least(floor((greatest(least({Z}, 3), -3) + 3) / 6 * 64), 63) AS INTEGER) AS level FROM ev")
def quantize_levels(spark, d):
    return frames.events(spark, d).select("event_id", stats.quantise(F.expr(Z), 64, 3.0).alias("level"))


@query("dequantize_mse", f"WITH {EV}, q AS (SELECT {Z} AS z, least(floor((greatest(least({Z}, 3), -3) + 3) / 6 * 64), 63) AS q FROM ev) SELECT round(avg(pow(z - ((q + 0.5) * (6.0 / 64) - 3), 2)), 8) AS mse FROM q")
def dequantize_mse(spark, d):
    z = F.expr(Z)
    return frames.events(spark, d).agg(r6(F.avg(F.pow(z - stats.dequantise(stats.quantise(z, 64, 3.0), 64, 3.0), 2)), 8).alias("mse"))


@query("level_entropy", f"WITH {EV}, q AS (SELECT least(floor((greatest(least({Z}, 3), -3) + 3) / 6 * 64), 63) AS q FROM ev), c AS (SELECT q, count(*) AS c FROM q GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS n, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT c, c / sum(c) OVER () AS p FROM c)")
def level_entropy(spark, d):
    q = frames.events(spark, d).select(stats.quantise(F.expr(Z), 64, 3.0).alias("q"))
    return stats.entropy(q, "q").select("n", r6(F.col("bits")).alias("bits"))


@query("static_gaussian_nll", f"WITH {EV} SELECT round(avg(0.5 * pow({Z}, 2) + 0.5 * ln(2 * pi())), 6) AS nats FROM ev")
def static_gaussian_nll(spark, d):
    return frames.events(spark, d).agg(r6(F.avg(0.5 * F.pow(F.expr(Z), 2) + 0.5 * math.log(2 * math.pi))).alias("nats"))


@query("state_means", f"WITH {EV}, m AS (SELECT state, avg(value) AS v, avg(k) AS k FROM ev GROUP BY 1) SELECT CAST(s AS INTEGER) AS state, round(coalesce(v, 0), 6) AS value, round(coalesce(m.k, 0), 6) AS k FROM (SELECT unnest(range(6)) AS s) LEFT JOIN m ON state = s")
def state_means(spark, d):
    """Mean feature of each of six states; a state without rows has zeros."""
    m = frames.events(spark, d).groupBy("state").agg(F.avg("value").alias("value"), F.avg("k").alias("k"))
    return spark.range(6).select(F.col("id").cast("int").alias("state")).join(m, "state", "left").select("state", *[r6(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("value", "k")])


@query("residual_step", f"WITH {EV} SELECT CAST(b AS INTEGER) AS n_bits, round((stddev_pop(value) + 1e-12) * pow(2, 1 - b) * 3, 6) AS step FROM ev, (SELECT unnest([2, 4, 8]) AS b) GROUP BY b")
def residual_step(spark, d):
    s = frames.events(spark, d).agg(F.stddev_pop("value").alias("sd"))
    rows = s.withColumn("n_bits", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))))
    return rows.select("n_bits", r6((F.col("sd") + 1e-12) * F.pow(F.lit(2.0), 1 - F.col("n_bits")) * 3).alias("step"))


DITHER = "((((event_id * 1103515245 + (12345 + 7919 * 3)) % 2147483648) * 69069 + 1) % 2147483648) / 2147483648.0 - 0.5"


@query("residual_dither_roundtrip", f"""WITH {EV}, q AS (SELECT event_id, value, round_even(value / 0.75 + {DITHER}, 0) AS q, {DITHER} AS u FROM ev)
SELECT event_id, CAST(q AS BIGINT) AS level, round((q - u) * 0.75, 6) AS back, abs((q - u) * 0.75 - value) <= 0.375 + 1e-9 AS within FROM q""")
def residual_dither_roundtrip(spark, d):
    """Subtractive dither: the error stays within half a step; the draw depends on (seed, row) alone."""
    u, step = stats.dither(3, F.col("event_id")), 0.75
    ev = frames.events(spark, d).withColumn("u", u).withColumn("q", F.bround(F.col("value") / step + F.col("u"), 0))
    back = (F.col("q") - F.col("u")) * step
    return ev.select("event_id", F.col("q").cast("long").alias("level"), r6(back).alias("back"), (F.abs(back - F.col("value")) <= step / 2 + 1e-9).alias("within"))


@query("bit_accounting", f"WITH {COUNTS}, n AS (SELECT count(*) AS frames, count(DISTINCT run_id) AS runs FROM ev), t AS (SELECT c, c / sum(c) OVER (PARTITION BY i) AS p FROM c), x AS (SELECT -sum(c * log2(p)) AS s FROM t) SELECT frames, runs, frames * 64 AS original_bits, round(s, 3) AS stream_bits, CAST(25 * 64 AS BIGINT) AS side_bits, round(frames * 64 / (s + 25 * 64), 6) AS ratio FROM x, n")
def bit_accounting(spark, d):
    ev = frames.events(spark, d)
    c = counts.transition_counts(ev).withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy("i")))
    stream = c.agg((-F.sum(F.col("c") * F.log2("p"))).alias("s"))
    n = ev.agg(F.count("*").alias("frames"), F.count_distinct("run_id").alias("runs"))
    return n.join(F.broadcast(stream)).select("frames", "runs", (F.col("frames") * 64).alias("original_bits"), r6(F.col("s"), 3).alias("stream_bits"), F.lit(1600).cast("long").alias("side_bits"), r6(F.col("frames") * 64 / (F.col("s") + 1600)).alias("ratio"))


@query("footprint", "SELECT count(*) AS frames, CAST(12 * 21 * count(*) AS BIGINT) AS raw_bytes, CAST(63 * 63 * 8 AS BIGINT) AS whitening_bytes, 63 > 6000 AS warn FROM embeddings")
def footprint(spark, d):
    return frames.coordinates(spark, d).agg(F.count("*").alias("frames"), (F.count("*") * 12 * 21).alias("raw_bytes"), F.lit(63 * 63 * 8).cast("long").alias("whitening_bytes"), F.lit(63 > 6000).alias("warn"))


@query("quantize_contrast", f"WITH {EM} SELECT CAST(g AS INTEGER) AS decimals, round(avg(pow(v - round_even(v, g::INT), 2)), 9) AS mse FROM (SELECT unnest([x, y, z]) AS v FROM atm), (SELECT unnest([1, 2]) AS g) GROUP BY g")
def quantize_contrast(spark, d):
    v = frames.coordinates(spark, d).select(F.explode("xyz").alias("v"))
    error = lambda g: r6(F.avg(F.pow(F.col("v") - F.bround("v", g), 2)), 9)
    both = v.agg(F.array(*[F.struct(F.lit(g).alias("decimals"), error(g).alias("mse")) for g in (1, 2)]).alias("e"))
    return both.select(F.explode("e").alias("e")).select("e.decimals", "e.mse")


@query("xtc_entropy_rate", f"""WITH {EM}, ct AS (SELECT t, [x - avg(x) OVER (PARTITION BY t), y - avg(y) OVER (PARTITION BY t), z - avg(z) OVER (PARTITION BY t)] AS v FROM atm),
q AS (SELECT CAST(round_even(v * 100, 0) AS BIGINT) AS q FROM (SELECT unnest(v) AS v FROM ct)), c AS (SELECT q, count(*) AS c FROM q GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS n, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT c, c / sum(c) OVER () AS p FROM c)""")
def xtc_entropy_rate(spark, d):
    """Entropy of all coordinates of frames centred on their centroids, on a grid of 1/100."""
    from lagfold.plans.benchmark import centred

    q = centred(frames.coordinates(spark, d)).select(F.explode("centred").alias("v")).select(F.bround(F.col("v") * 100, 0).cast("long").alias("q"))
    return stats.entropy(q, "q").select("n", r6(F.col("bits")).alias("bits"))


# --- nearest neighbours, weights, reconstruction -----------------------------------------------------------------

CENTRES = "ce AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS state, unnest([10.0, 30.0, 55.0, 85.0])::DOUBLE AS value, unnest([5.0, 40.0, 60.0, 20.0])::DOUBLE AS k)"


def centres(spark):
    return spark.createDataFrame([(0, 10.0, 5.0), (1, 30.0, 40.0), (2, 55.0, 60.0), (3, 85.0, 20.0)], "state int, value double, k double")


def assigned(spark, d):
    return stats.nearest(frames.events(spark, d).withColumn("k", F.col("k").cast("double")), centres(spark), ["value", "k"])


@query("nearest_center", f"WITH {EV}, {CENTRES}, r AS (SELECT event_id, c.state, row_number() OVER (PARTITION BY event_id ORDER BY (e.value - c.value) * (e.value - c.value) + (e.k - c.k) * (e.k - c.k), c.state) AS n FROM ev e, ce c) SELECT event_id, state FROM r WHERE n = 1")
def nearest_center(spark, d):
    return assigned(spark, d).select("event_id", "state")


NEAR = EV + f""", {CENTRES}, r AS (SELECT e.run_id, e.t, e.event_id, e.value, e.k, c.state, (e.value - c.value) * (e.value - c.value) + (e.k - c.k) * (e.k - c.k) AS d2, row_number() OVER (PARTITION BY event_id ORDER BY (e.value - c.value) * (e.value - c.value) + (e.k - c.k) * (e.k - c.k), c.state) AS n FROM ev e, ce c),
  nr AS (SELECT * FROM r WHERE n = 1)"""


@query("voronoi_weights", f"WITH {NEAR} SELECT ce.state, round(count(nr.state) / sum(count(nr.state)) OVER (), 9) AS weight FROM ce LEFT JOIN nr USING (state) GROUP BY 1")
def voronoi_weights(spark, d):
    return stats.cell_weights(assigned(spark, d), centres(spark)).select("state", r6(F.col("weight"), 9).alias("weight"))


@query("ensemble_average", f"WITH {NEAR}, w AS (SELECT ce.state, ce.value, count(nr.state) AS n FROM ce LEFT JOIN nr USING (state) GROUP BY ALL) SELECT round(sum(value * n) / sum(n), 6) AS average FROM w")
def ensemble_average(spark, d):
    w = stats.cell_weights(assigned(spark, d), centres(spark)).join(F.broadcast(centres(spark)), "state")
    return w.agg(r6(stats.weighted_average(F.col("value"), F.col("weight"))).alias("average"))


@query("medoid_per_state", f"WITH {NEAR}, m AS (SELECT state, run_id, t, d2, row_number() OVER (PARTITION BY state ORDER BY d2, run_id, t) AS q FROM nr) SELECT state, run_id, t, round(d2, 6) AS d2 FROM m WHERE q = 1")
def medoid_per_state(spark, d):
    return stats.medoids(assigned(spark, d), centres(spark), ["value", "k"]).select("state", "run_id", "t", r6(F.col("d2")).alias("d2"))


@query("kept_override", f"WITH {NEAR} SELECT run_id, t, round(CASE WHEN t % 7 = 0 THEN nr.value ELSE ce.value END, 6) AS value FROM nr JOIN ce USING (state)")
def kept_override(spark, d):
    """A frame is its state's centre, but kept frames (every seventh) are themselves."""
    a = assigned(spark, d)
    kept = a.where("t % 7 = 0").select("run_id", "t", F.col("value").alias("own"))
    rep = a.select("run_id", "t", "state").join(F.broadcast(centres(spark)), "state")
    return rep.join(kept, ["run_id", "t"], "left").select("run_id", "t", r6(F.coalesce("own", "value")).alias("value"))


@query("empty_state_fallback", f"WITH {NEAR}, oc AS (SELECT ce.* FROM ce WHERE state IN (SELECT state FROM nr WHERE k < 30)), fb AS (SELECT e.state, o.state AS used, row_number() OVER (PARTITION BY e.state ORDER BY pow(e.value - o.value, 2) + pow(e.k - o.k, 2), o.state) AS n FROM ce e, oc o) SELECT state, used FROM fb WHERE n = 1")
def empty_state_fallback(spark, d):
    """Only frames with k below 30 are kept, so some states have none: each state uses the nearest that has."""
    there = assigned(spark, d).where("k < 30").select("state").distinct()
    occupied = centres(spark).join(there, "state", "left_semi")
    return stats.nearest(centres(spark).withColumnRenamed("state", "own"), occupied, ["value", "k"]).select(F.col("own").alias("state"), F.col("state").alias("used"))


@query("fps_select", f"WITH RECURSIVE {EV}, x AS (SELECT DISTINCT value FROM ev), f(n, value, picked) AS (SELECT 0, (SELECT min(value) FROM x), [(SELECT min(value) FROM x)] UNION ALL SELECT n + 1, b.value, list_append(picked, b.value) FROM f, LATERAL (SELECT x.value FROM x ORDER BY list_min(list_transform(f.picked, lambda p: abs(p - x.value))) DESC, x.value LIMIT 1) b WHERE n < 5) SELECT CAST(n AS INTEGER) AS n, value FROM f")
def fps_select(spark, d):
    """Farthest-point sampling of the distinct values from the smallest one; a pass per pick, ties to the smaller."""
    x = frames.events(spark, d).select("value").distinct()
    picked = [x.agg(F.min("value")).first()[0]]
    for _ in range(5):
        gap = F.array_min(F.array(*[F.abs(F.col("value") - p) for p in picked]))
        picked.append(x.agg(F.max_by("value", F.struct(gap, -F.col("value")))).first()[0])
    return spark.createDataFrame(list(enumerate(picked)), "n int, value double")


# --- geometry ----------------------------------------------------------------------------------------------------


@query("rmsf_per_atom", f"WITH {EM} SELECT CAST(atom AS INTEGER) AS atom, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rmsf FROM atm GROUP BY atom")
def rmsf_per_atom(spark, d):
    return stats.rmsf(frames.atoms(frames.coordinates(spark, d))).select("atom", r6(F.col("rmsf")).alias("rmsf"))


@query("pair_distances", f"WITH {EM} SELECT CAST(a.atom AS INTEGER) AS i, CAST(b.atom AS INTEGER) AS j, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) AS mean_d FROM atm a JOIN atm b USING (t) WHERE b.atom - a.atom >= 3 GROUP BY ALL")
def pair_distances(spark, d):
    p = stats.pair_distances(frames.coordinates(spark, d), 3)
    return p.groupBy("i", "j").agg(r6(F.avg("d")).alias("mean_d"))


@query("min_interatomic", f"WITH {EM} SELECT a.t, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) AS d FROM atm a JOIN atm b USING (t) WHERE b.atom > a.atom GROUP BY a.t")
def min_interatomic(spark, d):
    return stats.min_distances(frames.coordinates(spark, d)).select("t", r6(F.col("d")).alias("d"))


@query("steric_check", f"WITH {EM}, q AS (SELECT t, atom, round_even(x, 1) AS x, round_even(y, 1) AS y, round_even(z, 1) AS z FROM atm), o AS (SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM atm a JOIN atm b USING (t) WHERE b.atom > a.atom GROUP BY a.t), r AS (SELECT min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d FROM q a JOIN q b USING (t) WHERE b.atom > a.atom GROUP BY a.t), s AS (SELECT (SELECT quantile_cont(d, 0.01) FROM o) AS original, (SELECT quantile_cont(d, 0.01) FROM r) AS rebuilt) SELECT round(original, 6) AS original, round(rebuilt, 6) AS rebuilt, rebuilt >= 0.9 * original AS ok FROM s")
def steric_check(spark, d):
    a = frames.coordinates(spark, d)
    rebuilt = a.withColumn("xyz", F.transform("xyz", lambda x: F.bround(x, 1)))
    got = [stats.percentiles(stats.min_distances(x), "d", [0.01])[0] for x in (a, rebuilt)]
    one = spark.range(1).select(F.lit(got[0]).alias("original"), F.lit(got[1]).alias("rebuilt"))
    return one.select(r6(F.col("original")).alias("original"), r6(F.col("rebuilt")).alias("rebuilt"), (F.col("rebuilt") >= 0.9 * F.col("original")).alias("ok"))


@query("rmsd_centered", f"WITH {EM}, m AS (SELECT t, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM atm GROUP BY t), c AS (SELECT atm.t, atom, x - mx AS x, y - my AS y, z - mz AS z FROM atm JOIN m USING (t)) SELECT a.t, round(sqrt(avg(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) AS rmsd FROM c a JOIN c b ON a.atom = b.atom AND b.t = 0 GROUP BY a.t")
def rmsd_centered(spark, d):
    """Distance of each centred frame to the first one (no rotation)."""
    a = frames.atoms(frames.coordinates(spark, d))
    w = W.partitionBy("run_id", "t")
    c = a.withColumns({x: F.col(x) - F.avg(x).over(w) for x in "xyz"})
    ref = c.where("t = 0").select("atom", *[F.col(x).alias(f"r{x}") for x in "xyz"])
    d2 = sum((F.pow(F.col(x) - F.col(f"r{x}"), 2) for x in "xyz"), F.lit(0.0))
    return c.join(F.broadcast(ref), "atom").groupBy("t").agg(r6(F.sqrt(F.avg(d2))).alias("rmsd"))


@query("covariance_lagged", f"WITH {EV}, m AS (SELECT avg(value) AS mv, avg(k) AS mk FROM ev), p AS (SELECT value, k, lead(value) OVER w AS nv, lead(k) OVER w AS nk FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY t)) SELECT round(avg((value - mv) * (nv - mv)), 6) AS vv, round(avg((value - mv) * (nk - mk)), 6) AS vk, round(avg((k - mk) * (nv - mv)), 6) AS kv, round(avg((k - mk) * (nk - mk)), 6) AS kk, count(*) AS n FROM p, m WHERE nv IS NOT NULL")
def covariance_lagged(spark, d):
    """By the operator's moments of the arrays (value, k)."""
    import numpy as np

    from lagfold.operators import geometry

    ev = pairs_of(spark, d)
    whole, lagged = geometry.moments(ev), geometry.moments(counts.lag_pairs(ev, 1, columns=("x",)), "x", "next_x", only=("xy",))
    m, n = whole[1] / whole[0], lagged[0]
    c = lagged[4] / n - np.outer(lagged[1] / n, m) - np.outer(m, lagged[2] / n) + np.outer(m, m)
    return spark.createDataFrame([(*(round(float(v), 6) + 0.0 for v in c.ravel()), n)], "vv double, vk double, kv double, kk double, n long")


def pairs_of(spark, d):
    """Events as frames of the array (value, k)."""
    from lagfold.shipping import ship

    ship(spark)
    return frames.events(spark, d).select("run_id", "t", F.array(F.col("value"), F.col("k").cast("double")).alias("x"))


@query("tica_2d", f"WITH {EV}, m AS (SELECT avg(value) AS mv, avg(k) AS mk FROM ev), z AS (SELECT avg(pow(value - mv, 2)) + 1e-9 AS a, avg((value - mv) * (k - mk)) AS b, avg(pow(k - mk, 2)) + 1e-9 AS c FROM ev, m), p AS (SELECT value - mv AS v, k - mk AS k, lead(value) OVER w - mv AS nv, lead(k) OVER w - mk AS nk FROM ev, m WINDOW w AS (PARTITION BY run_id ORDER BY t)), l AS (SELECT avg(v * nv) AS d, (avg(v * nk) + avg(k * nv)) / 2 AS e, avg(k * nk) AS f FROM p WHERE nv IS NOT NULL), t AS (SELECT (c * d - 2 * b * e + a * f) / (a * c - b * b) AS tr, (d * f - e * e) / (a * c - b * b) AS det FROM z, l) SELECT round(tr / 2 + sqrt(tr * tr / 4 - det), 6) AS first, round(tr / 2 - sqrt(tr * tr / 4 - det), 6) AS second FROM t")
def tica_2d(spark, d):
    """The two eigenvalues of the model fitted to (value, k) at lag 1."""
    from lagfold.operators import geometry

    values = geometry.Tica(1, 2).fit(pairs_of(spark, d)).values
    return spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in values)], "first double, second double")


@query("whitening_2d", f"WITH {EV} SELECT round((var_samp(value) + var_samp(k)) / 2 + sqrt(pow((var_samp(value) - var_samp(k)) / 2, 2) + pow(covar_samp(value, k), 2)), 6) AS first, round((var_samp(value) + var_samp(k)) / 2 - sqrt(pow((var_samp(value) - var_samp(k)) / 2, 2) + pow(covar_samp(value, k), 2)), 6) AS second FROM ev")
def whitening_2d(spark, d):
    """The variances along the axes of the whitening fitted to (value, k)."""
    from lagfold.operators import geometry

    w = geometry.Whitening.fit(pairs_of(spark, d)).w
    return spark.createDataFrame([tuple(round(float(1 / (c @ c) - 1e-9), 6) for c in w.T)], "first double, second double")


# --- kernels on the driver, Arrow groups, learned cells ----------------------------------------------------------


def event_counts(spark, d, lag: int = 1):
    from lagfold.functions import kinetics

    return kinetics.dense_counts(counts.transition_counts(frames.events(spark, d), lag).collect(), 5)  # 25 rows


@query("range_coder_roundtrip", f"WITH {EV} SELECT run_id, count(*) AS n, true AS ok FROM ev GROUP BY 1")
def range_coder_roundtrip(spark, d):
    from lagfold.operators import coding
    from lagfold.shipping import ship

    ship(spark)
    ev = frames.events(spark, d)
    t, pi = coding.markov_model(ev, 5)
    back = coding.decode_runs(coding.encode_runs(ev, t, pi), t, pi).select("run_id", "t", F.col("state").alias("got"))
    both = ev.select("run_id", "t", "state").join(back, ["run_id", "t"], "full")
    return both.groupBy("run_id").agg(F.count("*").alias("n"), F.bool_and(F.col("state").eqNullSafe(F.col("got"))).alias("ok"))


@query("iid_coder_roundtrip", f"WITH {EV} SELECT run_id, count(*) AS n, true AS ok FROM ev GROUP BY 1")
def iid_coder_roundtrip(spark, d):
    from lagfold.operators import coding
    from lagfold.shipping import ship

    ship(spark)
    q = frames.events(spark, d).select("run_id", "t", stats.quantise(F.expr(Z), 64, 3.0).alias("level"))
    back = coding.decode_levels(coding.encode_levels(q, 64, 3.0), 64, 3.0).select("run_id", "t", F.col("level").alias("got"))
    return q.join(back, ["run_id", "t"], "full").groupBy("run_id").agg(F.count("*").alias("n"), F.bool_and(F.col("level").eqNullSafe(F.col("got"))).alias("ok"))


@query("predictive_roundtrip", f"WITH {EV} SELECT run_id, count(*) AS n, true AS ok FROM ev GROUP BY 1")
def predictive_roundtrip(spark, d):
    """Closed-loop coding keeps every value within one step."""
    from lagfold.operators import coding
    from lagfold.shipping import ship

    ship(spark)
    z = frames.events(spark, d).select("run_id", "t", F.expr(Z).alias("z"))
    back = coding.predictive_back(coding.predictive_levels(z, 0.1, 8.0, 13), 0.1, 8.0, 13)
    ok = F.abs(F.col("back") - F.col("z")) <= 8 * 16.0 / 8192
    return z.join(back, ["run_id", "t"]).groupBy("run_id").agg(F.count("*").alias("n"), F.bool_and(ok).alias("ok"))


@query("kabsch_rmsd")
def kabsch_rmsd(spark, d):
    from lagfold.operators import geometry
    from lagfold.shipping import ship

    ship(spark)
    return geometry.kabsch(frames.coordinates(spark, d)).select("t", r6(F.col("rmsd")).alias("rmsd"))


@query("kmeans_msm")
def kmeans_msm(spark, d):
    """Contacts, slow modes, k-means and the counts of the cells."""
    from lagfold.operators import geometry
    from lagfold.shipping import ship

    ship(spark)
    from lagfold.operators.tables import dropped, written

    raw = written(geometry.contacts(frames.coordinates(spark, d)).select("run_id", "t", "x"))
    x = written(geometry.Standard.fit(raw).transform(raw).select("run_id", "t", "z"))
    cv = written(geometry.Tica(1, 2).fit(x, "z").transform(x, "z").select("run_id", "t", "cv"))
    dropped(raw, x)
    cells, _ = geometry.discretise(cv, 8)
    return counts.transition_counts(cells)


@query("reversible_mle")
def reversible_mle(spark, d):
    from lagfold.functions import kinetics

    t, act = kinetics.reversible_mle(event_counts(spark, d))
    return spark.createDataFrame([(int(act[i]), int(act[j]), round(float(t[i, j]), 6)) for i in range(len(act)) for j in range(len(act))], "i int, j int, p double")


@query("lag_scan")
def lag_scan(spark, d):
    """Timescales by lag from one pass over the runs; a lag that fails has nulls."""
    from lagfold.operators import analysis

    rows = [(lag, k + 1, None if v != v else round(float(v), 6)) for lag, its in analysis.lag_scan(frames.events(spark, d), [1, 2, 5, 10], 3, 5) for k, v in enumerate(its)]
    return spark.createDataFrame(rows, "lag int, k int, timescale double")


@query("mfpt_two_state")
def mfpt_two_state(spark, d):
    from lagfold.functions import kinetics

    t, pi = kinetics.transition_matrix(event_counts(spark, d))
    _, pops, m = kinetics.metastable_mfpt(t, pi, 2)
    return spark.createDataFrame([(a, b, round(float(pops[a]), 6), round(float(m[a, b]), 6)) for a in range(2) for b in range(2) if a != b], "a int, b int, population double, steps double")


@query("ck_deviation")
def ck_deviation(spark, d):
    from lagfold.operators import analysis

    return spark.createDataFrame([(k, round(v, 6)) for k, v in analysis.ck_test(frames.events(spark, d), 1, 5, 2).items()], "factor int, deviation double")


@query("kinetic_resolution")
def kinetic_resolution(spark, d):
    from lagfold.functions import kinetics

    c = event_counts(spark, d)
    from lagfold.operators import posterior

    out = kinetics.kinetic_resolution(posterior.timescales(spark, c, 1, 3, 48), frames.table(spark, d, "events").count())
    return spark.createDataFrame([(k + 1, *(round(float(x), 6) for x in (r.timescale, r.std, r.low, r.high, r.relative, r.events)), r.resolved) for k, r in enumerate(out)], "k int, timescale double, std double, low double, high double, relative double, events double, resolved boolean")


@query("connected_set", "WITH RECURSIVE " + COUNTS + """,
  e AS (SELECT i, j, c FROM c), st AS (SELECT i FROM e UNION SELECT j FROM e),
  r(i, j) AS (SELECT i, i FROM st UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
  k AS (SELECT a.i, min(a.j) AS root FROM r a JOIN r b ON a.i = b.j AND a.j = b.i GROUP BY a.i),
  m AS (SELECT x.root, sum(c) AS mass FROM e JOIN k x ON e.i = x.i JOIN k y ON e.j = y.i WHERE x.root = y.root GROUP BY 1)
SELECT CAST(i AS INTEGER) AS state FROM k WHERE root = (SELECT root FROM m ORDER BY mass DESC, root LIMIT 1)""")
def connected_set(spark, d):
    from lagfold.functions import kinetics

    return spark.createDataFrame([(int(s),) for s in kinetics.largest_connected_set(event_counts(spark, d))], "state int")


@query("ideal_gaussian_rate")
def ideal_gaussian_rate(spark, d):
    """Mean code length of the levels under the static normal table; the table is 64 rows."""
    import numpy as np

    from lagfold.functions import coders

    f = np.diff(coders.gaussian_table(64, 3.0))
    table = spark.createDataFrame([(k, float(-np.log2(v / coders.TOTAL))) for k, v in enumerate(f)], "level int, bits double")
    q = frames.events(spark, d).select(stats.quantise(F.expr(Z), 64, 3.0).alias("level"))
    return q.join(F.broadcast(table), "level").agg(r6(F.avg("bits")).alias("bits_per_value"))


@query("bootstrap_timescales")
def bootstrap_timescales(spark, d):
    """Means and 95% intervals of the timescales over resampled runs."""
    from lagfold.operators import analysis

    got = analysis.bootstrap_timescales(frames.events(spark, d), 1, 3, 5, replicates=50)
    return spark.createDataFrame([(k + 1, *(round(float(v), 6) for v in row)) for k, row in enumerate(zip(*got))], "k int, mean double, low double, high double")


@query("benchmark_report")
def benchmark_report(spark, d):
    """Stored, shuffled and quantised coordinates and one tool that isn't there, against the bound."""
    from lagfold.operators.tables import written
    from lagfold.plans import benchmark

    x = written(frames.coordinates(spark, d).select("run_id", "t", "xyz"))  # read for every candidate
    rows = benchmark.run_benchmark(x, ["stored", "shuffle", "quantize", "nosuchtool"], lag=1, states=8)
    return benchmark.table(spark, rows)


@query("stream_counts", f"WITH {COUNTS} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, c FROM c")
def stream_counts(spark, d):
    """Counts from a stream of the events, run to the end of what is there."""
    import uuid

    from lagfold.shipping import shared_base, ship
    from lagfold.streaming.counts import stream_counts as increments

    ship(spark)
    folder = f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"
    schema = frames.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    keyed = source.select(F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", frames.state_of(F.col("event_type"), frames.EVENT_STATES).alias("state"))
    q = increments(keyed, order=("ts", "event_id")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("run_id long, i int, j int, c long").parquet(f"{folder}/out").groupBy("i", "j").agg(F.sum("c").alias("c"))


# --- rate, distortion and prediction -----------------------------------------------------------------------------


@query("rate_distortion", f"""WITH {EV}, z AS (SELECT {Z} AS z FROM ev), q AS (SELECT b, z, least(floor((greatest(least(z, 3), -3) + 3) / 6 * pow(2, b)), pow(2, b) - 1) AS q FROM z, (SELECT unnest([2, 4, 6, 8]) AS b)),
m AS (SELECT b, avg(pow(z - ((q + 0.5) * (6.0 / pow(2, b)) - 3), 2)) AS mse FROM q GROUP BY b), c AS (SELECT b, q, count(*) AS c FROM q GROUP BY ALL), h AS (SELECT b, -sum(p * log2(p)) AS bits FROM (SELECT b, c / sum(c) OVER (PARTITION BY b) AS p FROM c) GROUP BY b)
SELECT CAST(b AS INTEGER) AS bits, round(h.bits, 6) AS rate, round(mse, 8) AS mse FROM m JOIN h USING (b)""")
def rate_distortion(spark, d):
    """Entropy of the levels and squared error by word length, all lengths in one pass."""
    z = frames.events(spark, d).select(F.expr(Z).alias("z"))
    rows = z.withColumn("b", F.explode(F.array(*map(F.lit, (2, 4, 6, 8)))))
    n = F.pow(F.lit(2.0), "b")
    level = F.least(F.floor((F.greatest(F.least("z", F.lit(3.0)), F.lit(-3.0)) + 3) / 6 * n).cast("double"), n - 1)
    q = rows.withColumn("q", level).withColumn("e", F.pow(F.col("z") - ((F.col("q") + 0.5) * (6.0 / n) - 3), 2))
    cells = q.groupBy("b", "q").agg(F.count("*").alias("c"), F.sum("e").alias("e"))
    p = F.col("c") / F.sum("c").over(W.partitionBy("b"))
    out = cells.withColumn("p", p).groupBy("b").agg((-F.sum(F.col("p") * F.log2("p"))).alias("rate"), (F.sum("e") / F.sum("c")).alias("mse"))
    return out.select(F.col("b").alias("bits"), r6(F.col("rate")).alias("rate"), r6(F.col("mse"), 8).alias("mse"))


@query("linear_decoder", f"WITH {EV} SELECT round(regr_slope(k, value), 8) AS slope, round(regr_intercept(k, value), 6) AS intercept, round(sqrt(avg(pow(k - (SELECT regr_intercept(k, value) FROM ev) - (SELECT regr_slope(k, value) FROM ev) * value, 2))), 6) AS rmsd FROM ev")
def linear_decoder(spark, d):
    """Least squares from the feature back to a coordinate, by its normal equations, and what it leaves."""
    ev = frames.events(spark, d)
    fit = ev.agg((F.covar_pop("value", "k") / F.var_pop("value")).alias("slope"), F.avg("value").alias("mv"), F.avg("k").alias("mk"))
    fit = fit.select("slope", (F.col("mk") - F.col("slope") * F.col("mv")).alias("intercept"))
    left = ev.join(F.broadcast(fit)).groupBy("slope", "intercept").agg(F.sqrt(F.avg(F.pow(F.col("k") - F.col("intercept") - F.col("slope") * F.col("value"), 2))).alias("rmsd"))
    return left.select(r6(F.col("slope"), 8).alias("slope"), r6(F.col("intercept")).alias("intercept"), r6(F.col("rmsd")).alias("rmsd"))


@query("conditional_nll", f"""WITH {EV}, p AS (SELECT {Z} AS z, lead({Z}) OVER (PARTITION BY run_id ORDER BY t) AS y FROM ev), f AS (SELECT * FROM p WHERE y IS NOT NULL),
a AS (SELECT regr_slope(y, z) AS s, regr_intercept(y, z) AS i FROM f), v AS (SELECT avg(pow(y - i - s * z, 2)) AS v FROM f, a)
SELECT round(0.5 * ln(2 * pi() * v) + 0.5, 6) AS nats, round(s, 6) AS slope FROM v, a""")
def conditional_nll(spark, d):
    """Mean negative log likelihood of the next value under the fitted linear predictor with normal errors."""
    from lagfold.operators import coding
    from lagfold.shipping import ship

    ship(spark)
    model = coding.LinearPredictor.fit(frames.events(spark, d).select("run_id", "t", F.array(F.expr(Z)).alias("z")))
    return spark.createDataFrame([(round(0.5 * math.log(2 * math.pi) + float(model.log_s[0]) + 0.5, 6), round(float(model.a[0, 0]), 6) + 0.0)], "nats double, slope double")


CONTRAST = EV + """,
  n AS (SELECT run_id, count(*) AS n FROM ev GROUP BY 1),
  x AS (SELECT 'stored' AS method, run_id, t, state FROM ev UNION ALL SELECT 'merged', run_id, t, CASE WHEN state = 4 THEN 3 ELSE state END FROM ev
    UNION ALL SELECT 'shuffle', e.run_id, e.t, f.state FROM ev e JOIN n USING (run_id) JOIN ev f ON f.run_id = e.run_id AND f.t = (e.t * 1103515245 + 12345 + e.run_id) % n),
  pr AS (SELECT method, state AS i, lead(state) OVER (PARTITION BY method, run_id ORDER BY t) AS j FROM x),
  co AS (SELECT method, i, j, count(*) AS c FROM pr WHERE j IS NOT NULL GROUP BY ALL),
  sy AS (SELECT method, i, j, sum(c) / 2 AS c FROM (SELECT * FROM co UNION ALL SELECT method, j, i, c FROM co) GROUP BY ALL),
  gr AS (SELECT method, i, j, coalesce(c, 0) AS c FROM (SELECT DISTINCT method FROM x) m CROSS JOIN (SELECT unnest(range(5)) AS i) a CROSS JOIN (SELECT unnest(range(5)) AS j) b LEFT JOIN sy USING (method, i, j)),
  tm AS (SELECT method, i, j, CASE WHEN sum(c) OVER (PARTITION BY method, i) > 0 THEN c / sum(c) OVER (PARTITION BY method, i) ELSE 0 END AS p FROM gr),
  pi AS (SELECT method, i, sum(c) / sum(sum(c)) OVER (PARTITION BY method) AS pi FROM gr GROUP BY method, i),
  pc AS (SELECT method, i, greatest(pi, 1e-12) / sum(greatest(pi, 1e-12)) OVER (PARTITION BY method) AS w FROM pi),
  en AS (SELECT b.method, sum(a.w * ln(a.w / b.w)) AS ensemble FROM pc a JOIN pc b USING (i) WHERE a.method = 'stored' GROUP BY 1),
  tr AS (SELECT b.method, sum(pi.pi * greatest(a.p, 1e-12) * ln(greatest(a.p, 1e-12) / greatest(b.p, 1e-12))) AS transition, bool_and(NOT (a.p > 1e-12 AND NOT b.p > 1e-12)) AS support_ok
    FROM tm a JOIN tm b USING (i, j) JOIN pi ON pi.i = a.i AND pi.method = 'stored' WHERE a.method = 'stored' GROUP BY 1)"""


@query("contrast_report", f"WITH {CONTRAST} SELECT method, round(ensemble, 6) + 0.0 AS ensemble, round(transition, 6) + 0.0 AS transition, round(ensemble + transition, 6) + 0.0 AS two_slice, support_ok FROM en JOIN tr USING (method)")
def contrast_report(spark, d):
    """The events against themselves, a shuffle within runs, and a coarser state: ensemble and transition terms."""
    from lagfold.plans.codec import contrast

    ev = frames.events(spark, d).select("run_id", "t", "state")
    n = ev.groupBy("run_id").agg(F.count("*").alias("n"))
    pick = ev.join(n, "run_id").select("run_id", "t", ((F.col("t") * 1103515245 + 12345 + F.col("run_id")) % F.col("n")).alias("from"))
    shuffled = pick.join(ev.withColumnRenamed("t", "from"), ["run_id", "from"]).select("run_id", "t", "state")
    coarse = ev.withColumn("state", F.when(F.col("state") == 4, 3).otherwise(F.col("state")))
    rows = contrast(ev, {"stored": ev, "shuffle": shuffled, "merged": coarse}, 5)
    return rows.select("method", *[r6(F.col(c)).alias(c) for c in ("ensemble", "transition", "two_slice")], "support_ok")
