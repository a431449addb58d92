"""Queries of likelihoods, Markov chains and integer copy states."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions.likelihood import bb_log_pmf, nb_log_pmf, once_each
from tessera.operators import copies, fitting, hmm

from .registry import query, table


def _nb_sql(k, base, mu, alpha):
    r, lam = f"(1 / greatest({alpha}, 1e-10))", f"({base} * exp({mu}))"
    p = f"(1 / (1 + {alpha} * {lam}))"
    return f"(CASE WHEN {lam} <= 0 THEN 0 ELSE lgamma({k} + {r}) - lgamma({r}) - lgamma({k} + 1.0) + {r} * ln{p} + {k} * ln(1 - {p}) END)"


@query(f"SELECT l_orderkey, l_linenumber, round({_nb_sql('CAST(l_quantity AS BIGINT)', '(l_linenumber * 5.0)', '0.3', '0.2')}, 5) AS ll FROM lineitem")
def nb_loglik(spark, sf_dir):
    ll = nb_log_pmf(F.col("k"), F.col("l_linenumber") * 5.0, F.lit(0.3), F.lit(0.2))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("k"))
    return once_each(rows, F.round(ll, 5), "ll", "k", "l_linenumber").drop("k")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) AS k, CAST(l_quantity AS BIGINT) AS n, 0.4 * 12.0 AS a, 0.6 * 12.0 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN k > n THEN 0 ELSE lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)
  + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b) END, 5) AS ll FROM x
""")
def bb_loglik(spark, sf_dir):
    ll = bb_log_pmf(F.col("l_linenumber").cast("long"), F.col("n"), F.lit(0.4), F.lit(12.0))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("n"))
    return once_each(rows, F.round(ll, 5), "ll", "l_linenumber", "n").drop("n")


@query(f"""
WITH c AS (SELECT i, 0.2 * i - 0.4 AS mu FROM range(5) r(i)),
d AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS k, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, CAST(i AS BIGINT) AS state, round(sum(n * {_nb_sql('k', '(b * 7.0)', 'mu', '0.1')}), 3) AS field FROM d, c GROUP BY 1, 2
""")
def spot_clone_field(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("long").alias("k"), F.col("l_linenumber").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    states = codes.withColumn("state", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    ll = nb_log_pmf(F.col("k"), F.col("b") * 7.0, F.col("state") * 0.2 - 0.4, F.lit(0.1))
    return states.groupBy("l_suppkey", "state").agg(F.round(F.sum(F.col("n") * ll), 3).alias("field"))


@query("""
WITH c AS (SELECT a, b, (a + b) / 2.0 AS d, b / CAST(a + b AS DOUBLE) AS s FROM range(6) r(a), range(6) q(b) WHERE a + b BETWEEN 1 AND 6),
x AS (SELECT p_partkey, p_size / 15.0 AS depth, (p_partkey % 101) / 100.0 AS share FROM part),
r AS (SELECT p_partkey, a, b, 0.3 * abs(depth - d) + abs(share - s) AS cost, row_number() OVER (PARTITION BY p_partkey ORDER BY round(0.3 * abs(depth - d) + abs(share - s), 12), a + b, a) AS nth FROM x, c)
SELECT p_partkey, a, b, round(cost, 6) AS cost FROM r WHERE nth = 1
""")
def copy_lattice_decode(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 15.0).alias("depth"), ((F.col("p_partkey") % 101) / 100.0).alias("share"))
    return copies.nearest_pair(parts, "p_partkey", "depth", "share", 6, 5).withColumn("cost", F.round("cost", 6))


#: Two states that see one event type in three and in two respectively.
SEEN, UNSEEN = (math.log(0.6), math.log(0.25)), (math.log(0.4), math.log(0.75))
CHAIN = f"""
x AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'click' THEN {SEEN[0]!r} ELSE {UNSEEN[0]!r} END AS e0, CASE WHEN event_type = 'click' THEN {SEEN[1]!r} ELSE {UNSEEN[1]!r} END AS e1,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
"""
STAY, MOVE, HALF = math.log(0.9), math.log(1 - 0.9), math.log(0.5)


def _chain(spark, sf_dir):
    click = F.col("event_type") == "click"
    emit = [F.when(click, F.lit(SEEN[i])).otherwise(F.lit(UNSEEN[i])).alias(f"e{i}") for i in (0, 1)]
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", *emit)


@query(f"""
WITH RECURSIVE {CHAIN},
f(user_id, rn, a0, a1) AS (
  SELECT user_id, rn, {HALF!r} + e0, {HALF!r} + e1 FROM x WHERE rn = 1
  UNION ALL
  SELECT x.user_id, x.rn,
    greatest(a0 + {STAY!r}, a1 + {MOVE!r}) + ln(exp(a0 + {STAY!r} - greatest(a0 + {STAY!r}, a1 + {MOVE!r})) + exp(a1 + {MOVE!r} - greatest(a0 + {STAY!r}, a1 + {MOVE!r}))) + e0,
    greatest(a0 + {MOVE!r}, a1 + {STAY!r}) + ln(exp(a0 + {MOVE!r} - greatest(a0 + {MOVE!r}, a1 + {STAY!r})) + exp(a1 + {STAY!r} - greatest(a0 + {MOVE!r}, a1 + {STAY!r}))) + e1
  FROM f JOIN x ON x.user_id = f.user_id AND x.rn = f.rn + 1)
SELECT user_id, max(rn) AS n, round(max_by(greatest(a0, a1) + ln(exp(a0 - greatest(a0, a1)) + exp(a1 - greatest(a0, a1))), rn), 6) AS log_likelihood FROM f GROUP BY user_id
""")
def hmm_forward(spark, sf_dir):
    found = hmm.forward(_chain(spark, sf_dir), "user_id", ["ts", "event_id"], ["e0", "e1"], [[STAY, MOVE], [MOVE, STAY]], [HALF, HALF])
    return found.withColumn("log_likelihood", F.round("log_likelihood", 6))


@query(f"""
WITH RECURSIVE {CHAIN},
f(user_id, rn, v0, v1, b0, b1) AS (
  SELECT user_id, rn, {HALF!r} + e0, {HALF!r} + e1, 0, 0 FROM x WHERE rn = 1
  UNION ALL
  SELECT x.user_id, x.rn, greatest(v0 + {STAY!r}, v1 + {MOVE!r}) + e0, greatest(v0 + {MOVE!r}, v1 + {STAY!r}) + e1,
    CASE WHEN v0 + {STAY!r} >= v1 + {MOVE!r} THEN 0 ELSE 1 END, CASE WHEN v0 + {MOVE!r} >= v1 + {STAY!r} THEN 0 ELSE 1 END
  FROM f JOIN x ON x.user_id = f.user_id AND x.rn = f.rn + 1),
g(user_id, rn, state, prev) AS (
  SELECT user_id, rn, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END, CASE WHEN v0 >= v1 THEN b0 ELSE b1 END FROM f WHERE (user_id, rn) IN (SELECT user_id, max(rn) FROM f GROUP BY user_id)
  UNION ALL
  SELECT f.user_id, f.rn, g.prev, CASE WHEN g.prev = 0 THEN f.b0 ELSE f.b1 END FROM g JOIN f ON f.user_id = g.user_id AND f.rn = g.rn - 1)
SELECT event_id, CAST(state AS BIGINT) AS state FROM g JOIN x USING (user_id, rn)
""")
def viterbi(spark, sf_dir):
    return hmm.viterbi(_chain(spark, sf_dir), "user_id", ["ts", "event_id"], ["e0", "e1"], [[STAY, MOVE], [MOVE, STAY]], [HALF, HALF]).select("event_id", "state")


def _log_add(p, q):
    return f"(greatest({p}, {q}) + ln(1 + exp(-abs(({p}) - ({q})))))"


@query(f"""
WITH RECURSIVE {CHAIN},
f(user_id, rn, a0, a1) AS (
  SELECT user_id, rn, {HALF!r} + e0, {HALF!r} + e1 FROM x WHERE rn = 1
  UNION ALL
  SELECT x.user_id, x.rn, {_log_add(f"a0 + {STAY!r}", f"a1 + {MOVE!r}")} + e0, {_log_add(f"a0 + {MOVE!r}", f"a1 + {STAY!r}")} + e1
  FROM f JOIN x ON x.user_id = f.user_id AND x.rn = f.rn + 1),
g(user_id, rn, b0, b1) AS (
  SELECT user_id, max(rn), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM x GROUP BY user_id
  UNION ALL
  SELECT g.user_id, g.rn - 1, {_log_add(f"{STAY!r} + e0 + b0", f"{MOVE!r} + e1 + b1")}, {_log_add(f"{MOVE!r} + e0 + b0", f"{STAY!r} + e1 + b1")}
  FROM g JOIN x ON x.user_id = g.user_id AND x.rn = g.rn WHERE g.rn > 1)
SELECT event_id, CAST(CASE WHEN a0 + b0 >= a1 + b1 THEN 0 ELSE 1 END AS BIGINT) AS state, round(exp(a0 + b0 - {_log_add("a0 + b0", "a1 + b1")}), 6) AS p0
FROM f JOIN g USING (user_id, rn) JOIN x USING (user_id, rn)
""")
def state_posteriors(spark, sf_dir):
    found = hmm.posteriors(_chain(spark, sf_dir), "user_id", ["ts", "event_id"], ["e0", "e1"], [[STAY, MOVE], [MOVE, STAY]], [HALF, HALF])
    return found.select("event_id", "state", F.round(F.get("posterior", F.lit(0)), 6).alias("p0"))


def _em_sql(rounds=10, states=3, alpha="0.1"):
    """One row of parameters after each round, from the sums over distinct counts."""
    each = range(states)
    parts = [
        "c AS MATERIALIZED (SELECT CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS k, CAST(l_linenumber AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_linenumber > 0 GROUP BY 1, 2)",
        "p0 AS MATERIALIZED (SELECT " + ", ".join(f"ln(sum(n * k) / sum(n * b)) + {0.5 * (i - (states - 1) / 2)!r} AS m{i}, 1 / {float(states)!r} AS w{i}" for i in each) + " FROM c)",
    ]
    for r in range(1, rounds + 1):
        parts.append(f"e{r} AS (SELECT k, b, n, " + ", ".join(f"ln(greatest(1e-300, w{i})) + {_nb_sql('k', 'b', f'm{i}', alpha)} AS l{i}" for i in each) + f" FROM c, p{r - 1})")
        parts.append(f"h{r} AS (SELECT *, greatest({', '.join(f'l{i}' for i in each)}) AS top FROM e{r})")
        parts.append(f"t{r} AS (SELECT *, top + ln({' + '.join(f'exp(l{i} - top)' for i in each)}) AS whole FROM h{r})")
        parts.append(f"s{r} AS (SELECT " + ", ".join(f"sum({by} * n * exp(l{i} - whole)) AS {name}{i}" for i in each for name, by in (("n", "1"), ("k", "k"), ("b", "b"))) + f" FROM t{r})")
        total = " + ".join(f"n{i}" for i in each)
        parts.append(f"p{r} AS MATERIALIZED (SELECT " + ", ".join(f"ln(greatest(1e-9, k{i}) / greatest(1e-9, b{i})) AS m{i}, n{i} / ({total}) AS w{i}" for i in each) + f" FROM s{r})")
    out = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS state, round(w{i}, 5) AS weight, round(m{i}, 5) AS log_mu FROM p{rounds}" for i in each)
    return f"WITH {', '.join(parts)} {out}"


@query(_em_sql())
def em_fit(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("k"), F.col("l_linenumber").alias("b"))
    return hmm.count_mixture(items, "k", "b", 3, 0.1).withColumns({"weight": F.round("weight", 5), "log_mu": F.round("log_mu", 5)})


def _plane_sql(rounds=8, states=3, least=1e-6):
    """Means and weights after each round, from six sums for each component."""
    each = range(states)
    parts = [
        "c AS MATERIALIZED (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)",
        f"g AS (SELECT avg(y) AS my, avg(x * x) - avg(x) * avg(x) + {least!r} AS xx, avg(x * y) - avg(x) * avg(y) AS xy, avg(y * y) - avg(y) * avg(y) + {least!r} AS yy, count(*) AS n FROM c)",
        "p0 AS MATERIALIZED (SELECT " + ", ".join(f"1 / {float(states)!r} AS w{i}, (SELECT quantile_cont(x, {(i + 0.5) / states!r}) FROM c) AS x{i}, my AS y{i}, xx AS xx{i}, xy AS xy{i}, yy AS yy{i}" for i in each) + " FROM g)",
    ]
    for r in range(1, rounds + 1):
        law = lambda i: f"ln(w{i}) - 0.5 * ln(xx{i} * yy{i} - xy{i} * xy{i}) - 0.5 * (yy{i} * (x - x{i}) * (x - x{i}) - 2 * xy{i} * (x - x{i}) * (y - y{i}) + xx{i} * (y - y{i}) * (y - y{i})) / (xx{i} * yy{i} - xy{i} * xy{i}) AS l{i}"
        parts.append(f"e{r} AS (SELECT x, y, {', '.join(map(law, each))} FROM c, p{r - 1})")
        parts.append(f"t{r} AS (SELECT *, greatest({', '.join(f'l{i}' for i in each)}) AS top FROM e{r})")
        parts.append(f"q{r} AS (SELECT x, y, {', '.join(f'exp(l{i} - top) AS h{i}' for i in each)}, {' + '.join(f'exp(l{i} - top)' for i in each)} AS whole FROM t{r})")
        sums = ", ".join(f"sum(h{i} / whole) AS n{i}, " + ", ".join(f"sum(h{i} / whole * {v}) AS s{k}{i}" for k, v in (("x", "x"), ("y", "y"), ("xx", "x * x"), ("xy", "x * y"), ("yy", "y * y"))) for i in each)
        parts.append(f"s{r} AS (SELECT {sums} FROM q{r})")
        mean = ", ".join(f"n{i} / n AS w{i}, sx{i} / n{i} AS x{i}, sy{i} / n{i} AS y{i}, sxx{i} / n{i} - (sx{i} / n{i}) * (sx{i} / n{i}) + {least!r} AS xx{i}, sxy{i} / n{i} - (sx{i} / n{i}) * (sy{i} / n{i}) AS xy{i}, syy{i} / n{i} - (sy{i} / n{i}) * (sy{i} / n{i}) + {least!r} AS yy{i}" for i in each)
        parts.append(f"p{r} AS MATERIALIZED (SELECT {mean} FROM s{r}, g)")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {i} AS component, round(w{i}, 6) AS weight, round(x{i}, 6) AS x, round(y{i}, 6) AS y FROM p{rounds}" for i in each)


@query(_plane_sql())
def gmm_init(spark, sf_dir):
    """Means and weights of a mixture of three normal laws on the first two coordinates."""
    points = table(spark, sf_dir, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    found, _ = fitting.plane_mixture(points, "x", "y", 3, rounds=8)
    return found.select("component", *(F.round(c, 6).alias(c) for c in ("weight", "x", "y")))
