"""Queries of starting states, purity by expectation maximisation, and chains with phases, on cells of the same shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import hmm, purity, starts

from .models import CHAIN, HALF, MOVE, SEEN, STAY as KEEP, UNSEEN
from .registry import query, table

#: Cells of parts: reads against an expectation, and reads of one allele among some.
CELLS = "c AS (SELECT CAST(p_size + p_partkey % 40 AS DOUBLE) AS k, CAST(45 + p_partkey % 3 AS DOUBLE) AS e, CAST(p_partkey * 7 % 29 AS DOUBLE) AS b, CAST(30 + p_partkey % 2 AS DOUBLE) AS t FROM part)"


def _cells(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((F.col("p_size") + key % 40).alias("total"), (45 + key % 3).alias("exposure"), (key * 7 % 29).alias("b"), (30 + key % 2).alias("trials"))


def _grid_sql(purities=(1.0, 0.7, 0.5), scales=starts.SCALES, most=4, iterations=3) -> str:
    """Densities of all states at every point of the grid, classified ``iterations`` times."""
    point = ", ".join(f"({g}, CAST({p!r} AS DOUBLE), CAST({s!r} AS DOUBLE))" for g, (p, s) in enumerate((p, s) for p in purities for s in scales))
    size, conc, err = starts.SIZE, starts.CONCENTRATION, starts.ERROR
    parts = [
        CELLS,
        "x AS MATERIALIZED (SELECT k, e, b, t, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY ALL)",
        f"g(g, purity, scale) AS (VALUES {point})",
        f"s AS (SELECT g, a * 100 + d AS id, scale * (purity * (a + d) / 2 + 1 - purity) AS r, {err!r} + {1 - 2 * err!r} * (purity * a + 1 - purity) / (purity * (a + d) + 2 * (1 - purity)) AS p0 FROM g, range({most + 1}) i(a), range({most + 1}) j(d) WHERE a + d BETWEEN 1 AND {most})",
        f"q AS (SELECT *, greatest(1e-4, least(1 - 1e-4, p0)) * {conc!r} AS al, (1 - greatest(1e-4, least(1 - 1e-4, p0))) * {conc!r} AS be FROM s)",
        f"""d AS MATERIALIZED (SELECT g, k, e, b, t, n, id,
  lgamma(k + {size!r}) - lgamma({size!r}) - lgamma(k + 1) + {size!r} * ln({size!r} / ({size!r} + e * r)) + k * ln(e * r / ({size!r} + e * r))
  + CASE WHEN b > t THEN 0 ELSE lgamma(t + 1) - lgamma(b + 1) - lgamma(t - b + 1) + lgamma(b + al) + lgamma(t - b + be) - lgamma(t + al + be) - lgamma(al) - lgamma(be) + lgamma(al + be) END AS v FROM x, q)""",
        "m AS (SELECT sum(n) AS m FROM x)",
        "w0 AS (SELECT g, id, -ln(count(*) OVER (PARTITION BY g)) AS w FROM s)",
    ]
    for i in range(iterations):
        parts.append(f"a{i} AS (SELECT g, k, e, b, t, any_value(n) AS n, arg_max(id, (v + w, -id)) AS id FROM d JOIN w{i} USING (g, id) GROUP BY g, k, e, b, t)")
        parts.append(f"u{i} AS (SELECT g, id, sum(n) AS n FROM a{i} GROUP BY g, id)")
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT s.g, s.id, ln(greatest(coalesce(n, 0) / m, 1 / (10 * m))) AS w FROM s LEFT JOIN u{i} USING (g, id), m)")
    parts.append(f"l AS (SELECT g, n, max(v + w) AS v FROM d JOIN w{iterations} USING (g, id) GROUP BY g, k, e, b, t, n)")
    return f"WITH {', '.join(parts)} SELECT purity, round(scale, 9) AS scale, round(sum(n * v), 3) AS level FROM l JOIN g USING (g) GROUP BY purity, scale"


@query(_grid_sql())
def start_grid(spark, sf_dir):
    """The classification log-likelihood of all parts at each purity and depth scale."""
    found = starts.lattice_grid(starts.distinct_cells(_cells(spark, sf_dir)), (1.0, 0.7, 0.5), most=4)
    return spark.createDataFrame(found, "purity double, scale double, level double").select("purity", F.round("scale", 9).alias("scale"), F.round("level", 3).alias("level"))


#: Cells of clones: parts in bins of two contigs.
CLONES = "c AS (SELECT p_partkey % 3 AS clone, p_partkey // 3 % 2 AS contig, p_partkey AS bin, CAST(p_size + 20 AS DOUBLE) AS k, CAST(40 + p_partkey % 3 AS DOUBLE) AS e, CAST(p_partkey * 7 % 13 AS DOUBLE) AS b, CAST(20 + p_partkey % 2 AS DOUBLE) AS t FROM part)"
STAY, ALPHA, TAU = 0.99, 0.05, 40.0


def _clones(spark, sf_dir):
    key = F.col("p_partkey")
    contig = F.call_function("div", key, F.lit(3)) % 2
    return table(spark, sf_dir, "part").select((key % 3).alias("clone"), contig.alias("contig"), key.alias("bin"), (F.col("p_size") + 20).alias("umi"), (40 + key % 3).cast("double").alias("base"), (key * 7 % 13).alias("a"), (20 + key % 2).alias("total"))


def _path_sql(purities=(0.5, 0.9), shifts=(-0.1, 0.2)) -> str:
    """Best paths over five states under four settings, with the states side by side."""
    model = purity.lattice(2, 2, STAY, 0.5)
    stay, move = model.moves
    settings = ", ".join(f"({i}, CAST({p!r} AS DOUBLE), CAST({s!r} AS DOUBLE))" for i, (p, s) in enumerate((p, s) for p in purities for s in shifts))
    states = range(len(model.pairs))
    emits = []
    for i, (a, b) in enumerate(model.pairs):
        mean = f"(e * exp(shift) * (purity * {a + b} / 2 + 1 - purity))"
        share = f"greatest(1e-4, least(1 - 1e-4, (purity * {a} + 1 - purity) / (purity * {a + b} + 2 * (1 - purity))))"
        al, be, size = f"({share} * {TAU!r})", f"((1 - {share}) * {TAU!r})", repr(1 / ALPHA)
        nb = f"lgamma(k + {size}) - lgamma({size}) - lgamma(k + 1) + {size} * ln({size} / ({size} + {mean})) + k * ln({mean} / ({size} + {mean}))"
        bb = f"lgamma(t + 1) - lgamma(b + 1) - lgamma(t - b + 1) + lgamma(b + {al}) + lgamma(t - b + {be}) - lgamma(t + {TAU!r}) - lgamma({al}) - lgamma({be}) + lgamma({TAU!r})"
        emits.append(f"{nb} + {bb} - {0.5 * abs(a + b - 2)!r} AS e{i}")
    top = f"greatest({', '.join(f'v{i}' for i in states)})"
    return f"""
WITH RECURSIVE {CLONES}, s(setting, purity, shift) AS (VALUES {settings}),
x AS MATERIALIZED (SELECT setting, clone, contig, row_number() OVER (PARTITION BY setting, clone, contig ORDER BY bin) AS rn, {", ".join(emits)} FROM c, s),
f(setting, clone, contig, rn, {", ".join(f"v{i}" for i in states)}) AS (
  SELECT setting, clone, contig, rn, {", ".join(f"e{i} - ln({len(model.pairs)}.0)" for i in states)} FROM x WHERE rn = 1
  UNION ALL
  SELECT x.setting, x.clone, x.contig, x.rn, {", ".join(f"greatest(v{i} + {stay!r}, {top} + {move!r}) + e{i}" for i in states)}
  FROM f JOIN x ON x.setting = f.setting AND x.clone = f.clone AND x.contig = f.contig AND x.rn = f.rn + 1),
l AS (SELECT setting, clone, contig, max_by({top}, rn) AS level FROM f GROUP BY ALL)
SELECT clone, purity, shift, round(sum(level), 4) AS level FROM l JOIN s USING (setting) GROUP BY clone, purity, shift
"""


@query(_path_sql())
def path_scores(spark, sf_dir):
    """The best path's log-likelihood of each clone at two purities and two shifts."""
    model, grid = purity.lattice(2, 2, STAY, 0.5), [(p, s) for p in (0.5, 0.9) for s in (-0.1, 0.2)]
    got = purity.scores(_clones(spark, sf_dir), model, {c: [purity.At(p, s, ALPHA, TAU) for p, s in grid] for c in range(3)})
    rows = [(c, p, s, float(v)) for c, values in got.items() for (p, s), v in zip(grid, values)]
    return spark.createDataFrame(rows, "clone long, purity double, shift double, level double").withColumn("level", F.round("level", 4))


@query()
def purity_decode(spark, sf_dir):
    """Each clone's bins with their copies, after two rounds of expectation maximisation."""
    return purity.decode(_clones(spark, sf_dir), normal=0, model=purity.lattice(3, 2, STAY), rounds=2, passes=2).paths


#: The probability that the phase flips before the next event, by the event's own value.
SWITCH = "ln(0.02 + least(abs(coalesce(value, 0)), 900) / 2000)"


def _log_sum(terms: list[str]) -> str:
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def _phased_sql(same_state: bool) -> str:
    """Two states and their twins; a twin sees as the other state does."""
    stay, move = [[repr(KEEP), repr(MOVE)], [repr(MOVE), repr(KEEP)]], []
    for j in range(4):
        terms = []
        for i in range(4):
            flips = i // 2 != j // 2
            by = "-0.6931471805599453" if same_state and i % 2 != j % 2 else "f.turn" if flips else "f.hold"
            terms.append(f"a{i} + {stay[i % 2][j % 2]} + {by}")
        move.append(_log_sum(terms))
    e = [0, 1, 1, 0]
    return f"""
WITH RECURSIVE {CHAIN},
y AS MATERIALIZED (SELECT x.*, {SWITCH} AS turn, ln(1 - exp({SWITCH})) AS hold FROM x JOIN (SELECT event_id, value FROM events) USING (event_id)),
f(user_id, rn, turn, hold, a0, a1, a2, a3) AS (
  SELECT user_id, rn, turn, hold, {", ".join(f"2 * {HALF!r} + e{k}" for k in e)} FROM y WHERE rn = 1
  UNION ALL
  SELECT y.user_id, y.rn, y.turn, y.hold, {", ".join(f"{m} + e{k}" for m, k in zip(move, e))}
  FROM f JOIN y ON y.user_id = f.user_id AND y.rn = f.rn + 1)
SELECT user_id, max(rn) AS n, round(max_by({_log_sum([f"a{i}" for i in range(4)])}, rn), 6) AS log_likelihood FROM f GROUP BY user_id
"""


def _phased(spark, sf_dir, same_state):
    click = F.col("event_type") == "click"
    sees = [F.when(click, F.lit(SEEN[i])).otherwise(F.lit(UNSEEN[i])) for i in (0, 1)]
    switch = F.ln(0.02 + F.least(F.abs(F.coalesce(F.col("value"), F.lit(0.0))), F.lit(900.0)) / 2000)
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", *(sees[k].alias(f"t{i}") for i, k in enumerate([0, 1, 1, 0])), switch.alias("switch"))
    level, states = hmm.phased(events, "user_id", ["ts", "event_id"], ["t0", "t1", "t2", "t3"], [[KEEP, MOVE], [MOVE, KEEP]], [HALF, HALF], "switch", same_state)
    return level.withColumn("log_likelihood", F.round("log_likelihood", 6))


@query(_phased_sql(False))
def phased_likelihood(spark, sf_dir):
    """Events of users as chains whose states have twins that see the other way round."""
    return _phased(spark, sf_dir, False)


@query(_phased_sql(True))
def phased_likelihood_same_state(spark, sf_dir):
    """The same, with phases tied only where the state stays."""
    return _phased(spark, sf_dir, True)


@query()
def mixture_states(spark, sf_dir):
    """Three states of parts, the likeliest of two seeded draws: their rates, shares and weights."""
    found = starts.mixture_start(starts.distinct_cells(_cells(spark, sf_dir)), 3, tries=2, seed=1)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(zip(found.log_mu, found.p, found.weight))], "state int, log_mu double, p double, weight double")
