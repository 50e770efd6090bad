"""Queries over the driver's tables, lifted into the domain, each through the library's operators; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions.sql import register_sql
from ..functions.vocabulary import TAGS, VEHICLES, tag_closure
from ..operators import catalog as store
from ..operators import containment, segments, states
from ..sources.staging import new_folder
from ..streaming import runs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Signals: an actor for each user, a sample for each event, labelled by its type.
EPOCH = 1704067200
SAMPLES = f"samples AS (SELECT 'u' || user_id AS actor, epoch_us(ts) / 1e6 - {EPOCH} AS t, value AS y, event_type AS label FROM events)"
RUNS = f"""{SAMPLES},
marked AS (SELECT *, lag(label) OVER (PARTITION BY actor ORDER BY t) AS p, max(t) OVER (PARTITION BY actor) AS last_t FROM samples),
starts AS (SELECT * FROM marked WHERE p IS NULL OR p <> label),
runs AS (SELECT actor, row_number() OVER (PARTITION BY actor ORDER BY t) AS run, label, t AS t_start, coalesce(lead(t) OVER (PARTITION BY actor ORDER BY t), last_t) AS t_end FROM starts)"""
INSIDE = f"{RUNS},\ninside AS (SELECT s.actor, s.t, s.y, r.run, r.label, r.t_start, r.t_end FROM samples s JOIN runs r ON s.actor = r.actor AND s.t BETWEEN r.t_start AND r.t_end)"
OLS = """o AS (SELECT actor, run, min(t) AS t0, max(t) AS t1, avg(y) AS my, avg(x) AS mx, covar_pop(y, x) AS num, var_pop(x) AS den FROM z GROUP BY actor, run),
ab AS (SELECT actor, run, t0, t1, CASE WHEN t0 = t1 THEN 0 ELSE num / nullif(den, 0) END AS b, my - (CASE WHEN t0 = t1 THEN 0 ELSE num / nullif(den, 0) END) * mx AS a FROM o)"""
LINEAR = f"{INSIDE},\nz AS (SELECT *, t AS x FROM inside),\n{OLS},\nfitted AS (SELECT actor, run, b * t0 + a AS xstart, b * t1 + a AS xend FROM ab)"
SINE = f"{INSIDE},\nz AS (SELECT *, cos(pi() * (t - min(t) OVER (PARTITION BY actor, run)) / nullif(max(t) OVER (PARTITION BY actor, run) - min(t) OVER (PARTITION BY actor, run), 0)) AS x FROM inside),\n{OLS},\nfitted AS (SELECT actor, run, CASE WHEN t0 < t1 THEN a + b END AS xstart, CASE WHEN t0 < t1 THEN a - b END AS xend FROM ab)"
S = "(i.t - i.t_start) / nullif(i.t_end - i.t_start, 0)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - EPOCH
    return read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), t.alias("t"), F.col("value").alias("y"), F.col("event_type").alias("label"))


def inside(spark: SparkSession, d: str) -> DataFrame:
    return segments.in_runs(samples(spark, d)).select("actor", "t", "y", "run", F.col("run_label").alias("label"), "t_start", "t_end")


KEYS = ["actor", "run"]
NO_PARAMETERS = {f: k for f, k in (x.split(":") for x in models.PARAMETERS.removeprefix("struct<").removesuffix(">").split(","))}


def parameters(**known: Column) -> Column:
    return F.struct(*(known.get(f, F.lit(None).cast(v)).alias(f) for f, v in NO_PARAMETERS.items()))


def fitted_states(spark: SparkSession, d: str, model: str, dot: bool = False, **options) -> DataFrame:
    """Each sample in each of its runs with the state of the model that was fitted to the run."""
    own = inside(spark, d)
    p = models.fit(model, own, KEYS, **options)
    p = p.select(*KEYS, parameters(xstart=F.col("xstart"), xend=F.col("xend") if "xend" in p.columns else F.lit(None).cast("double")).alias("p"))
    s = states.normal_time(F.col("t"), F.col("t_start"), F.col("t_end"))
    of = models.derivative if dot else models.value
    v = of(F.lit(model), F.col("p"), s)
    return own.join(p, KEYS).withColumn("state", v / F.when(F.col("t_end") > F.col("t_start"), F.col("t_end") - F.col("t_start")) if dot else v)


@query(f"WITH {INSIDE} SELECT actor, run, label, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, count(*) AS n FROM inside GROUP BY actor, run, label, t_start, t_end")
def segment_runs(spark, d):
    return inside(spark, d).groupBy("actor", "run", "label", "t_start", "t_end").agg(F.count("*").alias("n")).select("actor", F.col("run").cast("long"), "label", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"), "n")


@query(f"WITH {INSIDE} SELECT actor, run, label, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, count(*) AS n FROM inside GROUP BY actor, run, label, t_start, t_end")
def segment_runs_ranged(spark, d):
    """As segment_runs, by a scan in two levels over ranges that cut through actors."""
    out = segments.in_runs_ranged(samples(spark, d), 16).groupBy("actor", "run", F.col("run_label").alias("label"), "t_start", "t_end").agg(F.count("*").alias("n"))
    return out.select("actor", "run", "label", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"), "n")


@query(f"WITH {RUNS} SELECT actor, run, label, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM runs")
def stream_segment_runs(spark, d):
    """The runs of all events, which come as a stream of files in order of time; one far in the future lets the last runs end."""
    folder = new_folder(spark)
    events = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))
    # As many files as there are cores, so that neither writing nor reading them is left to a few tasks; half of them at a time.
    files = max(4, spark.sparkContext.defaultParallelism)
    events.repartitionByRange(files, "ts").write.parquet(f"{folder}/in/0")
    for k in (1, 2):
        events.agg((F.max("ts") + F.expr(f"interval {k * 10000} days")).alias("ts")).select(F.lit("").alias("actor"), "ts", F.lit("").alias("label")).write.parquet(f"{folder}/in/{k}")
    source = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", (files + 1) // 2).parquet(f"{folder}/in")
    runs.to_files(runs.stream_segments(source, "100 days", "5000 days"), f"{folder}/out", f"{folder}/checkpoint")
    since = lambda c: r6(F.unix_micros(c) / F.lit(1e6) - EPOCH).alias(c)
    return spark.read.schema("actor string, run long, label string, t_start timestamp, t_end timestamp").parquet(f"{folder}/out").filter("actor <> ''").select("actor", "run", "label", since("t_start"), since("t_end"))


@query(f"WITH {INSIDE} SELECT actor, run, count(*) AS n, round(sum(y), 6) AS total FROM inside GROUP BY actor, run")
def samples_in_runs(spark, d):
    """As segment_runs, by a join with runs that need not be the samples' own."""
    s = samples(spark, d)
    return segments.samples_in(s, segments.segments(s)).groupBy("actor", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), r6(F.sum("y")).alias("total"))


@query(f"WITH {SAMPLES} SELECT label, round(avg(-y), 6) AS mean FROM samples WHERE t BETWEEN 86400 AND 864000 GROUP BY label")
def negated_slice(spark, d):
    """A signal's slice between two instants, both included, with its sign changed."""
    return samples(spark, d).filter(F.col("t").between(86400, 864000)).groupBy("label").agg(r6(F.avg(-F.col("y"))).alias("mean"))


@query(f"WITH {RUNS} SELECT label, count(*) AS n, round(avg(t_end - t_start), 6) AS mean, round(max(t_end - t_start), 6) AS longest FROM runs GROUP BY label")
def segment_durations(spark, d):
    length = F.col("t_end") - F.col("t_start")
    return segments.segments(samples(spark, d)).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(length)).alias("mean"), r6(F.max(length)).alias("longest"))


@query(f"WITH {RUNS} SELECT actor, round(t, 6) AS t, label FROM starts")
def change_points(spark, d):
    return segments.change_points(samples(spark, d)).select("actor", r6("t").alias("t"), "label")


@query(f"WITH {RUNS} SELECT a.actor, a.run, b.run AS next_run FROM runs a JOIN runs b ON a.actor = b.actor AND a.t_end = b.t_start AND a.run < b.run")
def adjacent_activities(spark, d):
    return segments.adjacent(segments.segments(samples(spark, d))).select("actor", F.col("run").cast("long"), F.col("next_run").cast("long"))


def _fit(spark, d, model, **options):
    p = models.fit(model, inside(spark, d), KEYS, **options)
    return p.select("actor", F.col("run").cast("long"), *(r6(c).alias(c) for c in p.columns if c not in KEYS))


@query(f"WITH {INSIDE} SELECT actor, run, round(avg(y), 6) AS xstart FROM inside GROUP BY actor, run")
def fit_constant(spark, d):
    return _fit(spark, d, "Constant")


@query(f"WITH {LINEAR} SELECT actor, run, round(xstart, 6) AS xstart, round(xend, 6) AS xend FROM fitted")
def fit_linear(spark, d):
    return _fit(spark, d, "Linear")


@query(f"WITH {INSIDE} SELECT actor, run, round(arg_min(y, t), 6) AS xstart, round(arg_max(y, t), 6) AS xend FROM inside GROUP BY actor, run")
def fit_linear_endpoints(spark, d):
    return _fit(spark, d, "Linear", endpoints=True)


@query(f"WITH {SINE} SELECT actor, run, round(xstart, 6) AS xstart, round(xend, 6) AS xend FROM fitted")
def fit_sinusoidal(spark, d):
    return _fit(spark, d, "Sinusoidal")


@query()
def fit_spline3knots(spark, d):
    return models.fit("Spline3Knots", samples(spark, d), ["actor"])


@query()
def fit_splines(spark, d):
    p = models.fit("Splines", samples(spark, d), ["actor"])
    return p.select("actor", "degree", F.array_join(F.transform("coefficients", lambda c: F.round(c, 6).cast("string")), ",").alias("coefficients"))


@query(f"WITH {INSIDE}, m AS (SELECT actor, run, avg(y) AS v FROM inside GROUP BY actor, run) SELECT i.actor, i.run, round(i.t, 6) AS t, round(m.v, 6) AS state FROM inside i JOIN m ON i.actor = m.actor AND i.run = m.run WHERE i.t_end > i.t_start")
def state_constant(spark, d):
    return fitted_states(spark, d, "Constant").filter("t_end > t_start").select("actor", F.col("run").cast("long"), r6("t").alias("t"), r6("state").alias("state"))


@query(f"WITH {LINEAR} SELECT i.actor, i.run, round(i.t, 6) AS t, round(f.xstart + {S} * (f.xend - f.xstart), 6) AS state FROM inside i JOIN fitted f ON i.actor = f.actor AND i.run = f.run")
def state_linear(spark, d):
    return fitted_states(spark, d, "Linear").select("actor", F.col("run").cast("long"), r6("t").alias("t"), r6("state").alias("state"))


@query(f"WITH {SINE} SELECT i.actor, i.run, round(i.t, 6) AS t, round((f.xstart - f.xend) / 2 * cos(pi() * {S}) + (f.xstart + f.xend) / 2, 6) AS state FROM inside i JOIN fitted f ON i.actor = f.actor AND i.run = f.run")
def state_sinusoidal(spark, d):
    return fitted_states(spark, d, "Sinusoidal").select("actor", F.col("run").cast("long"), r6("t").alias("t"), r6("state").alias("state"))


@query(f"WITH {SINE} SELECT i.actor, i.run, round(i.t, 6) AS t, round(-pi() * (f.xstart - f.xend) / 2 * sin(pi() * {S}) / (i.t_end - i.t_start), 6) AS state_dot FROM inside i JOIN fitted f ON i.actor = f.actor AND i.run = f.run WHERE i.t_end > i.t_start")
def state_dot_sinusoidal(spark, d):
    return fitted_states(spark, d, "Sinusoidal", dot=True).filter("t_end > t_start").select("actor", F.col("run").cast("long"), r6("t").alias("t"), r6("state").alias("state_dot"))


@query(f"WITH {LINEAR} SELECT i.actor, i.run, round(i.t, 6) AS t, round((f.xend - f.xstart) / (i.t_end - i.t_start), 6) AS state_dot FROM inside i JOIN fitted f ON i.actor = f.actor AND i.run = f.run WHERE i.t_end > i.t_start")
def state_dot_linear(spark, d):
    return fitted_states(spark, d, "Linear", dot=True).filter("t_end > t_start").select("actor", F.col("run").cast("long"), r6("t").alias("t"), r6("state").alias("state_dot"))


CUBIC = dict(a1=36.0, b1=-30.0, c1=1.5, d1=0.25, a2=-36.0, b2=78.0, c2=-52.5, d2=9.25)


def _cubic_sql(k: int, slope: bool = False) -> str:
    a, b, c, e = (CUBIC[f"{x}{k}"] for x in "abcd")
    return f"((3 * {a} * s + 2 * {b}) * s + {c})" if slope else f"((({a} * s + {b}) * s + {c}) * s + {e})"


@query(f"WITH {RUNS}, n AS (SELECT actor, (t - min(t) OVER (PARTITION BY actor)) / nullif(max(t) OVER (PARTITION BY actor) - min(t) OVER (PARTITION BY actor), 0) AS s, t FROM samples) SELECT actor, round(t, 6) AS t, round(CASE WHEN s < 0.5 THEN {_cubic_sql(1)} ELSE {_cubic_sql(2)} END, 6) AS state, round(CASE WHEN s < 0.5 THEN {_cubic_sql(1, True)} ELSE {_cubic_sql(2, True)} END, 6) AS state_dot FROM n WHERE s IS NOT NULL")
def state_spline3knots(spark, d):
    p = parameters(**{k: F.lit(v) for k, v in CUBIC.items()})
    own = models.normalised(samples(spark, d), ["actor"]).filter("s is not null").withColumn("p", p)
    name = F.lit("Spline3Knots")
    return own.select("actor", r6("t").alias("t"), r6(models.value(name, F.col("p"), F.col("s"))).alias("state"), r6(models.derivative(name, F.col("p"), F.col("s"))).alias("state_dot"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN s < 0.5 THEN 20 * (1 - 2 * s) * (1 - 2 * s) + 21 * 2 * s * (2 - 3 * s) + 19 * 2 * s * s
ELSE 21 * 2 * (1 - s) * (1 - s) + 19 * 2 * (1 - s) * (3 * s - 1) + 22 * (2 * s - 1) * (2 * s - 1) END, 6) AS state FROM x""")
def state_bspline(spark, d):
    p = parameters(knots=F.array(*map(F.lit, [0.0, 0.0, 0.0, 0.5, 1.0, 1.0, 1.0])), coefficients=F.array(*map(F.lit, [20.0, 21.0, 19.0, 22.0, 0.0, 0.0, 0.0])), degree=F.lit(2))
    own = on_curves(spark, d, p, models.with_pieces)
    return own.select("l_orderkey", "l_linenumber", r6(models.value(F.lit("Splines"), F.col("p"), F.col("s"), F.col("pieces"))).alias("state"))


def on_curves(spark: SparkSession, d: str, p: Column, prepared) -> DataFrame:
    """A curve for each part, put in powers once, and on it the lines of the part as instants. Curves are far larger than Spark takes
    them to be from the table's size, so that they must not be sent to every task."""
    curves = prepared(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), p.alias("p"))).hint("merge")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("s")).join(curves, "l_partkey")


@query(f"WITH {LINEAR} SELECT r.actor, r.run, g.i, round(f.xstart + g.i / 4.0 * (f.xend - f.xstart), 6) AS state FROM runs r JOIN fitted f ON r.actor = f.actor AND r.run = f.run CROSS JOIN (SELECT unnest(range(0, 5)) AS i) g")
def grid_eval(spark, d):
    own = inside(spark, d)
    p = models.fit("Linear", own, KEYS).select(*KEYS, parameters(xstart=F.col("xstart"), xend=F.col("xend")).alias("p"))
    acts = segments.segments(samples(spark, d)).join(p, KEYS).withColumn("modelname", F.lit("Linear"))
    out = states.activity_states(acts, 5)
    return out.select("actor", F.col("run").cast("long"), F.round(F.col("s") * 4).cast("long").alias("i"), r6("state").alias("state"))


@query(SQL["grid_eval"])
def grid_eval_sql(spark, d):
    """As grid_eval, by a query in SQL over the registered functions."""
    register_sql(spark)
    own = inside(spark, d)
    p = models.fit("Linear", own, KEYS).select(*KEYS, parameters(xstart=F.col("xstart"), xend=F.col("xend")).alias("p"))
    acts = segments.segments(samples(spark, d)).join(p, KEYS).withColumn("modelname", F.lit("Linear"))
    return spark.sql("SELECT actor, CAST(run AS BIGINT) AS run, CAST(i AS BIGINT) AS i, round(state_value(modelname, p, t), 6) AS state FROM {acts} AS a, LATERAL instants(0, 1, 5) AS g", acts=acts)


def _acts(spark, d):
    own = inside(spark, d)
    p = models.fit("Linear", own, KEYS).select(*KEYS, parameters(xstart=F.col("xstart"), xend=F.col("xend")).alias("p"))
    return segments.segments(samples(spark, d)).filter("t_end > t_start").join(p, KEYS).select(F.lit("all").alias("scenario"), "actor", F.lit("SPEED").alias("state_variable"), F.col("run").alias("act_pos"), F.lit("Linear").alias("modelname"), "p", "t_start", "t_end")


LAST = f"WITH {LINEAR}, v AS (SELECT i.actor, i.t, i.run, f.xstart + {S} * (f.xend - f.xstart) AS state FROM inside i JOIN fitted f ON i.actor = f.actor AND i.run = f.run WHERE i.t_end > i.t_start)"


@query(f"{LAST} SELECT actor, round(t, 6) AS t, round(arg_max(state, run), 6) AS state FROM v GROUP BY actor, t")
def state_interval_join(spark, d):
    acts = _acts(spark, d)
    asked = samples(spark, d).select(F.lit("all").alias("scenario"), "actor", F.lit("SPEED").alias("state_variable"), "t")
    out = states.scenario_states(acts, asked, uncovered=False)
    return out.select("actor", r6("t").alias("t"), r6("state").alias("state"))


@query(f"""WITH {RUNS}, q AS (SELECT DISTINCT s.actor, g.t FROM samples s CROSS JOIN (SELECT unnest(range(-2, 40)) * 86400.0 AS t) g),
h AS (SELECT q.actor, q.t, count(r.run) AS n FROM q LEFT JOIN runs r ON q.actor = r.actor AND r.t_end > r.t_start AND q.t BETWEEN r.t_start AND r.t_end GROUP BY q.actor, q.t)
SELECT actor, count(*) AS instants, count(*) FILTER (n = 0) AS uncovered FROM h WHERE actor IN (SELECT actor FROM runs WHERE t_end > t_start) GROUP BY actor""")
def state_uncovered(spark, d):
    out = states.scenario_states(_acts(spark, d), [i * 86400.0 for i in range(-2, 40)])
    return out.groupBy("actor").agg(F.count("*").alias("instants"), F.count_if(F.isnan("state")).alias("uncovered"))


@query(f"WITH {LINEAR} SELECT i.label, round(sqrt(sum(power(i.y - (f.xstart + {S} * (f.xend - f.xstart)), 2)) / count({S})), 6) AS rmse FROM inside i JOIN fitted f ON i.actor = f.actor AND i.run = f.run GROUP BY i.label")
def fit_rmse(spark, d):
    own = fitted_states(spark, d, "Linear")
    return states.rmse(own, ["label"], "state", "y").select("label", r6("rmse").alias("rmse"))


@query(f"WITH {SAMPLES}, z AS (SELECT actor, t AS x, y FROM samples), o AS (SELECT actor, count(*) AS n, covar_pop(y, x) AS sxy, var_pop(x) AS sxx, var_pop(y) AS syy FROM z GROUP BY actor) SELECT actor, round(sqrt(greatest(0, syy - sxy * sxy / sxx)), 4) AS rmse FROM o WHERE n > 5")
def fit_shared_rmse(spark, d):
    own = samples(spark, d)
    many = own.groupBy("actor").count().filter("count > 5").select("actor")
    return models.fit_shared(own.join(many, "actor"), ["actor"], [F.lit(1.0), F.col("t") / 86400]).select("actor", F.round("rmse", 4).alias("rmse"))


@query(f"WITH {SAMPLES} SELECT actor, 3.0::DOUBLE AS level, (1 + count(*) % 3)::DOUBLE AS height, 1.5::DOUBLE AS turns, 0.4::DOUBLE AS phase, true AS converged FROM samples GROUP BY actor HAVING count(*) > 20")
def fit_wave(spark, d):
    """A wave over each actor's instants, whose level, height, turns and phase are found again."""
    own = models.normalised(samples(spark, d), ["actor"]).join(samples(spark, d).groupBy("actor").count().filter("count > 20"), "actor")
    wave = lambda p, s: p["level"] + p["height"] * F.sin(2 * F.pi() * p["turns"] * s + p["phase"])
    known = {"level": F.lit(3.0), "height": (1 + F.col("count") % 3).cast("double"), "turns": F.lit(1.5), "phase": F.lit(0.4)}
    own = own.withColumn("y", wave(known, F.col("s")))
    out = models.fit_nonlinear(own, ["actor"], wave, {"level": 2.0, "height": 1.0, "turns": 1.4, "phase": 0.6}, t="s")
    return out.select("actor", *(F.round(c, 4).alias(c) for c in known), "converged")


@query(f"WITH {SAMPLES} SELECT actor, round(t, 6) AS t, round((t - min(t) OVER (PARTITION BY actor)) / nullif(max(t) OVER (PARTITION BY actor) - min(t) OVER (PARTITION BY actor), 0), 6) AS s FROM samples")
def normalize_time(spark, d):
    return models.normalised(samples(spark, d), ["actor"]).select("actor", r6("t").alias("t"), r6("s").alias("s"))


# Tags: facts of the order tables mapped to tag names.
_LIST = lambda v: ", ".join(f"'{x}'" for x in v)
TAG = "tag AS (SELECT unnest([" + _LIST(TAGS) + "]) AS name)"
CLOSURE = f"{TAG}, closure AS (SELECT a.name AS sup, b.name AS sub FROM tag a JOIN tag b ON starts_with(b.name, a.name) OR (a.name = 'RoadUserType_Vehicle' AND b.name IN ({_LIST(VEHICLES)})))"
FLAGS = {"A": "VehicleLateralActivity_ChangingLane_Left", "N": "VehicleLateralActivity_ChangingLane_Right", "R": "VehicleLateralActivity_Turning_Left"}
STATUS = {"F": "RoadUserType_CategoryM_Bus", "O": "RoadUserType_VRU_Cyclist"}
PRIORITY = {"1-URGENT": "Weather_Rain_Heavy", "2-HIGH": "Weather_Rain_Light", "3-MEDIUM": "Weather_Snow_Light", "4-NOT SPECIFIED": "Lighting_Day_Cloudy", "5-LOW": "Lighting_Dark_Streetlights"}


def _map(column: str | Column, of: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col(column) if isinstance(column, str) else column)


def _case(column: str, of: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in of.items()) + " END"


@query(f"WITH {CLOSURE}, f AS (SELECT tag, count(*) AS n FROM (SELECT {_case('l_returnflag', FLAGS)} AS tag FROM lineitem UNION ALL SELECT {_case('l_linestatus', STATUS)} FROM lineitem UNION ALL SELECT {_case('o_orderpriority', PRIORITY)} FROM orders) x GROUP BY tag) SELECT sup, sub, coalesce(n, 0)::BIGINT AS n FROM closure LEFT JOIN f ON sub = tag")
def tag_closure_rows(spark, d):
    """The whole closure of tags: each tag with every one that it covers, and how many lines and orders have that one."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    some = li.select(_map("l_returnflag", FLAGS).alias("sub")).unionByName(li.select(_map("l_linestatus", STATUS).alias("sub"))).unionByName(o.select(_map("o_orderpriority", PRIORITY).alias("sub"))).groupBy("sub").agg(F.count("*").alias("n"))
    return tag_closure(spark).join(some, "sub", "left").select("sup", "sub", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"WITH {CLOSURE}, f AS (SELECT {_case('l_returnflag', FLAGS)} AS tag FROM lineitem UNION ALL SELECT {_case('l_linestatus', STATUS)} FROM lineitem) SELECT sup, count(*)::BIGINT AS n FROM f JOIN closure ON f.tag = closure.sub GROUP BY sup")
def tag_supertag_counts(spark, d):
    li = read(spark, d, "lineitem")
    facts = li.select(_map("l_returnflag", FLAGS).alias("tag")).unionByName(li.select(_map("l_linestatus", STATUS).alias("tag")))
    return containment.supertag_counts(facts).select("sup", F.col("n").cast("long").alias("n"))


def _customers(spark, d):
    """Customers as actors of the scenario of their nation; their orders as activities that they perform."""
    c = read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("owner"), F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("uid"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_acctbal") > 5000, F.array(F.lit("EgoVehicle"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("activity"), F.col("o_custkey").cast("string").alias("actor"), F.array(_map("o_orderpriority", PRIORITY)).alias("tags"))
    acts = o.join(c.select("owner", F.col("uid").alias("actor")), "actor").select("owner", "actor", "activity")
    return c, acts, o.select("activity", "tags")


DERIVED = f"""t AS (SELECT c_custkey, 'EgoVehicle' AS tag FROM customer WHERE c_acctbal > 5000 UNION SELECT o_custkey, {_case('o_orderpriority', PRIORITY)} FROM orders),
g AS (SELECT c.c_nationkey AS owner, c.c_custkey, c.c_mktsegment AS name, string_agg(t.tag, ',' ORDER BY t.tag) AS tags FROM customer c JOIN t ON c.c_custkey = t.c_custkey GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY owner, name ORDER BY c_custkey) AS i FROM g)"""


@query(f"WITH {DERIVED} SELECT c_custkey::VARCHAR AS object_uid, tags FROM k")
def derived_actor_tags(spark, d):
    return containment.derived_actor_tags(*_customers(spark, d)).select("object_uid", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {DERIVED} SELECT owner::VARCHAR AS owner, c_custkey::VARCHAR AS object_uid, name || CASE WHEN i > 1 THEN i::VARCHAR ELSE '' END || '::Actor' AS key FROM k")
def derived_tag_keys(spark, d):
    return containment.derived_actor_tags(*_customers(spark, d)).select("owner", "object_uid", "key")


# Candidates: orders with their lines as actors (equal lines of an order count once). Categories: required tags.
CATEGORIES = {
    "turning": [["VehicleLateralActivity_Turning"]],
    "vehicle_changes_lane": [["RoadUserType_Vehicle", "VehicleLateralActivity_ChangingLane"]],
    "bus_and_cyclist": [["RoadUserType_CategoryM_Bus"], ["RoadUserType_VRU_Cyclist"]],
    "left_and_any_vehicle": [["VehicleLateralActivity_ChangingLane_Left"], ["RoadUserType_Vehicle"]],
    "left_bus_and_lane_change": [["RoadUserType_CategoryM_Bus", "VehicleLateralActivity_ChangingLane_Left"], ["VehicleLateralActivity_ChangingLane"]],
}
OWN_TAGS = {"turning": "Weather_Rain", "vehicle_changes_lane": "Weather_Snow", "bus_and_cyclist": "Lighting_Dark_Streetlights", "left_and_any_vehicle": "Weather_Rain"}


def _categories(spark, with_own: bool = True):
    rows = [(c, "ActorCategory", f"{c}-{i}", tags) for c, objects in CATEGORIES.items() for i, tags in enumerate(objects)]
    if with_own:
        rows += [(c, "ScenarioCategory", c, [t]) for c, t in OWN_TAGS.items()]
    return spark.createDataFrame(rows, "owner string, class string, object_uid string, tags array<string>")


def _candidates(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = li.select(F.col("l_orderkey").cast("string").alias("owner"), F.lit("Actor").alias("class"), key.alias("object_uid"), F.array(_map("l_returnflag", FLAGS), _map("l_linestatus", STATUS)).alias("tags"))
    own = o.select(F.col("o_orderkey").cast("string").alias("owner"), F.lit("Scenario").alias("class"), F.col("o_orderkey").cast("string").alias("object_uid"), F.array(_map("o_orderpriority", PRIORITY)).alias("tags"))
    return lines.unionByName(own)


_WANTED = ", ".join(f"('{c}', '{c}-{i}', '{t}')" for c, objects in CATEGORIES.items() for i, tags in enumerate(objects) for t in tags)
_OWN = ", ".join(f"('{c}', '{t}')" for c, t in OWN_TAGS.items())
EDGES = f"""{CLOSURE},
want(category, own_uid, tag) AS (VALUES {_WANTED}), own(category, tag) AS (VALUES {_OWN}),
obj AS (SELECT DISTINCT l_orderkey::VARCHAR AS candidate, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS other_uid, unnest([{_case('l_returnflag', FLAGS)}, {_case('l_linestatus', STATUS)}]) AS tag FROM lineitem),
need AS (SELECT category, own_uid, count(*) AS wanted FROM want GROUP BY ALL),
hit AS (SELECT w.category, w.own_uid, o.candidate, o.other_uid, count(DISTINCT w.tag) AS n FROM want w JOIN closure c ON w.tag = c.sup JOIN obj o ON o.tag = c.sub GROUP BY ALL),
edge AS (SELECT h.category, h.candidate, h.own_uid, h.other_uid FROM hit h JOIN need USING (category, own_uid) WHERE h.n = need.wanted),
top AS (SELECT DISTINCT own.category, o_orderkey::VARCHAR AS candidate FROM own JOIN closure c ON own.tag = c.sup JOIN orders ON {_case('o_orderpriority', PRIORITY)} = c.sub),
degree AS (SELECT category, candidate, own_uid, count(*) AS n, min(other_uid) AS one FROM edge GROUP BY ALL),
size AS (SELECT category, count(*) AS n_own FROM need GROUP BY ALL),
pair AS (SELECT d.category, d.candidate, count(*) AS objects, count(DISTINCT CASE WHEN d.n = 1 THEN d.one ELSE d.own_uid END) AS free FROM degree d GROUP BY ALL),
found AS (SELECT p.category, p.candidate FROM pair p JOIN size s USING (category) WHERE p.objects = s.n_own AND p.free = s.n_own)"""


@query(f"WITH {EDGES} SELECT category, candidate FROM top")
def comprises_own_tags(spark, d):
    long = lambda df, c, u, kinds: df.filter(F.col("class").isin(kinds)).select(F.col("owner").alias(c), F.col("object_uid").alias(u), F.explode("tags").alias("tag"))
    out = containment.covered(long(_categories(spark), "category", "own_uid", ["ScenarioCategory"]), long(_candidates(spark, d), "candidate", "other_uid", ["Scenario"]))
    return out.select("category", "candidate").distinct()


@query(f"WITH {EDGES} SELECT category, candidate, own_uid, n AS degree FROM degree")
def object_match_edges(spark, d):
    long = lambda df, c, u, kinds: df.filter(F.col("class").isin(kinds)).select(F.col("owner").alias(c), F.col("object_uid").alias(u), F.explode("tags").alias("tag"))
    edges = containment.covered(long(_categories(spark), "category", "own_uid", ["ActorCategory"]), long(_candidates(spark, d), "candidate", "other_uid", ["Actor"]))
    return edges.groupBy("category", "candidate", "own_uid").agg(F.count("*").alias("degree"))


@query(f"WITH {EDGES} SELECT f.category, f.candidate FROM found f WHERE f.category NOT IN (SELECT category FROM own) OR (f.category, f.candidate) IN (SELECT category, candidate FROM top)")
def comprises_pairs(spark, d):
    return containment.contains(_categories(spark), _candidates(spark, d), "assignment")


@query()
def comprises_reference(spark, d):
    return containment.contains(_categories(spark), _candidates(spark, d), "reference")


def part_categories(spark, d):
    """Categories lifted from parts: of each brand what its small, middle and large parts show, of each type kinds above those."""
    p = read(spark, d, "part").withColumn("k", F.col("p_size") % 3)
    kinds = lambda some: F.element_at(F.array(*map(F.lit, some)), F.col("k") + 1)
    own = p.select(F.col("p_brand").alias("owner"), kinds(FINE).alias("tag")).unionByName(p.filter("k < 2").select(F.concat(F.lit("all "), "p_type").alias("owner"), kinds(COARSE).alias("tag")))
    return own.distinct().select("owner", F.lit("ActorCategory").alias("class"), F.concat_ws(":", "owner", "tag").alias("object_uid"), F.array("tag").alias("tags"))


FINE, COARSE = ("RoadUserType_CategoryM_Bus", "RoadUserType_VRU_Cyclist", "RoadUserType_CategoryN_LCV"), ("RoadUserType_Vehicle", "RoadUserType_VRU")
_LIFTED = "SELECT DISTINCT p_brand AS category, list_extract([{fine}], p_size % 3 + 1) AS tag FROM part UNION SELECT DISTINCT 'all ' || p_type, list_extract([{coarse}], p_size % 3 + 1) FROM part WHERE p_size % 3 < 2".format(fine=_LIST(FINE), coarse=_LIST(COARSE))


# Each object has one tag, all of a category differ, and neither of two kinds above others covers the other: so a category
# includes another just where each of its objects covers some object there, and where one covers two or more, others can have
# their own.
@query(f"""WITH {CLOSURE}, want AS ({_LIFTED}), size AS (SELECT category, count(*) AS n FROM want GROUP BY category),
hit AS (SELECT DISTINCT w.category, w.tag, o.category AS candidate FROM want w JOIN closure c ON w.tag = c.sup JOIN want o ON o.tag = c.sub),
pair AS (SELECT category, candidate, count(*) AS n FROM hit GROUP BY ALL)
SELECT p.category, p.candidate FROM pair p JOIN size s USING (category) WHERE p.n = s.n""")
def includes_pairs(spark, d):
    own = part_categories(spark, d)
    return containment.contains(own, own, "assignment")


# Parts of the store on their own; whole catalogs are in store_queries.


def _order_acts(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("actor"), F.col("l_suppkey").alias("activity"))


@query("SELECT l_orderkey AS owner, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL")
def acts_resolve(spark, d):
    actors = read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("uid"))
    return store.resolve_acts(_order_acts(spark, d), actors, read(spark, d, "supplier").select(F.col("s_suppkey").alias("uid"))).groupBy("owner").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey AS owner, l_partkey AS uid, min(l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
x AS (SELECT l_orderkey AS owner, l_partkey AS uid, min(l_linenumber) AS p FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT owner, uid FROM m) GROUP BY ALL)
SELECT owner, count(*) AS n, count(*) FILTER (NOT own) AS added FROM (SELECT owner, uid, true AS own FROM m UNION ALL SELECT owner, uid, false FROM x) GROUP BY owner""")
def missing_members_append(spark, d):
    acts = _order_acts(spark, d)
    m = read(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("uid")).agg(F.min("l_linenumber").alias("pos"))
    # m has a member once, so that those of an owner that aren't its own were added.
    every = store.append_missing(m, acts, "actor").select("owner", F.lit(1).alias("n"), F.lit(0).alias("own")).unionByName(m.select("owner", F.lit(0).alias("n"), F.lit(1).alias("own")))
    return every.groupBy("owner").agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("own")).alias("added"))


def _customer_items(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    return c.filter("uid % 3 <> 0"), c.filter("uid % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name"))


@query("SELECT c_custkey AS uid, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name ELSE c_name END AS name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def upsert_items(spark, d):
    return store.upsert(*_customer_items(spark, d))


@query("SELECT c_custkey AS uid, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def insert_if_absent(spark, d):
    return store.upsert(*_customer_items(spark, d), overwrite=False)


@query("SELECT c_custkey AS uid, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 <> 0")
def delete_items(spark, d):
    old, new = _customer_items(spark, d)
    return store.delete(old, new.select("uid"))


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS count FROM {t}" for t in TABLES))
def collection_counts(spark, d):
    return store.Catalog({t: read(spark, d, t) for t in TABLES}).counts()


@query("SELECT c_nationkey AS owner, min(c_custkey) AS uid FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey")
def actor_by_name(spark, d):
    members = read(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("name"))
    return store.by_name(members, "BUILDING").select("owner", "uid")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.time') AS time FROM events")
def event_props_lookup(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"), F.get_json_object("props", "$.time").alias("time"))


@query("SELECT e.event_id, s.s_name FROM events e JOIN supplier s ON s.s_suppkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)")
def message_network_join(spark, d):
    e = read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("network"))
    return e.join(read(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("network") == F.col("s_suppkey")).select("event_id", "s_name")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first_component FROM embeddings")
def vector_component(spark, d):
    return read(spark, d, "embeddings").select("vec_id", r6(F.col("embedding")[0].cast("double")).alias("first_component"))


@query(f"WITH {SAMPLES} SELECT round(t, 6) AS t, actor, label FROM samples ORDER BY t, actor LIMIT 5")
def signal_head(spark, d):
    return samples(spark, d).orderBy("t", "actor").limit(5).select(r6("t").alias("t"), "actor", "label")


@query(f"WITH {INSIDE}, m AS (SELECT actor, run, avg(y) AS v FROM inside GROUP BY actor, run) SELECT i.actor, round(sqrt(sum((i.y - m.v) * (i.y - m.v)) / count(*)), 6) AS rmse, count(*) AS n FROM inside i JOIN m ON i.actor = m.actor AND i.run = m.run GROUP BY i.actor")
def segment_fit_rmse(spark, d):
    """The flagship: signals cut into activities, a constant fitted to each, evaluated at every sample, and its error."""
    own = inside(spark, d)
    p = models.fit("Constant", own, KEYS)
    e = F.col("y") - F.col("xstart")
    return own.join(p, KEYS).groupBy("actor").agg(r6(F.sqrt(F.sum(e * e) / F.count("*"))).alias("rmse"), F.count("*").alias("n"))

