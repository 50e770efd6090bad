"""Instants and states in SQL: functions that Catalyst puts into the query that calls them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .models import PARAMETERS

#: The SQL of a model's state and slope, over p, a struct of parameters, and s. A model of one's own can be added.
STATES = {
    "Constant": ("p.xstart + 0 * s", "0D * s"),
    "Linear": ("p.xstart + s * (p.xend - p.xstart)", "p.xend - p.xstart + 0 * s"),
    "Sinusoidal": ("(p.xstart - p.xend) / 2 * cos(pi() * s) + (p.xstart + p.xend) / 2", "-pi() * (p.xstart - p.xend) / 2 * sin(pi() * s)"),
    "Spline3Knots": (
        "CASE WHEN s < 0.5 THEN ((p.a1 * s + p.b1) * s + p.c1) * s + p.d1 ELSE ((p.a2 * s + p.b2) * s + p.c2) * s + p.d2 END",
        "CASE WHEN s < 0.5 THEN (3 * p.a1 * s + 2 * p.b1) * s + p.c1 ELSE (3 * p.a2 * s + 2 * p.b2) * s + p.c2 END",
    ),
}


def register_sql(spark: SparkSession) -> None:
    """Makes three temporary functions of the session: instants(t0, t1, n), a table of n equidistant instants t with their numbers
    i; state_value(modelname, p, s) and state_slope(modelname, p, s). What isn't a model in STATES raises when computed."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION instants(t0 DOUBLE, t1 DOUBLE, n INT) RETURNS TABLE(i INT, t DOUBLE)
        RETURN SELECT i, CASE WHEN n = 1 THEN t0 ELSE t0 + i * (t1 - t0) / (n - 1) END FROM (SELECT explode(sequence(0, n - 1)) AS i)"""
    )
    for k, name in enumerate(("state_value", "state_slope")):
        cases = " ".join(f"WHEN '{m}' THEN {v[k]}" for m, v in STATES.items())
        spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(modelname STRING, p {PARAMETERS}, s DOUBLE) RETURNS DOUBLE
            RETURN CASE modelname {cases} ELSE CAST(raise_error(concat('no scalar state of a model named ', modelname)) AS DOUBLE) END"""
        )
