"""SQL that takes the Newton steps of the small logistic entry and sums up calibrated scores."""

from __future__ import annotations

from oracles.relations import sql


def newton(steps: int = 8, C: float = 0.5) -> str:
    """Two scaled inputs and an intercept; each step solves its three equations by determinants."""
    ctes = {
        "tr": "SELECT * FROM scored WHERE split = 'train'",
        "x": """SELECT (clicks_7d - (SELECT avg(clicks_7d) FROM tr)) / (SELECT stddev_pop(clicks_7d) FROM tr) AS a,
                       (missing_due_to_date - (SELECT avg(missing_due_to_date) FROM tr))
                         / (SELECT stddev_pop(missing_due_to_date) FROM tr) AS b, y::DOUBLE AS y,
                       (SELECT count(*) FROM tr)::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS w FROM tr""",
        "n0": "SELECT 0.0::DOUBLE AS ca, 0.0::DOUBLE AS cb, 0.0::DOUBLE AS c",
    }
    for k in range(steps):
        ctes[f"s{k}"] = f"""
            SELECT {C} * sum(w * (p - y) * a) + max(ca) AS g1, {C} * sum(w * (p - y) * b) + max(cb) AS g2,
                   {C} * sum(w * (p - y)) AS g3, {C} * sum(w * p * (1 - p) * a * a) + 1 AS m11,
                   {C} * sum(w * p * (1 - p) * a * b) AS m12, {C} * sum(w * p * (1 - p) * a) AS m13,
                   {C} * sum(w * p * (1 - p) * b * b) + 1 AS m22, {C} * sum(w * p * (1 - p) * b) AS m23,
                   {C} * sum(w * p * (1 - p)) AS m33
            FROM (SELECT x.*, n.*, 1 / (1 + exp(-(ca * a + cb * b + c))) AS p FROM x, n{k} n)"""
        ctes[f"n{k + 1}"] = f"""
            SELECT ca - (g1 * (m22 * m33 - m23 * m23) - m12 * (g2 * m33 - m23 * g3) + m13 * (g2 * m23 - m22 * g3)) / d AS ca,
                   cb - (m11 * (g2 * m33 - m23 * g3) - g1 * (m12 * m33 - m23 * m13) + m13 * (m12 * g3 - g2 * m13)) / d AS cb,
                   c - (m11 * (m22 * g3 - g2 * m23) - m12 * (m12 * g3 - g2 * m13) + g1 * (m12 * m23 - m22 * m13)) / d AS c
            FROM (SELECT *, m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13) AS d
                  FROM s{k}), n{k}"""
    last = f"n{steps}"
    terms = " UNION ALL ".join(
        f"SELECT '{t}' AS term, {c} AS coefficient FROM {last}"
        for t, c in (("clicks_7d", "ca"), ("missing_due_to_date", "cb"), ("intercept", "c"))
    )
    return sql(
        "scored",
        f"""SELECT term, round(coefficient, 5) AS coefficient, round(exp(coefficient), 5) AS odds_ratio, true AS optimal,
                   round((SELECT sum(w * y) / sum(w) FROM x), 5) AS mean_probability
            FROM ({terms})""",
        **ctes,
    )


def calibrated_mean() -> str:
    """A fitted sigmoid keeps the mean of the smoothed targets."""
    return sql(
        "scored",
        """SELECT n, round((e * (e + 1) / (e + 2) + (n - e) / (n - e + 2)) / n, 4) AS mean_probability
           FROM (SELECT count(*) AS n, sum(y)::DOUBLE AS e FROM scored WHERE split = 'validation')""",
    )
