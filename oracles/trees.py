"""SQL that grows the trees of the model entries: one set of CTEs per level."""

from __future__ import annotations

from courselake.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from oracles.relations import sql

AKW = "code_module, code_presentation, id_student, course_week"


def inputs() -> dict[str, str]:
    """Training rows with a number, and their features in long form (rid, feature, value)."""
    parts = [
        f"""SELECT rid, {i} AS feature,
              round(coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM tr), 0), 9) AS value FROM tr"""
        for i, c in enumerate(NUMERIC_FEATURES)
    ]
    parts.append(f"SELECT rid, {len(NUMERIC_FEATURES)} + place AS feature, (t.known = k.known AND t.name = k.name)::INTEGER::DOUBLE AS value FROM marks t JOIN kinds k ON t.name = k.name")
    marks = " UNION ALL ".join(f"SELECT rid, '{c}' AS name, {c} AS known FROM tr" for c in CATEGORICAL_FEATURES)
    ordered = " WHEN ".join(f"'{c}' THEN {i}" for i, c in enumerate(CATEGORICAL_FEATURES))
    return {
        "tr": f"""SELECT *, right(code_presentation, 1) AS presentation_term, row_number() OVER (ORDER BY {AKW}) AS rid
                  FROM scored WHERE split = 'train'""",
        "marks": marks,
        "kinds": f"""SELECT name, known, row_number() OVER (ORDER BY CASE name WHEN {ordered} END, known) - 1 AS place
                     FROM (SELECT DISTINCT name, known FROM marks)""",
        "long": " UNION ALL ".join(parts),
    }


def grow(tag: str, measures: str, values: str, worth: str, depth: int, leaf: int) -> dict[str, str]:
    """CTEs of one tree; ``<tag>a<depth>`` holds the leaf of each row, ``<tag>b<k>`` the splits of level k."""
    def side(prefix: str) -> str:
        return worth.format(f=f"{prefix}1", s=f"{prefix}2")

    out = {f"{tag}a0": f"SELECT rid, 1 AS node FROM {measures}"}
    for k in range(depth):
        out[f"{tag}h{k}"] = f"""
            SELECT node, feature, value, sum(first) AS s1, sum(second) AS s2, count(*) AS n
            FROM {tag}a{k} JOIN {values} USING (rid) JOIN {measures} USING (rid)
            WHERE node >= {1 << k} GROUP BY node, feature, value"""
        out[f"{tag}r{k}"] = f"""
            SELECT *, t1 - l1 AS r1, t2 - l2 AS r2 FROM (
              SELECT node, feature, value, sum(s1) OVER up AS l1, sum(s2) OVER up AS l2, sum(n) OVER up AS ln,
                     sum(s1) OVER every AS t1, sum(s2) OVER every AS t2, sum(n) OVER every AS tn
              FROM {tag}h{k}
              WINDOW up AS (PARTITION BY node, feature ORDER BY value),
                     every AS (PARTITION BY node, feature))
            WHERE ln >= {leaf} AND tn - ln >= {leaf}"""
        out[f"{tag}b{k}"] = f"""
            SELECT node, feature, value AS cut FROM (
              SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, feature, value) AS place
              FROM (SELECT *, {side("l")} + {side("r")} - {side("t")} AS gain FROM {tag}r{k}) WHERE gain > 1e-7)
            WHERE place = 1"""
        out[f"{tag}a{k + 1}"] = f"""
            SELECT a.rid, CASE WHEN b.node IS NULL THEN a.node ELSE 2 * a.node + (v.value > b.cut)::INTEGER END AS node
            FROM {tag}a{k} a LEFT JOIN {tag}b{k} b ON a.node = b.node
            LEFT JOIN {values} v ON v.rid = a.rid AND v.feature = b.feature"""
    return out


def exact_splits(depth: int = 2, leaf: int = 100) -> str:
    """Every node of the decision tree, with feature, cut point, rows and event probability."""
    ctes = inputs()
    ctes["w"] = """
        SELECT rid, CASE WHEN y = 1 THEN weight ELSE 0 END AS first, CASE WHEN y = 1 THEN 0 ELSE weight END AS second
        FROM (SELECT rid, y, (SELECT count(*) FROM tr)::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS weight FROM tr)"""
    ctes |= grow("d", "w", "long", "({f} * {f} + {s} * {s}) / ({f} + {s})", depth, leaf)
    numeric = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(NUMERIC_FEATURES))
    ctes["names"] = f"""
        SELECT feature, coalesce(CASE feature {numeric} END, k.name || '=' || k.known) AS label
        FROM (SELECT DISTINCT feature FROM long) LEFT JOIN kinds k ON feature = {len(NUMERIC_FEATURES)} + k.place"""
    nodes = " UNION ALL ".join(
        f"""SELECT a.node, b.feature, a.first, a.second, a.value, b.cut
            FROM (SELECT a.rid, a.node, w.first, w.second, v.value FROM da{k} a JOIN w USING (rid)
                  LEFT JOIN {f'db{k}' if k < depth else '(SELECT 0 AS node, 0 AS feature)'} s ON s.node = a.node
                  LEFT JOIN long v ON v.rid = a.rid AND v.feature = s.feature WHERE a.node >= {1 << k}) a
            LEFT JOIN {f'db{k}' if k < depth else '(SELECT 0 AS node, 0 AS feature, 0.0 AS cut)'} b ON a.node = b.node"""
        for k in range(depth + 1)
    )
    ctes["nodes"] = nodes
    return sql(
        "scored",
        """SELECT n.node::INTEGER AS node, l.label AS feature,
                  round((max(value) FILTER (value <= cut) + min(value) FILTER (value > cut)) / 2, 6) AS cut,
                  count(*) AS rows, round(sum(first) / sum(first + second), 6) AS probability
           FROM nodes n LEFT JOIN names l ON l.feature = n.feature GROUP BY n.node, l.label""",
        **ctes,
    )


def boosted_leaves(rounds: int = 2, depth: int = 2, rate: float = 0.08, penalty: float = 1.0, leaf: int = 20) -> str:
    """Every leaf of the first boosted trees, with rows, gradient and hessian sums and value."""
    ctes = inputs()
    ctes["bins"] = """
        SELECT rid, feature, CASE WHEN max(place) OVER (PARTITION BY feature) <= 255 THEN place - 1
                                  ELSE floor(255 * before / total) END AS value
        FROM (SELECT rid, feature, dense_rank() OVER (PARTITION BY feature ORDER BY value) AS place,
                     rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS before,
                     count(*) OVER (PARTITION BY feature) AS total FROM long)"""
    ctes["m0"] = "SELECT rid, y, (SELECT ln(avg(y) / (1 - avg(y))) FROM tr) AS margin FROM tr"
    parts = []
    for t in range(rounds):
        ctes[f"p{t}"] = f"SELECT rid, y, margin, 1 / (1 + exp(-margin)) AS p FROM m{t}"
        ctes[f"g{t}"] = f"SELECT rid, p - y AS first, p * (1 - p) AS second FROM p{t}"
        ctes |= grow(f"t{t}", f"g{t}", "bins", "({f} * {f}) / ({s} + %s)" % penalty, depth, leaf)
        ctes[f"v{t}"] = f"""
            SELECT node, count(*) AS rows, sum(first) AS gradient, sum(second) AS hessian,
                   -{rate} * sum(first) / (sum(second) + {penalty}) AS value
            FROM t{t}a{depth} JOIN g{t} USING (rid) GROUP BY node"""
        ctes[f"m{t + 1}"] = f"""
            SELECT rid, y, margin + value AS margin FROM m{t} JOIN t{t}a{depth} USING (rid) JOIN v{t} USING (node)"""
        parts.append(f"SELECT {t} AS tree, node::INTEGER AS leaf, rows, round(gradient, 5) AS gradient, round(hessian, 5) AS hessian, round(value, 6) AS value FROM v{t}")
    return sql("scored", " UNION ALL ".join(parts), **ctes)
