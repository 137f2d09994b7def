"""Independent SQL for the registered queries, written for a single-node SQL engine.

Nothing here is used to compute a Spark result. The relations are derived again
from the driver tables, and the marts keep their declarative form (correlated
look-ups, DISTINCT counts, FILTER), so that a rewrite on the Spark side is
checked against a different formulation.
"""
