"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courselake.llm.common import map_arrow, stored


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, ints): floor(scale * x) of each component; vectors that are null, or hold null
    or non-finite components, and rows without an id are left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("ints"),
    )


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def rotation(ints: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, largest first, from their summed Gram matrix.

    Tasks send width x width sums; the driver decomposes one such matrix.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0).to_pylist(), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(g).reshape(width, width) for g in pdf["gram"]), np.zeros((width, width)))
        return pd.DataFrame({"gram": [total.tobytes()]})

    parts = map_arrow(ints.select("ints"), gram, "gram binary")
    lanes = parts.groupBy((F.rand(7) * 8).cast("int")).applyInPandas(add, "gram binary")
    total = sum((np.frombuffer(r[0]).reshape(width, width) for r in lanes.collect()), np.zeros((width, width)))
    values, vectors = np.linalg.eigh(total)
    return vectors[:, np.argsort(-values)]


def search_block(q_ids, q, known, c_ids, c, turn: np.ndarray, k: int, head: int, step: int = 512):
    """The k best of the block's candidates for each query, without those below ``known``, its k-th
    best elsewhere: arrays (query place, id, score).

    Candidates come by descending length. Of a chunk, those are scored in full whose partial sum
    over the first ``head`` rotated coordinates, plus the product of both remaining lengths
    (Cauchy-Schwarz), reaches the query's k-th best so far; a query leaves as soon as its length
    times the chunk's longest falls short. Bounds get a margin for rounding; scores are whole
    numbers, and only those that reach the k-th best are ranked.
    """
    order = np.lexsort((c_ids, -np.einsum("ij,ij->i", c.astype(float), c.astype(float))))
    c_ids, c = c_ids[order], c[order]
    qr, cr = q @ turn, c @ turn
    q_len, c_len = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    q_rest, c_rest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(cr[:, head:], axis=1)
    # below 2^52 every partial sum is a whole number that doubles hold, so the fast product is exact
    if q_len.max() * c_len[0] < 2.0**52:
        q, c = q.astype(float), c.astype(float)
    n, worst = len(q), -(2**62)
    best = np.full((n, k), worst)  # scores, descending
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    for start in range(0, len(c), step):
        part = slice(start, start + step)
        reach = np.maximum(best[:, -1], known)
        least = reach.astype(float)
        margin = 1e-9 * (1 + q_len * c_len[start])
        live = np.flatnonzero(q_len * c_len[start] + margin >= least)
        if not len(live):
            break
        bound = qr[live, :head] @ cr[part, :head].T + np.outer(q_rest[live], c_rest[part])
        passes = bound + margin[live, None] >= least[live, None]
        passes &= q_ids[live, None] != c_ids[None, part]
        rows, cols = np.nonzero(passes)
        if not len(rows):
            continue
        if len(rows) * 4 > passes.size:
            scores = (q[live] @ c[part].T).astype(np.int64)
            rows, cols = np.nonzero(passes & (scores >= reach[live, None]))
            score = scores[rows, cols]
        else:
            score = np.einsum("ij,ij->i", q[live[rows]], c[part][cols]).astype(np.int64)
            enough = score >= reach[live[rows]]
            rows, cols, score = rows[enough], cols[enough], score[enough]
        if not len(rows):
            continue
        live, rows = live[np.unique(rows)], np.unique(rows, return_inverse=True)[1]
        where = live[rows]
        # the running best and the newcomers, best first per query
        all_q = np.concatenate([np.repeat(live, k), where])
        all_s = np.concatenate([best[live].ravel(), score])
        all_i = np.concatenate([best_id[live].ravel(), c_ids[part][cols]])
        o = np.lexsort((all_i, -all_s, all_q))
        o = o[_place_in_run(all_q[o]) < k]
        best[live] = all_s[o].reshape(len(live), k)
        best_id[live] = all_i[o].reshape(len(live), k)
    where, rank = np.nonzero(best > worst)
    return where, best_id[where, rank], best[where, rank]


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _place_in_run(sorted_keys: np.ndarray) -> np.ndarray:
    first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    return np.arange(len(sorted_keys)) - np.maximum.accumulate(np.where(first, np.arange(len(sorted_keys)), 0))


def by_length(ints: DataFrame, rows: int, lead: int, classes: int) -> tuple[DataFrame, list]:
    """The vectors with ``class``, 0 for about the ``lead`` longest and then by falling squared length
    ``sq``, and per class (rows, largest sq). Equal lengths share a class, however many."""
    shares = [1 - lead / rows] if rows > lead else []
    shares += [(1 - lead / rows) * (classes - i) / classes for i in range(1, classes)] if shares else []
    cuts = ints.agg(F.percentile_approx("sq", shares, 10_000)).first()[0] if shares else []
    cuts = sorted(set(cuts), reverse=True)
    number = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        number = F.when(F.col("sq") >= cuts[i], i).otherwise(number)
    classed = ints.withColumn("class", number.cast("int"))
    facts = classed.groupBy("class").agg(F.count("*").alias("rows"), F.max("sq").alias("most")).collect()
    return classed, sorted((r["class"], r["rows"], r["most"]) for r in facts)


def top_inner_products(
    vectors: DataFrame, query_modulus: int = 20, k: int = 20, head: int = 24, block: int = 8192, classes: int = 16
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest inner products, exactly.

    Queries are the rows whose id is divisible by ``query_modulus``, candidates all rows with
    another id; ties go to the smaller id. Shorter vectors count as padded with zeros. An id that
    repeats is one query per distinct vector and a candidate per row. An empty table gives no
    rows; extra columns are not read.

    The candidates are cut into classes by descending length. First every query meets the longest
    ones, which gives it a k-th best to beat; then a query meets a later class only if its length
    times the class's longest reaches that. Inside a class both sides meet in blocks of about
    ``block`` rows, dealt by a hash of the row, so a length that many vectors share is spread over
    blocks; each pair of blocks is one group. Memory is bounded by the block.
    """
    ints = whole_vectors(vectors).withColumn(
        "sq", F.aggregate("ints", F.lit(0).cast("double"), lambda acc, x: acc + x.cast("double") * x)
    )
    ints = stored(ints)
    rows, width = ints.agg(F.count("*"), F.max(F.size("ints"))).first()
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    if not rows:
        return spark.createDataFrame([], result)
    width = max(width, 1)
    turn = rotation(ints, width)
    at = min(head, width)
    classed, facts = by_length(ints, rows, max(k + 1, block // 4), classes)
    asks = F.pmod("vec_id", F.lit(query_modulus)) == 0
    spread = F.xxhash64("vec_id", "ints")
    queries = ints.where(asks).select("vec_id", "ints", "sq", spread.alias("no")).distinct()
    q_blocks = max(1, -(-queries.count() // block))
    queries = queries.withColumn("qb", F.pmod("no", F.lit(q_blocks)))
    none = -(2**62)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        q_ids, c_ids = q["vec_id"].to_numpy(), c["vec_id"].to_numpy()
        if not len(q) or not len(c):
            return pd.DataFrame({n: pd.Series([], dtype="int64") for n in ("query_id", "query_no", "vec_id", "score")})
        place, ids, scores = search_block(
            q_ids, _matrix(q["ints"].tolist(), width), q["known"].to_numpy(np.int64),
            c_ids, _matrix(c["ints"].tolist(), width), turn, k, at,
        )
        return pd.DataFrame(
            {"query_id": q_ids[place], "query_no": q["no"].to_numpy()[place], "vec_id": ids, "score": scores}
        )

    def met(asking: DataFrame, some: list) -> DataFrame:
        """Queries with ``known`` against the classes of ``some``, pruned by length."""
        sizes = {number: max(1, -(-n * 2 // block)) for number, n, _ in some}
        # a relative margin for the rounding of both lengths
        worth = [
            F.when(F.sqrt(F.col("sq") * float(most)) * (1 + 1e-9) + 1 >= F.col("known"), F.lit(number))
            for number, _, most in some
        ]
        of_class = F.create_map(*(F.lit(x).cast("int") for pair in sizes.items() for x in pair))
        asking = asking.withColumn("class", F.explode(F.array_compact(F.array(*worth)))).select(
            F.lit(True).alias("asks"), "vec_id", "ints", "no", "known", "qb", "class",
            F.explode(F.sequence(F.lit(0), F.element_at(of_class, F.col("class")) - 1)).alias("cb"),
        )
        listed = classed.where(F.col("class").isin(list(sizes))).select(
            F.lit(False).alias("asks"), "vec_id", "ints", spread.alias("no"), F.lit(none).cast("long").alias("known"),
            _numbers(q_blocks).alias("qb"), "class",
            F.pmod(F.xxhash64(F.col("vec_id"), F.lit(3)), F.element_at(of_class, F.col("class"))).cast("int").alias("cb"),
        )
        return asking.unionByName(listed).groupBy("qb", "class", "cb").applyInPandas(
            search, "query_id long, query_no long, vec_id long, score long"
        )

    best = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    lead = ranked(met(queries.withColumn("known", F.lit(none).cast("long")), facts[:1]))
    if len(facts) == 1:
        return lead.select("query_id", "rank", "vec_id", "score")
    lead = stored(lead.drop("rank"))
    bounds = lead.groupBy(F.col("query_id").alias("vec_id"), F.col("query_no").alias("no")).agg(
        F.when(F.count("*") == k, F.min("score")).alias("kth")
    )
    known = queries.join(bounds, ["vec_id", "no"], "left").withColumn("known", F.coalesce("kth", F.lit(none))).drop("kth")
    found = met(known, facts[1:])
    return ranked(lead.unionByName(found)).select("query_id", "rank", "vec_id", "score")
