"""Hard-negative mining over an inverted multi-index with certified stops.

Vectors are halved and each half has a codebook; a pair of codes is a cell, with a list of its
vectors. A query's inner product with a vector of cell (i, j) is at most
    q1 . c1[i] + |q1| r1[i]  +  q2 . c2[j] + |q2| r2[j],
where r is the largest distance of a code's vectors from it. The multi-sequence heap takes the cells
in falling order of this sum of half-score bounds. It stops at the first cell that cannot reach what
is already found, which certifies the result: all that was not visited scores less.

Searches run in two waves each: the first cells give every query a score to reach, then the heap
goes on down to that score. Visits are dealt by cell, a large cell in parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from courselake.llm.common import map_arrow, stored

LOW = -(2**62)


def whole_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, ints) of the rows that take part, with floor(scale * x) of each component."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    ).select(
        F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("ints"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as rows of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of the points by Lloyd's rounds from evenly spread points; a centre without points stays."""
    centres = points[np.linspace(0, len(points) - 1, codes).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        count = np.bincount(at, minlength=codes)
        for k in np.flatnonzero(count):
            centres[k] = points[at == k].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centres, centres) - 2 * (points @ centres.T)).argmin(axis=1)


class MultiIndex:
    """Codebooks of both halves, each code's radius, and the number of vectors in each cell."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray]):
        self.books = books
        self.codes = len(books[0])
        self.radii = (np.zeros(self.codes), np.zeros(self.codes))
        self.count = np.zeros((self.codes, self.codes), np.int64)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = self.books[0].shape[1]
        return vectors[:, :middle].astype(float), vectors[:, middle:].astype(float)

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Upper and lower bounds of the half scores by code: (upper1, upper2, lower1, lower2)."""
        upper, lower = [], []
        for half, book, radius in zip(self.halves(query[None]), self.books, self.radii):
            middle, reach = book @ half[0], np.linalg.norm(half[0]) * radius
            slack = 1e-9 * (1 + np.abs(middle) + reach)
            upper.append(middle + reach + slack)
            lower.append(middle - reach - slack)
        return upper[0], upper[1], lower[0], lower[1]

    def cells(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, i, j) of all cells with vectors, in falling order of first[i] + second[j].

        The multi-sequence: a cell enters the heap when its neighbours before it in both sorted
        lists have left it.
        """
        rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        a, b = first[rows], second[columns]
        done = np.zeros(len(a), np.int64)  # how many columns of a row have left the heap
        heap = [(-(a[0] + b[0]), 0, 0)]
        while heap:
            bound, r, c = heapq.heappop(heap)
            i, j = int(rows[r]), int(columns[c])
            if self.count[i, j]:
                yield -bound, i, j
            done[r] = c + 1
            if c + 1 < len(b) and (r == 0 or done[r - 1] > c + 1):
                heapq.heappush(heap, (-(a[r] + b[c + 1]), r, c + 1))
            if r + 1 < len(a) and done[r + 1] == c:
                heapq.heappush(heap, (-(a[r + 1] + b[c]), r + 1, c))


def built_index(rows: DataFrame, width: int, cell_rows: int, most_codes: int, sample_rows: int) -> tuple[MultiIndex, DataFrame]:
    """The multi-index and the rows with their cell (number i * codes + j).

    Codebooks are fitted on about ``sample_rows`` rows chosen by hash, fewer if these would exceed
    64 MB; every row is indexed. A half has as many codes as give a cell ``cell_rows`` rows, at most
    ``most_codes``, so that books, radii and counts have a bounded size.
    """
    n = rows.count()
    take = max(1, min(sample_rows, (64 << 20) // (8 * width)))
    some = rows.select("ints").where(F.pmod(F.xxhash64("vec_id", "ints", F.lit(5)), F.lit(max(1, n // take))) == 0).limit(2 * take)
    sample = _matrix(some.toArrow().column(0), width)
    if not len(sample):
        sample = _matrix(rows.select("ints").limit(1).toArrow().column(0), width)
    codes = max(1, min(round((n / cell_rows) ** 0.5), most_codes, len(sample)))
    middle = width // 2
    index = MultiIndex(tuple(codebook(sample[:, part].astype(float), codes) for part in (slice(0, middle), slice(middle, width))))
    vectors = index  # the books alone are used inside tasks here

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes_of, far = [], []
            for half, book in zip(vectors.halves(_matrix(batch.column(2), width)), vectors.books):
                at = nearest(half, book)
                codes_of.append(at)
                far.append(np.linalg.norm(half - book[at], axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int32()) for c in codes_of), *(pa.array(f) for f in far)],
                ["vec_id", "label", "ints", "i", "j", "far1", "far2"],
            )

    placed = stored(
        map_arrow(rows.select("vec_id", "label", "ints"), place,
                  "vec_id long, label string, ints array<long>, i int, j int, far1 double, far2 double")
    )
    for r in placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("far1").alias("f1"), F.max("far2").alias("f2")).collect():
        index.count[r["i"], r["j"]] = r["n"]
        index.radii[0][r["i"]] = max(index.radii[0][r["i"]], r["f1"])
        index.radii[1][r["j"]] = max(index.radii[1][r["j"]], r["f2"])
    return index, placed.select("vec_id", "label", "ints", (F.col("i").cast("long") * codes + F.col("j")).alias("cell"))


def _best_of_rows(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of each row; columns are in tie order."""
    m = score.shape[1]
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if np.abs(score).max() < 2**62 // m:
        key = np.where(allowed, score * m + (m - 1 - np.arange(m)), LOW)
        at = np.argpartition(-key, min(k, m) - 1, axis=1)[:, :k] if m > k else np.broadcast_to(np.arange(m), score.shape)
    else:
        at = np.argsort(np.where(allowed, -score, -LOW), axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(score)), at.shape[1])
    columns = at.ravel()
    fine = allowed[rows, columns]
    return rows[fine], columns[fine]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where these hold every partial sum."""
    most = np.linalg.norm(queries.astype(float), axis=1).max(initial=0) * np.linalg.norm(rows.astype(float), axis=1).max(initial=0)
    if most < 2.0**52:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    return queries @ rows.T


def _search(index_rows: DataFrame, cells: DataFrame, queries: DataFrame, visits: DataFrame, width: int, find, names: list[str], batches: int) -> DataFrame:
    """Runs ``find(queries table, query matrix, rows table, row matrix)`` on every visited cell.

    Groups are (cell, part, batch of queries); a cell's rows go once to each batch that visits it.
    Both sides' keys must have the same types (cell long, part and batch int): an int and a long
    of one value hash to different partitions, and a cogroup does not cast.
    """
    asked = (
        visits.withColumn("batch", F.pmod(F.xxhash64("query", F.lit(9)), F.lit(batches)).cast("int"))
        .join(F.broadcast(cells), "cell")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    )
    met = asked.groupBy("cell", "part", F.col("batch").alias("met")).agg(F.count("*"))
    lists = (
        index_rows.join(F.broadcast(cells), "cell")
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "ints"), F.col("parts")).cast("int"))
        .join(met.select("cell", "part", "met"), ["cell", "part"])
        .select("cell", "part", "met", "vec_id", "label", "ints")
    )

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in empty], schema=empty)
        right = right.sort_by("vec_id")
        rows = _matrix(right.column("ints"), width)
        out = []
        for start in range(0, left.num_rows, 256):
            some = left.slice(start, 256)
            queries = _matrix(some.column("ints"), width)
            out.append(find(some, queries, right, rows))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, empty)], schema=empty)

    empty = pa.schema([(n, pa.bool_() if n == "same" else pa.int64()) for n in names])
    schema = ", ".join(f"{n} {'boolean' if n == 'same' else 'long'}" for n in names)
    left = asked.join(queries, "query").groupBy("cell", "part", "batch")
    return left.cogroup(lists.groupBy("cell", "part", "met")).applyInArrow(work, schema)


def _visits(queries: DataFrame, width: int, choose) -> DataFrame:
    """(query, cell), stored: the cells that ``choose(row, vector)`` takes of the heap's."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("ints"), width)
            told = batch.drop_columns(["ints"]).to_pylist()
            for row, vector in zip(told, vectors):
                taken = choose(row, vector)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["query"]] * len(taken), pa.int64()), pa.array(taken, pa.int64())], ["query", "cell"]
                )

    return stored(map_arrow(queries, walk, "query long, cell long"))


def hard_negatives(
    vectors: DataFrame,
    anchor_modulus: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    cell_rows: int = 256,
    most_codes: int = 256,
    sample_rows: int = 16384,
    seed_rows: int = 1024,
    part_rows: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exactly.

    Anchors are the rows whose vec_id is divisible by ``anchor_modulus``, candidates all rows. A
    score is the inner product of floor(scale * x). An anchor's positives are its best other rows
    of the same label; for each, the best rows of another label follow whose score lies between
    ``low`` and ``high`` percent of the positive's. Ties go to the smaller vec_id.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part;
    shorter vectors count as padded with zeros. Repeated rows are rows of their own: an anchor
    leaves out one copy of itself, and each copy of an anchor gets its rows. An empty table gives
    no rows; extra columns are not read. Scores are whole numbers of 64 bits.

    Of rows equal in vector and label only the smallest ids can be among the results, so the index
    holds these, and equal anchors are searched for once, with one positive more, since each leaves
    out itself. That keeps large groups of copies out of the lists.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = vectors.sparkSession
    rows = whole_rows(vectors, scale)
    width = rows.agg(F.max(F.size("ints"))).first()[0]
    if width is None:
        return spark.createDataFrame([], out)
    width = max(width, 2)
    padded = F.concat("ints", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("ints")))
    rows = stored(rows.withColumn("ints", padded))
    k = positives + 1
    equal = Window.partitionBy("label", "ints").orderBy("vec_id")
    index, placed = built_index(
        rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= max(k, negatives)).drop("place"),
        width, cell_rows, most_codes, sample_rows,
    )
    anchors = rows.where(F.pmod("vec_id", F.lit(anchor_modulus)) == 0)
    queries = stored(
        anchors.select("label", "ints").distinct().withColumn("query", F.monotonically_increasing_id())
    )
    batches = max(1, -(-queries.count() // 2048))
    codes = index.codes
    sizes = [(int(i * codes + j), int(-(-index.count[i, j] // part_rows))) for i, j in np.argwhere(index.count)]
    cells = spark.createDataFrame(sizes, "cell long, parts int")  # at most most_codes^2 rows

    def first_cells(row, vector) -> list[int]:
        seen, taken = 0, []
        for _, i, j in index.cells(*index.bounds(vector)[:2]):
            if seen >= seed_rows:
                break
            seen += index.count[i, j]
            taken.append(i * codes + j)
        return taken

    # positives
    def same_label(some, q, right, r):
        score = _products(q, r)
        allowed = np.equal.outer(some.column("label").to_numpy(), right.column("label").to_numpy())
        at, to = _best_of_rows(score, allowed, k)
        ids = right.column("vec_id").to_numpy()
        return some.column("query").to_numpy()[at], ids[to], score[at, to], (q[at] == r[to]).all(axis=1)

    def best_positives(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)

    def positive_rows(visits: DataFrame) -> DataFrame:
        return _search(placed, cells, queries, visits, width, same_label, ["query", "vec_id", "score", "same"], batches)

    seeds = stored(best_positives(positive_rows(_visits(queries.select("query", "ints"), width, first_cells))).drop("at"))
    reach = seeds.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))

    def more_cells(row, vector) -> list[int]:
        seen, taken, least = 0, [], row["least"]
        for bound, i, j in index.cells(*index.bounds(vector)[:2]):
            if least is not None and bound < least:
                break
            if seen >= seed_rows:
                taken.append(i * codes + j)
            seen += index.count[i, j]
        return taken

    told = queries.join(reach, "query", "left")
    rest = positive_rows(_visits(told.select("query", "ints", "least"), width, more_cells))
    best = stored(best_positives(seeds.unionByName(rest)))

    # negatives: per positive score a window of scores; below 0 the window is empty
    lists = best.where("score >= 0").groupBy("query").agg(F.sort_array(F.collect_set("score"), asc=False).alias("marks"))
    asking = stored(queries.join(lists, "query"))

    def other_label(some, q, right, r):
        score = _products(q, r)
        other = ~np.equal.outer(some.column("label").to_numpy(), right.column("label").to_numpy())
        marks = some.column("marks").to_pylist()
        ids, names = right.column("vec_id").to_numpy(), some.column("query").to_numpy()
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for n in range(max(len(m) for m in marks)):
            mark = np.array([m[n] if n < len(m) else 0 for m in marks], np.int64)[:, None]
            has = np.array([n < len(m) for m in marks])[:, None]
            inside = other & has & (low * mark <= 100 * score) & (100 * score <= high * mark)
            at, to = _best_of_rows(score, inside, negatives)
            for column, values in zip(out, (names[at], mark[at, 0], ids[to], score[at, to])):
                column.append(values)
        return tuple(np.concatenate(c) for c in out)

    def best_negatives(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query", "mark").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)

    def negative_rows(visits: DataFrame) -> DataFrame:
        return _search(placed, cells, asking, visits, width, other_label, ["query", "mark", "vec_id", "score"], batches)

    def window_cells(row, vector, needed: dict) -> Iterator[tuple[int, int]]:
        """(cell, rows seen before) of the cells that can hold a score inside an open window."""
        up1, up2, down1, down2 = index.bounds(vector)
        seen = 0
        highest = max(high * m for m in row["marks"])
        for bound, i, j in index.cells(up1, up2):
            if 100 * bound < min(needed.values()):
                break
            if 100 * (down1[i] + down2[j]) > highest:
                continue  # all of the cell lies above every window
            yield i * codes + j, seen
            seen += index.count[i, j]

    def first_window_cells(row, vector) -> list[int]:
        needed = {m: low * m for m in row["marks"]}
        taken = []
        for cell, seen in window_cells(row, vector, needed):
            if seen >= seed_rows:
                break
            taken.append(cell)
        return taken

    def more_window_cells(row, vector) -> list[int]:
        needed = {m: low * m for m in row["marks"]}
        first = set(first_window_cells(row, vector))
        for mark in row["certain"] or []:
            needed[mark["mark"]] = max(needed[mark["mark"]], 100 * mark["least"])
        return [cell for cell, _ in window_cells(row, vector, needed) if cell not in first]

    seeds = stored(best_negatives(negative_rows(_visits(asking.select("query", "ints", "marks"), width, first_window_cells))).drop("rank"))
    third = seeds.groupBy("query", "mark").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= negatives)
    certain = third.groupBy("query").agg(F.collect_list(F.struct("mark", "least")).alias("certain"))
    told = asking.join(certain, "query", "left")
    rest = negative_rows(_visits(told.select("query", "ints", "marks", "certain"), width, more_window_cells))
    mined = stored(best_negatives(seeds.unionByName(rest)))

    # every anchor takes its query's answer, without itself
    hits = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score", "same"))).alias("hits"))
    windows = mined.groupBy("query").agg(F.collect_list(F.struct("mark", "rank", "vec_id", "score")).alias("mined"))
    answers = queries.join(hits, "query").join(windows, "query")
    itself = F.get(F.filter("hits", lambda h: h["same"] & (h["vec_id"] == F.col("anchor_id"))), F.lit(0))["at"]
    per_anchor = anchors.withColumnRenamed("vec_id", "anchor_id").join(answers, ["label", "ints"]).select(
        "anchor_id", "mined",
        F.explode(F.slice(F.filter("hits", lambda h: h["at"] != F.coalesce(itself, F.lit(0))), 1, positives)).alias("hit"),
    )
    return per_anchor.select(
        "anchor_id", "hit", F.explode(F.filter("mined", lambda m: m["mark"] == F.col("hit.score"))).alias("m")
    ).select(
        "anchor_id", F.col("hit.vec_id").alias("positive_id"), F.col("m.rank").alias("rank"),
        F.col("m.vec_id").alias("negative_id"), F.col("hit.score").alias("positive_score"),
        F.col("m.score").alias("negative_score"),
    )
