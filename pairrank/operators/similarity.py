"""Exact cosine similarity between two vector tables.

Both inputs carry an id, a unique ``long`` position (the order used to break ties)
and an array of numbers. Nothing here plans a cross join:

* if one side is proven small it is broadcast and the other side is streamed
  past it in place, without a shuffle;
* otherwise the pair space is cut into a grid of cells. Each vector is copied to
  the cells of its row or column, one shuffle brings the copies of a cell together, its
  jobs first, and the candidates stream past the jobs, which are bounded.

Only what the caller asked for leaves a task: all scores, the scores above a
threshold or their number, or the best ``k`` candidates of each job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairrank.runtime import measure

CANDIDATE = ("candidate_id", "candidate_position")
JOB = ("job_id", "job_position")
BAR = ("bar", "bar_job_position")

SMALL_SIDE_BYTES = 32 << 20
# Of the jobs of a cell, as doubles. A worker holds some five times that; candidates stream past them.
CELL_BYTES = 32 << 20
# Candidates of a cell, in multiples of its jobs; they are sorted, not held.
CELL_STREAM = 4
# Cells for each task slot, so that slots are done at about the same time.
CELLS_PER_SLOT = 4
# Partitions of the grid, in multiples of the session's shuffle partitions.
CELL_PARTITIONS = 16
# Of the copies that one task makes, before the shuffle.
COPIED_BYTES = 128 << 20
TILE_CANDIDATES = 2048
TILE_JOBS = 512
ROWS_PER_BATCH = 1 << 16
# Jobs that are scored together; their tile stays in the processor's cache.
JOBS_AT_ONCE = 16
# Jobs whose scores are binned together, likewise.
BINNED_AT_ONCE = 64
# Vectors of either side that are copied out at once to score single pairs.
GATHERED_BYTES = 4 << 20
# Cells of a grid that a task keeps and emits at most.
MAX_BINS = 1 << 20
# The single-precision product pays where at most one pair in this many survives it.
SINGLE_PRECISION_BELOW = 16
# From this many pairs on, a streamed side that sits in few tasks is spread first.
SPREAD_FROM_PAIRS = 1 << 24


def as_candidates(df: DataFrame, id: str, position: str | Column, embedding: str = "embedding") -> DataFrame:
    """Shape a table into the candidate side of a match."""
    return _side(df, CANDIDATE, id, position, embedding)


def as_jobs(df: DataFrame, id: str, position: str | Column, embedding: str = "embedding") -> DataFrame:
    """Shape a table into the job side of a match."""
    return _side(df, JOB, id, position, embedding)


def _side(df, names, id, position, embedding):
    position = F.col(position) if isinstance(position, str) else position
    return df.select(
        F.col(id).alias(names[0]), position.cast("long").alias(names[1]), F.col(embedding).alias("embedding")
    )


def drop_missing_vectors(df: DataFrame) -> DataFrame:
    """Leave out rows without a vector; the joins below fail on them otherwise."""
    return df.where(F.col("embedding").isNotNull())


def pair_similarity(candidates: DataFrame, jobs: DataFrame, **options) -> DataFrame:
    """Every candidate scored against every job, in long form.

    Tasks hand on blocks, whose scores lie in one list; Spark makes the rows of them.
    """
    pairs = pair_schema(candidates, jobs)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in pairs])
    blocks = _score(candidates, jobs, _AllPairs, schema=schema, **options)
    down, across = (F.expr(f"cast(_at {part} size({JOB[0]}) as int)") for part in ("div", "%"))
    scores = blocks.select(*CANDIDATE, *JOB, F.posexplode("similarity").alias("_at", "similarity"))
    return scores.select(*(F.get(c, down).alias(c) for c in CANDIDATE), *(F.get(c, across).alias(c) for c in JOB), "similarity")


def pairs_above(candidates: DataFrame, jobs: DataFrame, threshold: float = 0.5, counted: bool = False, **options) -> DataFrame:
    """The pairs scoring at least ``threshold``; lower ones never leave the scoring task.

    With ``counted`` they are counted there: ``job_id, job_position, n``, several rows per job, none
    for a job without pairs.
    """
    if counted:
        job = [T.StructField(f.name, f.dataType) for name in JOB for f in jobs.schema if f.name == name]
        schema = T.StructType([*job, T.StructField("n", T.LongType())])
        return _score(candidates, jobs, lambda *a: CountsAbove(threshold, *a), schema=schema, **options)
    return _score(candidates, jobs, lambda *a: PairsAbove(threshold, *a), **options)


def best_per_job(candidates: DataFrame, jobs: DataFrame, k: int, positive: bool = False, **options) -> DataFrame:
    """A superset of each job's ``k`` best pairs, at most ``k`` per job from each task.

    Feed it to :func:`pairrank.operators.ranking.rank_candidates` for the final cut.
    ``positive`` leaves out scores that are not above 0. If candidates carry ``bar`` and
    ``bar_job_position``, a pair must also score above its candidate's bar, or as high
    with a job position that is not higher.
    """
    return _score(candidates, jobs, lambda *a: BestPerJob(k, positive, *a), **options)


def binned_scores(candidates: DataFrame, jobs: DataFrame, y_bins: int, x_bins: int, n_candidates: int, n_jobs: int,
                  decimals: int = 9, **options) -> DataFrame:
    """All pairs counted into a grid: ``y, x, n, total, highest``, several rows per cell.

    Positions must number each side 0, 1, 2, ...; a side is cut into bins of equally many
    places. ``total`` is in units of the last decimal, a whole number, so it does not depend on
    the plan. Scores that are no number are not counted. A task emits at most the grid.
    """
    if y_bins < 1 or x_bins < 1 or y_bins * x_bins > MAX_BINS:
        raise ValueError(f"the grid has 1 to {MAX_BINS} cells")
    schema = T.StructType.fromDDL("y long, x long, n long, total long, highest double")
    return _score(candidates, jobs, lambda *a: BinnedScores(y_bins, x_bins, n_candidates, n_jobs, *a), decimals, schema=schema, **options)


def threshold_mask(pairs: DataFrame, threshold: float = 0.5, score: str = "similarity") -> DataFrame:
    """Keep every pair but blank the scores below ``threshold`` (NaN never passes)."""
    return pairs.withColumn(score, F.when(_reaches(score, threshold), F.col(score)))


def threshold_rows(pairs: DataFrame, threshold: float = 0.5, score: str = "similarity") -> DataFrame:
    """Keep only the pairs reaching ``threshold`` (NaN never passes)."""
    return pairs.where(_reaches(score, threshold))


def positive_pairs(pairs: DataFrame, score: str = "similarity") -> DataFrame:
    """Pairs that may take part in an assignment."""
    return pairs.where((F.col(score) > 0) & ~F.isnan(score))


def _reaches(score: str, threshold: float) -> Column:
    # Spark sorts NaN above every number, so NaN >= 0.5 is true there.
    return (F.col(score) >= F.lit(float(threshold))) & ~F.isnan(score)


def to_matrix(pairs: DataFrame, jobs: list, row: str = "candidate_id", column: str = "job_id",
              score: str = "similarity") -> DataFrame:
    """Wide matrix, one column per listed job. The job list bounds the width.

    Candidates are told apart by id and position, so people of one name keep their own rows.
    A job that is not listed, a title listed twice, and a title that two jobs bear all raise.
    """
    if len(set(jobs)) < len(jobs):
        raise ValueError("a job is listed twice")
    limit = int(pairs.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    if len(jobs) > limit:
        raise ValueError(f"{len(jobs)} jobs make too wide a matrix (limit {limit}); keep the long form")
    unlisted = F.raise_error(F.concat(F.lit("a job is not listed: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    keys = [row] + [CANDIDATE[1]] * (row == CANDIDATE[0] and CANDIDATE[1] in pairs.columns)
    known = pairs.withColumn(column, F.when(F.col(column).isin(jobs), F.col(column)).otherwise(unlisted))
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several scores of a candidate for one job title"))).otherwise(
        F.first(score, ignorenulls=True))
    return known.groupBy(*keys).pivot(column, jobs).agg(once).drop(*keys[1:])


def to_long(matrix: DataFrame, row: str = "candidate_id", column: str = "job_id",
            score: str = "similarity") -> DataFrame:
    """Turn a wide matrix back into one row per (job, candidate)."""
    jobs = [c for c in matrix.columns if c != row]
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in jobs]
    return matrix.unpivot(F.col("`" + row.replace("`", "``") + "`"), quoted, column, score)


# --- distribution -----------------------------------------------------------


def pair_schema(candidates: DataFrame, jobs: DataFrame) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, f.dataType) for f in candidates.schema if f.name in CANDIDATE]
        + [T.StructField(f.name, f.dataType) for f in jobs.schema if f.name in JOB]
        + [T.StructField("similarity", T.DoubleType())]
    )


def _score(candidates: DataFrame, jobs: DataFrame, collector: Callable, decimals: int | None = None,
           small_side_bytes: int = SMALL_SIDE_BYTES, cell_bytes: int = CELL_BYTES,
           schema: T.StructType | None = None) -> DataFrame:
    schema = schema or pair_schema(candidates, jobs)
    bars = [c for c in BAR if c in candidates.columns]
    candidates = candidates.select(*CANDIDATE, "embedding", *bars)
    jobs = jobs.select(*JOB, "embedding")
    (n_candidates, candidate_tasks), (n_jobs, job_tasks) = measure(candidates, jobs)
    if n_candidates == 0 or n_jobs == 0:
        return candidates.sparkSession.createDataFrame([], schema)
    slots = candidates.sparkSession.sparkContext.defaultParallelism
    many = n_candidates * n_jobs >= SPREAD_FROM_PAIRS

    if n_jobs <= n_candidates:
        if _is_small(jobs, n_jobs, small_side_bytes):
            if many and candidate_tasks < 2 * slots:
                candidates = candidates.repartition(2 * slots, CANDIDATE[1])
            return _past_broadcast_jobs(candidates, jobs, collector, decimals, schema)
    elif _is_small(candidates, n_candidates, small_side_bytes):
        if many and job_tasks < 2 * slots:
            jobs = jobs.repartition(2 * slots, JOB[1])
        return _past_broadcast_candidates(candidates, jobs, collector, decimals, schema)
    return _by_cells(candidates, jobs, (n_candidates, candidate_tasks), (n_jobs, job_tasks), collector, decimals, schema, cell_bytes)


def _is_small(side: DataFrame, rows: int, limit: int) -> bool:
    """Whether the whole side, measured exactly, stays within ``limit`` bytes."""
    if rows * 8 > limit:
        return False
    id_name = side.columns[0]
    row_bytes = F.size("embedding") * 8 + F.octet_length(F.col(id_name).cast("string")) + 16
    return side.agg(F.sum(row_bytes)).head()[0] <= limit


def _past_broadcast_jobs(candidates, jobs, collector, decimals, schema):
    shared = candidates.sparkSession.sparkContext.broadcast(jobs.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = _Vectors(shared.value)
        out = collector(right, decimals)
        for batch in batches:
            if batch.num_rows:
                yield from out.add(_Vectors(batch))
        yield from out.finish()

    return candidates.mapInArrow(run, schema)


def _past_broadcast_candidates(candidates, jobs, collector, decimals, schema):
    shared = candidates.sparkSession.sparkContext.broadcast(candidates.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = _Vectors(shared.value)
        for batch in batches:
            if batch.num_rows:
                out = collector(_Vectors(batch), decimals)
                yield from out.add(left)
                yield from out.finish()

    return jobs.mapInArrow(run, schema)


def _grid(n_candidates: int, n_jobs: int, rows: int, cells: int, candidate_rows: int | None = None) -> tuple[int, int]:
    """Cells down and across: at least ``cells``, at most ``rows`` vectors a side, and few copies.

    A candidate is copied ``across`` times and a job ``down`` times. For a given number of
    cells that is least where both sides make the same number of copies. ``candidate_rows`` is the
    bound of the candidates where it is another one.
    """
    least_down, least_across = math.ceil(n_candidates / (candidate_rows or rows)), math.ceil(n_jobs / rows)
    cells = max(cells, least_down * least_across)
    across = max(least_across, min(n_jobs, round(math.sqrt(cells * n_jobs / n_candidates))), 1)
    return max(least_down, math.ceil(cells / across)), across


def _by_cells(candidates, jobs, candidate_size, job_size, collector, decimals, schema, cell_bytes):
    spark = candidates.sparkSession
    (n_candidates, _), (n_jobs, _) = candidate_size, job_size
    width = jobs.agg(F.max(F.size("embedding"))).head()[0]
    rows = max(1, cell_bytes // (8 * max(1, width)))
    slots = spark.sparkContext.defaultParallelism
    down, across = _grid(n_candidates, n_jobs, rows, CELLS_PER_SLOT * slots, CELL_STREAM * rows)
    # A task walks its cells one after another, so there need not be a partition for each.
    partitions = min(down * across, CELL_PARTITIONS * max(slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def copies(df: DataFrame, size: tuple[int, int], own: str, own_count: int, other: str, other_count: int) -> DataFrame:
        df = for_copies(df, *size, size[0] * other_count, width)
        # The position takes part in the hash so that a repeated id does not fill one cell.
        return df.withColumn(own, F.pmod(F.xxhash64(df.columns[0], df.columns[1]), F.lit(own_count))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_count - 1).cast("long")))
        )

    left = copies(candidates, candidate_size, "down", down, "across", across)
    right = copies(jobs, job_size, "across", across, "down", down)
    # Cells are as large as each other, so they are dealt in turn.
    place = F.pmod(F.col("down") * across + F.col("across"), F.lit(partitions)).cast("int")
    return score_cells(left, right, partitions, collector, decimals, schema, place)


def for_copies(df: DataFrame, rows: int, tasks: int, n_copies: int, width: int) -> DataFrame:
    """The table in so many tasks that each makes a bounded part of the ``n_copies`` of its rows; they stay in memory until the shuffle.

    A table of few rows is left where it is.
    """
    wanted = math.ceil(n_copies * (8 * max(1, width) + 128) / COPIED_BYTES)
    return df.repartition(min(rows, wanted), df.columns[1]) if wanted > tasks else df


def score_cells(candidates: DataFrame, jobs: DataFrame, partitions: int, collector: Callable, decimals: int | None, schema,
                place: Column | None = None) -> DataFrame:
    """What the collector finds where candidates and jobs share ``down`` and ``across``.

    The jobs of a cell come first and are held, so its makers bound them; its candidates are
    scored batch by batch. ``place`` names the partition of a cell, by default its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, out = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            down, across = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("down", "across"))
            is_job = pc.is_valid(batch.column(JOB[1])).to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((np.diff(down) != 0) | (np.diff(across) != 0) | (is_job[1:] != is_job[:-1])) + 1
            for start, stop in zip([0, *changes], [*changes, batch.num_rows]):
                start, stop = int(start), int(stop)
                if cell != (down[start], across[start]):
                    if out is not None:
                        yield from out.finish()
                    cell, held, out = (down[start], across[start]), [], None
                part = batch.slice(start, stop - start)
                if is_job[start]:
                    held.append(part.select([*JOB, "embedding"]))
                    continue
                if held:
                    out, held = collector(_Vectors(pa.Table.from_batches(held)), decimals), []
                if out is not None:
                    yield from out.add(_Vectors(part.select([c for c in part.schema.names if c in given])))
        if out is not None:
            yield from out.finish()

    given = [c for c in candidates.columns if c not in ("down", "across")]
    both = candidates.unionByName(jobs, allowMissingColumns=True)
    dealt = both.repartition(partitions, "down", "across") if place is None else both.repartitionById(partitions, place)
    return dealt.sortWithinPartitions("down", "across", F.col(JOB[1]).isNull()).mapInArrow(run, schema)


# --- work inside a task -----------------------------------------------------


class _Vectors:
    """Ids, positions and unit vectors of one Arrow batch or table, by rising position."""

    def __init__(self, data):
        table = pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
        names = table.column_names
        table = table.take(pc.sort_indices(table.column(1))).combine_chunks()
        self.ids = _flat(table.column(0))
        self.positions = _flat(table.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = _flat(table.column(names.index("embedding")))
        if vectors.null_count:
            raise ValueError(f"{vectors.null_count} rows have no vector")
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        if len(sizes) and sizes.min() != sizes.max():
            raise ValueError(f"vectors of different size: {sizes.min()} and {sizes.max()}")
        values = vectors.flatten()
        if values.null_count:
            raise ValueError("a vector has a missing element")
        matrix = values.to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = matrix.reshape(len(sizes), -1)
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        norms[norms == 0.0] = 1.0
        matrix /= norms[:, None]
        self.unit = matrix
        self.single = self.unit.astype(np.float32)
        self.has_nan = not np.isfinite(norms).all()
        self.bar = None
        if BAR[0] in names:
            bar, job = (_flat(table.column(names.index(c))) for c in BAR)
            self.bar = pc.fill_null(bar, -np.inf).to_numpy(zero_copy_only=False)
            self.bar_job = pc.fill_null(job, 0).to_numpy(zero_copy_only=False)

    def __len__(self):
        return len(self.positions)


def _flat(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    return column


class _Tiles:
    """Walks a block of candidates against the jobs in tiles of bounded size."""

    def __init__(self, jobs: _Vectors, decimals: int | None):
        self.jobs = jobs
        self.decimals = decimals
        # Bound on the error of a single-precision score of two unit vectors, with room to
        # spare, plus what rounding may add.
        self.slack = (jobs.unit.shape[1] + 16) * 2.0**-22 + (0 if decimals is None else 0.5 * 10.0**-decimals)
        # The same of a double-precision product, in units of the last decimal.
        unsure = None if decimals is None else (jobs.unit.shape[1] + 16) * 2.0**-50 * 10.0**decimals
        self.unsure = unsure if unsure is not None and decimals >= 0 and unsure < 0.01 else None

    def tiles(self, candidates: _Vectors):
        """Yields slices of jobs and of candidates."""
        if candidates.unit.shape[1] != self.jobs.unit.shape[1]:
            raise ValueError(
                f"vectors of different size: {candidates.unit.shape[1]} and {self.jobs.unit.shape[1]}"
            )
        for job_start in range(0, len(self.jobs), TILE_JOBS):
            here = slice(job_start, min(job_start + TILE_JOBS, len(self.jobs)))
            start, width = 0, self.first_width(here)
            while start < len(candidates):
                yield here, slice(start, min(start + width, len(candidates)))
                start, width = start + width, min(width * 4, TILE_CANDIDATES)

    def first_width(self, here: slice) -> int:
        return TILE_CANDIDATES

    def scores(self, candidates: _Vectors, here: slice, there: slice) -> np.ndarray:
        """Scores of one tile, a row per job.

        Elements are multiplied and added one after another, as in ``reaching``. The last bits of a
        matrix product depend on the shape of the tile, and equal vectors would not tie; it
        serves where scores are rounded.
        """
        tile = self.units(candidates, here, there)
        if tile is not None:
            tile /= 10.0**self.decimals
            tile += 0.0  # no negative zero
            return tile
        jobs, others = self.jobs.unit[here], np.ascontiguousarray(candidates.unit[there].T)
        tile = np.zeros((len(jobs), others.shape[1]))
        for start in range(0, len(jobs), JOBS_AT_ONCE):
            part = slice(start, start + JOBS_AT_ONCE)
            for k in range(others.shape[0]):
                tile[part] += jobs[part, k, None] * others[k]
        return self._rounded(tile)

    def units(self, candidates: _Vectors, here: slice, there: slice) -> np.ndarray | None:
        """Rounded scores of one tile in units of the last decimal, a row per job, or ``None``.

        A matrix product, which errs by far less than a unit. Where that may decide how a score is
        rounded, it is scored again element by element. ``None`` where scores are not rounded, or too finely.
        """
        if self.unsure is None or candidates.has_nan or self.jobs.has_nan:
            return None
        ours, theirs = self.jobs.unit[here], candidates.unit[there]
        tile = (ours * 10.0**self.decimals) @ theirs.T
        rounded = np.rint(tile)
        tile -= rounded
        np.abs(tile, out=tile)
        if tile.max(initial=0.0) >= 0.5 - self.unsure:
            jobs, rows = _places(tile >= 0.5 - self.unsure)
            rounded[jobs, rows] = np.rint(self._exact(ours, theirs, jobs, rows) * 10.0**self.decimals)
        return rounded

    def _exact(self, ours: np.ndarray, theirs: np.ndarray, jobs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of single pairs, element by element."""
        exact = np.zeros(len(jobs))
        step = max(1, GATHERED_BYTES // max(1, 8 * ours.shape[1]))
        for start in range(0, len(jobs), step):
            part = slice(start, start + step)
            left, right = (np.ascontiguousarray(x.T) for x in (ours[jobs[part]], theirs[rows[part]]))
            for k in range(len(left)):
                exact[part] += left[k] * right[k]
        return exact

    def reaching(self, candidates: _Vectors, here: slice, there: slice, floor: np.ndarray):
        """Places and scores of the pairs that reach each job's ``floor``, or ``None``.

        A single-precision product, which is faster, rules out nearly all pairs; the rest
        are scored exactly. ``None`` where that would not pay.
        """
        if candidates.has_nan or self.jobs.has_nan:
            return None
        lowest = np.nextafter(np.maximum(floor - self.slack, -2.0).astype(np.float32), np.float32(-np.inf))
        maybe = (self.jobs.single[here] @ candidates.single[there].T) >= lowest[:, None]
        if np.count_nonzero(maybe) * SINGLE_PRECISION_BELOW > maybe.size:
            return None
        jobs, rows = _places(maybe)
        exact = self._rounded(self._exact(self.jobs.unit[here], candidates.unit[there], jobs, rows))
        kept = exact >= floor[jobs]
        return jobs[kept], rows[kept], exact[kept]

    def _rounded(self, scores: np.ndarray) -> np.ndarray:
        if self.decimals is not None:
            np.round(scores, self.decimals, out=scores)
            scores += 0.0  # no negative zero
        return scores

    def batches(self, candidates: _Vectors, jobs: np.ndarray, rows: np.ndarray, values: np.ndarray):
        for start in range(0, len(jobs), ROWS_PER_BATCH):
            j, r = jobs[start:start + ROWS_PER_BATCH], rows[start:start + ROWS_PER_BATCH]
            yield _batch(
                candidates.ids.take(pa.array(r)), candidates.positions[r],
                self.jobs.ids.take(pa.array(j)), self.jobs.positions[j], values[start:start + ROWS_PER_BATCH],
            )

    def finish(self):
        return iter(())


class _AllPairs(_Tiles):
    """A row is a block: its candidates, its jobs, and one list of scores.

    Scores of one candidate lie side by side, so that they can be packed before a shuffle.
    """

    def add(self, candidates: _Vectors):
        for here, there in self.tiles(candidates):
            tile = self.scores(candidates, here, there).T
            step = max(1, ROWS_PER_BATCH // tile.shape[1])
            for start in range(0, len(tile), step):
                part = tile[start:start + step]
                rows = slice(there.start + start, there.start + start + len(part))
                columns = [candidates.ids[rows], pa.array(candidates.positions[rows]), self.jobs.ids[here], pa.array(self.jobs.positions[here]),
                           pa.array(part.ravel())]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays(lists, names=[*CANDIDATE, *JOB, "similarity"])


class PairsAbove(_Tiles):
    def __init__(self, threshold: float, jobs: _Vectors, decimals: int | None):
        super().__init__(jobs, decimals)
        self.floor = np.full(len(jobs), float(threshold))

    def add(self, candidates: _Vectors):
        for here, there in self.tiles(candidates):
            found = self.reaching(candidates, here, there, self.floor[here])
            if found is None:
                tile = self.scores(candidates, here, there)
                jobs, rows = _places(tile >= self.floor[here, None])
                found = jobs, rows, tile[jobs, rows]
            jobs, rows, values = found
            yield from self.batches(candidates, jobs + here.start, rows + there.start, values)


class CountsAbove(PairsAbove):
    """Number of pairs of each job that score at least the threshold. Memory is a number per job."""

    def __init__(self, threshold: float, jobs: _Vectors, decimals: int | None):
        super().__init__(threshold, jobs, decimals)
        self.n = np.zeros(len(jobs), np.int64)

    def add(self, candidates: _Vectors):
        for here, there in self.tiles(candidates):
            if candidates.has_nan or self.jobs.has_nan:
                self.n[here] += np.count_nonzero(self.scores(candidates, here, there) >= self.floor[here, None], axis=1)
                continue
            ours, theirs = self.jobs.unit[here], candidates.unit[there]
            # Single precision settles all pairs but those close to the threshold, which are scored exactly.
            away = self.jobs.single[here] @ candidates.single[there].T
            away -= np.float32(self.floor[here.start])
            slack = np.float32(self.slack * (1 + 2.0**-20) + 2.0**-22)
            self.n[here] += np.count_nonzero(away > slack, axis=1)
            np.abs(away, out=away)
            jobs, rows = _places(away <= slack)
            if len(jobs):
                near = self._rounded(self._exact(ours, theirs, jobs, rows)) >= self.floor[here.start]
                self.n[here] += np.bincount(jobs[near], minlength=len(ours))
        return iter(())

    def finish(self):
        jobs = np.flatnonzero(self.n)
        for start in range(0, len(jobs), ROWS_PER_BATCH):
            at = jobs[start:start + ROWS_PER_BATCH]
            columns = [self.jobs.ids.take(pa.array(at)), pa.array(self.jobs.positions[at]), pa.array(self.n[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*JOB, "n"])


class BinnedScores(_Tiles):
    """Number, sum and maximum of the scores in each cell of a grid. Memory is the grid."""

    def __init__(self, y_bins: int, x_bins: int, n_candidates: int, n_jobs: int, jobs: _Vectors, decimals: int):
        super().__init__(jobs, decimals)
        self.y_bins, self.n_candidates = y_bins, n_candidates
        self.x = jobs.positions * x_bins // n_jobs
        self.n = np.zeros((x_bins, y_bins), np.int64)
        self.total = np.zeros((x_bins, y_bins), np.int64)
        self.highest = np.full((x_bins, y_bins), -np.inf)

    def add(self, candidates: _Vectors):
        bins = candidates.positions * self.y_bins // self.n_candidates
        for here, there in self.tiles(candidates):
            # Some jobs at a time, so that the numbers stay in the processor's cache.
            for start in range(here.start, here.stop, BINNED_AT_ONCE):
                self._count(candidates, bins, slice(start, min(start + BINNED_AT_ONCE, here.stop)), there)
        return iter(())

    def _count(self, candidates: _Vectors, bins: np.ndarray, here: slice, there: slice) -> None:
        # Positions rise, so equal bins lie side by side.
        x, y = self.x[here], bins[there]
        left, top = (np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) for b in (x, y))
        at = np.ix_(x[left], y[top])
        # Sums of whole numbers below 2**53 are exact.
        units = self.units(candidates, here, there) if self.decimals <= 9 else None
        if units is not None:
            self.n[at] += np.outer(np.diff(np.r_[left, len(x)]), np.diff(np.r_[top, len(y)]))
            self.total[at] += _blocks(np.add, units, left, top).astype(np.int64)
            highest = _blocks(np.maximum, units, left, top) / 10.0**self.decimals + 0.0
            self.highest[at] = np.maximum(self.highest[at], highest)
            return
        tile = self.scores(candidates, here, there)
        known = ~np.isnan(tile)
        units = np.rint(np.where(known, tile, 0.0) * 10.0**self.decimals).astype(np.int64)
        self.n[at] += _blocks(np.add, known.astype(np.int64), left, top)
        self.total[at] += _blocks(np.add, units, left, top)
        self.highest[at] = np.maximum(self.highest[at], _blocks(np.maximum, np.where(known, tile, -np.inf), left, top))

    def finish(self):
        x, y = np.nonzero(self.n)
        for start in range(0, len(x), ROWS_PER_BATCH):
            at = x[start:start + ROWS_PER_BATCH], y[start:start + ROWS_PER_BATCH]
            columns = at[1], at[0], self.n[at], self.total[at], self.highest[at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["y", "x", "n", "total", "highest"])


def _blocks(combine: np.ufunc, tile: np.ndarray, left: np.ndarray, top: np.ndarray) -> np.ndarray:
    return combine.reduceat(combine.reduceat(tile, left, axis=0), top, axis=1)


class BestPerJob(_Tiles):
    """Running best ``k`` of each job over all candidates a task sees.

    An entry is kept if it beats the job's present ``k``-th entry by (score, then lower
    position); NaN ranks last. Memory is ``k`` entries per job.
    """

    def __init__(self, k: int, positive: bool, jobs: _Vectors, decimals: int | None):
        super().__init__(jobs, decimals)
        self.k = k
        # What an entry must beat. No position is below -1, so a score of 0 never enters
        # where only positive ones may.
        self.last_score = np.full(len(jobs), 0.0 if positive else -np.inf)
        self.last_position = np.full(len(jobs), -1 if positive else np.iinfo(np.int64).max)
        # First job of a tile -> kept entries of its jobs: job, score, position, candidate id.
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = {}

    def add(self, candidates: _Vectors):
        for here, there in self.tiles(candidates):
            # Candidates come by rising position: where even the first one here would lose
            # a tie, only a higher score can enter.
            score = self.last_score[here]
            loses_ties = self.last_position[here] <= candidates.positions[there.start]
            floor = np.where(loses_ties, np.nextafter(score, np.inf), score)
            found = self.reaching(candidates, here, there, floor)
            if found is None:
                found = self._best_of_tile(candidates, here, there, floor)
            jobs, rows, values = found
            jobs, rows, key = jobs + here.start, rows + there.start, _nan_last(values)
            positions = candidates.positions[rows]
            ahead = (key > self.last_score[jobs]) | (positions < self.last_position[jobs])
            if candidates.bar is not None:
                bar = candidates.bar[rows]
                not_later = self.jobs.positions[jobs] <= candidates.bar_job[rows]
                ahead &= (key > bar) | ((key == bar) & not_later)
            if ahead.any():
                ids = candidates.ids.take(pa.array(rows[ahead]))
                self._keep(here.start, jobs[ahead], values[ahead], positions[ahead], ids)
        return iter(())

    def first_width(self, here: slice) -> int:
        # A few candidates first: they set the bar that rules out most of the others.
        return TILE_CANDIDATES if here.start in self.kept else max(1, TILE_CANDIDATES // 8)

    def _best_of_tile(self, candidates, here, there, floor):
        tile = self.scores(candidates, here, there)
        height, width = tile.shape
        key = _nan_last(tile) if candidates.has_nan or self.jobs.has_nan else tile
        enters = key >= floor[:, None]
        if candidates.bar is not None:
            not_later = self.jobs.positions[here, None] <= candidates.bar_job[there]
            enters &= (key > candidates.bar[there]) | ((key == candidates.bar[there]) & not_later)
        if width > self.k and np.count_nonzero(enters) > 4 * self.k * height:
            eligible = key if candidates.bar is None else np.where(enters, key, -np.inf)
            cut = np.partition(eligible, width - self.k, axis=1)[:, width - self.k, None]
            level = eligible == cut
            if np.count_nonzero(level) > self.k * height:
                # Many copies at the cut: a job needs only the first k of them.
                level &= np.cumsum(level, axis=1, dtype=np.int32) <= self.k
            enters &= (eligible > cut) | level
        jobs, rows = _places(enters)
        return jobs, rows, tile[jobs, rows]

    def _keep(self, tile, job, value, position, ids):
        if tile in self.kept:
            had = self.kept[tile]
            job, value, position = (np.concatenate(p) for p in zip(had[:3], (job, value, position)))
            ids = pa.concat_arrays([had[3], ids])
        key = _nan_last(value)
        order = np.lexsort((position, -key, job))
        grouped = job[order]
        first = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
        place = np.arange(len(grouped)) - np.repeat(first, np.diff(np.r_[first, len(grouped)]))
        best, full = order[place < self.k], order[place == self.k - 1]
        self.last_score[job[full]] = key[full]
        self.last_position[job[full]] = position[full]
        self.kept[tile] = job[best], value[best], position[best], ids.take(pa.array(best))

    def finish(self):
        for job, value, position, ids in self.kept.values():
            for start in range(0, len(job), ROWS_PER_BATCH):
                part = slice(start, start + ROWS_PER_BATCH)
                yield _batch(
                    ids.slice(start, ROWS_PER_BATCH), position[part],
                    self.jobs.ids.take(pa.array(job[part])), self.jobs.positions[job[part]], value[part],
                )


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where the mask holds; much faster than ``nonzero`` on two dimensions."""
    return np.divmod(np.flatnonzero(mask.ravel()), mask.shape[1])


def _nan_last(values: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(values), -np.inf, values)


def _batch(candidate_ids, candidate_positions, job_ids, job_positions, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [candidate_ids, pa.array(candidate_positions), job_ids, pa.array(job_positions), pa.array(values)],
        names=[*CANDIDATE, *JOB, "similarity"],
    )
