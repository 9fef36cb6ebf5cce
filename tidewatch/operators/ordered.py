"""Running totals, ranks, quantiles and sessions that never put a whole group, or a whole table, into one task.

The shape is the same everywhere: cut the order axis into chunks by a function of the data, reduce each chunk to one
small row (map-side combined), run the window over the chunk rows only, and add the chunk offset back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_grown(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the input: a merge join at every size. The planner judges a written table by its
    compressed files, so it would take millions of nested rows for small and broadcast them."""
    return left.join(right.hint("merge"), keys, how)


def _join_chunks(rows: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their chunk offsets; the chunk side is small against the row side, AQE splits a hot chunk."""
    return rows.join(chunks, keys)


def gap_sessions(df: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """Long form: one row per (key, time bucket) with the session it belongs to.

    Buckets are as wide as the gap, so all rows of one bucket are in one session: two rows in it are less than a gap
    apart. Only the bucket rows (first, last, n) are ordered; a key holding a third of the data still reduces to one
    row per half hour of wall clock. A pause of exactly the gap does not split.
    """
    width = gap_minutes * 60 * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    buckets = (df.groupBy(key, F.floor(micros / width).alias("bucket"))
               .agg(F.min(micros).alias("first_us"), F.max(micros).alias("last_us"), F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(key).orderBy("bucket")
    opened = F.coalesce((F.col("first_us") - F.lag("last_us").over(w) > width).cast("int"), F.lit(1))
    numbered = buckets.withColumn("opened", opened).withColumn("session_no", F.sum("opened").over(w))
    by_session = Window.partitionBy(key, "session_no")
    return numbered.withColumn("start_us", F.min("first_us").over(by_session)).drop("opened")


def session_bucket(ts: str, gap_minutes: int = 30) -> Column:
    """The time bucket of `gap_sessions` that a row falls into."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (gap_minutes * 60 * 1_000_000))


def with_sessions(df: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """Rows with session_no and start_us."""
    sessions = gap_sessions(df, key, ts, gap_minutes).select(key, "bucket", "session_no", "start_us")
    rows = df.withColumn("bucket", session_bucket(ts, gap_minutes))
    return join_grown(rows, sessions, [key, "bucket"]).drop("bucket")


def running_totals(counts: DataFrame, keys: list[str], order: str, sums: list[str], chunk: Column,
                   descending: bool = False) -> DataFrame:
    """Adds cum_<c> (inclusive) and tot_<c> for each sum column, ordered by `order` inside each key.

    `counts` holds one row per distinct order value. `chunk` must not decrease with `order`; it bounds how much one
    task sorts.
    """
    rows = counts.withColumn("_chunk", chunk)
    way = F.desc if descending else F.asc
    inner = Window.partitionBy(*keys, "_chunk").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_run_{c}": F.sum(c).over(inner) for c in sums})
    per_chunk = counts.withColumn("_chunk", chunk).groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(f"_all_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy(way("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_chunk.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_all_{c}").over(whole).alias(f"tot_{c}") for c in sums])
    out = _join_chunks(rows, offsets, keys + ["_chunk"])
    out = out.withColumns({f"cum_{c}": F.col(f"_off_{c}") + F.col(f"_run_{c}") for c in sums})
    return out.drop("_chunk", *[f"_off_{c}" for c in sums], *[f"_run_{c}" for c in sums])


def unit_chunk(column: str | Column, chunks: int = 1024) -> Column:
    """Chunk of a value in [0, 1]."""
    c = F.col(column) if isinstance(column, str) else column
    return F.least(F.greatest(F.floor(c * chunks), F.lit(0)), F.lit(chunks - 1))


def sole_key(column: str) -> Column:
    """A key with one value that is no literal: a join on it stays an equi-join, for the one-row or few-row side to be broadcast."""
    return F.pmod(F.xxhash64(column), F.lit(1))


GRID = 11


def split_points(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key: approximate quantiles that cut the value axis, as a coarse grid and the finer cuts inside each
    coarse cell. Exactness never rests on them; they only balance the work."""
    n = GRID * GRID
    grid = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), grid, F.lit(10000)).alias("_q"))
    coarse = F.array(*[F.col("_q")[i * GRID - 1] for i in range(1, GRID)])
    fine = F.array(*[F.slice("_q", i * GRID + 1, GRID - 1) for i in range(GRID)])
    return cuts.select(*keys, coarse.alias("_coarse"), fine.alias("_fine"))


def with_cells(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the cell number of a value against the two-level grid; it does not decrease with the value. Plain
    comparisons, so the search stays in generated code."""
    at_least = lambda cuts: sum((F.coalesce(F.get(cuts, F.lit(i)) <= F.col(value), F.lit(False)).cast("int")
                                 for i in range(GRID - 1)), F.lit(0))
    out = df.withColumn("_upper", at_least(F.col("_coarse")))
    out = out.withColumn("_row", F.get("_fine", F.col("_upper")))
    return out.withColumn(name, F.col("_upper") * GRID + at_least(F.col("_row"))).drop("_upper", "_row", "_coarse", "_fine")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, n, q: array<double>) with linear interpolation, exact, without holding a group's values in one task.

    Values collapse to distinct values with counts, cells come from a mergeable sketch, and only the cells that hold a
    wanted rank are ordered.
    """
    one = keys or ["_one"]
    clean = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        clean = clean.withColumn("_one", sole_key("_v"))
    small = (lambda d: d) if keys else F.broadcast  # without keys the side has one row, or one per cell
    counts = clean.groupBy(*one, "_v").agg(F.count(F.lit(1)).alias("_n"))
    marked = with_cells(counts.join(small(split_points(counts, one, "_v")), one), "_v", "_c")
    sizes = marked.groupBy(*one, "_c").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*one).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_off": F.coalesce(F.sum("_size").over(before), F.lit(0)),
                               "n": F.sum("_size").over(Window.partitionBy(*one))})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    lo = lambda w: F.floor(w["p"] * (F.col("n") - 1))
    hi = lambda w: F.least(lo(w) + 1, F.col("n") - 1)
    within = lambda r, start, end: (r >= start) & (r < end)
    held = lambda start, end: F.filter(wanted, lambda w: within(lo(w), start, end) | within(hi(w), start, end))
    needed = sizes.withColumn("_w", held(F.col("_off"), F.col("_off") + F.col("_size"))).where(F.size("_w") > 0)
    rows = _join_chunks(marked, small(needed.select(*one, "_c", "_off", "n")), one + ["_c"])
    run = Window.partitionBy(*one, "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_to", F.col("_off") + F.sum("_n").over(run)).withColumn("_from", F.col("_to") - F.col("_n"))
    rows = rows.withColumn("_w", held(F.col("_from"), F.col("_to")))
    picks = rows.select(*one, "n", "_v", "_from", "_to", F.explode("_w").alias("_w"))
    w = {"p": F.col("_w.p")}
    picks = picks.withColumns({
        "_lo": F.when(within(lo(w), F.col("_from"), F.col("_to")), F.col("_v")),
        "_hi": F.when(within(hi(w), F.col("_from"), F.col("_to")), F.col("_v")), "_frac": w["p"] * (F.col("n") - 1) - lo(w)})
    solved = picks.groupBy(*one, "n", F.col("_w.i").alias("i")).agg(
        (F.max("_lo") + (F.max("_hi") - F.max("_lo")) * F.max("_frac")).alias("q"))
    out = solved.groupBy(*one, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))),
                                                    lambda s: s["q"]).alias("q"))
    return out if keys else out.drop("_one")


def hash_unit(*cols: Column, seed: int = 0) -> Column:
    """Uniform number in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def global_rank(df: DataFrame, keys: list[str], unit: str, tie: str, chunks: int = 1024, name: str = "rank",
                total: str = "total") -> DataFrame:
    """Exact 1-based rank by a uniform [0, 1) column inside each key, and the key's size, chunk by chunk."""
    one = keys or ["_one"]
    rows = df if keys else df.withColumn("_one", F.lit(1))
    rows = rows.withColumn("_chunk", unit_chunk(unit, chunks))
    local = Window.partitionBy(*one, "_chunk").orderBy(unit, tie)
    sizes = rows.groupBy(*one, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*one).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*one, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"),
                           F.sum("_size").over(Window.partitionBy(*one)).alias(total))
    out = _join_chunks(rows.withColumn("_local", F.row_number().over(local)), offsets, one + ["_chunk"])
    out = out.withColumn(name, F.col("_off") + F.col("_local")).drop("_chunk", "_off", "_local")
    return out if keys else out.drop("_one")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """First n rows per key; the planner cuts each input task to n rows per key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def running_total(df: DataFrame, keys: list[str], order: list[str], weight: str, name: str, bucket: str = "minute") -> DataFrame:
    """Adds the sum of `weight` over a key's rows before this one. The order begins with a timestamp; a key is summed bucket by
    bucket, and only one row per bucket is summed over the whole key."""
    rows = df.withColumn("_c", F.date_trunc(bucket, F.col(order[0]).cast("timestamp")))
    local = Window.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_c").agg(F.sum(weight).alias("_sum"))
    offsets = sums.select(*keys, "_c", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    out = _join_chunks(rows.withColumn("_own", F.coalesce(F.sum(weight).over(local), F.lit(0))), offsets, [*keys, "_c"])
    return out.withColumn(name, F.col("_off") + F.col("_own")).drop("_c", "_off", "_own")
