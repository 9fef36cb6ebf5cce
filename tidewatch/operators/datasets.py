"""Data set building: splits, caps, balancing, augmentation, neighbour interpolation, shuffles of one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import has, strip_trailing_digits
from tidewatch.operators.ordered import global_rank, hash_unit, split_points, with_cells
from tidewatch.rules import labels as L


def random_split(df: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Split by key hash: the same row lands on the same side in every run."""
    return df.withColumn("split", F.when(hash_unit(F.col(key), seed=seed) < train, "train").otherwise("val"))


def stratified_split(df: DataFrame, key: str, strata: list[str], train: float = 0.75, seed: int = 42) -> DataFrame:
    """Exact share per stratum: rank by hash inside the stratum, chunk by chunk."""
    ranked = global_rank(df.withColumn("_u", hash_unit(F.col(key), seed=seed)), strata, "_u", key)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.round(F.col("total") * train), "train").otherwise(
        "val")).drop("_u", "rank", "total")


def fold_column(df: DataFrame, key: str, strata: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold number in `fold`: hash ranks dealt out in turn."""
    ranked = global_rank(df.withColumn("_u", hash_unit(F.col(key), seed=seed)), strata, "_u", key)
    return ranked.withColumn("fold", (F.col("rank") % folds).cast("int")).drop("_u", "rank", "total")


def cap_rows(df: DataFrame, key: str, group: list[str], cap: int | Column, seed: int = 0) -> DataFrame:
    """At most `cap` rows per group, picked by hash; the cap may be a large share of the group."""
    ranked = global_rank(df.withColumn("_u", hash_unit(F.col(key), seed=seed)), group, "_u", key)
    limit = F.lit(cap) if isinstance(cap, int) else cap
    return ranked.where(F.col("rank") <= limit).drop("_u", "rank", "total")


def cap_source(df: DataFrame, key: str, source: str, name: str, share: float = 0.25, seed: int = 0) -> DataFrame:
    """Down-sample one source to a share of its rows."""
    kept = cap_rows(df.where(F.col(source) == name), key, [source], F.floor(F.col("total") * share), seed)
    return df.where(F.col(source) != name).unionByName(kept)


def rebuild(df: DataFrame, key: str, source: str = "source_type", label: str = "label", benign: str = "real_benign",
            all_train: str = "evtx", synthetic: str = "synthetic", n_train: int = 60_000, n_val: int = 20_000,
            val_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Real benign rows sampled to fixed sizes, attacks of one source all to train, a share of the others to val."""
    real = df.where((F.col(source) == benign) & (F.col(label) == 0)).withColumn("_u", hash_unit(F.col(key), seed=seed))
    real = global_rank(real, [], "_u", key)
    real = real.where(F.col("rank") <= n_train + n_val).withColumn(
        "split", F.when(F.col("rank") <= n_train, "train").otherwise("val"))
    attacks = df.where((F.col(label) == 1) & (F.col(source) != synthetic)).withColumn(
        "_u", hash_unit(F.col(key), seed=seed)).withColumn("_first", F.col(source) == all_train)
    attacks = global_rank(attacks, ["_first"], "_u", key)
    attacks = attacks.withColumn("split", F.when(F.col("_first"), "train").when(
        F.col("rank") <= F.floor(F.col("total") * val_share), "val").otherwise("train")).drop("_first")
    return real.unionByName(attacks).drop("_u", "rank", "total")


# ---------------------------------------------------------------- balancing
def _pick(options: list[str], unit: Column) -> Column:
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.floor(unit * len(options)) + 1).cast("int"))


def augment_text(text: Column, *seed_cols: Column) -> Column:
    """One of synonym, case, spacing or nothing, picked by hash so that a rerun gives the same text."""
    u = lambda s: hash_unit(*seed_cols, seed=s)
    low = F.lower(text)
    synonym = F
    for word, options in L.AUGMENT_WORDS:
        at = F.instr(low, word)
        swapped = F.concat(F.substring(text, F.lit(1), at - 1), _pick(options, u(2)),
                           F.substring(text, at + len(word), F.length(text)))
        synonym = synonym.when(has(low, word), swapped)
    mixed = F.array_join(F.transform(F.split(text, ""), lambda ch, i: F.when(
        F.pmod(F.xxhash64(ch, i, *seed_cols), F.lit(2)) == 0, F.upper(ch)).otherwise(F.lower(ch))), "")
    case = (F.when(u(3) < 0.25, low).when(u(3) < 0.5, F.upper(text)).when(u(3) < 0.75, F.initcap(text))
            .otherwise(mixed))
    spacing = F.when(u(4) > 0.5, F.when(has(text, " "), F.replace(text, F.lit(" "), F.lit("  "))).otherwise(
        F.concat(text, F.lit(" ")))).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))
    changed = (F.when(u(1) < 0.25, synonym.otherwise(text)).when(u(1) < 0.5, case).when(u(1) < 0.75, spacing)
               .otherwise(text))
    return F.when(F.coalesce(text, F.lit("")) == "", text).otherwise(changed)


def balance_classes(df: DataFrame, key: str, label: str, factor: float = 1.0, max_copies: int = 3) -> DataFrame:
    """Bring small classes towards the largest by augmented copies: half of the missing rows, three per row at most.

    Class sizes are one pre-aggregated row each; each original row makes its own copies, so nothing is gathered.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    target = F.floor(F.max("_n").over(Window.partitionBy()) * factor)  # a window over one row per class
    need = sizes.withColumn("_t", target).withColumn(
        "_add", F.greatest(F.least(F.floor((F.col("_t") - F.col("_n")) / 2), F.col("_n") * max_copies), F.lit(0)))
    ranked = global_rank(df.withColumn("_u", hash_unit(F.col(key), seed=7)), [label], "_u", key)
    joined = ranked.join(need.select(label, "_add"), label)
    copies = F.floor(F.col("_add") / F.col("total")) + (F.col("rank") <= F.col("_add") % F.col("total")).cast("int")
    extra = joined.withColumn("_copies", copies).where(F.col("_copies") > 0).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies")
    seeds = [F.col(key), F.col("copy_no")]
    changes = {c: augment_text(F.col(c), *seeds, F.lit(c)) for c in ("command_line", "process_name") if c in df.columns}
    if "user" in df.columns:
        changes["user"] = F.when(hash_unit(*seeds, seed=11) > 0.7, augment_text(F.col("user"), *seeds)).otherwise(
            F.col("user"))
    if "hostname" in df.columns:
        changes["hostname"] = F.when(hash_unit(*seeds, seed=12) > 0.8, F.concat(strip_trailing_digits(
            F.col("hostname")), _pick(L.HOST_SUFFIXES, hash_unit(*seeds, seed=13)))).otherwise(F.col("hostname"))
    extra = extra.withColumns(changes).withColumn("augmented", F.lit(True))
    keep = df.columns + ["copy_no", "augmented"]
    originals = df.withColumns({"copy_no": F.lit(0).cast("bigint"), "augmented": F.lit(False)})
    return originals.select(*keep).unionByName(extra.select(*keep))


def interpolate_minority(df: DataFrame, key: str, vector: str, copies: int = 1, neighbours: int = 5, planes: int = 4,
                         block: int = 1000, seed: int = 0) -> DataFrame:
    """New minority rows between a row and one of its near neighbours: (key, copy_no, vector).

    Rows are ordered along a few random directions by exact rank; neighbours on those lines are the candidates and the closest
    `neighbours` of them stay. A line is cut into blocks of `block` ranks, and each block also gets the `neighbours` rows before
    and behind it, so no row loses a neighbour to a border, at any size. Each row meets 2 * neighbours rows per direction,
    however many copies of one vector exist. Directions are approximate; the interpolation itself is exact.
    """
    direction = lambda p: F.aggregate(F.transform(F.col(vector), lambda x, i: x.cast("double") * (
        hash_unit(i, F.lit(p), seed=seed) - 0.5)), F.lit(0.0), lambda a, x: a + x)
    lined = df.select(key, vector, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), direction(p).alias("at"))
                                                       for p in range(planes)])).alias("d")).select(
        key, vector, "d.p", "d.at")
    marked = with_cells(lined.join(F.broadcast(split_points(lined, ["p"], "at")), "p"), "at", "_c")  # a row per direction
    sizes = marked.groupBy("p", "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("p").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("p", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # a row per cell
    local = F.row_number().over(Window.partitionBy("p", "_c").orderBy("at", key))
    ranked = marked.withColumn("_local", local).join(F.broadcast(offsets), ["p", "_c"]).withColumn(
        "_rank", F.col("_off") + F.col("_local") - 1)
    home, place = F.floor(F.col("_rank") / block), F.col("_rank") % block
    homes = F.array_compact(F.array(home, F.when(place < neighbours, home - 1), F.when(place >= block - neighbours, home + 1)))
    lined = ranked.withColumns({"_home": home, "_in": F.explode(homes)})
    w = Window.partitionBy("p", "_in").orderBy("_rank")
    near = F.array_compact(F.array(*[f(F.struct(F.col(key).alias("k"), F.col(vector).alias("v")), i).over(w)
                                     for i in range(1, neighbours + 1) for f in (F.lag, F.lead)]))
    lined = lined.withColumn("_near", near).where(F.col("_in") == F.col("_home"))
    cand = lined.select(key, F.col(vector).alias("_v"), F.explode("_near").alias("n"))
    gap = F.aggregate(F.zip_with("_v", "n.v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    cand = cand.withColumn("gap", gap).groupBy(key, F.col("n.k").alias("nk")).agg(
        F.min("gap").alias("gap"), F.first("_v").alias("_v"), F.first("n.v").alias("_n"))
    best = cand.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("gap", "nk"))).where(
        F.col("_rn") <= neighbours)
    grouped = best.groupBy(key).agg(F.first("_v").alias("_v"), F.array_sort(F.collect_list(F.struct(
        "_rn", "_n"))).alias("_ns"))
    made = grouped.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    pick = (F.floor(hash_unit(F.col(key), F.col("copy_no"), seed=seed + 1) * F.size("_ns")) + 1).cast("int")
    t = hash_unit(F.col(key), F.col("copy_no"), seed=seed + 2)
    out = made.withColumn("_o", F.element_at("_ns", pick)["_n"]).withColumn(
        vector, F.zip_with("_v", "_o", lambda a, b: a + (b - a) * t))
    return out.select(key, "copy_no", vector)


def permuted_column(df: DataFrame, key: str, column: str, seed: int = 0) -> DataFrame:
    """The table with one column shuffled over all rows: two hash orders joined on rank."""
    left = global_rank(df.withColumn("_u", hash_unit(F.col(key), seed=seed)), [], "_u", key, total="_t").drop("_u", "_t")
    right = global_rank(df.select(key, F.col(column).alias("_new")).withColumn("_u", hash_unit(
        F.col(key), seed=seed + 1)), [], "_u", key, total="_t").select("rank", "_new")
    return left.join(right, "rank").withColumn(column, F.col("_new")).drop("_new", "rank")


def scenarios(df: DataFrame, features: list[str], key: str, noise: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20, 0.50),
              erased: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Base rows, Gaussian noise per level (clipped to [0, 1]) and rows with the behaviour features zeroed; long over
    `scenario`. One row becomes a fixed number of rows by an explode of constants."""
    names = ["base"] + [f"noise_{s:.2f}" for s in noise] + (["erased"] if erased else [])
    out = df.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names])))
    std = F.create_map(*[x for s in noise for x in (F.lit(f"noise_{s:.2f}"), F.lit(float(s)))])
    level = F.element_at(std, F.col("scenario"))
    changes = {}
    for i, f in enumerate(features):
        # normal draw from two hash uniforms, so the noise does not depend on partitioning
        u1 = hash_unit(F.col(key), F.col("scenario"), F.lit(i), seed=seed) + 1e-12
        u2 = hash_unit(F.col(key), F.col("scenario"), F.lit(i), seed=seed + 1)
        normal = F.sqrt(-2 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)
        noisy = F.least(F.greatest(F.col(f) + level * normal, F.lit(0.0)), F.lit(1.0))
        zero = F.lit(f in (erased or []))
        changes[f] = F.when(level.isNotNull(), noisy).when((F.col("scenario") == "erased") & zero, 0.0).otherwise(
            F.col(f))
    return out.withColumns(changes)


def outlier_flag(df: DataFrame, features: list[str], contamination: float = 0.3) -> DataFrame:
    """Standardised squared distance at or above the (1 - contamination) quantile."""
    from tidewatch.operators.ordered import exact_quantiles, sole_key

    stats = df.agg(*[a for f in features for a in (F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"))])
    wide = df.withColumn("_j", sole_key(features[0])).join(F.broadcast(stats.withColumn("_j", sole_key(f"{features[0]}__m"))), "_j")
    z = lambda f: (F.col(f) - F.col(f"{f}__m")) / F.when(F.col(f"{f}__s") > 0, F.col(f"{f}__s")).otherwise(1.0)
    dist = sum((z(f) * z(f) for f in features), F.lit(0.0))
    scored = wide.withColumn("distance", F.round(dist, 9)).drop(*[f"{f}__{s}" for f in features for s in "ms"])
    cut = exact_quantiles(scored, [], "distance", [1 - contamination]).select(
        sole_key("n").alias("_j"), F.col("q")[0].alias("_cut"))
    return scored.join(F.broadcast(cut), "_j").withColumn("anomaly", F.col("distance") >= F.col("_cut")).drop(
        "_j", "_cut")
