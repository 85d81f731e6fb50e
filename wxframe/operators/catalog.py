"""Variable catalog and dataset synchronisation: display variables, default
variable, cross-dataset pairs, shared date range, date-group sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import null_nonfinite


def variables_present(df: DataFrame, keys) -> DataFrame:
    """(name, pos) for every non-key column holding at least one non-null value.

    ``pos`` is the column position; presence is measured on the data with a
    single aggregate (one count per column).
    """
    cols = [c for c in df.columns if c not in set(keys)]
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("name"), F.lit(i).alias("pos"), F.col(c).alias("n")) for i, c in enumerate(cols)]
    return (counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .where(F.col("n") > 0).drop("n"))


def variable_dims(long: DataFrame, coords, variable: str = "variable") -> DataFrame:
    """(variable, dims): the coordinates that a variable's rows have values of, in the order of ``coords``."""
    had = [F.when(F.max(F.col(c).isNotNull()), F.lit(c)) for c in coords]
    return long.groupBy(variable).agg(F.array_compact(F.array(*had)).alias("dims"))


def candidate_vars(dims: DataFrame, lat: str = "latitude", lon: str = "longitude", time_like=("time", "step"),
                   variable: str = "variable") -> DataFrame:
    """Variables that can be drawn: with both axes and, if any variable has a time-like one, with such a one; all
    variables if there is none of that kind.  ``dims``: (variable, dims), see :func:`variable_dims`."""
    timed = F.arrays_overlap("dims", F.array(*[F.lit(t) for t in time_like]))
    no_time = ~dims.agg(F.coalesce(F.bool_or(timed), F.lit(False))).scalar()
    fits = F.array_contains("dims", lat) & F.array_contains("dims", lon)
    some = dims.agg(F.coalesce(F.bool_or(fits & timed), F.lit(False))).scalar()
    some_untimed = dims.agg(F.coalesce(F.bool_or(fits), F.lit(False))).scalar()
    candidate = fits & (timed | no_time)
    return dims.where(F.when(some | (no_time & some_untimed), candidate).otherwise(F.lit(True))).select(variable)


def shared_limits(obs_long: DataFrame, grid: DataFrame, pairs=C.COMPATIBLE_VARS) -> DataFrame:
    """(var_a, var_b, v_min, v_max): one colour scale for each mapped pair present on both sides, from the finite values
    of the grid's variable and of the station variable together.

    One aggregate per side; a handful of rows meet."""
    present = [a for a, _ in pairs if a in grid.columns]
    grid_rows = F.array(*[F.struct(F.lit(a).alias("var_a"), F.col(f"{a}_lo").alias("a_lo"), F.col(f"{a}_hi").alias("a_hi")) for a in present])
    bounds = [f(null_nonfinite(a)).alias(f"{a}_{end}") for a in present for f, end in ((F.min, "lo"), (F.max, "hi"))]
    mapping = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    of_grid = (grid.agg(*bounds).select(F.explode(grid_rows).alias("g")) if present else
               grid.limit(0).select(F.struct(F.lit("").alias("var_a"), F.lit(0.0).alias("a_lo"), F.lit(0.0).alias("a_hi")).alias("g"))) \
        .select("g.*").withColumn("var_b", F.element_at(mapping, F.col("var_a"))).where(F.col("a_lo").isNotNull())
    of_obs = obs_long.where(F.col("variable").isin([b for _, b in pairs])).select("variable", null_nonfinite("value").alias("value")) \
        .groupBy(F.col("variable").alias("var_b")).agg(F.min("value").alias("b_lo"), F.max("value").alias("b_hi")).where(F.col("b_lo").isNotNull())
    return of_grid.join(of_obs, "var_b").select("var_a", "var_b", F.least("a_lo", "b_lo").alias("v_min"), F.greatest("a_hi", "b_hi").alias("v_max"))


def display_vars(variables: DataFrame, unpaired: str = "keep") -> DataFrame:
    """Group ``uXX``/``vXX`` pairs into ``windXX`` display variables.

    ``variables``: (name, pos).  Output (display, kind, u, v, ord), ``ord``
    the display order: u-derived entries first (in u order), then the rest
    in column order.  ``unpaired='keep'`` keeps an unpaired ``u*`` as a
    scalar in the u block; ``'drop'`` drops it.

    The variable list (one row per variable) becomes one array; pairing and
    order are array functions on that row.
    """
    if unpaired not in ("keep", "drop"):
        raise ValueError(unpaired)
    row = variables.agg(F.collect_list(F.struct("pos", "name")).alias("v"))
    names = F.transform("v", lambda x: x["name"])
    null = F.lit(None).cast("string")

    def entry(x):
        name, sfx = x["name"], F.substring(x["name"], 2, 1 << 20)
        made = lambda grp, display, kind, u, v: F.struct(
            F.lit(grp).alias("grp"), x["pos"].alias("pos"), display.alias("display"), F.lit(kind).alias("kind"),
            u.alias("u"), v.alias("v"))
        partner = lambda letter: F.array_contains(names, F.concat(F.lit(letter), sfx))
        is_u, is_v = F.startswith(name, F.lit("u")), F.startswith(name, F.lit("v"))
        wind = made(0, F.concat(F.lit("wind"), sfx), "wind", name, F.concat(F.lit("v"), sfx))
        out = F.when(is_u & partner("v"), wind)
        if unpaired == "keep":
            out = out.when(is_u, made(0, name, "scalar", null, null))
        return out.when(~is_u & ~(is_v & partner("u")), made(1, name, "scalar", null, null))

    listed = F.array_sort(F.filter(F.transform("v", entry), lambda e: e.isNotNull()))
    return row.select(F.posexplode(listed).alias("ord", "e")) \
        .select("e.display", "e.kind", "e.u", "e.v", F.col("ord").cast("long").alias("ord"))


def default_var(display: DataFrame, preference=C.DEFAULT_VAR_PREFERENCE) -> DataFrame:
    """First present of the preference list, otherwise the first display variable."""
    pref = F.array(*[F.lit(p) for p in preference])
    rank = F.array_position(pref, F.col("display"))
    return display.agg(F.coalesce(
        F.min_by(F.when(rank > 0, F.col("display")), F.when(rank > 0, rank)),
        F.min_by("display", "ord")).alias("default_var"))


def compatible_pairs(vars_a: DataFrame, vars_b: DataFrame, pairs=C.COMPATIBLE_VARS) -> DataFrame:
    """Mapped variable pairs present on both sides: (var_a, var_b)."""
    spark = vars_a.sparkSession
    mapping = spark.createDataFrame(list(pairs), "var_a string, var_b string")
    return (mapping.join(vars_a.select(F.col("name").alias("var_a")), "var_a", "left_semi")
            .join(vars_b.select(F.col("name").alias("var_b")), "var_b", "left_semi")
            .select("var_a", "var_b"))


def shared_range(a: DataFrame, b: DataFrame, a_time: str, b_time: str,
                 a_name: str = "stations", b_name: str = "forecast") -> DataFrame:
    """The date range of whichever dataset spans less time (ties: ``a``).

    One aggregate per side; ``b``'s bounds enter ``a``'s one-row result as a
    single struct subquery."""
    bb = b.agg(F.struct(F.min(b_time).alias("b0"), F.max(b_time).alias("b1"))).scalar()
    one = a.agg(F.min(a_time).alias("a0"), F.max(a_time).alias("a1")).withColumn("_b", bb)
    a0, a1, b0, b1 = F.col("a0"), F.col("a1"), F.col("_b.b0"), F.col("_b.b1")
    span_a = F.unix_micros(a1.cast("timestamp")) - F.unix_micros(a0.cast("timestamp"))
    span_b = F.unix_micros(b1.cast("timestamp")) - F.unix_micros(b0.cast("timestamp"))
    one = one.withColumn("_pick_a", span_a <= span_b)
    pick_a = F.col("_pick_a")
    return one.select(
        F.to_date(F.when(pick_a, a0).otherwise(b0)).alias("start_date"),
        F.to_date(F.when(pick_a, a1).otherwise(b1)).alias("end_date"),
        F.when(pick_a, F.lit(a_name)).otherwise(F.lit(b_name)).alias("source"))


def sync_groups(groups: DataFrame, rng: DataFrame) -> DataFrame:
    """Map a [start_date, end_date] range onto date-group indices.

    ``groups``: (label 'yyyy-MM-dd', start_idx, end_idx) in frame order, one
    row per date.  Start = first group on/after start (0 if none); end =
    last group on/before end (last group if none); end < start -> end = start.
    """
    r = rng.select(F.struct("start_date", "end_date").alias("_r")).scalar()
    g = groups.select(F.to_date("label").alias("d"),
                      F.dense_rank().over(Window.orderBy("start_idx")).alias("gi")).withColumn("_r", r)
    one = g.agg(F.count(F.lit(1)).alias("_n"),
                F.min(F.when(F.col("d") >= F.col("_r.start_date"), F.col("gi"))).alias("_s"),
                F.max(F.when(F.col("d") <= F.col("_r.end_date"), F.col("gi"))).alias("_e"))
    s = F.coalesce(F.col("_s"), F.lit(1))
    e = F.coalesce(F.col("_e"), F.col("_n"))
    return one.select((s - 1).cast("long").alias("start_group"),
                      (F.greatest(s, e) - 1).cast("long").alias("end_group"))


def station_display_vars(variables: DataFrame, speed: str = "wind_3m_speed", direction: str = "wind_3m_degN",
                         combined: str = "wind_3m", wind_first: bool = True) -> DataFrame:
    """Station display list: when both wind components are present they are
    replaced by one combined entry, placed first (``wind_first``) or last.

    ``variables``: (name, pos).  Output (display, ord).
    """
    both = variables.where(F.col("name").isin(speed, direction)).agg(
        (F.count_distinct("name") == 2).alias("_both")).scalar()
    rest = variables.where(~(both & F.col("name").isin(speed, direction))).select(
        F.col("name").alias("display"), F.lit(1).alias("grp"), "pos")
    wind = variables.limit(1).select(F.lit(combined).alias("display"), F.lit(0 if wind_first else 2).alias("grp"),
                                     F.lit(-1).alias("pos")).where(both)
    out = rest.unionByName(wind)
    return out.select("display", (F.row_number().over(Window.orderBy("grp", "pos")) - 1).cast("long").alias("ord"))
