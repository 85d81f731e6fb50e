"""Station series and forecast valid times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import add_hours, null_nonfinite
from . import select as S

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


class UnknownStationError(KeyError):
    pass


def series(obs_long: DataFrame, variables, station: str | None = None, start=None, end=None,
           present=None, check_station: bool = True) -> DataFrame:
    """Long series (station, time label, variable, value) for a variable list.

    Unknown variables are skipped (``present`` is the list of variables the
    dataset has; when omitted all requested ones are kept); when none is left
    an error is raised.  Without a station every station is returned.
    """
    wanted = [v for v in variables if present is None or v in present]
    if not wanted:
        raise S.NoVariablesError(f"none of {list(variables)} is present")
    df = obs_long.where(F.col("variable").isin(wanted))
    if station is not None:
        if check_station and not S.station_exists(obs_long, station):
            raise UnknownStationError(station)
        df = S.station_filter(df, station)
    df = S.time_slice(df, start, end)
    return df.select("station", F.date_format("time", ISO_SECONDS).alias("time"), "variable",
                     null_nonfinite("value").alias("value"))


def valid_time(df: DataFrame, time_col: str = "time", step_col: str = "step") -> DataFrame:
    """Valid time = run time + lead hours, with the two display labels.

    ``label``: ``YYYY-mm-dd HH:MM (T=HH:MM +Nh)`` with N the whole lead hours;
    ``label_12h``: ``dd-MM-yyyy hh:mm am`` of the valid time.
    """
    vt = add_hours(time_col, F.col(step_col))
    lead = F.col(step_col).cast("long")
    vt_whole = F.col(time_col) + F.make_dt_interval(hours=lead.cast("int"))
    label = F.format_string("%s (T=%s +%dh)", F.date_format(vt_whole, "yyyy-MM-dd HH:mm"),
                            F.date_format(time_col, "HH:mm"), lead)
    return df.withColumns({
        "valid_time": vt,
        "label": label,
        "label_12h": F.lower(F.date_format(vt, "dd-MM-yyyy hh:mm a")),
    })
