import datetime as dt

from pyspark.sql import functions as F

EP_SCHEMA = ("user_id long, age int, bmi double, stress_level int, exercise_frequency string, "
             "sleep_hours double, diet string, cycle_start_date date, cycle_length int, period_length int, "
             "next_cycle_start_date date, symptoms string")


def d(s):
    return dt.date.fromisoformat(s)


def episode(uid, start, length, period, nxt=None, diet="Balanced", symptoms="Cramps", ex="Low"):
    start = d(start)
    nxt = d(nxt) if isinstance(nxt, str) else (nxt or start + dt.timedelta(days=length))
    return (uid, 30, 22.5, 2, ex, 7.0, diet, start, length, period, nxt, symptoms)


def frame(spark, rows):
    return spark.createDataFrame(rows, EP_SCHEMA)


def rows_by(df, *keys):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(r[k] for k in keys))


def one(df):
    return df.collect()[0]


def col_list(df, c, *order):
    return [r[c] for r in df.orderBy(*(order or [c])).select(c).collect()]


__all__ = ["F", "EP_SCHEMA", "d", "episode", "frame", "rows_by", "one", "col_list"]
