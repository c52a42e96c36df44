"""Mixed timestamp formats and zones to UTC instants.

Texts become civil times (``functions.temps``); civil times meet the offset intervals of their
zone. The interval table is built only for the (zone, year) pairs that occur, by probing the
zone database on executors, and joined on that pair: two matching intervals mean an ambiguous
time, none a nonexistent one, one gives the offset.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guichet.functions.temps import read_times
from guichet.session import cut

INTERVALS = "array<struct<debut:bigint,fin:bigint,decalage:bigint>>"
#: Zone names (below 600) times years: a table under this many rows (some 200 bytes each) is broadcast.
BROADCAST_ROWS = 200_000
#: Beyond it rows meet it by zone and year in so many salted parts, so that the zone of most rows is no hot key.
SALTS = 64
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def zone_intervals(zone: str, year: int) -> list[dict] | None:
    """Intervals of local time with one offset that touch the local year; None for an unknown zone."""
    import zoneinfo

    try:
        z = zoneinfo.ZoneInfo(zone)
    except Exception:
        return None
    if not 1 < year < 9998:
        return None
    off = lambda t: int((_EPOCH + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())
    a = int((datetime(year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) - 2 * 86400
    b = int((datetime(year + 1, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds()) + 2 * 86400
    out, begin, last = [], a, off(a)
    for t in range(a, b, 86400):
        lo, hi = t, t + 86400
        if off(hi) == last:
            continue
        while hi - lo > 1:  # the second of the change
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if off(mid) == last else (lo, mid)
        out.append((begin, hi, last))
        begin, last = hi, off(hi)
    out.append((begin, b, last))
    return [{"debut": (s + o) * 1_000_000, "fin": (e + o) * 1_000_000, "decalage": o * 1_000_000} for s, e, o in out]


def interval_table(pairs: DataFrame) -> DataFrame:
    """``zone, annee`` (distinct) with ``intervalles``."""

    @F.pandas_udf(INTERVALS)
    def build(zone: pd.Series, year: pd.Series) -> pd.Series:
        return pd.Series([zone_intervals(z, int(y)) for z, y in zip(zone, year)])

    return pairs.withColumn("intervalles", build("zone", "annee"))


def resolve(parsed: DataFrame, parts: str = "lu", out: str = "instant_us", status: str = "etat") -> DataFrame:
    """Turn column ``parts`` (see ``read_times``) into an instant and a status.

    ``status``: ``exact``, ``decale`` (one matching interval), ``ambigu`` (two: the first instant
    is taken), ``inexistant`` (none), ``illisible`` (no time was read). Empty input gives an empty
    result. Rows with their own offset keep a null zone and never meet the table.
    """
    zone, year = F.col(f"{parts}.zone"), F.year(F.timestamp_micros(F.col(f"{parts}.local_us"))).cast("int")
    # Written once: read twice below, and the reading of a text is too much code to stand in every stage.
    keyed = cut(parsed, "temps").withColumns({"_zone": zone, "_annee": year})
    pairs = keyed.where(F.col("_zone").isNotNull()).select(F.col("_zone").alias("zone"), F.col("_annee").alias("annee")).distinct()
    table = cut(interval_table(pairs), "intervalles").withColumnsRenamed({"zone": "_z", "annee": "_a"})
    same = (F.col("_zone") == F.col("_z")) & (F.col("_annee") == F.col("_a"))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    else:
        keyed = keyed.withColumn("_sel", F.pmod(F.xxhash64(f"{parts}.local_us"), F.lit(SALTS)).cast("int"))
        table = table.withColumn("_sel_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.col("_sel") == F.col("_sel_t"))
    joined = keyed.join(table, same, "left")
    local = F.col(f"{parts}.local_us")
    hits = F.filter("intervalles", lambda i: (i["debut"] <= local) & (local < i["fin"]))
    instants = F.transform(hits, lambda i: local - i["decalage"])
    n = F.coalesce(F.size(hits), F.lit(0))
    own = F.col(f"{parts}.instant_us")
    return joined.withColumns(
        {
            out: F.coalesce(own, F.array_min(instants)),
            status: F.when(own.isNotNull(), "exact").when(local.isNull(), "illisible").when(n == 0, "inexistant").when(n == 1, "decale").otherwise("ambigu"),
        }
    ).drop("_zone", "_annee", "_z", "_a", "intervalles", "_sel", "_sel_t")


def normalise_times(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per (record, time column) with a value: ``keys, champ, texte, instant_us, etat``.

    Null and blank values give ``illisible``. Repeated records each keep their rows. Other
    columns of ``df`` are left behind, so their names can't clash.
    """
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("champ"), F.col(c).cast("string").alias("texte")) for c in columns])).alias("_v")).select(*keys, "_v.champ", "_v.texte")
    return resolve(read_times(long, "texte")).drop("lu")
