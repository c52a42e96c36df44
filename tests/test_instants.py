"""Timestamps to instants."""

from datetime import datetime, timezone

from guichet.operators.instants import normalise_times, zone_intervals

UTC = timezone.utc
CASES = {
    "05-01-2026 16:24": datetime(2026, 1, 5, 15, 24), "06/02/2026 16:18": datetime(2026, 2, 6, 15, 18), "2026-01-05T16:24:00": datetime(2026, 1, 5, 15, 24),
    "2026-01-05": datetime(2026, 1, 4, 23), "44914,39167": datetime(2022, 12, 19, 8, 24), "44914.39167": datetime(2022, 12, 19, 8, 24), "44927": datetime(2022, 12, 31, 23),
    "2025-10-26 02:30": datetime(2025, 10, 26, 0, 30), "Wed, 08 Oct 2025 22:31:11 +0200": datetime(2025, 10, 8, 20, 31, 11), "jeudi 30 octobre 2025 12:55": datetime(2025, 10, 30, 11, 55),
    "22 juin 2024 à 14h19": datetime(2024, 6, 22, 12, 19), "1er août 2024": datetime(2024, 7, 31, 22), "2024-08-10T04:11:37.5+02:00[Europe/Paris]": datetime(2024, 8, 10, 2, 11, 37, 500000),
    "1712553264225": datetime(2024, 4, 8, 5, 14, 24, 225000), "1754215804": datetime(2025, 8, 3, 10, 10, 4), "31/03/24 05:43": datetime(2024, 3, 31, 3, 43), "2025-01-20 00:59:47-04:00": datetime(2025, 1, 20, 4, 59, 47),
    "20251002T060322Z": datetime(2025, 10, 2, 6, 3, 22), "2024-03-31 02:08:59 Indian/Mayotte": datetime(2024, 3, 30, 23, 8, 59), "12/08/2025 19:15:46 CEST": datetime(2025, 8, 12, 17, 15, 46),
    "  05-01-2026 16:24\n": datetime(2026, 1, 5, 15, 24),
    "30/03/2025 02:30": None, "2024-05-14 10:00:00 Foo/Bar": None, "16 frimaire 2025 à 9h00": None, "": None, "  ": None, None: None, "12-05-2025 24:10": None, "29-02-2025": None, "2025-13-01": None,
    "not-a-date": None, "semaine 14": None, "########": None, "0": None, "x" * 100_000: None,
}


def test_cases(spark):
    df = spark.createDataFrame([(i, v, "y", 3) for i, v in enumerate(CASES)], "k long, t string, champ string, zone int")
    got = {r.k: (r.instant_us, r.etat) for r in normalise_times(df, ["k"], ["t"]).collect()}
    for i, (text, want) in enumerate(CASES.items()):
        us = None if want is None else int(want.replace(tzinfo=UTC).timestamp() * 1_000_000)
        assert got[i][0] == us, text
    states = {v: got[i][1] for i, v in enumerate(CASES)}
    assert states["30/03/2025 02:30"] == "inexistant" and states["2025-10-26 02:30"] == "ambigu" and states["05-01-2026 16:24"] == "decale" and states["1754215804"] == "exact" and states[None] == "illisible"


def test_intervals_match_the_zone_database():
    import random
    import zoneinfo

    rnd = random.Random(1)
    for zone in ("Europe/Paris", "America/Guadeloupe", "Australia/Lord_Howe", "Asia/Kathmandu"):
        z = zoneinfo.ZoneInfo(zone)
        for _ in range(200):
            t = datetime.fromtimestamp(rnd.randrange(1704067200, 1735689600), UTC)
            local = t.astimezone(z)
            us = int((local.replace(tzinfo=UTC)).timestamp()) * 1_000_000
            hits = [i for i in zone_intervals(zone, local.year) if i["debut"] <= us < i["fin"]]
            assert int(local.utcoffset().total_seconds()) * 1_000_000 in [i["decalage"] for i in hits]
    assert zone_intervals("Foo/Bar", 2024) is None


def test_empty_and_repeats(spark):
    assert normalise_times(spark.createDataFrame([], "k long, t string"), ["k"], ["t"]).count() == 0
    df = spark.createDataFrame([(1, "2026-01-05")] * 3, "k long, t string")
    assert normalise_times(df, ["k"], ["t"]).count() == 3
