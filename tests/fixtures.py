"""Paths and hand-made source files shared by the tests."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

HEADER = ["DATE_TIME", "LATITUDE", "LONGITUDE", "GEOHASH", "MINIMUM_SPEED", "MAXIMUM_SPEED", "AVERAGE_SPEED", "NUMBER_OF_VEHICLES"]


def write_csv(path, rows, header=HEADER):
    """Hand-made source file: ``rows`` are dicts keyed by header name."""
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if r.get(h) is None else str(r.get(h)) for h in header) + "\n")


def month_rows(year, month, n=3, geohash="sxk9", speed=30):
    return [
        {
            "DATE_TIME": f"{year:04d}-{month:02d}-{d + 1:02d} {d % 24:02d}:00:00",
            "LATITUDE": 41.0 + d * 0.001,
            "LONGITUDE": 29.0,
            "GEOHASH": geohash,
            "MINIMUM_SPEED": 5,
            "MAXIMUM_SPEED": 90,
            "AVERAGE_SPEED": speed + d,
            "NUMBER_OF_VEHICLES": 10 + d,
        }
        for d in range(n)
    ]
