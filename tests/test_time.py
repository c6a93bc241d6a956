from pyspark.sql import functions as F

from gleaner.functions.value import epoch_micros


def test_epoch_micros_ignores_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:07.179575' AS t UNION ALL SELECT TIMESTAMP_NTZ '1969-12-31 23:59:59.5'")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Paris", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = sorted(r["m"] for r in df.select(epoch_micros(F.col("t")).alias("m")).collect())
            assert got == [-500000, 1711852207179575]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
