"""2.A sources and sinks, 2.L streaming. Each query writes the derived tables in
the source's own format to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import R, query, rnd
from tideline.catalog.survival import SPEED_COLS, STATE, WEIGHT, speeds_sql, tidy
from tideline.functions import periods, rates
from tideline.functions.curves import TENORS
from tideline.operators import survival
from tideline.session import cut_lineage, run_dir
from tideline.sources import series, shards, vintages
from tideline.streaming import cube


def raw_panel(fx):
    """Loan view in the raw layout's columns."""
    return fx.loan.select(
        "loan_id", "mmyyyy", "note_rate", "orig_upb", "upb", periods.to_mmyyyy("orig_ym").alias("orig_mmyyyy"), "file_age",
        "ltv", "dti", "fico", "purpose", "property_type", "zip3", "zbc", "vintage", "yyyymm")


def write_raw(fx, name: str) -> str:
    folder = run_dir(fx.spark, name)
    vintages.raw_fields(raw_panel(fx)).write.partitionBy("vintage").option("sep", "|").csv(folder)
    return folder


SCAN = ["loan_id", "mmyyyy", "note_rate", "upb", "fico", "purpose", "zbc"]


@query("A1_scan_vintage", "f_loan", "SELECT loan_id, yyyymm, mmyyyy, note_rate, upb, fico, purpose, zbc FROM f_loan WHERE vintage = '1995Q1'")
def _(fx):
    folder = write_raw(fx, "raw")
    df = vintages.scan_vintage(fx.spark, f"{folder}/vintage=1995Q1", SCAN)
    return df.select("loan_id", "yyyymm", *SCAN[1:])


@query("A2_scan_all_vintages", "f_loan", "SELECT vintage, count(*) AS n, CAST(sum(CASE WHEN zbc = 1 THEN 1 ELSE 0 END) AS BIGINT) AS events FROM f_loan WHERE vintage IN ('1995Q1','1995Q2','1996Q3') GROUP BY 1")
def _(fx):
    """A named list with a vintage that does not exist; it is skipped."""
    folder = write_raw(fx, "raw")
    df = vintages.scan_all(fx.spark, folder, ["1995Q1", "1995Q2", "1996Q3", "2049Q1"], columns=["loan_id", "mmyyyy", "zbc"])
    return df.groupBy("vintage").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("zbc") == 1, 1).otherwise(0)).alias("events"))


@query("A3_vintage_tag", "f_loan", "SELECT vintage, count(DISTINCT loan_id) AS loans FROM f_loan GROUP BY 1")
def _(fx):
    folder = write_raw(fx, "raw")
    df = vintages.scan_all(fx.spark, folder, columns=["loan_id"])
    return df.groupBy("vintage").agg(F.countDistinct("loan_id").alias("loans"))


@query("A4_scan_rate_series", "f_market_rate", "SELECT yyyymm, mmyyyy, mi, rate_30yr FROM f_market_rate")
def _(fx):
    path = run_dir(fx.spark, "rate")
    df = fx.market_rate.select(F.floor(F.col("yyyymm") / 100).alias("year"), (F.col("yyyymm") % 100).alias("month"), "rate_30yr", F.col("mmyyyy").alias("reporting_period"))
    series.sink_table(df, path, "csv")
    return series.scan_rate_series(fx.spark, path).select("yyyymm", "mmyyyy", "mi", "rate_30yr")


@query("A5_scan_hpi_long", "f_hpi", "SELECT zip3, yyyymm, hpi FROM f_hpi")
def _(fx):
    path = run_dir(fx.spark, "hpi")
    series.sink_table(fx.hpi.select("zip3", periods.to_mmyyyy("yyyymm").alias("reporting_period"), "hpi"), path, "csv")
    return series.scan_hpi_long(fx.spark, path)


@query("A6_hpi_wide_to_long", "f_hpi", f"SELECT zip3 // 10 AS zip3, yyyymm, {R('avg(hpi)', 9)} AS hpi FROM f_hpi GROUP BY 1, 2")
def _(fx):
    """Wide file (a column per month) back to long; zips share a zip3 prefix."""
    months = fx.hpi.agg(F.min("yyyymm"), F.max("yyyymm")).first()
    names = [f"{y}-{m:02d}-01" for y in range(months[0] // 100, months[1] // 100 + 1) for m in range(1, 13)]
    zipcode = F.lpad(F.floor(F.col("zip3") / 10).cast("string"), 3, "0")
    region = F.concat(zipcode, F.lpad((F.col("zip3") % 10).cast("string"), 2, "0")).cast("bigint")
    wide = fx.hpi.select(region.alias("RegionName"), F.date_format(periods.yyyymm_to_date("yyyymm"), "yyyy-MM-dd").alias("m"), "hpi").groupBy("RegionName").pivot("m", names).agg(F.max("hpi"))
    return rnd(series.hpi_wide_to_long(wide, from_year=months[0] // 100), 9)


@query("A7_scan_price_wide", "f_price", f"SELECT make_date(yyyymm//100, yyyymm%100, 1) AS date, yyyymm, coupon, {R('price', 9)} AS price FROM f_price")
def _(fx):
    path = run_dir(fx.spark, "price")
    columns = [f"FNCL {r['coupon']}" for r in fx.price.select("coupon").distinct().orderBy("coupon").collect()]
    wide = fx.price.select(periods.yyyymm_to_date("yyyymm").alias("Date"), F.concat(F.lit("FNCL "), F.col("coupon").cast("string")).alias("c"), "price").groupBy("Date").pivot("c", columns).agg(F.max("price"))
    series.sink_table(wide, path, "csv")
    back = series.scan_csv(fx.spark, path, "Date date, " + ", ".join(f"`{c}` double" for c in columns))
    return rnd(series.price_wide_to_long(back), 9)


@query("A8_scan_curve", "f_curve_daily", f"SELECT d, {', '.join(TENORS)} FROM f_curve_daily")
def _(fx):
    path = run_dir(fx.spark, "curve")
    series.sink_table(fx.curve_daily.select("d", *TENORS), path, "csv")
    return series.scan_csv(fx.spark, path, "d date, " + ", ".join(f"{t} double" for t in TENORS))


@query("A9_scan_params", "f_forecast", f"""WITH p AS (SELECT round(avg(forecast_cpr), 6) AS floor_, round(max(forecast_cpr), 6) AS sat FROM f_forecast)
SELECT coupon, yyyymm, {R("floor_ + (sat-floor_)/(1+exp(-3.0*((coupon+0.5-rate_30yr)-0.4)))")} AS terminal_cpr FROM f_forecast, p""")
def _(fx):
    """Parameters written as JSON, read back and applied as one scalar row."""
    path = run_dir(fx.spark, "params")
    f = F.col("forecast_cpr")
    series.sink_summary(fx.forecast.agg(F.round(F.avg(f), 6).alias("floor"), F.round(F.max(f), 6).alias("sat"), F.lit(3.0).alias("k"), F.lit(0.4).alias("x0")), path)
    p = series.scan_params(fx.spark, path, "floor double, sat double, k double, x0 double")
    df = fx.forecast.withColumn("p", p.select(F.struct("*")).scalar())
    x = F.col("coupon") + 0.5 - F.col("rate_30yr")
    return rnd(df.select("coupon", "yyyymm", rates.scurve(x, "p.floor", "p.sat", "p.k", "p.x0").alias("terminal_cpr")))


@query("A10_sink_csv", "f_forecast", f"SELECT coupon, yyyymm, {R('forecast_cpr', 9)} AS forecast_cpr FROM f_forecast")
def _(fx):
    path = run_dir(fx.spark, "out")
    df = fx.forecast.select("coupon", "yyyymm", "forecast_cpr")
    series.sink_table(df, f"{path}/csv", "csv")
    series.sink_table(df, f"{path}/parquet")
    text = series.scan_csv(fx.spark, f"{path}/csv", "coupon double, yyyymm bigint, forecast_cpr double")
    both = text.join(fx.spark.read.parquet(f"{path}/parquet"), ["coupon", "yyyymm", "forecast_cpr"], "left_semi")
    return rnd(both, 9)


@query("A11_sink_json_summary", "f_forecast", f"SELECT count(*) AS n, {R('avg(forecast_cpr)', 9)} AS mean, {R('max(forecast_cpr)', 9)} AS max, count(DISTINCT coupon) AS coupons FROM f_forecast")
def _(fx):
    path = run_dir(fx.spark, "summary")
    f = F.col("forecast_cpr")
    row = fx.forecast.agg(F.count(F.lit(1)).alias("n"), F.struct(F.avg(f).alias("mean"), F.max(f).alias("max")).alias("speed"), F.countDistinct("coupon").alias("coupons"))
    series.sink_summary(row, path)
    back = series.scan_params(fx.spark, path, "n bigint, speed struct<mean double, max double>, coupons bigint")
    return rnd(back.select("n", "speed.mean", "speed.max", "coupons"), 9)


@query("A12_shard_resume", "f_loan", "SELECT vintage, count(*) AS n_rows, false AS is_empty, sum(upb) > 0 AS has_balance FROM f_loan GROUP BY 1 UNION ALL SELECT '2049Q1', 0, true, NULL")
def _(fx):
    """First run writes 1995, the second only what is missing (one vintage is
    empty and is flagged)."""
    folder = run_dir(fx.spark, "shards")
    df = fx.loan.select("vintage", "loan_id", "yyyymm", "upb")
    all_v = df.select("vintage").distinct().unionByName(fx.spark.createDataFrame([("2049Q1",)], "vintage string"))
    shards.write_missing(df, folder, all_v.filter("vintage < '1996Q1'"))
    done = shards.write_missing(df, folder, all_v)
    data = shards.read_shards(fx.spark, folder, "loan_id bigint, yyyymm bigint, upb double, vintage string")
    seen = data.groupBy("vintage").agg(F.count(F.lit(1)).alias("n_rows"), (F.sum("upb") > 0).alias("has_balance"))
    return done.select("vintage", "is_empty").join(seen, "vintage", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))


@query("A13_pass_checkpoint", "f_loan", "SELECT round_even(note_rate*2,0)/2 AS coupon_bucket, yyyymm, count(*) AS n_atrisk, count(*) FILTER (zbc = 1) AS n_prepay FROM f_loan GROUP BY 1, 2")
def _(fx):
    """Partial aggregates per vintage, resumed and merged."""
    folder = run_dir(fx.spark, "partials")
    part = fx.loan.groupBy("vintage", rates.coupon_bucket("note_rate").alias("coupon_bucket"), "yyyymm").agg(
        F.count(F.lit(1)).alias("n_atrisk"), F.count_if(F.col("zbc") == 1).alias("n_prepay"))
    every = fx.loan.select("vintage").distinct()
    shards.write_missing(part, folder, every.filter("vintage < '1996Q1'"))
    shards.write_missing(part, folder, every)
    return shards.merge_partials(fx.spark, folder, "coupon_bucket double, yyyymm bigint, n_atrisk bigint, n_prepay bigint, vintage string", ["coupon_bucket", "yyyymm"], ["n_atrisk", "n_prepay"])


@query("A14_consistency_gate", "f_hpi", f"SELECT count(*) AS n_common, {R('max(hpi*0.001)')} AS max_abs_diff, {R('avg(hpi*0.001)')} AS mean_abs_diff, max(hpi*0.001) < 1.0 AS accept FROM f_hpi")
def _(fx):
    folder = run_dir(fx.spark, "hpi_versions")
    old = fx.spark.read.parquet(shards.publish(fx.hpi, folder, 1))
    new = fx.hpi.withColumn("hpi", F.col("hpi") * 1.001)
    gate = shards.consistency_gate(old, new, ["zip3", "yyyymm"], "hpi", 1.0)
    shards.publish(new, folder, 2, gate)
    return rnd(gate)


BUCKETS, FILES = 16, 8  # of the streamed state, and files of one delivery


@query("L1_stream_vintages", "f_loan", f"WITH {STATE}, {WEIGHT} " + speeds_sql(""))
def _(fx):
    """Four deliveries in time order stream in, a few files per batch (a loan's
    later months come in later files); the merged cube equals the batch result.

    The panel is derived once. A delivery has eight files of whole hash buckets of the state, however large it is, so
    the number of batches is fixed and each reads the state of its own buckets only."""
    inbox, state = run_dir(fx.spark, "inbox"), run_dir(fx.spark, "cube")
    panel = cut_lineage(raw_panel(fx).drop("vintage"))
    bounds = [0, 199612, 199806, 200001, 999912]
    for lo, hi in zip(bounds, bounds[1:]):
        part = panel.filter((F.col("yyyymm") > lo) & (F.col("yyyymm") <= hi)).repartitionByRange(FILES, F.pmod(F.xxhash64("loan_id"), F.lit(BUCKETS)))
        vintages.raw_fields(part).write.mode("append").option("sep", "|").csv(inbox)
    stream = vintages.stream_vintages(fx.spark, inbox, 4, ["loan_id", "mmyyyy", "note_rate", "upb"])
    cube.run_available(stream, state, buckets=BUCKETS)
    return tidy(cube.cube(fx.spark, state))
