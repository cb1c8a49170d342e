"""Provider payloads to rows: nested and damaged JSON, parallel arrays, XML.

Every parser takes payloads (source, body) and gives one row per observation with the column ``fault`` null.  What can't be used is
not dropped: a payload or row that fails is a row with its source and a fault, so that good rows and the quarantine are one
table.  Bodies are parsed by Spark's own readers of JSON and XML; a body that isn't one, a null one and an empty one are ``malformed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the formats: rows of a lending table that add others up, marks of a missing number, years before the Republic's first.
AGGREGATE_ROWS = ["합계", "평균"]
MISSING = ["", "--", "N/A", "null", "-"]
REPUBLIC = 1911
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def number(text: Column) -> Column:
    """A provider's number: $ , and % are taken off, the marks of a missing one and what isn't a number are null."""
    bare = F.trim(F.regexp_replace(text, "[$,%]", ""))
    return F.when(~bare.isin(MISSING), bare.try_cast("double"))


def good(rows: DataFrame) -> DataFrame:
    return rows.where("fault is null").drop("fault")


def quarantine(rows: DataFrame) -> DataFrame:
    """Sources with their faults and how often each occurs."""
    return rows.where("fault is not null").groupBy("source", "fault").agg(F.count("*").alias("n"))


def _parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """(source, p, broken) with the body as a struct; broken where it isn't JSON."""
    p = F.from_json("body", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return payloads.select("source", p.alias("p")).withColumn("broken", F.col("p").isNull() | F.col("p._broken").isNotNull())


def _outer(rows: DataFrame, items: Column, fault: Column) -> DataFrame:
    """One row (source, e, fault) per item, and one with a fault for payloads that have one."""
    return rows.select("source", fault.alias("fault"), items.alias("items")).select("source", "fault", F.explode(F.when(F.col("fault").isNotNull(), F.array(F.lit(None))).otherwise(F.col("items"))).alias("e"))


def republic_months(payloads: DataFrame) -> DataFrame:
    """SRC-07: monthly tables of string rows with dates of the Republic's calendar (yyy/mm/dd), volume second and prices from the
    fourth; a month whose stat isn't OK is a fault, a row without a date too."""
    rows = _parsed(payloads, "stat string, data array<array<string>>")
    # Spark reads a broken body as far as it goes: nothing of it is used
    fault = F.when(F.col("broken"), "malformed").when(F.coalesce(F.col("p.stat"), F.lit("")) != "OK", "status")
    each = _outer(rows, F.col("p.data"), fault)
    part = lambda i: F.get(F.split(F.get("e", F.lit(0)), "/"), F.lit(i))
    date = F.concat_ws("-", (part(0).try_cast("int") + REPUBLIC).cast("string"), part(1), part(2)).try_cast("date")
    cell = lambda i: number(F.get("e", F.lit(i)))
    out = each.select("source", F.when(F.col("fault").isNull() & part(2).isNotNull(), date).alias("date"), cell(3).alias("open"), cell(4).alias("high"), cell(5).alias("low"), cell(6).alias("close"), cell(1).alias("volume"), "fault")
    out = out.withColumn("fault", F.coalesce("fault", F.when(F.col("date").isNull(), "date")))
    values = ["open", "high", "low", "close", "volume"]
    return out.select("source", "date", *(F.when(F.col("fault").isNull(), F.col(c)).alias(c) for c in values), "fault")


def rate_maps(payloads: DataFrame, currency: str) -> DataFrame:
    """SRC-08: rates by date and currency as nested maps; close is null on days without the currency, a body without rates is a fault."""
    rows = _parsed(payloads, "rates map<string, map<string, double>>")
    fault = F.when(F.col("broken"), "malformed").when(F.coalesce(F.size("p.rates"), F.lit(0)) < 1, "empty")
    each = _outer(rows, F.map_entries("p.rates"), fault)
    date = F.col("e.key").try_cast("date")
    return each.select("source", date.alias("date"), F.when(date.isNotNull(), F.try_element_at("e.value", F.lit(currency))).alias("close"), F.coalesce("fault", F.when(date.isNull(), "date")).alias("fault"))


def charts(payloads: DataFrame) -> DataFrame:
    """SRC-11: bars as parallel arrays, each stamped with its session's opening instant, which is a date in the exchange's own
    zone.  Without adjusted closes these are the closes.  Rows without any price drop, of a date's rows the last one stays; a body
    without stamps has no rows."""
    quote = ", ".join(f"{c}: array<double>" for c in ("open", "high", "low", "close", "volume"))
    indicators = f"struct<quote: array<struct<{quote}>>, adjclose: array<struct<adjclose: array<double>>>>"
    fields = f"meta: struct<exchangeTimezoneName: string>, timestamp: array<bigint>, indicators: {indicators}"
    rows = _parsed(payloads, f"chart struct<result: array<struct<{fields}>>>").withColumn("r", F.get("p.chart.result", F.lit(0)))
    rows = rows.withColumn("q", F.get("r.indicators.quote", F.lit(0))).withColumn("adj", F.coalesce(F.get("r.indicators.adjclose", F.lit(0))["adjclose"], F.col("q.close")))
    fault = F.when(F.col("broken"), "malformed").when(F.col("r").isNull(), "empty")
    zone = F.coalesce("r.meta.exchangeTimezoneName", F.lit("UTC"))
    held = lambda c: F.coalesce(c, F.array().cast("array<double>"))
    columns = [held(F.col(f"q.{c}")).alias(c) for c in ("open", "high", "low", "close", "volume")]
    wide = rows.select("source", fault.alias("fault"), zone.alias("zone"), F.col("r.timestamp").alias("epoch"), *columns, held(F.col("adj")).alias("adj_close"))
    prices = ["open", "high", "low", "close", "adj_close"]
    each = wide.where("fault is null").select("source", "zone", F.posexplode(F.arrays_zip("epoch", *prices, "volume")).alias("at", "e")).select("source", "zone", "at", "e.*").where("epoch is not null")
    each = each.dropna(how="all", subset=prices)
    each = each.withColumn("date", F.expr(f"cast(convert_timezone('UTC', zone, timestampadd(SECOND, epoch, {EPOCH})) as date)"))
    last = each.groupBy("source", "date").agg(F.max_by(F.struct(*prices, "volume"), "at").alias("m")).select("source", "date", "m.*", F.lit(None).cast("string").alias("fault"))
    bad = wide.where("fault is not null").select("source", "fault")
    return last.unionByName(bad, allowMissingColumns=True)


def lending_tables(payloads: DataFrame) -> DataFrame:
    """SRC-12: lending balances whose numbers may be masked by # signs, which is no JSON: these become null before parsing.  Rows
    that add others up drop; a row without a date is a fault."""
    names = {"TMPV2": "issue_name", "TMPV3": "new_lending_shares", "TMPV4": "repaid_shares", "TMPV5": "balance_shares", "TMPV6": "balance_value_unverified_unit"}
    repaired = payloads.withColumn("body", F.regexp_replace("body", r"(:\s*)\d*#+", "$1null"))
    rows = _parsed(repaired, "ds1 array<struct<TMPV1: string, TMPV2: string, TMPV3: bigint, TMPV4: bigint, TMPV5: bigint, TMPV6: bigint>>")
    each = _outer(rows, F.filter("p.ds1", lambda e: ~F.coalesce(e["TMPV1"], F.lit("")).isin(AGGREGATE_ROWS)), F.when(F.col("broken"), "malformed"))
    t = F.col("e.TMPV1")
    date = F.when(F.length(t) == 8, F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)).try_cast("date"))
    return each.select("source", date.alias("date"), *(F.col(f"e.{k}").alias(v) for k, v in names.items()), F.coalesce("fault", F.when(date.isNull(), "date")).alias("fault"))


def observations(payloads: DataFrame) -> DataFrame:
    """SRC-09: macro observations, whose missing values are points; these drop, a body without observations is a fault."""
    rows = _parsed(payloads, "observations array<struct<date: string, value: string>>")
    fault = F.when(F.col("broken"), "malformed").when(F.coalesce(F.size("p.observations"), F.lit(0)) < 1, "empty")
    each = _outer(rows, F.col("p.observations"), fault)
    out = each.select("source", F.col("e.date").try_cast("date").alias("date"), F.when(F.col("e.value") != ".", number(F.col("e.value"))).alias("close"), "fault")
    return out.where("fault is not null or close is not null").withColumn("fault", F.coalesce("fault", F.when(F.col("date").isNull(), "date")))


_HOLDING = "nameOfIssuer string, cusip string, value string, shrsOrPrnAmt struct<sshPrnamt: string>"


def _holding(e: str) -> list[Column]:
    amount = lambda c: F.coalesce(F.regexp_replace(c, ",", "").try_cast("double"), F.lit(0.0))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return [F.upper(text(F.col(f"{e}nameOfIssuer"))).alias("issuer"), text(F.col(f"{e}cusip")).alias("cusip"), amount(F.col(f"{e}value")).alias("value"), amount(F.col(f"{e}shrsOrPrnAmt.sshPrnamt")).alias("shares")]


def information_tables(payloads: DataFrame) -> DataFrame:
    """SRC-14: holdings of XML information tables, with or without a name space: source, issuer, cusip, value (as filed), shares.

    ``payloads`` may have a column ``declared``, the number of holdings that the filing claims; a document with another number is
    a fault (``count``), as is one that isn't XML.  Names are trimmed and upper-cased; amounts lose their commas, and what isn't
    one is 0.
    """
    fields = "nameOfIssuer: string, cusip: string, value: string, shrsOrPrnAmt: struct<sshPrnamt: string>"
    p = F.from_xml("body", f"infoTable array<struct<{fields}>>, _broken string", {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_broken"})
    rows = payloads.select("source", p.alias("p"), *(["declared"] if "declared" in payloads.columns else []))
    found = F.coalesce(F.size("p.infoTable"), F.lit(0))
    other = found != F.col("declared") if "declared" in payloads.columns else F.lit(False)
    fault = F.when(F.col("p").isNull() | F.col("p._broken").isNotNull(), "malformed").when(other, "count")
    each = _outer(rows, F.col("p.infoTable"), fault)
    values = ("issuer", "cusip", "value", "shares")
    return each.select("source", *_holding("e."), "fault").select("source", *(F.when(F.col("fault").isNull(), F.col(c)).alias(c) for c in values), "fault")


def information_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14 from files too large for a row: holdings of every information table under ``path``, with their file."""
    rows = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", "true").schema(_HOLDING).load(path)
    return rows.select(F.col("_metadata.file_path").alias("source"), *_holding(""))


def registry_codes(payloads: DataFrame) -> DataFrame:
    """SRC-17: stock_code to corp_code and name from registry XML; issuers without a stock code drop, of a code's entries the last
    of the document stays."""
    fields = "corp_code: string, corp_name: string, stock_code: string"
    p = F.from_xml("body", f"list array<struct<{fields}>>, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = payloads.select("source", p.alias("p"))
    fault = F.when(F.col("p").isNull() | F.col("p._broken").isNotNull(), "malformed")
    each = rows.select("source", fault.alias("fault"), F.posexplode(F.when(fault.isNull(), F.col("p.list")).otherwise(F.array(F.lit(None)))).alias("at", "e"))
    text = lambda c: F.coalesce(F.trim(F.col(f"e.{c}")), F.lit(""))
    out = each.select("source", "at", text("stock_code").alias("stock_code"), text("corp_code").alias("corp_code"), text("corp_name").alias("corp_name"), "fault").where("fault is not null or stock_code <> ''")
    last = out.withColumn("k", F.row_number().over(Window.partitionBy("source", "stock_code").orderBy(F.col("at").desc()))).where("k = 1")
    return last.select("source", *(F.when(F.col("fault").isNull(), F.col(c)).alias(c) for c in ("stock_code", "corp_code", "corp_name")), "fault")
