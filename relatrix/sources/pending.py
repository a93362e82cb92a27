"""What a collection run still has to ask for, from lists of what is wanted and of the files that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import key_report

#: A document's files, and what lists call a series' first and last period by its frequency.
BODY, DOCUMENT = "body.html", "original.pdf"
BOUNDS = {"M": ("01", "12"), "Q": ("Q1", "Q4"), "D": ("0101", "1231")}


def macro_requests(indicators: DataFrame, first_year: int, last_year: int, cached: DataFrame) -> DataFrame:
    """SRC30: (code, freq, first_period, last_period, file) of the series (code, freq) whose file is not among ``cached`` (file).

    Months are 202001, quarters 2020Q1, days 20200101, anything else years.
    """
    ends = [F.concat(F.lit(str(year)), F.coalesce(*(F.when(F.col("freq") == f, b[i]) for f, b in BOUNDS.items()), F.lit(""))) for i, year in enumerate((first_year, last_year))]
    rows = indicators.select("code", "freq", ends[0].alias("first_period"), ends[1].alias("last_period")).distinct()
    rows = rows.withColumn("file", F.concat(F.concat_ws("_", "code", "freq", "first_period", "last_period"), F.lit(".json")))
    return rows.join(cached.select("file").distinct(), "file", "left_anti").select("code", "freq", "first_period", "last_period", "file")


def document_states(pool: DataFrame, files: DataFrame, most: int = 300) -> DataFrame:
    """SRC23: (corp, receipt, state, place) of the first ``most`` receipts of each company in the order of the pool (corp, receipt, pos).

    ``files``: (corp, receipt, name). With both files a receipt is "cached", with the body only "pdf_only" (the document alone is asked for again), else "fetch".
    A receipt that is listed again keeps its first place; rows without a company or a receipt are left out.
    """
    once = pool.where("corp <> '' and receipt <> ''").groupBy("corp", "receipt").agg(F.min("pos").alias("pos"))
    first = once.withColumn("place", F.row_number().over(Window.partitionBy("corp").orderBy("pos", "receipt"))).where(F.col("place") <= most)
    held = files.groupBy("corp", "receipt").agg(F.bool_or(F.col("name") == BODY).alias("body"), F.bool_or(F.col("name") == DOCUMENT).alias("document"))
    state = F.when(F.col("body") & F.col("document"), "cached").when(F.col("body"), "pdf_only").otherwise("fetch")
    return first.join(held, ["corp", "receipt"], "left").select("corp", "receipt", state.alias("state"), "place")


def companies(codes: DataFrame, stocks: DataFrame, defaults: DataFrame, known: DataFrame, register: DataFrame) -> DataFrame:
    """SRC24: (place, corp, stock, name, isin) of the companies asked for: explicit codes first, then stock codes, each company once.

    ``codes`` (pos, corp) and ``stocks`` (pos, stock) are what was asked for; ``defaults`` (corp, stock, name, isin) are known by heart; ``known`` (corp, stock, name) tells the rest of the
    codes, ``register`` (stock, corp, name) of the stock codes. A code nobody knows stays with the name "?"; a stock code nobody knows is left out. Nothing asked for means all defaults.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    own = defaults.select("corp", F.col("stock").alias("_stock"), F.col("name").alias("_name"), F.col("isin").alias("_isin"))
    a = codes.where(F.trim("corp") != "").select(F.lit(0).alias("kind"), "pos", F.trim("corp").alias("corp"))
    a = a.join(own, "corp", "left").join(known.select("corp", F.col("stock").alias("_s"), F.col("name").alias("_n")), "corp", "left")
    a = a.select("kind", "pos", "corp", blank(F.coalesce("_stock", "_s")).alias("stock"), F.coalesce("_name", "_n", F.lit("?")).alias("name"), blank(F.col("_isin")).alias("isin"))
    b = stocks.where(F.trim("stock") != "").select(F.lit(1).alias("kind"), "pos", F.trim("stock").alias("stock"))
    b = b.join(defaults.select("stock", F.col("corp").alias("_c"), F.col("name").alias("_n"), F.col("isin").alias("_isin")), "stock", "left").join(register.where("stock <> ''").select("stock", F.col("corp").alias("_c2"), F.col("name").alias("_n2")), "stock", "left")
    b = b.select("kind", "pos", F.coalesce("_c", "_c2").alias("corp"), "stock", F.coalesce("_n", "_n2", F.lit("?")).alias("name"), blank(F.col("_isin")).alias("isin")).where("corp <> ''")
    asked = codes.where(F.trim("corp") != "").limit(1).count() + stocks.where(F.trim("stock") != "").limit(1).count()
    rows = a.unionByName(b) if asked else defaults.select(F.lit(0).alias("kind"), F.row_number().over(Window.orderBy("corp")).alias("pos"), "corp", "stock", "name", "isin")  # a handful
    once = rows.groupBy("corp").agg(F.min(F.struct("kind", "pos", "stock", "name", "isin")).alias("r")).select("corp", "r.*")
    return once.withColumn("place", F.row_number().over(Window.orderBy("kind", "pos", "corp"))).select("place", "corp", "stock", "name", "isin")  # what a run was asked for: a short list


def catalogue(rows: DataFrame) -> DataFrame:
    """SRC25: cleaned endpoint rows (category, api, endpoint, name, url, required, optional): lists are split at commas without dashes and the signing key; ``callable`` rows have an address and a real endpoint."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    many = lambda c, *out: F.filter(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "-", *out))
    named = rows.where("category is not null")
    endpoint = text("endpoint")
    good = text("url").rlike("^https?://") & (endpoint != "") & ~endpoint.startswith("(") & ~endpoint.contains("외")
    return named.select(text("category").alias("category"), text("api").alias("api"), endpoint.alias("endpoint"), text("name").alias("name"), text("url").alias("url"), many("required", "crtfc_key").alias("required"), many("optional").alias("optional"), good.alias("callable"))


def endpoint_order(entries: DataFrame) -> DataFrame:
    """SRC26: callable endpoints of the disclosure categories with the ``turn`` in which they are asked: lists, companies, codes, then the rest."""
    turn = F.when(F.col("endpoint") == "list", 0).when(F.col("endpoint") == "company", 1).when(F.col("endpoint") == "corpCode", 2).otherwise(10)
    return entries.where(F.col("callable") & F.col("category").startswith("DS")).withColumn("turn", turn)


def page_state(code: Column, total: Column, per_page: Column, page: Column) -> Column:
    """SRC27: (status, more) of a page: "ok" while pages are left, "no_data" for code 97, "rc_<code>" for others; a page without a size holds 100."""
    fine = F.coalesce(code, F.lit("")) == "00"
    size = F.when(F.coalesce(per_page, F.lit(0)) > 0, per_page).otherwise(100)
    status = F.when(fine, "ok").when(code == "97", "no_data").otherwise(F.concat(F.lit("rc_"), F.coalesce(code, F.lit(""))))
    return F.struct(status.alias("status"), (fine & (F.coalesce(total, F.lit(0)) > 0) & (page * size < total)).alias("more"))


def receipt_pool(listed: DataFrame) -> DataFrame:
    """SRC28: (corp, receipt, place) of the key reports in list responses (corp, pos, receipt, report), each once, in the order in which they came."""
    rows = listed.where(F.coalesce("receipt", F.lit("")) != "").where(key_report(F.coalesce("report", F.lit(""))))
    once = rows.groupBy("corp", "receipt").agg(F.min("pos").alias("pos"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("corp").orderBy("pos", "receipt"))).select("corp", "receipt", "place")


def list_states(parents: DataFrame, files: DataFrame, responses: DataFrame) -> DataFrame:
    """SRC31: (parent, status, lists) of catalogue lists: "cached" where a file is there, else what the response (parent, http, body) tells: "http_<code>", "parse_error", "err_<code>" or "ok" with the number of lists; "pending" without one."""
    rows = parents.join(files.select("parent", F.lit(True).alias("_file")).distinct(), "parent", "left").join(responses, "parent", "left")
    many = F.from_json("body", "array<variant>")
    one = F.get_json_object("body", "$.err")
    broken = F.expr("try_parse_json(body)").isNull()
    status = F.when(F.col("_file"), "cached").when(F.col("http").isNull(), "pending").when(F.col("http") != 200, F.concat(F.lit("http_"), F.col("http").cast("string"))).when(broken, "parse_error").when(one != "", F.concat(F.lit("err_"), one)).otherwise("ok")
    out = rows.withColumn("status", status)
    return out.select("parent", "status", F.when(F.col("status") == "ok", F.when(F.trim("body").startswith("["), F.size(many)).otherwise(1)).alias("lists"))
