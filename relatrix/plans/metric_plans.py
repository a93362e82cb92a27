"""Queries over aggregations and windows (rows AGG, WIN, TOP, SET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import windows as W
from .registry import query

LABELS = ["click", "view", "purchase", "signup", "error"]
_LABEL_SQL = ", ".join(f"CAST(count(*) FILTER (WHERE label = '{x}') AS BIGINT) AS \"{x}\"" for x in LABELS)
STOCK = ["1-URGENT", "2-HIGH"]


def r6(c):
    return F.round(c, 6)


@query("SELECT corp, day, count(*) AS mentions, array_to_string(list_sort(list(doc_id)), ',') AS doc_ids FROM docs WHERE ts IS NOT NULL GROUP BY corp, day")
def agg1_mention_daily(read):
    return A.mention_daily(read("docs")).withColumn("doc_ids", F.array_join("doc_ids", ","))


@query(f"SELECT corp, day, {_LABEL_SQL} FROM docs GROUP BY corp, day")
def agg2_label_daily(read):
    return A.label_daily(read("docs"), LABELS)


@query("SELECT src, dst, type, min(day) AS first_day, max(day) AS last_day, max_by(doc_id, {'d': day, 'i': -doc_id}) AS latest_doc FROM facts GROUP BY src, dst, type".replace("{", "{"))
def agg4_agg5_edge_dates(read):
    return read("facts").groupBy("src", "dst", "type").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max_by("doc_id", F.struct("day", -F.col("doc_id"))).alias("latest_doc"))


_HOLDERS = """WITH n AS (SELECT corp, trim(holder) AS name, regexp_replace(trim(holder), '\\s|\\(Co\\)', '', 'g') AS key, stake, seq FROM stakes)
SELECT corp, key, name, round(stake, 6) AS stake FROM (SELECT *, row_number() OVER (PARTITION BY corp, key ORDER BY stake DESC NULLS LAST, seq) AS rn FROM n) WHERE rn = 1"""


@query(_HOLDERS)
def agg6_shareholders(read):
    return A.shareholders(read("stakes")).withColumn("stake", r6("stake"))


@query(f"""WITH h AS ({_HOLDERS.replace("WITH n AS", "WITH n2 AS").replace("FROM n)", "FROM n2)")}), r AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY coalesce(stake, 0) DESC, key) AS rn FROM h)
SELECT corp, key AS name, stake FROM r WHERE rn <= 2 UNION ALL SELECT corp, concat('외 ', CAST(count(*) AS VARCHAR), '인'), NULL FROM r WHERE rn > 2 GROUP BY corp""")
def agg7_top_and_rest(read):
    return A.top_and_rest(A.shareholders(read("stakes")), 2).withColumn("stake", r6("stake"))


_BEST = "SELECT corp, account, year, report, fs, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY corp, account, year, report ORDER BY CASE WHEN fs = 'CFS' THEN 0 ELSE 1 END, abs(value) DESC, seq) AS rn FROM metrics WHERE value IS NOT NULL) WHERE rn = 1"


@query(_BEST)
def agg8_best_row(read):
    return A.best_row(read("metrics"), ["corp", "account", "year", "report"])


@query("SELECT corp, account, year, fs, value FROM (SELECT *, row_number() OVER (PARTITION BY corp, account ORDER BY year DESC, CASE WHEN fs = 'CFS' THEN 0 ELSE 1 END, abs(value) DESC, seq) AS rn FROM metrics) WHERE rn = 1")
def agg9_headline(read):
    return A.headline(read("metrics"))


_QUARTERS = f"""WITH b AS ({_BEST}), w AS (SELECT corp, account, year, max(value) FILTER (WHERE report = '11013') AS q1, max(value) FILTER (WHERE report = '11012') AS q2,
max(value) FILTER (WHERE report = '11014') AS q3, max(value) FILTER (WHERE report = '11011') AS fy, CASE WHEN bool_or(fs = 'CFS') THEN 'CFS' ELSE 'OFS' END AS fs FROM b GROUP BY corp, account, year),
l AS (SELECT corp, account, year, fs, 'q1' AS quarter, q1 AS value FROM w UNION ALL SELECT corp, account, year, fs, 'q2', q2 FROM w UNION ALL SELECT corp, account, year, fs, 'q3', q3 FROM w
UNION ALL SELECT corp, account, year, fs, 'q4', CASE WHEN account IN ('1-URGENT', '2-HIGH') THEN fy ELSE fy - (q1 + q2 + q3) END FROM w)"""


@query(f"{_QUARTERS} SELECT corp, account, year, fs, quarter, value FROM l WHERE value IS NOT NULL")
def agg10_quarters(read):
    return A.quarters(read("metrics"), STOCK)


@query(f"""{_QUARTERS}, k AS (SELECT * FROM l WHERE value IS NOT NULL), y AS (SELECT *, coalesce(lag(value, 4) OVER w, lag(value, 1) OVER w) AS base FROM k WINDOW w AS (PARTITION BY corp, account ORDER BY year, quarter))
SELECT corp, account, year, quarter, value, base, round(CASE WHEN base <> 0 THEN CAST(value - base AS DOUBLE) / abs(base) * 100 END, 6) AS change FROM y""")
def win12_year_on_year(read):
    return W.year_on_year(A.quarters(read("metrics"), STOCK)).select("corp", "account", "year", "quarter", "value", "base", r6("change").alias("change"))


@query("""WITH p AS (SELECT *, strftime(day, '%Y-%m') AS month FROM prices)
SELECT corp, month, round(min_by(close, {'d': day, 's': seq}) FILTER (WHERE close IS NOT NULL), 6) AS open, round(max_by(close, {'d': day, 's': seq}) FILTER (WHERE close IS NOT NULL), 6) AS close, round(max(close), 6) AS high, round(min(close), 6) AS low,
round(avg(close), 9) AS mean, count(*) AS rows_, count(close) AS priced, CAST(sum(seq % 100) FILTER (WHERE seq % 5 > 0) AS BIGINT) AS volume, CAST(floor(avg(seq % 100) FILTER (WHERE seq % 5 > 0)) AS BIGINT) AS mean_volume, count(DISTINCT day) AS days FROM p GROUP BY corp, month HAVING count(close) > 0""")
def agg15_monthly_ohlc(read):
    rows = read("prices").withColumn("volume", F.when(F.col("seq") % 5 > 0, F.col("seq") % 100))
    return A.monthly_ohlc(rows).select("corp", "month", *[r6(c).alias(c) for c in ("open", "close", "high", "low")], F.round("mean", 9).alias("mean"), "rows_", "priced", "volume", "mean_volume", "days")


@query("""SELECT corp, round(max_by(close, {'d': day, 's': seq}), 6) AS last, round(avg(close), 4) AS mean, round(min(close), 6) AS low, round(max(close), 6) AS high, count(*) AS n, array_to_string(list(CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR) ORDER BY day, seq)[greatest(1, count(*) - 23):], ',') AS samples FROM prices WHERE close IS NOT NULL GROUP BY corp""")
def agg16_series_summary(read):
    return A.series_summary(read("prices")).select("corp", r6("last").alias("last"), F.round("mean", 4).alias("mean"), r6("low").alias("low"), r6("high").alias("high"), "n", F.expr("array_join(transform(samples, x -> cast(cast(round(x * 100) as bigint) as string)), ',')").alias("samples"))


@query("""WITH n AS (SELECT c_nationkey AS nation, list_sort(list(DISTINCT c_name)) AS a FROM customer GROUP BY c_nationkey)
SELECT nation, concat(array_to_string(a[1:5], ', '), CASE WHEN len(a) > 5 THEN concat(' 외 ', CAST(len(a) - 5 AS VARCHAR), '명') ELSE '' END) AS names FROM n""")
def agg17_names_and_rest(read):
    return A.names_and_rest(read("customer").withColumnRenamed("c_nationkey", "nation"), "nation", "c_name")


@query("SELECT conv_id, CAST(floor(turn / 3) AS BIGINT) AS bucket, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS content FROM conversations GROUP BY ALL")
def agg17_page_buckets(read):
    return A.page_buckets(read("conversations"), "conv_id", "turn", "text", 3).withColumn("content", F.md5("content"))


@query("""WITH e AS (SELECT DISTINCT year, report FROM metrics), h AS (SELECT corp, count(*) AS have FROM (SELECT DISTINCT corp, year, report FROM metrics) GROUP BY corp)
SELECT corp, have, round(have / CAST((SELECT count(*) FROM e) AS DOUBLE), 6) AS rate, CASE WHEN have / CAST((SELECT count(*) FROM e) AS DOUBLE) < 0.5 THEN 'FAIL' WHEN have / CAST((SELECT count(*) FROM e) AS DOUBLE) < 0.8 THEN 'WARN' ELSE 'PASS' END AS status FROM h""")
def agg19_coverage(read):
    m = read("metrics")
    return A.coverage(m, m.select("year", "report").distinct(), "corp", ["year", "report"]).withColumn("rate", r6("rate"))


@query("WITH c AS (SELECT CASE WHEN corp % 10 = 0 THEN 0 ELSE corp END AS corp, count(*) AS n FROM docs WHERE corp % 7 > 0 OR doc_id % 10 = 0 GROUP BY 1) SELECT corp, n FROM c WHERE n < 0.3 * (SELECT avg(n) FROM c) OR n > 3 * (SELECT avg(n) FROM c)")
def agg20_outliers(read):
    """Every tenth company counts as company 0, every seventh keeps a tenth of its rows."""
    rows = read("docs").where("corp % 7 > 0 or doc_id % 10 = 0").withColumn("corp", F.when(F.col("corp") % 10 == 0, 0).otherwise(F.col("corp")))
    return A.outliers(rows.groupBy("corp").agg(F.count("*").alias("n")))


@query("SELECT account, report, count(*) AS n, count(DISTINCT corp) AS corps FROM metrics GROUP BY account, report HAVING count(*) > 1")
def agg18_agg21_duplicates(read):
    return read("metrics").groupBy("account", "report").agg(F.count("*").alias("n"), F.count_distinct("corp").alias("corps")).where("n > 1")


@query("SELECT corp, count(*) AS n, count(close) AS priced, CAST(count(*) FILTER (WHERE close IS NULL) AS BIGINT) AS missing FROM prices GROUP BY corp")
def agg22_null_rates(read):
    return read("prices").groupBy("corp").agg(F.count("*").alias("n"), F.count("close").alias("priced"), F.count_if(F.col("close").isNull()).alias("missing"))


@query("SELECT fs, report, count(*) AS n, count(*) FILTER (WHERE fs NOT IN ('CFS', 'OFS')) AS unexpected FROM metrics GROUP BY fs, report")
def agg23_distribution(read):
    return read("metrics").groupBy("fs", "report").agg(F.count("*").alias("n"), F.count_if(~F.col("fs").isin("CFS", "OFS")).alias("unexpected"))


@query("""WITH g AS (SELECT DISTINCT l_suppkey AS grp, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), p AS (SELECT DISTINCT l_suppkey AS grp, l_partkey AS item FROM lineitem WHERE l_quantity > 25),
c AS (SELECT grp, count(*) FILTER (WHERE ig AND ip) AS tp, count(*) FILTER (WHERE ig IS NULL) AS fp, count(*) FILTER (WHERE ip IS NULL) AS fn FROM (SELECT coalesce(g.grp, p.grp) AS grp, CASE WHEN g.item IS NOT NULL THEN true END AS ig, CASE WHEN p.item IS NOT NULL THEN true END AS ip FROM g FULL OUTER JOIN p ON g.grp = p.grp AND g.item = p.item) GROUP BY grp)
SELECT grp, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall FROM c""")
def agg24_set4_prf(read):
    rows = read("lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("item"), "l_returnflag", "l_quantity")
    return A.prf(rows.where("l_returnflag = 'R'"), rows.where("l_quantity > 25"), "grp", "item").select("grp", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


_RANKS = "SELECT l_suppkey AS qid, l_partkey AS item, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey"


@query(f"""WITH r AS ({_RANKS}), e AS (SELECT DISTINCT l_suppkey AS qid, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40), w AS (SELECT qid, count(*) AS want FROM e GROUP BY qid),
h AS (SELECT r.qid, count(*) AS hits, min(rank) AS best, sum(1 / log2(rank + 1.0)) AS dcg FROM r JOIN e ON r.qid = e.qid AND r.item = e.item WHERE rank <= 10 GROUP BY r.qid)
SELECT w.qid, round(coalesce(hits / CAST(least(want, 10) AS DOUBLE), 0), 6) AS recall, round(coalesce(CAST(1 AS DOUBLE) / best, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(want, 10) + 1), lambda x: 1 / log2(x + 1.0))), 0), 6) AS ndcg FROM w LEFT JOIN h ON w.qid = h.qid""")
def agg25_retrieval_metrics(read):
    li = read("lineitem")
    from pyspark.sql import Window

    sums = li.groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("s"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "item")))
    expected = li.where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("item")).distinct()
    return A.retrieval_metrics(ranked, expected).select("qid", *[r6(c).alias(c) for c in ("recall", "mrr", "ndcg")])


@query("SELECT c_nationkey AS nation, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\", count(*) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def agg27_status_pivot(read):
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "nation")
    return A.pivot_counts(rows, "nation", "o_orderstatus", ["F", "O", "P"])


@query("SELECT corp, day, n, round(n / CAST(max(n) OVER (PARTITION BY corp) AS DOUBLE), 6) AS share FROM (SELECT corp, day, count(*) AS n FROM docs GROUP BY corp, day)")
def agg32_day_shares(read):
    from pyspark.sql import Window

    days = read("docs").groupBy("corp", "day").agg(F.count("*").alias("n"))
    return days.withColumn("share", r6(F.col("n") / F.max("n").over(Window.partitionBy("corp"))))


@query("SELECT corp, day, doc_id, rank FROM (SELECT corp, day, doc_id, CAST(row_number() OVER (PARTITION BY corp, day ORDER BY ts DESC, doc_id) AS INT) AS rank FROM docs) WHERE rank <= 2")
def win3_headlines(read):
    return W.top_per_group(read("docs"), ["corp", "day"], [F.desc("ts"), "doc_id"], 2).select("corp", "day", "doc_id", "rank")


@query("""SELECT corp, seq, round(close, 6) AS close, round(CASE WHEN seq % 6 = 0 THEN seq % 10 - 5 WHEN p <> 0 THEN (close - p) / p * 100 END, 4) AS change FROM (SELECT *, lag(close) OVER (PARTITION BY corp ORDER BY day, seq) AS p FROM (SELECT corp, day, seq, CASE WHEN seq % 11 = 0 THEN 0 ELSE close END AS close FROM prices) WHERE close IS NOT NULL)""")
def win4_change(read):
    """Some rows bring a change of their own, some closes are zero."""
    rows = read("prices").withColumn("close", F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.col("close"))).withColumn("given", F.when(F.col("seq") % 6 == 0, (F.col("seq") % 10 - 5).cast("double")))
    return W.change_from_previous(rows).select("corp", "seq", r6("close").alias("close"), F.round("change", 4).alias("change"))


@query("""WITH q AS (SELECT corp, day, seq, CASE WHEN seq % 11 = 0 THEN 0 ELSE close END AS close, CASE WHEN seq % 2 = 0 THEN 0.03 ELSE -2.5 END AS share FROM prices WHERE NOT (corp % 5 = 0 AND day < DATE '2024-01-20')), b AS (SELECT * FROM q WHERE day >= DATE '2024-01-20'), s AS (SELECT corp, max_by(close, {'d': day, 's': seq}) AS seed FROM q WHERE day < DATE '2024-01-20' AND close IS NOT NULL AND close <> 0 AND corp IN (SELECT corp FROM b) GROUP BY corp),
l AS (SELECT b.corp, b.seq, b.close, b.share, coalesce(lag(b.close) OVER (PARTITION BY b.corp ORDER BY b.day, b.seq), s.seed) AS p FROM b LEFT JOIN s ON b.corp = s.corp WHERE b.close IS NOT NULL AND b.close <> 0)
SELECT corp, seq, round(CASE WHEN p <> 0 THEN (close - p) / p * 100 WHEN abs(share) < 1 THEN share * 100 ELSE share END, 4) AS change FROM l""")
def win5_incremental_change(read):
    """Every fifth company has nothing stored, so its first change is the source's own."""
    p = read("prices").where("not (corp % 5 = 0 and day < date'2024-01-20')").withColumn("close", F.when(F.col("seq") % 11 == 0, 0.0).otherwise(F.col("close"))).withColumn("share", F.when(F.col("seq") % 2 == 0, 0.03).otherwise(-2.5))
    cut = F.lit("2024-01-20").cast("date")
    return W.incremental_change(p.where(F.col("day") < cut), p.where(F.col("day") >= cut)).select("corp", "seq", F.round("change", 4).alias("change"))


@query("""SELECT corp, array_to_string(list(CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR) ORDER BY day, seq), ',') AS line FROM (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY day DESC, seq DESC) AS rn FROM prices WHERE close IS NOT NULL) WHERE rn <= 30 GROUP BY corp""")
def win6_spark_line(read):
    return W.spark_line(read("prices")).select("corp", F.expr("array_join(transform(line, x -> cast(cast(round(x * 100) as bigint) as string)), ',')").alias("line"))


_RUNS = "SELECT src AS corp, year(day) AS run_ts, type, dst FROM facts"


@query(f"""WITH s AS ({_RUNS}), r AS (SELECT corp, run_ts, dense_rank() OVER (PARTITION BY corp ORDER BY run_ts DESC) AS age FROM (SELECT DISTINCT corp, run_ts FROM s)),
t AS (SELECT s.*, age FROM s JOIN r USING (corp, run_ts)) SELECT DISTINCT corp, type, dst FROM t WHERE age = 2 EXCEPT SELECT corp, type, dst FROM t WHERE age = 1""")
def win9_set3_dropped(read):
    rows = read("facts").select(F.col("src").alias("corp"), F.year("day").alias("run_ts"), "type", "dst")
    return W.dropped_between_runs(rows, ["type", "dst"])


@query("""SELECT corp, account, year, report, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY corp, account, year ORDER BY CASE report WHEN '11011' THEN 4 WHEN '11014' THEN 3 WHEN '11012' THEN 2 WHEN '11013' THEN 1 ELSE 0 END DESC, seq) AS rn FROM metrics) WHERE rn = 1""")
def win10_report_priority(read):
    return W.by_report_priority(read("metrics"), ["corp", "account", "year"])


@query("""SELECT conv_id, turn, CAST(held AS BIGINT) AS held FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS held FROM conversations) WHERE held <= 600""")
def win15_budget(read):
    rows = read("conversations").withColumn("size", F.length("text"))
    return W.within_budget(rows, "conv_id", ["turn"], "size", 600).select("conv_id", "turn", F.col("held").cast("long").alias("held"))


@query("""SELECT src, dst, grp, CAST(rank AS INT) AS rank, CAST(floor((rank - 1) / 8) AS INT) AS ring, round((rank - 1) * 2 * pi() / n, 6) AS angle FROM (SELECT src, dst, type AS grp, row_number() OVER w AS rank, count(*) OVER (PARTITION BY src, type) AS n FROM edges WHERE extracted_by IS NOT NULL WINDOW w AS (PARTITION BY src, type ORDER BY evidence_count DESC, dst))""")
def win18_layout(read):
    rows = read("edges").where("extracted_by is not null").select("src", "dst", F.col("type").alias("grp"), F.col("evidence_count").alias("weight"))
    return W.ring_layout(rows).select("src", "dst", "grp", "rank", "ring", r6("angle").alias("angle"))


@query("SELECT src, dst, type, evidence_count FROM edges WHERE extracted_by IS NOT NULL ORDER BY evidence_count DESC, src, dst, type LIMIT 25")
def top1_top4_relations(read):
    return read("edges").where("extracted_by is not null").orderBy(F.desc("evidence_count"), "src", "dst", "type").limit(25).select("src", "dst", "type", "evidence_count")


@query("SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges WHERE type = 'SUPPLIES' UNION SELECT src, dst FROM edges WHERE type = 'INVESTS_IN')")
def set1_union(read):
    e = read("edges")
    return e.where("type = 'SUPPLIES'").select("src", "dst").union(e.where("type = 'INVESTS_IN'").select("src", "dst")).distinct()


@query("SELECT c_custkey AS id, 'no_orders' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_custkey, 'no_customer' FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def set7_jon13_membership(read):
    c, o = read("customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    known = c.where("c_mktsegment <> 'BUILDING'")
    return c.select("id").join(o, "id", "left_anti").withColumn("kind", F.lit("no_orders")).unionByName(o.join(known, "id", "left_anti").withColumn("kind", F.lit("no_customer")))


@query("SELECT a.corp AS a, b.corp AS b, a.account, a.year, count(*) AS n FROM (SELECT DISTINCT corp, account, year FROM metrics) a JOIN (SELECT DISTINCT corp, account, year FROM metrics) b ON a.account = b.account AND a.year = b.year AND a.corp < b.corp GROUP BY ALL")
def jon19_comparable(read):
    m = read("metrics").select("corp", "account", "year").distinct()
    b = m.select(F.col("corp").alias("b"), "account", "year")
    return m.withColumnRenamed("corp", "a").join(b, ["account", "year"]).where("a < b").groupBy("a", "b", "account", "year").agg(F.count("*").alias("n"))


del S
