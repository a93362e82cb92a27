"""Queries over joins of several stores, evaluation, small windows, sets and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import lookups as L
from ..operators import windows as W
from .registry import by_case, query, sql_case


@query("SELECT corp, day, count(*) FILTER (WHERE l = 'pos') AS pos, count(*) FILTER (WHERE l = 'neg') AS neg, count(*) FILTER (WHERE l = 'neu') AS neu FROM (SELECT corp, day, CASE doc_id % 3 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' ELSE 'neu' END AS l FROM docs WHERE doc_id % 4 <> 0) GROUP BY corp, day")
def jon1_snk3_str8_sentiment(read):
    k = F.col("doc_id")
    moods = read("docs").where(k % 4 != 0).select("doc_id", F.when(k % 3 == 0, "pos").when(k % 3 == 1, "neg").otherwise("neu").alias("mood"))
    fresh = A.label_daily(read("docs").join(moods, "doc_id").withColumn("label", F.col("mood")), ["pos", "neg", "neu"])
    return L.rebuilt(fresh.limit(0), fresh)


@query("SELECT l.doc_id, l.quality, length(d.text) AS chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id AND l.quality = CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END")
def jon5_composite(read):
    d = read("documents").select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("quality"), F.length("text").cast("long").alias("chars"))
    return read("labels").select("doc_id", "quality").join(d, ["doc_id", "quality"])


@query("SELECT l_suppkey AS edge, o_orderkey AS doc_id, o_orderstatus AS status FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem WHERE l_quantity > 45) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def jon7_jon15_documents(read):
    edges = read("lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("edge")).agg(F.collect_set("l_orderkey").alias("doc_ids"))
    docs = read("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    return L.documents_of(edges, docs).select("edge", "doc_id", "status")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN concat('a', CAST(doc_id AS VARCHAR)) ELSE concat('b', CAST(doc_id AS VARCHAR)) END AS title, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS store FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def jon8_first_found(read):
    k = F.col("doc_id")
    ids = read("documents").select(k.alias("id")).distinct()
    of = lambda n, p: read("documents").where(k % n == 0).select(k.alias("id"), F.concat(F.lit(p), k.cast("string")).alias("title"))
    return L.first_found(ids, "id", of(3, "a"), of(2, "b"), ["title"])


@query("SELECT dst AS centre, src AS other, CASE type WHEN 'SUPPLIES' THEN 'supplier' ELSE 'investor' END AS role FROM edges WHERE type IN ('SUPPLIES', 'INVESTS_IN')")
def jon10_roles(read):
    return L.related(read("edges"), {"SUPPLIES": "supplier", "INVESTS_IN": "investor"})


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 15 THEN n_name ELSE concat('patch ', n_name) END AS name FROM nation")
def jon26_patched(read):
    n = read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return L.patched(n.where("id < 15"), n.where("id >= 10").withColumn("name", F.concat(F.lit("patch "), "name")), ["id"])


_VIEW = "SELECT src, dst, type AS grp, CAST(evidence_count AS DOUBLE) AS weight FROM edges WHERE type IN ('SUPPLIES', 'COMPETES_WITH') AND evidence_count >= {n}"


@query(f"WITH v AS ({_VIEW.format(n=4)}) SELECT DISTINCT node FROM (SELECT src AS node FROM v UNION ALL SELECT dst FROM v UNION ALL SELECT 'N0')")
def fil23_view_nodes(read):
    e = read("edges").select("src", "dst", F.col("type").alias("grp"), F.col("evidence_count").cast("double").alias("weight"))
    nodes = e.select(F.col("src").alias("node")).union(e.select(F.col("dst").alias("node"))).union(read("region").limit(1).select(F.lit("N0"))).distinct()
    return L.linked_only(nodes, e, read("region").limit(1).select(F.lit("N0").alias("node")), ["SUPPLIES", "COMPETES_WITH"], 4.0)[0]


_LINKS = "SELECT DISTINCT l_orderkey AS chunk, CASE l_suppkey % 5 WHEN 0 THEN 'org' WHEN 1 THEN 'person' WHEN 2 THEN 'product' WHEN 3 THEN 'fact' ELSE 'event' END AS kind, concat('E', CAST(l_suppkey AS VARCHAR)) AS item FROM lineitem WHERE l_orderkey % 3 > 0"


@query(f"""WITH l AS ({_LINKS}), r AS (SELECT *, row_number() OVER (PARTITION BY chunk, kind ORDER BY item) AS rn FROM l), g AS (SELECT chunk, string_agg(concat(item, '(', item, ')'), ', ' ORDER BY item) FILTER (WHERE kind = 'org') AS o, string_agg(item, ', ' ORDER BY item) FILTER (WHERE kind = 'person') AS p,
string_agg(concat(item, '(None)'), ', ' ORDER BY item) FILTER (WHERE kind = 'product') AS q, string_agg(concat('  fact: ', item, ' -[SUPPLIES]-> E0 (conf=0.50)'), chr(10) ORDER BY item) FILTER (WHERE kind = 'fact') AS f,
string_agg(concat('  event: MERGED_WITH @ 1999 — ', item), chr(10) ORDER BY item) FILTER (WHERE kind = 'event') AS e FROM r WHERE rn <= 2 GROUP BY chunk)
SELECT o_orderkey AS chunk, concat_ws(chr(10), concat('[chunk:', CAST(o_orderkey AS VARCHAR), ']'), '  관련 회사: ' || o, '  관련 인물: ' || p, '  제품: ' || q, f, e) AS block FROM orders LEFT JOIN g ON o_orderkey = chunk""")
def jon16_ret7_contexts(read):
    k, own, none = F.col("l_suppkey") % 5, F.concat(F.lit("E"), F.col("l_suppkey").cast("string")), F.lit(None).cast("string")
    kind = F.when(k == 0, "org").when(k == 1, "person").when(k == 2, "product").when(k == 3, "fact").otherwise("event")
    item = L.context_item(kind, name=own, code=own, category=none, subject=own, predicate=F.lit("SUPPLIES"), target=F.lit("E0"), confidence=F.lit(0.5), event=F.lit("MERGED_WITH"), day=F.lit("1999"), label=own)
    links = read("lineitem").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("chunk"), kind.alias("kind"), item.alias("item"), own.alias("pos")).distinct()
    return L.context_block(L.contexts(read("orders").select(F.col("o_orderkey").alias("chunk")), links, 2))


#: A year only counts between characters that are no letters, so "2024년" gives none.
_ASKED = [("삼성전자 2024 매출은?", "00126380", 2024, True), ("SK하이닉스와 삼성전자 비교", "00126380,00164779", None, True), ("오늘 날씨 (2023)", "", 2023, False), ("하이닉스 12024", "", None, False), ("한미반도체vs삼성전자 2019년", "00126380,00161383", None, True), ("", "", None, False)]


@query(f"SELECT o_orderkey AS qid, {sql_case('o_orderkey', [b for _, b, _, _ in _ASKED])} AS codes, CAST({sql_case('o_orderkey', [c for _, _, c, _ in _ASKED])} AS INT) AS year, {sql_case('o_orderkey', [d for *_, d in _ASKED])} AS in_scope FROM orders")
def s36_jon22_ret6_signals(read):
    names = read("region").limit(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("code")) for a, b in (("삼성전자", "00126380"), ("SK하이닉스", "00164779"), ("한미반도체", "00161383"))])).alias("r")).select("r.*")
    asked = read("orders").select(F.col("o_orderkey").alias("qid"), by_case("o_orderkey", [a for a, *_ in _ASKED]).alias("query"))
    return L.query_signals(asked, names).select("qid", F.array_join("codes", ",").alias("codes"), "year", "in_scope")


_RANKED = "SELECT l_suppkey AS qid, l_partkey AS item, sum(l_quantity) AS score, CAST(l_suppkey % 4 AS INT) AS category, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey"


def _ranked(read):
    g = read("lineitem").groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("score"))
    return W.top_per_group(g, ["qid"], [F.desc("score"), "item"], 20).withColumn("category", (F.col("qid") % 4).cast("int"))


@query(f"WITH r AS (SELECT * FROM ({_RANKED}) WHERE rank <= 20 AND qid % 3 > 0), s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN category = 1 THEN score ELSE (item * 7919) % 1009 END DESC, rank) AS place FROM r) SELECT qid, item, CAST(place AS INT) AS place FROM s WHERE place <= 10")
def ret4_ret6_reranked(read):
    signals = read("supplier").select(F.col("s_suppkey").alias("qid"), (F.col("s_suppkey") % 3 > 0).alias("in_scope"))
    rows = L.gated(_ranked(read), signals)
    scores = rows.select("qid", "item", ((F.col("item") * 7919) % 1009).cast("double").alias("second"))
    return L.reranked(rows, scores, 10, F.col("category") == 1).select("qid", "item", "place")


@query(f"""WITH g AS (SELECT qid, category, category = 3 AS none, CAST(count(*) FILTER (WHERE item % 10 < 9 - category) AS DOUBLE) / count(*) AS recall, CASE WHEN category = 3 THEN 0.4 ELSE 0.9 END AS top FROM (SELECT * FROM ({_RANKED}) WHERE rank <= 20) GROUP BY qid, category),
c AS (SELECT category, count(*) AS n, round(avg(recall), 6) AS recall, CASE WHEN bool_and(none) THEN avg(top) < 0.5 ELSE avg(recall) >= 0.85 END AS passed FROM g GROUP BY category) SELECT category, n, recall, passed, (SELECT bool_and(passed) FROM c WHERE category <> 2) AS overall FROM c""")
def agg26_gates(read):
    g = _ranked(read).groupBy("qid", "category").agg((F.count_if(F.col("item") % 10 < 9 - F.col("category")) / F.count("*")).alias("recall"))
    g = g.withColumns({"no_answer": F.col("category") == 3, "mrr": F.lit(1.0), "ndcg": F.lit(1.0), "top_score": F.when(F.col("category") == 3, 0.4).otherwise(0.9)})
    return L.category_gates(g, excluded=(2,)).select("category", "n", F.round("recall", 6).alias("recall"), "passed", "overall")


@query("SELECT stage, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM (SELECT CASE WHEN p_size < 10 THEN 'alias' WHEN p_size < 30 THEN 'vector' ELSE 'unlinked' END AS stage FROM part) GROUP BY stage")
def agg29_stages(read):
    stage = F.when(F.col("p_size") < 10, "alias").when(F.col("p_size") < 30, "vector").otherwise("unlinked")
    return L.stage_counts(read("part").select(stage.alias("stage"))).withColumn("share", F.round("share", 6))


@query("WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 5 > 0), g AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 7 > 0) SELECT (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM g) AS got, (SELECT count(*) FROM w WHERE k NOT IN (SELECT k FROM g)) AS missing, (SELECT count(*) FROM g WHERE k NOT IN (SELECT k FROM w)) AS unasked")
def agg30_missing(read):
    return L.missing(read("orders").select(F.col("o_orderkey").alias("k")).where("k % 5 > 0"), read("lineitem").select(F.col("l_orderkey").alias("k")).where("k % 7 > 0"), "k")


@query("""SELECT corp, account AS indicator, max(value) FILTER (WHERE year = 1996) AS "1996", max(value) FILTER (WHERE year = 1997) AS "1997", max(value) FILTER (WHERE year = 2000) AS "2000" FROM metrics GROUP BY corp, account""")
def agg31_pivot(read):
    return L.pivot_periods(read("metrics").select("corp", F.col("account").alias("indicator"), F.col("year").cast("string").alias("period"), "value"), ["1996", "1997", "2000"])


@query("""WITH r AS (SELECT l_suppkey % 20 AS grp, count(*) FILTER (WHERE l_quantity > 20 AND l_discount > 0.04) AS tp, count(*) FILTER (WHERE l_quantity > 20 AND l_discount <= 0.04 AND l_suppkey % 20 > 2) AS fp, count(*) FILTER (WHERE l_quantity <= 20 AND l_discount > 0.04 AND l_suppkey % 20 > 1) AS fn FROM lineitem GROUP BY 1),
x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS r FROM r)
SELECT round(sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE), 6) AS micro_p, round(sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE), 6) AS micro_r, round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1, round(avg(CASE WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact FROM x""")
def agg24_averages(read):
    q, d, g = F.col("l_quantity") > 20, F.col("l_discount") > 0.04, F.col("l_suppkey") % 20
    rows = read("lineitem").groupBy(g.alias("grp")).agg(F.count_if(q & d).alias("tp"), F.count_if(q & ~d & (g > 2)).alias("fp"), F.count_if(~q & d & (g > 1)).alias("fn"))
    return L.merged_shares(rows).select(*[F.round(c, 6).alias(c) for c in ("micro_p", "micro_r", "macro_p", "macro_r", "macro_f1", "exact")])


@query("""WITH d AS (SELECT corp, day, count(*) AS mentions FROM docs GROUP BY corp, day), l AS (SELECT corp, max(day) AS day FROM d GROUP BY corp), r AS (SELECT docs.corp, docs.day, d.mentions, doc_id, row_number() OVER (PARTITION BY docs.corp ORDER BY ts DESC, doc_id) AS rank FROM docs JOIN l ON docs.corp = l.corp AND docs.day = l.day JOIN d ON d.corp = l.corp AND d.day = l.day)
SELECT corp, day, mentions, doc_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2""")
def win8_latest(read):
    d = read("docs")
    return L.latest_with(A.mention_daily(d).select("corp", "day", "mentions"), d.drop("label"), 2)


@query("""SELECT code, id, value FROM (SELECT p_brand AS code, p_partkey AS id, p_retailprice AS value, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(CASE WHEN p_size > 5 THEN p_size END, 0) DESC, p_partkey) AS rn FROM part WHERE p_partkey % 3 > 0) WHERE rn = 1""")
def win11_representative(read):
    k = F.col("p_partkey")
    return L.representative(read("part").select(F.col("p_brand").alias("code"), k.alias("id"), F.when(k % 3 > 0, F.col("p_retailprice")).alias("value"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("total_rows")), "code").select("code", "id", "value")


@query("""SELECT corp, CAST(sum(CASE WHEN rn <= 8 THEN seq ELSE 0 END) AS BIGINT) AS recent, count(*) FILTER (WHERE rn <= 8) AS n FROM (SELECT corp, seq, row_number() OVER (PARTITION BY corp ORDER BY seq DESC) AS rn FROM metrics) GROUP BY corp""")
def win13_recent(read):
    rows = W.top_per_group(read("metrics"), ["corp"], [F.desc("seq")], 12).groupBy("corp").agg(F.array_sort(F.collect_list("seq")).alias("a"))
    last = L.upside(F.col("a"), 8)
    return rows.select("corp", F.aggregate(last, F.lit(0).cast("long"), lambda s, x: s + x).alias("recent"), F.size(last).cast("long").alias("n"))


@query("""SELECT dst, grp, CAST(evidence_count AS DOUBLE) AS weight, CAST(rank AS INT) AS rank FROM (SELECT dst, coalesce(CASE type WHEN 'COMPETES_WITH' THEN 'compete' WHEN 'SUPPLIES' THEN 'supply' WHEN 'INVESTS_IN' THEN 'invest' END, 'partner') AS grp, evidence_count, row_number() OVER (ORDER BY evidence_count DESC, dst, type) AS rank FROM edges WHERE src = 'N1' AND extracted_by IS NOT NULL) WHERE rank <= 6""")
def top2_relations(read):
    from ..operators.graph import group_of

    rows = read("edges").where("src = 'N1' and extracted_by is not null").withColumn("centre", F.col("src"))
    return W.top_per_group(rows, ["centre"], [F.desc("evidence_count"), "dst", "type"], 6).select("dst", group_of(F.col("type"), "partner").alias("grp"), F.col("evidence_count").cast("double").alias("weight"), "rank")


@query("""SELECT corp, doc_id, day, CAST(rank AS INT) AS rank FROM (SELECT corp, doc_id, d AS day, row_number() OVER (PARTITION BY corp ORDER BY d DESC, doc_id) AS rank FROM (SELECT corp, doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS d FROM docs)) WHERE rank <= 40""")
def top3_top5_activity(read):
    day = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.date_format("day", "yyyy-MM-dd"))
    return W.top_per_group(read("docs").select("corp", "doc_id", day.alias("day")), ["corp"], [F.desc("day"), "doc_id"], 40).select("corp", "doc_id", "day", "rank")


@query("""SELECT corp, CAST(row_number() OVER (PARTITION BY corp ORDER BY year, CASE report WHEN '11013' THEN 1 WHEN '11012' THEN 2 WHEN '11014' THEN 3 ELSE 4 END, account, seq) AS INT) AS place, seq FROM metrics""")
def top6_order(read):
    from pyspark.sql import Window

    from ..functions.scalars import REPORT_QUARTER

    quarter = F.coalesce(*[F.when(F.col("report") == c, F.lit(q)) for c, q in REPORT_QUARTER.items()])
    return read("metrics").select("corp", F.row_number().over(Window.partitionBy("corp").orderBy("year", quarter, "account", "seq")).alias("place"), "seq")


@query("SELECT doc_id, 'news' AS kind FROM docs WHERE label = 'click' UNION ALL SELECT o_orderkey, 'filing' FROM orders WHERE o_orderstatus = 'F'")
def set2_concatenated(read):
    filings = read("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.lit("filing").alias("kind"))
    return read("docs").where("label = 'click'").select("doc_id", F.lit("news").alias("kind")).unionByName(filings)


@query("""SELECT grp, string_agg(item, ',' ORDER BY pos, item) AS items FROM (SELECT l_orderkey AS grp, l_returnflag AS item, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL) GROUP BY grp""")
def set6_ordered_distinct(read):
    rows = read("lineitem").groupBy(F.col("l_orderkey").alias("grp")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("a"))
    return rows.select("grp", F.array_join(L.ordered_distinct(F.expr("transform(a, x -> x.l_returnflag)")), ",").alias("items"))


@query("SELECT corp, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS latest FROM docs GROUP BY corp")
def agg3_latest(read):
    return read("docs").groupBy("corp").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id > 100")
def str3_resume(read):
    return L.resume_after(read("documents").withColumn("key", F.lpad(F.col("doc_id").cast("string"), 12, "0")), "key", "000000000100").select("doc_id", "n_chars")


@query("SELECT s_suppkey AS corp, y AS year, r AS report FROM supplier, (SELECT unnest(['2023', '2024']) AS y), (SELECT unnest(['11011', '11012', '11013']) AS r)")
def src10_src29_fan_out(read):
    one = read("region").limit(1)
    many = lambda name, *xs: one.select(F.explode(F.array(*[F.lit(x) for x in xs])).alias(name))
    return L.fan_out(read("supplier").select(F.col("s_suppkey").alias("corp")), many("year", "2023", "2024"), many("report", "11011", "11012", "11013"))


@query("SELECT o_orderkey AS edge, CAST(o_custkey AS VARCHAR) AS dst, CASE WHEN o_custkey % 3 = 0 THEN 'Organization' ELSE 'Person' END AS kind FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0)")
def snk10_known_ends(read):
    ids = lambda n: read("customer").where(F.col("c_custkey") % n == 0).select(F.col("c_custkey").cast("string").alias("id"))
    return L.known_ends(read("orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").cast("string").alias("dst")), ids(3), ids(2)).select("edge", "dst", "kind")


@query("SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linestatus = 'F' THEN 'ready' WHEN l_returnflag = 'R' THEN 'ready' ELSE 'pending' END AS status, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, 'none') AS body FROM lineitem")
def snk12_snk23_updates(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("run"), F.when(F.col("l_returnflag") == "R", "ready").otherwise("pending").alias("status"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("body"))
    return L.filled_where_null(L.marked_ready(rows, "F"), "body", F.lit("none")).select("id", "line", "status", "body")


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '{"needs_rule":true}' ELSE concat('{"k":', json_extract_string(props, '$.k'), CASE WHEN event_id % 3 = 2 THEN ',"b":{"c":2},"e":[1,null,"x"]' ELSE '' END, ',"needs_rule":true}') END AS meta FROM events""")
def snk18_flagged(read):
    meta = F.when(F.col("event_id") % 3 == 1, F.col("props")).when(F.col("event_id") % 3 == 2, F.regexp_replace("props", r"\}$", ', "needs_rule": "false", "b": {"c": 2}, "e": [1, null, "x"]}')).otherwise(F.when(F.col("event_id") % 2 == 0, "{broken"))
    out = L.flagged(meta, "needs_rule", "true")
    return read("events").select(F.col("event_id").alias("id"), out.alias("meta"))


@query("SELECT doc_id, CASE WHEN source LIKE '%1%' THEN 'one' ELSE source END AS publisher, CASE WHEN source LIKE '%1%' THEN 'economy' ELSE '' END AS category FROM documents")
def snk25_feeds(read):
    table = read("documents").where("source like '%1%'").select(F.col("source").alias("feed"), F.lit("one").alias("publisher"), F.lit("economy").alias("category")).distinct()
    return L.feeds(read("documents").select("doc_id", F.col("source").alias("feed")), table).select("doc_id", "publisher", "category")


_NEAR = [(("Infineon", "Infineon Inc.", 0.56, 0.55), "canonical"), (("Infineon", "Infineon Inc.", 0.54, None), None), (("Luxshare", "Luxshare ICT", 0.71, 0.69), None), (("Luxshare", "Luxshare ICT", 0.71, 0.67), "margin"), (("Luxshare", "Luxshare ICT", 0.70, None), "margin"), (("Sony", "Sonus", 0.69, None), None)]


@query(f"WITH r AS (SELECT o_orderkey AS id, {sql_case('o_orderkey', [b for _, b in _NEAR])} AS rule FROM orders) SELECT id, rule FROM r WHERE rule IS NOT NULL")
def ent3_canonical_match(read):
    """Every row is a mention of its own: its number stands before both names."""
    a, b, s, t = (by_case("o_orderkey", [r[i] for r, _ in _NEAR]) for i in range(4))
    own = lambda name: F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), name)
    rows = read("orders").select(F.col("o_orderkey").alias("id"), own(a).alias("surface"), own(b).alias("name"), s.alias("s"), t.alias("t"))
    first = rows.select("surface", F.col("id").alias("entity"), "name", F.col("s").alias("score"), F.lit(1).alias("rank"))
    second = rows.where("t is not null").select("surface", F.lit(-1).cast("long").alias("entity"), F.lit("x").alias("name"), F.col("t").alias("score"), F.lit(2).alias("rank"))
    return L.canonical_match(rows.select("surface"), first.unionByName(second)).select(F.col("entity").alias("id"), "rule")
