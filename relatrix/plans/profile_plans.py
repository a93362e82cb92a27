"""Queries over whole profiles and details, scenarios over several layers, and targets of entity resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import profiles as P
from ..operators import scenario as N
from ..session import written
from .registry import query
from .semantic_plans import _REC, _frames
from .text_plans import _COS

_ACCOUNTS = {"1-URGENT": "매출액", "3-MEDIUM": "영업이익", "2-HIGH": "순이익"}
_SIZE = "CASE account WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 1000000 ELSE 100000000 END"


def _said(c: str, *fields: Column) -> Column:
    return F.array_join(F.transform(F.col(c), lambda x: F.concat_ws("|", *(f(x) for f in fields))), ";").alias(c)


def _cents(field: str):
    return lambda x: F.round(x[field] * 100).cast("bigint").cast("string")


def _field(field: str):
    return lambda x: x[field].cast("string")


_C = "concat('C', CAST({} % 40 AS VARCHAR))"


@query(f"""WITH co AS (SELECT DISTINCT corp FROM metrics),
f AS (SELECT corp, account, value * {_SIZE} AS v, row_number() OVER (PARTITION BY corp, account ORDER BY year DESC, CASE WHEN fs = 'CFS' THEN 0 ELSE 1 END, abs(value) DESC, seq) AS rn FROM metrics WHERE report = '11011' AND account IN ('1-URGENT', '3-MEDIUM', '2-HIGH')),
fin AS (SELECT corp, string_agg(concat(CASE account WHEN '1-URGENT' THEN '매출액' WHEN '3-MEDIUM' THEN '영업이익' ELSE '순이익' END, '|', CASE WHEN v >= 1e12 THEN concat(printf('%.1f', v / 1e12), '조원') WHEN v >= 1e8 THEN concat(format('{{:,}}', CAST(round_even(v / 1e8, 0) AS BIGINT)), '억원') ELSE concat(format('{{:,}}', v), '원') END), ';' ORDER BY CASE account WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 2 END) AS finance FROM f WHERE rn = 1 GROUP BY corp),
x1 AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY seq, name) AS rn FROM (SELECT {_C.format('c_custkey')} AS corp, concat('P', CAST(c_custkey * 7 % 3001 AS VARCHAR)) AS name, min(c_custkey) AS seq, arg_min(c_mktsegment, c_custkey) AS position FROM customer WHERE c_custkey % 9 > 0 GROUP BY 1, 2)),
ex AS (SELECT corp, string_agg(concat(name, '|', position), ';' ORDER BY rn) AS executives FROM x1 WHERE rn <= 20 GROUP BY corp),
h AS (SELECT {_C.format('p_partkey')} AS corp, CASE p_partkey // 40 % 4 WHEN 0 THEN concat('Big ', CAST(p_partkey % 360 AS VARCHAR)) WHEN 1 THEN concat(p_brand, ' 투자조합') WHEN 2 THEN 'SEA-1' ELSE concat('Own ', p_brand) END AS name, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS stake FROM part),
ho AS (SELECT corp, name, max(stake) AS stake FROM h WHERE name LIKE 'Big %' OR name LIKE 'Own %' GROUP BY ALL), hr AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY coalesce(stake, 0) DESC, name) AS rn FROM ho),
hc AS (SELECT corp, count(*) FILTER (WHERE name = 'SEA-1') AS abroad, count(*) FILTER (WHERE name LIKE '%조합') AS fund FROM h GROUP BY corp),
su AS (SELECT hc.corp, concat_ws(';', (SELECT string_agg(concat_ws('|', name, CAST(CAST(round(stake * 100) AS BIGINT) AS VARCHAR)), ';' ORDER BY rn) FROM hr WHERE hr.corp = hc.corp AND rn <= 6), CASE WHEN abroad > 0 THEN concat('해외 출자법인 ', CAST(abroad AS VARCHAR), '건') END, CASE WHEN fund > 0 THEN concat('투자조합·펀드 ', CAST(fund AS VARCHAR), '건') END,
(SELECT CASE WHEN count(*) > 6 THEN concat('기타 출자 ', CAST(count(*) - 6 AS VARCHAR), '건') END FROM ho WHERE ho.corp = hc.corp)) AS subsidiaries FROM hc),
sh AS (SELECT corp, name, stake, row_number() OVER (PARTITION BY corp ORDER BY coalesce(stake, 0) DESC, name) AS rn, count(*) OVER (PARTITION BY corp) AS n FROM (SELECT corp, holder AS name, max(stake) AS stake FROM (SELECT {_C.format('s_suppkey')} AS corp, concat('Holder', CAST(s_suppkey // 40 % 9 AS VARCHAR)) AS holder, CASE WHEN s_suppkey % 11 > 0 THEN s_acctbal END AS stake FROM supplier) GROUP BY ALL)),
hs AS (SELECT corp, concat_ws(';', string_agg(concat_ws('|', name, CAST(CAST(round(stake * 100) AS BIGINT) AS VARCHAR)), ';' ORDER BY rn) FILTER (WHERE rn <= 6), CASE WHEN any_value(n) > 6 THEN concat('외 ', CAST(any_value(n) - 6 AS VARCHAR), '인 · 특수관계인') END) AS shareholders FROM sh GROUP BY corp),
p AS (SELECT {_C.format('user_id')} AS corp, CAST(ts AS DATE) AS day, max(CASE WHEN event_id % 3 > 0 THEN value END) AS close, min(value) AS change FROM events GROUP BY ALL), pr AS (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY day DESC) AS rn FROM p),
st AS (SELECT corp, concat_ws('|', CAST(CAST(round(max(close) FILTER (WHERE rn = 1) * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(max(change) FILTER (WHERE rn = 1) * 100) AS BIGINT) AS VARCHAR), CAST(max(day) AS VARCHAR), string_agg(CAST(CAST(round(close * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY day)) AS stock FROM pr WHERE rn <= 30 GROUP BY corp),
nw AS (SELECT corp, string_agg(concat_ws('|', CAST(doc_id AS VARCHAR), label, CAST(day AS VARCHAR)), ';' ORDER BY rn) AS news FROM (SELECT {_C.format('corp')} AS corp, doc_id, label, day, row_number() OVER (PARTITION BY corp % 40 ORDER BY ts DESC, doc_id) AS rn FROM docs) WHERE rn <= 10 GROUP BY corp),
ds AS (SELECT corp, string_agg(concat(target, '|', CAST(e AS VARCHAR)), ';' ORDER BY rn) AS disputes FROM (SELECT corp, target, e, row_number() OVER (PARTITION BY corp ORDER BY e DESC, target) AS rn FROM (SELECT {_C.format('l_suppkey')} AS corp, CASE WHEN l_suppkey % 13 = 0 THEN '불명' ELSE concat('T', CAST(l_suppkey AS VARCHAR)) END AS target, greatest(count(*) FILTER (WHERE l_quantity > 40), 1) AS e FROM lineitem GROUP BY l_suppkey)) WHERE rn <= 10 GROUP BY corp),
pd AS (SELECT corp, string_agg(name, ';' ORDER BY name) AS products FROM (SELECT *, row_number() OVER (PARTITION BY corp ORDER BY name) AS rn FROM (SELECT DISTINCT {_C.format('p_partkey')} AS corp, p_type AS name FROM part WHERE p_partkey % 40 > 1)) WHERE rn <= 15 GROUP BY corp)
SELECT corp, concat('Comp ', corp) AS name, concat('설립|19', corp[2:]) AS overview, coalesce(finance, '') AS finance, coalesce(executives, '') AS executives, coalesce(subsidiaries, '') AS subsidiaries, coalesce(products, '') AS products, coalesce(shareholders, '') AS shareholders, stock, coalesce(news, '') AS news, coalesce(disputes, '') AS disputes
FROM co LEFT JOIN fin USING (corp) LEFT JOIN ex USING (corp) LEFT JOIN su USING (corp) LEFT JOIN hs USING (corp) LEFT JOIN st USING (corp) LEFT JOIN nw USING (corp) LEFT JOIN ds USING (corp) LEFT JOIN pd USING (corp)""")
def gra5_company_profiles(read):
    c = lambda k: F.concat(F.lit("C"), (F.col(k) % 40).cast("string"))
    size = F.when(F.col("account") == "1-URGENT", 1).when(F.col("account") == "3-MEDIUM", 1_000_000).otherwise(100_000_000)
    metrics = read("metrics").withColumn("value", F.col("value") * size)
    companies = read("metrics").select("corp").distinct().select("corp", F.concat(F.lit("Comp "), "corp").alias("name"), F.lit("").alias("stock_code"), F.concat(F.lit("19"), F.substring("corp", 2, 9)).alias("founded"), F.lit(None).cast("string").alias("number"))
    executives = read("customer").where("c_custkey % 9 > 0").select(c("c_custkey").alias("corp"), F.concat(F.lit("P"), (F.col("c_custkey") * 7 % 3001).cast("string")).alias("name"), F.col("c_mktsegment").alias("position"), F.col("c_custkey").alias("seq"))
    k = F.floor(F.col("p_partkey") / 40) % 4
    name = F.when(k == 0, F.concat(F.lit(" Big "), (F.col("p_partkey") % 360).cast("string"))).when(k == 1, F.concat("p_brand", F.lit(" 투자조합"))).when(k == 2, "SEA-1").otherwise(F.concat(F.lit("Own "), "p_brand"))
    investments = read("part").select(c("p_partkey").alias("corp"), name.alias("name"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("stake"))
    products = read("part").where("p_partkey % 40 > 1").select(c("p_partkey").alias("corp"), F.col("p_type").alias("name"))
    holders = read("supplier").select(c("s_suppkey").alias("corp"), F.concat(F.lit("Holder"), (F.floor(F.col("s_suppkey") / 40) % 9).cast("string")).alias("holder"), F.when(F.col("s_suppkey") % 11 > 0, F.col("s_acctbal")).alias("stake"), F.col("s_suppkey").alias("seq"))
    holders = holders.unionByName(holders.select("corp", F.lit("합계").alias("holder"), "stake", "seq"))
    prices = read("events").groupBy(c("user_id").alias("corp"), F.to_date("ts").alias("day")).agg(F.max(F.when(F.col("event_id") % 3 > 0, F.col("value"))).alias("close"), F.min("value").alias("change"))
    disputes = read("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 40).alias("evidence_count")).select(c("l_suppkey").alias("corp"), F.when(F.col("l_suppkey") % 13 > 0, F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))).alias("target"), "evidence_count")
    documents = read("docs").select(c("corp").alias("corp"), "doc_id", "ts", F.col("label").alias("title"), F.lit(None).cast("string").alias("url"), "metadata")
    out = P.company_profiles(companies, metrics=metrics, executives=executives, investments=investments, products=products, shareholders=holders, prices=prices, disputes=disputes, documents=documents, accounts=_ACCOUNTS)
    return _profile_text(out)


def _profile_text(out):
    stock = F.concat_ws("|", F.round(F.col("stock.close") * 100).cast("bigint").cast("string"), F.round(F.col("stock.change") * 100).cast("bigint").cast("string"), F.col("stock.as_of").cast("string"), F.array_join(F.transform("stock.line", lambda x: F.round(x * 100).cast("bigint").cast("string")), ","))
    return out.select(
        "corp", "name", _said("overview", _field("label"), _field("value")), _said("finance", _field("label"), _field("value")), _said("executives", _field("name"), _field("position")), _said("subsidiaries", _field("name"), _cents("stake")),
        _said("products", _field("name")), _said("shareholders", _field("name"), _cents("stake")), F.when(F.col("stock").isNotNull(), stock).alias("stock"), _said("news", _field("doc_id"), _field("title"), _field("day")), _said("disputes", _field("target"), _field("evidence")),
    )


@query("""WITH pairs AS (SELECT DISTINCT src AS centre, dst AS node FROM facts WHERE doc_id % 3 = 0), fr AS (SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS node, concat('S', CAST(s_suppkey - s_suppkey % 2 AS VARCHAR)) AS fragment FROM supplier UNION SELECT concat('S', CAST(s_suppkey AS VARCHAR)), concat('S', CAST(s_suppkey AS VARCHAR)) FROM supplier),
pt AS (SELECT DISTINCT centre, pairs.node, fragment FROM pairs JOIN fr ON fr.node = pairs.node), e AS (SELECT src, dst, type, extracted_by, count(*) AS n, max(stake) AS stake FROM facts GROUP BY ALL), r AS (SELECT pt.centre, pt.node, CASE e.type WHEN 'COMPETES_WITH' THEN 'compete' WHEN 'SUPPLIES' THEN 'supply' ELSE 'invest' END AS grp, e.type, max(n) AS evidence, e.type <> 'COMPETES_WITH' AS directed, CASE WHEN bool_or(e.extracted_by IS NOT NULL) THEN 'news' ELSE 'filing' END AS source FROM pt JOIN e ON e.src = pt.centre AND e.dst = pt.fragment GROUP BY ALL),
d AS (SELECT DISTINCT pt.centre, pt.node, f.doc_id, o_orderdate AS ts FROM pt JOIN facts f ON f.src = pt.centre AND f.dst = pt.fragment JOIN orders ON o_orderkey = f.doc_id), k AS (SELECT *, row_number() OVER (PARTITION BY centre, node ORDER BY ts DESC, doc_id) AS rn FROM d)
SELECT pairs.centre, pairs.node, concat('Name ', pairs.node) AS name, CASE WHEN CAST(pairs.node[2:] AS INT) // 2 % 2 = 0 THEN 'org' ELSE 'news_entity' END AS kind, (SELECT string_agg(concat_ws('|', grp, type, CAST(evidence AS VARCHAR), CAST(directed AS VARCHAR), source), ';' ORDER BY grp, type) FROM r WHERE r.centre = pairs.centre AND r.node = pairs.node) AS relations,
(SELECT string_agg(concat_ws('|', CAST(doc_id AS VARCHAR), strftime(ts, '%Y-%m-%d')), ';' ORDER BY rn) FROM k WHERE k.centre = pairs.centre AND k.node = pairs.node AND rn <= 3) AS evidence, CASE WHEN CAST(pairs.node[2:] AS INT) // 2 % 2 = 0 THEN concat('S', CAST(CAST(pairs.node[2:] AS INT) // 2 * 2 AS VARCHAR)) END AS company FROM pairs""")
def gra3_node_details(read):
    """Every supplier of odd number is a fragment of the one before; those of a number divisible by four have a company's code."""
    facts = written(read("facts").select("src", "dst", "type", "extracted_by", "doc_id", "stake"), "facts")
    pairs = facts.where("doc_id % 3 = 0").select(F.col("src").alias("centre"), F.col("dst").alias("node"))
    edges = facts.groupBy("src", "dst", "type", "extracted_by").agg(F.count("*").alias("evidence_count"), F.max("stake").alias("stake"))
    k = F.col("s_suppkey")
    own = F.concat(F.lit("S"), k.cast("string"))
    s = read("supplier")
    fragments = s.select(own.alias("node"), F.concat(F.lit("S"), (k - k % 2).cast("string")).alias("fragment"))
    names = s.select(own.alias("node"), F.concat(F.lit("Name "), own).alias("name"), F.when(k % 4 == 0, own).alias("corp_code"))
    documents = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("ts"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("url"), F.col("o_orderpriority").alias("body"), F.lit("{broken").alias("metadata"))
    out = P.node_details(pairs, edges, documents, fragments, names, 3, facts)
    return out.select("centre", "node", "name", "kind", _said("relations", *(_field(f) for f in ("grp", "predicate", "evidence", "directed", "source"))), _said("evidence", _field("doc_id"), _field("day")), "company")


@query("""WITH d AS (SELECT s_suppkey AS k, concat('name ', CAST(s_suppkey AS VARCHAR)) AS name FROM supplier WHERE s_suppkey % 3 > 0), n AS (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT CASE WHEN coalesce(d.k, n.k) % 5 = 0 THEN lpad(CAST(coalesce(d.k, n.k) AS VARCHAR), 8, '0') ELSE concat('X', CAST(coalesce(d.k, n.k) AS VARCHAR)) END AS corp, CASE WHEN d.k IS NOT NULL THEN 'dictionary' ELSE 'graph' END AS source,
trim(concat(coalesce(d.name, n.s_name), ' ', CASE WHEN d.k IS NOT NULL THEN 'a b' ELSE 'g' END, ' ', CASE WHEN d.k % 4 = 0 THEN 'T1' ELSE '' END, ' ', CASE WHEN n.k IS NOT NULL THEN 'ksic1' ELSE '' END, ' ', CASE WHEN d.k IS NOT NULL THEN 'sub' ELSE '' END, ' ')) AS text, md5(concat('orgER:', CASE WHEN coalesce(d.k, n.k) % 5 = 0 THEN lpad(CAST(coalesce(d.k, n.k) AS VARCHAR), 8, '0') ELSE concat('X', CAST(coalesce(d.k, n.k) AS VARCHAR)) END)) AS point FROM d FULL JOIN n ON d.k = n.k""")
def ent9_targets(read):
    k = F.col("s_suppkey")
    own = F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit("X"), k.cast("string")))
    code = F.when(k % 5 == 0, F.lpad(k.cast("string"), 8, "0")).otherwise(own)
    words = lambda *x: F.array(*[F.lit(w) for w in x]).cast("array<string>")
    s = read("supplier")
    dictionary = s.where("s_suppkey % 3 > 0").select(own.alias("key"), F.concat(F.lit("name "), k.cast("string")).alias("name"), words("a", "b").alias("aliases"), F.when(k % 4 == 0, words("T1")).alias("tickers"), words("sub").alias("subsidiaries"))
    nodes = s.where("s_suppkey % 2 = 0").select(code.alias("corp"), F.col("s_name").alias("name"), words("g").alias("aliases"), F.lit("ksic1").alias("ksic"))
    return N.er_targets(dictionary, nodes).select("corp", "source", "text", F.replace(F.col("point"), F.lit("-"), F.lit("")).alias("point"))


@query(f"""WITH {_REC}, s AS (SELECT q.vec_id AS qid, v.vec_id, {_COS} AS score FROM vectors q CROSS JOIN vectors v WHERE q.vec_id % 50 = 0), h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s), top AS (SELECT qid, CAST(vec_id AS VARCHAR) AS chunk FROM h WHERE rank = 1 UNION ALL SELECT -1, NULL),
ev AS (SELECT DISTINCT chunk, type IN ('Organization', 'Person') AS actor, entity FROM t WHERE entity IS NOT NULL)
SELECT qid, chunk, least(5, (SELECT count(*) FROM ev WHERE ev.chunk = top.chunk AND actor)) AS actors, least(5, (SELECT count(*) FROM ev WHERE ev.chunk = top.chunk AND NOT actor)) AS objects, (SELECT count(*) FROM o WHERE o.chunk = top.chunk AND tier IN ('statement', 'event')) AS facts, (SELECT count(*) FROM o WHERE o.chunk = top.chunk AND tier = 'statement') AS statements, (SELECT count(*) FROM o WHERE o.chunk = top.chunk AND tier = 'statement' AND id[1:1] < 'c') AS with_activity,
(SELECT count(*) FROM o WHERE o.chunk = top.chunk AND tier = 'statement') = (SELECT count(*) FROM o WHERE o.chunk = top.chunk AND tier = 'statement' AND id[1:1] < 'c') AS provenance, CASE WHEN chunk IS NULL THEN 'no hit' WHEN (SELECT count(*) FROM ev WHERE ev.chunk = top.chunk) > 0 THEN 'good' ELSE 'weak' END AS quality FROM top""")
def ret8_scenarios(read):
    """A vector's number is an order's; a question without a vector has no hit; some statements have no activity."""
    v = read("vectors")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")).unionByName(v.limit(1).select(F.lit(-1).cast("long").alias("qid"), F.lit(None).cast("array<float>").alias("query")))
    chunks = v.select("vec_id", F.col("vec_id").cast("string").alias("chunk"), "embedding")
    hits = written(N.best_hits(asked, chunks, 3), "hits")
    f = _frames(read, hits.select("chunk"))
    out = N.scenarios(hits, f.evidence, f.statements, f.events, f.generated.where(F.substring("target_id", 1, 1) < "c"))
    return out.select("qid", "chunk", F.size("actors").cast("long").alias("actors"), F.size("objects").cast("long").alias("objects"), "facts", "statements", "with_activity", "provenance", "quality")


@query("""WITH c AS (SELECT n_nationkey % 4 AS scope, n_nationkey AS corp FROM nation), m AS (SELECT c_nationkey AS corp, count(*) AS n FROM customer WHERE c_nationkey % 4 <> 2 GROUP BY 1), s AS (SELECT scope, count(*) AS orgs, sum(coalesce(n, 0)) AS metrics FROM c LEFT JOIN m USING (corp) GROUP BY scope)
SELECT scope, 'I-03' AS "check", CASE WHEN orgs > 0 AND metrics > 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST((SELECT count(*) FROM c c2 LEFT JOIN m USING (corp) WHERE c2.scope = s.scope AND n IS NULL) AS BIGINT) AS bad, orgs AS total FROM s""")
def dia20_node_counts(read):
    companies = read("nation").select((F.col("n_nationkey") % 4).alias("scope"), F.col("n_nationkey").alias("corp"))
    metrics = read("customer").where("c_nationkey % 4 <> 2").select((F.col("c_nationkey") % 4).alias("scope"), F.col("c_nationkey").alias("corp"), F.col("c_custkey").alias("metric"))
    return D.node_counts(companies, metrics)
