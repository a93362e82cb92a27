"""Questions with known answers, made from chunks' own sentences, and their answers widened to all chunks of the same fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endpoints of accounts, auditors and executives, and how their sentences name what they are about.
ACCOUNTS, AUDIT, EXECUTIVES = "fnlttSinglAcntAll", "accnutAdtorNmNdAdtOpinion", "exctvSttus"
ACCOUNT, TREND, SECTION, PERSON = r"항목 '([^']+)'", r"(별도|연결)\s+(\S+)\s+3기 추이", r"'([^']+)' 섹션", r"임원\s+'([^']+)'"
UNDISCLOSED, DULL = "(공시되지", ("개요", "기타", "내용")


def sampled(rows: DataFrame, n: int, seed: str, *key: str) -> DataFrame:
    """TOP8: ``n`` rows in an order that looks random and is the same in every run: by a digest of seed and key, then key."""
    mixed = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key)))
    return rows.withColumn("_mix", mixed).orderBy("_mix", *key).limit(n).drop("_mix")


def _question(rows: DataFrame, category: str, text: Column) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), text.alias("query"), F.array("chunk").alias("chunks"), F.array("corp").alias("corps"), F.lit(False).alias("no_answer"))


def _named(chunks: DataFrame) -> DataFrame:
    """Account chunks that name their account."""
    rows = chunks.withColumn("account", F.regexp_extract("text", ACCOUNT, 1))
    return rows.where((F.col("endpoint") == ACCOUNTS) & (F.col("account") != "") & ~F.col("account").contains(UNDISCLOSED))


def account_questions(chunks: DataFrame, n: int, seed: str = "a") -> DataFrame:
    """TXT17: '{company} {year}년 {account}' from annual reports' sentences.

    ``chunks`` here and below: (chunk, corp, name, endpoint, variant, year, text), one row a chunk.
    """
    rows = _named(chunks).where(F.col("text").contains("사업보고서") & F.col("year").isNotNull())
    return _question(sampled(rows, n, seed, "chunk"), "정형수치", F.concat("name", F.lit(" "), F.col("year").cast("string"), F.lit("년 "), "account"))


def trend_questions(chunks: DataFrame, n: int, seed: str = "t") -> DataFrame:
    """TXT17: '{company} {account} 추이' from sentences that compare three periods."""
    rows = chunks.where("variant = 'comparison'").withColumn("account", F.regexp_extract("text", TREND, 2)).where("account <> ''")
    return _question(sampled(rows, n, seed, "chunk"), "시계열", F.concat("name", F.lit(" "), "account", F.lit(" 추이")))


def comparison_questions(chunks: DataFrame, n: int, years: tuple[int, ...], seed: str = "c") -> DataFrame:
    """TXT17: '{company} vs {company} {year}년 {account}' for one account of a year in two companies.

    Every company of a (year, account) stands for its first chunk and meets the next company, so k companies give k - 1 questions.
    """
    rows = _named(chunks).where((F.col("variant") == "full") & F.col("year").isin(*years))
    one = rows.groupBy("year", "account", "corp").agg(F.min(F.struct("chunk", "name")).alias("r"))
    after = Window.partitionBy("year", "account").orderBy("corp")
    pairs = one.withColumn("next", F.lead(F.struct("corp", "r")).over(after)).where("next is not null")
    pairs = pairs.select("year", "account", F.col("corp").alias("corp"), F.col("r.chunk").alias("chunk"), F.col("r.name").alias("name"), F.col("next.corp").alias("corp2"), F.col("next.r.chunk").alias("chunk2"), F.col("next.r.name").alias("name2"))
    text = F.concat("name", F.lit(" vs "), "name2", F.lit(" "), F.col("year").cast("string"), F.lit("년 "), "account")
    return sampled(pairs, n, seed, "chunk", "chunk2").select(F.lit("비교").alias("category"), text.alias("query"), F.array("chunk", "chunk2").alias("chunks"), F.array("corp", "corp2").alias("corps"), F.lit(False).alias("no_answer"))


def topic_questions(summaries: DataFrame, n: int, seed: str = "f") -> DataFrame:
    """TXT17: '{company} {heading}' from summaries (chunk, corp, name, kind, summary) of over 50 characters; each heading once, short dull ones never."""
    rows = summaries.where(F.col("kind").isin("text_micro", "text_macro") & (F.length("summary") > 50)).withColumn("topic", F.trim(F.regexp_extract("summary", SECTION, 1)))
    dull = F.lit(False)
    for word in DULL:
        dull = dull | F.col("topic").contains(word)
    rows = rows.where((F.length("topic") >= 4) & ~(dull & (F.length("topic") < 8)))
    once = rows.groupBy("topic").agg(F.min(F.struct("chunk", "corp", "name")).alias("r")).select("topic", "r.*")
    return _question(sampled(once, n, seed, "chunk"), "자유서술", F.concat("name", F.lit(" "), "topic"))


def audit_questions(chunks: DataFrame, n: int, seed: str = "s") -> DataFrame:
    """TXT17: '{company} {year}년 감사의견', one for each company and year."""
    one = chunks.where(F.col("endpoint") == AUDIT).groupBy("corp", "year").agg(F.min(F.struct("chunk", "name")).alias("r")).select("corp", "year", "r.*")
    return _question(sampled(one, n, seed, "chunk"), "출처_충돌_검증", F.concat("name", F.lit(" "), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit("년 감사의견")))


def person_questions(chunks: DataFrame, n: int, seed: str = "p") -> DataFrame:
    """TXT17: '{year}년 기준 {company} 임원 {person}', one for each company, year and person."""
    rows = chunks.where((F.col("endpoint") == EXECUTIVES) & F.col("year").isNotNull()).withColumn("person", F.regexp_extract("text", PERSON, 1)).where("person <> ''")
    one = rows.groupBy("corp", "year", "person").agg(F.min(F.struct("chunk", "name")).alias("r")).select("corp", "year", "person", "r.*")
    return _question(sampled(one, n, seed, "chunk"), "시점", F.concat(F.col("year").cast("string"), F.lit("년 기준 "), "name", F.lit(" 임원 "), "person"))


def unanswerable(names: DataFrame, fields: DataFrame, n: int, seed: str = "u") -> DataFrame:
    """TXT17: questions about companies (name) out of scope, each with a field (field); short stated lists."""
    rows = names.crossJoin(F.broadcast(fields))
    text = F.concat("name", F.lit(" "), "field")
    empty = F.array().cast("array<string>")
    return sampled(rows, n, seed, "name", "field").select(F.lit("no_answer").alias("category"), text.alias("query"), empty.alias("chunks"), empty.alias("corps"), F.lit(True).alias("no_answer"))


def widened(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """TXT17: expected chunks widened to all chunks with the natural key of one of them, in order.

    Of accounts that is (company, year, account, endpoint, variant), of the audit category (company, year, endpoint); other
    categories stay. Keys are matched NULL with NULL. A fact's chunks become one list before the questions meet it.
    """
    questions = questions.withColumn("_q", F.md5(F.concat_ws("|", "category", "query", F.array_join("chunks", ","))))
    wanted = questions.select("_q", "category", F.explode("chunks").alias("chunk"))
    rows = chunks.withColumn("account", F.regexp_extract("text", ACCOUNT, 1))
    key = lambda *c: F.md5(F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x in c)))
    fact = F.when((F.col("endpoint") == ACCOUNTS) & (F.col("account") != ""), key("corp", "year", "account", "endpoint", "variant"))
    audit = F.when(F.col("endpoint") == AUDIT, key("corp", "year", "endpoint"))
    keyed = rows.select("chunk", fact.alias("fact"), audit.alias("audit"))
    asked = wanted.join(keyed, "chunk").withColumn("key", F.when(F.col("category").isin("정형수치", "시계열", "비교"), F.col("fact")).when(F.col("category") == "출처_충돌_검증", F.col("audit"))).where("key is not null")
    needed = asked.select("key").distinct()
    both = keyed.select("chunk", F.explode(F.array_compact(F.array("fact", "audit"))).alias("key")).join(needed, "key", "left_semi")
    lists = both.groupBy("key").agg(F.collect_set("chunk").alias("more"))
    more = asked.select("_q", "key").distinct().join(lists, "key").groupBy("_q").agg(F.flatten(F.collect_list("more")).alias("more"))
    out = questions.join(more, "_q", "left")
    return out.withColumn("chunks", F.array_sort(F.array_union("chunks", F.coalesce("more", F.array().cast("array<string>"))))).drop("more", "_q")
