"""Texts cut into sections, paragraphs and chunks. Lines are rows, and what runs along a text is a window over its lines."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.scalars import let

#: Headings of three levels, and the sections that are kept.
HEADINGS = (("roman", r"^\s*([IVXLCDM]+)\.\s+(.+?)\s*$"), ("arabic", r"^\s*(\d+)\.\s+(.+?)\s*$"), ("hangul", r"^\s*([가-힣])\.\s+(.+?)\s*$"))
KEPT_ROMANS, KEPT_IN_III, NOTES = ("II", "IV", "V", "XI"), ("3", "4", "5"), "주석"


def heading(line: Column) -> Column:
    """(level, key, body) of a heading line; NULL for others."""
    out = None
    for level, (_, pattern) in enumerate(HEADINGS, 1):
        got = F.struct(F.lit(level).alias("level"), F.regexp_extract(line, pattern, 1).alias("key"), F.trim(F.regexp_extract(line, pattern, 2)).alias("body"))
        out = F.when(line.rlike(pattern), got) if out is None else out.when(line.rlike(pattern), got)
    return out


def kept(path: Column, second: Column) -> Column:
    """WIN17: sections of the kept chapters, and of chapter III the numbered ones or the notes."""
    top = F.get(path, F.lit(0))
    return top.isin(*KEPT_ROMANS) | ((top == "III") & (F.size(path) >= 2) & (F.coalesce(F.get(path, F.lit(1)).isin(*KEPT_IN_III), F.lit(False)) | F.coalesce(second.contains(NOTES), F.lit(False))))


def sections(docs: DataFrame, least: int = 30) -> DataFrame:
    """WIN17: (doc_id, start_line, end_line, path, headings, text) of the kept sections with enough text.

    A heading counts if its upper levels are open: chapters always, numbers inside a chapter, letters inside a
    number; other heading-like lines are text. Each level's latest heading is carried forward over the lines, those
    that a higher level has closed since are not.
    """
    # a document is a row: rows of one id, or without one, are told apart by their texts, and equal rows' equal lines by a number
    own = ["doc_id", "_text"]
    rows = docs.select("doc_id", "text", F.md5("text").alias("_text")).repartition(*own)
    lines = rows.select(*own, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("h", heading(F.col("line")))
    lines = lines.withColumn("_copy", F.row_number().over(Window.partitionBy(*own, "pos").orderBy("pos")))
    w = Window.partitionBy(*own).orderBy("pos")
    at = lambda level: F.last(F.when(F.col("h.level") == level, F.col("pos")), ignorenulls=True).over(w)
    lines = lines.withColumn("p1", at(1)).withColumn("p2", at(2))
    # numbers count inside a chapter; letters where a counted number is open
    lines = lines.withColumn("p2", F.when(F.col("p2") > F.col("p1"), F.col("p2")))
    counts = F.coalesce((F.col("h.level") == 1) | ((F.col("h.level") == 2) & F.col("p1").isNotNull()) | ((F.col("h.level") == 3) & F.col("p2").isNotNull()), F.lit(False))
    lines = lines.withColumn("opens", counts)
    start = F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(w)
    latest = lambda level: F.last(F.when(F.col("opens") & (F.col("h.level") == level), F.struct("pos", "h.key", "h.body")), ignorenulls=True).over(w)
    lines = lines.withColumns({"start": start, "a": latest(1), "b": latest(2), "c": latest(3)}).where("start is not null and not opens")
    b = F.when(F.col("b.pos") > F.col("a.pos"), F.col("b"))
    c = F.when(F.col("c.pos") > b["pos"], F.col("c"))
    shown = lambda x: F.concat(x["key"], F.lit(". "), x["body"])
    # the lines of one section have the same headings and make one text
    heads = F.struct(F.array_compact(F.array(F.col("a.key"), b["key"], c["key"])).alias("path"), F.array_compact(F.array(shown(F.col("a")), shown(b), shown(c))).alias("headings"))
    texts = lines.groupBy(*own, "_copy", "start").agg(F.any_value(heads).alias("heads"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    out = texts.select("doc_id", "start", "heads.*", F.size("l").alias("n"), F.regexp_replace(F.array_join(F.expr("transform(l, x -> x.line)"), "\n"), r"(?U)^\s+|\s+$", "").alias("text"))
    out = out.where((F.length("text") >= least) & kept(F.col("path"), F.get("headings", F.lit(1))))
    return out.select("doc_id", (F.col("start") + 1).alias("start_line"), (F.col("start") + 1 + F.col("n")).alias("end_line"), "path", "headings", "text")


def packed(sizes: Column, most: int) -> Column:
    """WIN16: for each size the number of its pack: a pack that holds something is closed when the next item would pass ``most``; larger items stand alone.

    One pass over Arrow batches; a fold in the JVM would copy the list at every step.
    """

    def number(rows: pd.Series) -> pd.Series:
        def one(own: Iterable[int]) -> list[int]:
            out, held, pack = [], 0, 0
            for n in own:
                if out and held + n > most and out[-1] == pack:
                    held, pack = 0, pack + 1
                held += n
                out.append(pack)
            return out

        return rows.map(lambda own: None if own is None else one(own))

    return F.pandas_udf(number, ArrayType(IntegerType()))(sizes)


def paragraph_packs(docs: DataFrame, most: int) -> DataFrame:
    """WIN16: (doc_id, pack, text): paragraphs packed in order into at most ``most`` words each."""
    parts = F.split("text", "\n\n", -1)
    rows = docs.select("doc_id", parts.alias("p")).withColumn("k", packed(F.transform("p", lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).cast("bigint")), most))
    items = rows.select("doc_id", F.posexplode(F.arrays_zip("p", "k")).alias("pos", "i")).select("doc_id", "pos", "i.k", "i.p")
    return items.groupBy("doc_id", F.col("k").alias("pack")).agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("a")).select("doc_id", "pack", F.array_join(F.expr("transform(a, x -> x.p)"), "\n\n").alias("text"))


#: Ranges that rows are numbered in side by side, as two steps of so many each.
STEPS, SAMPLED = 32, 20_000


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``row_no`` from 0 in key order (NULL first), gapless.

    The key's range is cut at places that a sample shows; a row's range depends on its key alone, so counting the ranges and numbering the rows in
    them agree, however Spark deals the rows out. Ranges are numbered side by side and each starts where those before it end. The key should be nearly
    unique: equal keys share a range.
    """
    share = min(1.0, SAMPLED / max(1, rows.count()))
    seen = sorted(r[0] for r in rows.select(key).sample(share, 7).collect() if r[0] is not None)
    cuts = sorted({seen[i * len(seen) // STEPS**2] for i in range(STEPS**2)}) if seen else []
    groups = [cuts[i : i + STEPS] for i in range(0, len(cuts), STEPS)]
    kind = rows.schema[key].dataType
    before = lambda values: F.size(F.filter(values, lambda x: x <= F.col(key)))
    literal = lambda values: F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind.simpleString()}>")
    high = before(literal([g[0] for g in groups]))
    low = before(F.get(F.array(*[literal(g) for g in groups]), high - 1)) if groups else F.lit(0)
    part = F.when(F.col(key).isNull(), F.lit(-1)).when(high == 0, F.lit(0)).otherwise(high * (STEPS + 1) + low)
    parts = rows.withColumn("_part", part)
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # at most STEPS * STEPS + 2 rows
    starts = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return parts.withColumn("_at", at).join(F.broadcast(starts), "_part").withColumn("row_no", F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")


def batches(docs: DataFrame, size: int = 10, cut: int = 2000) -> DataFrame:
    """TXT20: (batch, docs, body): documents in order of id, their texts cut, ``size`` of them in a batch."""
    rows = numbered(docs.select("doc_id", F.substring("text", 1, cut).alias("body")), "doc_id")
    g = rows.groupBy(F.floor(F.col("row_no") / size).alias("batch"))
    return g.agg(F.array_sort(F.collect_list(F.struct("doc_id", "body"))).alias("docs"))


#: Words that make a text worth a model's reading, by what they may tell.
TRIGGERS = {
    "events": (
        "인수", "합병", "M&A", "취득", "분할", "분할합병", "흡수합병", "주식 교환", "주식교환", "주식 이전", "주식이전",
        "증자", "유상증자", "무상증자", "감자", "유무상증자", "전환사채", "신주인수권", "교환사채", "사채 발행", "자기주식",
        "영업양수", "영업양도", "영업 양수", "영업 양도", "양수도", "공급계약", "단일판매", "공급 계약", "수주",
        "임원 변경", "이사회 결의", "사내이사", "사외이사", "대표이사 선임", "최대주주 변경", "지분 매각", "지분 인수",
        "상장", "상장폐지", "코스피 이전", "부도", "법정관리", "회생절차", "정정공시", "해산", "소송",
    ),
    "relations": (
        "공급", "납품", "협력사", "협력업체", "공급망", "공급사", "고객사", "주요 고객", "원료 공급", "경쟁", "라이벌", "시장 점유율",
        "자회사", "관계회사", "계열사", "지분 보유", "생산", "제조", "출시", "양산", "개발", "조달", "구매",
    ),
    "tech": (
        "도입", "적용", "전환", "개발 완료", "양산 적용", "EUV", "ArF", "GAA", "FinFET", "HBM", "DRAM", "NAND",
        "CoWoS", "TC 본더", "TC본더", "포토레지스트", "감광액", "파운드리", "패키징", "후공정", "전공정", "노광", "식각", "증착",
    ),
}


def triggers(text: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """TXT2: array of (category, hits) of the categories whose trigger words the text holds, in the order of the table; an empty list is no trigger."""
    hits = lambda held, ws: F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(held, w))
    row = lambda held, c, ws: F.struct(F.lit(c).alias("category"), hits(held, ws).alias("hits"))
    rows = lambda held: F.array(*[row(held, c, ws) for c, ws in (words or TRIGGERS).items()])
    return F.filter(let(F.coalesce(text, F.lit("")), rows), lambda r: F.size(r["hits"]) > 0)
