"""Scalar functions over collected records: keys, dates, report kinds, validity and routing. Rows S, PRJ and FIL of the inventory."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Report code by the month a report closes.
REPORT_BY_MONTH = {"03": "11013", "06": "11012", "09": "11014", "12": "11011"}
#: Reports that are read in full, and the text of an undisclosed value.
KEY_REPORTS = ("사업보고서", "반기보고서", "분기보고서")
UNDISCLOSED = "(공시되지 않음)"
#: Kinds of chunks that are never read for meaning, those that may go to a model, and the least length.
DROPPED_KINDS = ("table_nl", "krx_ohlcv", "bok_macro", "kosis_meta", "ftc_meta")
LEAST_CHARS = 80


def metric_id(*parts: Column) -> Column:
    """First 16 hex digits of md5 of company, year, indicator, statement kinds and report code."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))), 1, 16)


def to_int(raw: Column) -> Column:
    """Whole number of a text with commas, brackets as minus; NULL for blanks, dashes and other text."""
    text = F.regexp_replace(F.trim(raw), ",", "")
    text = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    return F.when(text.isin("", "-", "—"), None).otherwise(text.try_cast("double").cast("bigint"))


def normalize_date(raw: Column) -> Column:
    """Yyyy-mm-dd of the date a text begins with, else the trimmed text; NULL gives an empty text."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(text.rlike(r"^\d{4}[.\-/]?\d{2}[.\-/]?\d{2}"), F.regexp_replace(text, r"^(\d{4})[.\-/]?(\d{2})[.\-/]?(\d{2}).*$", "$1-$2-$3")).otherwise(text)


def published(raw: Column) -> Column:
    """Time without zone of an ISO 8601 or RFC 2822 text; NULL for others."""
    iso = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?))?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$", 1)
    clock = F.regexp_extract(raw, r"^\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2}(?::\d{2})?)", 1)
    iso_at = F.try_to_timestamp(F.concat(iso, F.lit(" "), F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)), F.lit("yyyy-MM-dd HH:mm:ss"))
    mail = F.regexp_extract(raw, r"^(?:[A-Z][a-z]{2}, )?(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.when(iso != "", iso_at).when(mail != "", F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss"))).cast("timestamp_ntz")


def safe_year(year: Column, closing: Column, receipt: Column) -> Column:
    """Year of a record: its business year, else of its closing date, else of its receipt number, else 0."""
    found = lambda c: F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"\b(20\d{2})\b", 1)
    return F.when(found(year) != "", found(year)).when(found(closing) != "", found(closing)).when(receipt.rlike(r"^\d{4}"), F.substring(receipt, 1, 4)).otherwise("0").cast("int")


def document_period(kind: Column) -> Column:
    """(year, report) of a document's kind such as '사업보고서 (2025.12)'; NULL without a period."""
    year, month = (F.regexp_extract(kind, r"\((20\d{2})[.\-/](\d{2})\)", i) for i in (1, 2))
    table = F.create_map(*[F.lit(x) for pair in REPORT_BY_MONTH.items() for x in pair])
    return F.struct(F.when(year != "", year.cast("int")).alias("year"), F.try_element_at(table, month).alias("report"))


def row_hash(*fields: Column) -> Column:
    """First 16 hex digits of sha1 of the key fields; a missing field is empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))), 1, 16)


def params_hash(params: dict[str, Column]) -> Column:
    """First 8 hex digits of sha1 of the parameters as JSON with sorted keys, without the key that signs requests.

    Values keep their types: numbers and booleans stand bare, NULL is null, texts are quoted and escaped.
    """
    named = sorted(k for k in params if k != "crtfc_key")
    field = lambda k: F.to_json(F.struct(params[k].alias("v")), {"ignoreNullFields": "false"})
    items = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ": "), F.regexp_replace(field(k), r'(?s)^\{"v":(.*)\}$', "$1")) for k in named]
    return F.substring(F.sha1(F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))), 1, 8)


def flat_fields(names: Column, values: Column, labels: dict[str, str], excluded: tuple[str, ...] = (), cut: int = 800) -> Column:
    """S37: 'label=value' of the fields that have a value, joined by ', ' and cut; unknown names stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    shown = lambda k, v: F.when(~k.isin(*excluded, "") & v.isNotNull() & ~v.isin("", "-"), F.concat(F.coalesce(F.try_element_at(table, k), k), F.lit("="), v))
    return F.substring(F.array_join(F.zip_with(names, values, shown), ", "), 1, cut)  # NULLs are not joined


def rescored(own: Column, evidence: Column, sources: Column, canonical: Column) -> Column:
    """S41 (proposed): confidence from the model's own, the number of documents (log, ten and more count full), other sources and canonical names."""
    seen = F.least(F.lit(1.0), F.log10(F.greatest(evidence, F.lit(1)).cast("double")))
    return 0.30 * own + 0.30 * seen + 0.20 * F.when(sources >= 2, 1.0).otherwise(0.0) + 0.20 * canonical.cast("double")


def display_name(*names: Column) -> Column:
    """PRJ1."""
    return F.coalesce(*names)


def filing_url(receipt: Column) -> Column:
    """PRJ9."""
    return F.concat(F.lit("https://dart.fss.or.kr/dsaf001/main.do?rcpNo="), receipt)


def logo_url(domain: Column) -> Column:
    """PRJ9: NULL without a domain."""
    return F.concat(F.lit("https://www.google.com/s2/favicons?domain="), F.nullif(domain, F.lit("")), F.lit("&sz=128"))


def shown_summary(summary: Column) -> Column:
    """PRJ10: summaries that stand for a failed call are blank."""
    text = F.coalesce(summary, F.lit(""))
    return F.when(text.startswith("(LLM") | text.contains("호출 실패"), "").otherwise(text)


def relation_ok(subject: Column, other: Column, confidence: Column) -> Column:
    """FIL11: both ends named, not the same, and some confidence."""
    return (F.coalesce(subject, F.lit("")) != "") & (F.coalesce(other, F.lit("")) != "") & (subject != other) & (F.coalesce(confidence, F.lit(0.0)) > 0)


def repaired_predicate(predicate: Column, subject_kind: Column, allowed: tuple[str, ...]) -> Column:
    """FIL12: NULL for unknown predicates; officers are persons, so another subject is a unit."""
    return F.when(~predicate.isin(*allowed), None).when((predicate == "EXECUTIVE_OF") & ~subject_kind.eqNullSafe(F.lit("Person")), "UNIT_OF").otherwise(predicate)


def report_name(name: Column) -> Column:
    """FIL15: name without a leading [..] mark, spaces squeezed."""
    text = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.when(text.rlike(r"^\[[^\]]*\]"), F.trim(F.regexp_replace(text, r"^\[[^\]]*\]", ""))).otherwise(text)


def dropped_report(name: Column, exact: list[str], parts: list[str]) -> Column:
    """FIL15: the catalogue drops this name, or it holds a dropped part."""
    held = F.lit(False)
    for p in parts:
        held = held | name.contains(p)
    return (F.coalesce(name, F.lit("")) != "") & (report_name(name).isin(*exact) | held)


def key_report(name: Column) -> Column:
    """FIL15: yearly, half-yearly and quarterly reports, corrected ones too."""
    return F.coalesce(name.contains(KEY_REPORTS[0]) | name.contains(KEY_REPORTS[1]) | name.contains(KEY_REPORTS[2]), F.lit(False))


def since(raw: Column, day: Column) -> Column:
    """FIL16: published on or after the day; what cannot be read passes."""
    at = published(raw)
    return at.isNull() | (at.cast("date") >= day)


def has_keyword(title: Column, body: Column, word: str) -> Column:
    """FIL17."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))).contains(word)


def statement_ok(indicator: Column, value: Column) -> Column:
    """FIL18: a named indicator that is no remark and disclosed, with a value."""
    text = F.trim(F.coalesce(indicator, F.lit("")))
    return (text != "") & ~text.startswith("(") & ~text.contains("공시되지") & value.isNotNull()


def meaningful(content: Column, least: int = 30) -> Column:
    """FIL19: enough is left without undisclosed values, commas and points."""
    return F.length(F.trim(F.regexp_replace(F.replace(content, F.lit(UNDISCLOSED), F.lit("")), "[,.]", ""))) >= least


def default_only(kinds: Column, relations: Column, events: Column) -> Column:
    """FIL22: records with nothing but one organisation."""
    return (F.size(kinds) == 1) & (F.element_at(kinds, 1) == "Organization") & (relations == 0) & (events == 0)


def route(kind: Column, text: Column, hits: Column, trigger: Column) -> Column:
    """FIL14: DROP by kind, SKIP short texts, DETERMINISTIC with three hits and no trigger, LLM_PATH with a trigger and two hits, else SKIP."""
    short = F.length(F.coalesce(text, F.lit(""))) < LEAST_CHARS
    return F.when(kind.isin(*DROPPED_KINDS), "DROP").when(short, "SKIP").when((hits >= 3) & ~trigger, "DETERMINISTIC").when(trigger & (hits >= 2), "LLM_PATH").otherwise("SKIP")
