"""Sentences from account rows and amounts in texts, as column expressions. Amounts and shares round by their binary value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let, one_decimal

#: Units of an amount, largest first.
UNITS = ((10**12, "조원"), (10**8, "억원"), (10**4, "만원"))
#: Fixed value: shown for an undisclosed amount.
UNDISCLOSED = "(공시되지 않음)"
#: Fixed value: an amount in won of four digits or more that has no rounded form behind it.
AMOUNT = r"(?<![,\d])([+-]?\d{1,3}(?:,\d{3})+|[+-]?\d{4,})원(?!\(약)"
#: Fixed value: a question that compares two companies in a year.
COMPARISON = r"^(.+?)\s*vs\s*(.+?)\s+(\d{4})년\s+(.+)$"


def rounded_amount(won: Column) -> Column:
    """The amount in its largest unit; NULL below 10,000."""
    size = F.abs(won)
    out = F.lit(None).cast("string")
    for unit, name in reversed(UNITS):
        out = F.when(size >= unit, F.concat(F.when(won < 0, "-").otherwise(""), one_decimal(size.cast("double") / float(unit)), F.lit(name))).otherwise(out)
    return out


def amount_text(won: Column, missing: str = UNDISCLOSED) -> Column:
    """'1,234,567원 (약 123.5만원)'; ``missing`` for NULL."""
    base = F.concat(F.format_number(won, 0), F.lit("원"))
    return F.when(won.isNull(), missing).otherwise(F.concat(base, F.coalesce(F.concat(F.lit(" (약 "), rounded_amount(won), F.lit(")")), F.lit(""))))


def change_text(now: Column, before: Column) -> Column:
    """'12.3% 증가' or '12.3% 감소'; no data when a value is missing or the base is zero."""
    known = now.isNotNull() & before.isNotNull() & (before != 0)
    return F.when(known, F.concat(one_decimal(F.abs((now - before).cast("double") / F.abs(before).cast("double") * 100)), F.when(now >= before, "% 증가").otherwise("% 감소"))).otherwise("전년 자료 없음")


def between(text: Column, pattern: str, group: int, shown: Callable[[Column, Column], Column]) -> Column:
    """A text whose every match, with what follows it up to the next, is put as ``shown(hit, after)``; the hit of what comes before the first is NULL.

    Cut and matched once a text, so the work grows with the text and not with matches x text.
    """
    hits = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return F.array_join(F.zip_with(hits, F.split(text, pattern, -1), shown), "")


def enrich_amounts(text: Column) -> Column:
    """Every amount of 10,000 won or more is followed by its rounded form; NULL and empty texts stay."""
    bracket = lambda won: F.coalesce(F.concat(F.lit(" (약 "), rounded_amount(won), F.lit(")")), F.lit(""))

    def shown(hit: Column, after: Column) -> Column:
        won = F.regexp_replace(hit, "[,+]", "").try_cast("decimal(28,0)")
        return F.when(hit.isNull(), after).otherwise(F.concat(hit, F.lit("원"), let(won, bracket), after))

    return let(text, lambda t: between(t, AMOUNT, 1, shown))


#: Kinds of statements, and accounts that get a short sentence.
STATEMENTS = {"BS": "재무상태표", "IS": "손익계산서", "CIS": "포괄손익계산서", "CF": "현금흐름표", "SCE": "자본변동표"}
KEY_ACCOUNTS = (
    "ifrs-full_Revenue", "ifrs-full_RevenueFromSaleOfGoods",
    "ifrs-full_GrossProfit",
    "ifrs-full_ProfitLossFromOperatingActivities", "dart_OperatingIncomeLoss",
    "ifrs-full_ProfitLoss", "ifrs-full_ComprehensiveIncome",
    "ifrs-full_Assets", "ifrs-full_Liabilities", "ifrs-full_Equity",
    "ifrs-full_CashFlowsFromUsedInOperatingActivities",
)


def account_sentences(corp: Column, code: Column, fs: Column, statement: Column, statement_name: Column, account: Column, account_id: Column, year: Column, now: Column, before: Column, earlier: Column, missing: str = UNDISCLOSED) -> Column:
    """TXT12: array of (variant, content): full; key for key accounts with a value; comparison where the value before the last is known."""
    kind = F.when(fs == "CFS", "연결").otherwise("별도")
    table = F.create_map(*[F.lit(x) for pair in STATEMENTS.items() for x in pair])
    shown = F.coalesce(F.try_element_at(table, statement), statement_name, F.lit(""))
    name, text = F.coalesce(account, F.lit("?")), F.coalesce(account_id, F.lit(""))
    a, b, c = amount_text(now, missing), amount_text(before, missing), amount_text(earlier, missing)
    y, y2 = change_text(now, before), change_text(before, earlier)
    full = F.format_string("%s(%s)의 %d년 사업보고서 %s재무제표 %s 항목 '%s'(account_id=%s)은 %s이며, 전년 %s 대비 %s.", corp, F.coalesce(code, F.lit("")), year, kind, shown, name, text, a, b, y)
    key = F.format_string("%s %d년 %s %s %s원", corp, year, kind, name, F.format_number(now, 0))
    comparison = F.format_string("%s %s %s 3기 추이: %s → %s → %s (직전년 %s, 당기년 %s).", corp, kind, name, c, b, a, y2, y)

    def entry(variant: str, content: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(variant).alias("variant"), content.alias("content")))

    return F.array_compact(F.array(entry("full", full, F.lit(True)), entry("key", key, text.isin(*KEY_ACCOUNTS) & now.isNotNull()), entry("comparison", comparison, earlier.isNotNull())))


def comparison_question(text: Column) -> Column:
    """TXT18: struct of the two names, the year and the indicator; NULL when the text is no such question."""
    t = F.trim(text)
    part = lambda i: F.trim(F.regexp_extract(t, COMPARISON, i))
    return F.when(t.rlike(COMPARISON), F.struct(part(1).alias("first"), part(2).alias("second"), part(3).cast("int").alias("year"), part(4).alias("indicator")))
