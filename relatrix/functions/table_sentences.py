"""Sentences from rows of disclosure tables, as column expressions; each converter gives an array of (variant, content).

Templates are output formats and fixed values. A field that is absent or NULL takes the template's stand-in: "?" for
names, nothing for details, and "undisclosed" for quantities.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import UNDISCLOSED, normalize_date, to_int
from .sentences import amount_text


def disclosed(value: Column) -> Column:
    """A quantity as it is shown: trimmed, or undisclosed if it is blank."""
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | text.isin("", "-", "—", "None", "null", "N/A"), UNDISCLOSED).otherwise(text)


def _or(value: Column, other: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(other))


def _filled(value: Column, other: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", other).otherwise(value)


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _row(variant: str, content: Column) -> Column:
    return F.struct(F.lit(variant).alias("variant"), content.alias("content"))


def _rows(*rows: tuple[str, Column, Column | None]) -> Column:
    """(variant, content, condition): rows whose condition holds."""
    made = [_row(v, c) if ok is None else F.when(ok, _row(v, c)) for v, c, ok in rows]
    return F.array_compact(F.array(*made))


def index_sentences(corp: Column, code: Column, year: Column, name: Column, value: Column) -> Column:
    """TXT13: full; key when there is a value."""
    y, n = year.cast("string"), _or(name, "?")
    shown = F.coalesce(value, F.lit(UNDISCLOSED))
    return _rows(("full", _text(corp, "(", _or(code), ")의 ", y, "년 재무지표 '", n, "'은 ", shown, "."), None), ("key", _text(corp, " ", y, "년 ", n, " ", shown), F.trim(F.coalesce(value, F.lit(""))) != ""))


def audit_sentences(corp: Column, code: Column, year: Column, auditor: Column, opinion: Column, matter: Column, emphasis: Column, special: Column) -> Column:
    """TXT13: auditor, opinion, emphasis, special and key matters."""
    head = _text(corp, "(", _or(code), ")의 ", year.cast("string"), "년 사업보고서 회계감사인은 ", _or(auditor, "?"), "이며, 감사의견은 '", _or(opinion, "?"), "'이다. ")
    tail = _text("강조사항: ", _filled(emphasis, "없음"), ". 감사보고서 특기사항: ", _filled(special, "없음"), ". 핵심감사사항(KAM): ", _filled(matter, "공시되지 않음"))
    return _rows(("full", F.concat(head, tail), None))


def officer_sentences(corp: Column, code: Column, year: Column, f: dict[str, Column]) -> Column:
    """TXT13: an officer (nm, sex, birth, post, registered, full_time, duty, career, relation, until); careers are cut at 200 characters."""
    head = _text(corp, "(", _or(code), ") ", year.cast("string"), "년 임원 '", _or(f["nm"], "?"), "'(", _or(f["sex"]), ", ", _or(f["birth"]), "생)은 ", _or(f["post"]), "(", _or(f["registered"]), ", ", _or(f["full_time"]), "). ")
    tail = _text("담당: ", _or(f["duty"]), ". 주요 경력: ", F.substring(_or(f["career"]), 1, 200), ". 최대주주와의 관계: ", _filled(f["relation"], "해당 없음"), ". 임기만료: ", normalize_date(f["until"]), ".")
    return _rows(("full", F.concat(head, tail), None))


def holder_sentences(corp: Column, code: Column, year: Column, name: Column, relation: Column, kind: Column, first: Column, first_rate: Column, last: Column, last_rate: Column) -> Column:
    """TXT14: holdings of a main shareholder at the start and the end."""
    head = _text(corp, "(", _or(code), ") ", year.cast("string"), "년 최대주주 '", _or(name, "?"), "'(관계: ", _or(relation), ") ", _or(kind))
    return _rows(("full", _text(head, " 보유주식 기초 ", disclosed(first), " (", disclosed(first_rate), "%) → 기말 ", disclosed(last), " (", disclosed(last_rate), "%)."), None))


def dividend_sentences(corp: Column, year: Column, item: Column, kind: Column, now: Column, before: Column, earlier: Column) -> Column:
    """TXT14: full and comparison over three terms."""
    a, b, c = disclosed(now), disclosed(before), disclosed(earlier)
    k, i = _or(kind, "보통주"), _or(item)
    full = _text(corp, " ", year.cast("string"), "년 ", k, " 항목 '", i, "': 당기 ", a, ", 전기 ", b, ", 전전기 ", c, ".")
    return _rows(("full", full, None), ("comparison", _text(corp, " ", k, " '", i, "' 3기 추이: ", c, " → ", b, " → ", a, "."), None))


def treasury_sentences(corp: Column, year: Column, kind: Column, first: Column, bought: Column, sold: Column, last: Column) -> Column:
    """TXT14: own shares; nothing if no quantity is disclosed."""
    values = [disclosed(x) for x in (first, bought, sold, last)]
    some = (values[0] != UNDISCLOSED) | (values[1] != UNDISCLOSED) | (values[2] != UNDISCLOSED) | (values[3] != UNDISCLOSED)
    a, b, c, d = values
    return _rows(("full", _text(corp, " ", year.cast("string"), "년 자기주식 ", _or(kind), ": 기초 ", a, " → 취득 ", b, ", 처분 ", c, " → 기말 ", d, "."), some))


def _won(raw: Column) -> Column:
    return amount_text(to_int(raw))


def investment_sentences(corp: Column, year: Column, name: Column, purpose: Column, quantity: Column, rate: Column, book: Column) -> Column:
    """TXT15: a stake in another company."""
    return _rows(("full", _text(corp, " ", year.cast("string"), "년 타법인 출자 — '", _or(name, "?"), "' (목적: ", _or(purpose), "). 기말 잔액 ", _or(quantity), "주 (", _or(rate), "%), 장부가액 ", _won(book), "."), None))


def employee_sentences(corp: Column, year: Column, sex: Column, unit: Column, regular: Column, contract: Column, tenure: Column) -> Column:
    """TXT15."""
    return _rows(("full", _text(corp, " ", year.cast("string"), "년 직원 현황 (", _or(sex), ", 부문 ", _or(unit), "): 정규직 ", _or(regular), ", 계약직 ", _or(contract), ", 평균 근속 ", _or(tenure), "년."), None))


def pay_sentences(corp: Column, year: Column, name: Column, post: Column, total: Column, mean: Column) -> Column:
    """TXT15: the mean is left out where there is none."""
    also = F.when(F.coalesce(mean, F.lit("")) != "", F.concat(F.lit("; 평균 "), _won(mean))).otherwise("")
    return _rows(("full", _text(corp, " ", year.cast("string"), "년 보수 — '", _or(name), "' ", _or(post), ": 총액 ", _won(total), also, "."), None))


def event_sentences(corp: Column, code: Column, received: Column, label: Column | str, fields: Column) -> Column:
    """TXT16: a decision and its fields (flat_fields)."""
    return _rows(("full", _text(corp, "(", _or(code), ")는 ", normalize_date(received), " ", label, " 결정. 세부: ", fields), None))


def table_sentences(corp: Column, code: Column, year: Column, label: Column | str, fields: Column) -> Column:
    """TXT16: any other table row; nothing without fields."""
    return _rows(("full", _text(corp, "(", _or(code), ") ", year.cast("string"), "년 ", label, ": ", fields), fields != ""))
