"""Which sentences a disclosure table's rows become, by the table's endpoint (TXT4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import table_sentences as T
from .records import flat_fields, safe_year, to_int
from .sentences import account_sentences

#: Endpoints with sentences of their own, by kind, and the section of a kind.
KINDS = {
    "account": ("fnlttSinglAcntAll", "fnlttSinglAcnt"),
    "index": ("fnlttSinglIndx",),
    "audit": ("accnutAdtorNmNdAdtOpinion",),
    "officer": ("exctvSttus", "outcmpnyDrctrNdChangeSttus"),
    "holder": ("hyslrSttus", "hyslrChgSttus"),
    "dividend": ("alotMatter",),
    "treasury": ("tesstkAcqsDspsSttus",),
    "investment": ("otrCprInvstmntSttus",),
    "employee": ("empSttus",),
    "pay": ("hmvAuditAllSttus", "hmvAuditIndvdlBySttus", "indvdlByPay"),
}
SECTIONS = {"account": "III.", "index": "III.", "audit": "V.", "officer": "VIII.", "holder": "VII.", "dividend": "I.", "treasury": "I.", "investment": "XII.", "employee": "VIII.", "pay": "VIII."}
#: Endpoints of decisions and of other tables, with what they are called and their section.
EVENTS = {
    "piicDecsn": ("유상증자", "I."), "fricDecsn": ("무상증자", "I."), "pifricDecsn": ("유무상증자", "I."), "crDecsn": ("감자", "I."),
    "tsstkAqDecsn": ("자기주식 취득", "I."), "tsstkDpDecsn": ("자기주식 처분", "I."), "tsstkAqTrctrCcDecsn": ("자기주식취득 신탁계약 체결", "I."), "tsstkAqTrctrCnsDecsn": ("자기주식취득 신탁계약 해지", "I."),
    "otcprStkInvscrInhDecsn": ("타법인 주식·출자증권 양수 (M&A)", "XII."), "otcprStkInvscrTrfDecsn": ("타법인 주식·출자증권 양도", "XII."), "bsnInhDecsn": ("영업양수", "XII."), "bsnTrfDecsn": ("영업양도", "XII."),
    "cmpDvDecsn": ("회사분할", "XII."), "cmpDvmgDecsn": ("회사분할합병", "XII."), "othcmpMrgDecsn": ("회사합병", "XII."), "stkExtrDecsn": ("주식교환·이전", "XII."),
    "exbdIsDecsn": ("교환사채권 발행", "II."), "bdwtIsDecsn": ("신주인수권부사채 발행", "II."), "cvbdIsDecsn": ("전환사채 발행", "II."), "wdCocobdIsDecsn": ("상각형 조건부자본증권 발행", "II."),
    "lwstLg": ("소송 등 제기", "XII."), "tgastInhDecsn": ("유형자산 양수", "XII."), "tgastTrfDecsn": ("유형자산 양도", "XII."), "asignInhDecsn": ("주식양수도", "XII."), "astInhtrfEtcPtbkOpt": ("자산양수도·풋백옵션", "XII."),
    "bsnSp": ("영업정지", "XII."), "dfOcr": ("부도발생", "XII."), "ctrcvsBgrq": ("회생절차 개시신청", "XII."), "dsRsOcr": ("해산사유 발생", "XII."), "ovLstDecsn": ("해외증권시장 상장", "XII."), "bnkMngtPcbg": ("채권은행 관리절차 개시", "XII."),
}
TABLES = {
    "mrhlSttus": ("소액주주현황", "VII."), "irdsSttus": ("증감자(자본금) 변동", "I."), "pssrpCptalUseDtls": ("공모자금 사용내역", "XI."), "prvsrpCptalUseDtls": ("사모자금 사용내역", "XI."),
    "detScritsIsuAcmslt": ("채무증권 발행실적", "II."), "entrprsBilScritsNrdmpBlce": ("회사채 미상환 잔액", "II."), "srtpdPsndbtNrdmpBlce": ("단기사채 미상환 잔액", "II."), "cprndNrdmpBlce": ("기업어음 미상환 잔액", "II."),
    "newCaplScritsNrdmpBlce": ("신종자본증권 미상환 잔액", "II."), "cndlCaplScritsNrdmpBlce": ("조건부자본증권 미상환 잔액", "II."), "adtServcCnclsSttus": ("감사용역 체결현황", "V."), "accnutAdtorNonAdtServcCnclsSttus": ("비감사용역 계약체결", "V."),
    "drctrAdtAllMendngSttusGmtsckConfmAmount": ("이사·감사 보수 주총승인 금액", "VIII."), "drctrAdtAllMendngSttusMendngPymntamtTyCl": ("이사·감사 보수 유형별 지급금액", "VIII."), "unrstExctvMendngSttus": ("미등기임원 보수현황", "VIII."),
}
_UNSHOWN = ("rcept_no", "corp_code", "corp_name", "corp_cls")


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def section(endpoint: Column) -> Column:
    """The section of an endpoint's chunks; NULL for endpoints that are not read."""
    own = {e: SECTIONS[kind] for kind, names in KINDS.items() for e in names} | {e: s for e, (_, s) in (EVENTS | TABLES).items()}
    return F.try_element_at(_table(own), endpoint)


def endpoint_sentences(corp: Column, endpoint: Column, item: Column, labels: dict[str, str]) -> Column:
    """TXT4: array of (variant, content) of a table row, by its endpoint; NULL for endpoints that are not read.

    ``item`` maps field names to texts, in the order of the row; ``labels`` name fields of decisions and other tables. The year is the row's own, else of its
    closing date, else of its receipt, else 0.
    """
    f = lambda name: F.try_element_at(item, F.lit(name))
    code, year = f("corp_code"), safe_year(f("bsns_year"), f("stlm_dt"), f("rcept_no"))
    shown = lambda *more: flat_fields(F.map_keys(item), F.map_values(item), labels, (*_UNSHOWN, *more))
    amount = lambda name: to_int(f(name))
    officer = {"nm": "nm", "sex": "sexdstn", "birth": "birth_ym", "post": "ofcps", "registered": "rgist_exctv_at", "full_time": "fte_at", "duty": "chrg_job", "career": "main_career", "relation": "mxmm_shrholdr_relate", "until": "tenure_end_on"}
    made = {
        "account": account_sentences(corp, code, f("fs_div"), f("sj_div"), f("sj_nm"), f("account_nm"), f("account_id"), year, amount("thstrm_amount"), amount("frmtrm_amount"), amount("bfefrmtrm_amount")),
        "index": T.index_sentences(corp, code, year, f("idx_nm"), f("idx_val")),
        "audit": T.audit_sentences(corp, code, year, f("adtor"), f("adt_opinion"), f("core_adt_matter"), f("emphs_matter"), f("adt_reprt_spcmnt_matter")),
        "officer": T.officer_sentences(corp, code, year, {k: f(v) for k, v in officer.items()}),
        "holder": T.holder_sentences(corp, code, year, f("nm"), f("relate"), f("stock_knd"), f("bsis_posesn_stock_co"), f("bsis_posesn_stock_qota_rt"), f("trmend_posesn_stock_co"), f("trmend_posesn_stock_qota_rt")),
        "dividend": T.dividend_sentences(corp, year, f("se"), f("stock_knd"), f("thstrm"), f("frmtrm"), f("lwfr")),
        "treasury": T.treasury_sentences(corp, year, f("stock_knd"), f("bsis_qy"), f("change_qy_acqs"), f("change_qy_dsps"), f("trmend_qy")),
        "investment": T.investment_sentences(corp, year, f("inv_prm"), f("invstmnt_purps"), f("trmend_blce_qy"), f("trmend_blce_qota_rt"), f("trmend_blce_acntbk_amount")),
        "employee": T.employee_sentences(corp, year, f("sexdstn"), f("fo_bbm"), f("rgllbr_co"), f("cnttk_co"), f("avrg_cnwk_sdytrn")),
        "pay": T.pay_sentences(corp, year, F.when(F.coalesce(f("nm"), F.lit("")) != "", f("nm")).otherwise(f("nmpr")), f("ofcps"), f("mendng_totamt"), f("jan_avrg_mendng_am")),
    }
    event, other = (F.try_element_at(_table({e: label for e, (label, _) in rows.items()}), endpoint) for rows in (EVENTS, TABLES))
    out = F.when(event.isNotNull(), T.event_sentences(corp, code, f("rcept_dt"), event, shown("rcept_dt"))).when(other.isNotNull(), T.table_sentences(corp, code, year, other, shown("stlm_dt")))
    for kind, names in KINDS.items():
        out = out.when(endpoint.isin(*names), made[kind])
    return out
