"""Last touches on a chunk's text, and the keys of chunks. All but the BLAKE2b digest stay in the JVM."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import let
from .sentences import between, enrich_amounts

#: Acronyms and the names that are put behind them.
ACRONYMS = {
    "HBM": "고대역폭메모리", "DRAM": "동적 RAM", "NAND": "낸드플래시", "SSD": "솔리드스테이트드라이브", "PCB": "인쇄회로기판", "FAB": "반도체공장",
    "EUV": "극자외선노광", "CMP": "화학적기계연마", "ALD": "원자층증착", "CVD": "화학기상증착", "PVD": "물리기상증착",
    "DX": "디바이스경험", "DS": "디바이스솔루션", "SDC": "삼성디스플레이",
    "KSIC": "한국표준산업분류", "IFRS": "국제회계기준", "K-IFRS": "한국채택국제회계기준", "KAM": "핵심감사사항", "EPS": "주당순이익", "BPS": "주당순자산",
    "ROE": "자기자본이익률", "ROA": "총자산이익률", "OPM": "영업이익률", "PER": "주가수익비율", "PBR": "주가순자산비율", "ESG": "환경·사회·지배구조", "M&A": "인수합병",
    "CB": "전환사채", "BW": "신주인수권부사채", "CP": "기업어음", "EB": "교환사채",
    "PSU": "성과연동주식보상", "OPI": "성과인센티브", "LTI": "장기인센티브", "ESOP": "우리사주조합",
    "FTC": "공정거래위원회", "BOK": "한국은행", "KOSIS": "통계청 국가통계포털", "DART": "전자공시시스템",
    "KRX": "한국거래소", "KOSPI": "코스피", "KOSDAQ": "코스닥", "OTC": "장외시장", "IPO": "기업공개", "VC": "벤처캐피털",
}


def _terms(names: dict[str, str]) -> str:
    """A word among the names, the longest where several begin; word characters are those of Unicode. Letters that begin no name are passed without more."""
    heads = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({k[0] for k in names}))
    return rf"(?U)(?=[{heads}])\b(?:" + "|".join(rf"\Q{k}\E" for k in sorted(names, key=lambda k: (-len(k), k))) + r")\b"


def expand_acronyms(text: Column, names: dict[str, str] | None = None) -> Column:
    """Every acronym is followed by its name in brackets, unless a bracket follows already; NULL stays.

    The text is cut at all acronyms at once and put together again, so what was put in is not read again.
    """
    names = ACRONYMS if names is None else names
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def shown(hit: Column, after: Column) -> Column:
        named = F.concat(hit, F.when(F.startswith(after, F.lit("(")), "").otherwise(F.concat(F.lit("("), F.element_at(table, hit), F.lit(")"))), after)
        return F.when(hit.isNull(), after).otherwise(named)

    return let(text, lambda t: between(t, _terms(names), 0, shown))


def apply_lexicon(text: Column) -> Column:
    """Amounts in rounded units, then acronyms."""
    return expand_acronyms(enrich_amounts(text))


@F.pandas_udf(StringType())
def blake16(text: pd.Series) -> pd.Series:
    """16 hex digits of BLAKE2b with a digest of 8 bytes; NULL stays. Spark has no such digest, so it runs over Arrow batches."""
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode("utf-8"), digest_size=8).hexdigest())


def table_chunk_key(corp: Column, receipt: Column, endpoint: Column, variant: Column, row: Column, content: Column) -> Column:
    """S3: what the id of a table row's chunk is the digest of."""
    return F.concat_ws("|", corp, receipt, F.concat(endpoint, F.lit("/"), variant), row.cast("string"), F.sha1(content))


def text_chunk_key(corp: Column, receipt: Column, path: Column, offset: Column, content: Column) -> Column:
    """S3: what the id of a section's chunk is the digest of; ``path`` is an array of keys."""
    return F.concat_ws("|", corp, receipt, F.array_join(path, "-"), offset.cast("string"), F.sha1(content))
