"""Scalar functions over columns; all stay in the JVM. Rows S1 to S40 of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Corporate forms stripped from names, and what is stripped before a name is compared with its own company's.
CORPORATE_FORMS = r"(?i)주식회사|㈜|\(주\)|株式会社|Co\.,?\s*Ltd\.?|Inc\.?|Corp\.?|Ltd\.?"
OWN_FORMS = r"주식회사|㈜|\(주\)|\(주식회사\)|\s+"
#: Report codes by priority, and the quarter each closes.
REPORT_PRIORITY = {"11011": 4, "11014": 3, "11012": 2, "11013": 1}
REPORT_QUARTER = {"11013": 1, "11012": 2, "11014": 3, "11011": 4}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value; the value is evaluated once, however often it is used. Optimisers do not share work inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash16(*parts: Column) -> Column:
    """First 16 hex digits of md5 of the pipe-joined parts; NULL if any part is (never skipped)."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("|"), p.cast("string"))
    return F.substring(F.md5(joined), 1, 16)


def uuid_from_id(key: Column) -> Column:
    """md5 of the id in UUID layout."""
    return F.regexp_replace(F.md5(key), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def news_id(url: Column) -> Column:
    """First 16 hex digits of sha1 of the trimmed address."""
    return F.substring(F.sha1(F.trim(url)), 1, 16)


def news_doc_id(url: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.lit("news:"), news_id(url))), 1, 16)


def synthetic_code(name: Column) -> Column:
    """Code of an organisation without a registered one."""
    return F.concat(F.lit("X"), F.upper(F.substring(hash16(F.lit("xorg"), name), 1, 7)))


def canonical_name(name: Column) -> Column:
    """Corporate forms removed, spaces squeezed; NULL gives an empty name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), CORPORATE_FORMS, ""), r"\s+", " "))


def own_name(name: Column) -> Column:
    """FIL4: a name without the forms and spaces that do not make it another company's."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), OWN_FORMS, "")


def aggressive_name(name: Column) -> Column:
    """Canonical name without any non-word character, lower case (Unicode word characters)."""
    return F.lower(F.regexp_replace(canonical_name(name), r"(?U)[^\w]+", ""))


def holder_key(name: Column) -> Column:
    """Shareholder key without spaces and marks."""
    return F.regexp_replace(name, r"\s|㈜|\(주\)|\(특별계정\)|\(Co\)", "")


def parse_amount(raw: Column) -> Column:
    """Signed amount cut to a whole number; a triangle or minus in front, or brackets around, mean negative; dashes and any other text are NULL."""
    text = F.trim(raw)
    bare = F.regexp_replace(F.regexp_replace(text, r"^[△-]+", ""), "[, ]", "")
    bracketed = bare.rlike(r"^\(.*\)$")
    inner = F.when(bracketed, F.regexp_replace(bare, r"^\((.*)\)$", "$1")).otherwise(bare)
    whole = F.when(inner.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), inner.try_cast("double").cast("bigint"))
    return F.when(text.rlike(r"^[△-]") | bracketed, -whole).otherwise(whole)


def parse_rate(raw: Column) -> Column:
    """Number with '%' and ',' stripped."""
    return F.regexp_replace(F.trim(raw), "[%,]", "").try_cast("double")


def to_float(raw: Column) -> Column:
    """NULL for anything that is no number."""
    return F.trim(raw).try_cast("double")


def parse_date_loose(raw: Column) -> Column:
    """ISO text of a date that the text begins with (y.m.d, y/m/d or y-m-d), or that it is (yyyymmdd); NULL otherwise."""
    text = F.regexp_replace(F.regexp_replace(raw, "[./]", "-"), r"\s+", "")
    part = lambda i: F.regexp_extract(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})", i)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).when(part(1) != "", iso)


def format_time(raw: Column) -> Column:
    """6 or 8 digits with dashes, anything else as it is."""
    return F.when(raw.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))).when(raw.rlike(r"^\d{6}$"), F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2))).otherwise(raw)


def one_decimal(size: Column) -> Column:
    """A number of at least 0 with one decimal, rounded by its binary value: 1.25 is 1.2, 1.05 (a little more in binary) is 1.1.

    Against the tie of its tenth, 20 times the number is told exactly: 16 and 4 times it are exact, and so are the differences of near numbers.
    """

    def rounded(v: Column, tenths: Column) -> Column:
        return let((v * 16 - (tenths * 2 + 1)) + v * 4, lambda over: tenths.cast("bigint") + ((over > 0) | ((over == 0) & (tenths % 2 == 1))).cast("int"))

    shown = lambda n: F.concat(F.call_function("div", n, F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string"))
    return let(let(size.cast("double"), lambda v: let(F.floor(v * 10).cast("double"), lambda tenths: rounded(v, tenths))), shown)


def money_label(won: Column) -> Column:
    """PRJ8, S20: trillions with one decimal, hundred millions without (halves to even), else plain."""
    a, sign = F.abs(won), F.when(won < 0, "-").otherwise("")
    return F.when(won.isNull(), None).when(a >= 1e12, F.concat(sign, one_decimal(a / 1e12), F.lit("조"))).when(a >= 1e8, F.concat(sign, F.rint(a / 1e8).cast("bigint").cast("string"), F.lit("억"))).otherwise(F.concat(won.cast("bigint").cast("string"), F.lit("원")))


def change_percent(now: Column, before: Column) -> Column:
    """S21, WIN12: change against the absolute base; NULL when there is none or it is zero."""
    return F.when(before.isNotNull() & (before != 0), (now - before) / F.abs(before) * 100)


#: Marks without width and no-break spaces; brackets with Chinese characters; lines that are page numbers.
NO_WIDTH = "[\u200b\u200c\u200d\ufeff\u00a0]"
HANJA_BRACKETS = r"\(\s*[^()]*[一-鿿][^()]*\)"
PAGE_LINE = r"(?Ui)^\s*(?:-\s*)?(?:p\.?\s*)?\d{1,4}(?:\s*-)?\s*$"


def normal_text(text: Column) -> Column:
    """Marks without width, bracketed Chinese and page-number lines go; spaces and empty lines are squeezed; NULL gives an empty text."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), NO_WIDTH, ""), HANJA_BRACKETS, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: ~x.rlike(PAGE_LINE))
    t = F.array_join(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_tags(xml: Column) -> Column:
    """S26."""
    return F.trim(F.regexp_replace(F.regexp_replace(xml, r"<[^>]+>", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of Hangul, Latin letters and digits, case kept."""
    return F.regexp_extract_all(text, F.lit("[가-힣a-zA-Z0-9]+"), F.lit(0))


def word_match_rate(summary: Column, body: Column) -> Column:
    """Share of the summary's distinct tokens that the body holds."""
    own = F.array_distinct(tokens(summary))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, F.array_distinct(tokens(body)))) / F.size(own)).otherwise(0.0)


def token_difference(a: Column, b: Column) -> Column:
    """Jaccard distance of the distinct tokens."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    either = F.size(F.array_union(x, y))
    return F.when(either > 0, 1 - F.size(F.array_intersect(x, y)) / either).otherwise(0.0)


def is_blank(value: Column) -> Column:
    """Values that stand for nothing."""
    return value.isNull() | F.trim(value).isin("", "-", "—", "None", "null", "N/A")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """S32."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def broken(vector: Column) -> Column:
    """Places of a vector that are NULL or no number."""
    return F.size(F.filter(vector, lambda x: x.isNull() | F.isnan(x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NULL if a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def url_date(url: Column) -> Column:
    """Date in an address path, NULL if none is valid."""
    y, m, d = (F.regexp_extract(url, r"(20\d{2})[/\-]?(\d{2})[/\-]?(\d{2})", i) for i in (1, 2, 3))
    return F.when(y != "", F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd"))


def alias_forms(name: Column) -> Column:
    """Default alias forms of a name, distinct, in order."""
    bare = canonical_name(name)
    forms = F.array(name, bare, F.regexp_replace(bare, r"\s+", ""), F.concat(F.lit("㈜"), bare), F.concat(bare, F.lit("(주)")))
    return F.array_distinct(F.filter(forms, lambda x: F.length(x) > 0))


def node_kind(node: Column, is_seed: Column, has_code: Column | None = None) -> Column:
    """PRJ6: kind of a node by its id: seed, person, product, organisation (8 digits), else news entity, else organisation.

    Where it is known whether the node has a company's code, those that have one are organisations first, and what the id does not tell is a news entity.
    """
    kind = F.when(is_seed, "seed")
    kind = kind if has_code is None else kind.when(has_code, "org")
    kind = kind.when(node.startswith("news:per"), "person").when(node.startswith("news:prod"), "product")
    return kind.when(node.rlike(r"^\d{8}$"), "org").when(node.startswith("news:"), "news_entity").otherwise("org" if has_code is None else "news_entity")


def noisy_surface(text: Column) -> Column:
    """FIL10: shorter than 2 or longer than 40, without a letter, or one pattern three times."""
    return (F.length(text) < 2) | (F.length(text) > 40) | ~text.rlike(r"(?U)\p{L}") | text.rlike(r"(.{1,10})\1{2,}")
