"""Column expressions over text: tokens, white-space-free keys, numerals, citations, amounts, parties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[一-鿿]"
TOKEN = rf"([0-9A-Za-z_]+|{HAN})"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII word characters, single Han characters, then bigrams of neighbouring Han characters.

    Bigrams are taken over the Han characters alone, so that they span punctuation and Latin words.
    """
    single = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 1)
    han = F.filter(single, lambda c: c.rlike(f"^{HAN}$"))
    pairs = F.zip_with(F.slice(han, F.lit(1), F.greatest(F.size(han) - 1, F.lit(0))), F.slice(han, F.lit(2), F.greatest(F.size(han) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.concat(single, F.when(F.size(han) > 1, pairs).otherwise(F.array().cast("array<string>")))


def compact(text: Column) -> Column:
    """Text without any Unicode white space: the key by which texts count as equal."""
    return F.regexp_replace(text, r"(?U)\s+", "")


# Fixed values of the numeral system and of the civil code (1,260 articles).
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
LAST_ARTICLE = 1260


def han_integer(text: Column) -> Column:
    """Value of a Chinese numeral below ten thousand; null for anything else."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def add(state: Column, c: Column) -> Column:
        digit, unit = F.lit(0), F.lit(1)
        for name, value in DIGITS.items():
            digit = F.when(c == name, F.lit(value)).otherwise(digit)
        for name, value in UNITS.items():
            unit = F.when(c == name, F.lit(value)).otherwise(unit)
        lone = F.when(state["digit"] == 0, F.lit(1)).otherwise(state["digit"])
        return F.when(unit > 1, F.struct((state["total"] + lone * unit).alias("total"), F.lit(0).alias("digit"))).otherwise(F.struct(state["total"].alias("total"), digit.alias("digit")))

    value = F.aggregate(F.split(text, ""), start, add, lambda s: s["total"] + s["digit"])
    return F.when(F.coalesce(text, F.lit("")).rlike(f"^[{''.join([*DIGITS, *UNITS])}]+$") & (value > 0), value)


def article_number(raw: Column) -> Column:
    """Article number of strings such as 第五百六十三条 or 563; null outside the code."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "^第|[条款项].*$", ""), " ", "")
    number = F.when(bare.rlike(r"^\d+$"), bare.cast("int")).otherwise(han_integer(bare))
    return F.when(number.between(1, LAST_ARTICLE), number)


# A statute name counts as the civil code if it has the first and none of the others.
CODE, NOT_CODE = "民法典", ("解释", "规定", "指导", "批复", "纪要", "意见", "通知")
CITATION = r"(?:《中华人民共和国民法典》|中华人民共和国民法典|民法典)第([零〇一二三四五六七八九十百千两0-9]+)条"


def is_civil_code(name: Column) -> Column:
    return name.contains(CODE) & ~name.rlike("|".join(NOT_CODE))


def provision_id(number: Column) -> Column:
    return F.concat(F.lit("provision."), F.lpad(number.cast("string"), 4, "0"))


def cited_provisions(text: Column) -> Column:
    """Sorted distinct provision ids of the articles that a text cites together with the code's name."""
    numbers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), 1)
    ids = F.transform(numbers, lambda a: provision_id(article_number(a)))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


# Fixed value: an amount with half- or full-width grouping and 万 or 亿.
AMOUNT = r"(?<![\d.,，．])(?:人民币)?((?:\d{1,3}(?:[,，]\d{3})+|\d+)(?:[.．]\d+)?)\s*(万|亿)?元"


def amount(text: Column) -> Column:
    """The first money amount of a text, in yuan; null if none."""
    number = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, AMOUNT, 1), "[,，]", ""), "．", ".")
    unit = F.regexp_extract(text, AMOUNT, 2)
    scale = F.when(unit == "万", 10_000).when(unit == "亿", 100_000_000).otherwise(1)
    return F.when(number != "", (number.cast("decimal(24,6)") * scale).cast("double"))


def date(text: Column) -> Column:
    """The first year-month-day of a text; null if there is none or it is no date."""
    pattern = r"(\d{4})[.年/-](\d{1,2})[.月/-](\d{1,2})"
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts), "y-M-d"))


def heading(text: Column) -> Column:
    """A heading without spaces but for one between 第…编/章/节 and its name; empty is null."""
    bare = compact(text)
    spaced = F.regexp_replace(bare, r"^(第.+?(?:分编|编|章|节))(.+)$", "$1 $2")
    return F.nullif(spaced, F.lit(""))


def case_id(given: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.concat(F.lit("case."), F.substring(F.sha1(title), 1, 12)))


def sections(markdown: Column) -> Column:
    """Map of `## heading` to its body; of equal headings the last wins."""
    parts = F.split(F.concat(F.lit("\n"), markdown), r"\n##[ \t]+")
    bodies = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda p: F.regexp_replace(F.when(F.instr(p, "\n") > 0, F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(""), r"(?U)^\s+|\s+$", "")
    pairs = F.transform(bodies, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("k"), body(p).alias("v")))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


SENTENCE = r"([^。；\n]+[。；]?)"
HOLDING = r"(?:人民法院|法院)[^。\n]{0,80}?(?:作出|做出)[^。\n]{0,80}?判决[：:，,]|(?:作出|做出)[^。\n]{0,80}?判决[：:，,]|(?:判决|判决如下)[：:]"


def court_sentences(text: Column) -> Column:
    """Sentences of at least 8 characters that end in a stop and are no holding."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), 1), lambda s: F.trim(s))
    return F.filter(found, lambda s: (F.length(s) >= 8) & s.rlike("[。；]$") & ~s.rlike(HOLDING) & ~s.contains("民事判决"))


def numbered_items(text: Column) -> Column:
    """Items that begin a line with a number and a stop, each up to the next; at least 8 characters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?ms)(^\s*\d+\.\s+.*?)(?=^\s*\d+\.\s+|\z)"), 1)
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: F.length(s) >= 8)


def parties(title: Column, has_plaintiff: Column, has_defendant: Column) -> tuple[Column, Column]:
    """Claimant and respondent of a title 甲诉乙…案; generic names if a statement shows that there is one."""
    claimant = F.nullif(F.trim(F.regexp_extract(title, "^(.+?)诉(.+)案$", 1)), F.lit(""))
    other = F.trim(F.regexp_replace(F.regexp_extract(title, "^(.+?)诉(.+)案$", 2), "(服务合同纠纷|合同纠纷|纠纷)$", ""))
    respondent = F.nullif(other, F.lit(""))
    return F.coalesce(claimant, F.when(has_plaintiff, F.lit("原告"))), F.coalesce(respondent, F.when(has_defendant, F.lit("被告")))


def anchored(document: Column, quote: Column, region_start: Column, region_end: Column) -> Column:
    """Right-open code-point span of a quote: inside the region if there, else in the document; null if nowhere."""
    at = F.instr(document.substr(region_start + 1, region_end - region_start), quote)
    whole = F.instr(document, quote)
    start = F.when(at > 0, region_start + at - 1).when(whole > 0, whole - 1)
    return F.when(start.isNotNull() & (F.length(quote) > 0), F.struct(start.cast("int").alias("start_offset"), (start + F.length(quote)).cast("int").alias("end_offset")))
