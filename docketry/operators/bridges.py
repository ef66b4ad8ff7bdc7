"""States of six conditions from what a judgment says: cues over its findings, then its reasoning, then its holding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import SENTENCE

# The cues of each condition.
CONTRACT = r"签订.{0,20}(协议|合同)"
PAYMENT = (
    r"(支付|交纳|缴纳|付款).{0,24}(会籍|私教|会员|服务费|课程|服务|培训费|旅游费|团费)|(会籍|私教|会员|服务费|课程|培训费|旅游费|团费).{0,16}(支付|交纳|缴纳|付款)|"
    r"出具.{0,16}收据|收据.{0,40}(金额|元)"
)
RECOGNISED = r"交纳的.{0,12}(会籍|课程|服务)?费用|已支付|已经支付"
OTHER_FEE = "维修费|停车管理费"
IMPOSSIBLE, STILL_OPEN = "关闭|闭店|撤离|无法提供|不能提供|停止营业|相继关闭|未正式开业", "正常营业|继续提供|仍可提供"
UNPERFORMED = r"剩余|未消费|未履行|未使用|未开始上课|尚有\d+次课|尚有.{0,8}次课"
ALTERNATIVE, TOO_FAR, REFUSED = r"转让|安置|另一.{0,8}(会所|门店)|替代", "距离较远|不便于", r"距离较远|不便于|未经.{0,8}同意"
TERMINATED = r"解除.{0,20}(协议|合同)"
FACTS, REASONS, RESULT = "基本案情", "裁判理由", "裁判结果"
ANY = "|".join([CONTRACT, PAYMENT, OTHER_FEE, IMPOSSIBLE, STILL_OPEN, UNPERFORMED, ALTERNATIVE, REFUSED])


def first(sentences: Column, cue: str) -> Column:
    return F.get(F.filter(sentences, lambda s: s.rlike(cue)), F.lit(0))


def outcome(status: str, quote: Column, confidence: float, section: str | None) -> Column:
    return F.struct(F.lit(status).alias("status"), quote.cast("string").alias("quote"), F.lit(confidence).alias("confidence"), F.lit(section).cast("string").alias("section"))


def cascade(*steps: tuple[str, Column, float, str]) -> Column:
    """The first step with a quote, else UNKNOWN at .3."""
    out = outcome("UNKNOWN", F.lit(None), 0.3, None)
    for status, quote, confidence, section in reversed(steps):
        out = F.when(quote.isNotNull(), outcome(status, quote, confidence, section)).otherwise(out)
    return out


def condition_states(cases: DataFrame) -> DataFrame:
    """cases (case_id, sentences array, reasoning, holding) -> six rows each: (case_id, condition, status, confidence, section, quote).

    sentences are the court's findings in order. A condition takes its first matching sentence; payment and the unperformed rest fall back to the
    reasoning, with less confidence, but findings that speak of repair or parking fees alone leave payment open. An alternative that was refused or too far is NOT_SATISFIED;
    one merely offered stays UNKNOWN at .4. One alternation of all cues picks the sentences that any rule can use, so that each
    text is scanned once; there is no join and no shuffle. Null sentences, reasoning and holding count as empty.
    """
    hits = F.filter(F.coalesce("sentences", F.array().cast("array<string>")), lambda s: s.rlike(ANY))
    reasons = F.filter(F.transform(F.regexp_extract_all(F.coalesce("reasoning", F.lit("")), F.lit(SENTENCE), 1), lambda s: F.trim(s)), lambda s: s.rlike(f"{PAYMENT}|{RECOGNISED}|{UNPERFORMED}"))
    held = cases.select("case_id", hits.alias("f"), reasons.alias("r"), F.trim(F.coalesce("holding", F.lit(""))).alias("h"))
    f, r, h = F.col("f"), F.col("r"), F.col("h")
    recognised = F.when(first(f, OTHER_FEE).isNull(), first(r, f"{PAYMENT}|{RECOGNISED}"))
    rows = {
        "contract_exists": cascade(("SATISFIED", first(f, CONTRACT), 0.7, FACTS)),
        "payment_made": cascade(("SATISFIED", first(f, PAYMENT), 0.7, FACTS), ("SATISFIED", recognised, 0.55, REASONS)),
        "performance_impossible": cascade(("SATISFIED", first(f, IMPOSSIBLE), 0.7, FACTS), ("NOT_SATISFIED", first(f, STILL_OPEN), 0.65, FACTS)),
        "unperformed_balance": cascade(("SATISFIED", first(f, UNPERFORMED), 0.65, FACTS), ("SATISFIED", first(r, UNPERFORMED), 0.55, REASONS)),
        "alternative_performance": cascade(("NOT_SATISFIED", F.coalesce(first(f, TOO_FAR), first(f, REFUSED)), 0.65, FACTS), ("UNKNOWN", first(f, ALTERNATIVE), 0.4, FACTS)),
        "contract_terminated": cascade(("SATISFIED", F.when(h.rlike(TERMINATED), h), 0.6, RESULT)),
    }
    listed = F.array(*[F.struct(F.lit(name).alias("condition"), x.alias("x")) for name, x in rows.items()])
    return held.select("case_id", F.explode(listed).alias("c")).select("case_id", "c.condition", "c.x.status", "c.x.confidence", "c.x.section", "c.x.quote")
