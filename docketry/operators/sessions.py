"""Sessions in batch form: facts, evidence, ledgers, corrections, candidates for the next question, evidence packs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators.joins import bounded

VERSION_KEY = ["session_id", "fact_id", "condition_id", "definition_version", "mapper_version", "text_version"]


def initial_facts(sessions: DataFrame, facts: DataFrame) -> DataFrame:
    """facts with the initial query as fact of turn 0 for sessions without any."""
    empty = sessions.join(facts.select("session_id").distinct(), "session_id", "left_anti")
    return facts.unionByName(empty.select("session_id", F.lit(0).cast("long").alias("fact_id"), F.col("initial_query").alias("text"), F.lit(0).cast("long").alias("turn")))


def delta_pairs(facts: DataFrame, conditions: DataFrame, ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pairs of a session's facts and conditions that its ledger lacks under the same versions, without corrected facts."""
    pairs = facts.join(conditions, "session_id").join(ledger.select(*VERSION_KEY), VERSION_KEY, "left_anti")
    whole = corrections.where("condition_id is null").select("session_id", "fact_id").distinct()
    part = corrections.where("condition_id is not null").select("session_id", "fact_id", "condition_id").distinct()
    return pairs.join(whole, ["session_id", "fact_id"], "left_anti").join(part, ["session_id", "fact_id", "condition_id"], "left_anti")


def merge_evidence(prior: DataFrame, new: DataFrame, corrected: DataFrame) -> DataFrame:
    """Evidence per (session, condition, fact): new wins over prior, corrected facts' prior evidence goes."""
    old = prior.join(corrected.select("session_id", "fact_id").distinct(), ["session_id", "fact_id"], "left_anti").withColumn("p", F.lit(0))
    both = old.unionByName(new.withColumn("p", F.lit(1)))
    w = Window.partitionBy("session_id", "condition_id", "fact_id").orderBy(F.desc("p"), F.desc("turn"), F.desc("confidence"))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "p")


def states(evidence: DataFrame) -> DataFrame:
    """State of each (session, condition) by its newest turn with directional evidence; a split newest turn conflicts."""
    directed = evidence.where(F.col("relation").isin("SUPPORTS", "OPPOSES"))
    last = F.max("turn").over(Window.partitionBy("session_id", "condition_id"))
    newest = directed.withColumn("last", last).where("turn = last").groupBy("session_id", "condition_id").agg(
        F.bool_or(F.col("relation") == "SUPPORTS").alias("yes"), F.bool_or(F.col("relation") == "OPPOSES").alias("no"), F.max("confidence").alias("c"), F.max("turn").alias("last_updated_turn"))
    known = newest.select("session_id", "condition_id", F.when(F.col("yes") & F.col("no"), "CONFLICTING").when(F.col("yes"), "SATISFIED").otherwise("NOT_SATISFIED").alias("status"),
        F.when(F.col("yes") & F.col("no"), F.least(F.lit(0.7), "c")).otherwise(F.col("c")).alias("confidence"), "last_updated_turn")
    rest = evidence.select("session_id", "condition_id").distinct().join(known, ["session_id", "condition_id"], "left_anti")
    return known.unionByName(rest.select("*", F.lit("UNKNOWN").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("last_updated_turn")))


def accept_links(links: DataFrame, facts: DataFrame, delta: DataFrame) -> DataFrame:
    """Evidence links (session_id, condition_id, quote, relation, confidence, pos) whose quote stands in exactly one fact and whose pair is due."""
    legal = links.where(F.col("relation").isin("SUPPORTS", "OPPOSES", "QUALIFIES") & (F.length(F.trim("quote")) > 0))
    met = legal.join(facts.select("session_id", "fact_id", "text", "turn"), "session_id").where(F.col("text").contains(F.col("quote")))
    one = met.withColumn("n", F.count("*").over(Window.partitionBy("session_id", "condition_id", "pos"))).where("n = 1")
    due = one.join(delta.select("session_id", "fact_id", "condition_id").distinct(), ["session_id", "fact_id", "condition_id"], "left_semi")
    last = F.row_number().over(Window.partitionBy("session_id", "condition_id", "fact_id").orderBy(F.desc("pos")))
    out = due.withColumn("rn", last).where("rn = 1")
    return out.select("session_id", "condition_id", "fact_id", "relation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), "turn")


def ledger_rows(delta: DataFrame, accepted: DataFrame) -> DataFrame:
    """What the ledger gains: every due pair, mapped or without relevant evidence."""
    hit = accepted.select("session_id", "fact_id", "condition_id").distinct().withColumn("hit", F.lit(True))
    return delta.join(hit, ["session_id", "fact_id", "condition_id"], "left").select(*VERSION_KEY, F.when(F.col("hit"), "MAPPED").otherwise("NO_RELEVANT_EVIDENCE").alias("outcome"))


# Answers without a fact.
UNABLE, DECLINED = "不知道|不清楚|不确定|记不清|don't know|not sure", "不想说|拒绝回答|不方便|rather not|decline"


def disposition(answer: Column) -> Column:
    """UNABLE, DECLINED, MIXED (with facts beside it) or FACTS_PROVIDED."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    rest = F.length(F.regexp_replace(F.regexp_replace(text, f"{UNABLE}|{DECLINED}", ""), r"[\s,.，。、!！?？]", ""))
    none = text.rlike(UNABLE) | text.rlike(DECLINED)
    return F.when(none & (rest > 6), "MIXED").when(text.rlike(UNABLE), "UNABLE").when(text.rlike(DECLINED), "DECLINED").otherwise("FACTS_PROVIDED")


def effective_facts(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Facts without fully corrected ones, each with the conditions for which it is inactive."""
    by = corrections.groupBy("session_id", "fact_id").agg(F.bool_or(F.col("condition_id").isNull()).alias("gone"), F.array_sort(F.collect_set("condition_id")).alias("inactive"))
    out = facts.join(by, ["session_id", "fact_id"], "left").where(~F.coalesce("gone", F.lit(False)))
    return out.withColumn("inactive", F.coalesce(F.array_join(F.transform("inactive", lambda x: x.cast("string")), ","), F.lit(""))).drop("gone")


def drop_corrected(ledger: DataFrame, corrections: DataFrame) -> DataFrame:
    """The ledger without rows that a correction touches; a correction without condition touches all of its fact's."""
    whole = corrections.where("condition_id is null").select("session_id", "fact_id").distinct()
    part = corrections.where("condition_id is not null").select("session_id", "fact_id", "condition_id").distinct()
    return ledger.join(whole, ["session_id", "fact_id"], "left_anti").join(part, ["session_id", "fact_id", "condition_id"], "left_anti")


def merge_drafts(drafts: DataFrame) -> DataFrame:
    """Missing-fact drafts (session_id, description, condition_ids, strictness) merged by description without white space."""
    key = F.regexp_replace("description", r"(?U)\s+", "")
    return drafts.groupBy("session_id", key.alias("key")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("condition_ids")))), ",").alias("condition_ids"), F.min("strictness").alias("strictness"), F.count("*").alias("n"))


def candidates(conditions: DataFrame) -> DataFrame:
    """conditions (session_id, condition_id, rule_rank, status, core, diagnostic, core_open, split, asked, answerable) -> best (tier, rule rank) each."""
    tier = F.when((F.col("status") == "CONFLICTING") | (F.col("core") & F.col("core_open")), 0).when(F.col("split"), 1).when(F.col("diagnostic"), 2)
    open_ = conditions.where("not asked and answerable and status in ('UNKNOWN', 'CONFLICTING')").withColumn("tier", tier).where("tier is not null")
    return open_.groupBy("session_id", "condition_id").agg(F.min(F.struct("tier", "rule_rank")).alias("b")).select("session_id", "condition_id", "b.tier", "b.rule_rank")


def next_questions(found: DataFrame, cards: DataFrame) -> DataFrame:
    """The first candidate with a card of each session, and its utility 1 / (tier + 1)."""
    w = Window.partitionBy("session_id").orderBy("tier", "rule_rank", "condition_id")
    first = found.join(cards.select("condition_id").distinct(), "condition_id", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return first.select("session_id", "condition_id", "tier", F.round(1 / (F.col("tier") + 1), 6).alias("utility"))


def pack(items: DataFrame, budget: int) -> DataFrame:
    """items (session_id, pos, size) -> those that a greedy pack in order takes: an item that is too large is skipped, later ones may fit."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used, taken = pdf.sort_values("pos"), 0, []
        for size in pdf["size"]:
            fits = used + size <= budget
            used += size if fits else 0
            taken.append(fits)
        return pdf.assign(taken=taken)[["session_id", "pos", "size", "taken"]]

    return items.groupBy("session_id").applyInPandas(greedy, "session_id long, pos long, size long, taken boolean")


def calibrate(samples: DataFrame) -> DataFrame:
    """samples (dataset, score, hit) -> bins (dataset, score, value): smoothed rates pooled until they rise. Only distinct scores reach a group."""
    scores = samples.groupBy("dataset", "score").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for score, n, hits in pdf.sort_values("score")[["score", "n", "hits"]].itertuples(index=False):
            blocks.append([score, n + 2, hits + 1])
            while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] > blocks[-1][2] / blocks[-1][1]:
                upper, n_, h_ = blocks.pop()
                blocks[-1] = [upper, blocks[-1][1] + n_, blocks[-1][2] + h_]
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "score": [b[0] for b in blocks], "value": [b[2] / b[1] for b in blocks]})

    return scores.groupBy("dataset").applyInPandas(pooled, "dataset string, score double, value double")


def calibrated(scores: DataFrame, bins: DataFrame) -> DataFrame:
    """Each score's value: of the first bin that is not below it, else of the last."""
    met = scores.join(bounded(bins.withColumnRenamed("score", "edge")), "dataset")
    above = F.min(F.when(F.col("edge") >= F.col("score"), F.struct("edge", "value")))
    return met.groupBy("dataset", "id", "score").agg(F.coalesce(above["value"], F.max(F.struct("edge", "value"))["value"]).alias("value"))


# Words of intent and of supposition, and negations that may stand before a phrase.
INTENT = ["想", "希望", "打算", "准备", "想要", "要求"]
SUPPOSED = ["如果", "若", "假如", "要是"]
NEGATED = r"(?:没有|并非|不是|未|不曾|没)\s*"


def lexical_evidence(facts: DataFrame, phrases: DataFrame) -> DataFrame:
    """facts (session_id, fact_id, text), phrases (condition_id, relation, pos, phrase) -> (session_id, fact_id, condition_id, relation, confidence .58, phrase).

    Sentences of intent or supposition don't count. Of a condition's phrases of either relation the longest that the rest holds counts, of equal ones the first by pos.
    Where both relations have one, an opposing phrase that wraps every occurrence of the supporting one wins, else neither says anything; a supporting phrase with a
    negation right before any of its occurrences says nothing.
    """
    sentences = F.filter(F.split("text", "[。！？!?；;\n]+"), lambda s: ~s.rlike("|".join(INTENT + SUPPOSED)))
    said = facts.where("text is not null").select("session_id", "fact_id", F.array_join(sentences, "。").alias("t"))
    met = said.join(bounded(phrases.where("length(phrase) > 0")), F.col("t").contains(F.col("phrase")))
    longest = F.struct(-F.length("phrase"), "pos")
    best = met.groupBy("session_id", "fact_id", "t", "condition_id").agg(*(F.min_by(F.when(F.col("relation") == r, F.col("phrase")), F.when(F.col("relation") == r, longest)).alias(n) for r, n in (("SUPPORTS", "s"), ("OPPOSES", "o"))))
    wrapped = F.col("o").contains(F.col("s")) & ~F.replace("t", "o", F.lit("")).contains(F.col("s"))
    best = best.where(F.col("s").isNull() | F.col("o").isNull() | wrapped)
    denied = F.rlike(F.col("t"), F.concat(F.lit(NEGATED + r"\Q"), F.col("s"), F.lit(r"\E")))
    best = best.where(F.col("o").isNotNull() | ~denied)
    return best.select("session_id", "fact_id", "condition_id", F.when(F.col("o").isNotNull(), "OPPOSES").otherwise("SUPPORTS").alias("relation"), F.lit(0.58).alias("confidence"), F.coalesce("o", "s").alias("phrase"))


# Marks of a correction, of what it speaks of, and the conditions of payment and of the unperformed rest.
CORRECTS, REFUNDED, OF_BALANCE = "说错了|更正|纠正|改成|应为|其实是|应该是", "已退款|已退|退了|退还了", "余额|剩余|未消费"
OF_AMOUNT, OF_MONEY, NUMBER = "金额|元|交了|付了|付的|费用", "元|交了|付了|付的|支付|付款|充了|金额|费用", r"(\d+(?:\.\d+)?)\s*元?"
PAID, BALANCE = "cond.payment_made", "cond.unperformed_balance"


def correction_targets(answers: DataFrame, facts: DataFrame, links: DataFrame) -> DataFrame:
    """(session_id, fact_id, condition_id): the one fact that a session's answer explicitly corrects, and for which condition; no row where it is not certain.

    answers (session_id, condition_id, answer), one a session; facts (session_id, fact_id, text); links (session_id, condition_id, fact_id), the evidence so far.
    An answer needs a mark of correction and may not speak of refunds; one of a balance is about the unperformed rest. A corrected amount hits facts with another amount: among those linked
    to payment (or the balance), if there are none among those linked to the asked condition, and if none of these differs, and no balance is meant, among all that speak of money. Any other correction hits what is linked
    to its condition. Just one such fact makes a target.
    """
    marked = answers.where(F.col("answer").rlike(CORRECTS) & ~F.col("answer").rlike(REFUNDED)).withColumn("balance", F.col("answer").rlike(OF_BALANCE))
    amounts = F.regexp_extract_all("answer", F.lit(NUMBER), F.lit(1))
    asked = marked.select("session_id", F.when(F.col("balance"), BALANCE).otherwise(F.col("condition_id")).alias("condition_id"), "balance", amounts.alias("new"), ((F.size(amounts) > 0) & F.col("answer").rlike(OF_AMOUNT)).alias("money"))
    own = facts.join(asked, "session_id").withColumn("old", F.regexp_extract_all("text", F.lit(NUMBER), F.lit(1)))
    evidence = links.groupBy("session_id", "fact_id").agg(F.collect_set("condition_id").alias("of"))
    own = own.join(evidence, ["session_id", "fact_id"], "left").withColumn("of", F.coalesce("of", F.array().cast("array<string>")))
    differs = F.size(F.array_except("old", "new")) > 0
    paid = F.when(F.col("balance"), F.array_contains("of", BALANCE)).otherwise(F.array_contains("of", PAID))
    session = Window.partitionBy("session_id")
    own = own.withColumns({"linked": F.array_contains("of", F.col("condition_id")), "paid": paid}).withColumn("some_paid", F.max("paid").over(session))
    first = F.when(~F.col("money"), F.col("linked")).otherwise(differs & F.when(F.col("some_paid"), F.col("paid")).otherwise(F.col("linked")))
    own = own.withColumn("first", first).withColumn("some", F.max("first").over(session))
    hit = own.where(F.col("first") | (~F.col("some") & F.col("money") & ~F.col("balance") & differs & F.col("text").rlike(OF_MONEY)))
    about = F.when(F.bool_or("money") & ~F.bool_or("balance"), PAID).otherwise(F.min("condition_id"))
    return hit.groupBy("session_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("fact_id"), about.alias("condition_id")).where("n = 1").drop("n")


def merge_answers(facts: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with accepted ones, rejected rows): a new fact (session_id, quote, answer, turn) must be quoted from its answer; ids follow the last."""
    fine = F.coalesce(F.col("answer").contains(F.col("quote")), F.lit(False)) & (F.length(F.trim("quote")) > 0)
    last = facts.groupBy("session_id").agg(F.max("fact_id").alias("last"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "quote")).cast("long")
    new = answers.where(fine).join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(-1)) + number).cast("long").alias("fact_id"), F.col("quote").alias("text"), "turn")
    return facts.unionByName(new), answers.where(~fine)


# Answers that say nothing, as far as the history of questions goes.
EMPTY_ANSWERS = ["", "不清楚", "不知道", "不了解", "不确定", "说不清", "暂不回答"]


def history_guard(asked: DataFrame, answers: DataFrame, refusals: DataFrame, states: DataFrame) -> DataFrame:
    """asked (session_id, condition_id, turn) -> with outcome: may the question be asked at that turn?

    answers (session_id, condition_id, turn, answer) and refusals (session_id, condition_id, turn, kind UNABLE or DECLINED) count up to the asking turn, and the last
    answer alone counts (an as-of join: all rows of a session and condition are laid in one order of turns). states (session_id, condition_id, status, n_evidence).
    In this order: USER_UNABLE, USER_DECLINED, ALREADY_ANSWERED if the last answer says something, ALREADY_EVIDENCED if the state is decided on evidence, else MISSING.
    """
    key = ["session_id", "condition_id"]
    none = F.lit(None).cast("string")
    rows = answers.where("answer is not null").select(*key, "turn", F.trim("answer").alias("answer"), none.alias("kind"), F.lit(0).alias("asks"))
    rows = rows.union(refusals.select(*key, "turn", none, "kind", F.lit(0))).union(asked.select(*key, "turn", none, none, F.lit(1)))
    so_far = Window.partitionBy(*key).orderBy("turn", "asks", "answer").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"last": F.last("answer", ignorenulls=True).over(so_far), "unable": F.max(F.col("kind") == "UNABLE").over(so_far), "declined": F.max(F.col("kind") == "DECLINED").over(so_far)})
    met = seen.where("asks = 1").join(states.select(*key, "status", "n_evidence"), key, "left")
    decided = F.col("status").isin("SATISFIED", "NOT_SATISFIED") & (F.col("n_evidence") > 0)
    outcome = (
        F.when(F.col("unable"), "USER_UNABLE").when(F.col("declined"), "USER_DECLINED").when(~F.col("last").isin(EMPTY_ANSWERS), "ALREADY_ANSWERED").when(decided, "ALREADY_EVIDENCED").otherwise("MISSING")
    )
    return met.select(*key, "turn", outcome.alias("outcome"))


def turn_audit(sessions: DataFrame, turns: DataFrame, snapshots: DataFrame, facts: DataFrame, states: DataFrame) -> DataFrame:
    """(session_id, turn, issue, n): what the snapshot after a turn may not do to the one before it.

    sessions (session_id, initial_query); turns (session_id, turn, answer); snapshots (session_id, turn, initial_query, history array of answers);
    facts (session_id, turn, fact_id, text, source_turn) and states (session_id, turn, condition_id, status, n_facts) of each snapshot. Issues:
    protected_changed: another initial query, or a history that doesn't begin with that of the snapshot before; fact_changed: facts of the snapshot before that are
    gone or differ; fact_unquoted: new facts that don't stand in the initial query (source turn 0) or in their turn's answer; state_unreferenced: decided states without facts.
    Every snapshot is joined with the one before it alone, on (session, turn).
    """
    before = F.lag("turn").over(Window.partitionBy("session_id").orderBy("turn"))
    shots = snapshots.withColumn("prior", before)
    steps = shots.select("session_id", "turn", "prior")
    old = snapshots.select("session_id", F.col("turn").alias("prior"), F.col("history").alias("old"))
    kept = F.col("old").isNull() | (F.slice("history", F.lit(1), F.size("old")) == F.col("old"))
    protected = shots.join(old, ["session_id", "prior"], "left").join(sessions.select("session_id", F.col("initial_query").alias("q")), "session_id", "left")
    protected = protected.where(~(F.col("initial_query").eqNullSafe(F.col("q")) & F.coalesce(kept, F.lit(False)))).select("session_id", "turn", F.lit("protected_changed").alias("issue"))
    earlier = steps.where("prior is not null").join(facts.select("session_id", F.col("turn").alias("prior"), "fact_id", F.struct("text", "source_turn").alias("was")), ["session_id", "prior"])
    now = facts.select("session_id", "turn", "fact_id", F.struct("text", "source_turn").alias("is"))
    changed = earlier.join(now, ["session_id", "turn", "fact_id"], "left").where(~F.col("was").eqNullSafe(F.col("is"))).select("session_id", "turn", F.lit("fact_changed"))
    new = facts.join(earlier.select("session_id", "turn", "fact_id"), ["session_id", "turn", "fact_id"], "left_anti")
    said = turns.select("session_id", F.col("turn").alias("source_turn"), "answer")
    source = F.when(F.col("source_turn") == 0, F.col("initial_query")).otherwise(F.col("answer"))
    quoted = new.join(sessions, "session_id", "left").join(said, ["session_id", "source_turn"], "left").where(~F.coalesce(source.contains(F.col("text")), F.lit(False))).select("session_id", "turn", F.lit("fact_unquoted"))
    bare = states.where((F.col("status") != "UNKNOWN") & (F.coalesce("n_facts", F.lit(0)) == 0)).select("session_id", "turn", F.lit("state_unreferenced"))
    return protected.union(changed).union(quoted).union(bare).groupBy("session_id", "turn", "issue").agg(F.count("*").alias("n"))
