"""Validators of record, case, rule and sample sets, of drafts, and scoring of runs: each gives a table of issues or flags, keyed by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions import text as T
from docketry.operators.joins import bounded, dealt
from docketry.sources.tables import written


def flagged(rows: DataFrame, key: list[str], issues: dict[str, Column]) -> DataFrame:
    """(key, issue) for each issue whose condition holds in a row."""
    found = F.filter(F.array(*[F.when(when, F.lit(name)) for name, when in issues.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(found).alias("issue"))


def record_issues(provisions: DataFrame, sources: DataFrame, cases: DataFrame) -> DataFrame:
    """(kind, id, issue): provisions (provision_id, source_id, article_no, text) of unknown source, whose id is not their source's and number's, or without text; cases (case_id, facts, reasoning) without any text."""
    held = provisions.join(sources.select("source_id", F.lit(True).alias("known")).distinct(), "source_id", "left")
    wanted = F.concat("source_id", F.lit(".article_"), F.lpad("article_no", F.greatest(F.length("article_no"), F.lit(4)), F.lit("0")))
    blank = lambda c: F.coalesce(T.compact(F.col(c)), F.lit("")) == ""
    rows = held.select(F.lit("provision").alias("kind"), F.col("provision_id").cast("string").alias("id"), F.col("known").isNull().alias("u"), (F.col("article_no").rlike("^[0-9]+$") & (F.col("provision_id") != wanted)).alias("n"), blank("text").alias("e"))
    out = flagged(rows, ["kind", "id"], {"unknown_source": F.col("u"), "noncanonical_id": F.col("n"), "empty_text": F.col("e")})
    return out.union(cases.where(blank("facts") & blank("reasoning")).select(F.lit("case"), F.col("case_id").cast("string"), F.lit("empty_case_text")))


#: Fixed value: words of a premise or an exception.
PREMISE = "除外|方可|须经|必须|未经"


def premise_warnings(conditions: DataFrame, spans: DataFrame, cue: str = PREMISE) -> DataFrame:
    """(rule_id, condition_id, span_ids): diagnostic conditions (rule_id, condition_id, role, span_ids) whose source spans (span_id, quote) name a premise or an exception."""
    roles = conditions.groupBy("rule_id", "condition_id").agg(F.bool_and(F.col("role") == "DIAGNOSTIC").alias("only"), F.array_distinct(F.flatten(F.collect_list("span_ids"))).alias("span_ids"))
    said = roles.where("only").select("rule_id", "condition_id", F.explode("span_ids").alias("span_id")).join(spans.where(F.col("quote").rlike(cue)).select("span_id").distinct(), "span_id")
    return said.groupBy("rule_id", "condition_id").agg(F.array_join(F.array_sort(F.collect_set("span_id")), ",").alias("span_ids"))


def case_set_issues(light: DataFrame, deep: DataFrame, citations: DataFrame, findings: DataFrame, invoked: DataFrame, provisions: DataFrame, conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, issue, n) over light (case_id, facts, keywords), deep (case_id, maturity, reviewed), citations (case_id, provision_id), findings (case_id, condition_id, verified) and invoked rules (case_id, rule_id, claim_type).

    rules (rule_id, claim_type): a null claim_type takes claims of any type. A text counts as a duplicate without its white space; the smallest case of a text is its owner.
    """
    ids = light.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("duplicate_id").alias("issue"))
    ids = ids.union(deep.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", F.lit("duplicate_deep_id")))
    keyed = light.select("case_id", "keywords", F.coalesce(T.compact(F.col("facts")), F.lit("")).alias("bare"))
    out = ids.union(flagged(keyed, ["case_id"], {"empty_facts": F.col("bare") == "", "duplicate_keywords": F.size(F.array_distinct("keywords")) < F.size("keywords")}))
    sums = keyed.where("bare <> ''").select("case_id", F.sha2("bare", 256).alias("key"))
    owners = sums.groupBy("key").agg(F.min("case_id").alias("owner"), F.count("*").alias("k")).where("k > 1")
    out = out.union(sums.join(owners, "key").where("case_id <> owner").select("case_id", F.lit("duplicate_facts")))
    out = out.union(citations.join(bounded(provisions.select("provision_id").distinct()), "provision_id", "left_anti").select("case_id", F.lit("missing_provision")))
    out = out.union(deep.join(light.select("case_id").distinct(), "case_id", "left_anti").select("case_id", F.lit("not_in_index")))
    out = out.union(flagged(deep, ["case_id"], {"unreviewed_not_l1": ~F.col("reviewed") & (F.col("maturity") != "L1"), "reviewed_not_l2": F.col("reviewed") & (F.col("maturity") != "L2")}))
    out = out.union(findings.join(bounded(conditions.select("condition_id").distinct()), "condition_id", "left_anti").select("case_id", F.lit("unknown_condition")))
    out = out.union(findings.where("verified").join(deep.where("not reviewed").select("case_id").distinct(), "case_id").select("case_id", F.lit("machine_marked_verified")))
    met = invoked.join(bounded(rules.select("rule_id", F.col("claim_type").alias("wanted"), F.lit(True).alias("known"))), "rule_id", "left")
    out = out.union(flagged(met, ["case_id"], {"unknown_rule": F.col("known").isNull(), "claim_type_mismatch": F.coalesce(F.col("wanted") != F.col("claim_type"), F.lit(False))}))
    return out.groupBy("case_id", "issue").agg(F.count("*").alias("n"))


def rule_set_issues(conditions: DataFrame, members: DataFrame, rules: DataFrame, spans: DataFrame) -> DataFrame:
    """(rule_id, issue, n) over conditions (rule_id, condition_id), members (rule_id, group_id, role, condition_id), rules (rule_id, maturity, n_consequences, n_provisions) and their spans (rule_id, span_id, article_no, first, last).

    A condition is in one group exactly; a rule with conditions has a CORE group; an L3 rule has spans, provisions and consequences; spans lie within their book's articles.
    """
    own = conditions.groupBy("rule_id", "condition_id").agg(F.count("*").alias("k"))
    out = own.where("k > 1").select("rule_id", F.lit("duplicate_condition").alias("issue"))
    held = members.groupBy("rule_id", "group_id", "condition_id").agg(F.count("*").alias("k"))
    out = out.union(held.where("k > 1").select("rule_id", F.lit("repeated_member")))
    groups = held.groupBy("rule_id", "condition_id").agg(F.count("*").alias("groups"))
    met = own.join(groups, ["rule_id", "condition_id"], "full_outer")
    out = out.union(flagged(met, ["rule_id"], {"unassigned_condition": F.col("groups").isNull(), "unknown_member": F.col("k").isNull(), "several_groups": F.col("k").isNotNull() & (F.col("groups") > 1)}))
    core = members.where("role = 'CORE'").select("rule_id").distinct()
    out = out.union(own.select("rule_id").distinct().join(core, "rule_id", "left_anti").select("rule_id", F.lit("no_core_group")))
    whole = rules.join(spans.groupBy("rule_id").agg(F.count("*").alias("n_spans")), "rule_id", "left")
    lacks = (F.coalesce("n_spans", F.lit(0)) == 0) | (F.col("n_provisions") == 0) | (F.col("n_consequences") == 0)
    out = out.union(whole.where((F.col("maturity") == "L3") & lacks).select("rule_id", F.lit("incomplete_l3")))
    out = out.union(spans.where(~F.col("article_no").between(F.col("first"), F.col("last"))).select("rule_id", F.lit("outside_book")))
    return out.groupBy("rule_id", "issue").agg(F.count("*").alias("n"))


def sample_issues(samples: DataFrame) -> DataFrame:
    """(id, issue) of labelled samples (id, text, relations: map of label to arguments): ids that are no canonical UUID or occur twice, empty texts, texts that are equal but for white space (all but that of the smallest id), labels without arguments."""
    bare = F.coalesce(T.compact(F.col("text")), F.lit(""))
    rows = samples.select("id", bare.alias("bare"), F.coalesce(F.exists(F.map_values("relations"), lambda a: a.isNull() | (F.size(a) == 0)), F.lit(False)).alias("hollow"))
    uuid = F.coalesce(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))
    out = flagged(rows, ["id"], {"bad_uuid": ~uuid, "empty_text": F.col("bare") == "", "empty_arguments": F.col("hollow")})
    out = out.union(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id")))
    sums = rows.where("bare <> ''").select("id", F.sha2("bare", 256).alias("key"))
    owners = sums.groupBy("key").agg(F.min("id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    return out.union(sums.join(owners, "key").where("id <> owner").select("id", F.lit("duplicate_text")))


def corpus_counts(cases: DataFrame, labels: DataFrame, known: DataFrame, peers: DataFrame) -> DataFrame:
    """(name, n) of cases (id), their raw labels (id, label), known ids (id), and peers (id, n_peers) by trimmed labels.

    Blank labels count as raw ones only; a case without any other is unlabelled, and evaluable if it has a peer.
    """
    clean = labels.withColumn("clean", F.trim("label")).where("clean <> ''")
    per = cases.join(clean.select("id").distinct().withColumn("has", F.lit(True)), "id", "left").join(peers, "id", "left").join(known.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    n_peers = F.coalesce("n_peers", F.lit(0))
    by_case = per.agg(
        F.count("*").alias("cases"), F.count_if("known").alias("known_overlap"), F.count_if(F.col("has").isNull()).alias("unlabeled"),
        F.count_if(F.col("has") & (n_peers == 0)).alias("labeled_without_peer"), F.count_if(n_peers > 0).alias("evaluable"), F.coalesce(F.sum(n_peers), F.lit(0)).alias("directed_pairs"),
    )
    by_label = labels.agg(F.countDistinct("label").alias("raw_labels"), F.countDistinct(F.nullif(F.trim("label"), F.lit(""))).alias("labels"))
    return by_case.unpivot([], by_case.columns, "name", "n").union(by_label.unpivot([], by_label.columns, "name", "n"))


def frozen_issues(samples: DataFrame, refs: DataFrame, catalog: DataFrame, release: str, wanted: dict[str, int] | None = None) -> DataFrame:
    """(sample_id, issue, n) of a frozen set: samples (sample_id, category, release_id, expected, gold_fields), refs (sample_id, kind, id) into a catalog (kind, id).

    wanted: how many samples each category must have; a category that has others gives an issue without sample.
    """
    gold = ["expected_action", "acceptable_missing_facts", "forbidden_reasks", "unable_or_declined_topics", "review_status"]
    out = samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1 or sample_id is null").select("sample_id", F.lit("duplicate_sample").alias("issue"))
    missing = F.size(F.array_except(F.array(*map(F.lit, gold)), F.coalesce("gold_fields", F.array().cast("array<string>")))) > 0
    out = out.union(flagged(samples, ["sample_id"], {"other_release": ~F.col("release_id").eqNullSafe(release), "bad_action": ~F.coalesce(F.col("expected").isin("ASK", "STOP"), F.lit(False)), "missing_gold_field": missing}))
    out = out.union(refs.join(bounded(catalog.select("kind", "id").distinct()), ["kind", "id"], "left_anti").select("sample_id", F.concat(F.lit("unknown_"), "kind")))
    out = out.groupBy("sample_id", "issue").agg(F.count("*").alias("n"))
    if wanted:
        want = samples.sparkSession.createDataFrame(list(wanted.items()), "category string, k long")
        found = want.join(samples.groupBy("category").agg(F.count("*").alias("n")), "category", "full_outer").where("not k <=> n")
        out = out.union(found.select(F.lit(None).cast(samples.schema["sample_id"].dataType), F.concat(F.lit("category_"), "category"), F.coalesce("n", F.lit(0))))
    return out


def scored_runs(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """runs (sample_id, decision, condition_id, ...) held against gold (sample_id, expected, target, known, unable: arrays of conditions): four flags; a sample without gold has none."""
    asked, wants = F.col("decision") == "ASK", F.col("expected") == "ASK"
    within = lambda c: F.coalesce(F.array_contains(c, F.col("condition_id")), F.lit(False))
    out = runs.join(gold, "sample_id", "left")
    flags = {"decision_correct": asked == wants, "target_correct": (~asked & ~wants) | (asked & wants & within("target")), "repeat_known": asked & within("known"), "reasks_unable": asked & within("unable")}
    return out.select(*runs.columns, *[F.when(F.col("expected").isNotNull(), v).alias(k) for k, v in flags.items()])


STATUSES = ("MISSING", "REFINE", "DUPLICATE", "ANSWERED", "UNABLE", "DECLINED")


def validated_drafts(drafts: DataFrame, allowed: DataFrame, facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Drafts (session_id, pos, status, description, condition_ids, fact_ids, question_ids, refinement) with ids reduced to known ones, and reason: null if the draft is kept.

    allowed (session_id, condition_id), facts (session_id, fact_id) and questions (session_id, question_id) are what a session knows. Reasons in
    order: invalid_status, empty_description, no_allowed_condition, missing_history_reference, missing_refinement; `dropped` counts unknown conditions.
    """
    out = drafts
    for name, table, ident in (("condition_ids", allowed, "condition_id"), ("fact_ids", facts, "fact_id"), ("question_ids", questions, "question_id")):
        known = table.groupBy("session_id").agg(F.collect_set(ident).alias(f"known_{name}"))
        out = out.join(known, "session_id", "left")
    none = lambda c: F.coalesce(F.array_distinct(F.filter(c, lambda x: F.array_contains(F.col(f"known_{c}"), x))), F.filter(c, lambda x: F.lit(False)))
    out = out.withColumns({"c": none("condition_ids"), "f": none("fact_ids"), "q": none("question_ids"), "description": F.trim("description")})
    history = F.col("status").isin("DUPLICATE", "REFINE") & (F.size("f") + F.size("q") == 0)
    reason = (
        F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "invalid_status").when(F.coalesce("description", F.lit("")) == "", "empty_description")
        .when(F.size("c") == 0, "no_allowed_condition").when(history, "missing_history_reference").when((F.col("status") == "REFINE") & (F.coalesce(F.trim("refinement"), F.lit("")) == ""), "missing_refinement")
    )
    dropped = F.size(F.filter("condition_ids", lambda x: ~F.coalesce(F.array_contains(F.col("known_condition_ids"), x), F.lit(False))))
    return out.select("session_id", "pos", "status", "description", F.col("c").alias("condition_ids"), F.col("f").alias("fact_ids"), F.col("q").alias("question_ids"), "refinement", dropped.cast("long").alias("dropped"), reason.alias("reason"))


def ranked_drafts(kept: DataFrame, tiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(askable drafts with candidate_id, tier, rule_rank and rank; excluded (session_id, status, n)) of kept drafts (session_id, pos, status, condition_ids) and tiers (session_id, condition_id, tier, rule_rank).

    A draft takes the smallest tier and the smallest rank of its conditions (3 and 99 without any). Ids number a session's drafts in order.
    """
    named = kept.withColumn("candidate_id", F.concat(F.lit("mf."), F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))))
    best = named.select("session_id", "pos", F.explode("condition_ids").alias("condition_id")).join(tiers, ["session_id", "condition_id"]).groupBy("session_id", "pos").agg(F.min("tier").alias("tier"), F.min("rule_rank").alias("rule_rank"))
    met = named.join(best, ["session_id", "pos"], "left").withColumns({"tier": F.coalesce("tier", F.lit(3)), "rule_rank": F.coalesce("rule_rank", F.lit(99))})
    askable = met.where("status in ('MISSING', 'REFINE')")
    w = Window.partitionBy("session_id").orderBy("tier", "rule_rank", "candidate_id")
    return askable.withColumn("rank", F.row_number().over(w).cast("long")), met.where("status not in ('MISSING', 'REFINE')").groupBy("session_id", "status").agg(F.count("*").alias("n"))


def default_scope(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, rules, conditions): all candidates (query_id, rule_id, rank) active in order, and their conditions (rule_id, condition_id, pos), each at its first place."""
    places = members.groupBy("rule_id", "condition_id").agg(F.min("pos").alias("pos"))
    lists = bounded(written(places.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("pos", "condition_id"))).alias("held"))), 20_000)
    # A rule's conditions are one row, each once; candidates are dealt by query, and nothing moves after that.
    own = dealt(written(candidates.select("query_id", "rule_id", "rank")), ["query_id"], 50_000).join(lists, "rule_id", "left")
    own = own.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "rule_id", "held"))).alias("own"))
    every = F.flatten(F.transform(F.filter("own", lambda x: x["held"].isNotNull()), lambda x: F.transform(x["held"], lambda h: F.struct(x["rank"].alias("rank"), h["pos"].alias("pos"), h["condition_id"].alias("condition_id")))))
    rules = F.array_distinct(F.transform("own", lambda x: F.struct(x["rank"].alias("rank"), x["rule_id"].alias("rule_id"))))
    return own.select("query_id", F.transform(rules, lambda x: x["rule_id"]).alias("rules"), F.array_distinct(F.transform(F.sort_array(every), lambda x: x["condition_id"])).alias("conditions"))


def case_documents(light: DataFrame, claims: DataFrame, assessments: DataFrame, applied: DataFrame, decisions: DataFrame) -> DataFrame:
    """light (case_id, ...) with what its deep record says: claim_types, assessments (structs of condition and status), rules applied or invoked, decisions; each distinct and sorted, empty where there is no deep record.

    claims (case_id, claim_type, rule_id), assessments (case_id, condition_id, status), applied (case_id, rule_id), decisions (case_id, status).
    """
    def gathered(rows: DataFrame, value: Column, name: str) -> DataFrame:
        return rows.groupBy("case_id").agg(F.array_sort(F.collect_set(value)).alias(name))

    parts = [
        gathered(claims, F.col("claim_type"), "claim_types"), gathered(assessments, F.struct("condition_id", "status"), "assessments"),
        gathered(applied.select("case_id", "rule_id").union(claims.select("case_id", "rule_id")).where("rule_id is not null"), F.col("rule_id"), "rules"), gathered(decisions, F.col("status"), "decisions"),
    ]
    out = light
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def document_text(cases: DataFrame, markdown: DataFrame) -> DataFrame:
    """(case_id, text, origin): the markdown (title, text) of a case's title, else its full_document, else its facts, reasoning and result under headings."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    parts = [F.when(blank(c).isNotNull(), F.concat(F.lit(f"## {h}\n"), F.col(c))) for c, h in (("facts", "案件事实"), ("reasoning", "裁判理由"), ("result", "裁判结果"))]
    met = cases.join(markdown.groupBy("title").agg(F.max("text").alias("markdown")), "title", "left")
    origin = F.when(blank("markdown").isNotNull(), "markdown").when(blank("full_document").isNotNull(), "document").otherwise("sections")
    return met.select("case_id", F.coalesce(blank("markdown"), blank("full_document"), F.concat_ws("\n\n", *parts)).alias("text"), origin.alias("origin"))


def converted_samples(samples: DataFrame, primary: str, causes: dict[str, str], cut: int = 400) -> DataFrame:
    """Index records of labelled samples (id, text, relations: map of label to arrays of (subject, object, content)) that have the label `primary`.

    Keywords are the primary label, then the others sorted. The summary is the primary's first object and content, else the text's first line, up to `cut` characters.
    """
    named = F.create_map(*[F.lit(x) for pair in causes.items() for x in pair])
    others = F.array_sort(F.array_except(F.map_keys("relations"), F.array(F.lit(primary))))
    first = F.get(F.element_at("relations", F.lit(primary)), F.lit(0))
    said = F.nullif(F.trim(F.concat_ws("：", F.nullif(F.trim(first["object"]), F.lit("")), F.nullif(F.trim(first["content"]), F.lit("")))), F.lit(""))
    own = samples.where(F.array_contains(F.map_keys("relations"), primary))
    return own.select(F.concat(F.lit("case."), "id").alias("case_id"), F.coalesce(F.element_at(named, F.lit(primary)), F.lit(primary)).alias("cause"), F.concat(F.array(F.lit(primary)), others).alias("keywords"),
                      F.substring(F.coalesce(said, F.trim(F.substring_index(F.trim("text"), "\n", 1))), 1, cut).alias("summary"))


def decision_rows(cases: DataFrame) -> DataFrame:
    """(decision_id, case_id, status, amount, section, start_offset, end_offset) of cases (case_id, status, amount, holding, facts, reasoning): the holding's first sentence, anchored in the facts, else in the reasoning; no row if it stands in neither."""
    quote = F.trim(F.get(F.regexp_extract_all("holding", F.lit(T.SENTENCE), 1), F.lit(0)))
    held = cases.withColumn("quote", quote).where(F.length("quote") > 0)
    place = lambda c: T.anchored(F.col(c), F.col("quote"), F.lit(0), F.length(c))
    held = held.withColumns({"in_facts": place("facts"), "in_reasoning": place("reasoning")}).withColumn("span", F.coalesce("in_facts", "in_reasoning")).where("span is not null")
    return held.select(F.concat("case_id", F.lit(".decision.001")).alias("decision_id"), "case_id", "status", "amount", F.when(F.col("in_facts").isNotNull(), "facts").otherwise("reasoning").alias("section"), "span.start_offset", "span.end_offset")


def answer_statuses(answers: DataFrame, options: DataFrame, phrases: DataFrame, intent: str = "想要|打算|准备|希望|want to|plan to") -> DataFrame:
    """answers (session_id, question_id, condition_id, option_id, answer) -> their status: by the chosen option (question_id, option_id, status), else by a bare yes or no, else by the longest phrase (condition_id, phrase, status) of a sentence that states no intent; null if none says anything.

    Phrases of equal length that disagree make a CONFLICTING status.
    """
    text = F.lower(F.trim(F.regexp_replace(F.coalesce("answer", F.lit("")), r"[。.!！]+$", "")))
    bare = F.when(text.isin("不是", "没有", "否", "不", "no", "false"), "NOT_SATISFIED").when(text.isin("是", "是的", "有", "对", "yes", "true"), "SATISFIED")
    said = answers.select("session_id", "question_id", "condition_id", F.explode(F.split(F.coalesce("answer", F.lit("")), "[。；.;\n]")).alias("s")).where(~F.col("s").rlike(intent))
    met = said.join(bounded(phrases.where("length(phrase) > 0")), "condition_id").where(F.col("s").contains(F.col("phrase")))
    longest = met.groupBy("session_id", "question_id").agg(F.max(F.length("phrase")).alias("k"))
    kinds = met.join(longest, ["session_id", "question_id"]).where(F.length("phrase") == F.col("k")).groupBy("session_id", "question_id").agg(F.min("status").alias("lo"), F.max("status").alias("hi"))
    free = kinds.select("session_id", "question_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("CONFLICTING").alias("free"))
    out = answers.join(bounded(options.select("question_id", "option_id", F.col("status").alias("chosen"))), ["question_id", "option_id"], "left").join(free, ["session_id", "question_id"], "left")
    return out.select("session_id", "question_id", "condition_id", F.coalesce("chosen", bare, "free").alias("status"))
