"""Streaming forms: idempotent answers, the session fold, and incremental mapping against a ledger."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from docketry.operators.sessions import drop_corrected, states

ANSWER_STATE = "answers map<string, string>, revision long"


def answers(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream (session_id long, question_id string, answer string, seq long) -> outcome of each answer, and the session's revision.

    The first answer to a question, by seq, is ACCEPTED and raises the revision; an identical one is a REPLAY; another is a CONFLICT.
    A session that hears nothing for idle_ms is forgotten.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, revision = (dict(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        pdf = pd.concat(frames).sort_values("seq", kind="stable")
        new = ~pdf["question_id"].isin(known) & ~pdf["question_id"].duplicated()
        known |= dict(zip(pdf.loc[new, "question_id"], pdf.loc[new, "answer"], strict=True))
        same = pdf["question_id"].map(known) == pdf["answer"]
        outcome = np.where(new, "ACCEPTED", np.where(same, "REPLAY", "CONFLICT"))
        revisions = revision + new.cumsum()
        state.update((known, int(revisions.iloc[-1])))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": key[0], "question_id": pdf["question_id"], "outcome": outcome, "revision": revisions})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("session_id").applyInPandasWithState(fold, "session_id long, question_id string, outcome string, revision long", ANSWER_STATE, "append", timeout)


#: One event is what an answer brings: its facts, the evidence found in them, and the facts that it corrects (condition_id null: for all conditions).
EVENT = """session_id long, revision long, turn long, facts array<struct<fact_id: long, text: string>>,
  links array<struct<condition_id: string, fact_id: long, relation: string, confidence: double>>, corrections array<struct<fact_id: long, condition_id: string>>"""
FOLDED = "session_id long, revision long, kind string, condition_id string, status string, confidence double, last_turn long, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionFold(StatefulProcessor):
    """The state of a session, one variable for each thing that an event may change."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.revision = handle.getValueState("revision", "revision long")
        self.active = handle.getValueState("active", "at long")
        self.facts = handle.getMapState("facts", "fact_id long", "text string, turn long")
        self.evidence = handle.getMapState("evidence", "condition_id string, fact_id long", "relation string, confidence double, turn long")
        self.corrected = handle.getMapState("corrected", "fact_id long, condition_id string", "turn long")
        self.known = handle.getMapState("known", "condition_id string", "status string, confidence double, turn long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for event in pd.concat(rows).sort_values("revision", kind="stable").itertuples(index=False):
            revision = self.revision.get()[0] if self.revision.exists() else 0
            if event.revision != revision + 1:
                out.append((key[0], event.revision, "rejected", None, None, None, None, f"expected revision {revision + 1}"))
                continue
            self.revision.update((int(event.revision),))
            out += [(key[0], event.revision, "state", *row, None) for row in self.apply(event)]
        if self.idle_ms:
            self.active.update((timerValues.getCurrentProcessingTimeInMs(),))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.frame(out)

    def apply(self, event) -> list[tuple]:
        """Takes an event in; the conditions whose state it changes."""
        for fact in event.facts if event.facts is not None else ():
            if not self.facts.containsKey((fact["fact_id"],)):  # a fact once taken never changes
                self.facts.updateValue((fact["fact_id"],), (fact["text"], int(event.turn)))
        touched = set()
        for c in event.corrections if event.corrections is not None else ():
            self.corrected.updateValue((c["fact_id"], c["condition_id"] or ""), (int(event.turn),))
        for link in event.links if event.links is not None else ():
            self.evidence.updateValue((link["condition_id"], link["fact_id"]), (link["relation"], float(link["confidence"]), int(event.turn)))
            touched.add(link["condition_id"])
        for condition_id, fact_id in list(self.evidence.keys()):
            if self.corrected.containsKey((fact_id, "")) or self.corrected.containsKey((fact_id, condition_id)):
                self.evidence.removeKey((condition_id, fact_id))
                touched.add(condition_id)
        held: dict[str, list] = {c: [] for c in touched}
        for (condition_id, _), value in self.evidence.iterator():
            if condition_id in held and value[0] in ("SUPPORTS", "OPPOSES"):
                held[condition_id].append(value)
        changed = []
        for condition_id, rows in sorted(held.items()):
            state = state_of(rows)
            if not self.known.containsKey((condition_id,)) or tuple(self.known.getValue((condition_id,))) != state:
                self.known.updateValue((condition_id,), state)
                changed.append((condition_id, *state))
        return changed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forgets a session that has heard nothing since; a timer of an older event does nothing."""
        if self.active.exists() and self.active.get()[0] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            revision = self.revision.get()[0] if self.revision.exists() else 0
            for state in (self.revision, self.active, self.facts, self.evidence, self.corrected, self.known):
                state.clear()
            yield self.frame([(key[0], revision, "expired", None, None, None, None, "idle")])

    def close(self) -> None:
        pass

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOLDED.split(", ")]).astype({"confidence": "float64", "last_turn": "Int64", "revision": "int64"})


def state_of(rows: list) -> tuple[str, float | None, int | None]:
    """(status, confidence, turn) of directed evidence (relation, confidence, turn): that of its newest turn, in conflict at .7 at most."""
    if not rows:
        return "UNKNOWN", None, None
    turn = max(r[2] for r in rows)
    newest = [r for r in rows if r[2] == turn]
    relations, confidence = {r[0] for r in newest}, max(r[1] for r in newest)
    if len(relations) > 1:
        return "CONFLICTING", min(0.7, confidence), turn
    return "SATISFIED" if relations == {"SUPPORTS"} else "NOT_SATISFIED", confidence, turn


def fold_sessions(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream of EVENT -> FOLDED: the conditions whose state changed (kind state), and events whose revision does not follow (kind rejected).

    Facts are taken once. Corrections are kept, and evidence that any of them touches, older or newer, does not count; of several links of a fact and condition the last
    revision's counts. So the last state of each condition equals that of the batch operators over all accepted events: newest links, without what was
    corrected, reduced by their newest turn. Events of a batch are taken by revision, in whatever order they come. A session that hears nothing for idle_ms is forgotten, with a
    row of kind expired. Needs the RocksDB state store, which keeps each variable's entries apart.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    return stream.groupBy("session_id").transformWithStateInPandas(SessionFold(idle_ms), FOLDED, "Append", "ProcessingTime" if idle_ms else "None")


def accepted_events(events: DataFrame) -> DataFrame:
    """The events of a table that the fold accepts: of each session those of revision 1, 2, ... up to the first gap; of equal revisions one."""
    once = events.dropDuplicates(["session_id", "revision"]).where("revision > 0")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("revision"))
    return once.withColumn("place", place).where("revision = place").drop("place")


def batch_states(events: DataFrame) -> DataFrame:
    """(session_id, condition_id, status, confidence, last_updated_turn): what the fold ends with, from a table of accepted EVENT rows."""
    links = events.select("session_id", "revision", "turn", F.explode("links").alias("x")).select("session_id", "revision", "turn", "x.*")
    newest = Window.partitionBy("session_id", "condition_id", "fact_id").orderBy(F.desc("revision"))
    links = links.withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n", "revision")
    corrections = events.select("session_id", F.explode("corrections").alias("x")).select("session_id", "x.*")
    kept = drop_corrected(links, corrections)
    gone = links.select("session_id", "condition_id").distinct().join(kept.select("session_id", "condition_id").distinct(), ["session_id", "condition_id"], "left_anti")
    empty = gone.select("*", F.lit("UNKNOWN").alias("status"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("last_updated_turn"))
    return states(kept).unionByName(empty)


def fold_states(stream: DataFrame) -> DataFrame:
    """stream (session_id long, condition_id string, fact_id long, relation string, turn long) -> each changed (session, condition) state.

    The state keeps the newest turn and which relations it holds; late evidence of older turns changes nothing, so
    that the last row of a key equals the batch result.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, yes, no = state.get if state.exists else (-1, False, False)
        before = (turn, yes, no)
        for pdf in frames:
            said = pdf[pdf["relation"].isin(["SUPPORTS", "OPPOSES"]) & (pdf["turn"] >= turn)]
            if not len(said):
                continue
            newest_turn = int(said["turn"].max())
            held = set(said.loc[said["turn"] == newest_turn, "relation"])
            yes, no = (("SUPPORTS" in held) | (yes & (newest_turn == turn)), ("OPPOSES" in held) | (no & (newest_turn == turn)))
            turn = newest_turn
        state.update((turn, yes, no))
        if (turn, yes, no) != before or not before[0] + 1:
            status = "CONFLICTING" if yes and no else "SATISFIED" if yes else "NOT_SATISFIED" if no else "UNKNOWN"
            yield pd.DataFrame([(key[0], key[1], status, turn)], columns=["session_id", "condition_id", "status", "turn"])

    return stream.groupBy("session_id", "condition_id").applyInPandasWithState(fold, "session_id long, condition_id string, status string, turn long", "turn long, yes boolean, no boolean", "append", GroupStateTimeout.NoTimeout)


#: Versions that make a pair new again, where facts or conditions have them.
VERSIONS = ("definition_version", "mapper_version", "text_version")


def map_new(stream: DataFrame, conditions: DataFrame, ledger_path: str, checkpoint: str):
    """A running query that appends to the ledger the pairs of each batch's facts (session_id, fact_id) and conditions (session_id, condition_id) that it lacks in their versions."""

    def pairs_of(facts: DataFrame) -> DataFrame:
        own = [c for c in VERSIONS if c in facts.columns]
        theirs = [c for c in VERSIONS if c in conditions.columns]
        return facts.select("session_id", "fact_id", *own).distinct().join(conditions, "session_id").select("session_id", "fact_id", "condition_id", *own, *theirs)

    def batch(facts: DataFrame, _: int) -> None:
        pairs = pairs_of(facts)
        pairs.join(facts.sparkSession.read.schema(pairs.schema).parquet(ledger_path), pairs.columns, "left_anti").write.mode("append").parquet(ledger_path)

    spark = conditions.sparkSession
    pairs_of(spark.createDataFrame([], stream.schema)).write.mode("ignore").parquet(ledger_path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(changes: DataFrame) -> DataFrame:
    """The last change of each (session, condition): of the largest turn, and there the fullest state."""
    order = F.struct("turn", (F.col("status") == "CONFLICTING").cast("int").alias("c"))
    return changes.groupBy("session_id", "condition_id").agg(F.max_by("status", order).alias("status"), F.max("turn").alias("turn"))
