"""The session fold against the batch operators, with events out of order, gaps, repeats and corrections."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.streaming import sessions as streams


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKS)
    yield
    spark.conf.set(name, before)


def events_of(seed):
    r, out = np.random.default_rng(seed), []
    for session in range(6):
        for revision in range(1, 8):
            links = [{"condition_id": f"c{r.integers(3)}", "fact_id": int(r.integers(5)), "relation": str(r.choice(["SUPPORTS", "OPPOSES", "QUALIFIES"])), "confidence": float(r.integers(1, 9)) / 10} for _ in range(r.integers(0, 4))]
            links = list({(x["condition_id"], x["fact_id"]): x for x in links}.values())
            corrections = [{"fact_id": int(r.integers(5)), "condition_id": [None, "c1"][r.integers(2)]}] if r.random() < 0.3 else []
            turn = revision if r.random() < 0.8 else max(revision - 2, 0)  # evidence of an older turn may come late
            out.append({"session_id": session, "revision": revision, "turn": turn, "facts": [{"fact_id": revision, "text": f"t{revision}"}], "links": links, "corrections": corrections})
    return out


def drained(spark, tmp_path, name, batches, idle_ms=None):
    folder = tmp_path / name
    folder.mkdir()
    for i, batch in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, batch)))
    stream = spark.readStream.schema(streams.EVENT).option("maxFilesPerTrigger", 1).json(str(folder))
    query = streams.fold_sessions(stream, idle_ms).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        if not idle_ms:  # with timers there is always another batch
            query.processAllAvailable()
        deadline = time.time() + 60
        while idle_ms and time.time() < deadline and not spark.table(name).where("kind = 'expired'").count():
            time.sleep(0.5)
    finally:
        query.stop()
    return spark.table(name).toPandas()


def last_states(rows):
    rows = rows[rows.kind == "state"].sort_values("revision").drop_duplicates(["session_id", "condition_id"], keep="last")
    return {(r.session_id, r.condition_id): (r.status, None if np.isnan(r.confidence) else round(r.confidence, 6)) for r in rows.itertuples()}


def test_session_fold_equals_batch(spark, tmp_path, rocks):
    events = events_of(3)
    r = np.random.default_rng(0)
    both = [{"condition_id": "c9", "fact_id": i, "relation": x, "confidence": 0.9} for i, x in enumerate(("SUPPORTS", "OPPOSES"))]
    events.append({"session_id": 9, "revision": 1, "turn": 1, "facts": [], "links": both, "corrections": []})
    early = [e for e in events if e["revision"] <= 4]
    late = [e for e in events if e["revision"] > 4 and not (e["session_id"] == 5 and e["revision"] == 5)]  # a gap: the rest of session 5 is rejected
    again = [e for e in events if e["session_id"] == 0 and e["revision"] == 2]
    batches = [[early[i] for i in r.permutation(len(early))], [late[i] for i in r.permutation(len(late))], again]
    got = drained(spark, tmp_path, "folded_sessions", batches)
    rejected = got[got.kind == "rejected"]
    assert sorted(zip(rejected.session_id, rejected.revision, rejected.reason, strict=True)) == [(0, 2, "expected revision 8"), (5, 6, "expected revision 5"), (5, 7, "expected revision 5")]
    table = spark.createDataFrame([tuple(e[k] for k in ("session_id", "revision", "turn", "facts", "links", "corrections")) for b in batches for e in b], streams.EVENT)
    want = {(x.session_id, x.condition_id): (x.status, None if x.confidence is None else round(x.confidence, 6)) for x in streams.batch_states(streams.accepted_events(table)).collect()}
    assert last_states(got) == want and {v[0] for v in want.values()} >= {"SATISFIED", "NOT_SATISFIED", "CONFLICTING", "UNKNOWN"}
    assert not (got.kind == "expired").any()


def test_idle_sessions_are_forgotten(spark, tmp_path, rocks):
    got = drained(spark, tmp_path, "idle_sessions", [[e for e in events_of(1) if e["session_id"] == 0 and e["revision"] == 1]], idle_ms=200)
    assert got[got.kind == "expired"][["session_id", "revision"]].values.tolist() == [[0, 1]]


def test_fold_needs_its_state_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        streams.fold_sessions(spark.createDataFrame([], streams.EVENT))


def test_accepted_events_end_at_a_gap(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (2, 2), (3, 0), (3, 1)], "session_id long, revision long").withColumn("turn", F.lit(0))
    assert sorted(tuple(x)[:2] for x in streams.accepted_events(rows).collect()) == [(1, 1), (1, 2), (3, 1)]
