"""The session machine: its rules one by one, and the stream against the batch on shuffled, late and repeated input."""

import random
from collections import Counter
from types import SimpleNamespace

import pytest

from tessera.operators import machine as m
from tessera.streaming import machine as streaming

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Modules with their section, scope and seconds of a clock, way back, review and locks.
MODULES = [("r", "reading", "module", 9, "module", True, False), ("l", "listening", "question", 4, "none", False, True), ("w", "writing", "task", 8, "task", True, False), ("s", "speaking", "question", 3, "none", False, True)]
PLACES = [
    (f"{mod}{q}", mod, f"{mod}t{q // 2}", section, q // 2, q, scope, 1000 * seconds, 1000 if section == "speaking" else None, back, review, locks, after, None if after is None else after + "0")
    for (mod, section, scope, seconds, back, review, locks), after in zip(MODULES, ["l", "w", "s", None], strict=True)
    for q in range(4)
]
FIELDS = [x.split()[0] for x in m.EVENT.split(", ")]
PLAN = {p[0]: dict(zip([x.split()[0] for x in m.PLACE.split(", ")], p, strict=True)) for p in PLACES}
NOWHERE = dict.fromkeys(PLAN["r0"])


class Play:
    """A session that is told what happens, one event after another."""

    def __init__(self, mode="practice", first="r0", at=0):
        self.state, self.seq, self.rows = m.empty_session(), 0, []
        self("start", at, first, mode=mode)

    def __call__(self, kind, at, question, phase=None, **more):
        given = dict.fromkeys(FIELDS) | {"session_id": 1, "seq": self.seq, "kind": kind, "at_ms": at, "phase": phase} | more
        rows = m.step(1, self.state, SimpleNamespace(**(PLAN.get(question, NOWHERE) | given | {"question": question})))
        self.seq += 1
        self.rows += rows
        return rows[-1][4]

    def clock(self, name):
        return self.state.clocks[name]

    def goto(self, module, at):
        """Submit all modules before one."""
        for mod, *_ in MODULES:
            if mod == module:
                return
            assert self("submit", at, f"{mod}0") == "accepted"


def test_start_is_first_and_once():
    p = Play()
    assert [r[4] for r in p.rows] == ["accepted"] and p.state.head.revision == 1
    assert p("start", 5, "r0") == "reused" and p.state.head.revision == 1
    fresh = m.empty_session()
    e = SimpleNamespace(**(PLAN["r0"] | dict.fromkeys(FIELDS) | {"session_id": 1, "seq": 0, "kind": "move", "at_ms": 0, "phase": "response", "question": "r0"}))
    assert m.step(1, fresh, e)[-1][4] == "no_session" and fresh.head is None


def test_one_clock_runs_and_shared_ones_go_on():
    p = Play()
    p("move", 1000, "r0", "response")
    p("move", 3000, "r1", "response")
    assert p.state.head.active == "response:module:r" and p.clock("response:module:r").started_ms == 1000  # the module's clock goes on
    p("pause", 4000, "r1")
    assert p.clock("response:module:r").consumed_ms == 3000 and p.clock("response:module:r").running_since_ms is None
    p("resume", 9000, "r1")
    assert p.clock("response:module:r").deadline_ms == 15000
    p.goto("l", 10_000)
    assert p.clock("response:module:r").completed and p.clock("response:module:r").consumed_ms == 4000
    p("move", 11_000, "l0", "response")
    p("move", 12_000, "l1", "response")
    assert p.clock("response:question:l0").completed and p.state.head.active == "response:question:l1"
    p("move", 12_500, "l1", "review")
    assert p.rows[-1][4] == "no_review"


def test_deadline_fires_between_events():
    p = Play(mode="exam")
    p("move", 1000, "r0", "response")
    assert p("answer", 10_500, "r0", answer="A") == "too_late"
    assert [r[3:5] for r in p.rows if r[2] is None] == [("deadline", "expired")] and p.rows[-2][1] == 10_000 and p.rows[-2][10] == 9000
    assert m.deadline(p.state) is None and m.advance(1, p.state, 99_999) == []
    # Captured in the last second before the cutoff and received within a second after it.
    assert p("answer", 10_900, "r0", answer="A", captured_ms=9_400) == "accepted"
    assert p("answer", 10_900, "r1", answer="A", captured_ms=8_900) == "too_late"
    assert p("answer", 11_001, "r1", answer="A", captured_ms=9_900) == "too_late"


def test_practice_may_go_on_but_not_in_speaking():
    p = Play()
    p("move", 0, "r0", "response")
    assert p("answer", 20_000, "r0", answer="A") == "accepted"
    p.goto("s", 21_000)
    p("move", 22_000, "s0", "response")
    assert p("answer", 30_000, "s0", answer="A") == "too_late"
    assert p("move", 31_000, "s0", "response") == "time_used_up"


def test_preparation_has_a_clock_of_its_own():
    p = Play()
    p.goto("s", 0)
    p("move", 100, "s0", "prepare")
    assert p.state.head.active == "prepare:question:s0" and m.deadline(p.state) == 1100
    p("move", 600, "s0", "response")
    assert p.clock("prepare:question:s0").completed and p.clock("prepare:question:s0").consumed_ms == 500 and m.deadline(p.state) == 3600
    assert p("move", 700, "s0", "prepare") == "already_answering"


def test_recordings_are_saved_in_their_window():
    p = Play(mode="exam")
    p.goto("s", 0)
    assert p("move", 50, "s0", "saving") == "not_recording"
    p("move", 100, "s0", "response")
    assert p("move", 1000, "s0", "recorded") == "no_recording"
    assert p("move", 2500, "s0", "saving", captured_ms=2000) == "accepted" and p.state.head.saving_until_ms == 2000 + m.RECORDING_MS
    assert p("move", 2600, "s0", "response") == "still_saving"
    assert p("answer", 100_000, "s0", recording="rec") == "accepted"
    assert p("move", 100_500, "s0", "recorded") == "accepted"
    assert p("move", 100_600, "s0", "response") == "no_second_take"
    again = Play()
    again.goto("s", 0)
    again("move", 100, "s0", "response")
    again("move", 500, "s0", "saving")
    again("answer", 600, "s0", recording="rec")
    again("move", 700, "s0", "recorded")
    assert again("move", 800, "s0", "response") == "accepted" and again.state.head.assisted
    late = Play()
    late.goto("s", 0)
    late("move", 100, "s0", "response")
    late("move", 3500, "s0", "saving")
    assert late("answer", 3100 + m.RECORDING_MS + 5000, "s0", recording="rec") == "too_late"


def test_moves_are_guarded_and_lock():
    p = Play()
    assert p("move", 0, "r0", "completed") == "bad_phase"
    assert p("move", 0, "l0", "response") == "submit_first"
    assert p("move", 0, "r0", "saving") == "not_spoken"
    assert p("move", 0, "r3", "response") == "accepted" and p("move", 1, "r0", "review") == "accepted"  # reading goes back
    p.goto("l", 10)
    p("move", 20, "l2", "response")
    assert p("answer", 30, "l1", answer="A") == "locked" and p("move", 30, "l2", "response") == "accepted"
    assert p("move", 40, "l0", "response") == "locked"
    p.goto("w", 50) if "l" in p.state.head.submitted else p("submit", 50, "l0")
    p("move", 60, "w1", "response")
    assert p("move", 61, "w0", "response") == "accepted"  # back inside a task
    p("move", 62, "w2", "response")
    assert p("answer", 63, "w1", answer="x") == "locked" and p("move", 64, "w3", "response") == "accepted" and p("move", 65, "w2", "review") == "accepted"
    assert p("answer", 66, "s0", answer="x") == "other_module" and p("move", 66, "zz", "response") == "unknown_question"


def test_fences():
    p = Play()
    assert p("answer", 1, "r0", answer="A", request="x", expected_revision=1) == "accepted"
    assert p("answer", 2, "r0", answer="A", request="x", expected_revision=1) == "replayed"  # again, although the revision has passed
    assert p("answer", 3, "r0", answer="B", request="x") == "conflict"
    assert p("answer", 4, "r0", answer="B", expected_revision=1) == "stale"
    assert p("answer", 5, "r0", answer="B", request="y", expected_revision=2) == "accepted" and p.state.answers["r0"][0] == "B"
    p.goto("s", 6)
    assert p("submit", 7, "r0") == "sealed"
    assert p("submit", 8, "s0") == "accepted" and p.state.head.finished and p.state.head.phase == "completed"
    assert p("answer", 9, "s0", answer="A") == "finished" and p("answer", 9, "r0", answer="A", request="x") == "replayed"


def history(seed, sessions=12, events=60):
    r = random.Random(seed)
    rows = []
    for s in range(sessions):
        t, module, q = 1000, 0, 0
        for k in range(events):
            t += r.randrange(0, 1500)
            kind = r.choice(["move"] * 6 + ["answer"] * 5 + ["pause", "resume", "submit", "start", "?"]) if k else r.choice(["start"] * 5 + ["move"])
            mod = "rlws"[min(3, max(0, module + r.choice([0] * 12 + [1, -1])))]
            q = min(3, max(0, q + r.choice([0, 0, 0, 1, 1, -1])))
            if kind == "submit" and r.random() < 0.6:
                module, q = min(3, module + 1), 0
            phase = r.choice(["response"] * 5 + ["stimulus", "prepare", "saving", "recorded", "review", "directions", "bad", None])
            rows.append((s, k, r.choice([None, f"x{k}", f"x{r.randrange(5)}"]), kind, t, r.choice([None, t - r.randrange(1500)]), r.choice([None, None, None, k]), f"{mod}{q}" if r.random() > 0.02 else "zz", phase, r.choice([None, "A", "B"]), r.choice([None, None, "rec"]), ["practice", "exam", None][s % 3]))
    return rows


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def run_stream(spark, tmp_path, name, batches, delay, **options):
    """The LOG rows of a stream that gets these batches."""
    for rows in batches:
        spark.createDataFrame(rows, m.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    told = spark.readStream.schema(m.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    located = m.located_events(told, spark.createDataFrame(PLACES, m.PLACE))
    query = streaming.stream_sessions(located, delay, **options).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(x) for x in spark.table(name).collect()], query


def end(at):
    """Two events of another session that drive the watermark past a moment."""
    return [[(999, k, None, "start", at + 100_000 * (k + 1), None, None, "r0", None, None, None, None)] for k in range(2)]


def test_stream_is_the_batch(rocks, tmp_path):
    rows = history(3)
    last = max(r[4] for r in rows)
    r = random.Random(4)
    # Shuffled by up to three seconds, some events twice, and some so late that the watermark has passed them.
    order = sorted(rows + r.sample(rows, 40), key=lambda x: x[4] + r.randrange(3000))
    n = len(order) // 6 + 1
    batches = [order[i : i + n] for i in range(0, len(order), n)]
    ancient = [(s, 900 + s, None, "submit", 500, None, None, "r0", None, None, None, None) for s in range(12)]
    batches[4] = batches[4] + ancient
    got, _ = run_stream(rocks, tmp_path, "machine", batches + end(last), "4 seconds", remember="20 seconds")
    located = m.located_events(rocks.createDataFrame(rows + rows[:7], m.EVENT), rocks.createDataFrame(PLACES, m.PLACE))
    want = [tuple(x) for x in m.fold_sessions(located.repartition(5), last + 90_000, 20_000).collect()]
    assert Counter(x for x in got if x[0] < 900) == Counter(want)
    verdicts = {x[4] for x in want}
    assert {"accepted", "expired", "replayed", "conflict", "stale", "locked", "sealed", "unknown_question", "bad_phase", "unknown_kind"} - {"replayed"} <= verdicts


def test_a_deadline_needs_no_event(rocks, tmp_path):
    """A clock runs out while its session is silent: the row comes when the watermark passes, from a timer."""
    rows = [(1, 0, None, "start", 1000, None, None, "r0", None, None, None, "exam"), (1, 1, None, "move", 2000, None, None, "r0", "response", None, None, None)]
    got, query = run_stream(rocks, tmp_path, "silent", [rows, *end(0)], "1 second")
    assert [(x[1], x[2], x[3], x[4]) for x in got if x[0] == 1] == [(1000, 0, "start", "accepted"), (2000, 1, "move", "accepted"), (11_000, None, "deadline", "expired")]


def test_idle_sessions_are_forgotten(rocks, tmp_path):
    rows = [(1, 0, None, "start", 1000, None, None, "r0", None, None, None, None)]
    later = [(1, 1, None, "pause", 290_000, None, None, "r0", None, None, None, None)]
    got, _ = run_stream(rocks, tmp_path, "idle_machine", [rows, *end(0), later, *end(300_000)], "1 second", idle="60 seconds", remember="1 hour")
    assert [(x[2], x[4]) for x in got if x[0] == 1] == [(0, "accepted"), (1, "no_session")]


def test_empty_input(spark):
    located = m.located_events(spark.createDataFrame([], m.EVENT), spark.createDataFrame(PLACES, m.PLACE))
    assert m.fold_sessions(located, 10).collect() == []
    nulls = m.located_events(spark.createDataFrame([(None, 1, None, "start", 1, None, None, "r0", None, None, None, None), (1, 1, None, "start", None, None, None, "r0", None, None, None, None)], m.EVENT), spark.createDataFrame(PLACES, m.PLACE))
    assert m.fold_sessions(nulls).collect() == []
