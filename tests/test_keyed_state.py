import random
import time
from datetime import datetime, timedelta

import pytest

from lodestar.operators import state
from lodestar.streaming import incremental, keyed_state

AS_OF = datetime(2024, 6, 1)
SCHEMA = "entity_id string, signal string, value_num double, value_bool boolean, value_text string, weight double, observed_at timestamp, date_estimated boolean, ord long"
SIGNALS = [("quiet", "numeric", 90), ("beauty", "numeric", 0), ("water", "boolean", 30), ("spot_closed", "boolean", 60), ("kind", "text", 45)]


def made(n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        signal = rng.choice([*[s for s, _, _ in SIGNALS], "unknown"])
        at = AS_OF - timedelta(days=rng.choice([0, 1, 20, 300, 4000, rng.random() * 500]))
        out.append((rng.choice("abcd"), signal, rng.choice([None, 0.2, 0.9, 3.5]), rng.choice([None, True, False]), rng.choice([None, "", "road", "train", "sea"]),
                    rng.choice([1.0, 0.5, 0.25, 0.0, -1.0, None]), rng.choice([at] * 20 + [None]), rng.choice([None, False, False, True]), k))
    return out


@pytest.fixture
def rocks(spark):
    with keyed_state.settings(spark):
        yield


def run(spark, folder, batches, **options):
    """The table's latest rows after these batches, each a file and a run of its own, from where the runs before stood."""
    signals = spark.createDataFrame(SIGNALS, "signal string, value_type string, half_life int")
    out = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{time.time_ns()}-{k}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        out = incremental.run_once(keyed_state.entity_states(stream, signals, **options), ["entity_id", "signal"], f"{folder}/out")
    return out


def rounded(rows):
    return {(r.entity_id, r.signal): tuple(round(x, 4) if isinstance(x, float) else x for x in r[2:]) for r in rows.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_an_aggregation_after_any_order_of_batches(spark, rocks, tmp_path, seed):
    rows = made(160, seed)
    signals = spark.createDataFrame(SIGNALS, "signal string, value_type string, half_life int")
    want = rounded(state.aggregate_observations(spark.createDataFrame(rows, SCHEMA), signals, AS_OF))
    mixed = rows.copy()
    random.Random(seed + 9).shuffle(mixed)
    got = run(spark, tmp_path, [mixed[:100], mixed[100:110], mixed[110:]], clock=AS_OF)
    assert len(want) > 12 and rounded(keyed_state.scores_at(got, AS_OF)) == want


def test_what_is_to_come_waits_and_later_counts(spark, rocks, tmp_path):
    rows = [("a", "quiet", 0.5, None, None, 1.0, AS_OF - timedelta(days=9), None, 1), ("a", "quiet", 0.9, None, None, 1.0, AS_OF + timedelta(days=9), None, 2),
            ("a", "kind", None, None, "sea", 1.0, AS_OF + timedelta(days=2), None, 3), ("a", "kind", None, None, "road", 0.5, AS_OF, None, 4)]
    signals = spark.createDataFrame(SIGNALS, "signal string, value_type string, half_life int")
    want = rounded(state.aggregate_observations(spark.createDataFrame(rows, SCHEMA), signals, AS_OF))
    assert rounded(keyed_state.scores_at(run(spark, tmp_path, [rows[:2], rows[2:]], clock=AS_OF), AS_OF)) == want


@pytest.mark.parametrize("live", [None, 1 / 86400])
def test_timers_fold_what_is_due_and_old_signals_leave(spark, rocks, tmp_path, live):
    now = datetime.now()
    first = [("a", "water", None, True, None, 1.0, now, None, 2)] + ([("a", "quiet", 0.5, None, None, 1.0, now + timedelta(seconds=20), None, 1)] if live is None else [])
    got = run(spark, tmp_path, [first], live_days=live)
    assert {r.signal: (r.n, sum(r.waiting) > 0) for r in got.collect()} == {"water": (1, False)} | ({"quiet": (1, True)} if live is None else {})
    time.sleep(max(2, 21 - (datetime.now() - now).total_seconds()))
    got = run(spark, tmp_path, [[("a", "water", None, False, None, 1.0, now, None, 3)]], live_days=live)
    after = {r.signal: (r.n, sum(r.waiting)) for r in got.collect()}
    assert after == ({"water": (2, 0.0), "quiet": (1, 0.0)} if live is None else {"water": (1, 0.0)})
