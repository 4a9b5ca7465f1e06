import json
from datetime import date, datetime

import pytest
from pyspark.sql.utils import StreamingQueryException

from lodestar.operators import transactions
from lodestar.sources.versioned import VersionedTables

AS_OF = datetime(2024, 2, 1)
REVIEWS = [(1, "a quiet place with friendly dogs", datetime(2024, 1, 1), 0.5), (2, "noisy road beside it", datetime(2024, 1, 1), 0.5)]
SIGNALS = [("quietness", "numeric", 30), ("dog_friendly", "boolean", 60)]


def claim(signal, value, review, excerpt="quiet place"):
    return {"signal": signal, "value": value, "confidence": 0.8, "review_id": review, "excerpt": excerpt}


FIRST = [
    (7, 1, json.dumps({"claims": [claim("quietness", "0.8", "1"), claim("quietness", "0.1", "1"), claim("unheard", "1", "1"), claim("dog_friendly", "true", "2", "sunny beach nearby")],
                       "alerts": [{"alert_type": "theft", "severity": 0.4, "confidence": 0.9, "valid_from_inferred": "2024-01-05", "source_review_ids": ["2"]}],
                       "cross_references": [{"mentioned_name": "Lake", "relation_type": "same_complex", "review_id": "2"}], "summary": "old", "tags": ["x"]})),
    (8, 2, "no json"), (None, 3, json.dumps({"summary": "nowhere"})), (9, 4, json.dumps({"summary": "alone"})),
]
SECOND = [
    (7, 5, json.dumps({"claims": [claim("quietness", "0.3", "1"), claim("quietness", "0.4", "2", "noisy road")],
                       "alerts": [{"alert_type": "theft", "severity": 0.7, "confidence": 0.2, "valid_from_inferred": "never", "source_review_ids": ["1", "2"]}, {"alert_type": "noise", "severity": 1, "confidence": 1}],
                       "cross_references": [{"mentioned_name": "Lake", "relation_type": "same_complex", "review_id": "1"}], "summary": "new", "tags": []})),
]
PAYLOAD = "spot_id long, seq long, payload string"


def held(tables):
    now = tables.snapshot()
    rows = lambda name, *c: sorted(tuple(r) for r in now.read(name).select(*c).collect())
    return {
        "claims": rows("claims", "spot_id", "signal", "review_id", "value"), "observations": rows("observations", "entity_id", "signal", "value_num"), "states": rows("states", "entity_id", "signal", "score_num", "n_observations"),
        "alerts": rows("alerts", "spot_id", "alert_type", "severity", "confidence", "valid_from", "source_review_ids"), "relations": rows("relations", "spot_id", "mentioned_name", "relation_type", "review_id"),
        "spots": rows("spots", "spot_id", "summary", "tags", "active_alert_types", "epoch"),
    }


AFTER_FIRST = {
    "claims": [(7, "quietness", 1, "0.8")], "observations": [(7, "quietness", 0.8)], "states": [(7, "quietness", 0.8, 1)], "alerts": [(7, "theft", 0.4, 0.9, date(2024, 1, 5), ["2"])],
    "relations": [(7, "Lake", "same_complex", 2)], "spots": [(7, "old", ["x"], ["theft"], 0), (9, "alone", None, [], 0)],
}
AFTER_SECOND = {
    "claims": [(7, "quietness", 1, "0.8"), (7, "quietness", 2, "0.4")], "observations": [(7, "quietness", 0.4), (7, "quietness", 0.8)], "states": [(7, "quietness", 0.6, 2)],
    "alerts": [(7, "noise", 1.0, 1.0, date(2024, 2, 1), []), (7, "theft", 0.7, 0.9, date(2024, 1, 5), ["1", "2"])],
    "relations": [(7, "Lake", "same_complex", 1)], "spots": [(7, "new", ["x"], ["noise", "theft"], 1), (9, "alone", None, [], 0)],
}


def test_a_killed_stream_leaves_all_of_an_epoch_or_nothing(spark, tmp_path, monkeypatch):
    reviews = spark.createDataFrame(REVIEWS, "review_id long, text string, at timestamp, source_confidence double")
    signals = spark.createDataFrame(SIGNALS, "signal string, value_type string, half_life int")
    tables = transactions.store(spark, f"file://{tmp_path}/tables", 4)

    def run():
        stream = spark.readStream.schema(PAYLOAD).parquet(f"file://{tmp_path}/payloads")
        transactions.ingest_stream(stream, tables, reviews, signals, lambda _: AS_OF, f"file://{tmp_path}/checkpoint").awaitTermination()

    def come(rows):
        spark.createDataFrame(rows, PAYLOAD).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/payloads")

    come(FIRST)
    run()
    assert held(tables) == AFTER_FIRST
    come(SECOND)
    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "_note", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(StreamingQueryException):
            run()
    assert tables.snapshot().version == 0 and held(tables) == AFTER_FIRST  # all six tables were written, none is seen
    run()
    assert held(tables) == AFTER_SECOND and tables.snapshot().version == 1
    again = spark.createDataFrame(SECOND, PAYLOAD)
    assert not transactions.ingest(tables, 1, again, reviews, signals, AS_OF)  # a batch that is run again is applied once
    assert transactions.ingest(tables, 2, again.where("seq < 0"), reviews, signals, AS_OF) and held(tables) == AFTER_SECOND


def test_payloads_of_one_file_are_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    reviews = spark.createDataFrame(REVIEWS, "review_id long, text string, at timestamp, source_confidence double")
    signals = spark.createDataFrame(SIGNALS, "signal string, value_type string, half_life int")
    tables, parsed, tasks = transactions.store(spark, f"file://{tmp_path}/tables", 4), transactions.llm_payload.validated, []

    def validated(payloads, *args, **kwargs):
        tasks.append(payloads.rdd.getNumPartitions())
        return parsed(payloads, *args, **kwargs)

    monkeypatch.setattr(transactions.llm_payload, "validated", validated)
    assert transactions.ingest(tables, 0, spark.createDataFrame(FIRST, PAYLOAD).coalesce(1), reviews, signals, AS_OF)
    assert held(tables) == AFTER_FIRST and tasks == [4 * spark.sparkContext.defaultParallelism]
