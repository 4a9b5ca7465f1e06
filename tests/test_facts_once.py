from lodestar.operators import facts


def test_facts_are_parsed_once_by_many_tasks(spark):
    rows = [(1, '{"agua_potable": true, "servicios_extras": {"bbq": "yes", "prohibitions": ["No Dogs", null], "ground": " Mud "}}'), (2, "{broken"), (3, None), (4, '{"servicios_extras": [1]}')]
    out = facts.claims_of_facts(spark.createDataFrame(rows, "record_id long, facts string").coalesce(1))
    assert {(r.record_id, r.signal, r.value) for r in out.collect()} == {(1, "water_working", "true"), (1, "campfire_allowed", "true"), (1, "road_quality", "0.1"), (1, "dog_friendly", "false")}
    assert "get_json_object" not in out._jdf.queryExecution().toString()
    assert out.rdd.getNumPartitions() > 1
