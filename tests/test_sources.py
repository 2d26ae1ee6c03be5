"""Readers, writers, registry, bronze store, audit and the link-to-fixture path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.functions.payloads import payload_hash
from touchline.operators.quality import DataQualityError
from touchline.plans.odds import empty_expected_value, import_odds
from touchline.plans.serving import link_fixtures
from touchline.sources import audit, bronze, io, registry


def teams(spark, n=48):
    return spark.createDataFrame(
        [(f"t{i}", f"Team {i}", f"C{i:02d}", "UEFA", "ABCDEFGHIJKL"[i % 12], i == 0, f"Team {i}", i, f"team-{i}") for i in range(n)],
        registry.REGISTRY_SCHEMA,
    )


def test_registry_checks(spark):
    checked = registry.check_registry(teams(spark))
    assert checked.count() == 48 and checked.first()["is_registered_team"]
    with pytest.raises(ValueError, match="Expected 48"):
        registry.check_registry(teams(spark, 47))
    twice = teams(spark).withColumn("fifa_code", F.lit("X"))
    with pytest.raises(DataQualityError, match="fifa_code"):
        registry.check_registry(twice)


def test_aliases(spark):
    aliases = registry.build_aliases(spark, teams(spark))
    names = spark.createDataFrame([("Korea Republic",), ("Congo DR",), ("Team 3",), ("nobody",)], "name string")
    got = {r["name"]: r["team_id"] for r in registry.resolve_team(names, aliases, "name").collect()}
    assert got == {"Korea Republic": "south_korea", "Congo DR": "dr_congo", "Team 3": "t3", "nobody": None}


def test_formats_and_optional_datasets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, name string")
    io.write_layer(df, str(tmp_path), "silver", "names", ["id"])
    assert io.read_layer(spark, str(tmp_path), "silver", "names").count() == 2
    io.write_report(df, str(tmp_path / "report"))
    assert io.read_by_suffix(spark, str(tmp_path / "report"), "id bigint, name string").count() == 2
    assert io.read_optional(spark, str(tmp_path / "nothing"), "event_id bigint, side string").count() == 0
    kept = io.write_extract(df, str(tmp_path / "extract.parquet"), ["id", "missing"])
    assert kept == ["id"] and io.read_parquet(spark, str(tmp_path / "extract.parquet")).columns == ["id"]
    one = io.read_parquet(spark, str(tmp_path / "extract.parquet"), ["id"], F.col("id") == 2)
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,2)]" in one._jdf.queryExecution().toString()
    assert empty_expected_value(spark).count() == 0
    io.write_marts(df, str(tmp_path / "marts"), {"a": ["id"], "b": ["id", "name"]})
    assert spark.read.parquet(str(tmp_path / "marts" / "b")).columns == ["id", "name"]


def test_bronze_store_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "bronze")
    rows = spark.createDataFrame(
        [("events", '{"a":1,"b":2}', "t1"), ("events", '{"b":2,"a":1}', "t2"), ("details", '{"a":1}', "t1"), ("events", "broken", "t1")],
        "category string, payload string, fetched_at string",
    )
    assert bronze.store_payloads(spark, rows, path, F.lit("2024-01-01")) == 2
    assert bronze.store_payloads(spark, rows, path, F.lit("2024-01-02")) == 0
    assert spark.read.parquet(path).count() == 2


def test_raw_files_with_sidecar(spark, tmp_path):
    folder = tmp_path / "category=events" / "fetch_date=2024-01-01"
    folder.mkdir(parents=True)
    (folder / "abc.json").write_text('{"x":\n1}')
    (folder / "abc.meta.json").write_text('{"url":"u"}')
    row = bronze.read_raw_files(spark, str(tmp_path)).first()
    assert row["payload_hash"] == "abc" and row["metadata"] == '{"url":"u"}' and row["category"] == "events"


def test_audit_lifecycle(spark, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("src", "dst", "audit"))
    spark.range(5).write.parquet(source)
    audit.load_table(spark, source, target, "raw.t", log)
    with pytest.raises(Exception):
        audit.load_table(spark, source + "-missing", target, "raw.t", log)
    states = audit.audit_listing(audit.read_audit(spark, log)).collect()
    assert sorted(r["status"] for r in states) == ["failed", "success"]
    assert [r["row_count"] for r in states if r["status"] == "success"] == [5]


def test_import_odds_from_csv(spark, tmp_path):
    path = tmp_path / "odds.csv"
    path.write_text(
        "event_id,bookmaker,market,selection,odds,odds_format,snapshot_utc,kickoff_utc\n"
        "1,b,m,home,2.0,decimal,2024-01-01T00:00:00Z,2024-01-02T00:00:00Z\n"
        "1,b,m,away,2.0,decimal,2024-01-01T00:00:00Z,2024-01-02T00:00:00Z\n"
    )
    got = import_odds(spark, str(path), str(tmp_path / "out.parquet"), ["snapshot_utc"])
    assert [r["no_vig_probability"] for r in got.collect()] == [0.5, 0.5]


def test_links_to_fixtures(spark):
    payload = (
        '{"event":{"startTimestamp":1780336800,"homeTeam":{"id":1,"name":"A"},"awayTeam":{"id":%d,"name":"B"},'
        '"venue":{"country":{"name":"USA"}}}}'
    )
    url = "https://scores.example.com/x/y#id:%d"
    links = spark.createDataFrame([(url % 10,), (url % 11,), (url % 12,), ("https://bad.example.com/",)], "url string")
    payloads = spark.createDataFrame([(10, payload % 2), (11, payload % 99)], "event_id bigint, payload string")
    cache = spark.createDataFrame([(10, "{}")], "event_id bigint, payload string")
    dim = registry.check_registry(teams(spark))
    ok, rejected = link_fixtures(links, payloads.withColumn("fetched_at", F.lit(1)), cache, dim, ["scores.example.com"], newest="fetched_at")
    row = ok.first()
    assert ok.count() == 1 and (row["home_team_id"], row["away_team_id"], row["neutral_site"]) == ("t1", "t2", 1)
    reasons = {r["event_id"]: r["reject_reason"] for r in rejected.collect()}
    assert reasons == {11: "no team history for: B", 12: "no payload for the event", None: "not a supported match link"}


def test_payload_hash_of_bad_json_is_null(spark):
    assert spark.range(1).select(payload_hash(F.lit("{"))).first()[0] is None
