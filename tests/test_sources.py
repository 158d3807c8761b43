import json

import pytest

from cellgauge.session import ensure_checkpoint_dir
from cellgauge.sources import schema as S
from cellgauge.sources import sinks
from cellgauge.sources.tables import load_observations, read_table, spread

CSV = """Tower ID,Signal Strength (dBm),Network Traffic (MB),Latency (ms),User Count,Device Type,Location Type
north,-91.0,12.25,8.5,7,Desktop,Urban
south,-55.5,,101.0,31.5,Mobile,Rural
west,-102.75,640.0,n/a,12,IoT,
"""


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "towers.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_with_display_names(spark, csv_path):
    rows = {r[S.KEY]: r for r in load_observations(spark, csv_path).collect()}
    assert rows["north"][S.USERS] == 7 and rows["north"][S.LATENCY] == 8.5
    assert rows["south"][S.TRAFFIC] is None and rows["south"][S.USERS] == 32
    assert rows["west"][S.LATENCY] is None and rows["west"][S.LOCATION] is None


def test_cast_failures_are_counted(spark, csv_path):
    raw = S.canonical_names(read_table(spark, csv_path))
    failed = {r["column_name"]: r["n_failed"] for r in S.cast_failures(raw).collect()}
    assert failed[S.LATENCY] == 1 and sum(failed.values()) == 1


@pytest.mark.parametrize("line", ["east,-80.0,1.0", "east,-80.0,1.0,2.0,3,IoT,Urban,more"])
def test_ragged_csv_lines_are_counted_and_left_out(spark, csv_path, line):
    with open(csv_path, "a") as out:
        out.write(line + "\n")
    raw = S.canonical_names(read_table(spark, csv_path))
    assert [r[S.CORRUPT] for r in raw.filter(f"{S.CORRUPT} is not null").collect()] == [line]
    failed = {r["column_name"]: r["n_failed"] for r in S.cast_failures(raw).collect()}
    assert failed[S.CORRUPT] == 1 and failed[S.LATENCY] == 1 and sum(failed.values()) == 2
    rows = load_observations(spark, csv_path)
    assert rows.columns == S.REQUIRED and {r[S.KEY] for r in rows.collect()} == {"north", "south", "west"}


def test_broken_json_lines(spark, tmp_path):
    whole = json.dumps(dict(zip(S.REQUIRED, ["a", -60.0, 1.0, 2.0, 3, "IoT", "Urban"])))
    for name, lines, n in [("some", [whole, whole[:30], "", "nonsense"], 2), ("none", [whole], 0)]:
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(lines))
        failed = {r["column_name"]: r["n_failed"] for r in S.cast_failures(read_table(spark, str(path))).collect()}
        assert failed[S.CORRUPT] == n and sum(failed.values()) == n
        assert [r[S.USERS] for r in load_observations(spark, str(path)).collect()] == [3]


def test_whole_numbers_out_of_range_do_not_parse(spark):
    rows = [("99999999999",), ("12.0",), ("NaN",), ("x",), (None,)]
    df = spark.createDataFrame(rows, f"{S.USERS} string")
    part = type(S.CONTRACT)([S.CONTRACT[S.USERS]])
    assert S.cast_failures(df, part).first()["n_failed"] == 2


def test_missing_and_unreadable_paths_differ(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "absent.parquet"))
    broken = tmp_path / "broken.parquet"
    broken.write_text("not a parquet file")
    with pytest.raises(ValueError):
        read_table(spark, str(broken))
    with pytest.raises(ValueError):
        read_table(spark, str(broken), "excel")


def test_missing_columns_are_named(spark):
    with pytest.raises(S.MissingColumnsError, match="latency"):
        S.apply_contract(spark.createDataFrame([("a",)], [S.KEY]))


def test_nan_becomes_null(spark):
    row = ("T", float("nan"), 1.0, 2.0, 3, "Mobile", "Urban")
    df = spark.createDataFrame([row], S.CONTRACT)
    assert S.apply_contract(df).first()[S.SIGNAL] is None


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("m", 1.5), ("n", None)], "model_name string, mae double")
    sinks.write_csv(table, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["model_name", "mae"] and back.count() == 2
    sinks.write_metrics_json(table, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    record = sinks.run_record(spark, "vertical", "in", 0.2, 42, "out")
    sinks.write_json(record, str(tmp_path / "config"))
    text = next((tmp_path / "config").glob("part-*")).read_text()
    assert json.loads(text)["random_state"] == 42
    lines = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "line_number int, line string")
    sinks.write_text(lines, str(tmp_path / "text"))
    assert next((tmp_path / "text").glob("part-*")).read_text() == "a\nb\nc\n"


def test_spread_only_widens_narrow_scans(spark):
    narrow = spark.range(100).coalesce(1)
    assert spread(narrow, "id").rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 20)
    assert spread(wide, "id") is wide


def test_checkpoint_folder_is_set_once(spark):
    ensure_checkpoint_dir(spark)
    first = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().get() == first
