"""Forests, fusion model and jobs by their properties."""

import pytest
from pyspark.sql import functions as F

from cellgauge.operators import models as M
from cellgauge.operators.clean import preprocess
from cellgauge.operators.fusion import META, FusionModel
from cellgauge.operators.partition import location_heuristic, train_test_split
from cellgauge.plans import submit
from cellgauge.plans.evaluation import report_bundle
from cellgauge.plans.horizontal import run_horizontal
from cellgauge.plans.jobs import JobConfig
from cellgauge.plans.vertical import MODEL_TYPES, run_vertical
from cellgauge.sources import schema as S
from cellgauge.sources.network import network

TINY = M.ForestSettings(trees=5, depth=4, layout=4)
JOB = JobConfig(trees=4, depth=3)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return train_test_split(location_heuristic(preprocess(network(spark, sf_dir)))).cache()


@pytest.fixture(scope="module")
def train(rows):
    return rows.filter("split = 'train'")


@pytest.fixture(scope="module")
def test_side(rows):
    return rows.filter("split = 'test'")


def test_untrained_models_refuse(rows):
    model = M.monolithic_model(TINY)
    for use in (model.predict, model.evaluate, model.feature_importance):
        with pytest.raises(ValueError, match="must be trained"):
            use(rows)
    with pytest.raises(ValueError, match="must be trained"):
        FusionModel().predict(rows)
    with pytest.raises(ValueError, match="strategy"):
        FusionModel("vote")


def test_forest_beats_the_mean_and_repeats_itself(train, test_side):
    model = M.monolithic_model(TINY).train(train)
    assert model.evaluate(test_side).first()["r2"] > 0.3
    again = M.monolithic_model(TINY).train(train.repartition(3))
    key = [S.KEY, S.LATENCY, "prediction"]
    first = model.predict(test_side).select(key).orderBy(*key).limit(50).collect()
    assert first == again.predict(test_side).select(key).orderBy(*key).limit(50).collect()
    top = model.feature_importance(train, top=3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[1]["importance"]
    assert model.info(train).first()["is_trained"]


def test_nulls_use_training_medians_unless_asked(train, test_side):
    model = M.infrastructure_model(TINY).train(train)
    blank = test_side.withColumn(S.TRAFFIC, F.when(F.lit(False), F.col(S.TRAFFIC)))
    assert model.predict(blank).filter("prediction IS NULL").count() == 0
    part = test_side.withColumn(S.TRAFFIC, F.when(F.col(S.TRAFFIC) > 200, F.col(S.TRAFFIC)))
    own = model.predict(part, fill="batch").agg(F.sum("prediction")).first()[0]
    assert own != model.predict(part).agg(F.sum("prediction")).first()[0]


def test_segment_models_score_their_rows_only(train, test_side):
    models = M.train_segments(train, TINY)
    overall = M.monolithic_model(TINY).train(train)
    scored = M.score_horizontal(test_side, overall, models)
    assert scored.count() == test_side.count()
    for segment, model in models.items():
        own = F.col(S.LOCATION) == segment
        assert scored.filter(own & F.col(model.name).isNull()).count() == 0
        assert scored.filter(~own & F.col(model.name).isNotNull()).count() == 0
    assert scored.filter("global_model IS NULL").count() == 0


def test_small_segments_are_skipped(train):
    urban = train.filter(F.col(S.LOCATION) == "Urban").unionByName(
        train.filter(F.col(S.LOCATION) == "Rural").limit(3)
    )
    assert list(M.train_segments(urban, TINY)) == ["Urban"]
    with pytest.raises(ValueError, match="no segment has enough rows"):
        M.train_segments(urban, TINY, ["Rural"])
    with pytest.raises(ValueError, match="too few"):
        M.rural_model(TINY).train(urban)


def test_fusion_strategies(train, test_side):
    average = FusionModel(settings=TINY).train(train)
    assert sum(average.weights) == pytest.approx(1)
    table = {r["model_name"]: r["r2"] for r in average.compare(test_side).collect()}
    assert set(table) == {"infrastructure_model", "user_behavior_model", "fusion_model"}
    meta = FusionModel(META, TINY, oof=True)
    meta.infrastructure, meta.user = average.infrastructure, average.user
    assert meta.train(train).predict(test_side).filter("prediction IS NULL").count() == 0
    assert meta.parameters(train).first()["strategy"] == META


def test_out_of_fold_covers_every_row_once(train):
    make = {"infra": lambda: M.infrastructure_model(TINY)}
    assert M.cross_predict(train, make, 2).count() == train.count()
    folds = M.cross_validate(train, make, 2).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1]


def test_vertical_job_and_report(spark, sf_dir, tmp_path):
    result = run_vertical(network(spark, sf_dir), JOB)
    assert {r["model_name"] for r in result["comparison"].collect()} == set(MODEL_TYPES)
    assert result["split_check"].first()["is_valid"]
    submit.write_results(result, str(tmp_path / "job"))
    text = next((tmp_path / "job" / "summary").glob("part-*")).read_text()
    assert text.startswith("VERTICAL PARTITIONING RESULTS\n=====")
    test = result["predictions"].filter("split = 'test'")
    bundle = report_bundle(test, {n: n for n in MODEL_TYPES}, MODEL_TYPES, str(tmp_path / "report"))
    assert bundle["significance"].count() == 6
    assert (tmp_path / "report" / "performance_table").exists()
    result.close()


def test_horizontal_job(spark, sf_dir):
    result = run_horizontal(network(spark, sf_dir), JOB)
    names = {r["model_name"] for r in result["comparison"].collect()}
    assert names == {
        "urban_model", "rural_model", "global_model", "global_model_urban", "global_model_rural",
    }
    assert result["improvement"].count() == 2 and result["insights"].count() >= 2
    with pytest.raises(ValueError, match="add up"):
        run_horizontal(network(spark, sf_dir), JobConfig(trees=1, depth=1, strict=True))
    result.close()


def test_job_guards(towers):
    with pytest.raises(S.MissingColumnsError):
        run_vertical(towers().drop(S.DEVICE), JOB)
    few = towers(*[(f"T{i}", -70.0, 1.0, 5.0, 3, "Mobile", "Urban") for i in range(4)])
    with pytest.raises(ValueError, match="too few cleaned rows"):
        run_vertical(few, JOB)


@pytest.mark.parametrize("extra", [["--test-size", "0.05"], ["--random-state", "-1"]])
def test_bad_options_stop(extra):
    with pytest.raises(SystemExit):
        submit.parse(["vertical", "--data", "x.csv", *extra])


def test_failing_job_ends_with_one(spark, tmp_path, caplog):
    shown = ",".join(S.DISPLAY_NAMES.values())
    (tmp_path / "few.csv").write_text(f"{shown}\nT1,-70,oops,5,3,Mobile,Urban\n")
    (tmp_path / "bare.csv").write_text("Tower ID\nT1\n")
    assert submit.main(["vertical", "--data", str(tmp_path / "few.csv")]) == 1
    assert "network_traffic: 1 values do not parse" in caplog.text
    assert "too few" in caplog.text
    assert submit.main(["horizontal", "--data", str(tmp_path / "bare.csv")]) == 1
    assert submit.main(["vertical", "--data", str(tmp_path / "absent.csv")]) == 1


def test_good_options():
    args = submit.parse(["horizontal", "--data", "x.csv", "--strict"])
    assert args.test_size == 0.2 and args.random_state == 42 and args.strict
