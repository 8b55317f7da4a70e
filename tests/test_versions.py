import pytest
from pyspark.sql import functions as F

from surfparc.operators import ledger
from surfparc.sources import files, tables, versions


def roster(spark, ids, run="r", gradient=None):
    return spark.createDataFrame([(i, run, f"profile/{i}", gradient) for i in ids], "id string, run_id string, profile string, gradient string")


def merged(new):
    return lambda old: new if old is None else ledger.merge_subjects(new, old, ["profile", "gradient"])


def test_two_runs_do_not_lose_one_anothers_rows(spark, tmp_path):
    project, calls = str(tmp_path), []
    with pytest.raises(FileNotFoundError):
        tables.read(spark, project, "ledger")
    versions.commit(spark, project, "ledger", merged(roster(spark, ["1", "2"])))

    def late(old):
        # Another run commits between this one's reading and its own commit.
        calls.append(1)
        if len(calls) == 1:
            versions.commit(spark, project, "ledger", merged(roster(spark, ["1", "2"], gradient="gradient/here")))
        return merged(roster(spark, ["1", "2"]))(old)

    assert versions.commit(spark, project, "ledger", late) == 3
    assert len(calls) == 2
    assert {(r.id, r.gradient) for r in tables.read(spark, project, "ledger").collect()} == {("1", "gradient/here"), ("2", "gradient/here")}
    assert len([n for n in files.names(spark, f"{project}/ledger") if n.startswith("state-")]) == 3


def test_a_broken_commit_leaves_the_last_state(spark, tmp_path, monkeypatch):
    project = str(tmp_path)
    monkeypatch.setattr(versions, "PATIENCE_SECONDS", 0.3)
    versions.commit(spark, project, "ledger", merged(roster(spark, ["1"])))
    with pytest.raises(ZeroDivisionError):
        versions.commit(spark, project, "ledger", lambda old: 1 / 0)
    assert [r.id for r in tables.read(spark, project, "ledger").collect()] == ["1"]
    assert files.create(spark, f"{project}/ledger/_log/{2:012d}", "")
    assert not files.create(spark, f"{project}/ledger/_log/{2:012d}", "again")
    assert [r.id for r in tables.read(spark, project, "ledger").collect()] == ["1"]
    assert versions.commit(spark, project, "ledger", lambda old: old.withColumn("id", F.lit("9"))) == 3
    assert [r.id for r in tables.read(spark, project, "ledger").collect()] == ["9"]


def test_old_states_go_after_a_while(spark, tmp_path):
    project = str(tmp_path)
    for i in range(6):
        versions.commit(spark, project, "ledger", merged(roster(spark, [str(i)], run=str(i))))
    assert len(files.names(spark, f"{project}/ledger/_log")) == versions.KEPT + 1
    assert len([n for n in files.names(spark, f"{project}/ledger") if n.startswith("state-")]) == versions.KEPT + 1
    assert [r.id for r in tables.read(spark, project, "ledger").collect()] == ["5"]
