import os
from functools import partial

import pytest
from conftest import DATA
from frames import BASE, transactions

from txscreen.plans import catalog
from txscreen.schema import TRANSACTION_SCHEMA
from txscreen.sources import (
    files,
    job_folder,
    keep_on_disk,
    materialize,
    new_path,
    session_settings,
    stored_result,
)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_csv_roundtrip_keeps_rows_and_types(spark, tmp_path):
    tx = catalog.transactions(spark, f"{DATA}/sf0.001")
    files.write_csv(tx, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert back.schema == TRANSACTION_SCHEMA
    assert as_set(back) == as_set(tx)


def test_csv_write_overwrites(spark, tmp_path):
    for _ in range(2):
        files.write_csv(transactions(spark, {}), str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 1


def test_csv_columns_may_come_in_any_order_and_with_others(spark, tmp_path):
    names = [*reversed(BASE), "note"]
    values = [*map(str, reversed(BASE.values())), "hello"]
    (tmp_path / "t.csv").write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    row = files.read_csv(spark, str(tmp_path / "t.csv")).first().asDict()
    assert row == {**BASE, "note": "hello"}


def test_csv_with_a_column_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text("step,type\n1,PAYMENT\n")
    with pytest.raises(ValueError, match="missing amount"):
        files.read_csv(spark, str(tmp_path / "t.csv"))


def test_csv_files_with_different_headers_fail(spark, tmp_path):
    names = list(BASE)
    for file, order in (("a.csv", names), ("b.csv", names[::-1])):
        line = ",".join(str(BASE[n]) for n in order)
        (tmp_path / file).write_text(",".join(order) + "\n" + line + "\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path)).collect()


def test_csv_with_a_bad_value_fails_instead_of_losing_the_label(spark, tmp_path):
    row = {**BASE, "isFraud": "yes"}
    (tmp_path / "t.csv").write_text(",".join(row) + "\n" + ",".join(map(str, row.values())) + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        files.read_csv(spark, str(tmp_path / "t.csv")).collect()
    lenient = files.read_csv(spark, str(tmp_path / "t.csv"), mode="PERMISSIVE")
    assert lenient.first().isFraud is None


def test_csv_schema_can_be_inferred(spark, tmp_path):
    files.write_csv(transactions(spark, {"isFraud": None}, {}), str(tmp_path / "csv"))
    inferred = files.read_csv(spark, str(tmp_path / "csv"), infer_schema=True)
    assert [f.dataType for f in inferred.schema] == [f.dataType for f in TRANSACTION_SCHEMA]


def test_parquet_is_read_as_stored(spark, tmp_path):
    tx = transactions(spark, {}, {"isFraud": 1})
    tx.withColumn("isFraud", tx.isFraud.cast("long")).write.parquet(str(tmp_path / "t"))
    fraud = files.read_parquet(spark, str(tmp_path / "t")).filter("isFraud = 1").select("type")
    plan = fraud._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(isFraud), EqualTo(isFraud,1)]" in plan
    assert fraud.count() == 1


def test_parquet_with_a_number_stored_as_text(spark, tmp_path):
    tx = transactions(spark, {})
    tx.withColumn("amount", tx.amount.cast("string")).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="amount is stored as string"):
        files.read_parquet(spark, str(tmp_path / "t"))


def test_schema_profile(spark):
    rows = [tuple(r) for r in files.schema_profile(transactions(spark, {})).collect()]
    assert rows[0] == (0, "step", "int") and rows[2] == (2, "amount", "double") and len(rows) == 11


def test_stored_tables_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x").startswith(f"{shared}/x-")
    stored = materialize(transactions(spark, {}, {}), "t")
    assert stored.count() == 2
    assert all(f.split("://")[-1].startswith(shared) for f in stored.inputFiles())


class FakeSession:
    """Just what decides on the folder for stored tables."""

    def __init__(self, master, configured=None):
        self.folder = None
        self.conf = self.sparkContext = self
        self.master, self.configured = master, configured

    def get(self, key, default):
        return self.configured or default if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session():
    assert new_path(FakeSession("yarn", "hdfs://x/y/"), "t").startswith("hdfs://x/y/t-")


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    with pytest.raises(ValueError, match="one machine"):
        new_path(FakeSession("yarn", "file:///tmp/x"), "t")
    assert new_path(FakeSession("local[2]", "file:///tmp/x"), "t").startswith("file:///tmp/x/t-")


def test_without_a_shared_folder_only_a_local_session_makes_one():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        new_path(FakeSession("yarn"), "t")
    local = FakeSession("local[2]")
    assert new_path(local, "t").startswith(local.folder)


def test_job_folder_is_gone_after_the_job(spark):
    with job_folder(spark) as folder:
        stored = materialize(transactions(spark, {}, {"type": "X"}), "t", partition_by=("type",))
        assert stored.filter("type = 'X'").count() == 1
        assert all(f"{folder}/t_" in f for f in stored.inputFiles())
        assert new_path(spark, "t").startswith(f"{folder}/t-")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
    assert "/job_" not in new_path(spark, "t")
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("job_")]


def test_bucketed_tables_join_without_a_shuffle(spark):
    rows = spark.range(100).selectExpr("id", "2 * id AS twice")
    store = partial(materialize, rows, "bucketed", bucket_by=("id",), buckets=4)
    with job_folder(spark):
        assert sum(r["twice"] for r in store().collect()) == 9900
    outside = store()
    assert outside.columns == rows.columns and outside.count() == 100
    with session_settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = outside.join(store(), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_job_folder_is_gone_after_a_failure(spark):
    with pytest.raises(RuntimeError), job_folder(spark) as folder:
        materialize(transactions(spark, {}), "t")
        raise RuntimeError
    assert not os.path.exists(folder)


def tables_below(folder):
    return sorted(d for d in os.listdir(folder) if not d.startswith("."))


def test_inner_tables_go_once_the_result_is_stored(spark):
    def build():
        inner = materialize(transactions(spark, {}, {"step": 2}), "inner")
        deeper = stored_result(spark, "deeper", lambda: materialize(inner, "innermost"))
        return deeper.filter("step = 2")

    with job_folder(spark) as folder:
        for n in (1, 2):
            result = stored_result(spark, "stage", build)
            assert result.count() == 1
            assert len(tables_below(folder)) == n
            assert all(d.startswith("stage_") for d in tables_below(folder))
    outside = stored_result(spark, "stage", build)
    assert outside.count() == 1 and "/job_" not in outside.inputFiles()[0]
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("job_")]


def test_inner_tables_go_after_a_failure(spark):
    def build():
        materialize(transactions(spark, {}), "inner")
        raise RuntimeError

    with job_folder(spark) as folder:
        with pytest.raises(RuntimeError):
            stored_result(spark, "stage", build)
        assert tables_below(folder) == []
        assert f"{folder}/t-" in new_path(spark, "t")


def test_kept_rows_are_let_go_with_the_job(spark):
    rows = transactions(spark, {"step": 77})
    with job_folder(spark):
        kept = keep_on_disk(rows)
        assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    assert not rows.storageLevel.useDisk


def test_settings_are_put_back(spark):
    keys = ("spark.sql.shuffle.partitions", "spark.txscreen.unknown")
    before = [spark.conf.get(k, None) for k in keys]
    with pytest.raises(RuntimeError), session_settings(spark, dict.fromkeys(keys, "5")):
        assert [spark.conf.get(k) for k in keys] == ["5", "5"]
        raise RuntimeError
    assert [spark.conf.get(k, None) for k in keys] == before


def write_lines(path, *rows, header=True):
    lines = [",".join(BASE)] if header else []
    lines += [r if isinstance(r, str) else ",".join(map(str, {**BASE, **r}.values())) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def test_account_of_three_kinds_of_broken_rows(spark, tmp_path):
    broken = [",".join(map(str, {**BASE, "isFraud": "yes"}.values())), "1,TRANSFER,5.0"]
    broken.append(",".join(map(str, BASE.values())) + ",extra")
    (tmp_path / "in").mkdir()
    write_lines(tmp_path / "in" / "a.csv", {}, broken[0], {"step": 2}, broken[1])
    write_lines(tmp_path / "in" / "b.csv", broken[2], {"isFraud": ""}, {"isFraud": 1})
    write_lines(tmp_path / "in" / "c.csv", broken[0])
    write_lines(tmp_path / "in" / "d.csv", {"step": 9})
    write_lines(tmp_path / "in" / "e.csv")
    account = files.read_csv_with_account(spark, str(tmp_path / "in"))
    assert account.rows.schema == TRANSACTION_SCHEMA
    rows = sorted((r.step, str(r.isFraud)) for r in account.rows.collect())
    assert rows == [(1, "0"), (1, "1"), (1, "None"), (2, "0"), (9, "0")]
    counts = {r.file[-5:]: tuple(r)[1:] for r in account.files.collect()}
    assert counts == {"a.csv": (4, 2, 2), "b.csv": (3, 2, 1), "c.csv": (1, 0, 1), "d.csv": (1, 1, 0)}
    refused = sorted((r.file[-5:], r.text) for r in account.refused.collect())
    assert refused == sorted(
        [("a.csv", broken[0]), ("a.csv", broken[1]), ("b.csv", broken[2]), ("c.csv", broken[0])]
    )
    lines = sum(len(p.read_text().splitlines()) - 1 for p in (tmp_path / "in").iterdir())
    assert lines == sum(c[0] for c in counts.values())


def test_account_without_broken_rows_or_without_rows(spark, tmp_path):
    write_lines(tmp_path / "t.csv", {}, {"isFraud": 1})
    account = files.read_csv_with_account(spark, str(tmp_path / "t.csv"))
    assert account.rows.count() == 2 and account.refused.count() == 0
    write_lines(tmp_path / "none.csv")
    account = files.read_csv_with_account(spark, str(tmp_path / "none.csv"))
    assert account.rows.count() == account.refused.count() == account.files.count() == 0


def test_account_of_columns_in_another_order_and_with_a_clashing_name(spark, tmp_path):
    names = [*reversed(BASE), "line_text"]
    values = [*map(str, reversed(BASE.values())), "hello"]
    text = "\n".join([",".join(names), ",".join(values), "x," + ",".join(values[1:]), ""])
    (tmp_path / "t.csv").write_text(text)
    account = files.read_csv_with_account(spark, str(tmp_path / "t.csv"))
    assert account.rows.first().asDict() == {**BASE, "line_text": "hello"}
    assert account.refused.first().text == "x," + ",".join(values[1:])


def test_account_of_files_with_different_headers_fails(spark, tmp_path):
    for file, order in (("a.csv", list(BASE)), ("b.csv", list(BASE)[::-1])):
        line = ",".join(str(BASE[n]) for n in order)
        (tmp_path / file).write_text(",".join(order) + "\n" + line + "\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv_with_account(spark, str(tmp_path))
