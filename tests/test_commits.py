"""Several tables in one commit, and jobs that write them."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from vendorlytics.plans import new_tables, reads
from vendorlytics.plans.changes_accounts import CLIENT_QUOTA, client_admission
from vendorlytics.run import main
from vendorlytics.sources import commits
from vendorlytics.sources.tables import FixtureTables, SnapshotTables


def frame(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_tables_become_visible_together(spark):
    root = tempfile.mkdtemp(prefix="vl-commit-")
    assert commits.current_commit(spark, root) is None and commits.versions(spark, root) == {}
    assert commits.commit_tables(spark, root, {"a": frame(spark, 1), "b": frame(spark, 1)}) == 0
    assert commits.commit_tables(spark, root, {"b": frame(spark, 1, 2)}, expected=0) == 1
    assert ids(commits.read_table(spark, root, "a")) == [1] and ids(commits.read_table(spark, root, "b")) == [1, 2]
    assert ids(commits.read_table(spark, root, "b", commit=0)) == [1]
    with pytest.raises(FileNotFoundError):
        commits.read_table(spark, root, "c")


def test_a_job_that_dies_changes_nothing(spark):
    root = tempfile.mkdtemp(prefix="vl-commit-")
    commits.commit_tables(spark, root, {"a": frame(spark, 1), "b": frame(spark, 1)})
    bad = frame(spark, 1).select(F.raise_error(F.lit("died")).cast("long").alias("id"))
    with pytest.raises(Exception, match="died"):
        commits.commit_tables(spark, root, {"a": frame(spark, 9), "b": bad})
    assert ids(commits.read_table(spark, root, "a")) == [1] and commits.current_commit(spark, root) == 0
    # the job that follows doesn't reuse the versions that the dead one left
    assert commits.commit_tables(spark, root, {"a": frame(spark, 5)}) == 1
    assert commits.versions(spark, root) == {"a": 2, "b": 0} and ids(commits.read_table(spark, root, "a")) == [5]


def test_retries_and_rival_writers(spark):
    root = tempfile.mkdtemp(prefix="vl-commit-")
    commits.commit_tables(spark, root, {"a": frame(spark, 1)})
    assert commits.commit_tables(spark, root, {"a": frame(spark, 2)}, expected=0) == 1
    assert commits.commit_tables(spark, root, {"a": frame(spark, 3)}, commit=1, expected=0) == 1
    assert ids(commits.read_table(spark, root, "a")) == [3]
    with pytest.raises(RuntimeError):
        commits.commit_tables(spark, root, {"a": frame(spark, 4)}, expected=0)


@pytest.fixture(scope="module")
def root(spark):
    fx, root = FixtureTables(spark, SMALL), tempfile.mkdtemp(prefix="vl-app-")
    for method, name in SnapshotTables.NAMES.items():
        if hasattr(fx, method):
            getattr(fx, method)().write.parquet(f"{root}/{name}")
    return root


def test_requests_are_committed_to_real_tables(spark, root):
    """W8 by the command line, with requests of its own: product and
    inventory row appear together; the next job reads them."""
    before = SnapshotTables(spark, root)
    n_products, n_items = before.products().count(), before.inventory().count()
    req = spark.createDataFrame([(1, 3, "Anillo", "MIO-1", 4, 10.5), (2, 3, None, "MIO-2", 4, 1.0), (3, 1, "Aro", "MIO-1", 1, 2.0)],
                                "seq long, vendedor_id long, nombre string, sku string, stock int, precio double") \
        .withColumn("precio_personalizado", F.col("precio").cast("decimal(18,2)")).withColumn("req_id", F.col("seq"))
    req.write.parquet(f"{root}/peticiones")
    main(["custom_item_submit", "--tables", root, "--requests", f"{root}/peticiones", "--commit"])
    t = SnapshotTables(spark, root)
    new = t.products().where("sku like 'MIO-%'").collect()
    assert t.commit == 0 and t.products().count() == n_products + 1 and t.inventory().count() == n_items + 1
    assert [(r["sku"], r["creado_por"], r["estado"], r["categoria_id"]) for r in new] == [("MIO-1", 3, False, None)]
    assert "MIO-1" in {r["sku"] for r in reads.pending_items(t).collect()}
    assert before.products().count() == n_products  # an older reader keeps its commit
    main(["catalog_reject", "--tables", root, "--commit", "--requests", _pending(spark, root, new[0]["id"])])
    t = SnapshotTables(spark, root)
    assert t.commit == 1 and t.products().count() == n_products and t.inventory().count() == n_items


def _pending(spark, root, product):
    spark.createDataFrame([(product,)], "id long").write.parquet(f"{root}/rechazos")
    return f"{root}/rechazos"


@pytest.mark.parametrize("args", [["sales_summary", "--commit"], ["sale_validate", "--commit"], ["catalog_create", "--requests", "x"], ["sales_summary"]])
def test_only_jobs_are_committed(args):
    with pytest.raises(SystemExit):
        main([*args, "--tables", SMALL, "--fixture"])


def test_command_line_uses_the_reference_values(spark):
    """Page 1, no search, 20 clients; test values are bound in the registry."""
    from vendorlytics.run import jobs

    t = FixtureTables(spark, SMALL)
    assert jobs()["sales_history_page"](t).agg(F.min("ord")).first()[0] == 1
    assert jobs()["catalog_search"](t).count() == 30
    assert jobs()["rate_limit_violations"](t).where("solicitudes <= 10").count() == 0
    accepted = client_admission(t).where("resultado = 'ok'").groupBy("vendedor_id").count().agg(F.max("count")).first()[0]
    assert CLIENT_QUOTA == 20 and accepted <= 20


def test_ids_follow_the_type_of_the_table(spark):
    text = spark.createDataFrame([("u",)], "id string")
    rows = spark.createDataFrame([("x",)], "k string")
    assert len(rows.select(new_tables.row_id(text, F.col("k")).alias("i")).first()["i"]) == 64
    assert isinstance(rows.select(new_tables.row_id(frame(spark, 1), F.col("k")).alias("i")).first()["i"], int)


@pytest.mark.parametrize("job", ["custom_item_outcome", "catalog_move_outcome"])
def test_requests_have_every_outcome(spark, job):
    t = FixtureTables(spark, "/root/testdata/sf0.01")
    want = {"custom_item_outcome": {"ok", "cuota", "sku_duplicado", "datos_faltantes"}, "catalog_move_outcome": {"ok", "sku_duplicado", "fk_invalida"}}
    assert {r["resultado"] for r in new_tables.QUERIES[job](t).select("resultado").distinct().collect()} == want[job]
