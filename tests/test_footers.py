import pyarrow as pa
import pyarrow.parquet as pq

from veridra.api import Engine
from veridra.operators import footers
from veridra.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"


def told(rows):
    return {r["column_name"]: (r["row_count"], r["null_count"], r["min_value"], r["max_value"]) for r in rows}


def write(path, **options):
    table = pa.table({"i": pa.array([3, None, 5]), "d": pa.array([1.0, float("nan"), None]), "s": pa.array(["a", "b", None]), "n": pa.array([None] * 3, pa.int64()), "l": pa.array([[1], None, []])})
    pq.write_table(table, path / "a.parquet", **options)
    pq.write_table(table.slice(0, 1), path / "b.parquet", **options)


def test_aggregates_come_from_footers(spark):
    one, columns, _, from_footers = footers.footer_aggregate(spark, f"{SF}/lineitem.parquet")
    assert from_footers and footers.pushed(one) and len(columns) == 11
    assert one.first()["rows"] == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    # The caller's session keeps its own reader.
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_several_files_and_nulls(spark, tmp_path):
    write(tmp_path)
    want = {"i": (4, 1, "3", "5"), "d": (4, 1, None, None), "s": (4, 1, None, None), "n": (4, 4, None, None)}
    assert told(footers.footer_profile(spark, str(tmp_path)).collect()) == want  # a column of nulls has no statistics: scanned
    assert told(footers.footer_profile(spark, str(tmp_path), ["i", "s"]).collect()) == {k: want[k] for k in ("i", "s")}
    assert footers.footer_aggregate(spark, str(tmp_path), ["i", "s"])[3] and not footers.footer_aggregate(spark, str(tmp_path), ["n"])[3]


def test_files_without_statistics_are_scanned(spark, tmp_path):
    write(tmp_path, write_statistics=False)
    assert told(footers.footer_profile(spark, str(tmp_path), ["i"]).collect()) == {"i": (4, 1, "3", "5")}
    assert not footers.footer_aggregate(spark, str(tmp_path), ["i"])[3]


def test_floats_only_if_asked_for(spark, tmp_path):
    pq.write_table(pa.table({"d": [1.5, 2.5]}), tmp_path / "a.parquet")
    assert told(footers.footer_profile(spark, str(tmp_path)).collect()) == {"d": (2, 0, None, None)}
    assert told(footers.footer_profile(spark, str(tmp_path), floats=True).collect()) == {"d": (2, 0, "1.5", "2.5")}


def test_engine_statistics(spark):
    engine = Engine(spark, Catalog.from_directory(spark, SF, ["nation"], "raw"))
    assert told(engine.table_statistics("raw.nation")["columns"])["n_nationkey"] == (25, 0, "0", "24")
    engine.catalog.register("raw.nation", spark.range(1))
    assert "error" in engine.table_statistics("raw.nation")
