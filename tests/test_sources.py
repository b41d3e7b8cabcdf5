import json
import os

import pytest
from pyspark.sql import functions as F

from checks import queries
from marketboard.operators import audit, outlook
from marketboard.sources import dimensions, prices, storage, tables
from marketboard.streaming.ingest import ingest_price_csv
from marketboard.streaming import ingest

EIGHT = "date,crop,mandi,state,modal_price,min_price,max_price,arrivals_tonnes"
ROW = "2026-01-01,Onion,Nashik,Maharashtra,820.0,740.0,920.0,200.5"


def write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_csv_binds_by_name_not_by_position(spark, tmp_path):
    folder = str(tmp_path / "csv")
    write(folder, "a.csv", EIGHT, ROW, "2026-01-02,Onion,Pune,Maharashtra,n/a,740,,x")
    rows = prices.read_price_csv(spark, folder, extra=["state"]).orderBy("date").collect()
    assert rows[0].asDict() == {
        "date": "2026-01-01", "crop": "Onion", "mandi": "Nashik", "modal_price": 820.0, "min_price": 740.0,
        "max_price": 920.0, "arrivals_tonnes": 200.5, "state": "Maharashtra",
    }
    assert (rows[1]["modal_price"], rows[1]["min_price"], rows[1]["max_price"], rows[1]["arrivals_tonnes"]) == (
        None, 740.0, None, None,
    )


def test_missing_columns_are_null(spark, tmp_path):
    folder = str(tmp_path / "csv")
    write(folder, "a.csv", "mandi,date,crop,modal_price", "Pune,2026-01-01,Onion,5")
    row = prices.read_price_csv(spark, folder).first()
    assert (row["mandi"], row["modal_price"], row["max_price"]) == ("Pune", 5.0, None)


def test_foreign_header_stops_the_job(spark, tmp_path):
    folder = str(tmp_path / "csv")
    write(folder, "a.csv", EIGHT, ROW)
    write(folder, "b.csv", "crop,date,mandi,state,modal_price,min_price,max_price,arrivals_tonnes", ROW)
    with pytest.raises(Exception, match="(?i)header"):
        prices.read_price_csv(spark, folder).collect()


def test_ingest_adds_only_new_files(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "bronze", "progress"))
    write(source, "a.csv", EIGHT, ROW, ROW)

    def run():
        ingest_price_csv(spark, source, target, progress, max_files_per_batch=1)
        return tables.read_table(spark, target)

    first = run()
    assert first.count() == 2 and first.columns == prices.PRICE_COLUMNS
    assert first.first()["modal_price"] == 820.0
    assert run().count() == 2
    write(source, "b.csv", EIGHT, ROW)
    write(source, "c.csv", EIGHT, ROW)
    assert run().count() == 4


def test_ingest_into_a_named_table(spark, tmp_path):
    source = str(tmp_path / "in")
    write(source, "a.csv", EIGHT, ROW)
    tables.ensure_namespace(spark, "raw_zone")
    ingest_price_csv(spark, source, "raw_zone.bronze", str(tmp_path / "progress"))
    assert tables.read_table(spark, "raw_zone.bronze", "modal_price > 800").count() == 1


def test_export_keeps_blanks_and_file_count(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2026-01-01", " onion", "Pune", 1.5, None, None, None)], prices.PRICE_SCHEMA
    ).repartition(3)
    path = str(tmp_path / "out")
    prices.export_csv(rows, path, files=1)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    back = prices.read_price_csv(spark, path).first()
    assert (back["crop"], back["modal_price"], back["min_price"]) == (" onion", 1.5, None)


def test_tables_overwrite_append_partition_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("Onion", "Pune", 1.0), ("Tomato", "Pune", 2.0)], "crop string, mandi string, p double")
    tables.write_table(rows, path, partition_cols=["crop", "mandi"])
    tables.write_table(rows, path, partition_cols=["crop", "mandi"])
    assert tables.read_table(spark, path).count() == 2
    assert os.path.isdir(f"{path}/crop=Onion/mandi=Pune")
    tables.write_table(rows, path, mode="append", partition_cols=["crop", "mandi"])
    read = tables.read_table(spark, path, "crop = 'Onion'")
    assert read.count() == 2
    assert "PartitionFilters: [isnotnull(crop" in read._jdf.queryExecution().executedPlan().toString()


def test_schema_evolves_on_append_and_is_replaced_on_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append_evolving(spark.createDataFrame([(1,)], "a int"), path)
    tables.append_evolving(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    merged = tables.read_table(spark, path, merge_schema=True)
    assert sorted(map(tuple, merged.collect())) == [(1, None), (2, "x")]
    tables.write_table(spark.createDataFrame([("z",)], "c string"), path)
    assert tables.read_table(spark, path).columns == ["c"]


def test_namespace_table(spark):
    tables.ensure_namespace(spark, "zone_a")
    tables.ensure_namespace(spark, "zone_a")
    rows = spark.createDataFrame([(1,)], "a int")
    for mode in ("overwrite", "append"):
        tables.write_table(rows, "zone_a.t", mode=mode)
    assert tables.read_table(spark, "zone_a.t", "a = 1").count() == 2


def test_json_records(spark, tmp_path):
    record = {
        "Arrival_Date": "01/04/2026", "Commodity": "Onion", "Market": "Pune", "Modal_x0020_Price": "820",
        "Min_x0020_Price": "NR", "Arrivals_x0020_in_x0020_Qtl": "12.5",
    }
    write(str(tmp_path / "j"), "a.json", json.dumps({"records": [record, {}]}), json.dumps({"records": []}))
    rows = prices.read_price_json(spark, str(tmp_path / "j")).collect()
    assert tuple(rows[0]) == ("01/04/2026", "Onion", "Pune", 820.0, None, None, 12.5)
    assert tuple(rows[1]) == (None,) * 7 and len(rows) == 2
    inferred = prices.price_records(spark.read.json(str(tmp_path / "j")))
    assert inferred.columns == prices.PRICE_COLUMNS and inferred.count() == 2


def test_dimensions(spark, tmp_path):
    text = {
        "mandis": {"Nashik": {"state": "MH", "lat": 19.9, "lon": 73.7, "apmc_code": "A1"}},
        "crops": {
            "Onion": {"aliases": ["pyaaz", "kanda"], "harvest_months": [11, 12], "shelf_life_days": 10, "rain_sensitivity": "HIGH"},
            "Tomato": {"aliases": [], "harvest_months": [1], "shelf_life_days": 4, "rain_sensitivity": "VERY_HIGH"},
        },
    }
    write(str(tmp_path / "d"), "d.json", json.dumps(text, indent=2))
    got = dimensions.dimensions(dimensions.read_dimensions(spark, str(tmp_path / "d")))
    assert tuple(got.mandis.first()) == ("Nashik", "MH", 19.9, 73.7, "A1")
    assert {tuple(r) for r in got.aliases.collect()} == {("pyaaz", "Onion"), ("kanda", "Onion")}
    assert {r["crop"]: r["harvest_months"] for r in got.crops.collect()} == {"Onion": [11, 12], "Tomato": [1]}


def test_union_and_counts(spark):
    a = spark.createDataFrame([("Onion", "Pune", "MH")], "crop string, mandi string, state string")
    b = spark.createDataFrame([("Pune", "Onion")], "mandi string, crop string")
    both = outlook.concat_all([a, b])
    assert audit.rows_per_series(both).first()["rows"] == 2
    assert both.filter(F.col("state").isNull()).count() == 1


def test_shared_folder_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    path = storage.work_path(spark, "x")
    assert path.startswith(folder + "/x-") and path != storage.work_path(spark, "x")


def test_spread_leaves_large_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=cores)
    assert tables.spread(wide) is wide
    assert tables.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores


def layouts(folder):
    """Files of several layouts, one name with a space, one of them empty, one with a quoted header."""
    folder.mkdir()
    (folder / "a 1[x].csv").write_text("date,crop,mandi,modal_price,min_price,max_price,arrivals_tonnes\n2026-01-01,Onion,Pune,1,2,3,4\n")
    (folder / "b.csv").write_text('"Mandi", State ,crop,modal_price,date\nPune,MH,"Onion, red",bad,2026-01-02\nNashik,,Onion,7,2026-01-03\n')
    (folder / "c.csv").write_text("")
    (folder / "d.csv").write_text("grade,crop,,crop\nA,Onion,x,y\n")


def evolved(spark, target):
    return tables.read_table(spark, target, merge_schema=True)


def test_files_of_any_layout_are_bound_by_their_own_header(spark, tmp_path):
    layouts(tmp_path / "in")
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for _ in range(2):
        ingest.ingest_evolving_csv(spark, str(tmp_path / "in"), target, progress, max_files_per_batch=2)
        got = {tuple(r) for r in evolved(spark, target).select("date", "crop", "mandi", "modal_price", "arrivals_tonnes", "state", "grade").collect()}
        assert got == {
            ("2026-01-01", "Onion", "Pune", 1.0, 4.0, None, None), ("2026-01-02", "Onion, red", "Pune", None, None, "MH", None),
            ("2026-01-03", "Onion", "Nashik", 7.0, None, None, None), (None, "Onion", None, None, None, None, "A"),
        }
        assert evolved(spark, target).count() == 4
    # a layout that was not there when the table began
    (tmp_path / "in" / "later.csv").write_text("crop,season\nTomato,rabi\n")
    ingest.ingest_evolving_csv(spark, str(tmp_path / "in"), target, progress)
    assert [r["season"] for r in evolved(spark, target).filter("crop = 'Tomato'").collect()] == ["rabi"]
    assert evolved(spark, target).count() == 5


def test_a_failed_batch_is_repeated_without_copies(spark, tmp_path):
    layouts(tmp_path / "in")
    target, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def fails_after_writing(rows, folder):
        rows.write.mode("overwrite").parquet(folder)
        if folder.endswith("=1"):
            raise RuntimeError("lost after the write")

    with pytest.raises(Exception, match="lost after the write"):
        ingest.ingest_evolving_csv(spark, str(tmp_path / "in"), target, progress, max_files_per_batch=2, store=fails_after_writing)
    ingest.ingest_evolving_csv(spark, str(tmp_path / "in"), target, progress, max_files_per_batch=2)
    rows = evolved(spark, target)
    assert rows.count() == rows.select("crop", "date", "mandi").distinct().count() == 4


def test_replies_are_written_compressed(spark, tmp_path, monkeypatch):
    row = ("2024-01-01", "Onion", "ASIA", 10.0, 9.0, 11.0, 3.0)
    kinds = "date string, crop string, mandi string, modal_price double, min_price double, max_price double, arrivals_tonnes double"
    monkeypatch.setattr(queries, "ticks", lambda *_: spark.createDataFrame([row] * 500, kinds))
    monkeypatch.setattr(queries, "work_path", lambda _, name: str(tmp_path / name))
    read = queries.json_price_records(spark, "").collect()
    assert {tuple(r) for r in read} == {row, (*row[:4], None, None, row[6])} and len(read) == 1000
    files = [f for f in (tmp_path / "replies").iterdir() if f.name.startswith("part-")]
    assert sum(f.stat().st_size for f in files) < 1000 * 20
