"""Files in and out: whole versions, checked headers, payloads under other keys."""

import json

import pytest
from pyspark.sql import functions as F

from hubflow.sources import files, readers

ROWS = "a long, b string, day date"


def frame(spark, n):
    return spark.range(n).select(F.col("id").alias("a"), F.concat(F.lit('x "quoted", '), F.col("id").cast("string")).alias("b"), F.date_add(F.lit("2024-01-30").cast("date"), F.col("id").cast("int") % 3).alias("day"))


@pytest.mark.parametrize("format", ["csv", "json", "parquet"])
@pytest.mark.parametrize("partition_by", [(), ("day",)])
def test_what_is_published_comes_back(spark, tmp_path, format, partition_by):
    path = f"{tmp_path}/t"
    for n in (50, 7, 20):
        files.publish(frame(spark, n), path, format, partition_by, ("a",))
        got = files.published(spark, path, ROWS)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, frame(spark, n).collect()))
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2  # this one and the one before


def test_readers_see_the_old_version_until_the_new_one_is_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        files.published(spark, path, ROWS)
    files.publish(frame(spark, 5), path)
    reader = files.published(spark, path, ROWS)
    broken = frame(spark, 9).withColumn("b", F.when(F.col("a") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("b")))
    with pytest.raises(Exception, match="lost"):
        files.publish(broken, path)
    assert files.published(spark, path, ROWS).count() == 5
    files.publish(frame(spark, 9), path)
    assert reader.count() == 5 and files.published(spark, path, ROWS).count() == 9


def test_headers_and_types_are_checked(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.publish(frame(spark, 5), path)
    assert files.published(spark, path, "b string, a long", exactly=False).columns == ["b", "a"]
    with pytest.raises(ValueError, match="expected columns"):
        files.published(spark, path, "a long, b string")
    with pytest.raises(ValueError, match="expected columns"):
        files.published(spark, path, "a long, b string, c date")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.published(spark, path, "a long, b long, day date").collect()


def test_a_demand_log_by_name_and_by_place(spark, tmp_path):
    rows = [("ÇIKIŞ tm", "Varış TM", "x3", " Toplam  Desi ", "x5"), (" A ", "B", "2024-01-02", "1.5", "09:00"), ("A", "C ", "2024-01-03", "2", "17:00")]
    path = tmp_path / "log.csv"
    path.write_text("\n".join(",".join(r) for r in rows) + "\n", encoding="utf-8")
    got = readers.read_demand_history(spark, str(path)).collect()
    assert [(r.source, r.dest, str(r.date), r.volume, r.slot) for r in got] == [("A", "B", "2024-01-02", 1.5, "09:00"), ("A", "C", "2024-01-03", 2.0, "17:00")]


DEMANDS = [
    {"TM_ID": "A → B", "tarih": "2024-01-02", "slot": "09:00", "talep_id": "D1", "demand_low": 1, "demand_base": 2, "demand_high": 3, "recommended_qty": 2.5},
    {"rota": "C->D", "tarih": "2024-01-03", "q10": 1.5, "q50": 2.5, "q90": 3.5, "recommended_demand": 9},
    {"TM_ID": "", "route": " E => F -> G", "tarih": "2024-01-04", "demand_base": 7},
]


def test_payloads_under_any_of_their_keys(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"metadata": {"more": 1}, "demands": DEMANDS}, indent=2, ensure_ascii=False), encoding="utf-8")
    got = sorted((str(r.date), r.slot, r.demand_id, r.source, r.destination, r.q10, r.q50, r.q90, r.recommended) for r in files.read_payload_file(spark, str(path)).collect())
    assert got == [
        ("2024-01-02", "09:00", "D1", "A", "B", 1.0, 2.0, 3.0, 2.5),
        ("2024-01-03", "UNKNOWN", "", "C", "D", 1.5, 2.5, 3.5, 9.0),
        ("2024-01-04", "UNKNOWN", "", "E", "F -> G", 0.0, 7.0, 0.0, 7.0),
    ]


@pytest.mark.parametrize("payload, error", [({"demands": []}, "no demands"), ({"metadata": {}}, "no demands"), ({"demands": [{"tarih": "2024-01-01"}]}, "has no lane"), ({"demands": [{"TM_ID": "AB", "tarih": "2024-01-01"}]}, "no lane")])
def test_payloads_that_cannot_be_read(spark, tmp_path, payload, error):
    path = tmp_path / "p.json"
    path.write_text(json.dumps(payload))
    with pytest.raises(Exception, match=error):
        files.read_payload_file(spark, str(path)).collect()


def test_written_payloads_are_read_again(spark, tmp_path):
    rows = [("2024-01-01", s, f"D{i}{s}", f"A{i} → B", 1.0, 2.0 + i, 9.0, 3.0, c) for s in ("09:00", "17:00") for i, c in enumerate(("LOW", "HIGH", "HIGH"))]
    bands = spark.createDataFrame(rows, "date string, slot string, demand_id string, lane string, q10 double, q50 double, q90 double, recommended double, risk_class string").withColumn("date", F.to_date("date"))
    files.write_payloads(bands, f"{tmp_path}/p")
    documents = files.published(spark, f"{tmp_path}/p", files.PAYLOAD)
    assert sorted((r.metadata.slot, r.metadata.demands, r.risk_summary) for r in documents.collect()) == [(s, 3, {"LOW": 1, "MEDIUM": 0, "HIGH": 2}) for s in ("09:00", "17:00")]
    got = files.payload_rows(documents).select(F.col("date").cast("string"), "slot", "demand_id", "lane", "q10", "q50", "q90", "recommended").collect()
    assert sorted(map(tuple, got)) == sorted(r[:-1] for r in rows)


def test_inputs_of_the_plan_and_a_forecast_that_is_cut(spark, tmp_path):
    from pyspark.sql.types import StructType

    values = {"string": "Tır", "double": 2.5, "int": 3, "date": None}
    tables = {n: spark.createDataFrame([tuple(values[f.dataType.simpleString()] for f in StructType.fromDDL(s))] * 2, s) for n, s in files.PLAN_INPUTS.items()}
    files.write_plan_inputs(tables, f"{tmp_path}/in", "test")
    read = files.read_plan_inputs(spark, f"{tmp_path}/in")
    assert all(sorted(map(str, read[n].collect())) == sorted(map(str, t.collect())) for n, t in tables.items())
    assert [tuple(r) for r in files.solver_dimensions(read).collect()] == [("Tır", True, 6)] * 2
    files.publish(tables["forecast"].limit(1), f"{tmp_path}/in/forecast")
    with pytest.raises(ValueError, match="has 1 rows"):
        files.read_plan_inputs(spark, f"{tmp_path}/in")
