"""Raw files to facts: schema, rules, repeat runs."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from catalog import roundtrips
from farebox.functions.calendar import holiday_type, parse_ts
from farebox.functions.text import display_name, dotted_thousands, hour_band, normalize_name
from farebox.operators import clean, dims
from farebox.plans import etl, kpis
from farebox.schemas import FACT_COLUMNS, RAW_COLUMNS, STATION_VARIANTS
from farebox.sources import facts, raw, reference
from farebox.sources.sinks import DIMS, READY, current_dims, dim_versions, publish_dims
from farebox.streaming.ingest import ingest_incremental

HEADER = "Fecha_Transaccion,Tiempo,Linea,Estacion,Entradas_E,Salidas_S\n"
TWO_ROWS = (
    "2025-11-08,18:45:00,(12)Zona H - Caracas Sur,(2304)Calle 57,37,412\n"
    "2025-11-08,19:00:00,(12)Zona H - Caracas Sur,(2304)Calle 57,61,295\n"
)


def raw_frame(spark, rows):
    return spark.createDataFrame([tuple(map(str, r)) for r in rows], RAW_COLUMNS)


def test_csv_to_warehouse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "salidas20251108.csv").write_text(HEADER + TWO_ROWS, encoding="utf-8")
    etl.run_from_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    table = facts.read_validations(spark, str(tmp_path / "out" / "validations"))
    assert table.columns == FACT_COLUMNS
    got = {(r.hora, r.codigo_linea, r.codigo_estacion, r.entradas, r.salidas, r.total) for r in table.collect()}
    assert got == {("18:45:00", 12, 2304, 37, 412, 449), ("19:00:00", 12, 2304, 61, 295, 356)}
    names = spark.read.json(str(tmp_path / "out" / "dims" / "dim_estacion")).collect()
    assert [(r.codigo_estacion, r.nombre_estacion) for r in names] == [(2304, "Calle 57")]
    # A second run replaces the day instead of adding to it.
    etl.run_from_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert facts.read_validations(spark, str(tmp_path / "out" / "validations")).count() == 2


def test_files_with_other_columns_and_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + TWO_ROWS)
    (tmp_path / "b.csv").write_text('Salidas_S,Entradas_E,Estacion,"Linea",Tiempo,Fecha_Transaccion,Acceso\n8,9,"(1)P, Q",(2)L,07:00:00,2025-01-16,x\nNA,1,(1)P,(2)L,08:00:00,2025-01-16,\n')
    got = sorted(map(tuple, raw.read_raw_csv(spark, str(tmp_path)).collect()))
    assert len(got) == 4 and ("2025-01-16", "07:00:00", "(2)L", "(1)P, Q", "9", "8") in got
    assert ("2025-01-16", "08:00:00", "(2)L", "(1)P", "1", "NA") in got


def test_cleaning_of_files_with_several_headers(spark, tmp_path):
    """The scan of one header stops at another one before anything is written; the census takes over."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + TWO_ROWS)
    (tmp_path / "in" / "b.csv").write_text("Salidas_S,Entradas_E,Estacion,Linea,Tiempo,Fecha_Transaccion\n8,9,(1)P,(2)L,07:00:00,2025-01-16\n")
    with pytest.raises(Exception) as error:
        raw.read_raw_csv(spark, str(tmp_path / "in"), uniform=True).collect()
    assert raw.headers_differ(error.value)
    etl.run_from_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    table = facts.read_validations(spark, str(tmp_path / "out" / "validations"))
    assert sorted((r.codigo_estacion, r.total) for r in table.collect()) == [(1, 17), (2304, 356), (2304, 449)]


def test_csv_to_kpi_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + TWO_ROWS + "2025-03-05,17:45:00,(40)Zona T,(40003)Mirador,7000,1\n")
    etl.run_from_csv(spark, src, out)
    table = facts.read_validations(spark, f"{out}/validations")
    names = {n: reference.read_dim(spark, f"{out}/dims/{n}").toDF(c, t) for n, c, t, k in DIMS if k == "string"}
    lists = reference.read_dim(spark, f"{out}/dims/linea_estaciones", "array<long>").toDF("codigo_linea", "estaciones")
    kpis.run(table, names["dim_linea"], lists, names["dim_estacion"], f"{out}/kpis")
    read = lambda name: [r.asDict() for r in spark.read.json(f"{out}/kpis/{name}").collect()]
    assert read("promedio_diario")[0]["promedio_diario"] == (805 + 7001) / 2
    assert read("hora_pico") == [{"hora_int": 17, "total": 7001, "franja": "17:00 - 18:00"}]
    assert read("linea_principal")[0]["nombre_linea"] == "Zona T" and read("estacion_principal")[0]["codigo_estacion"] == 40003
    assert {(r["Linea"], r["total_linea"]) for r in read("tabla_troncales")} == {("Zona T", 7001), ("Zona H - Caracas Sur", 805)}
    assert {r["codigo_estacion"]: r["promedio_diario"] for r in read("estacion_stats")} == {2304: 98, 40003: 7000}


def test_extra_columns_are_dropped_and_missing_ones_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Acceso_Estacion," + HEADER + "x," + TWO_ROWS.splitlines()[0] + "\n")
    assert raw.read_raw_csv(spark, str(tmp_path / "a.csv")).columns == RAW_COLUMNS
    (tmp_path / "bad.csv").write_text("Fecha_Transaccion,Tiempo,Linea,Estacion,Salidas_S\n2025-01-15,07:00:00,(36)Z,(1)P,8\n")
    with pytest.raises(ValueError, match="Columnas faltantes"):
        raw.read_raw_csv(spark, str(tmp_path / "bad.csv"))


def test_bad_numbers_raise_and_bad_times_become_null(spark):
    bad = raw_frame(spark, [("2025-01-15", "07:00:00", "(1)L", "(2)E", "x", 1)])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.aggregate_slots(bad).collect()
    df = spark.createDataFrame([("2025-01-15", "07:00:00"), ("2025-13-45", "07:00:00"), (None, "x")], "d string, t string")
    assert [r[0] for r in df.select(parse_ts("d", "t")).collect()] == [dt.datetime(2025, 1, 15, 7), None, None]


def test_slots_sum_and_take_first_line_label(spark):
    rows = [
        ("2025-01-15", "07:00:00", "(36)B", "(9001)P", 1, 2), ("2025-01-15", "07:00:00", "(31)A", "(9001)P", 10, 20),
        ("2025-01-15", "07:00:00", "(36)B", "sin codigo", 5, 5),
    ]
    out = clean.derive_fields(clean.aggregate_slots(raw_frame(spark, rows))).orderBy("total").collect()
    assert [(r.codigo_linea, r.codigo_estacion, r.nombre_estacion, r.total) for r in out] == [
        (36, None, None, 10), (31, 9001, "P", 33)]


def test_line_rules(spark):
    df = spark.createDataFrame([(39, "Zona F Calle 13"), (50, "Line for Intermedium Gate"), (11, "Zona B"), (None, None)],
                               "codigo_linea long, nombre_linea string")
    got = [tuple(r) for r in clean.recode_lines(df).select("codigo_linea", "nombre_linea").collect()]
    assert got == [(31, "Zona F Av. Americas"), (50, "Zona G NQS Sur"), (11, "Zona B"), (None, None)]


def variants_frame(spark):
    t1, t2 = dt.datetime(2025, 1, 1, 7), dt.datetime(2025, 1, 1, 8)
    rows = [
        (t1, 7503, "San Mateo", 10, 1, 11), (t1, 57503, "Int", 5, 5, 10), (t1, 59503, "Amp", 1, 1, 2),
        (t2, 57503, "Int", 7, 7, 14),  # no principal row at this time
        (t1, 7503, "San Mateo bis", 1, 1, 2),  # a second principal row at one time
        (None, 7503, "San Mateo", 3, 3, 6), (None, 57503, "Int", 9, 9, 18), (t1, 1, "Otra", 4, 4, 8), (t1, None, "?", 1, 1, 2),
    ]
    return spark.createDataFrame(rows, "timestamp timestamp, codigo_estacion long, nombre_estacion string, entradas long, salidas long, total long")


def test_variants_parity(spark):
    out = clean.consolidate_variants(variants_frame(spark))
    got = sorted((r.codigo_estacion, r.nombre_estacion, r.total) for r in out.collect())
    # Both principal rows get the whole sum (12); the variant of 08:00 and unmatched nulls vanish.
    assert got == [(1, "Otra", 8), (7503, "San Mateo", 6), (7503, "San Mateo", 23), (7503, "San Mateo bis", 14)]


def test_variants_regroup_loses_nothing(spark):
    df = variants_frame(spark)
    out = clean.consolidate_variants(df, mode="regroup")
    assert out.agg(F.sum("total")).first()[0] == df.agg(F.sum("total")).first()[0]
    by_time = {(r.timestamp and r.timestamp.hour, r.codigo_estacion): (r.total, r.nombre_estacion) for r in out.collect()}
    assert by_time[7, 7503] == (25, "San Mateo") and by_time[8, 7503] == (14, "Int")


def test_result_does_not_depend_on_partitions(spark):
    rows = [("2025-01-1%d" % (i % 5), "0%d:00:00" % (i % 7), "(%d)L" % (i % 3), "(%d)E" % (9000 + i % 4), i, i) for i in range(200)]
    df = raw_frame(spark, rows)
    first = sorted(map(str, clean.clean(df.repartition(7)).collect()))
    assert first == sorted(map(str, clean.clean(df.orderBy(F.desc("Entradas_E")).coalesce(1)).collect()))


def test_names(spark):
    df = spark.createDataFrame([("  CABECERA c.c. ñuñoa 20 DE julio ",), ("MIRADOR DEL PARAÍSO",), (None,)], "n string")
    assert [r[0] for r in df.select(normalize_name("n")).collect()] == ["Cabecera C.C. Nunoa 20 De Julio", "Mirador Del Paraiso", None]
    df = spark.createDataFrame([("(05000)Portal",), ("05000 - Portal ",), ("(1)2 - X",)], "n string")
    assert [r[0] for r in df.select(display_name("n")).collect()] == ["Portal", "Portal", "X"]
    row = spark.range(1).select(dotted_thousands(F.lit(3390789.9)), hour_band(F.lit(23)), hour_band(F.lit(7))).first()
    assert tuple(row) == ("3.390.789", "23:00 - 00:00", "07:00 - 08:00")


def test_dims(spark):
    counts = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 1), (2, "z", 1)], "c long, n string, len long")
    assert sorted(map(tuple, dims.most_frequent_name(counts, "c", "n").collect())) == [(1, "a"), (2, "z")]
    old = spark.createDataFrame([(1, [5, 6]), (2, [7])], "c long, e array<long>")
    new = spark.createDataFrame([(1, [6, 8]), (3, [9])], "c long, e array<long>")
    got = lambda mode: {r.c: r.e for r in dims.upsert_dim(old, new, "c", "e", mode).collect()}
    assert got("parity") == {1: [6, 8], 2: [7], 3: [9]}
    assert got("union") == {1: [5, 6, 8], 2: [7], 3: [9]}
    stats = spark.createDataFrame([(10, 1), (20, 2)], "codigo_estacion long, v int")
    alias = spark.createDataFrame([(10, 20), (99, 5)], "codigo_estacion long, alias long")
    assert sorted(map(tuple, dims.with_aliases(stats, alias).collect())) == [(10, 1), (20, 1)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as zf:
        zf.writestr("dir/uno.CSV", HEADER + TWO_ROWS)
        zf.writestr("otro.csv", "a,b\n1,2\n")
        zf.writestr("nota.txt", "x")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    out = raw.extract_archives(spark, str(tmp_path)).cache()
    assert raw.extracted_rows(out).count() == 2
    bad = {(r.archive.split("/")[-1], r.member) for r in raw.bad_inputs(out).collect()}
    assert bad == {("bad.zip", None), ("good.zip", "otro.csv")}


def test_broken_and_repeated_members(spark, tmp_path):
    big = HEADER + "".join(f"2025-01-15,07:00:00,(3)L,({k % 90000})E,{k},1\n" for k in range(300_000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("dia.csv", HEADER + TWO_ROWS.replace(",37,", ",NA,"))
        zf.writestr("roto.csv", big)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[len(data) * 3 // 4] ^= 0xFF  # inside the second member
    (tmp_path / "a.zip").write_bytes(bytes(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as zf:
        zf.writestr("dia.csv", HEADER + TWO_ROWS)
    out = raw.extract_archives(spark, str(tmp_path)).cache()
    assert {r.member for r in raw.bad_inputs(out).collect()} == {"roto.csv"}
    assert sorted(r.Entradas_E for r in raw.extracted_rows(out).collect()) == ["61", "NA"]


def test_members_are_read_by_several_tasks(spark, tmp_path):
    """Members of one archive go to several tasks; a broken one and one that isn't readable leave the others alone."""
    rows = lambda k: HEADER + "".join(f"2025-01-15,07:00:00,(3)L,({e})E,{k},{e}\n" for e in range(200))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as zf:
        for k in range(24):
            zf.writestr(f"dir/{k}.csv", rows(k), zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        zf.writestr("vacio.csv", HEADER)
        zf.writestr("otro.csv", rows(99), zipfile.ZIP_BZIP2)
        zf.writestr("0.txt", "no")
    data = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as zf:
        for name in ("dir/4.csv", "dir/5.csv"):  # one stored, one deflated
            info = zf.getinfo(name)
            data[info.header_offset + 30 + len(name) + info.compress_size // 2] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(bytes(data))
    out = raw.extract_archives(spark, str(tmp_path))
    tasks = out.where("error IS NULL").withColumn("t", F.spark_partition_id()).groupBy("member").agg(F.collect_set("t").alias("t")).collect()
    assert all(len(r.t) == 1 for r in tasks) and len({r.t[0] for r in tasks}) > 2
    assert {r.member for r in raw.bad_inputs(out).collect()} == {"dir/4.csv", "dir/5.csv", "otro.csv"}
    good = raw.extracted_rows(out).groupBy("Entradas_E").count().collect()
    assert {(r.Entradas_E, r["count"]) for r in good} == {(str(k), 200) for k in range(24) if k not in (4, 5)}


def test_dims_round_trip_and_refresh(spark, tmp_path):
    src, table, ckpt, folder = (str(tmp_path / n) for n in ("src", "table", "ckpt", "dims"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.csv").write_text(HEADER + TWO_ROWS)
    ingest_incremental(spark, src, table, ckpt, dims=folder)
    (tmp_path / "src" / "b.csv").write_text("Extra," + HEADER + "x,2025-01-15,08:00:00,(40)Zona T,(40003)Mirador,5,5\n")
    ingest_incremental(spark, src, table, ckpt, dims=folder)
    newest = current_dims(spark, folder)
    read = lambda name, kind="string": sorted(map(tuple, reference.read_dim(spark, f"{newest}/{name}", kind).collect()))
    assert read("dim_linea") == [(12, "Zona H - Caracas Sur"), (40, "Zona T")]
    assert read("dim_estacion") == [(2304, "Calle 57"), (40003, "Mirador")]
    assert read("linea_estaciones", "array<long>") == [(12, [2304]), (40, [40003])]
    (tmp_path / "bad.json").write_text("no json")
    with pytest.raises(Exception, match="not a dimension"):
        reference.read_dim(spark, str(tmp_path / "bad.json")).collect()


def test_readers_meet_whole_versions_of_dimensions(spark, tmp_path):
    folder = str(tmp_path / "dims")
    tables = lambda name: (
        spark.createDataFrame([(1, name)], "codigo_linea long, nombre_linea string"),
        spark.createDataFrame([(2, name)], "codigo_estacion long, nombre_estacion string"),
        spark.createDataFrame([(1, [2])], "codigo_linea long, estaciones array<long>"),
    )
    assert current_dims(spark, folder) == folder
    for version in (1, 2, 4, 5):
        publish_dims(spark, tables(f"v{version}"), folder, version)
    assert dim_versions(spark, folder) == [4, 5]
    (tmp_path / "dims" / "v6" / "dim_linea").mkdir(parents=True)  # a version that is being written
    (tmp_path / "dims" / "v5" / READY).unlink()  # and one that never was completed
    assert current_dims(spark, folder).endswith("v4")
    assert reference.read_dim(spark, f"{current_dims(spark, folder)}/dim_linea").first().valor == "v4"


def test_compaction_of_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda first, n: raw_frame(spark, [
        (f"2025-02-{d:02d}", f"{h:02d}:00:00", "(1)L", f"({e})E", n, 1) for d in range(first, first + 3) for h in (5, 6) for e in (3, 4)
    ])
    for load, first in ((1, 1), (2, 2), (7, 3)):
        facts.write_validations(clean.clean(rows(first, 10 ** load)), path, load=load, laid_out=True)
    before = sorted(map(tuple, facts.regroup_slots(facts.read_validations(spark, path)).collect()))
    # A run that broke off after it had put a day aside.
    (tmp_path / "t" / "_aside").mkdir()
    (tmp_path / "t" / "fecha=2025-02-03").rename(tmp_path / "t" / "_aside" / "fecha=2025-02-03")
    assert facts.compact_days(spark, path) == 3
    table = facts.read_validations(spark, path)
    assert sorted(map(tuple, table.collect())) == before
    loads = spark.read.parquet(path).select("fecha", "carga").distinct().orderBy("fecha").collect()
    assert [(r.fecha.day, r.carga) for r in loads] == [(1, 1), (2, 2), (3, 7), (4, 7), (5, 7)]
    assert facts.compact_days(spark, path) == 0 and not [p for p in (tmp_path / "t").iterdir() if p.name in ("_aside", "_fresh")]


def test_day_parts_and_modes_agree(spark):
    """The dealt and windowed cleaning equals the plain steps, in both modes and however days are dealt."""
    variants = list(STATION_VARIANTS.items())[:4]
    stations = [c for pair in variants for c in pair] + [1, 2]
    rows = [
        ("2025-01-1%d" % (i % 5), "0%d:00:00" % (i % 3) if i % 11 else "x", "(%d)L" % (30 + i % 10), f"({stations[i % 10]})E{i % 2}" if i % 17 else "?", i, 2 * i)
        for i in range(400)
    ]
    frame = raw_frame(spark, rows)
    slots = clean.recode_lines(clean.derive_fields(clean.aggregate_slots(frame)))
    for mode in ("parity", "regroup"):
        plain = sorted(map(str, clean.consolidate_variants(slots, mode=mode).collect()))
        assert plain and all(sorted(map(str, clean.clean(frame, mode, day_parts=n).collect())) == plain for n in (1, 3))


def test_cleaning_moves_rows_once(spark, tmp_path):
    """One scan of the raw files and one exchange of rows, by day; one sort serves sums and variants."""
    (tmp_path / "a.csv").write_text(HEADER + TWO_ROWS)
    dealt, keys, slot = clean.lay_out(raw.read_raw_csv(spark, str(tmp_path / "a.csv")), STATION_VARIANTS)
    plan = clean.fold_variants(clean.aggregate_slots(dealt, slot), STATION_VARIANTS, keys, ["entradas"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan


def test_headers_are_read_by_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"f {k}.csv").write_text(("\ufeff" if k % 3 == 0 else "") + ("x," if k % 2 else "") + HEADER + ("y," if k % 2 else "") + TWO_ROWS.splitlines()[0] + "\n")
    (tmp_path / "big.csv").write_text(HEADER + TWO_ROWS * 30_000)
    census = raw.header_census(spark, str(tmp_path)).collect()
    assert sorted(len(r.files) for r in census) == [20, 21]
    assert raw.read_raw_csv(spark, str(tmp_path)).count() == 60_040
    (tmp_path / "empty.csv").write_text("")
    assert raw.read_raw_csv(spark, str(tmp_path)).count() == 60_040


def test_slots_from_two_loads(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ckpt"))
    (tmp_path / "src").mkdir()
    for name in ("a.csv", "b.csv"):
        (tmp_path / "src" / name).write_text(HEADER + TWO_ROWS)
        ingest_incremental(spark, src, table, ckpt)
    etl_rows = clean.clean(raw.read_raw_csv(spark, f"{src}/a.csv"))
    facts.write_validations(etl_rows, table)  # a full load shares the table
    assert facts.read_validations(spark, table).count() == 6
    assert sorted(r.total for r in facts.regroup_slots(facts.read_validations(spark, table)).collect()) == [1068, 1347]


def test_index_links(spark):
    html = "salidas20250102.zip salidas20241231.zip <a>salidas20250101.zip</a> salidas20250102.zip"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = raw.links_from_index(df).orderBy("first_page", "first_pos").collect()
    assert [(r.name, r.mentions) for r in got] == [("salidas20250102.zip", 2), ("salidas20250101.zip", 1)]


def test_incremental_ingest(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ckpt"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.csv").write_text(HEADER + TWO_ROWS)
    ingest_incremental(spark, src, table, ckpt)
    ingest_incremental(spark, src, table, ckpt)  # nothing new
    assert facts.read_validations(spark, table).count() == 2
    (tmp_path / "src" / "b.csv").write_text(HEADER + "2025-01-15,09:00:00,(36)Z,(9001)P,1,1\n")
    ingest_incremental(spark, src, table, ckpt)
    assert facts.read_validations(spark, table).count() == 3


def test_read_dates_prunes_partitions(spark, tmp_path):
    rows = [("2025-01-%02d" % d, "07:00:00", "(1)L", "(2)E", d, 0) for d in range(1, 11)]
    facts.write_validations(clean.clean(raw_frame(spark, rows)), str(tmp_path / "t"))
    days = spark.createDataFrame([(dt.date(2025, 1, 3),), (dt.date(2025, 1, 9),), (dt.date(2026, 1, 1),)], "fecha date")
    assert sorted(r.entradas for r in facts.read_dates(spark, str(tmp_path / "t"), days).collect()) == [3, 9]


def test_reference_readers(spark, tmp_path):
    (tmp_path / "h.json").write_text('[{"date":"2025-01-01","localName":"Año Nuevo","name":"New Year"},{"date":"2025-06-30","localName":"a","name":"b"},{"date":"2025-06-30","localName":"c","name":"d"}]')
    assert reference.read_holidays(spark, str(tmp_path / "h.json")).count() == 3
    (tmp_path / "d.json").write_text('{"36": "Zona A", "40": "Zona T"}')
    assert sorted(map(tuple, reference.read_dim(spark, str(tmp_path / "d.json")).collect())) == [(36, "Zona A"), (40, "Zona T")]
    (tmp_path / "l.json").write_text('{"36": [9001, 9002]}')
    assert reference.read_dim(spark, str(tmp_path / "l.json"), "array<long>").first().valor == [9001, 9002]
    assert reference.read_dim(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"codigo_nodo_estacion":"9001","nombre_estacion":"P"},"geometry":{"type":"Point","coordinates":[-74.1,4.6]}},{"type":"Feature","properties":{"codigo_nodo_estacion":"9002","nombre_estacion":"Q"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}')
    stations = reference.add_missing_stations(reference.read_stations(spark, str(tmp_path / "s.geojson")))
    assert sorted((r.codigo_estacion, r.lon) for r in stations.collect() if r.lon) == [(9001, -74.1), (9005, -74.121111)]
    assert stations.count() == 3
    (tmp_path / "r.geojson").write_text('{"features":[{"geometry":{"type":"MultiLineString","coordinates":[[[-74.1,4.6],[-74.0,4.7]],[[1.0,2.0],[3.0,4.0],[5.0,6.0]]]}},{"geometry":{"type":"LineString","coordinates":[[-74.1,4.6],[-74.0,4.7]]}}]}')
    assert sorted((r.route_id, r.part_id, len(r.points)) for r in reference.read_routes(spark, str(tmp_path / "r.geojson")).collect()) == [(0, 0, 2), (0, 1, 3), (1, 0, 2)]
    (tmp_path / "w.csv").write_text("time,precipitation,temperature_2m\n2025-01-01T00:00,1.5,12.0\n")
    assert reference.read_weather(spark, str(tmp_path / "w.csv")).first().time == dt.datetime(2025, 1, 1)
    (tmp_path / "f.csv").write_text("mes,precio_cop_gal,otro\n2025-01-01,15800,1\n2025-02,15900,2\n")
    assert sorted((r.mes.month, r.precio_cop_gal) for r in reference.read_fuel(spark, str(tmp_path / "f.csv")).collect()) == [(1, 15800.0), (2, 15900.0)]


def bytes_read(spark):
    return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")


def test_stations_are_read_once(spark, tmp_path):
    """Numbers are not fetched anew from the file one by one."""
    point = '{"properties":{"codigo_nodo_estacion":%d,"nombre_estacion":"E"},"geometry":{"type":"Point","coordinates":[-74.%d,4.6E0]}}'
    (tmp_path / "s.geojson").write_text('{"features":[' + ",\n".join(point % (i, i) for i in range(2000)) + "]}")
    before = bytes_read(spark)
    got = reference.read_stations(spark, str(tmp_path / "s.geojson")).collect()
    assert bytes_read(spark) - before < 3 * (tmp_path / "s.geojson").stat().st_size
    assert sorted(map(tuple, got)) == [(i, "E", float(f"-74.{i}"), 4.6) for i in range(2000)]


def test_station_numbers_in_every_notation(spark, tmp_path):
    point = '{"properties":{"codigo_nodo_estacion":%s},"geometry":{"type":"Point","coordinates":[%s,%s]}}'
    odd = [("9001", "-7.41E1", "4.6"), ('"9002"', '"-74.1"', '" 4.6 "'), ("9003.0", "5e-324", "1e400"), ("9e3", "null", "4.60000000000000000000000000000000000000000001")]
    (tmp_path / "s.geojson").write_text('{"features":[' + ",".join(point % x for x in odd) + ',{"geometry":{"type":"Point","coordinates":7}}]}')
    got = reference.read_stations(spark, str(tmp_path / "s.geojson")).select("codigo_estacion", "lon", "lat").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(9001, -74.1, 4.6), (9002, -74.1, 4.6), (9003, 5e-324, float("inf")), (9000, None, 4.6), (None, None, None)], key=str)


@pytest.mark.parametrize("users", [[], [None], [*range(95), None, 3, 3]])
def test_stations_are_written_in_files_of_some_rows(spark, tmp_path, monkeypatch, users):
    rows = [(dt.datetime(2024, 1, 1), u, "view", 1.0, '{"k": 1}') for u in users]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(roundtrips, "folder", lambda spark: str(tmp_path / "out"))
    monkeypatch.setattr(roundtrips, "DOCUMENT_ROWS", 10, raising=False)
    got = roundtrips.stations_file(spark, str(tmp_path)).collect()
    assert sorted((r.codigo_estacion, r.nombre_estacion) for r in got if r.codigo_estacion is not None) == sorted({(u, f"E{u}") for u in users if u is not None})
    assert [tuple(r) for r in got if r.codigo_estacion is None] == [(None,) * 4] * (None in users)
    held = [len(json.loads(p.read_text())["features"]) for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    assert sum(held) == len(set(users)) and max(held, default=0) <= 30


def test_holiday_types(spark):
    days = [dt.date(2025, 6, 2), dt.date(2025, 7, 20), dt.date(2025, 7, 19), dt.date(2025, 5, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(holiday_type("d")).collect()] == ["lunes_puente", "fin_semana", "mitad_semana", "mitad_semana"]
