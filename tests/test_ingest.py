import pytest
from pyspark.sql import Observation

from ledgerspark.plans import ingest
from ledgerspark.sources import files

# The six delivered lines: annual and monthly, plain and dotted codes, a negative special account.
LINES = [
    "22\tSECTOR A\t0991290915001\tEmpresa Uno\t31/12/2023\tANUAL\t1\tACTIVO\t1.188.854,66\t",
    "22\tSECTOR A\t0991290915001\tEmpresa Uno\t31/12/2023\tANUAL\t101\tACTIVO CORRIENTE\t900.000,00\t",
    "22\tSECTOR A\t0991290915001\tEmpresa Uno\t31/12/2023\tANUAL\t10101\tEFECTIVO\t340.818,85\t",
    "15.036\tSECTOR B\t1792754658001\tEmpresa Dos\t31/03/2023\tMENSUAL\t502.03.08\tGASTO\t9.450,00\tX",
    "2.118\tSECTOR C\t0992722657001\tEmpresa Tres\t28/02/2025\tMENSUAL\t101.02.02.02.08\tDETALLE\t600.000,00\tFIDEICOMISO MERCANTIL",
    "30.018\tSECTOR D\t1792628415001\tEmpresa Cuatro\t30/11/2023\tMENSUAL\t98\tORDEN\t-190.089,41\t",
]


def write(path, lines, encoding="utf-8"):
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


def test_six_lines_load_once(spark, tmp_path):
    source = write(tmp_path / "a.tsv", LINES)
    log = str(tmp_path / "log")
    for batch in (1, 2):
        clean = ingest.clean_statements(files.read_statements(spark, source))
        ingest.append_batch(clean.select(*files.STATEMENT_COLUMNS), log, batch)
    rows = ingest.current_rows(spark, log)
    assert rows.count() == 6
    values = {r.account_code: r.value for r in rows.collect()}
    assert values["1"] == 1188854.66 and values["98"] == -190089.41
    assert {r.sector_code for r in rows.collect()} == {"22", "15036", "2118", "30018"}
    mark = ingest.stored_high_water_mark(spark, log).first()
    assert str(mark.last_date) == "2025-02-28" and mark.records == 6
    assert tuple(ingest.stored_high_water_mark(spark, str(tmp_path / "none")).first()) == (None, 0)
    ingest.compact(spark, log, str(tmp_path / "compact"))
    assert ingest.current_rows(spark, str(tmp_path / "compact")).count() == 6


def test_first_and_last_wins(spark, tmp_path):
    log = str(tmp_path / "log")
    for batch, amount in ((1, "10,00"), (2, "20,00")):
        line = LINES[0].replace("1.188.854,66", amount)
        raw = files.read_statements(spark, write(tmp_path / f"{batch}.tsv", [line]))
        ingest.append_batch(ingest.clean_statements(raw).select(*files.STATEMENT_COLUMNS), log, batch)
    assert [r.value for r in ingest.current_rows(spark, log, "first").collect()] == [10.0]
    assert [r.value for r in ingest.current_rows(spark, log, "last").collect()] == [20.0]


def test_duplicates_follow_file_order(spark, tmp_path):
    lines = [LINES[0].replace("1.188.854,66", f"{i},00") for i in range(50)]
    raw = files.read_statements(spark, write(tmp_path / "a.txt", lines))
    assert ingest.clean_statements(raw, keep="first").first().value == 0.0
    assert ingest.clean_statements(raw, keep="last").first().value == 49.0
    other = [LINES[0], LINES[0].replace("ANUAL", "MENSUAL")]
    assert ingest.clean_statements(files.read_statements(spark, write(tmp_path / "b.txt", other))).count() == 2


def test_unusable_rows_and_observation(spark, tmp_path):
    bad = [LINES[0].replace("1.188.854,66", v) for v in ("N/A", "", "#REF!")]
    bad += [LINES[1].replace("0991290915001", "123"), LINES[2].replace("31/12/2023", "n/d")]
    raw = files.read_statements(spark, write(tmp_path / "a.csv", bad))
    seen = Observation("read")
    rows = ingest.clean_statements(raw, observation=seen).collect()
    assert len(rows) == 1 and rows[0].date is None
    assert seen.get == {"rows_read": 5}
    counts = ingest.run_metrics(raw).first()
    assert (counts.rows_read, counts.rows_loaded, counts.rows_discarded) == (5, 1, 4)


def test_sector_filter_is_literal(spark, tmp_path):
    raw = files.read_statements(spark, write(tmp_path / "a.tsv", LINES))
    assert ingest.clean_statements(raw, sector_text="sector b").count() == 1
    assert ingest.clean_statements(raw, sector_text="sector .").count() == 0


def test_width_and_extra_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_statements(spark, write(tmp_path / "short.tsv", ["a\tb\tc"]))
    wide = files.read_statements(spark, write(tmp_path / "wide.tsv", [LINES[3] + "\textra\tmore"]))
    assert wide.first().entity_subtype == "X"


def test_mixed_encodings_and_separators(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    named = [line.replace("Empresa Uno", "Compañía Ñandú") for line in LINES[:3]]
    write(folder / "a.tsv", named, "utf-8")
    write(folder / "b.txt", [line.replace("\t", ";") for line in named], "latin-1")
    write(folder / "c.csv", [line.replace(",", "").replace("\t", ",") for line in named], "utf-8")
    (folder / "empty.csv").write_text("")
    (folder / "notes.md").write_text("no data")
    kinds = {r.path.rsplit("/", 1)[-1]: (r.encoding, r.separator, r.fields) for r in files.file_profile(spark, str(folder)).collect()}
    assert kinds == {"a.tsv": ("UTF-8", "\t", 10), "b.txt": ("ISO-8859-1", ";", 10), "c.csv": ("UTF-8", ",", 10)}
    rows = files.read_mixed_statements(spark, str(folder))
    assert rows.count() == 9
    assert {r.company_name for r in rows.collect()} == {"Compañía Ñandú"}


def test_profile_looks_at_whole_files(spark, tmp_path):
    (tmp_path / "far.txt").write_bytes(b"a;b\n" * 5000 + "Compañía;x\n".encode("latin-1"))
    (tmp_path / "long.txt").write_bytes(("a" * 9000 + "ñ" + "b" * 100).encode())
    (tmp_path / "bom.txt").write_bytes("﻿x;y".encode())
    got = {r.path.rsplit("/", 1)[-1]: r.encoding for r in files.file_profile(spark, str(tmp_path)).collect()}
    assert got == {"far.txt": "ISO-8859-1", "long.txt": "UTF-8", "bom.txt": "UTF-8"}


def test_late_latin_character_is_read(spark, tmp_path):
    lines = LINES * 800
    write(tmp_path / "in.tsv", [*lines, LINES[0].replace("Empresa Uno", "Compañía Uno")], "latin-1")
    rows = files.read_mixed_statements(spark, str(tmp_path))
    assert rows.filter("company_name = 'Compañía Uno'").count() == 1


def test_each_narrow_file_is_refused_by_name(spark, tmp_path):
    write(tmp_path / "a.tsv", LINES)
    write(tmp_path / "b.tsv", ["x\ty\tz", "1\t2\t3"])
    for read in (files.read_statements, files.read_mixed_statements):
        with pytest.raises(ValueError, match="b.tsv"):
            read(spark, str(tmp_path))


def test_a_quote_is_a_character(spark, tmp_path):
    odd = LINES[0].replace("Empresa Uno", '"Uno')
    rows = files.read_statements(spark, write(tmp_path / "q.tsv", [odd, *LINES[1:3]])).collect()
    assert len(rows) == 3 and {r.company_name for r in rows} >= {'"Uno'} and all(r.value for r in rows)


def test_header_tables_and_exports(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("﻿id_factura,fecha\n1,2024-01-31\n2,bad\n".encode())
    df = files.read_table(spark, str(tmp_path / "f.csv"), dates=("fecha",))
    assert df.columns == ["id_factura", "fecha"] and [str(r.fecha) for r in df.collect()] == ["2024-01-31", "None"]
    (tmp_path / "p.txt").write_text(" ruc emisor;clave acceso\n1;2\n")
    assert files.read_portal_table(spark, str(tmp_path / "p.txt")).columns == ["RUC_EMISOR", "CLAVE_ACCESO"]
    assert files.export_parquet(df, str(tmp_path / "out"), files=1) is True
    assert files.export_parquet(df.limit(0), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    files.export_csv(df, str(tmp_path / "csv"))
    assert files.read_table(spark, str(tmp_path / "csv")).count() == 2
    files.export_xml(df, str(tmp_path / "xml"), "compras", "detalleCompras")
    assert spark.read.format("xml").option("rowTag", "detalleCompras").load(str(tmp_path / "xml")).count() == 2
    files.export_parquet(spark.createDataFrame([("A", 1), ("B", 2)], "entity_type string, v int"), str(tmp_path / "e"))
    assert files.read_entities(spark, str(tmp_path / "e"), ["A"]).count() == 1


def test_roster(spark):
    rows = spark.createDataFrame(
        [
            (2, "01", "Ana", "Paz", "a@b.ec", "1"), (3, "02", "Eva", "", "", ""), (4, " ", "", " ", "", ""), (5, "01", "Ana", "Paz", "", ""),
            (6, "03", "Leo", "Gil", "", "99"), (7, "04", "Sol", "Rey", "", "x"),
        ],
        "fila int, cedula string, nombre string, apellido string, email string, grupo_id string",
    )
    known = spark.createDataFrame([("04",)], "cedula string")
    groups = spark.createDataFrame([(1,), (7,)], "grupo_id int")
    out = ingest.roster_import(rows, known, groups, default_group=7)
    got = {r.fila: (r.resultado, r.grupo_id) for r in out.collect()}
    assert got == {2: ("insertado", 1), 3: ("error", None), 5: ("omitido", None), 6: ("insertado", 7), 7: ("omitido", None)}
    assert tuple(ingest.roster_counts(out).first()) == (2, 2, 1)
    message = out.filter("fila = 3").first().mensaje
    assert message == "Fila 3: cedula, nombre y apellido son obligatorios."


def test_roster_header(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Cedula,NOMBRE,apellido,Email\n01,Ana,Paz,a@b.ec\n02,Eva,Gil,\n")
    rows = files.read_roster(spark, str(tmp_path / "r.csv")).collect()
    assert [(r.fila, r.cedula, r.email, r.cargo) for r in rows] == [(2, "01", "a@b.ec", None), (3, "02", None, None)]
    (tmp_path / "bad.csv").write_text("cedula,correo\n01,x\n")
    with pytest.raises(ValueError, match="nombre, apellido"):
        files.read_roster(spark, str(tmp_path / "bad.csv"))


def test_timed_load(spark, tmp_path):
    raw = files.read_statements(spark, write(tmp_path / "a.tsv", LINES + LINES[:1]))
    seen = ingest.timed_load(raw, str(tmp_path / "log"), 1)
    assert (seen["rows_read"], seen["rows_loaded"], seen["rows_discarded"]) == (7, 6, 1) and seen["seconds"] > 0


def test_visibility_by_role(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, grupo_id int")
    given = spark.createDataFrame([(7, 10), (7, 10), (8, 30)], "usuario int, grupo_id int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(ingest.visible_rows(rows, given, 7)) == [1]
    assert ids(ingest.visible_rows(rows, given, 9)) == []
    assert ids(ingest.visible_rows(rows, given, 9, supervisor=True)) == [1, 2, 3]
