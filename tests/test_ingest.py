import datetime as dt
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from balanza.operators import describe
from balanza.sources import store, text

HEADER = "FECHA DE CORTE\tSEGMENTO\tRUC\tRAZON SOCIAL\tCUENTA\tDESCRIPCION CUENTA\tSALDO (USD)"


@pytest.fixture()
def tree(tmp_path):
    def put(path, content, encoding="latin-1"):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content.encode(encoding))

    put("2015/ene.txt", HEADER + '\n2015-01-31\tSEGMENTO 1\t0190\tCOOP ÑANDÚ\t"14"\tCARTERA\t1234,50\n'
        "2015-01-31\tSEGMENTO 1\t0190\tCOOP ÑANDÚ\t11\tFONDOS\tabc\n"
        "2015-01-31\tSEGMENTO 1\t0190\n"
        "2015-01-31\tSEGMENTO 1\t0190\tX\t21\tDEP\t5\tsobra\n")
    put("2016/feb.csv", "Fecha_Corte;Ruc;Cuenta;Saldo\n29/02/2016;0190;1;10\nsin fecha;0191;1;20\n")
    put("2016/malo.csv", "RUC;CUENTA\n1;2\n")
    put("2016/vacio.txt", "")
    put("2016/blanco.txt", "\n")
    put("2016/notas.pdf", "x")
    (tmp_path / "Anteriores").mkdir()
    with zipfile.ZipFile(tmp_path / "Anteriores" / "2010 balances.zip", "w") as z:
        z.writestr("leame.pdf", "x")
        z.writestr("indice.txt", "A;B\n1;2\n")
        z.writestr("datos.csv", "FECHA CORTE;RUC;CUENTA;SALDO USD\n2010-12-31;0190;1;7,5\n2010-12-31;0190;2;1;sobra\n2010-12-31;0190;3\n")
        z.writestr("otro.csv", "FECHA CORTE;RUC;CUENTA;SALDO USD\n2010-12-31;9999;1;1\n")
    (tmp_path / "Anteriores" / "2011 roto.zip").write_bytes(b"not a zip")
    return str(tmp_path)


def test_header_rules():
    assert "saldo_usd" not in text.map_header(["FECHA DE CORTE", "CUENTA", "SALDO ANTERIOR"])
    assert text.normalize_header(" Saldo  (USD) ") == "SALDO_USD"
    assert text.map_header(["FECHA CORTE MES", "RAZÓN", "RAZON SOCIAL", "CUENTA", "DESCRIPCIÓN", "SALDO"]) == [
        "fecha_corte", "RAZÓN", "razon_social", "cuenta", "descripcion_cuenta", "saldo_usd"]
    assert text.require_columns(["ruc", "cuenta"]) == ["fecha_corte", "saldo_usd"]


def test_tree(spark, tree):
    rows = {(r.anio, r.ruc, r.cuenta): r for r in text.read_ledger_tree(spark, tree).collect()}
    assert set(rows) == {
        ("2015", "0190", "14"), ("2015", "0190", "11"), ("2015", "0190", None),
        ("2016", "0190", "1"), ("2016", "0191", "1"), ("2010", "0190", "1"), ("2010", "0190", "3"),
    }
    first = rows["2015", "0190", "14"]
    assert float(first.saldo_usd) == 1234.5 and first.razon_social == "COOP ÑANDÚ" and first.fecha_corte == dt.date(2015, 1, 31)
    assert rows["2015", "0190", "11"].saldo_usd == 0
    assert rows["2015", "0190", None].razon_social is None
    assert rows["2016", "0190", "1"].fecha_corte == dt.date(2016, 2, 29) and rows["2016", "0190", "1"].segmento is None
    assert rows["2016", "0191", "1"].fecha_corte is None
    assert float(rows["2010", "0190", "1"].saldo_usd) == 7.5


def test_refused(spark, tree):
    refused = {r.path.rsplit("/", 1)[1]: r.motivo for r in text.refused_files(spark, text.scan_tree(spark, tree)).collect()}
    assert refused == {
        "malo.csv": "missing fecha_corte, saldo_usd", "blanco.txt": "no header", "notas.pdf": "unknown extension",
        "2010%20balances.zip!indice.txt": "missing fecha_corte, cuenta, saldo_usd", "2011%20roto.zip": "File is not a zip file",
    }


def archive(path, **members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("_", "."), body)


def test_archives_are_read_as_a_whole_or_not_at_all(spark, tmp_path):
    head, row = "FECHA CORTE;RUC;CUENTA;SALDO USD\n", "2010-12-31;{};1;{}\n"
    many = "".join(row.format(f"R{i}", i) for i in range(120_000))
    archive(tmp_path / "z/2010 a.zip", datos_csv=head + many + '"abierto;', otro_csv=head + row.format("0190", 7))
    archive(tmp_path / "z/2011 b.zip", datos_csv=head + many + '"abierto;')
    archive(tmp_path / "z/2012 c.zip", vacio_csv="", otro_csv=head + row.format("0191", 8))
    cut = (tmp_path / "z/2010 a.zip").read_bytes()
    (tmp_path / "z/2013 d.zip").write_bytes(cut[: len(cut) // 2])
    spoilt = bytearray(cut)
    spoilt[2000:2400] = bytes(400)
    (tmp_path / "z/2014 e.zip").write_bytes(bytes(spoilt))
    tree = text.scan_tree(spark, str(tmp_path))
    rows = sorted((r.anio, r.ruc, float(r.saldo_usd)) for r in text.read_ledger_tree(spark, str(tmp_path)).collect())
    assert rows == [("2010", "0190", 7.0), ("2012", "0191", 8.0), ("2014", "0190", 7.0)]
    refused = {r.path.rsplit("/", 1)[1]: r.motivo for r in text.refused_files(spark, tree).collect()}
    assert set(refused) == {
        "2010%20a.zip!datos.csv", "2011%20b.zip!datos.csv", "2011%20b.zip", "2012%20c.zip!vacio.csv", "2013%20d.zip", "2014%20e.zip!datos.csv",
    }
    assert "EOF inside string" in refused["2010%20a.zip!datos.csv"] and refused["2011%20b.zip"] == "no readable member"


def test_long_headers_and_many_layouts(spark, tmp_path):
    (tmp_path / "2015").mkdir()
    wide = ";".join(f"OTRA COLUMNA {i}" for i in range(6_000))
    assert len(wide) > 100_000
    for i in range(5):
        body = f"{wide};FECHA CORTE;CUENTA;RUC;SALDO\n" + ";" * 6_000 + f"2015-01-31;1;{i};{i},5\n"
        (tmp_path / f"2015/ancho{i}.csv").write_text(body if i % 2 else body.replace("OTRA", "UNA"))
    (tmp_path / "2015/otro.TXT").write_text("RUC\tCUENTA\tFECHA CORTE\tSALDO\n9\t2\t31/01/2015\t4\nRUC\tCUENTA\tFECHA CORTE\tSALDO\n\n8\t2\t31/01/2015\t4\n")
    rows = sorted((r.ruc, r.cuenta, float(r.saldo_usd), r.anio) for r in text.read_ledger_tree(spark, str(tmp_path)).collect())
    assert rows == [(str(i), "1", i + 0.5, "2015") for i in range(5)] + [("8", "2", 4.0, "2015"), ("9", "2", 4.0, "2015")]


def test_balances_of_any_size_and_their_rejects(spark):
    given = {"12345678901234567": "12345678901234567.0000", "-1234567890123456789012345,5": "-1234567890123456789012345.5000", "1e3": "1000.0000",
             "9" * 35: "0.0000", "1.234,5": "0.0000", "": "0.0000", None: "0.0000", "abc": "0.0000"}
    raw = spark.createDataFrame([(k, "a") for k in given], "saldo_usd string, anio string")
    watch = Observation()
    got = text.conform(raw, watch).select(F.col("saldo_usd").cast("string")).collect()
    assert [r[0] for r in got] == list(given.values())
    assert watch.get == {"filas": 8, "rechazados": 5}


def test_empty_tree(spark, tmp_path):
    (tmp_path / "2015").mkdir()
    (tmp_path / "2015" / "x.pdf").write_text("x")
    with pytest.raises(ValueError):
        text.read_ledger_tree(spark, str(tmp_path))


def test_store(spark, tmp_path, make_ledger):
    path = str(tmp_path / "store")
    old = make_ledger({"E1": {"1": 5}}, dt.date(2024, 12, 31)).unionByName(make_ledger({"E1": {"1": 6, "2": 1}}, dt.date(2025, 12, 31)))
    store.write_ledger(old, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "anio=2024").glob("*.parquet")}
    store.refresh_year(make_ledger({"E1": {"1": 9}}, dt.date(2025, 12, 31)), path, "2025")
    report = {r.anio: r for r in describe.load_report(store.read_ledger(spark, path)).collect()}
    assert report["2025"].registros == 1 and report["2024"].registros == 1
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "anio=2024").glob("*.parquet")} == before
    store.write_ledger(make_ledger({"E9": {"1": 9}}), path, mode="skip")
    assert store.read_ledger(spark, path).where("ruc = 'E9'").isEmpty()


def test_relational_needs_environment(spark, make_ledger, monkeypatch):
    monkeypatch.delenv("BALANZA_JDBC_URL", raising=False)
    with pytest.raises(KeyError):
        store.write_relational(make_ledger({"E1": {"1": 1}}), "fact_eeff")


def test_directory_csv(spark, tmp_path, entities_ledger):
    from balanza.operators.dimensions import build_directory

    path = str(tmp_path / "directorio")
    store.write_directory_csv(build_directory(entities_ledger), path)
    parts = [p.read_bytes() for p in (tmp_path / "directorio").glob("*.csv")]
    assert all(p.startswith(b"\xef\xbb\xbfruc,") and b"activo_M_Dec2025" in p for p in parts if p)
    assert sum(p.count(b"\n") - 1 for p in parts if p) == 4


def test_the_ledger_is_dealt_once_and_in_more_tasks_the_larger_it_is(spark, tmp_path):
    from balanza import session
    from balanza.sources import adapter

    days = ["1996-01-31", "1996-02-29", "1996-05-31", None]
    lines = [(s, p, 10.25 * p, dt.date.fromisoformat(d) if d else None) for s in (1, 2, None) for p in range(25) for d in days]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    ledger = adapter.ledger_from_tables(spark, str(tmp_path))
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    assert "cuenta" not in "".join(line for line in plan.splitlines() if "hashpartitioning(" in line)
    total = ledger.where("cuenta = '1' and ruc like '%1' and fecha_corte = date'1996-03-31'").first().saldo_usd
    weights = [Decimal(w) for _, w in adapter.LEAVES]
    leaves = [code for code, _ in adapter.LEAVES]
    assert total == 2 * sum(Decimal("10.25") * p * weights[p % 20] for p in range(25) if leaves[p % 20].startswith("1"))
    assert session.tasks_for(spark, 3_000_001, 500_000) == 7 and session.tasks_for(spark, 10) == 4
    assert store.clustered(ledger, 9).rdd.getNumPartitions() >= 5


def test_small_archives_leave_together_and_are_parsed_once(tmp_path, spark, monkeypatch):
    header = "FECHA CORTE;RUC;CUENTA;SALDO USD\n"
    for i in range(30):
        with zipfile.ZipFile(tmp_path / f"2010 {i}.zip", "w") as z:
            z.writestr("datos.csv", header + f"2010-12-31;{i};1;7,5\n")
    calls, whole = [], text._chunks
    monkeypatch.setattr(text, "_chunks", lambda *a: calls.append(a) or whole(*a))
    found = list(text._contents((tmp_path / "2010 3.zip").read_bytes(), text.ENCODING))
    assert len(calls) == 1 and [(m, r, len(c)) for m, r, c in found] == [("datos.csv", None, 1)]
    monkeypatch.setattr(text, "CHUNK_ROWS", 2)
    with zipfile.ZipFile(tmp_path / "2011 x.zip", "w") as z:
        z.writestr("datos.csv", header + "2010-12-31;1;1;7,5\n" * 5)
    assert [len(c) for _, _, c in text._contents((tmp_path / "2011 x.zip").read_bytes(), text.ENCODING)] == [2, 2, 1]
    monkeypatch.undo()
    tree = text.scan_tree(spark, str(tmp_path))
    rows = text.read_ledger_tree(spark, str(tmp_path), tree=tree)
    assert rows.count() == 35 and rows.select("ruc").distinct().count() == 30


def test_a_line_is_parsed_once(spark, tree):
    """Not once for each of its columns, nor again for a filter."""
    found = text.scan_tree(spark, tree)
    plan = text.read_ledger_text(spark, tree, found.headers, list(found.layouts))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == len(found.layouts)


def test_lines_are_shuffled_once_and_unknown_prices_stay_rows(spark, tmp_path):
    from balanza.sources import adapter

    day = dt.date(1996, 2, 10)
    lines = [(1, 0, 10.0, day), (1, 0, None, day), (1, 1, 5.0, day), (1, 19, None, day), (2, 8, 100.0, None), (None, 0, 1.0, day)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_extendedprice double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a", 3), (2, "b", 4), (3, "c", 5)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    ledger = adapter.ledger_from_tables(spark, str(tmp_path))
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    rows = {(r.ruc[-1], r.cuenta): (r.saldo_usd, r.fecha_corte, r.anio) for r in ledger.collect()}
    march, ten, five = dt.date(1996, 3, 31), Decimal("10.0000"), Decimal("5.0000")
    first = {"1": ten + five, "11": ten, "13": five, "1103": ten, "1301": five, "18": None, "1801": None}
    wanted = {("1", code): (amount, march, "1996") for code, amount in first.items()}
    wanted |= {("2", code): (Decimal("-15.0000"), None, None) for code in ("1", "14", "1499")}
    assert rows == wanted and ledger.count() == len(wanted)


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_large_trees_are_listed_lot_by_lot(spark, tmp_path, monkeypatch, most):
    """Whatever is listed at a time, all files are read or refused once; what Spark's readers hide stays hidden."""
    monkeypatch.setattr(text, "FILES_AT_A_TIME", most)
    head, row = "FECHA CORTE;RUC;CUENTA;SALDO USD\n", "2010-12-31;{};1;{}\n"
    for i in range(6):
        archive(tmp_path / f"zips/[{i % 2}]{{a}} b/{i // 2}/2010 {i}.zip", datos_csv=head + row.format(f"R{i}", i))
    archive(tmp_path / "zips/2011 roto.zip", indice_txt="NOTA\nx\n")
    for name in ("2012/uno*.csv", "2012/sub/dos.txt", "_oculto/tres.csv", "2012/.cuatro.csv", "2012/_cinco.csv", "anio=2013/seis.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(head + row.format(name, 9))
    (tmp_path / "2012/nota.pdf").write_text("x")
    found = text.lots(spark, str(tmp_path))
    assert len(found) == (1 if most == 1000 else len(found)) and (most > 4 or len(found) > 1)
    rows = sorted((r.ruc, float(r.saldo_usd)) for r in text.read_ledger_tree(spark, str(tmp_path)).collect())
    assert rows == sorted([(f"R{i}", float(i)) for i in range(6)] + [(n, 9.0) for n in ("2012/uno*.csv", "2012/sub/dos.txt", "anio=2013/seis.csv")])
    refused = sorted(r.path.rsplit("/", 1)[1] for r in text.refused_files(spark, text.scan_tree(spark, str(tmp_path))).collect())
    assert refused == ["2011%20roto.zip", "2011%20roto.zip!indice.txt", "nota.pdf"]
