import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.plans import benefits, payroll, prices, quotes, retrieval, tax
from ledgerspark.plans.payroll import Rules, bracket_value


def test_bracket_bounds(spark):
    base = [-1.0, 0.0, 11902.0, 11902.01, 15159.0, 19682.0, 107623.0, 2e9]
    df = spark.createDataFrame([(b,) for b in base], "b double").select(bracket_value(F.col("b")).alias("t"))
    # a bound belongs to the lower bracket; outside all brackets the amount is 0
    want = [0.0, 0.0, 0.0, 0.01 * 0.05, 3257 * 0.05, 163 + 4523 * 0.10, 14678 + 26906 * 0.35, 0.0]
    assert [r.t for r in df.collect()] == pytest.approx(want)


def test_attendance_rules(spark):
    rows = [(1, "2024-01-02", 480, 1080), (1, "2024-01-03", 495, 1140), (1, "2024-01-06", 480, 780), (1, "2024-01-01", 480, 720), (1, "2024-01-04", 600, 630)]
    df = spark.createDataFrame(rows, "empleado_id int, fecha string, entrada_min int, salida_min int").withColumn("fecha", F.col("fecha").cast("date"))
    got = {str(r.fecha): tuple(r)[2:] for r in payroll.attendance_hours(df, ["2024-01-01"]).collect()}
    assert got["2024-01-02"] == (8.0, 1.0, 0.0, 0)
    assert got["2024-01-03"] == (8.0, 1.75, 0.0, 15)
    assert got["2024-01-06"] == (0.0, 0.0, 4.0, 0)
    assert got["2024-01-01"] == (0.0, 0.0, 3.0, 0)
    assert got["2024-01-04"] == (0.0, 0.0, 0.0, 120)


def test_rules_lookup():
    rules = Rules.of_year(2026)
    assert rules["sbu"] == 470.0 and rules["unknown"] is None and Rules.of_year(1999)["sbu"] is None


def test_profit_share_adds_up(spark):
    people = spark.createDataFrame(
        [(i, "A", "B", datetime.date(2020, 1, 1), None, i % 3) for i in range(7)] + [(99, "X", "Y", datetime.date(2025, 1, 1), None, 1)],
        "id int, apellidos string, nombres string, fecha_ingreso date, fecha_salida date, cargas_familiares int",
    )
    out = benefits.profit_share(people, 1000.0, 2024).collect()
    assert len(out) == 7 and {r.dias_trabajados for r in out} == {360}
    assert sum(r.valor_10 for r in out) == pytest.approx(100, abs=0.05)
    assert sum(r.valor_5 for r in out) == pytest.approx(50, abs=0.05)


def test_invoice_cross(spark):
    inv = spark.createDataFrame(
        [("r", f"k{i}", str(i), v, "0,00", v) for i, v in enumerate(["100,00", "200,00", "500,00", "1000,50", "75,25"])],
        "ruc_emisor string, clave_acceso string, numero string, valor_sin_impuestos string, iva string, importe_total string",
    )
    ret = spark.createDataFrame(
        [("k0", "100,00", "1,00"), ("k2", "450,00", "4,50"), ("k3", "1000,50", "10,00")], "doc_sustento string, base_imponible string, valor_retenido string"
    )
    out = tax.tax_cross(inv, ret)
    assert tuple(tax.cross_counts(out).first()) == (5, 2, 1)
    by_key = ret.withColumnRenamed("doc_sustento", "clave_acceso")
    assert tuple(tax.cross_counts(tax.tax_cross(inv, by_key)).first()) == (5, 2, 1)


def test_page_cards(spark):
    card = '<article class="product_pod"><h3><a href="u" title="{n}">x</a></h3><p class="price_color">{p}</p><p class="instock availability">\n  <i></i>{s}\n</p></article>'
    html = card.format(n="Libro Uno", p="£51.77", s="In stock") + card.format(n="Malo", p="gratis", s="In stock") + card.format(n="Dos", p="$1,000.5", s="Out of stock")
    out = prices.page_products(spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id long, html string")).collect()
    assert [(r.nombre, r.precio_competidor, r.disponibilidad) for r in sorted(out, key=lambda r: r.pos)] == [
        ("Libro Uno", 51.77, "In Stock"), ("Dos", 1000.5, "Out of Stock"),
    ]


def test_quotes(spark):
    df = spark.createDataFrame([(1, "Premium", 10, "Alto"), (2, "Otro", 1, "Normal")], "id int, tipo_servicio string, horas int, nivel_urgencia string")
    good, bad = sorted(quotes.quote(df).collect(), key=lambda r: r.id)
    assert (good.costo_base, good.recargo, good.subtotal, good.ganancia, good.precio_final) == (1200.0, 240.0, 1440.0, 432.0, 1872.0)
    assert bad.precio_final is None and bad.error == "Tipo de servicio desconocido: Otro"


def test_chunks_cover_the_whole_text():
    words = [f"w{i}" for i in range(3000)]
    text = "\n\n".join(" ".join(words[i : i + 90]) for i in range(0, 3000, 90)) + " " + "z" * 1300
    parts = retrieval.chunk_text(text)
    assert all(0 < len(p) <= retrieval.CHUNK for p in parts)
    joined = " ".join(parts)
    assert all(w in joined.split() for w in words)
    assert sum(p.count("z") for p in parts) >= 1300
    assert retrieval.chunk_text("") == [] and retrieval.chunk_text("short. text") == ["short. text"]


def test_chunk_overlap_on_words():
    text = " ".join(f"{i:04d}" for i in range(400))
    parts = retrieval.chunk_text(text)
    for a, b in zip(parts, parts[1:]):
        tail = b.split()[:10]
        assert a.endswith(" ".join(tail)) and len(" ".join(tail)) <= retrieval.OVERLAP


@pytest.mark.parametrize("limit", [4096, 2])
def test_nearest_equals_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 64))
    asked = rng.normal(size=(5, 64))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id int, query array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.nearest(v, q, 4, limit).collect()}
    cosine = np.round(asked @ vectors.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(vectors, axis=1), 6)
    for i in range(5):
        for place, j in enumerate(np.lexsort((np.arange(60), -cosine[i]))[:4], 1):
            assert got[i, place] == j


def test_nearest_leaves_out_vectors_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.9, 0.1]), (5, [1.0, None]), (6, [1.0, 0.0, 0.0]), (7, []), (8, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id int, query array<double>")
    got = [(r.query_id, r.vec_id, r.similarity, r.rank) for r in retrieval.nearest(vectors, questions).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 4, 0.993884, 2), (1, 8, -1.0, 3)]


def test_mean_vectors_keep_their_length(spark):
    rows = [(1, 0, [float(i) for i in range(70)]), (2, 0, [2.0] * 70), (3, 1, [1.0, 3.0])]
    got = {r.query_id: r.query for r in retrieval.label_questions(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got[0] == [(i + 2.0) / 2 for i in range(70)] and got[1] == [1.0, 3.0]
