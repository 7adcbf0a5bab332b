"""360 degree evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.numbers import bands, cents

RATERS = ("Jefe", "Par", "Subordinado")
LEVELS = [(4.5, "Excelente"), (3.5, "Bueno"), (2.5, "Regular")]


def _mean(test=None):
    score = F.col("puntaje") if test is None else F.when(test, F.col("puntaje"))
    return cents(F.try_divide(F.sum(score).cast("double"), F.count(score).cast("double")))


def cycle_progress(evaluations: DataFrame) -> DataFrame:
    return evaluations.groupBy("ciclo_id").agg(
        F.count(F.lit(1)).alias("total_eval"), F.sum("completada").alias("completadas"), F.count_distinct("evaluado_id").alias("total_evaluados")
    )


def person_progress(evaluations: DataFrame, employees: DataFrame) -> DataFrame:
    g = evaluations.groupBy("ciclo_id", "evaluado_id").agg(F.count(F.lit(1)).alias("total_eval"), F.sum("completada").alias("completadas"))
    who = employees.select(F.col("id").alias("evaluado_id"), F.concat_ws(" ", "apellidos", "nombres").alias("nombre"), "cargo")
    return g.join(who, "evaluado_id")


def answers(evaluations: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers of completed evaluations with cycle, person and kind of rater."""
    done = evaluations.filter("completada = 1").select(F.col("id").alias("evaluacion_id"), "ciclo_id", "evaluado_id", "tipo_evaluador")
    return responses.select("evaluacion_id", "criterio", "puntaje").join(done, "evaluacion_id")


def report(evaluations: DataFrame, responses: DataFrame) -> DataFrame:
    """Mean per person and criterion, by kind of rater, against the mean of the cycle, with its level.

    The kinds of rater are conditions in one aggregate; criterion weights exist in the data but are not used.
    """
    a = answers(evaluations, responses)
    person = a.groupBy("ciclo_id", "evaluado_id", "criterio").agg(
        *[_mean(F.col("tipo_evaluador") == r).alias(r.lower()) for r in RATERS],
        _mean().alias("promedio"),
        F.count(F.lit(1)).alias("respuestas"),
    )
    cycle = a.groupBy("ciclo_id", "criterio").agg(_mean().alias("promedio_ciclo"))
    return (
        person.join(cycle, ["ciclo_id", "criterio"])
        .withColumn("diferencia", cents(F.col("promedio") - F.col("promedio_ciclo")))
        .withColumn("nivel", bands(F.col("promedio"), LEVELS, "Por mejorar", strict=False))
    )


def recommendations(evaluations: DataFrame, responses: DataFrame) -> DataFrame:
    """Strengths (mean 4 and more) and gaps (below 3.5) per person; the lists are as long as the criteria at most."""
    r = report(evaluations, responses)

    def names(test):
        return F.array_join(F.array_sort(F.collect_set(F.when(test, F.concat(F.lit("Criterio "), F.col("criterio").cast("string"))))), ", ")

    return r.groupBy("ciclo_id", "evaluado_id").agg(
        names(F.col("promedio") >= 4.0).alias("fortalezas"), names(F.col("promedio") < 3.5).alias("mejoras")
    )
