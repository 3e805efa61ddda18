import pytest
from pyspark.errors import AnalysisException

from balanza.operators.dimensions import build_dim_account, build_dim_entity, build_fact_indicadores
from balanza.operators.serve import to_json_rows
from balanza.plans import adhoc


SEEN = [*adhoc.VIEWS, "muchos"]


@pytest.fixture(scope="module")
def views(spark, entities_ledger):
    adhoc.register_views(
        {"dim_cooperativa": build_dim_entity(entities_ledger), "dim_cuenta": build_dim_account(entities_ledger),
         "fact_indicadores": build_fact_indicadores(entities_ledger)}
    )
    spark.range(300).createOrReplaceTempView("muchos")
    spark.range(3).createOrReplaceGlobalTempView("secreta")
    spark.udf.register("doble", lambda x: 2 * x, "int")


@pytest.mark.parametrize("asked,rows", [(None, 50), (0, 50), ("ALL", 50), (10, 10), (500, 100), ("x", 50), (-3, 50)])
def test_safe_limit(asked, rows):
    assert adhoc.safe_limit(asked) == rows


@pytest.mark.parametrize("tail,rows", [("", 50), (" LIMIT 10", 10), (" limit 500;", 100), (" LIMIT ALL", 50), (";", 50)])
def test_cap(spark, views, tail, rows):
    assert adhoc.adhoc(spark, "select id from muchos" + tail, views=SEEN).count() == rows


def test_inner_limit_stays(spark, views):
    assert adhoc.adhoc(spark, "SELECT count(*) AS n FROM (SELECT id FROM muchos LIMIT 200) t", views=SEEN).first().n == 200


@pytest.mark.parametrize("statement", ["WITH x AS (SELECT 1) SELECT * FROM x", "DELETE FROM muchos", "DROP VIEW muchos", ""])
def test_guard(spark, views, statement):
    with pytest.raises(adhoc.NotAllowed):
        adhoc.adhoc(spark, statement)
    assert "SELECT" in adhoc.try_adhoc(spark, statement).first().error


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', ruc) FROM dim_cooperativa",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT * FROM parquet.`/tmp/x.parquet`",
        "SELECT * FROM muchos",
        "SELECT ruc FROM dim_cooperativa WHERE ruc IN (SELECT value FROM text.`/etc/hostname`)",
        "SELECT (SELECT max(value) FROM text.`/etc/hostname`) AS x FROM dim_cooperativa",
        "SELECT * FROM range(10)",
        "SELECT * FROM dim_cooperativa JOIN muchos ON true",
        "SELECT TRANSFORM(cuenta) USING 'echo shellran' AS (o string) FROM dim_cuenta",
        "SELECT o FROM (SELECT TRANSFORM(cuenta) USING 'cat' AS (o string) FROM dim_cuenta) t",
        "SELECT reflect/**/('java.lang.System', 'getProperty', 'java.version') FROM dim_cuenta",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'java.version') FROM dim_cuenta",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'java.version')",
        "SELECT * FROM IDENTIFIER('muchos')",
        "SELECT * FROM IDENTIFIER('global_temp.' || 'secreta')",
        "SELECT * FROM global_temp.secreta",
        "SELECT * FROM `global_temp`.`published_dim_cuenta`",
        "SELECT input_file_name/**/() FROM dim_cuenta",
        "SELECT `input_file_name`() FROM dim_cuenta",
        "SELECT ruc FROM dim_cooperativa ORDER BY reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT count(*) FROM dim_cooperativa GROUP BY java_method('java.lang.System', 'getProperty', ruc)",
        "SELECT ruc FROM dim_cooperativa WHERE EXISTS (SELECT 1 FROM dim_cuenta WHERE input_file_name() = ruc)",
        "SELECT sum(length(reflect('java.lang.System', 'getProperty', ruc))) OVER (PARTITION BY ruc) FROM dim_cooperativa",
        "SELECT (SELECT max(reflect('java.lang.System', 'getProperty', 'user.home'))) FROM dim_cooperativa",
        "SELECT x FROM (WITH c AS (SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x) SELECT x FROM c)",
        "SELECT explode(array(1, 2)) FROM dim_cuenta",
        "SELECT * FROM dim_cuenta LATERAL VIEW explode(sequence(1, 100000000)) t AS x",
        "SELECT * FROM VALUES (1), (2)",
        "SELECT doble(1) FROM dim_cuenta",
        "SELECT current_user(), version() FROM dim_cuenta",
        "SELECT * FROM csv.`/etc/passwd` CROSS JOIN dim_cuenta",
        "SELECT * FROM dim_cuenta TABLESAMPLE (50 PERCENT)",
        "SELECT sequence(1, 100000000) FROM dim_cuenta",
        "SELECT repeat(ruc, 100000000) FROM dim_cooperativa",
        "SELECTED",
    ],
)
def test_only_views_and_plain_functions(spark, views, statement):
    with pytest.raises((adhoc.NotAllowed, AnalysisException)):
        adhoc.adhoc(spark, statement)
    assert adhoc.try_adhoc(spark, statement).columns == ["error"]


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT count(*) AS n, round(avg(camel_score), 2) AS m, stddev(roa_pct) AS s, median(roe_pct) AS q FROM fact_indicadores",
        "SELECT ruc, row_number() OVER (PARTITION BY rating_camel ORDER BY camel_score DESC, ruc) AS n FROM fact_indicadores",
        "SELECT upper(trim(ruc)) || '-' || coalesce(nullif(substr(ruc, 1, 2), 'x'), '') AS t FROM dim_cooperativa WHERE ruc LIKE 'E%' AND ruc NOT IN ('q')",
        "SELECT CASE WHEN camel_score > 3 THEN 'a' ELSE 'b' END AS g, year(fecha_corte) AS y, count(DISTINCT ruc) AS n FROM fact_indicadores GROUP BY 1, 2 HAVING count(*) > 0",
        "SELECT a.ruc FROM dim_cooperativa a LEFT JOIN fact_indicadores b USING (ruc) UNION SELECT cuenta FROM dim_cuenta ORDER BY 1",
        "SELECT n FROM (WITH c AS (SELECT count(*) AS n FROM dim_cuenta) SELECT n FROM c)",
        "SELECT ruc FROM dim_cooperativa d WHERE EXISTS (SELECT 1 FROM fact_indicadores f WHERE f.ruc = d.ruc AND f.camel_score BETWEEN 1 AND 5)",
        "SELECT max_by(ruc, camel_score) AS r, greatest(max(roa_pct), 0) AS g, percentile(roa_pct, 0.5) AS p FROM fact_indicadores",
        "SELECT * FROM IDENTIFIER('dim_cuenta')",
        "SELECT ifnull(nvl(razon_social, ruc), '') AS x, date_add(fecha_corte, 1) AS d, lag(roa_pct) OVER (ORDER BY ruc) AS l FROM fact_indicadores JOIN dim_cooperativa USING (ruc)",
    ],
)
def test_plain_statements_run(spark, views, statement):
    answer = adhoc.try_adhoc(spark, statement)
    assert "error" not in answer.columns, answer.first()
    answer.collect()


def test_views_are_those_of_now(spark, views):
    spark.range(5).createOrReplaceTempView("cambia")
    assert adhoc.adhoc(spark, "SELECT count(*) AS n FROM cambia", views=["cambia"]).first().n == 5
    spark.range(7).createOrReplaceTempView("cambia")
    assert adhoc.adhoc(spark, "SELECT count(*) AS n FROM cambia", views=["cambia"]).first().n == 7


def test_text_that_looks_like_a_call_is_fine(spark, views):
    rows = adhoc.adhoc(spark, "SELECT ruc, 'text.`/x` reflect(1)' AS nota FROM dim_cooperativa d WHERE d.ruc = 'E1'").collect()
    assert [tuple(r) for r in rows] == [("E1", "text.`/x` reflect(1)")]


def test_error_row(spark, views):
    with pytest.raises(AnalysisException):
        adhoc.adhoc(spark, "SELECT nada FROM muchos", views=SEEN)
    assert adhoc.try_adhoc(spark, "SELECT nada FROM muchos", views=SEEN).columns == ["error"]


def test_catalogue(spark, views):
    assert ("fact_indicadores", "camel_score", "decimal(5,3)") in {tuple(r) for r in adhoc.column_catalogue(spark).collect()}


def test_json_rows(spark, entities_ledger):
    fact = build_fact_indicadores(entities_ledger).where("ruc = 'E3'").select("fecha_corte", "camel_score", "roa_pct")
    assert to_json_rows(fact).first().json == '{"fecha_corte":"2025-12-31","camel_score":3.0,"roa_pct":null}'
