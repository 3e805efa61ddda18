"""Financial ratios over pivoted balances, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from balanza.functions.scalar import safe_ratio, zero


def auxiliaries(df: DataFrame) -> DataFrame:
    """Net result, non-performing loans and gross financial margin; missing parts count as 0."""
    return df.withColumns(
        {
            "resultado": zero("ingresos_total") - zero("gastos_total"),
            "cart_improductiva": zero("cart_nodev") + zero("cart_vencida"),
            "margen_fin_bruto": zero("int_ganados") - zero("int_causados"),
        }
    )


def capitalization() -> Column:
    return safe_ratio("patrimonio", "activo_total")


def delinquency() -> Column:
    return safe_ratio("cart_improductiva", "cartera_bruta")


def coverage() -> Column:
    return safe_ratio(F.abs("provisiones"), "cart_improductiva")


def productive_assets() -> Column:
    return safe_ratio(zero("cartera_bruta") + zero("inversiones"), "activo_total")


def op_efficiency() -> Column:
    return safe_ratio(zero("gastos_op"), "activo_total")


def efficiency_ratio() -> Column:
    return safe_ratio(zero("gastos_op"), "margen_fin_bruto")


def intermediation() -> Column:
    return safe_ratio("cartera_bruta", "depositos")


def roa() -> Column:
    return safe_ratio("resultado", "activo_total")


def roe() -> Column:
    return safe_ratio("resultado", "patrimonio")


def nim() -> Column:
    return safe_ratio("margen_fin_bruto", "activo_total")


def immediate_liquidity() -> Column:
    return safe_ratio("fondos_disp", "depositos")


def extended_liquidity() -> Column:
    return safe_ratio(zero("fondos_disp") + zero("inversiones"), "depositos")


def leverage() -> Column:
    return safe_ratio("pasivo_total", "patrimonio", scale=1)


def loans_to_assets() -> Column:
    return safe_ratio("cartera_bruta", "activo_total")


def provisioning() -> Column:
    return safe_ratio(F.abs("provisiones"), "cartera_bruta")


def log_assets() -> Column:
    return F.when(F.col("activo_total") > 0, F.ln("activo_total"))


def with_fact_ratios(pivoted: DataFrame) -> DataFrame:
    """Ratios under the names of the indicator fact."""
    return auxiliaries(pivoted).withColumns(
        {
            "capitalizacion_pct": capitalization(),
            "morosidad_pct": delinquency(),
            "cobertura_pct": coverage(),
            "roa_pct": roa(),
            "roe_pct": roe(),
            "nim_pct": nim(),
            "liquidez_ampliada": extended_liquidity(),
            "eficiencia_op_pct": op_efficiency(),
            "apalancamiento": leverage(),
            "intermediacion": intermediation(),
        }
    )


def with_panel_ratios(pivoted: DataFrame) -> DataFrame:
    """The 15 ratios of the cross-section study and the size control."""
    return auxiliaries(pivoted).withColumns(
        {
            "C_solvencia": capitalization(),
            "A_morosidad": delinquency(),
            "A_cobertura": coverage(),
            "A_activos_prod": productive_assets(),
            "M_efic_operativa": op_efficiency(),
            "M_efic_ratio": efficiency_ratio(),
            "M_intermediacion": intermediation(),
            "E_roa": roa(),
            "E_roe": roe(),
            "E_nim": nim(),
            "L_liq_inmediata": immediate_liquidity(),
            "L_liq_ampliada": extended_liquidity(),
            "S_apalancamiento": leverage(),
            "S_cartera_activo": loans_to_assets(),
            "S_aprovision": provisioning(),
            "log_activo": log_assets(),
        }
    )


def entity_ratios(df: DataFrame) -> DataFrame:
    """Ratios of the single-entity study; an undefined division is null."""

    def divide(num: str, den: str, scale: float = 100.0) -> Column:
        return F.try_divide(F.col(num), F.col(den)) * F.lit(scale)

    return df.withColumns(
        {
            "capitalizacion": divide("patrimonio", "activo_total"),
            "apalancamiento": F.try_divide("pasivo_total", "patrimonio"),
            "morosidad": safe_ratio("cartera_improductiva", "cartera_bruta"),
            "cobertura": safe_ratio(F.abs("provisiones"), "cartera_improductiva"),
            "resultado_neto": zero("ingresos") - zero("gastos"),
            "roa": F.try_divide(zero("ingresos") - zero("gastos"), F.col("activo_total")) * F.lit(100.0),
            "liquidez_amplia": divide("fondos_disponibles", "depositos"),
        }
    )


def system_ratios(df: DataFrame) -> DataFrame:
    """Ratios of summed balances (not means of entity ratios)."""

    def pct(num: Column, den: str) -> Column:
        return F.try_divide(num, F.col(den)) * F.lit(100.0)

    improductive = F.col("nodev_m") + F.col("vencida_m")
    return df.withColumn("cart_improd_m", improductive).withColumns(
        {
            "resultado_m": F.col("ingresos_m") - F.col("gastos_m"),
            "sist_solvencia": pct(F.col("patrimonio_m"), "activo_total_m"),
            "sist_morosidad": pct(F.col("cart_improd_m"), "cartera_m"),
            "sist_cobertura": pct(F.abs("provisiones_m"), "cart_improd_m"),
            "sist_roa": pct(F.col("ingresos_m") - F.col("gastos_m"), "activo_total_m"),
            "sist_liq_amp": pct(F.col("fondos_m") + F.col("inver_m"), "depositos_m"),
            "sist_nim": pct(F.col("int_ganados_m") - F.col("int_causados_m"), "activo_total_m"),
            "sist_efic_op": pct(F.col("gastos_op_m"), "activo_total_m"),
        }
    )
