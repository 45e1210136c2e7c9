"""Column names and feature lists of the billing data model."""

from __future__ import annotations

# ---- Fixed values: they must equal those of the billing data model. ----

UNIT_KEYS = ["codudu", "codcon"]
CONNECTION_KEYS = ["codcon"]
DISTRICT_MONTH_KEYS = ["coddis", "nomdis", "nuanio", "nummes"]

SUMMER_MONTHS = [12, 1, 2]
AUTUMN_MONTHS = [3, 4, 5]
WINTER_MONTHS = [6, 7, 8]
SUMMER, AUTUMN, WINTER, SPRING = "Verano", "Otono", "Invierno", "Primavera"

CATEGORY_DOMESTIC = "102"
CATEGORY_COMMERCIAL = "103"
CATEGORY_INDUSTRIAL = "104"

SUBSIDISED = "1"
NOT_SUBSIDISED = "2"

BASE_YEAR = 2021

TARGET = "consumo_promedio"

REGRESSION_CATEGORICAL = {
    "A": ["distrito", "categoria", "situdu"],
    "B": ["distrito", "categoria_principal", "tipo_predio"],
    "C": ["nomdis", "estacion"],
}
REGRESSION_NUMERIC = {
    "A": [
        "horas_dia_prom",
        "dias_semana_prom",
        "registros_totales",
        "consumo_verano",
        "consumo_invierno",
        "score_calidad",
    ],
    "B": [
        "num_unidades_uso",
        "horas_dia_prom",
        "score_calidad",
        "pct_subsidiado",
        "registros_totales",
    ],
    "C": [
        "mes_absoluto",
        "num_unidades",
        "score_calidad",
        "pct_domestico",
        "pct_comercial",
        "pct_subsidiado",
    ],
}
CLUSTER_FEATURES = {
    "A": ["consumo_promedio", "consumo_std", "tarifa_efectiva", "score_calidad", "registros_totales"],
    "B": ["consumo_promedio", "num_unidades_uso", "tarifa_efectiva", "score_calidad", "pct_subsidiado"],
    "C": ["consumo_promedio", "demanda_total_m3", "tarifa_promedio", "score_calidad", "num_unidades"],
}
ANOMALY_FEATURES = {
    "A": ["consumo_promedio", "consumo_std", "tarifa_efectiva", "score_calidad", "coef_variacion"],
    "B": ["consumo_promedio", "consumo_std", "tarifa_efectiva", "score_calidad", "num_unidades_uso"],
    "C": ["consumo_promedio", "demanda_total_m3", "tarifa_promedio", "coef_variacion", "score_calidad"],
}

PANEL_CATEGORICAL = ["coddis", "codcat", "codtis", "codmof"]
PANEL_NUMERIC = ["hoxdia", "diasem"]

# ---- End of the fixed values. ----

FEATURE_TABLE_KEYS = {"A": UNIT_KEYS, "B": CONNECTION_KEYS, "C": ["coddis", "nuanio", "nummes"]}
