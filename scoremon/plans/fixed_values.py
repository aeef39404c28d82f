"""Fixed values of the two monitored products.

Everything below is data that has to be exactly this for right results:
bucket edges and labels, recode tables, value lists and cube labels.  Column
names and product codes are not among them; they are parameters of the runs.
"""

from __future__ import annotations

from scoremon.functions.buckets import Band

# ---------------------------------------------------------------------------
# Product "traditional mortgage", base table.
# ---------------------------------------------------------------------------

TRADITIONAL_EXCLUDED_PURPOSES = (
    "AMPLIACION DE CREDITO PARA CONSTRUCCION",
    "AMPLIACION-REMOD.CASA CAMPO",
    "AMPLIACION-REMOD.CASA HABITACION",
    "Cambio de titularidad",
    "CAMBIO PLAZO",
    "CAMBIO VARIOS",
    "LIBRE DISP. CON GARANT.LOCAL COMERC.",
    "LIBRE DISPONIBILIDAD",
    "MIGRACION DE CREDITO",
    "MIGRACION DE MONEDA",
    "NUEVA AMPLIACION DE CREDITO",
    "Unificacion de credito hipotecario",
)
TRADITIONAL_SCORE_EDGES = (335, 365, 415, 485)
TRADITIONAL_SCORE_LABELS = (
    "01. <0 - 335>", "02. [335 - 365>", "03. [365 - 415>", "04. [415 - 485>", "05. [485 - ++>",
)
TRADITIONAL_PD_EDGES = (0.0045641, 0.0151879, 0.0353823, 0.0581041)
TRADITIONAL_PD_LABELS = (
    "01. [0 - 0.45%]", "02. <0.45 - 1.51%]", "03. <1.51 - 3.53%]", "04. <3.53 - 5.81%]", "05. <5.81 - 100%]",
)
TRADITIONAL_AMOUNT_EDGES = (237_500, 340_000, 460_000, 680_000)
TRADITIONAL_AMOUNT_LABELS = (
    "1. [0 - 237,500]", "2. <237,500 - 340,000]", "3. <340,000 - 460,000]", "4. <460,000 - 680,000]",
    "5. <680,000 - ++]",
)
TRADITIONAL_MIN_SCORE = 335
TRADITIONAL_HIGH_AMOUNT = 2_166_210
TRADITIONAL_ZONES = {
    "LIMA TOP": "1. Lima Top",
    "LIMA MODERNA": "2. Lima Moderna",
    "PROVINCIA TOP": "3. Provincia Top",
    "OTROS": "4. Otros",
}
ZONE_OTHER = "98. N.A."
TERM_GROUPS = {
    1: "1. Menor a 4 años",
    2: "2. De 5 a 9 años",
    3: "3. De 10 a 14 años",
    4: "4. De 15 a 19 años",
    5: "5. De 20 a 24 años",
    6: "6. De 25 a 29 años",
    7: "7. De 30 a 34 años",
    8: "8. 35 años o más",
}
TERM_RANGES = {
    "HASTA 10": "1  HASTA 10",
    "<10 - 15]": "2 <10 - 15]",
    "<15 - 20]": "3 <15 - 20]",
    "MAS DE 20": "4 MAS DE 20",
}
SEGMENTS = ("1. Afluente", "2. Consumo", "3. Resto")
TRADITIONAL_SEGMENT_IDS = {"1. Afluente": 1, "2. Consumo": 2}
CAPITAL_LABELS = ("LIMA", "Lima", "Provincia")

# ---------------------------------------------------------------------------
# Product "mortgage guarantee", base table.
# ---------------------------------------------------------------------------

GUARANTEE_PURPOSES = (
    "LIBRE DISPONIBILIDAD",
    "COMPRA VENTA DE LOCAL COMERCIAL",
    "C-V/REMODEL/AMPLI DE LOCAL COMERCIAL",
    "C-V Oficinas/Locales BT",
    "LIBRE DISP. CON GARANT.LOCAL COMERC.",
    "MIGRACION DE OTRO BANCO",
)
GUARANTEE_PURPOSES_SINCE = {"COMPRA/VENTA BIEN TERMINADO": 202307}
GUARANTEE_SCORE_EDGES = (385, 415, 450, 495)
GUARANTEE_SCORE_LABELS = (
    "1. <0 - 385>", "2. [385 - 415>", "3. [415 - 450>", "4. [450 - 495>", "5. [495 - +++>",
)
GUARANTEE_PD_EDGES = (0.005, 0.010, 0.015, 0.025)
GUARANTEE_PD_LABELS = (
    "1. <0 - 0.5%]", "2. <0.5 - 1.0%]", "3. <1.0 - 1.5%]", "4. <1.5 - 2.5%]", "5. <2.5 - ++>",
)
GUARANTEE_AMOUNT_EDGES = (87_500, 140_000, 215_000, 300_000, 600_000)
GUARANTEE_AMOUNT_LABELS = (
    "1. [0 - 87,500]", "2. <87,500 - 140,000]", "3. <140,000 - 215,000]", "4. <215,000 - 300,000]",
    "5. <300,000 - 600,000]", "6. <600,000 - ++>",
)
GUARANTEE_INCOME_EDGES = (2_500, 5_000, 7_500, 10_000, 20_000)
GUARANTEE_INCOME_LABELS = (
    "1. [0 - 2,500]", "2. <2,500 - 5,000]", "3. <5,000 - 7,500]", "4. <7,500 - 10,000]",
    "5. <10,000 - 20,000]", "6. <20,000 - ++>",
)
GUARANTEE_MIN_SCORE = 345
GUARANTEE_AMOUNT_FLAG = {1: "1. >=325,000"}
GUARANTEE_AMOUNT_FLAG_OTHER = "2. <325,000"
GUARANTEE_TIERS = {"1. Afluente": 345, "2. Consumo": 415, "3. Resto": 415}

# ---------------------------------------------------------------------------
# Ordered bands of the renewed sources (first match wins).
# ---------------------------------------------------------------------------

LTV_SOURCE_SINCE = 202308

LTV_BANDS = (
    Band("3. 0.679 - 0.801", 0.679, 0.801),
    Band("1. 0.643 - 0.643", 0.643, 0.643),
    Band("2. 0.643 - 0.679", 0.643, 0.679),
    Band("4. 0.801 - 0.888", 0.801, 0.888),
)
TERM_BANDS = (
    Band("3. De 10 a 14 años", 10, 14),
    Band("2. De 5 a 9 años", 5, 9),
    Band("6. De 25 a 29 años", 25, 29),
    Band("8. 35 años o más", 35, None),
    Band("4. De 15 a 19 años", 15, 19),
    Band("5. De 20 a 24 años", 20, 24),
    Band("1. Menor a 4 años", None, 5, hi_open=True),
)
TENURE_BANDS = (
    Band("1. -41.000 - 27.000", -41, 27),
    Band("2. 27.000 - 59.000", 27, 59),
    Band("3. 59.000 - 114.000", 59, 114),
    Band("4. 114.000 - 610.000", 114, 610),
)
AGE_BANDS = (
    Band("1. 20.000 - 34.000", 20, 34),
    Band("2. 34.000 - 39.000", 34, 39),
    Band("3. 39.000 - 45.000", 39, 45),
    Band("4. 45.000 - 70.000", 45, 70),
)
SPOUSE_INCOME_BANDS = (
    Band("0. Sin conyuge", 0, 0),
    Band("1. 0.000 - 7929.530", 0, 7929.530),
    Band("2. 7929.530 - 112...", 7929.530, 11225),
    Band("3. 11225.000 - 17...", 11225, 17434),
    Band("4. 17434.000 - 82...", 17434, None),
)
HOLDER_INCOME_BANDS = (
    Band("1. 0.000 - 6159.000", 0, 6159),
    Band("2. 6159.000 - 940...", 6159, 9409),
    Band("3. 9409.000 - 160...", 9409, 16000),
    Band("4. 16000.000 - 43...", 16000, None),
)

# ---------------------------------------------------------------------------
# Zone risk rules (department, district, risk).
# A null district stands for the whole department.  Everything else has the
# default BAJO, so only the ALTO rules are listed.
# ---------------------------------------------------------------------------

ZONE_RISK_DEFAULT = "BAJO"
ZONE_RISK_RULES = (
    ("ICA", None, "ALTO"),
    ("PIURA", None, "ALTO"),
    ("LIMA", "ATE-LIMA", "ALTO"),
    ("LIMA", "BREÑA-LIMA", "ALTO"),
    ("CALLAO", "CALLAO-LIMA", "ALTO"),
    ("LIMA", "CARABAYLLO-LIMA", "ALTO"),
    ("LIMA", "EL AGUSTINO-LIMA", "ALTO"),
    ("CALLAO", "MI PERU-CALLAO", "ALTO"),
    ("LIMA", "PACHACAMAC-LIMA", "ALTO"),
    ("LIMA", "PUENTE PIEDRA-LIMA", "ALTO"),
    ("LIMA", "SAN JUAN LURIGANCHO", "ALTO"),
    ("LIMA", "SAN JUAN MIRAFLORES", "ALTO"),
    ("CALLAO", "VENTANILLA-CALLAO", "ALTO"),
    ("LIMA", "VILLA EL SALVADOR", "ALTO"),
    ("LIMA", "VILLA MARIA DEL TRIUNFO-LIMA", "ALTO"),
)
# Second rule set; a null or blank department or district is ND.
ZONE_RISK_UNKNOWN = "ND"
ZONE_RISK_RULES_2 = (
    ("CALLAO", "VENTANILLA-LIMA", "ALTO"),
    ("LIMA", "ATE-LIMA", "ALTO"),
    ("LIMA", "CARABAYLLO-LIMA", "ALTO"),
    ("LIMA", "EL AGUSTINO-LIMA", "ALTO"),
    ("LIMA", "LURIN-LIMA", "ALTO"),
    ("LIMA", "PACHACAMAC-LIMA", "ALTO"),
    ("LIMA", "PUENTE PIEDRA-LIMA", "ALTO"),
    ("LIMA", "SAN JUAN LURIGANCHO", "ALTO"),
    ("LIMA", "SAN JUAN MIRAFLORES", "ALTO"),
    ("LIMA", "VILLA EL SALVADOR", "ALTO"),
    ("LIMA", "VILLA MARIA TRIUNFO", "ALTO"),
)
ZONE_RISK_WEIGHTS = {
    "ALTO": -4.62497281328427,
    "BAJO": -5.21697172709408,
    "ND": -4.61470207761345,
}

# ---------------------------------------------------------------------------
# Labels of the cube axes and of its probabilities.
# ---------------------------------------------------------------------------

TRADITIONAL_AXIS_LABELS = (
    ("EJE_P1", "Producto"),
    ("EJE_P2", "Tipo de Fondeo"),
    ("EJE_P3", "Segmento Banca"),
    ("EJE_P4", "Flg Bancarizado"),
    ("EJE_P5", "Rango de Score"),
    ("EJE_S1", "Deuda promedio No Hipotecaria entre 6 y 24 m"),
    ("EJE_S2", "Utilizacion promedio de lineas entre 6 y 24 m"),
    ("EJE_S3", "Ratio entre el pasivo minimo y prom. en u24 m"),
    ("EJE_S4", "Zona Pauta"),
    ("EJE_S5", "Flag No Dependiente"),
    ("EJE_S6", "Flag Soltero"),
    ("EJE_S7", "Monto aprobado"),
    ("EJE_S8", "Rango Plazo"),
    ("EJE_S9", "Rango de Tasa"),
    ("EJE_S10", "Tipo de Empleo"),
    ("EJE_S11", "Rango de Edad"),
    ("EJE_S12", "Rango Ingreso Conyugue"),
    ("EJE_S13", "LTV"),
    ("EJE_S14", "Rango de Ingreso Titular"),
    ("EJE_S15", "Marca HML"),
    ("EJE_S16", "Pasa Pauta"),
)
GUARANTEE_AXIS_LABELS = (
    ("EJE_P1", "Producto"),
    ("EJE_P2", "Tipo de Fondeo"),
    ("EJE_P3", "Segmento Banca"),
    ("EJE_P4", "Monto de Vivienda"),
    ("EJE_P5", "Cant Plazo Aprobado"),
    ("EJE_S1", "Rango de PD"),
    ("EJE_S2", "Score Troncal Garantía Hipotecaria"),
    ("EJE_S3", "Flag de monto aprobado (S/)>= 325k"),
    ("EJE_S4", "Vista anual"),
    ("EJE_S5", "Ingreso Titular + Conyuge"),
    ("EJE_S6", "Riesgo Zona"),
    ("EJE_S7", "Monto aprobado"),
    ("EJE_S8", "Rango Plazo"),
    ("EJE_S9", "Rango de Tasa"),
    ("EJE_S10", "Tipo de Empleo"),
    ("EJE_S11", "Rango de Edad"),
    ("EJE_S12", "Max Grado"),
    ("EJE_S13", "LTV"),
    ("EJE_S14", "Rango de Ingreso Titular"),
    ("EJE_S15", "Marca HML"),
    ("EJE_S16", "Pasa Pauta"),
)
TRADITIONAL_PD_TITLES = (
    ("01", "01-PD Vigente"),
    ("02", "02-PD Calibrado"),
    ("03", "03-PD Troncal"),
    ("04", "04-PD RBM"),
    ("05", "05-PD Hip"),
    ("06", "06-PD Demográfico"),
    ("07", "07-PD Activo"),
    ("08", "08-PD Transaccional"),
    ("09", "09-PD Pasivo"),
    ("10", "10-PD RCC"),
)

GUARANTEE_PD_TITLES = (
    ("01", "01-PD Vigente"),
    ("02", "02-PD Calibrado"),
    ("03", "03-PD Troncal"),
    ("04", "04-PD Nueva"),
    ("05", "05-PD Modulo Gahi"),
    ("06", "06-PD Demográfico"),
    ("07", "07-PD Activo"),
    ("08", "08-PD Transaccional"),
    ("09", "09-PD Pasivo"),
    ("10", "10-PD RCC"),
)

# ---------------------------------------------------------------------------
# Column names of the published cube and factor table.
# ---------------------------------------------------------------------------

PUBLISHED_NAMES = {
    "codmes": "CODMES",
    "flg_diagnosis": "flgventana_diagnostico",
    "flg_recent": "flgventana_reciente",
    "flg_closed": "flgdef_cerrado",
    "flg_temp": "flgdef_temp",
    "flg_early": "flgmora_temp",
    "seg_proy": "seg_proyeccion",
    "eje_tooltip": "EJE_TOOLTIP",
    "def_closed_xm": "def_cerrado_xm",
    "def_early_xm": "mora_temp_xm",
    "proj_factor_dt_xm": "def_proy_factor_dt_xm",
    "proj_factor_mt_xm": "def_proy_factor_mt_xm",
    "proj_value_dt_xm": "def_proy_valor_dt_xm",
    "proj_value_mt_xm": "def_proy_valor_mt_xm",
    "def_closed_xn": "def_cerrado_xn",
    "def_early_xn": "mora_temp_xn",
    "proj_factor_dt_xn": "def_proy_factor_dt_xn",
    "proj_factor_mt_xn": "def_proy_factor_mt_xn",
    "proj_value_dt_xn": "def_proy_valor_dt_xn",
    "proj_value_mt_xn": "def_proy_valor_mt_xn",
    "month_def": "CODMES_DEF",
    "projection_amounts": "proyeccion_montos",
    "factor_amounts": "factor_montos",
    "projection_accounts": "proyeccion_cuentas",
    "factor_accounts": "factor_cuentas",
}
