"""SQL counterparts of the registered queries, on the same tables."""

from __future__ import annotations

import math

from aforo import schema as S
from aforo.functions.hashing import MODULUS, key_hash_sql
from catalog.fixture import ORACLE_CONSUMO

SAMPLE = 1_000
SHIFT = 0.0173  # as in the queries: keeps short decimals off the rounding boundary
TOTAL = "TOTAL (todos los distritos)"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr}) + {SHIFT * 10.0**-digits!r}, {digits}) + 0.0 AS {name}"


def rs(names, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(r(f"{prefix}{n}", n, digits) for n in names)


SEASON = """CASE WHEN nummes IN (12, 1, 2) THEN 'Verano' WHEN nummes IN (3, 4, 5) THEN 'Otono'
            WHEN nummes IN (6, 7, 8) THEN 'Invierno' ELSE 'Primavera' END"""
BILL = "imagua + imalca + imcafi"
QUALITY = "(hoxdia / 24.0) * (diasem / 7.0)"
FIRST_A = "ORDER BY nuanio, nummes, nomdis, coddis, nomcat, codcat, situdu, coorpx, coorpy"
FIRST_B = "ORDER BY nuanio, nummes, nomdis, coddis, nomcat, codcat, coorpx, coorpy"

CTES = {
    "consumo": ORACLE_CONSUMO,
    "a": f"""
SELECT *, consumo_max - consumo_min AS consumo_rango,
       CASE WHEN consumo_promedio > 0 THEN consumo_std / consumo_promedio END AS coef_variacion,
       consumo_verano - consumo_invierno AS delta_estacional,
       CASE WHEN situdu = '1' THEN 1 ELSE 0 END AS es_subsidiado
FROM (SELECT codudu, codcon,
       FIRST(nomdis {FIRST_A}) AS distrito, FIRST(coddis {FIRST_A}) AS cod_distrito,
       FIRST(nomcat {FIRST_A}) AS categoria, FIRST(codcat {FIRST_A}) AS cod_categoria,
       FIRST(situdu {FIRST_A}) AS situdu,
       FIRST(coorpx {FIRST_A}) AS coord_x, FIRST(coorpy {FIRST_A}) AS coord_y,
       AVG(volfac) AS consumo_promedio, STDDEV_SAMP(volfac) AS consumo_std,
       MIN(volfac) AS consumo_min, MAX(volfac) AS consumo_max, SUM(volfac) AS consumo_total,
       QUANTILE_CONT(volfac, 0.5) AS consumo_mediana, SUM({BILL}) AS importe_total,
       AVG(CASE WHEN volfac > 0 THEN imagua / volfac END) AS tarifa_efectiva,
       AVG(hoxdia) AS horas_dia_prom, AVG(diasem) AS dias_semana_prom,
       AVG({QUALITY}) AS score_calidad, COUNT(*) AS registros_totales,
       COUNT(DISTINCT nuanio) AS anios_activos,
       AVG(CASE WHEN nummes IN (12, 1, 2) THEN volfac END) AS consumo_verano,
       AVG(CASE WHEN nummes IN (6, 7, 8) THEN volfac END) AS consumo_invierno
      FROM consumo GROUP BY codudu, codcon)""",
    "b": f"""
SELECT *, consumo_max - consumo_min AS consumo_rango,
       CASE WHEN consumo_promedio > 0 THEN consumo_std / consumo_promedio END AS coef_variacion,
       consumo_verano - consumo_invierno AS delta_estacional,
       CAST(registros_subsidiados AS DOUBLE) / registros_totales AS pct_subsidiado,
       consumo_total / num_unidades_uso AS consumo_por_udu,
       CASE WHEN num_unidades_uso = 1 THEN 'Unifamiliar' WHEN num_unidades_uso <= 4 THEN 'Pequeno'
            WHEN num_unidades_uso <= 10 THEN 'Mediano' ELSE 'Grande' END AS tipo_predio
FROM (SELECT codcon,
       FIRST(nomdis {FIRST_B}) AS distrito, FIRST(coddis {FIRST_B}) AS cod_distrito,
       FIRST(nomcat {FIRST_B}) AS categoria_principal, FIRST(codcat {FIRST_B}) AS cod_categoria,
       FIRST(coorpx {FIRST_B}) AS coord_x, FIRST(coorpy {FIRST_B}) AS coord_y,
       COUNT(DISTINCT codudu) AS num_unidades_uso,
       AVG(volfac) AS consumo_promedio, STDDEV_SAMP(volfac) AS consumo_std,
       MIN(volfac) AS consumo_min, MAX(volfac) AS consumo_max, SUM(volfac) AS consumo_total,
       SUM({BILL}) AS importe_total,
       AVG(CASE WHEN volfac > 0 THEN imagua / volfac END) AS tarifa_efectiva,
       AVG(hoxdia) AS horas_dia_prom, AVG({QUALITY}) AS score_calidad,
       COUNT(*) AS registros_totales, COUNT(DISTINCT nuanio) AS anios_activos,
       COUNT(*) FILTER (situdu = '1') AS registros_subsidiados,
       AVG(CASE WHEN nummes IN (12, 1, 2) THEN volfac END) AS consumo_verano,
       AVG(CASE WHEN nummes IN (6, 7, 8) THEN volfac END) AS consumo_invierno,
       COUNT(DISTINCT codcat) AS num_categorias
      FROM consumo GROUP BY codcon)""",
    "c": f"""
SELECT *, CAST(n_domestico AS DOUBLE) / num_registros * 100 AS pct_domestico,
       CAST(n_comercial AS DOUBLE) / num_registros * 100 AS pct_comercial,
       CAST(n_industrial AS DOUBLE) / num_registros * 100 AS pct_industrial,
       CAST(n_subsidiados AS DOUBLE) / num_registros * 100 AS pct_subsidiado,
       demanda_total_m3 / num_unidades AS consumo_per_unidad,
       CASE WHEN demanda_total_m3 > 0 THEN facturacion_total / demanda_total_m3 END AS tarifa_promedio,
       CASE WHEN consumo_promedio > 0 THEN consumo_std / consumo_promedio END AS coef_variacion,
       consumo_p75 - consumo_p25 AS iqr_consumo
FROM (SELECT coddis, nomdis, nuanio, nummes,
       CAST((nuanio - 2021) * 12 + nummes AS INT) AS mes_absoluto, {SEASON} AS estacion,
       COUNT(*) AS num_registros, COUNT(DISTINCT codudu) AS num_unidades,
       COUNT(DISTINCT codcon) AS num_conexiones, SUM(volfac) AS demanda_total_m3,
       SUM({BILL}) AS facturacion_total, AVG(volfac) AS consumo_promedio,
       STDDEV_SAMP(volfac) AS consumo_std, QUANTILE_CONT(volfac, 0.5) AS consumo_mediana,
       QUANTILE_CONT(volfac, 0.25) AS consumo_p25, QUANTILE_CONT(volfac, 0.75) AS consumo_p75,
       QUANTILE_CONT(volfac, 0.95) AS consumo_p95, AVG({QUALITY}) AS score_calidad,
       COUNT(*) FILTER (codcat = '102') AS n_domestico, COUNT(*) FILTER (codcat = '103') AS n_comercial,
       COUNT(*) FILTER (codcat = '104') AS n_industrial, COUNT(*) FILTER (situdu = '1') AS n_subsidiados
      FROM consumo GROUP BY coddis, nomdis, nuanio, nummes)""",
    "dm": """
SELECT coddis, nomdis, nuanio, nummes, SUM(volfac) AS demanda_total_m3,
       CAST((nuanio - 2021) * 12 + nummes AS INT) AS mes_absoluto
FROM consumo GROUP BY coddis, nomdis, nuanio, nummes""",
    "series": f"""
SELECT nomdis AS serie, nuanio, nummes, SUM(demanda_total_m3) AS valor FROM dm GROUP BY 1, 2, 3
UNION ALL
SELECT '{TOTAL}', nuanio, nummes, SUM(demanda_total_m3) FROM dm GROUP BY 2, 3""",
    "smooth": """
SELECT *, CASE WHEN t >= 6 AND t < n - 6 THEN (inner_sum + 0.5 * ends) / 12 END AS tendencia
FROM (SELECT *, ROW_NUMBER() OVER w - 1 AS t, COUNT(*) OVER (PARTITION BY serie) AS n,
             SUM(valor) OVER (PARTITION BY serie ORDER BY nuanio, nummes
                              ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS inner_sum,
             LAG(valor, 6) OVER w + LEAD(valor, 6) OVER w AS ends
      FROM series WINDOW w AS (PARTITION BY serie ORDER BY nuanio, nummes))""",
    "positions": """
SELECT serie, t % 12 AS p, AVG(valor - tendencia) AS bruto FROM smooth WHERE n >= 24 GROUP BY 1, 2""",
    "dec": """
SELECT s.serie, s.nuanio, s.nummes, s.t, s.valor, s.tendencia, s.t % 12 + 1 AS posicion,
       p.bruto - m.media AS estacional, s.valor - s.tendencia - (p.bruto - m.media) AS residuo
FROM smooth s JOIN positions p ON s.serie = p.serie AND s.t % 12 = p.p
JOIN (SELECT serie, AVG(bruto) AS media FROM positions GROUP BY 1) m ON s.serie = m.serie
WHERE s.n >= 24""",
    "trend": """
SELECT serie, ARG_MIN(tendencia, t) FILTER (tendencia IS NOT NULL) AS tendencia_inicio,
       ARG_MAX(tendencia, t) FILTER (tendencia IS NOT NULL) AS tendencia_fin FROM dec GROUP BY serie""",
    "amp": """
SELECT serie, MAX(estacional) AS estacionalidad_max, MIN(estacional) AS estacionalidad_min,
       MAX(estacional) - MIN(estacional) AS estacionalidad_amplitud FROM dec GROUP BY serie""",
    "pattern": """
SELECT serie, posicion, ARG_MIN(nummes, t) AS mes, AVG(estacional) AS patron FROM dec GROUP BY 1, 2""",
    "extremes": """
SELECT serie, FIRST(posicion ORDER BY patron DESC, posicion) AS mes_max, MAX(patron) AS valor_max,
       FIRST(posicion ORDER BY patron, posicion) AS mes_min, MIN(patron) AS valor_min
FROM pattern GROUP BY serie""",
    "sstats": """
SELECT serie, COUNT(valor) AS n_puntos, AVG(valor) AS media, STDDEV_POP(valor) AS std,
       MIN(valor) AS min, MAX(valor) AS max FROM series GROUP BY serie""",
    "um": """
SELECT codcon, codudu, CAST(nuanio * 12 + nummes AS INT) AS mes, MAX(situdu) AS s
FROM consumo GROUP BY 1, 2, 3""",
    "lagged": """
SELECT *, LAG(s) OVER (PARTITION BY codcon, codudu ORDER BY mes) AS prev FROM um""",
    "transitions": """
SELECT codcon, codudu, MIN(mes) AS mes_evento, '1to2' AS tipo FROM lagged
WHERE prev = '1' AND s = '2' GROUP BY 1, 2
UNION ALL
SELECT codcon, codudu, MIN(mes), '2to1' FROM lagged WHERE prev = '2' AND s = '1' GROUP BY 1, 2""",
    "never": """
SELECT codcon, codudu FROM consumo GROUP BY 1, 2 HAVING MIN(situdu) = '2' AND MAX(situdu) = '2'""",
    "treated": "SELECT codcon, codudu, mes_evento FROM transitions WHERE tipo = '1to2'",
    "ranges": """
SELECT mes_evento, SUM(k) OVER (ORDER BY mes_evento) - k AS lo, SUM(k) OVER (ORDER BY mes_evento) AS hi
FROM (SELECT mes_evento, COUNT(*) AS k FROM treated GROUP BY 1)""",
    "ordered": f"""
SELECT codcon, codudu, ROW_NUMBER() OVER (ORDER BY {key_hash_sql(['codcon', 'codudu'])}, codcon, codudu) AS rk,
       {key_hash_sql(['codcon', 'codudu'], 43)} % (SELECT COUNT(*) FROM treated) AS pos
FROM never""",
    "controls": """
SELECT o.codcon, o.codudu, g.mes_evento FROM ordered o JOIN ranges g ON o.pos >= g.lo AND o.pos < g.hi
WHERE o.rk <= 2 * (SELECT COUNT(*) FROM treated)""",
    "panel": """
SELECT c.*, t.tipo AS event_type, CAST(c.nuanio * 12 + c.nummes - t.mes_evento AS INT) AS t_rel
FROM consumo c JOIN transitions t ON c.codcon = t.codcon AND c.codudu = t.codudu
WHERE c.nuanio * 12 + c.nummes - t.mes_evento BETWEEN -6 AND 6""",
    "did": """
SELECT *, CAST(t_rel >= 0 AS INT) AS post FROM (
SELECT c.*, CAST(c.nuanio * 12 + c.nummes - t.mes_evento AS INT) AS t_rel, 1 AS treated
FROM consumo c JOIN treated t ON c.codcon = t.codcon AND c.codudu = t.codudu
UNION ALL
SELECT c.*, CAST(c.nuanio * 12 + c.nummes - t.mes_evento AS INT), 0
FROM consumo c JOIN controls t ON c.codcon = t.codcon AND c.codudu = t.codudu)
WHERE t_rel BETWEEN -6 AND 6""",
    "pre": """
SELECT t_rel, AVG(CASE WHEN treated = 0 THEN volfac END) AS control,
       AVG(CASE WHEN treated = 1 THEN volfac END) AS treated FROM did WHERE t_rel < 0 GROUP BY t_rel""",
    "basic": """
SELECT *, (treated_post - treated_pre) - (control_post - control_pre) AS effect FROM (
SELECT AVG(volfac) FILTER (treated = 1 AND post = 1) AS treated_post,
       AVG(volfac) FILTER (treated = 1 AND post = 0) AS treated_pre,
       AVG(volfac) FILTER (treated = 0 AND post = 1) AS control_post,
       AVG(volfac) FILTER (treated = 0 AND post = 0) AS control_pre FROM did)""",
    "flagged": """
SELECT *, consumo_promedio - cut AS anomaly_score, consumo_promedio > cut AS es_anomalia
FROM a, (SELECT QUANTILE_CONT(consumo_promedio, 0.99) AS cut FROM a)""",
    "comparison": "\nUNION ALL\n".join(
        f"""SELECT '{f}' AS feature, AVG({f}) FILTER (NOT es_anomalia) AS normal,
       AVG({f}) FILTER (es_anomalia) AS anomalia, COUNT(*) AS n_total,
       COUNT(*) FILTER (es_anomalia) AS n_anomalias FROM flagged"""
        for f in S.ANOMALY_FEATURES["A"]
    ),
    "bz": "SELECT codcon, "
    + ", ".join(S.CLUSTER_FEATURES["B"])
    + ", "
    + ", ".join(
        f"({f} - AVG({f}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({f}) OVER (), 0), 1) AS z_{f}"
        for f in S.CLUSTER_FEATURES["B"]
    )
    + " FROM b WHERE "
    + " AND ".join(f"{f} IS NOT NULL" for f in S.CLUSTER_FEATURES["B"]),
    "labelled": "SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM (SELECT *, "
    + ", ".join(
        " + ".join(f"(z_{f} - ({v})) * (z_{f} - ({v}))" for f in S.CLUSTER_FEATURES["B"]) + f" AS d{i}"
        for i, v in enumerate((-1.0, 0.0, 1.0))
    )
    + " FROM bz)",
    "pairs": "SELECT x.codcon, x.cluster AS own, y.cluster AS other, AVG(d) AS sq, SUM(d) AS sum_sq, SUM(SQRT(d)) AS sum_eu, COUNT(*) AS n FROM (SELECT x.codcon, x.cluster, y.cluster AS yc, "
    + " + ".join(f"(x.z_{f} - y.z_{f}) * (x.z_{f} - y.z_{f})" for f in S.CLUSTER_FEATURES["B"])
    + " AS d FROM labelled x, labelled y) x, (SELECT DISTINCT cluster FROM labelled) y WHERE x.yc = y.cluster GROUP BY 1, 2, 3",
    "widths": """
SELECT codcon, MAX(CASE WHEN own = other THEN sum_sq / NULLIF(n - 1, 0) END) AS a_sq,
       MIN(CASE WHEN own <> other THEN sum_sq / n END) AS b_sq,
       MAX(CASE WHEN own = other THEN sum_eu / NULLIF(n - 1, 0) END) AS a_eu,
       MIN(CASE WHEN own <> other THEN sum_eu / n END) AS b_eu FROM pairs GROUP BY codcon""",
    # saturated regression of volfac on the categories
    "levels": "SELECT codcat, AVG(volfac) AS m, COUNT(*) AS n FROM consumo GROUP BY 1",
    "base": "SELECT codcat, m, n FROM levels ORDER BY codcat LIMIT 1",
    "resid": "SELECT c.codcon, c.codudu, c.codcat, c.volfac - l.m AS e FROM consumo c JOIN levels l ON c.codcat = l.codcat",
    "cs": "SELECT codcon, codudu, codcat, SUM(e) AS s FROM resid GROUP BY 1, 2, 3",
    "v": """
SELECT x.codcat AS i, y.codcat AS j, SUM(x.s * y.s) / (MAX(lx.n) * MAX(ly.n)) AS v
FROM cs x JOIN cs y ON x.codcon = y.codcon AND x.codudu = y.codudu
JOIN levels lx ON lx.codcat = x.codcat JOIN levels ly ON ly.codcat = y.codcat GROUP BY 1, 2""",
    "factor": """
SELECT g / (g - 1.0) * (n - 1.0) / (n - k) AS f, CAST(g AS BIGINT) AS g, n FROM (
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT codcon, codudu FROM consumo)) AS g,
       (SELECT COUNT(*) FROM consumo) AS n, (SELECT COUNT(*) FROM levels) AS k)""",
    "sat": """
SELECT CASE WHEN l.codcat = b.codcat THEN 'intercept' ELSE 'codcat__' || l.codcat END AS term,
       CASE WHEN l.codcat = b.codcat THEN l.m ELSE l.m - b.m END AS coef,
       SQRT(f.f * CASE WHEN l.codcat = b.codcat THEN v00.v
            ELSE vll.v + v00.v - 2 * COALESCE(v0l.v, 0) END) AS std_error, f.g AS n_clusters, f.n AS n_obs
FROM levels l, base b, factor f, v v00, v vll, v v0l
WHERE v00.i = b.codcat AND v00.j = b.codcat AND vll.i = l.codcat AND vll.j = l.codcat
  AND v0l.i = b.codcat AND v0l.j = l.codcat""",
    # saturated event study: dummies of t_rel per event type
    "et_levels": "SELECT event_type, t_rel, AVG(volfac) AS m, COUNT(*) AS n FROM panel GROUP BY 1, 2",
    "et_resid": """
SELECT p.event_type, p.codcon, p.codudu, p.t_rel, p.volfac - l.m AS e, p.volfac
FROM panel p JOIN et_levels l ON p.event_type = l.event_type AND p.t_rel = l.t_rel""",
    "et_cs": "SELECT event_type, codcon, codudu, t_rel, SUM(e) AS s FROM et_resid GROUP BY 1, 2, 3, 4",
    "et_v": """
SELECT x.event_type, x.t_rel AS i, y.t_rel AS j, SUM(x.s * y.s) / (MAX(lx.n) * MAX(ly.n)) AS v
FROM et_cs x JOIN et_cs y ON x.event_type = y.event_type AND x.codcon = y.codcon AND x.codudu = y.codudu
JOIN et_levels lx ON lx.event_type = x.event_type AND lx.t_rel = x.t_rel
JOIN et_levels ly ON ly.event_type = y.event_type AND ly.t_rel = y.t_rel GROUP BY 1, 2, 3""",
    "et_fit": """
SELECT p.event_type, COUNT(*) AS n, COUNT(DISTINCT (codcon, codudu)) AS g, COUNT(DISTINCT t_rel) AS k,
       1 - SUM(e * e) / (VAR_POP(volfac) * COUNT(*)) AS r2 FROM et_resid p GROUP BY 1""",
    # saturated difference in differences
    "dd_levels": "SELECT treated, post, AVG(volfac) AS m, COUNT(*) AS n FROM did GROUP BY 1, 2",
    "dd_resid": """
SELECT d.codcon, d.codudu, d.treated, d.post, d.volfac, d.volfac - l.m AS e
FROM did d JOIN dd_levels l ON d.treated = l.treated AND d.post = l.post""",
    "dd_cs": """
SELECT codcon, codudu,
       COALESCE(SUM(e) FILTER (treated = 0 AND post = 0) / (SELECT n FROM dd_levels WHERE treated = 0 AND post = 0), 0) AS u00,
       COALESCE(SUM(e) FILTER (treated = 0 AND post = 1) / (SELECT n FROM dd_levels WHERE treated = 0 AND post = 1), 0) AS u01,
       COALESCE(SUM(e) FILTER (treated = 1 AND post = 0) / (SELECT n FROM dd_levels WHERE treated = 1 AND post = 0), 0) AS u10,
       COALESCE(SUM(e) FILTER (treated = 1 AND post = 1) / (SELECT n FROM dd_levels WHERE treated = 1 AND post = 1), 0) AS u11
FROM dd_resid GROUP BY 1, 2""",
    "dd_fit": """
SELECT COUNT(*) AS n, COUNT(DISTINCT (codcon, codudu)) AS g,
       1 - SUM(e * e) / (VAR_POP(volfac) * COUNT(*)) AS r2 FROM dd_resid""",
    "dd_se": """
SELECT SQRT(f * SUM(u00 * u00)) AS s0, SQRT(f * SUM((u10 - u00) * (u10 - u00))) AS s1,
       SQRT(f * SUM((u01 - u00) * (u01 - u00))) AS s2,
       SQRT(f * SUM((u11 - u10 - u01 + u00) * (u11 - u10 - u01 + u00))) AS s3
FROM dd_cs, (SELECT g / (g - 1.0) * (n - 1.0) / (n - 4) AS f FROM dd_fit) GROUP BY f""",
}


def nearest(columns: list[str], centres: list[list[str]]) -> str:
    """SQL of the number of the nearest centre, the lowest on ties."""
    d = ["(" + " + ".join(f"({c} - ({v})) * ({c} - ({v}))" for c, v in zip(columns, centre)) + ")" for centre in centres]
    return f"list_position([{', '.join(d)}], LEAST({', '.join(d)})) - 1"


Z_B = [f"z_{f}" for f in S.CLUSTER_FEATURES["B"]]
CTES["steps0"] = (
    "SELECT k AS cluster, 0.0 AS w, " + ", ".join(f"k - 1.0 AS {z}" for z in Z_B) + " FROM (SELECT UNNEST([0, 1, 2]) AS k)"
)
for _step in (1, 2):
    # each step reads one file's rows and the centres of the step before
    _centre = lambda k, z: f"(SELECT {z} FROM steps{_step - 1} WHERE cluster = {k})"
    CTES[f"rows{_step}"] = (
        f"SELECT *, {nearest(Z_B, [[f'c{k}_{z}' for z in Z_B] for k in range(3)])} AS cluster FROM (SELECT b2.*, "
        + ", ".join(f"{_centre(k, z)} AS c{k}_{z}" for k in range(3) for z in Z_B)
        + f" FROM (SELECT z.*, b.cod_distrito FROM bz z JOIN b ON b.codcon = z.codcon) b2 WHERE cod_distrito % 2 = {_step - 1})"
    )
    CTES[f"steps{_step}"] = (
        "SELECT s.cluster, s.w + COALESCE(n, 0) AS w, "
        + ", ".join(f"CASE WHEN n > 0 THEN (s.{z} * s.w + t.{z}) / (s.w + n) ELSE s.{z} END AS {z}" for z in Z_B)
        + f" FROM steps{_step - 1} s LEFT JOIN (SELECT cluster, COUNT(*) AS n, "
        + ", ".join(f"SUM({z}) AS {z}" for z in Z_B)
        + f" FROM rows{_step} GROUP BY 1) t ON t.cluster = s.cluster"
    )
FIXED = {k: [[repr(2.0 * i / (k - 1) - 1.0)] * 5 for i in range(k)] for k in (2, 3, 5)}
for _k, _fixed in FIXED.items():
    # mean squared distance of a row to a cluster, from the cluster's sums
    CTES[f"near{_k}"] = f"SELECT codcon, {', '.join(Z_B)}, {nearest(Z_B, _fixed)} AS c FROM bz"
    CTES[f"sums{_k}"] = (
        "SELECT c, COUNT(*) AS n, " + ", ".join(f"SUM({z}) AS s_{z}" for z in Z_B)
        + f", SUM({' + '.join(f'{z} * {z}' for z in Z_B)}) AS q FROM near{_k} GROUP BY c"
    )
    CTES[f"far{_k}"] = (
        "SELECT x.codcon, x.c AS own, y.c AS other, y.n, (" + " + ".join(f"x.{z} * x.{z}" for z in Z_B)
        + ") * y.n - 2 * (" + " + ".join(f"x.{z} * y.s_{z}" for z in Z_B) + f") + y.q AS total FROM near{_k} x, sums{_k} y"
    )
    CTES[f"sil{_k}"] = f"""
SELECT {_k} AS k, AVG(CASE WHEN n = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END) AS s FROM (
SELECT codcon, MAX(CASE WHEN own = other THEN n END) AS n, MAX(CASE WHEN own = other THEN total / NULLIF(n - 1, 0) END) AS a,
       MIN(CASE WHEN own <> other THEN total / n END) AS b FROM far{_k} GROUP BY codcon)"""
NEEDS = {
    "rows1": ["bz", "steps0"], "steps1": ["rows1"], "rows2": ["bz", "steps1"], "steps2": ["rows2"],
    **{f"near{k}": ["bz"] for k in FIXED}, **{f"sums{k}": [f"near{k}"] for k in FIXED},
    **{f"far{k}": [f"sums{k}"] for k in FIXED}, **{f"sil{k}": [f"far{k}"] for k in FIXED},
    "a": ["consumo"], "b": ["consumo"], "c": ["consumo"], "dm": ["consumo"], "series": ["dm"],
    "smooth": ["series"], "positions": ["smooth"], "dec": ["positions"], "trend": ["dec"], "amp": ["dec"],
    "pattern": ["dec"], "extremes": ["pattern"], "sstats": ["series"], "um": ["consumo"], "lagged": ["um"],
    "transitions": ["lagged"], "never": ["consumo"], "treated": ["transitions"], "ranges": ["treated"],
    "ordered": ["never", "treated"], "controls": ["ordered", "ranges"], "panel": ["transitions"],
    "did": ["controls"], "pre": ["did"], "basic": ["did"], "flagged": ["a"], "comparison": ["flagged"],
    "bz": ["b"], "labelled": ["bz"], "pairs": ["labelled"], "widths": ["pairs"], "levels": ["consumo"],
    "base": ["levels"], "resid": ["levels"], "cs": ["resid"], "v": ["cs"], "factor": ["levels"],
    "sat": ["v", "factor", "base"], "et_levels": ["panel"], "et_resid": ["et_levels"], "et_cs": ["et_resid"],
    "et_v": ["et_cs"], "et_fit": ["et_resid"], "dd_levels": ["did"], "dd_resid": ["dd_levels"],
    "dd_cs": ["dd_resid"], "dd_fit": ["dd_resid"], "dd_se": ["dd_cs", "dd_fit"],
}


def sql(body: str, *ctes: str) -> str:
    """The statement with the named sub-queries it needs, in order of dependence."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for c in ctes:
        add(c)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


A_DOUBLES = [
    "coord_x", "coord_y", "consumo_promedio", "consumo_std", "consumo_min", "consumo_max", "consumo_total",
    "consumo_mediana", "importe_total", "tarifa_efectiva", "horas_dia_prom", "dias_semana_prom",
    "score_calidad", "consumo_verano", "consumo_invierno", "consumo_rango", "coef_variacion",
    "delta_estacional",
]
B_DOUBLES = [
    "coord_x", "coord_y", "consumo_promedio", "consumo_std", "consumo_min", "consumo_max", "consumo_total",
    "importe_total", "tarifa_efectiva", "horas_dia_prom", "score_calidad", "consumo_verano",
    "consumo_invierno", "consumo_rango", "coef_variacion", "delta_estacional", "pct_subsidiado",
    "consumo_por_udu",
]
C_DOUBLES = [
    "demanda_total_m3", "facturacion_total", "consumo_promedio", "consumo_std", "consumo_mediana",
    "consumo_p25", "consumo_p75", "consumo_p95", "score_calidad", "pct_domestico", "pct_comercial",
    "pct_industrial", "pct_subsidiado", "consumo_per_unidad", "tarifa_promedio", "coef_variacion",
    "iqr_consumo",
]


def whole(name: str, doubles, digits: int = 6) -> str:
    return sql(f"SELECT * REPLACE ({rs(doubles, digits)}) FROM {name}", name)


FEATURES_A = whole("a", A_DOUBLES)
FEATURES_B = whole("b", B_DOUBLES)
QUARTILES = {"mediana": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def quantiles(keys: str) -> str:
    picks = ", ".join(r(f"QUANTILE_CONT(imagua, {p})", n) for n, p in QUARTILES.items())
    return sql(f"SELECT {keys}, {picks} FROM consumo GROUP BY {keys}", "consumo")


MONTH_EXPR = "CAST(nuanio * 12 + nummes AS DOUBLE)"
HASH_UNIT = key_hash_sql(["codudu", "codcon"])
REG_B = ["codcon", S.TARGET, *S.REGRESSION_CATEGORICAL["B"], *S.REGRESSION_NUMERIC["B"]]
CLUSTER_B = S.CLUSTER_FEATURES["B"]

ORACLE: dict[str, str] = {
    "parquet_scan": "SELECT * FROM customer",
    "projected_scan": "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem",
    "row_count": sql("SELECT COUNT(*) AS n_rows FROM consumo", "consumo"),
    "limit_rows": sql(f"SELECT DISTINCT codudu, codcon FROM consumo ORDER BY 1, 2 LIMIT {SAMPLE}", "consumo"),
    "sample_rows": sql(
        f"""SELECT codudu, codcon FROM (SELECT DISTINCT codudu, codcon FROM consumo)
        ORDER BY {HASH_UNIT}, codudu, codcon LIMIT {SAMPLE}""", "consumo"),
    "parquet_sink": FEATURES_B,
    "sink_verify": sql(
        """SELECT i AS rows_in, o AS rows_out, round(i / CAST(o AS DOUBLE), 6) + 0.0 AS reduction FROM
        (SELECT COUNT(*) AS i FROM consumo), (SELECT COUNT(*) AS o FROM (SELECT DISTINCT codudu, codcon FROM consumo))""",
        "consumo"),
    "csv_sink": sql(f"SELECT t_rel, {rs(['control', 'treated'])} FROM pre", "pre"),
    "result_json_sink": sql(
        f"""SELECT s.serie AS nombre, n_puntos, {rs(['media', 'std', 'tendencia_inicio', 'tendencia_fin',
        'estacionalidad_amplitud'], 4)}, CAST(12 AS BIGINT) AS n_meses
        FROM sstats s JOIN trend t ON s.serie = t.serie JOIN amp p ON s.serie = p.serie""",
        "sstats", "trend", "amp"),
    "latest_result": sql(f"SELECT 'second' AS run, {r('SUM(volfac)', 'total', 2)} FROM consumo", "consumo"),
    "result_json_read": sql(
        f"""SELECT s.serie AS nombre, {rs(['media', 'std', 'min', 'max', 'tendencia_inicio', 'tendencia_fin'], 4)},
        {r('(tendencia_fin / tendencia_inicio - 1) * 100', 'tendencia_cambio_pct', 4)},
        {rs(['estacionalidad_amplitud'], 4)}, CAST(mes_max AS INT) AS mes_max, {rs(['valor_max'], 4)},
        CAST(mes_min AS INT) AS mes_min, {rs(['valor_min'], 4)}
        FROM sstats s JOIN trend t ON s.serie = t.serie JOIN amp p ON s.serie = p.serie
        JOIN extremes x ON s.serie = x.serie WHERE s.serie = '{TOTAL}'""",
        "sstats", "trend", "amp", "extremes"),
    "cast_measures": sql(
        f"""SELECT codudu, codcon, {r('volfac', 'consumo')}, {r('imagua', 'importe_agua')},
        {r('imalca', 'importe_alc')}, {r('imcafi', 'cargo_fijo')}, {r('hoxdia', 'horas_dia')},
        {r('diasem', 'dias_semana')} FROM consumo""", "consumo"),
    "season": sql(f"SELECT nummes, {SEASON} AS estacion, COUNT(*) AS n FROM consumo GROUP BY 1, 2", "consumo"),
    "month_index": sql(
        """SELECT nuanio, nummes, CAST((nuanio - 2021) * 12 + nummes AS INT) AS mes_absoluto,
        CAST(nuanio * 12 + nummes AS INT) AS mes, COUNT(*) AS n FROM consumo GROUP BY 1, 2""", "consumo"),
    "safe_ratio": sql(
        f"""SELECT codudu, {r('CASE WHEN volfac > 0 THEN imagua / volfac END', 'tarifa')},
        {r('imalca / NULLIF(imagua, 0)', 'alc_por_agua')} FROM consumo""", "consumo"),
    "service_quality": sql(f"SELECT coddis, {r(f'AVG({QUALITY})', 'score_calidad')} FROM consumo GROUP BY 1", "consumo"),
    "bill_total": sql(f"SELECT codcon, {r(f'SUM({BILL})', 'importe_total')} FROM consumo GROUP BY 1", "consumo"),
    "subsidy_flag": sql(
        """SELECT situdu, CASE WHEN situdu = '1' THEN 1 ELSE 0 END AS es_subsidiado, COUNT(*) AS n
        FROM consumo GROUP BY 1, 2""", "consumo"),
    "size_bucket": sql("SELECT codcon, num_unidades_uso, tipo_predio FROM b", "b"),
    "share_pct": sql(
        f"""SELECT coddis, COUNT(*) AS n, COUNT(*) FILTER (situdu = '1') AS n_subsidiados,
        {r("COUNT(*) FILTER (situdu = '1') * 100.0 / COUNT(*)", 'pct_subsidiado')} FROM consumo GROUP BY 1""",
        "consumo"),
    "derived_spread": sql(
        f"SELECT codcon, {r('MAX(volfac) - MIN(volfac)', 'consumo_rango')} FROM consumo GROUP BY 1", "consumo"),
    "filter_eq": sql(
        f"SELECT codudu, nuanio, nummes, {rs(['volfac'])} FROM consumo WHERE nomdis = 'NATION_7'", "consumo"),
    "filter_lt": sql(
        "SELECT event_type, t_rel, COUNT(*) AS n FROM panel WHERE t_rel < 0 GROUP BY 1, 2", "panel"),
    "drop_null_rows": sql(
        f"""SELECT codudu, codcon, {rs(['consumo_std', 'consumo_verano', 'consumo_invierno'])} FROM a
        WHERE consumo_std IS NOT NULL AND consumo_verano IS NOT NULL AND consumo_invierno IS NOT NULL""", "a"),
    "select_features": sql(
        "SELECT " + ", ".join(r(c, c) if c in B_DOUBLES else c for c in REG_B) + " FROM b", "b"),
    "features_unit": FEATURES_A,
    "features_unit_large_groups": FEATURES_A,
    "features_connection": FEATURES_B,
    "features_district_month": whole("c", C_DOUBLES),
    "moments": sql(
        f"""SELECT coddis, {r('AVG(volfac)', 'consumo_promedio')}, {r('STDDEV_SAMP(volfac)', 'consumo_std')},
        {r('MIN(volfac)', 'consumo_min')}, {r('MAX(volfac)', 'consumo_max')}, {r('SUM(volfac)', 'consumo_total')},
        COUNT(*) AS n FROM consumo GROUP BY 1""", "consumo"),
    "coef_variation": sql(
        f"""SELECT coddis, codcat, {r('AVG(volfac)', 'media')}, {r('STDDEV_SAMP(volfac)', 'std')},
        {r('CASE WHEN AVG(volfac) > 0 THEN STDDEV_SAMP(volfac) / AVG(volfac) END', 'coef_variacion')}
        FROM consumo GROUP BY 1, 2""", "consumo"),
    "exact_quantiles": quantiles("coddis, nuanio"),
    "exact_quantiles_large_groups": quantiles("coddis"),
    "nearest_quantiles": sql(
        "SELECT coddis, "
        + ", ".join(
            r(f"LIST_SORT(LIST(imagua))[CAST(FLOOR({p} * (COUNT(*) - 1) + 0.5) AS BIGINT) + 1]", n)
            for n, p in QUARTILES.items()
        )
        + " FROM consumo GROUP BY coddis", "consumo"),
    "distinct_counts": sql(
        """SELECT coddis, COUNT(DISTINCT codudu) AS n_unidades, COUNT(DISTINCT codcon) AS n_conexiones,
        COUNT(DISTINCT nuanio) AS n_anios, COUNT(DISTINCT codcat) AS n_categorias FROM consumo GROUP BY 1""",
        "consumo"),
    "representative": sql(
        """SELECT codcon, FIRST(nomdis ORDER BY nuanio, nummes, nomdis, codcat, situdu) AS nomdis,
        FIRST(codcat ORDER BY nuanio, nummes, nomdis, codcat, situdu) AS codcat,
        FIRST(situdu ORDER BY nuanio, nummes, nomdis, codcat, situdu) AS situdu FROM consumo GROUP BY 1""",
        "consumo"),
    "conditional_mean": sql(f"SELECT codcon, {rs(['consumo_verano', 'consumo_invierno'])} FROM b", "b"),
    "conditional_count": sql(
        """SELECT coddis, nuanio, COUNT(*) FILTER (codcat = '102') AS n_domestico,
        COUNT(*) FILTER (codcat = '103') AS n_comercial, COUNT(*) FILTER (codcat = '104') AS n_industrial,
        COUNT(*) FILTER (situdu = '1') AS n_subsidiados FROM consumo GROUP BY 1, 2""", "consumo"),
    "effective_tariff": sql(
        f"""SELECT coddis, {r('AVG(CASE WHEN volfac > 0 THEN imagua / volfac END)', 'media_de_razones')},
        {r(f'CASE WHEN SUM(volfac) > 0 THEN SUM({BILL}) / SUM(volfac) END', 'razon_de_sumas')}
        FROM consumo GROUP BY 1""", "consumo"),
    "size_distribution": sql("SELECT tipo_predio, COUNT(*) AS n FROM b GROUP BY 1", "b"),
    "coverage_stats": sql(
        "SELECT COUNT(DISTINCT coddis) AS n_distritos, COUNT(DISTINCT mes_absoluto) AS n_meses FROM dm", "dm"),
    "top_districts": sql(
        f"""SELECT nomdis, {r('d', 'total_demanda', 4)} FROM (SELECT nomdis, SUM(demanda_total_m3) AS d FROM dm
        GROUP BY 1 ORDER BY d DESC, nomdis LIMIT 5)""", "dm"),
    "total_series": sql(
        f"""SELECT nuanio, nummes, {r('SUM(demanda_total_m3)', 'demanda_total', 4)},
        MIN(mes_absoluto) AS mes_absoluto FROM dm GROUP BY 1, 2""", "dm"),
    "distinct_values": sql(
        "\nUNION ALL\n".join(
            f"SELECT DISTINCT '{c}' AS columna, CAST({c} AS VARCHAR) AS nivel FROM consumo"
            for c in S.PANEL_CATEGORICAL
        ), "consumo"),
    "pivot_mean": sql(
        f"""SELECT t_rel, {r('AVG(volfac) FILTER (treated = 0)', 'treated_0')},
        {r('AVG(volfac) FILTER (treated = 1)', 'treated_1')} FROM did GROUP BY 1""", "did"),
    "first_transition": sql("SELECT codcon, codudu, mes_evento, tipo FROM transitions", "transitions"),
    "never_treated": sql("SELECT * FROM never", "never"),
    "sample_controls": sql(
        """SELECT o.codcon, o.codudu, g.mes_evento FROM ordered o
        JOIN ranges g ON o.pos >= g.lo AND o.pos < g.hi
        WHERE o.rk <= (SELECT COUNT(*) FROM treated)""", "ordered", "ranges"),
    "event_panel": sql(
        f"SELECT event_type, codcon, codudu, nuanio, nummes, t_rel, {rs(['volfac'])} FROM panel", "panel"),
    "combine_panels": sql(f"SELECT codcon, codudu, t_rel, treated, post, {rs(['volfac'])} FROM did", "did"),
    "centred_moving_average": sql(f"SELECT serie, nuanio, nummes, {rs(['tendencia'], 4)} FROM smooth", "smooth"),
    "seasonal_component": sql(
        f"SELECT serie, nuanio, nummes, CAST(t AS INT) AS t, {rs(['estacional'], 4)} FROM dec", "dec"),
    "first_last_trend": sql(
        f"SELECT serie, {rs(['tendencia_inicio', 'tendencia_fin'], 4)} FROM trend", "trend"),
    "series_stats": sql(
        f"SELECT serie, n_puntos, {rs(['media', 'std', 'min', 'max'], 4)} FROM sstats", "sstats"),
    "dickey_fuller": sql(
        f"""SELECT serie, n, {r('b / SQRT((syy - b * sxy) / (n - 2) / sxx)', 'df_statistic')} FROM (
        SELECT serie, COUNT(*) AS n, REGR_SLOPE(y, x) AS b, REGR_SXX(y, x) AS sxx, REGR_SYY(y, x) AS syy,
               REGR_SXY(y, x) AS sxy FROM (
          SELECT serie, valor - LAG(valor) OVER w AS y, LAG(valor) OVER w AS x FROM series
          WINDOW w AS (PARTITION BY serie ORDER BY nuanio, nummes)) WHERE x IS NOT NULL GROUP BY serie)""",
        "series"),
    "seasonal_decompose": sql(
        f"SELECT serie, nuanio, nummes, {rs(['tendencia', 'estacional', 'residuo'], 4)} FROM dec", "dec"),
    "trend_change": sql(
        f"""SELECT serie, {rs(['tendencia_inicio', 'tendencia_fin'], 4)},
        {r('(tendencia_fin / tendencia_inicio - 1) * 100', 'tendencia_cambio_pct', 4)} FROM trend""", "trend"),
    "seasonal_amplitude": sql(
        f"SELECT serie, {rs(['estacionalidad_max', 'estacionalidad_min', 'estacionalidad_amplitud'], 4)} FROM amp",
        "amp"),
    "monthly_pattern": sql(
        f"SELECT serie, CAST(posicion AS INT) AS posicion, mes, {rs(['patron'], 4)} FROM pattern", "pattern"),
    "complete_months": sql(
        f"""SELECT g.serie, CAST(g.m // 12 AS INT) AS nuanio, CAST(g.m % 12 + 1 AS INT) AS nummes,
        {r('COALESCE(s.valor, 0)', 'valor', 4)} FROM (
          SELECT serie, UNNEST(RANGE(MIN(nuanio * 12 + nummes - 1), MAX(nuanio * 12 + nummes - 1) + 1)) AS m
          FROM series GROUP BY serie) g
        LEFT JOIN series s ON s.serie = g.serie AND s.nuanio * 12 + s.nummes - 1 = g.m
        WHERE g.serie <> '{TOTAL}'""", "series"),
    "series_select": sql(
        f"""SELECT serie, nuanio, nummes, {rs(['valor'], 4)} FROM series WHERE serie IN (
        SELECT serie FROM (SELECT serie, COUNT(*) AS n, SUM(valor) AS d FROM series WHERE serie <> '{TOTAL}'
        GROUP BY 1 ORDER BY d DESC, serie LIMIT 5) WHERE n >= 12)""", "series"),
    "peak_trough_month": sql(
        f"""SELECT serie, CAST(mes_max AS INT) AS mes_max, {rs(['valor_max'], 4)},
        CAST(mes_min AS INT) AS mes_min, {rs(['valor_min'], 4)} FROM extremes""", "extremes"),
    "seasonal_summary": sql(
        f"""SELECT s.serie, n_puntos, {rs(['media', 'std', 'min', 'max', 'tendencia_inicio', 'tendencia_fin'], 4)},
        {r('(tendencia_fin / tendencia_inicio - 1) * 100', 'tendencia_cambio_pct', 4)},
        {rs(['estacionalidad_max', 'estacionalidad_min', 'estacionalidad_amplitud'], 4)},
        CAST(mes_max AS INT) AS mes_max, {rs(['valor_max'], 4)}, CAST(mes_min AS INT) AS mes_min,
        {rs(['valor_min'], 4)}
        FROM sstats s LEFT JOIN trend t ON s.serie = t.serie LEFT JOIN amp p ON s.serie = p.serie
        LEFT JOIN extremes x ON s.serie = x.serie""", "sstats", "trend", "amp", "extremes"),
    "sort_multi": sql(
        f"SELECT coddis, nomdis, nuanio, nummes, {rs(['demanda_total_m3'])}, mes_absoluto FROM dm", "dm"),
    "contamination_cut": sql(
        f"SELECT codudu, codcon, {rs(['consumo_promedio', 'anomaly_score'])}, es_anomalia FROM flagged", "flagged"),
    "contamination_cut_large_group": sql(f"SELECT {r('QUANTILE_CONT(imagua, 0.99)', 'cut')} FROM consumo", "consumo"),
    "top_anomalies": sql(
        f"""SELECT codudu, codcon, {rs(['consumo_promedio', 'anomaly_score'])} FROM (SELECT * FROM flagged
        WHERE es_anomalia ORDER BY anomaly_score DESC, codudu, codcon LIMIT 10)""", "flagged"),
    "anomaly_comparison": sql(
        f"""SELECT feature, {rs(['normal', 'anomalia'])}, n_total, n_anomalias,
        {r('CASE WHEN normal = 0 THEN 0 ELSE anomalia / normal END', 'ratio')},
        {r('n_anomalias * 100.0 / n_total', 'pct_anomalias')} FROM comparison""", "comparison"),
    "argmax_k": sql(
        f"""SELECT anios_activos AS best_k, {r('m', 'score')} FROM (SELECT anios_activos, AVG(score_calidad) AS m
        FROM b GROUP BY 1 ORDER BY m DESC, 1 LIMIT 1)""", "b"),
    "label_encode": sql(
        """SELECT codcon, DENSE_RANK() OVER (ORDER BY distrito) - 1 AS distrito_idx,
        DENSE_RANK() OVER (ORDER BY tipo_predio) - 1 AS tipo_predio_idx FROM b""", "b"),
    "categorical_features": sql(
        """SELECT COUNT(*) AS n, 'nomdis_idx' AS feature, CAST(COUNT(DISTINCT nomdis) AS INT) AS n_levels FROM c
        UNION ALL SELECT COUNT(*), 'estacion_idx', CAST(COUNT(DISTINCT estacion) AS INT) FROM c""", "c"),
    "train_test_split": sql(
        f"""SELECT codudu, codcon, CASE WHEN {HASH_UNIT} < {int(0.2 * MODULUS)} THEN 'test' ELSE 'train' END AS part
        FROM (SELECT DISTINCT codudu, codcon FROM consumo)""", "consumo"),
    "regression_metrics": sql(
        f"""SELECT COUNT(*) AS n, {r('SQRT(AVG(e * e))', 'rmse')}, {r('AVG(ABS(e))', 'mae')},
        {r('1 - AVG(e * e) / VAR_POP(y)', 'r2')} FROM (
        SELECT consumo_promedio AS y, consumo_promedio - consumo_mediana AS e FROM a)""", "a"),
    "standardise": sql("SELECT codcon, " + rs([f"z_{f}" for f in CLUSTER_B]) + " FROM bz", "bz"),
    "standardise_incremental": sql(
        "\nUNION ALL\n".join(
            f"SELECT '{f}' AS feature, COUNT(*) AS n, {r(f'AVG({f})', 'mean')}, {r(f'STDDEV_POP({f})', 'std')} FROM bz"
            for f in CLUSTER_B
        ), "bz"),
    "minibatch_kmeans_one_batch": sql(
        "\nUNION ALL\n".join(
            f"""SELECT cluster, CAST(COUNT(*) AS DOUBLE) AS weight, CAST({i} AS INT) AS dim, {r(f'AVG(z_{f})', 'centre')}
            FROM labelled GROUP BY cluster"""
            for i, f in enumerate(CLUSTER_B)
        ), "labelled"),
    "minibatch_kmeans_two_batches": sql(
        "\nUNION ALL\n".join(
            f"SELECT CAST(cluster AS INT) AS cluster, CAST(w AS DOUBLE) AS weight, CAST({i} AS INT) AS dim, {r(z, 'centre')} FROM steps2"
            for i, z in enumerate(Z_B)
        ), "steps2"),
    "silhouette_by_k": sql(
        "\nUNION ALL\n".join(f"SELECT CAST(k AS INT) AS k, {r('s', 'silhouette')} FROM sil{k}" for k in FIXED),
        *[f"sil{k}" for k in FIXED]),
    "assign_clusters": sql("SELECT codcon, cluster FROM labelled", "labelled"),
    "cluster_profiles": sql(
        f"""SELECT cluster, COUNT(*) AS n, {r('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM labelled)', 'pct')},
        {', '.join(r(f'AVG({f})', f) for f in CLUSTER_B)} FROM labelled GROUP BY cluster""", "labelled"),
    "silhouette": sql(
        f"""SELECT {r('AVG(CASE WHEN a_sq IS NULL THEN 0 ELSE (b_sq - a_sq) / GREATEST(a_sq, b_sq) END)', 'silhouette_sq')},
        COUNT(*) AS n FROM widths""", "widths"),
    "pretrend_means": sql(
        f"SELECT t_rel, treated, {r('AVG(volfac)', 'volfac_mean')} FROM did WHERE t_rel < 0 GROUP BY 1, 2", "did"),
    "pretrend_gap": sql(
        f"""SELECT {r('AVG(treated - control)', 'gap_mean')}, {r('STDDEV_SAMP(treated - control)', 'gap_std')},
        COUNT(treated - control) AS n_periods FROM pre""", "pre"),
    "event_times": sql(
        "SELECT DISTINCT event_type, -1 AS baseline, t_rel FROM panel WHERE t_rel <> -1", "panel"),
    "dummy_encode": sql(
        "SELECT codcat, codmof, "
        + ", ".join(r(f"COUNT(*) * CAST(codcat = '{v}' AS INT)", f"codcat__{v}") for v in (102, 103, 104, 105))
        + ", "
        + ", ".join(r(f"COUNT(*) * CAST(codmof = '{v}' AS INT)", f"codmof__{v}") for v in ("N", "R"))
        + " FROM consumo GROUP BY 1, 2", "consumo"),
    "design_matrix": sql(
        f"""SELECT codcon, codudu, 1.0 + 0.0 AS intercept, {r(MONTH_EXPR, 'mes_abs')}, {rs(['hoxdia'])},
        CAST(codcat = '102' AS DOUBLE) AS codcat__102, CAST(codcat = '103' AS DOUBLE) AS codcat__103
        FROM consumo""".replace("1.0 + 0.0", "CAST(1 AS DOUBLE)"), "consumo"),
    "product_matrix": sql(
        "\nUNION ALL\n".join(
            f"SELECT CAST({i} AS INT) AS i, CAST({j} AS INT) AS j, {r(f'SUM({x} * {y})', 'value', 2)} FROM consumo"
            for i, x in enumerate(("1.0E0", "hoxdia", "diasem", "volfac"))
            for j, y in enumerate(("1.0E0", "hoxdia", "diasem", "volfac"))
            if i <= j
        ), "consumo"),
    "ols_normal_equations": sql(
        f"""SELECT term, {rs(['coef'])}, n_obs, CAST((SELECT COUNT(*) FROM levels) AS INT) AS rank FROM sat""", "sat"),
    "ols_fit_stats": sql(
        f"""SELECT n, {rs(['sse', 'sst'], 4)}, {r('1 - sse / sst', 'r2', 4)} FROM (SELECT COUNT(*) AS n,
        SUM(r.e * r.e) AS sse, (SELECT VAR_POP(volfac) * COUNT(*) FROM consumo) AS sst FROM resid r)""", "resid"),
    "cluster_scores": sql(
        f"""SELECT codcon, codudu, {r('SUM(e)', 's0', 4)}, """
        + ", ".join(
            r(f"COALESCE(SUM(e) FILTER (codcat = '{v}'), 0)", f"s{i}", 4) for i, v in enumerate((102, 103, 104, 105), 1)
        )
        + f", {r('SUM(e * e)', 'sse', 4)} FROM resid GROUP BY 1, 2", "resid"),
    "cluster_robust_se": sql(
        f"SELECT term, {rs(['coef', 'std_error'])}, {r('coef / std_error', 't_stat')}, n_clusters FROM sat", "sat"),
    "coef_interval": sql(
        f"""SELECT term, {r('coef - 1.96 * std_error', 'ci_low')}, {r('coef + 1.96 * std_error', 'ci_high')}
        FROM sat""", "sat"),
    "event_study": sql(
        f"""SELECT l.event_type, -1 AS baseline,
        CASE WHEN l.t_rel = -1 THEN 'intercept' ELSE 't_rel__' || l.t_rel END AS term,
        {r('CASE WHEN l.t_rel = -1 THEN l.m ELSE l.m - b.m END', 'coef')},
        {r('''SQRT(f.g / (f.g - 1.0) * (f.n - 1.0) / (f.n - f.k) * CASE WHEN l.t_rel = -1 THEN v00.v
           ELSE vll.v + v00.v - 2 * COALESCE(v0l.v, 0) END)''', 'std_error')},
        f.n AS n_obs, f.g AS n_clusters, {r('f.r2', 'r2')}
        FROM et_levels l JOIN et_levels b ON b.event_type = l.event_type AND b.t_rel = -1
        JOIN et_fit f ON f.event_type = l.event_type
        JOIN et_v v00 ON v00.event_type = l.event_type AND v00.i = -1 AND v00.j = -1
        JOIN et_v vll ON vll.event_type = l.event_type AND vll.i = l.t_rel AND vll.j = l.t_rel
        LEFT JOIN et_v v0l ON v0l.event_type = l.event_type AND v0l.i = -1 AND v0l.j = l.t_rel""",
        "et_v", "et_fit"),
    "did_basic": sql(
        f"""SELECT {rs(['treated_post', 'treated_pre', 'control_post', 'control_pre', 'effect'])} FROM basic""",
        "basic"),
    "did_ols_saturated": sql(
        f"""SELECT term, {rs(['coef', 'std_error'])}, n AS n_obs, g AS n_clusters, {rs(['r2'])} FROM (
        SELECT 'intercept' AS term, control_pre AS coef, s0 AS std_error, n, g, r2 FROM basic, dd_se, dd_fit
        UNION ALL SELECT 'treated', treated_pre - control_pre, s1, n, g, r2 FROM basic, dd_se, dd_fit
        UNION ALL SELECT 'post', control_post - control_pre, s2, n, g, r2 FROM basic, dd_se, dd_fit
        UNION ALL SELECT 'treated_post', effect, s3, n, g, r2 FROM basic, dd_se, dd_fit)""",
        "basic", "dd_se", "dd_fit"),
    "excess_loss": sql(
        f"""SELECT feature, {r('n_anomalias * (anomalia - normal)', 'exceso_mensual_m3', 4)},
        {r('n_anomalias * (anomalia - normal) * 5.0', 'perdida_mensual', 4)},
        {r('n_anomalias * (anomalia - normal) * 60.0', 'perdida_anual', 4)}
        FROM comparison WHERE feature = 'consumo_promedio'""", "comparison"),
    "policy_impact": sql(
        f"""SELECT k AS n_units, {r('effect', 'effect', 4)}, {r('k * effect', 'volumen_mensual_m3', 4)},
        {r('k * effect * 5.0', 'facturacion_mensual', 4)}, {r('k * effect * 60.0', 'facturacion_anual', 4)}
        FROM basic, (SELECT COUNT(*) AS k FROM treated)""", "basic"),
    "deviation_alerts": sql(
        f"""SELECT coddis, nuanio, nummes, {rs(['demanda_total_m3', 'esperado', 'desviacion'])} FROM (
        SELECT d.*, e.esperado, ABS(d.demanda_total_m3 - e.esperado) / ABS(e.esperado) AS desviacion FROM dm d
        JOIN (SELECT coddis, nummes, AVG(demanda_total_m3) AS esperado FROM dm GROUP BY 1, 2) e
        ON d.coddis = e.coddis AND d.nummes = e.nummes) WHERE desviacion > 0.1""", "dm"),
}

HASH_C = key_hash_sql(["coddis", "nuanio", "nummes"])
STUMP_ROWS = f"""rows AS (SELECT coddis, nuanio, nummes, consumo_promedio, nomdis, CAST(DENSE_RANK() OVER (ORDER BY nomdis) - 1 AS DOUBLE) AS code,
  CAST(mes_absoluto AS DOUBLE) AS mes, {HASH_C} AS h FROM c WHERE consumo_promedio IS NOT NULL AND nomdis IS NOT NULL)"""


def stump(name: str, train: str, first: str = "code") -> str:
    """CTEs of the best split of the rows ``train`` by either feature, in ``{name}best``; ``first`` is the first feature's value."""
    return f"""
{name}t AS (SELECT {first} AS f0, mes AS f1, consumo_promedio AS y FROM rows {train}),
{name}v AS (SELECT 0 AS f, f0 AS x, COUNT(*) AS n, SUM(y) AS s FROM {name}t GROUP BY f0
            UNION ALL SELECT 1, f1, COUNT(*), SUM(y) FROM {name}t GROUP BY f1),
{name}u AS (SELECT f, x, LEAD(x) OVER w AS nx, SUM(n) OVER w AS ln, SUM(s) OVER w AS ls, SUM(n) OVER (PARTITION BY f) AS tn,
            SUM(s) OVER (PARTITION BY f) AS ts FROM {name}v WINDOW w AS (PARTITION BY f ORDER BY x)),
{name}best AS (SELECT f, (x + nx) / 2 AS cut, ls / ln AS lo, (ts - ls) / (tn - ln) AS hi FROM {name}u WHERE nx IS NOT NULL
               ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC, f LIMIT 1)"""


def split_of(name: str, first: str = "code") -> str:
    return f"CASE WHEN CASE {name}best.f WHEN 0 THEN {first} ELSE mes END <= {name}best.cut THEN {name}best.lo ELSE {name}best.hi END"


def path_of(size: int, depth: int) -> float:
    return depth + (0.0 if size <= 1 else 1.0 if size == 2 else 2.0 * (math.log(size - 1.0) + 0.5772156649015329) - 2.0 * (size - 1.0) / size)


IN_TRAIN, IN_TEST = f"WHERE h >= {int(0.2 * MODULUS)}", f"WHERE h < {int(0.2 * MODULUS)}"
STUMP = sql("", "c").rstrip() + ", " + STUMP_ROWS + ", " + stump("", IN_TRAIN)
# the two best clusters on a line are the cut with the least squares within
LINE = """, line AS (SELECT codcon, num_unidades_uso AS v, (num_unidades_uso - AVG(num_unidades_uso) OVER ()) / STDDEV_POP(num_unidades_uso) OVER () AS z FROM b),
upto AS (SELECT z, LEAD(z) OVER (ORDER BY z) AS nz, SUM(n) OVER (ORDER BY z) AS ln, SUM(s) OVER (ORDER BY z) AS ls, SUM(n) OVER () AS tn, SUM(s) OVER () AS ts
  FROM (SELECT z, COUNT(*) AS n, SUM(z) AS s FROM line GROUP BY z)),
cut AS (SELECT z AS cut FROM upto WHERE nz IS NOT NULL ORDER BY ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) DESC LIMIT 1),
halves AS (SELECT codcon, v, z, z <= cut AS low FROM line, cut),
sums AS (SELECT low, COUNT(*) AS n, SUM(z) AS s, SUM(z * z) AS q FROM halves GROUP BY low)"""
ORACLE |= {
    "adf_fixed_lag": sql(
        f"""SELECT serie, n, {r('(sxy * szz - szy * sxz) / det / SQRT((syy - (sxy * szz - szy * sxz) / det * sxy - (szy * sxx - sxy * sxz) / det * szy) / (n - 3) * szz / det)', 'adf_statistic')}
        FROM (SELECT *, sxx * szz - sxz * sxz AS det FROM (
          SELECT serie, COUNT(*) AS n, COVAR_POP(x, x) * COUNT(*) AS sxx, COVAR_POP(z, z) * COUNT(*) AS szz, COVAR_POP(y, y) * COUNT(*) AS syy,
                 COVAR_POP(x, z) * COUNT(*) AS sxz, COVAR_POP(x, y) * COUNT(*) AS sxy, COVAR_POP(z, y) * COUNT(*) AS szy FROM (
            SELECT serie, valor - LAG(valor) OVER w AS y, LAG(valor) OVER w AS x, LAG(valor) OVER w - LAG(valor, 2) OVER w AS z FROM series
            WINDOW w AS (PARTITION BY serie ORDER BY nuanio, nummes)) WHERE z IS NOT NULL GROUP BY serie))""", "series"),
    "isolation_forest_fixed": sql(
        f"""SELECT codudu, codcon, {r(f'POWER(2.0, -(p0 + p1) / 2.0 / {path_of(64, 0)!r})', 'score')} FROM (
        SELECT codudu, codcon, CASE WHEN consumo_promedio <= 20 THEN {path_of(24, 1)!r} WHEN tarifa_efectiva <= 40 THEN {path_of(39, 2)!r} ELSE {path_of(1, 2)!r} END AS p0,
               CASE WHEN coef_variacion <= 0.5 THEN {path_of(50, 1)!r} ELSE {path_of(14, 1)!r} END AS p1 FROM a
        WHERE {' AND '.join(f'{f} IS NOT NULL' for f in S.ANOMALY_FEATURES['A'])})""", "a"),
    "isolation_forest_shape": sql(
        f"""SELECT CAST(100 AS BIGINT) AS n_trees, LEAST(256, n) AS root_min, LEAST(256, n) AS root_max, CAST(8 AS INT) AS depth,
        CAST(100 * LEAST(256, n) AS BIGINT) AS leaf_rows, CAST(0 AS BIGINT) AS wrong_parents
        FROM (SELECT COUNT(*) AS n FROM a WHERE {' AND '.join(f'{f} IS NOT NULL' for f in S.ANOMALY_FEATURES['A'])})""", "a"),
    "kmeans_1d": sql("", "b").rstrip() + LINE + f"""
SELECT COUNT(*) AS n, {r('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM halves)', 'pct')}, {r('AVG(v)', 'num_unidades_uso')} FROM halves GROUP BY low""",
    "best_k_search_1d": sql("", "b").rstrip() + LINE + f"""
SELECT CAST(2 AS INT) AS k, {r('AVG(CASE WHEN own.n = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END)', 'silhouette')}, COUNT(*) AS n FROM (
  SELECT own.n, (own.n * z * z - 2 * z * own.s + own.q) / NULLIF(own.n - 1, 0) AS a, (other.n * z * z - 2 * z * other.s + other.q) / other.n AS b
  FROM halves JOIN sums AS own ON own.low = halves.low JOIN sums AS other ON other.low <> halves.low) AS own""",
    "boosted_stump": STUMP + f"\nSELECT coddis, nuanio, nummes, {r('consumo_promedio', 'consumo_promedio')}, {r(split_of(''), 'prediction')} FROM rows, best {IN_TEST}",
    "boosted_stump_categories": sql("", "c").rstrip() + ", " + STUMP_ROWS
    + f", places AS (SELECT nomdis, CAST(ROW_NUMBER() OVER (ORDER BY AVG(consumo_promedio), nomdis) AS DOUBLE) AS place FROM rows {IN_TRAIN} GROUP BY nomdis), "
    + stump("", "JOIN places USING (nomdis) " + IN_TRAIN, "place")
    + f"\nSELECT coddis, nuanio, nummes, {r('consumo_promedio', 'consumo_promedio')}, {r(split_of('', 'place'), 'prediction')} FROM rows JOIN places USING (nomdis), best {IN_TEST}",
    "boosted_stump_importance": STUMP + """
SELECT feature, CASE WHEN f = i THEN 1.0 ELSE 0.0 END + 0.0 AS importance, CAST(CASE WHEN f = i THEN 1 ELSE 0 END AS BIGINT) AS splits
FROM best, (VALUES (0, 'nomdis'), (1, 'mes_absoluto')) AS names(i, feature)""",
    "boosted_stump_metrics": STUMP + f"""
SELECT COUNT(*) AS n, {r('SQRT(AVG(e * e))', 'rmse')}, {r('AVG(ABS(e))', 'mae')}, {r('1 - AVG(e * e) / VAR_POP(y)', 'r2')}
FROM (SELECT consumo_promedio AS y, consumo_promedio - {split_of('')} AS e FROM rows, best {IN_TEST})""",
    "out_of_fold_stump": sql("", "c").rstrip() + ", " + STUMP_ROWS + ", " + stump("even_", "WHERE h % 2 <> 0") + ", " + stump("odd_", "WHERE h % 2 <> 1") + f"""
SELECT coddis, nuanio, nummes, {r('y', 'consumo_promedio')}, fold, {r('p', 'prediction')}, {r('ABS(y - p) / ABS(p)', 'desviacion')} FROM (
  SELECT coddis, nuanio, nummes, consumo_promedio AS y, CAST(h % 2 AS INT) AS fold, CASE h % 2 WHEN 0 THEN {split_of('even_')} ELSE {split_of('odd_')} END AS p
  FROM rows, even_best, odd_best) WHERE ABS(y - p) / ABS(p) > 0.1""",
}

ORACLE["did_result_document"] = sql(
    f"""SELECT 'DiD OLS covariables + cluster SE' AS modelo, n AS n_obs, g AS n_clusters, {rs(['r2'])}, CAST(0 AS INT) AS n_categoricas, CAST(0 AS INT) AS n_numericas,
    coef_names, {rs(['coef', 'std_error'])}, {r('coef / std_error', 't_stat')} FROM (
    SELECT 'intercept' AS coef_names, control_pre AS coef, s0 AS std_error, n, g, r2 FROM basic, dd_se, dd_fit
    UNION ALL SELECT 'treated', treated_pre - control_pre, s1, n, g, r2 FROM basic, dd_se, dd_fit
    UNION ALL SELECT 'post', control_post - control_pre, s2, n, g, r2 FROM basic, dd_se, dd_fit
    UNION ALL SELECT 'treated_post', effect, s3, n, g, r2 FROM basic, dd_se, dd_fit)""", "basic", "dd_se", "dd_fit")
FEW = "SELECT * FROM treated WHERE mes_evento BETWEEN 1998 * 12 + 1 AND 1998 * 12 + 12"
ORACLE |= {
    "sample_rows_text_keys": f"""SELECT key FROM (SELECT 'k' || o_orderkey AS key FROM orders)
        ORDER BY {key_hash_sql(['key'])}, key LIMIT 200""",
    "quantiles_null_groups": f"""SELECT l_suppkey, {r('QUANTILE_CONT(v, 0.25)', 'q25')}, {r('QUANTILE_CONT(v, 0.5)', 'q50')},
        {r('QUANTILE_CONT(v, 0.75)', 'q75')} FROM (SELECT l_suppkey,
        CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS v FROM lineitem) GROUP BY l_suppkey""",
    "sample_controls_ratio2": sql(
        f"""SELECT o.codcon, o.codudu, g.mes_evento FROM (
            SELECT codcon, codudu, ROW_NUMBER() OVER (ORDER BY {key_hash_sql(['codcon', 'codudu'])}, codcon, codudu) AS rk,
                   {key_hash_sql(['codcon', 'codudu'], 43)} % (SELECT COUNT(*) FROM ({FEW})) AS pos FROM never) o
        JOIN (SELECT mes_evento, SUM(k) OVER (ORDER BY mes_evento) - k AS lo, SUM(k) OVER (ORDER BY mes_evento) AS hi
              FROM (SELECT mes_evento, COUNT(*) AS k FROM ({FEW}) GROUP BY 1)) g ON o.pos >= g.lo AND o.pos < g.hi
        WHERE o.rk <= 2 * (SELECT COUNT(*) FROM ({FEW}))""", "treated", "never"),
    "did_basic_t": sql(
        f"SELECT {r('effect', 'effect')}, {r('s3', 'std_error')}, {r('effect / s3', 't_stat')}, n AS n_obs, g AS n_clusters FROM basic, dd_se, dd_fit",
        "basic", "dd_se", "dd_fit"),
    # Frisch and Waugh: outcome and number less their category means
    "ols_covariate_fwl": sql(
        f""", centred AS (SELECT codcon, codudu, volfac - AVG(volfac) OVER (PARTITION BY codcat) AS y,
            imagua - AVG(imagua) OVER (PARTITION BY codcat) AS x FROM consumo),
        slope AS (SELECT SUM(x * y) / SUM(x * x) AS b, SUM(x * x) AS sxx FROM centred)
        SELECT 'imagua' AS term, {r('b', 'coef')},
               {r('SQRT(1.0 * g / (g - 1) * (n - 1) / (n - 1 - cats) * meat) / sxx', 'std_error')}, n AS n_obs, g AS n_clusters
        FROM (SELECT SUM(s * s) AS meat, COUNT(*) AS g FROM (
                SELECT codcon, codudu, SUM(x * (y - b * x)) AS s FROM centred, slope GROUP BY 1, 2)) AS scores,
             slope, (SELECT COUNT(*) AS n, COUNT(DISTINCT codcat) AS cats FROM consumo) AS counts""", "consumo"),
}
