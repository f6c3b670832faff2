"""The same results in DuckDB SQL, over whole tables."""

from __future__ import annotations

from catalog.views import MEASUREMENT_SQL

_FEATURES = ["nadph_a2p", "nadph_t1", "nadph_t2", "fad_a1p", "photons"]
_STEPS = ["Ctrl", "T15", "T30", "T45", "T60"]
_CELLS = "treatment, fov, compartment, cell"


def _m(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([f"m AS ({MEASUREMENT_SQL})", *ctes]) + " " + body


def _aggs(f: str) -> list[str]:
    return [
        f"count({f}) AS {f}__count", f"round(min({f}), 6) AS {f}__min", f"round(max({f}), 6) AS {f}__max",
        f"round(avg({f}), 6) AS {f}__mean", f"round(stddev_samp({f}), 6) AS {f}__std",
        f"round(stddev_samp({f}) / sqrt(count({f})), 6) AS {f}__sem",
        f"round(quantile_cont({f}, 0.5), 6) AS {f}__median",
        f'round(quantile_cont({f}, 0.25), 6) AS "{f}__25 percentile"',
        f'round(quantile_cont({f}, 0.75), 6) AS "{f}__75 percentile"',
        f"round(coalesce(sum({f}), 0), 6) AS {f}__sum",
    ]


def _summary(group: str, feats: list[str]) -> str:
    cols = ", ".join(a for f in feats for a in _aggs(f))
    return f"SELECT {group}, {cols} FROM m GROUP BY {group}" if group else f"SELECT {cols} FROM m"


_ALL = (
    "row_key, line_no, fov, compartment, cell, treatment, "
    + ", ".join(
        f"round({c}, 6) AS {c}" for c in (
            "nadph_a1p", "nadph_a2p", "nadph_t1", "nadph_t2", "fad_a1p", "fad_a2p", "fad_t1", "fad_t2", "photons")
    )
)
_KEPT = (
    "photons BETWEEN 5 AND 40 AND nadph_t2 BETWEEN 2500 AND 6000 AND fad_a1p BETWEEN 10 AND 70"
)

_TWO = (
    "l AS (SELECT row_key, fov, CASE WHEN treatment <> 'T60' THEN treatment END AS treatment, cell, photons AS value "
    "FROM m WHERE treatment <> 'T15')",
    "r AS (SELECT fov, CASE WHEN treatment <> 'T60' THEN treatment END AS treatment, avg(nadph_t1) AS value "
    "FROM m WHERE treatment <> 'T30' GROUP BY 1, 2)",
)


def _merge(how: str) -> str:
    return _m(
        "SELECT coalesce(l.fov, r.fov) AS fov, coalesce(l.treatment, r.treatment) AS treatment, l.cell, l.row_key, "
        "round(l.value, 6) AS value_x, round(r.value, 6) AS value_y "
        f"FROM l {how} JOIN r ON l.fov IS NOT DISTINCT FROM r.fov AND l.treatment IS NOT DISTINCT FROM r.treatment",
        *_TWO,
    )


def _relative(keys: list[str], feats: list[str], agg: str) -> str:
    refs = ", ".join(f"{agg.format(x=f)} AS ref_{f}" for f in feats)
    on = " AND ".join(f"m.{k} = r.{k}" for k in keys)
    rel = ", ".join(
        f'round(CASE WHEN r.ref_{f} <> 0 THEN m.{f} / r.ref_{f} END, 6) AS "rel {f}"' for f in feats)
    return _m(
        f"SELECT m.fov, m.compartment, m.cell, m.treatment, {rel} FROM m LEFT JOIN r ON {on}",
        f"r AS (SELECT {', '.join(keys)}, {refs} FROM m WHERE treatment = 'Ctrl' GROUP BY {', '.join(keys)})",
    )


def _bin(x: str, edges: list[tuple[float, float, str]], default: str) -> str:
    whens = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{label}'" for lo, hi, label in edges)
    return f"CASE {whens} ELSE {default} END"


def _change() -> tuple[str, ...]:
    med = ", ".join(f"max(CASE WHEN treatment = '{s}' THEN v END) AS \"{s}\"" for s in _STEPS)
    rel = ", ".join(f'("{s}" - "Ctrl") / "Ctrl" * 100 AS "{s} rel %"' for s in _STEPS[1:])
    names = ", ".join(f'"{s} rel %"' for s in _STEPS[1:])
    bins = [(-100, 0, "down"), (0, 2, "same"), (2, 100, "up")]
    cats = ", ".join(
        f"{_bin(chr(34) + c + chr(34), bins, 'NULL')} AS \"Cat {c}\""
        for c in [*(f"{s} rel %" for s in _STEPS[1:]), "min rel %", "max rel %"])
    whole = " AND ".join(f'"{s}" IS NOT NULL' for s in _STEPS)
    return (
        "md AS (SELECT fov, cell, treatment, quantile_cont(nadph_t2, 0.5) AS v FROM m WHERE compartment = 'F' "
        "GROUP BY ALL)",
        f"w AS (SELECT fov, cell, {med} FROM md GROUP BY fov, cell)",
        f"rl AS (SELECT *, {rel} FROM w WHERE {whole})",
        f'mm AS (SELECT *, least({names}) AS "min rel %", greatest({names}) AS "max rel %" FROM rl)',
        f"ct AS (SELECT *, {cats} FROM mm)",
    )


_CHANGE_COLS = ", ".join(
    ["fov", "cell"]
    + [f'round("{c}", 6) AS "{c}"' for c in [
        *_STEPS, *(f"{s} rel %" for s in _STEPS[1:]), "min rel %", "max rel %"]]
    + [f'"Cat {c}"' for c in [*(f"{s} rel %" for s in _STEPS[1:]), "min rel %", "max rel %"]]
    + ['"Cat max rel %" AS "Category"']
)


def _series_wide() -> str:
    v = [f"v{i}" for i in range(5)]
    d = [f"(v{i + 1} - v{i})" for i in range(4)]
    run, cum = "0", []
    for x in d:
        run = f"({run} + coalesce({x}, 0))"
        cum.append(f"CASE WHEN {x} IS NOT NULL THEN {run} END")
    total = f"({cum[-1]})"
    cols = ["fov", "compartment", "cell"]

    def out(expr: str, name: str) -> None:
        cols.append(f'round({expr}, 6) + 0.0 AS "photons__{name}"')

    lo, hi = f"least({', '.join(v)})", f"greatest({', '.join(v)})"
    out(lo, "Series min"); out(hi, "Series max"); out(f"{hi} - {lo}", "Series max-min")
    out(f"list_avg([{', '.join(v)}])", "Series mean"); out(f"list_median([{', '.join(v)}])", "Series median")
    for i, x in enumerate(d):
        out(x, f"delta {_STEPS[i]}:{_STEPS[i + 1]}")
        out(cum[i], f"cumulative delta {_STEPS[0]}:{_STEPS[i + 1]}")
        out(f"CASE WHEN {total} <> 0 THEN {x} / {total} END", f"normalized delta {_STEPS[i]}:{_STEPS[i + 1]}")
    out(f"least({', '.join(d)})", "delta min"); out(f"greatest({', '.join(d)})", "delta max")
    out(" + ".join(f"coalesce({x}, 0)" for x in d), "delta sum")
    pivot = ", ".join(f"avg(CASE WHEN treatment = '{s}' THEN photons END) AS v{i}" for i, s in enumerate(_STEPS))
    return _m(
        f"SELECT {', '.join(cols)} FROM w WHERE " + " OR ".join(f"{x} IS NOT NULL" for x in v),
        f"w AS (SELECT fov, compartment, cell, {pivot} FROM m GROUP BY fov, compartment, cell)",
    )


def _series_long(source: str, keys: str, step: str, at: str, value: str, digits: int) -> str:
    return (
        f"pt AS (SELECT {keys}, {step} AS step, {at} AS pos, avg({value}) AS v FROM {source} "
        f"WHERE {at} IS NOT NULL GROUP BY ALL), "
        f"dl AS (SELECT *, v - lag(v) OVER (PARTITION BY {keys} ORDER BY pos) AS d FROM pt), "
        f"cm AS (SELECT *, sum(coalesce(d, 0)) OVER (PARTITION BY {keys} ORDER BY pos) AS c, "
        f"sum(coalesce(d, 0)) OVER (PARTITION BY {keys}) AS t FROM dl) "
        f"SELECT {keys}, step AS {step.split('.')[-1]}, round(v, {digits}) + 0.0 AS {value}, "
        f"round(d, {digits}) + 0.0 AS delta, "
        f'round(CASE WHEN d IS NOT NULL THEN c END, {digits}) + 0.0 AS "cumulative delta", '
        f'round(CASE WHEN t <> 0 THEN d / t END, {digits}) + 0.0 AS "normalized delta" FROM cm'
    )


_STEP_AT = "CASE treatment " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_STEPS)) + " END"


def _hist(x: str, group: str | None, groups: list[str], lo: str, hi: str, n: int,
          stacked: bool = False, cumulative: bool = False, density: bool = False) -> str:
    """Shares per bin; ``group`` None for one group called all."""
    g = group or "'all'"
    total = "(SELECT count(x) FROM d)" if stacked else "(SELECT count(x) FROM d dd WHERE dd.g = k.g)"
    share = f"n * 100.0 / {total}"
    if density:
        share = "n / (sum(n) OVER (PARTITION BY k.g) * (SELECT (hi - lo) / %d FROM e))" % n
    run = "sum(share) OVER (PARTITION BY g ORDER BY b)" if cumulative else "share"
    cols = ", ".join(
        "round(" + " + ".join(f"max(CASE WHEN g = '{h}' THEN share END)" for h in (groups[: i + 1] if stacked else [gr]))
        + f', 6) AS "{gr} [rel %]"'
        for i, gr in enumerate(groups)
    )
    return (
        f"WITH d AS (SELECT {g} AS g, CAST({x} AS DOUBLE) AS x FROM lineitem), "
        f"e AS (SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi FROM d LIMIT 1), "
        f"c AS (SELECT g, least({n - 1}, CAST(floor((x - lo) / (hi - lo) * {n}) AS INTEGER)) AS b, count(*) AS n "
        "FROM d, (SELECT * FROM e LIMIT 1) WHERE x BETWEEN lo AND hi GROUP BY 1, 2), "
        f"k AS (SELECT gg.g, bb.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT g FROM d) gg "
        f"CROSS JOIN (SELECT unnest(range({n})) AS b) bb LEFT JOIN c ON c.g = gg.g AND c.b = bb.b), "
        f"s AS (SELECT g, b, {share} AS share FROM k), "
        f"r AS (SELECT g, b, {run} AS share FROM s) "
        f'SELECT round(lo + (hi - lo) / {n} * b, 6) AS "bin edge low", '
        f'round(CASE WHEN b = {n - 1} THEN hi ELSE lo + (hi - lo) / {n} * (b + 1) END, 6) AS "bin edge high", {cols} '
        "FROM r, (SELECT * FROM e LIMIT 1) GROUP BY b, lo, hi"
    )


def _kde(source: str, x: str, group: str) -> str:
    """(group, i, x, y) as CTE ``dens``."""
    return (
        f"dv AS (SELECT {group} AS g, {x} AS v, count(*) AS c FROM {source} WHERE {x} IS NOT NULL GROUP BY 1, 2), "
        f"st AS (SELECT {group} AS g, count({x}) AS n, stddev_samp({x}) * power(count({x}), -0.2) AS h, "
        f"min({x}) AS lo, max({x}) AS hi FROM {source} GROUP BY 1 HAVING stddev_samp({x}) > 0), "
        "al AS (SELECT min(v) AS alo, max(v) AS ahi FROM dv), "
        "gr AS (SELECT g, n, h, i, greatest(lo - 3*h, alo) + (least(hi + 3*h, ahi) - greatest(lo - 3*h, alo)) * i / 199.0 AS t "
        "FROM st, al, (SELECT unnest(range(200)) AS i)), "
        "dens AS (SELECT gr.g, CAST(i AS INTEGER) AS i, t AS x, "
        "sum(c * exp(-((t - v) / h) * ((t - v) / h) / 2) / (n * h * sqrt(2 * pi()))) AS y "
        "FROM gr JOIN dv ON gr.g = dv.g GROUP BY gr.g, i, t)"
    )


def _corr_pairs(feats: list[str], expr) -> str:
    rows = []
    for a in feats:
        cols = ", ".join(f"round({expr(a, b)}, 6) AS {b}" for b in feats)
        rows.append(f"SELECT '{a}' AS \"Feature\", {cols} FROM m")
    return " UNION ALL ".join(rows)


def _spearman(feats: list[str]) -> str:
    """Ranks among the rows with both values, pair by pair."""
    ctes, cells = [], {}
    for i, a in enumerate(feats):
        for b in feats[i:]:
            name = f"p_{a}_{b}"
            ctes.append(
                f"{name} AS (SELECT round(corr(rx, ry), 6) AS c FROM (SELECT "
                f"rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
                f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry "
                f"FROM (SELECT {a} AS x, {b} AS y FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL)))"
            )
            cells[a, b] = cells[b, a] = f"(SELECT c FROM {name})"
    rows = [
        f"SELECT '{a}' AS \"Feature\", " + ", ".join(f"{cells[a, b]} AS {b}" for b in feats) for a in feats
    ]
    return _m(" UNION ALL ".join(rows), *ctes)


def _kendall() -> str:
    """Pairs of distinct (x, y) cells, weighted by their counts."""
    feats = ["nadph_a2p", "photons", "fad_a1p"]
    ctes, cells = [], {(f, f): "1.0" for f in feats}
    for i, a in enumerate(feats):
        for b in feats[i + 1:]:
            n = f"{a}_{b}"
            ctes += [
                f"c_{n} AS (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS c FROM m "
                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)",
                f"s_{n} AS (SELECT sum(p.c * o.c * sign(p.x - o.x) * sign(p.y - o.y)) / 2 AS s FROM c_{n} p, c_{n} o)",
                f"t_{n} AS (SELECT (SELECT sum(c) * (sum(c) - 1) / 2 FROM c_{n}) AS n0, "
                f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM c_{n} GROUP BY x)) AS n1, "
                f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM c_{n} GROUP BY y)) AS n2)",
            ]
            cells[a, b] = cells[b, a] = f"(SELECT round(s / (sqrt(n0 - n1) * sqrt(n0 - n2)), 6) FROM s_{n}, t_{n})"
    rows = [f"SELECT '{a}' AS \"Feature\", " + ", ".join(f"{cells[a, b]} AS {b}" for b in feats) for a in feats]
    return _m(" UNION ALL ".join(rows), *ctes)


def _kendall_continuous() -> str:
    """One feature of each pair has few values: for each of them, running counts along the other feature."""
    feats = ["nadph_t2", "photons", "nadph_a2p"]
    ctes, cells = [], {(f, f): "1.0" for f in feats}
    for i, a in enumerate(feats):
        for b in feats[i + 1:]:
            n = f"{a}_{b}"
            ctes += [
                f"c_{n} AS (SELECT {a} AS x, {b} AS y, count(*) AS c FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)",
                f"g_{n} AS (SELECT x, v, sum(CASE WHEN y = v THEN c ELSE 0 END) AS z, sum(CASE WHEN y > v THEN c ELSE 0 END) AS o "
                f"FROM c_{n}, (SELECT DISTINCT y AS v FROM c_{n}) GROUP BY x, v)",
                f"s_{n} AS (SELECT sum(o * (2 * upto - z - total)) AS s FROM (SELECT o, z, sum(z) OVER (PARTITION BY v ORDER BY x) AS upto, "
                f"sum(z) OVER (PARTITION BY v) AS total FROM g_{n}))",
                f"t_{n} AS (SELECT (SELECT sum(c) * (sum(c) - 1) / 2 FROM c_{n}) AS n0, "
                f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM c_{n} GROUP BY x)) AS n1, "
                f"(SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM c_{n} GROUP BY y)) AS n2)",
            ]
            cells[a, b] = cells[b, a] = f"(SELECT round(s / (sqrt(n0 - n1) * sqrt(n0 - n2)), 6) FROM s_{n}, t_{n})"
    rows = [f"SELECT '{a}' AS \"Feature\", " + ", ".join(f"{cells[a, b]} AS {b}" for b in feats) for a in feats]
    return _m(" UNION ALL ".join(rows), *ctes)


def _ks(source: str, x: str, comp: str, groups: list[str], prefix: str) -> str:
    g = ", ".join(groups)
    gs = (g + ", ") if g else ""
    part = f"PARTITION BY {gs}a, b"
    join_g = "".join(f" AND l.{k} = r.{k}" for k in groups)
    head = gs if groups else "'none' AS \"Grouping\", "
    lg = "".join(f"l.{k}, " for k in groups)
    return (
        f"{prefix} v AS (SELECT {gs}{comp} AS k, {x} AS x, count(*) AS c FROM {source} WHERE {x} IS NOT NULL GROUP BY ALL), "
        f"n AS (SELECT {gs}k, sum(c) AS n FROM v GROUP BY ALL), "
        f"p AS (SELECT {lg}l.k AS a, r.k AS b, l.n AS n1, r.n AS n2 FROM n l JOIN n r ON l.k < r.k{join_g}), "
        f"u AS (SELECT {''.join(f'p.{k}, ' for k in groups)}a, b, n1, n2, x, "
        f"sum(CASE WHEN v.k = a THEN c ELSE 0 END) AS c1, sum(CASE WHEN v.k = b THEN c ELSE 0 END) AS c2 "
        f"FROM p JOIN v ON v.k IN (a, b){''.join(f' AND p.{k} = v.{k}' for k in groups)} GROUP BY ALL), "
        f"f AS (SELECT *, sum(c1) OVER ({part} ORDER BY x) / n1 AS f1, sum(c2) OVER ({part} ORDER BY x) / n2 AS f2 FROM u), "
        f"s AS (SELECT {gs}a, b, n1, n2, max(abs(f1 - f2)) AS d FROM f GROUP BY ALL), "
        "w AS (SELECT *, d * sqrt(n1 * n2 / (n1 + n2)) AS lam, 1.36 * sqrt((n1 + n2) / (n1 * n2)) AS crit FROM s), "
        "pv AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), "
        "lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))))) END AS pval FROM w) "
        f'SELECT {head}a AS "{comp} 1", b AS "{comp} 2", a || \'-\' || b AS "{comp} 1 & 2", '
        f'CASE WHEN d > crit AND pval < 0.05 THEN \'Yes\' ELSE \'No\' END AS "dissimilar (<0.05)", '
        f'CAST(n1 AS BIGINT) AS "n ({comp} 1)", CAST(n2 AS BIGINT) AS "n ({comp} 2)", round(pval, 6) AS "p-values", '
        'round(d, 6) AS statistic, round(crit, 6) AS "critical D (0.05)" FROM pv'
    )


def _dense(exprs: list[str], row: list[float], bias: list[float], relu: bool) -> list[str]:
    """Output expressions of one layer; ``row`` is the (in, out) matrix row by row."""
    n = len(bias)
    out = []
    for j in range(n):
        z = " + ".join(f"{e} * ({row[i * n + j]})" for i, e in enumerate(exprs)) + f" + ({bias[j]})"
        out.append(f"greatest({z}, 0)" if relu else f"({z})")
    return out


def _ae() -> tuple[list[str], list[str]]:
    w = [0.5, -0.25, 1.0, 0.75, 0.5, -1.0, 0.1, 0.2, -0.3, 1.0, -0.5, 0.25, 0.5, 2.0, -1.0, 0.05, -0.05]
    x = ["coalesce(nadph_a2p, 0) / 50", "coalesce(photons, 0) / 50"]
    code = _dense(x, w[:6], w[6:9], True)
    return code, _dense(code, w[9:15], w[15:17], False)


def all_oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    e_pair, e_single = "(1 - t1 / t2) * 100", "(1 - t1 / 3100) * 100"

    def div(a: str, b: str) -> str:
        return f"CASE WHEN {b} <> 0 THEN {a} / {b} END"

    def dist(e: str) -> str:
        return f"CASE WHEN {e} <> 0 AND 100 / {e} - 1 >= 0 THEN 2.1 * power(100 / {e} - 1, 1.0 / 6) END"

    o["derive_measures"] = _m(
        f"SELECT {_ALL}, round(tm, 6) AS nadph_tm, round({div('nadph_a2p', 'nadph_a1p')}, 6) AS nadph_ratio, "
        "round((t2 - 1500) / 2900 * 100, 6) AS nadph_perc, round(100 - (t2 - 1500) / 2900 * 100, 6) AS nadh_perc, "
        f"round({e_pair}, 6) AS e_pair, round({e_single}, 6) AS e_single, "
        f"round({dist('(' + e_pair + ')')}, 6) AS r_pair, round({dist('(' + e_single + ')')}, 6) AS r_single, "
        f"round(ftm, 6) AS fad_tm, round({div('fad_a1p', 'fad_a2p')}, 6) AS fad_ratio, "
        f"round({div('tm', 'ftm')}, 6) AS tm_ratio, round({div('nadph_a2p', 'fad_a1p')}, 6) AS flirr "
        "FROM (SELECT *, nadph_t1 AS t1, nadph_t2 AS t2, "
        "(nadph_a1p * nadph_t1 + nadph_a2p * nadph_t2) / 100 AS tm, "
        "(fad_a1p * fad_t1 + fad_a2p * fad_t2) / 100 AS ftm FROM m)"
    )
    o["rename_drop_reorder"] = (
        'SELECT o_custkey AS custkey, o_orderdate AS "order date", o_orderkey AS "order key", '
        'o_orderstatus AS "order status", round(o_totalprice, 6) AS totalprice FROM orders'
    )
    o["parse_path_columns"] = (
        "SELECT page_id, url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS \"Directory\", "
        "regexp_extract(url, '([^/]*)$', 1) AS \"File\", "
        + ", ".join(
            f"CASE WHEN regexp_matches(url, '{p}') THEN CASE WHEN regexp_extract(url, '{p}', 1) = '' THEN '?' "
            f"ELSE regexp_extract(url, '{p}', 1) END END AS \"{n}\""
            for n, p in {"Site": r".*//(.*?)/", "Lang": r".*/(.*?)/", "Top": r"\.(.*?)/"}.items())
        + " FROM pages"
    )
    o["combine_categories"] = _m(
        "SELECT row_key, fov, compartment, treatment, fov || '-' || treatment AS \"fov-treatment\", "
        "fov || '-' || compartment || '-' || treatment AS \"fov-compartment-treatment\" FROM m")
    o["rename_values"] = "SELECT p_partkey, regexp_replace(p_brand, '^Brand#?', '') AS p_brand FROM part"
    o["map_values"] = _m(
        "SELECT row_key, CASE treatment WHEN 'Ctrl' THEN 'Control' WHEN 'T60' THEN 'T60+' ELSE treatment END AS treatment FROM m")
    o["scalar_functions"] = (
        "SELECT l_orderkey, round(10 * log10(l_extendedprice), 6) AS price_db, round(power(10, l_tax / 10), 6) AS tax_linear, "
        "round(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 6) AS share, l_quantity, "
        "l_quantity + 2.5 AS quantity_plus FROM lineitem")
    o["round_view"] = "SELECT c_custkey, round(c_acctbal, 1) AS c_acctbal FROM customer"

    o["import_text"] = _m(
        'SELECT fov AS "FOV", fov || \'-\' || treatment AS "FOV-Treatment", treatment AS "Treatment", '
        'round(fad_a1p, 6) AS "FAD a1[%]", photons AS "FAD photons", round(nadph_a1p, 6) AS "NAD(P)H a1[%]", '
        'round(nadph_a2p, 6) AS "NAD(P)H a2[%]", nadph_t1 AS "NAD(P)H t1", round(nadph_t2, 6) AS "NAD(P)H t2", '
        'CAST(row_key AS DOUBLE) AS row_key, '
        'round((nadph_a1p * nadph_t1 + nadph_a2p * nadph_t2) / 100, 6) AS "NAD(P)H tm", '
        f'round({div("nadph_a2p", "nadph_a1p")}, 6) AS "NAD(P)H a2[%]/a1[%]", '
        'round((nadph_t2 - 1500) / 2900 * 100, 6) AS "NADPH %", round(100 - (nadph_t2 - 1500) / 2900 * 100, 6) AS "NADH %", '
        f'round({div("nadph_a2p", "fad_a1p")}, 6) AS "FLIRR" FROM m')
    tm = "(nadph_a1p * nadph_t1 + nadph_a2p * nadph_t2) / 100"
    ratio = div("nadph_a2p", "fad_a1p")
    o["import_text_delimiters"] = _m(
        'SELECT fov AS "FOV", treatment AS "Treatment", ' + ", ".join(
            f'count({e}) AS "{n}__count", round(avg({e}), 6) AS "{n}__mean", round(max({e}), 6) AS "{n}__max"'
            for n, e in {"FLIRR": ratio, "NAD(P)H tm": tm}.items()) + " FROM m GROUP BY fov, treatment")

    o["range_filter_keepna"] = _m("SELECT row_key, photons FROM m WHERE photons BETWEEN 5 AND 30 OR photons IS NULL")
    o["range_filter_dropna"] = _m("SELECT row_key, photons FROM m WHERE photons BETWEEN 5 AND 30")
    o["filter_table"] = _m(f"SELECT {_ALL} FROM m WHERE treatment IN ('Ctrl', 'T30') AND {_KEPT}")
    o["filter_reversed"] = _m(f"SELECT {_ALL} FROM m WHERE photons IS NULL")
    o["filter_limited"] = _m(
        f"SELECT {_ALL} FROM m WHERE photons BETWEEN 8 AND 40 AND (nadph_t2 BETWEEN 2600 AND 6000 OR nadph_t2 IS NULL)")
    o["filter_discarded"] = _m(
        f"SELECT {_ALL} FROM m WHERE treatment IN ('Ctrl', 'T30') AND NOT coalesce({_KEPT}, false)")
    o["filter_report"] = _m(
        "SELECT * FROM (SELECT 'fad_a1p' AS filter, count(*) FILTER (NOT coalesce(fad_a1p BETWEEN 10 AND 70, false)) AS rows FROM m "
        "UNION ALL SELECT 'nadph_t2', count(*) FILTER (NOT coalesce(nadph_t2 BETWEEN 2500 AND 6000, false)) FROM m "
        "UNION ALL SELECT 'photons', count(*) FILTER (NOT coalesce(photons BETWEEN 5 AND 40, false)) FROM m "
        f"UNION ALL SELECT 'all dropped', count(*) FILTER (NOT coalesce({_KEPT}, false)) FROM m "
        f"UNION ALL SELECT 'remaining', count(*) FILTER (coalesce({_KEPT}, false)) FROM m)")
    o["series_filter"] = _m(
        f"SELECT {_ALL} FROM m WHERE row_key IN (SELECT row_key FROM m WHERE treatment IN ('Ctrl', 'T15', 'T30') "
        "GROUP BY row_key HAVING count(DISTINCT treatment) = 3)")

    for how in ("left", "right", "inner"):
        o[f"merge_{how}"] = _merge(how.upper())
    o["merge_outer"] = _merge("FULL")
    o["concat_rows"] = (
        "SELECT 'orders' AS \"Source\", o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount, "
        "NULL::VARCHAR AS segment FROM orders UNION ALL BY NAME "
        "SELECT 'customers' AS \"Source\", c_custkey AS id, c_mktsegment AS segment, c_acctbal AS amount FROM customer")
    o["zip_columns"] = (
        "SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.p_brand, a.p_size, a.p_retailprice, "
        "b.p_retailprice AS p_retailprice_1 FROM (SELECT * FROM part WHERE p_size > 10) a "
        "FULL JOIN (SELECT * FROM part WHERE p_size < 40) b ON a.p_partkey = b.p_partkey")
    o["join_labels"] = _m(
        "SELECT row_key, m.fov, m.cell, photons, round(g.v, 6) AS photons__mean FROM m "
        "LEFT JOIN (SELECT fov, cell, avg(photons) AS v FROM m GROUP BY 1, 2) g ON m.fov = g.fov AND m.cell = g.cell")
    o["distinct_rows"] = _m("SELECT DISTINCT fov, cell, nadph_t1 FROM m")
    o["except_rows"] = (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN "
        "(SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
    o["split_counts"] = _m('SELECT fov AS "Source", count(*) AS n FROM m GROUP BY fov')
    o["distinct_values"] = _m("SELECT DISTINCT treatment FROM m")

    cells = ", ".join(
        f"round(avg(CASE WHEN treatment = '{s}' THEN {f} END), 6) AS {f}__{s}" for f in ("nadph_t2", "photons") for s in _STEPS)
    o["pivot_mean"] = _m(f"SELECT fov, compartment, cell, {cells} FROM m GROUP BY fov, compartment, cell")
    cells = ", ".join(
        f"round(avg(CASE WHEN treatment = '{s}' AND fov = '{v}' THEN nadph_a2p END), 6) AS nadph_a2p__{s}__{v}"
        for s in _STEPS for v in "ANR")
    o["pivot_two_keys"] = _m(f"SELECT compartment, cell, {cells} FROM m GROUP BY compartment, cell")
    o["unpivot"] = _m(
        "SELECT fov, compartment, cell, treatment, unnest(['nadph_t1', 'photons', 'fad_a1p']) AS channel, "
        "round(unnest([nadph_t1, photons, fad_a1p]), 6) AS value FROM m")
    o["sort_topk"] = (
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 100")
    o["order_categories"] = (
        "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority IN ('5-LOW', '3-MEDIUM', '1-URGENT', '2-HIGH') "
        "THEN o_orderpriority END AS o_orderpriority, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 "
        "WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 END AS INTEGER) AS place FROM orders")

    o["summarize_by_group"] = _m(_summary(_CELLS, _FEATURES))
    o["summarize_all"] = _m(_summary("", ["photons", "nadph_t2"]))
    o["summarize_per_feature"] = _m(_summary("fov, compartment, treatment", ["photons"]))
    o["summarize_text_min"] = "SELECT p_brand, min(p_name) AS p_name__min, min(p_size) AS p_size__min FROM part GROUP BY p_brand"
    o["group_counts"] = _m(f"SELECT {_CELLS}, count(*) AS count FROM m GROUP BY {_CELLS}")
    o["column_limits"] = _m(
        "SELECT " + ", ".join(
            f"round(least(0, min({f})) * 1.05, 6) AS {f}__min, round(greatest(0, max({f})) * 1.05, 6) AS {f}__max"
            for f in ("nadph_t2", "photons")) + " FROM m")
    o["mean_error_sem"] = _m(
        "SELECT fov, compartment, treatment, " + ", ".join(
            f"round(avg({f}), 6) AS {f}__mean, round(stddev_samp({f}) / sqrt(count({f})), 6) AS {f}__error"
            for f in ("photons", "nadph_t2"))
        + " FROM m WHERE photons IS NOT NULL AND nadph_t2 IS NOT NULL GROUP BY fov, compartment, treatment")
    stacked = ("nadph_a2p", "fad_a1p", "photons")
    scale = "(" + " + ".join(f"abs(m_{f})" for f in stacked) + ")"
    o["stacked_percent"] = _m(
        "SELECT treatment, fov, " + ", ".join(
            f'round(m_{f} / {scale} * 100, 6) AS {f}__mean, 0.0 AS "{f}__lower error", '
            f"round(s_{f} / {scale} * 100, 6) AS {f}__error" for f in stacked)
        + " FROM g",
        "g AS (SELECT treatment, fov, " + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in stacked)
        + " FROM m WHERE photons IS NOT NULL GROUP BY treatment, fov)")
    o["bar_table"] = _m(
        "SELECT fov, " + ", ".join(
            f"round(avg(CASE WHEN treatment = '{s}' THEN photons END), 6) AS photons__mean__{s}, "
            f"round(stddev_samp(CASE WHEN treatment = '{s}' THEN photons END) / "
            f"sqrt(count(CASE WHEN treatment = '{s}' THEN photons END)), 6) AS photons__error__{s}" for s in _STEPS)
        + " FROM m GROUP BY fov")
    o["relative_change_mean"] = _relative(["fov"], ["photons", "fad_a1p"], "avg({x})")
    o["relative_change_median"] = _relative(["fov", "compartment"], ["photons", "fad_a1p"], "quantile_cont({x}, 0.5)")
    o["relative_change_all_keys"] = _relative(["fov", "compartment", "cell"], ["nadph_t2"], "avg({x})")
    o["group_transform"] = _m(
        'SELECT row_key, m.fov, m.cell, photons, round(g.v, 6) AS "median photons" FROM m JOIN '
        "(SELECT fov, cell, quantile_cont(photons, 0.5) AS v FROM m GROUP BY 1, 2) g ON m.fov = g.fov AND m.cell = g.cell")
    level = _bin("l_quantity", [(1, 10, "low"), (10, 25, "medium"), (25, 45, "high")], "'unassigned'")
    o["categorize"] = f"SELECT l_returnflag, {level} AS level, l_orderkey, l_quantity FROM lineitem"
    o["change_table"] = _m(f"SELECT {_CHANGE_COLS} FROM ct", *_change())
    o["categorize_by_change"] = _m(
        "SELECT row_key, compartment, treatment, m.fov, m.cell, round(nadph_t2, 6) AS nadph_t2, "
        "coalesce(\"Cat max rel %\", 'unassigned') AS \"Category\" FROM m LEFT JOIN ct ON m.fov = ct.fov AND m.cell = ct.cell",
        *_change())

    o["series_wide"] = _series_wide()
    o["series_long"] = (
        f"WITH m AS ({MEASUREMENT_SQL}), "
        + _series_long("m", "fov, compartment, cell", "treatment", _STEP_AT, "photons", 6))
    o["series_long_numeric"] = (
        "WITH od AS (SELECT *, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day FROM orders), "
        + _series_long("od", "o_orderpriority", "day", "day", "o_totalprice", 4))

    flags = ["A", "N", "R"]
    o["histogram"] = _hist("l_extendedprice", "l_returnflag", flags, "min(x)", "max(x)", 100)
    o["histogram_stacked"] = _hist("l_extendedprice", "l_returnflag", flags, "0", "90000", 45, stacked=True)
    o["histogram_cumulative"] = _hist("l_quantity", None, ["all"], "0", "40", 20, cumulative=True)
    o["histogram_density"] = _hist("l_quantity", "l_linestatus", ["F", "O"], "0", "40", 20, density=True)
    o["kde"] = (
        "WITH " + _kde("lineitem", "l_quantity", "l_returnflag")
        + " SELECT g AS l_returnflag, i, round(x, 8) AS x, round(y, 8) AS y FROM dens")
    o["kde_wide"] = (
        "WITH " + _kde("lineitem", "l_tax", "l_linestatus") + " SELECT i, " + ", ".join(
            f'round(max(CASE WHEN g = \'{g}\' THEN {c} END), 8) AS "{g}_{c}"' for g in "FO" for c in "xy")
        + " FROM dens GROUP BY i")
    o["violin_stats"] = _m(
        "SELECT g AS treatment, i, round(x, 8) AS x, round(y, 8) AS y FROM dens",
        _kde("m", "photons", "treatment"))
    o["box_stats"] = _m(
        "SELECT b.fov, b.treatment, count(*) AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, "
        'round(least(min(CASE WHEN nadph_t2 BETWEEN lo AND hi THEN nadph_t2 END), q1), 6) AS "whisker low", '
        'round(greatest(max(CASE WHEN nadph_t2 BETWEEN lo AND hi THEN nadph_t2 END), q3), 6) AS "whisker high", '
        "count(*) FILTER (NOT nadph_t2 BETWEEN lo AND hi) AS outliers "
        "FROM m JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b0) b "
        "ON m.fov = b.fov AND m.treatment = b.treatment GROUP BY b.fov, b.treatment, q1, med, q3",
        "b0 AS (SELECT fov, treatment, quantile_cont(nadph_t2, 0.25) AS q1, quantile_cont(nadph_t2, 0.5) AS med, "
        "quantile_cont(nadph_t2, 0.75) AS q3 FROM m GROUP BY fov, treatment)")
    o["box_outliers"] = _m(
        "SELECT s.fov, round(x, 6) AS skewed FROM s JOIN b0 ON s.fov = b0.fov "
        "WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)",
        "s AS (SELECT fov, exp(nadph_t2 / 1000) AS x FROM m)",
        "b0 AS (SELECT fov, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM s GROUP BY fov)")
    o["swarm_points"] = _m(
        f"SELECT treatment, round(avg(photons), 6) AS photons__mean FROM m GROUP BY {_CELLS} HAVING avg(photons) IS NOT NULL")
    for name, half in {
        "line_sd": "stddev_samp(photons)",
        "line_normal": "stddev_samp(photons) / sqrt(count(photons)) * 1.959963984540054",
    }.items():
        o[name] = _m(
            "SELECT treatment, fov, count(photons) AS n, round(avg(photons), 6) AS mean, "
            f"round(avg(photons) - {half}, 6) AS low, round(avg(photons) + {half}, 6) AS high "
            "FROM m GROUP BY treatment, fov")
    o["scatter_points"] = _m(
        "SELECT treatment, photons, round(nadph_t2, 6) AS nadph_t2 FROM m WHERE photons IS NOT NULL AND nadph_t2 IS NOT NULL")
    o["scatter_bins"] = _m(
        "SELECT treatment, CAST(least(39, floor((photons - x0) / (x1 - x0) * 40)) AS INTEGER) AS \"x bin\", "
        "CAST(least(39, floor((nadph_t2 - y0) / (y1 - y0) * 40)) AS INTEGER) AS \"y bin\", count(*) AS count "
        "FROM p, e GROUP BY 1, 2, 3",
        "p AS (SELECT * FROM m WHERE photons IS NOT NULL AND nadph_t2 IS NOT NULL)",
        "e AS (SELECT min(photons) AS x0, max(photons) AS x1, min(nadph_t2) AS y0, max(nadph_t2) AS y1 FROM p)")
    o["pair_hist"] = _m(
        "SELECT gg.treatment, gg.treatment AS \"group\", CAST(bb.b AS INTEGER) AS bin, "
        'round(lo + (hi - lo) / 20 * bb.b, 6) AS "bin edge low", '
        'round(CASE WHEN bb.b = 19 THEN hi ELSE lo + (hi - lo) / 20 * (bb.b + 1) END, 6) AS "bin edge high", '
        "coalesce(c.n, 0) AS count, round(coalesce(c.n, 0) * 100.0 / gg.total, 6) AS share "
        "FROM (SELECT treatment, count(nadph_t2) AS total FROM m GROUP BY 1) gg CROSS JOIN (SELECT unnest(range(20)) AS b) bb "
        "CROSS JOIN e LEFT JOIN c ON c.treatment = gg.treatment AND c.b = bb.b",
        "e AS (SELECT min(nadph_t2) AS lo, max(nadph_t2) AS hi FROM m)",
        "c AS (SELECT treatment, least(19, floor((nadph_t2 - lo) / (hi - lo) * 20)) AS b, count(*) AS n FROM m, e GROUP BY 1, 2)")
    o["ratio_panel"] = _m(
        'SELECT treatment, fov, round(avg(x), 6) AS flirr__mean, round(stddev_samp(x) / sqrt(count(x)), 6) AS flirr__error '
        "FROM (SELECT treatment, fov, CASE WHEN fad_a1p <> 0 THEN nadph_a2p / fad_a1p END AS x FROM m) "
        "WHERE x IS NOT NULL GROUP BY treatment, fov")

    o["corr_pearson"] = _m(_corr_pairs(_FEATURES, lambda a, b: f"corr({a}, {b})"))
    o["corr_spearman"] = _spearman(_FEATURES)
    o["corr_spearman_continuous"] = _spearman(["nadph_t2", "fad_t2", "photons"])
    o["corr_kendall"] = _kendall()
    o["corr_kendall_continuous"] = _kendall_continuous()
    o["ks_statistic"] = _ks("lineitem", "l_extendedprice", "l_returnflag", [], "WITH")
    o["ks_default"] = _ks("m", "photons", "treatment", ["fov"], f"WITH m AS ({MEASUREMENT_SQL}),")
    lines = "(SELECT l_extendedprice, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS l_quantity FROM lineitem)"
    o["ks_many_labels"] = _ks(lines, "l_extendedprice", "l_quantity", [], "WITH")
    o["ks_pvalue"] = _ks("m", "photons", "treatment", ["fov", "compartment"], f"WITH m AS ({MEASUREMENT_SQL}),")

    o["standardized"] = _m(
        "SELECT row_key, round(nadph_t2, 6) AS nadph_t2, photons, " + ", ".join(
            f"round(({f} - (SELECT avg({f}) FROM m)) / (SELECT stddev_pop({f}) FROM m), 6) + 0.0 AS {f}__standardized"
            for f in ("nadph_t2", "photons")) + " FROM m")
    o["job_merge_pca"] = _m(
        "SELECT unnest(['PC 1', 'PC 2']) AS \"PC\", round(unnest([(1 + abs(r)) / 2, (1 - abs(r)) / 2]), 6) "
        'AS "explained var ratio", n AS rows FROM (SELECT corr(photons, nadph_t2) AS r, 2 * count(*) AS n FROM m)')
    o["sort_rows"] = _m("SELECT count(*) AS n, 0 AS inside, 0 AS between FROM m")
    o["inf_to_missing"] = _m("SELECT row_key, line_no, CASE WHEN photons BETWEEN 6 AND 40 THEN photons END AS photons FROM m")
    used = "photons BETWEEN 5 AND 40 AND nadph_t2 BETWEEN 2500 AND 6000 AND fad_a1p BETWEEN 10 AND 70"
    o["apply_filters"] = _m(
        "SELECT count(*) AS n, 3 AS used, 2 AS skipped, 5 AS reported FROM k WHERE (fov, compartment, cell) IN ("
        "SELECT (fov, compartment, cell) FROM k GROUP BY fov, compartment, cell HAVING count(DISTINCT treatment) FILTER (treatment IN ('Ctrl', 'T15')) = 2)",
        f"k AS (SELECT * FROM m WHERE {used})")
    o["default_ranges"] = _m(
        "SELECT count(*) AS n, 2 AS ranges, 0.0::DOUBLE AS low, 100.0::DOUBLE AS high FROM m WHERE photons BETWEEN 0 AND 100")
    o["preview_rows"] = _m("SELECT least(50, 50) AS most, 0 AS longer FROM (SELECT count(*) FROM m)")
    o["group_split_sides"] = _m(
        "SELECT n, n AS groups, CAST(round(0.7 * n) AS BIGINT) AS training FROM (SELECT count(*) AS n FROM (SELECT DISTINCT fov, compartment, cell FROM m))")
    o["pca_moments"] = _m(
        "SELECT count(*) AS n, true AS uncorrelated, true AS centred, true AS as_shared, 1.0::DOUBLE AS total FROM m "
        "WHERE nadph_a2p IS NOT NULL AND fad_a1p IS NOT NULL AND photons IS NOT NULL AND nadph_t2 IS NOT NULL")
    o["forest_sums"] = _m("SELECT 4 AS features, 1.0::DOUBLE AS total, true AS positive, true AS accurate FROM (SELECT count(*) FROM m)")
    o["ae_fit_tables"] = _m(
        "SELECT 2 * count(*) AS decoded, 2 AS finals, 2 AS sides, true AS falling, 6 AS losses, 4 AS models FROM m")
    o["line_bootstrap_order"] = _m(
        "SELECT treatment, fov, count(*) AS n, round(avg(nadph_t2), 6) AS mean, true AS inside FROM m WHERE nadph_t2 IS NOT NULL GROUP BY treatment, fov")
    o["kmeans_nearest"] = _m("SELECT count(*) AS n, 3 AS clusters, 0 AS misplaced FROM m WHERE nadph_a2p IS NOT NULL AND photons IS NOT NULL")
    o["minmax_impute"] = _m(
        "SELECT row_key, treatment, " + ", ".join(
            f"round(coalesce(({f} - lo_{f}) / (hi_{f} - lo_{f}), 0), 6) AS {f}" for f in ("nadph_t2", "photons"))
        + " FROM m, (SELECT min(nadph_t2) AS lo_nadph_t2, max(nadph_t2) AS hi_nadph_t2, min(photons) AS lo_photons, "
        "max(photons) AS hi_photons FROM m WHERE treatment = 'Ctrl')")
    o["label_encode"] = _m(
        "SELECT row_key, treatment, fov, "
        "CAST((SELECT count(DISTINCT treatment) FROM m b WHERE b.treatment < m.treatment) AS INTEGER) AS \"treatment code\", "
        "CAST((SELECT count(DISTINCT fov) FROM m b WHERE b.fov < m.fov) AS INTEGER) AS \"fov code\" FROM m")
    o["pca_two"] = _m(
        "SELECT unnest(['PC 1', 'PC 2']) AS \"PC\", round(unnest([(1 + abs(r)) / 2, (1 - abs(r)) / 2]), 6) "
        'AS "explained var ratio" FROM (SELECT corr(photons, nadph_t2) AS r FROM m)')
    z = ", ".join(
        f"round({f}, 6) AS {f}, round(({f} - (SELECT avg({f}) FROM p)) / (SELECT stddev_pop({f}) FROM p), 6) + 0.0 "
        f"AS {f}__standardized" for f in ("photons", "nadph_t2"))
    o["pca_standardized"] = _m(
        f"SELECT fov, compartment, cell, treatment, {z} FROM p",
        "p AS (SELECT * FROM m WHERE photons IS NOT NULL AND nadph_t2 IS NOT NULL)")
    code, recon = _ae()
    o["ae_apply"] = _m(
        "SELECT 'given' AS model_file, fov, cell, " + ", ".join(
            f'round({e}, 6) + 0.0 AS "Recon Feature {i + 1}"' for i, e in enumerate(recon)) + " FROM m")
    o["ae_encode"] = _m(
        "SELECT 'given' AS model_file, fov, cell, " + ", ".join(
            f'round({e}, 6) + 0.0 AS "Feature {i + 1}"' for i, e in enumerate(code)) + " FROM m")
    amps = {"nadph_a1p": "nadph_a1p + nadph_a2p", "nadph_a2p": "nadph_a1p + nadph_a2p",
            "fad_a1p": "fad_a1p + fad_a2p", "fad_a2p": "fad_a1p + fad_a2p"}
    o["augment_amplitudes"] = _m(
        "SELECT fov, CAST(CAST(cell AS BIGINT) + (SELECT max(CAST(cell AS BIGINT)) FROM m) * s AS VARCHAR) AS cell, "
        + ", ".join(f"round({a}, 6) AS {a}, round(CASE WHEN {t} <> 0 THEN {a} / ({t}) * 100 END, 6) AS \"{a}%\"" for a, t in amps.items())
        + " FROM m CROSS JOIN range(3) t(s)")

    refs = _relative(["fov", "cell"], ["photons", "nadph_t2"], "avg({x})")
    o["flow_basic"] = (
        'SELECT cell, fov, treatment, round(avg("rel photons"), 6) AS "rel photons__mean", '
        f'round(avg("rel nadph_t2"), 6) AS "rel nadph_t2__mean" FROM ({refs.replace("round(CASE", "(CASE").replace("END, 6)", "END)")}) GROUP BY cell, fov, treatment')
    o["flow_basic_stats"] = _m(
        "SELECT treatment, " + ", ".join(
            f"count({f}) AS {f}__count, round(quantile_cont({f}, 0.5), 6) AS {f}__median, round(avg({f}), 6) AS {f}__mean, "
            f"round(stddev_samp({f}), 6) AS {f}__std, round(stddev_samp({f}) / sqrt(count({f})), 6) AS {f}__sem"
            for f in ("photons", "nadph_t2")) + " FROM m GROUP BY treatment")
    kind = _bin("tm", [(0, 400, "short"), (400, 1200, "middle"), (1200, 9000, "long")], "'unassigned'")
    o["stream_import"] = _m(
        f'SELECT fov AS "FOV", treatment AS "Treatment", {kind} AS kind, row_key, photons AS "FAD photons", '
        f'round(tm, 6) AS "NAD(P)H tm", round({div("nadph_a2p", "fad_a1p")}, 6) AS "FLIRR" FROM t',
        "t AS (SELECT *, (nadph_a1p * nadph_t1 + nadph_a2p * nadph_t2) / 100 AS tm FROM m WHERE photons BETWEEN 5 AND 45)")
    o["stream_daily"] = (
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(value) AS value__count, "
        "round(avg(value), 6) AS value__mean, round(stddev_samp(value), 6) AS value__std, "
        "round(min(value), 6) AS value__min, round(max(value), 6) AS value__max FROM events GROUP BY 1, 2")
    # As in the queries: exact decimal ties are moved off the rounding edge.
    return {name: sql.replace(", 6)", " + 2e-9, 6)") for name, sql in o.items()}
