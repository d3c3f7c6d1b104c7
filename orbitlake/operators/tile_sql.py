"""What the kernels over tiles compute, as SQL over a row a pixel.

Written apart from the kernels: stencils are windows along the lines of a scene. Borders are reflected
(d c b a | a b c d | d c b a): neighbours at distance 1 by their own pixel, wider frames by mirrored rows that are
dropped afterwards.
"""

from __future__ import annotations

import math

from orbitlake.operators.evaluation import METRICS
from orbitlake.sources.fixtures import SQL_WIDE

DIFF = "(abs(r1 - r2) + abs(g1 - g2) + abs(b1 - b2)) / 765"
CVA = "least(1, sqrt((pow(r1 - r2, 2) + pow(g1 - g2, 2) + pow(b1 - b2, 2)) / 195075))"
AT = "scene_id, h, w, y, x"
WITH = f"WITH {SQL_WIDE}, "


def luma(i: int, weights: tuple[str, str, str] = ("0.2989", "0.587", "0.114")) -> str:
    r, g, b = weights
    return f"({r}::DOUBLE * r{i} + {g}::DOUBLE * g{i} + {b}::DOUBLE * b{i}) / 255"


SSIM_LUMA = ("0.299", "0.587", "0.114")


def line(axis: str) -> str:
    return f"(PARTITION BY scene_id, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"


def before(v: str, axis: str) -> str:
    return f"coalesce(lag({v}) OVER {line(axis)}, {v})"


def after(v: str, axis: str) -> str:
    return f"coalesce(lead({v}) OVER {line(axis)}, {v})"


def mirrored(source: str, axis: str, columns: str, radius: int) -> str:
    """``source`` with ``radius`` reflected pixels before and after each line, which may be shorter than that by half."""
    other, side = ("y", "w") if axis == "x" else ("x", "h")
    head = f"SELECT scene_id, h, w, {other}, {axis}, {columns} FROM {source}"
    return f"{head} UNION ALL SELECT scene_id, h, w, {other}, -1 - {axis}, {columns} FROM {source} WHERE {axis} < {radius} UNION ALL SELECT scene_id, h, w, {other}, 2 * {side} - 1 - {axis}, {columns} FROM {source} WHERE {axis} >= {side} - {radius}"


def separable(source: str, out: str, values: list[str], kept: list[str], radius: int, weights: list[float] | None = None) -> str:
    """CTEs that end in ``out``: ``values`` averaged (or weighed) over a square around each pixel, ``kept`` as they are."""

    def smooth(v: str, axis: str) -> str:
        if weights is None:
            return f"avg({v}) OVER (PARTITION BY scene_id, {'y' if axis == 'x' else 'x'} ORDER BY {axis} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS {v}"
        taps = [f"{x:.17e} * " + (v if k == 0 else f"(coalesce(lag({v}, {k}) OVER {line(axis)}, 0) + coalesce(lead({v}, {k}) OVER {line(axis)}, 0))") for k, x in enumerate(weights)]
        return f"{' + '.join(taps)} AS {v}"

    steps, now = [], source
    for axis, side in (("x", "w"), ("y", "h")):
        steps.append(f"{out}_m{axis} AS ({mirrored(now, axis, ', '.join(values + kept), radius)})")
        now = out if axis == "y" else f"{out}_{axis}"
        done = ", ".join([AT, *(smooth(v, axis) for v in values), *kept])
        steps.append(f"{now} AS (SELECT * FROM (SELECT {done} FROM {out}_m{axis}) WHERE {axis} >= 0 AND {axis} < {side})")
    return ", ".join(steps)


def bell(sigma: float, radius: int) -> list[float]:
    """Normal densities at distances 0 to ``radius``, over their sum on both sides."""
    every = [math.exp(-((k / sigma) ** 2) / 2) for k in range(-radius, radius + 1)]
    return [x / math.fsum(every) for x in every[radius:]]


def _stencils() -> str:
    first, second, third = [], [], []
    for v in ("u", "v"):
        first += [f"{after(v, 'x')} - {before(v, 'x')} AS d{v}", f"{before(v, 'x')} + 2 * {v} + {after(v, 'x')} AS s{v}", f"{before(v, 'x')} + {after(v, 'x')} - 4 * {v} AS a{v}"]
        second += [f"{before('d' + v, 'y')} + 2 * d{v} + {after('d' + v, 'y')} AS h{v}", f"{after('s' + v, 'y')} - {before('s' + v, 'y')} AS w{v}", f"a{v} + {before(v, 'y')} + {after(v, 'y')} AS l{v}"]
        third += [f"sqrt(h{v} * h{v} + w{v} * w{v}) AS g{v}", f"l{v} * l{v} AS q{v}"]
    at = f"{AT}, u, v, p, gt"
    return f"""base AS (SELECT {AT}, {luma(1)} AS u, {luma(2)} AS v, {DIFF} AS p, gt FROM pixels),
st1 AS (SELECT {at}, {", ".join(first)} FROM base), st2 AS (SELECT {at}, {", ".join(second)} FROM st1), st3 AS (SELECT {at}, {", ".join(third)} FROM st2),
{separable("st3", "box", ["u", "v", "qu", "qv"], ["p", "gt", "gu", "gv"], 7)},
signals AS (SELECT scene_id, y, x, p, gt, abs(gu - gv) / (gu + gv + 1e-4) AS s_reg, abs(u - v) / (u + v + 1e-4) AS s_illum, abs(qu - qv) / (qu + qv + 1e-4) AS s_sharp, 4 * p * (1 - p) AS margin FROM box)"""


SIGNALS = WITH + _stencils()
FULL = "(0.34::DOUBLE * s_reg + 0.33::DOUBLE * s_illum + 0.33::DOUBLE * s_sharp)"


def gated(gamma: str, q: str, margin: str = "margin") -> str:
    return f"least(1, greatest(0, p * (1 - {gamma} * {margin} * {q})))"


def means(source: str, value: str) -> str:
    return f"SELECT scene_id, round(avg({value}), 6) AS mean, round(max({value}), 6) AS most FROM {source} GROUP BY scene_id"


def ssim(source: str, out: str, kept: str, i: str = "") -> str:
    """CTEs that end in ``out`` (scene_id, y, x, gt, ``kept``, p): 1 - SSIM of the lumas, or of channel ``i``."""
    u, v = (luma(k, SSIM_LUMA) if not i else f"{i}{k} / 255" for k in (1, 2))
    top, bottom = "(2 * u * v + 1e-4) * (2 * (uv - u * v) + 9e-4)", "(u * u + v * v + 1e-4) * (uu - u * u + vv - v * v + 9e-4)"
    more = [k for k in kept.split(", ") if k]
    return f"""{out}0 AS (SELECT {AT}, {", ".join(["gt", *more])}, {u} AS u, {v} AS v FROM {source}), {out}1 AS (SELECT *, u * u AS uu, v * v AS vv, u * v AS uv FROM {out}0),
{separable(f"{out}1", f"{out}2", ["u", "v", "uu", "vv", "uv"], ["gt", *more], 5, bell(1.5, 5))}, {out} AS (SELECT *, least(1, greatest(0, 1 - {top} / ({bottom}))) AS p FROM {out}2)"""


GRID = f"""{SIGNALS}, gm AS (SELECT unnest(range(7)) / 10 AS gamma), ta AS (SELECT (30 + 5 * unnest(range(7))) / 100 AS tau),
gp AS (SELECT gamma, gt, {gated("gamma", FULL)} AS g FROM signals, gm),
bins AS (SELECT gamma, gt, least(7, greatest(0, len(list_filter([0.3::DOUBLE, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6], lambda t: g >= t)))) AS k, count(*) AS n FROM gp GROUP BY ALL),
cm AS (SELECT gamma, tau, sum(CASE WHEN k > i AND gt = 1 THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN k > i AND gt = 0 THEN n ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN k <= i AND gt = 1 THEN n ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN k <= i AND gt = 0 THEN n ELSE 0 END)::BIGINT AS tn FROM bins, (SELECT tau, row_number() OVER (ORDER BY tau) - 1 AS i FROM ta) GROUP BY gamma, tau),
grid AS (SELECT gamma, tau, tp, fp, fn, tn, {METRICS} FROM cm), best AS (SELECT * FROM grid ORDER BY f1 DESC, gamma, tau LIMIT 1)"""
COUNTS = ", ".join(f"count(*) FILTER ({hit} AND gt = {gt}) AS {n}" for n, hit, gt in (("tp", "hit", 1), ("fp", "hit", 0), ("fn", "NOT hit", 1), ("tn", "NOT hit", 0)))
ABLATION = {
    "full": f"{gated('b.gamma', FULL)} >= b.tau",
    "no_gate": "p >= 0.45::DOUBLE",
    "all_signals": f"{gated('0.3::DOUBLE', FULL)} >= b.tau",
    "reg_only": f"{gated('0.3::DOUBLE', 's_reg')} >= b.tau",
    "illum_only": f"{gated('0.3::DOUBLE', 's_illum')} >= b.tau",
    "sharp_only": f"{gated('0.3::DOUBLE', 's_sharp')} >= b.tau",
    "no_uncertainty": f"{gated('0.3::DOUBLE', FULL, '1')} >= b.tau",
}


def shadow(share: str, seeded: bool) -> str:
    """Second image's channels, dimmed within the box; of columns side, top, left."""
    inside = f"y >= {'y_seed' if seeded else 'top'}_{share} AND y < {'y_seed' if seeded else 'top'}_{share} + side_{share} AND x >= {'x_seed' if seeded else 'lft'}_{share} AND x < {'x_seed' if seeded else 'lft'}_{share} + side_{share}"
    return ", ".join(f"CASE WHEN {inside} THEN round({c}2 * 0.4::DOUBLE) ELSE {c}2 END AS {c}2" for c in "rgb")


SHARES = {"a": "0.02", "b": "0.05", "c": "0.1"}


def _boxes() -> str:
    sides = ", ".join(f"greatest(1, least(round(sqrt(h * w * {v}::DOUBLE))::INT, h, w)) AS side_{k}" for k, v in SHARES.items())
    seed = lambda axis, side, k: f"('0x' || substr(md5('shadow:42:' || scene_id || ':{axis}'), 1, 8))::BIGINT % greatest(1, {side} - side_{k})"
    places = ", ".join(f"round_even((h - side_{k}) * 0.35::DOUBLE, 0)::INT AS top_{k}, round_even((w - side_{k}) * 0.35::DOUBLE, 0)::INT AS lft_{k}, {seed('y', 'h', k)} AS y_seed_{k}, {seed('x', 'w', k)} AS x_seed_{k}" for k in SHARES)
    return f"sd AS (SELECT s AS scene_id, h, w, {sides} FROM sides), boxes AS (SELECT *, {places} FROM sd), shade AS (SELECT p.*, b.* EXCLUDE (scene_id, h, w) FROM pixels p JOIN boxes b USING (scene_id))"


def _moved(axis: str, k: int) -> str:
    return f"CASE WHEN a.{axis} < {k} THEN {k - 1} - a.{axis} ELSE a.{axis} - {k} END"


FIRST = f"{AT}, gt, r1, g1, b1"


def _conditions() -> str:
    """CTE cond (code, scene_id, ...): the scenes under 13 conditions; scene_id * 16 + code keeps those apart."""
    parts = [("control", "none", f"SELECT {FIRST}, r2, g2, b2 FROM pixels")]
    parts += [("illumination", s, f"SELECT {FIRST}, " + ", ".join(f"least(255, round({c}2 + 255 * {v}::DOUBLE)) AS {c}2" for c in "rgb") + " FROM pixels") for s, v in (("mild", "0.05"), ("medium", "0.15"), ("strong", "0.25"))]
    parts += [("occlusion", s, f"SELECT {FIRST}, {shadow(k, True)} FROM shade") for s, k in (("mild", "a"), ("medium", "b"), ("strong", "c"))]
    parts += [("misregistration", s, f"SELECT a.scene_id, a.h, a.w, a.y, a.x, a.gt, a.r1, a.g1, a.b1, b.r2, b.g2, b.b2 FROM pixels a JOIN pixels b ON a.scene_id = b.scene_id AND b.y = {_moved('y', k)} AND b.x = {_moved('x', k)}") for s, k in (("mild", 1), ("medium", 3), ("strong", 5))]
    blurs = [separable("pixels", f"bl{s}", ["r2", "g2", "b2"], ["gt", "r1", "g1", "b1"], 4 * s, bell(s, 4 * s)) for s in (1, 2, 4)]
    parts += [("blur", s, f"SELECT {FIRST}, " + ", ".join(f"least(255, greatest(0, round({c}2))) AS {c}2" for c in "rgb") + f" FROM bl{k}") for s, k in (("mild", 1), ("medium", 2), ("strong", 4))]
    union = " UNION ALL ".join(f"SELECT '{family}' AS family, '{severity}' AS severity, * REPLACE (scene_id * 16 + {i} AS scene_id) FROM ({text})" for i, (family, severity, text) in enumerate(parts))
    return f"{_boxes()}, {', '.join(blurs)}, cond AS MATERIALIZED ({union})"


D20 = f"""{WITH}{_conditions()}, {ssim("cond", "ss", "family, severity")},
hits AS (SELECT family, severity, 'pixel_diff' AS detector, gt, {DIFF} >= 0.41::DOUBLE AS hit FROM cond UNION ALL SELECT family, severity, 'cva', gt, {CVA} >= 0.405::DOUBLE FROM cond UNION ALL SELECT family, severity, 'ssim', gt, p >= 0.9::DOUBLE FROM ss),
cm AS (SELECT detector, family, severity, {COUNTS} FROM hits GROUP BY ALL), m AS (SELECT *, {METRICS} FROM cm)
SELECT m.*, round(m.f1 - c.f1, 6) AS f1_delta, round(CASE WHEN c.f1 > 0 THEN (c.f1 - m.f1) / c.f1 * 100 ELSE 0 END, 4) AS f1_loss_pct, round(m.iou - c.iou, 6) AS iou_delta, round(CASE WHEN c.iou > 0 THEN (c.iou - m.iou) / c.iou * 100 ELSE 0 END, 4) AS iou_loss_pct,
  m.fp - c.fp AS fp_more, round(CASE WHEN c.fp > 0 THEN (m.fp - c.fp) / c.fp * 100 ELSE 0 END, 4) AS fp_more_pct, round(CASE WHEN c.fp + c.tn > 0 THEN (m.fp - c.fp) / (c.fp + c.tn) * 100 ELSE 0 END, 4) AS fp_rate_pct
FROM m JOIN m c ON c.detector = m.detector AND c.family = 'control'"""


def _pass(n: int, f: str, line_: str, along: str) -> str:
    return f"m{n + 1} AS (SELECT scene_id, y, x, {f}(m) OVER (PARTITION BY scene_id, {line_} ORDER BY {along} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM m{n})"


L1 = f"{WITH}m0 AS (SELECT scene_id, y, x, ({DIFF} >= 0.3::DOUBLE)::INT AS m FROM pixels), " + ", ".join(_pass(2 * i + j, f, *of) for i, f in enumerate(("max", "min", "min", "max")) for j, of in enumerate((("y", "x"), ("x", "y")))) + " SELECT scene_id, sum(m)::BIGINT AS set_pixels FROM m8 GROUP BY ALL"
_M3 = """a AS (SELECT scene_id, h, w, y, x, {u} AS u FROM pixels), d AS (SELECT scene_id, h, w, scene_id % 5 - 2 AS my, scene_id % 2 AS mx FROM (SELECT DISTINCT scene_id, h, w FROM pixels)),
src AS (SELECT a.scene_id, a.h, a.w, a.y, a.x, a.y - my AS sy, a.x - mx AS sx FROM a JOIN d USING (scene_id)),
b AS (SELECT src.scene_id, src.y, src.x, a.u AS v FROM src JOIN a ON a.scene_id = src.scene_id AND a.y = CASE WHEN sy < 0 THEN -1 - sy WHEN sy >= src.h THEN 2 * src.h - 1 - sy ELSE sy END AND a.x = CASE WHEN sx < 0 THEN -1 - sx WHEN sx >= src.w THEN 2 * src.w - 1 - sx ELSE sx END),
o AS (SELECT i - 2 AS dy, j - 2 AS dx FROM range(5) t(i), range(5) q(j)), c AS MATERIALIZED (SELECT scene_id, y + dy AS y, x + dx AS x, dy, dx, u FROM a, o), e AS (SELECT scene_id, dy, dx, round(avg(abs(u - v)), 9) AS err FROM c JOIN b USING (scene_id, y, x) GROUP BY ALL)
SELECT scene_id, dy, dx, err FROM e QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY err, abs(dy) + abs(dx), dy, dx) = 1"""
HEX2 = "printf('%02X%02X%02X', r2::INT, g2::INT, b2::INT)"
_PATCHES = "ph AS (SELECT DISTINCT scene_id, h, w, {rows} AS ny, {cols} AS nx FROM pixels), pk AS (SELECT *, unnest(range(nx)) AS kx FROM (SELECT *, unnest(range(ny)) AS ky FROM ph))"


def _several(key: str, names: list[tuple[str, str]], value: str, kind: str) -> str:
    return " UNION ALL ".join(f"SELECT scene_id, {name}::{kind} AS {key}, {value.format(source)} AS e FROM {source}" for name, source in names)


SHADES = " UNION ALL ".join(f"SELECT scene_id, 'shadow_{place}_{v}' AS cond, {DIFF} AS e FROM (SELECT {FIRST}, {shadow(k, place == 'seeded')} FROM shade)" for k, v in SHARES.items() for place in ("fixed", "seeded"))
def _index(i: int) -> str:
    r, g, b = (f"{c}{i}::DOUBLE / 255" for c in "rgb")
    return f"CASE WHEN abs({g} + {r} - {b}) < 1e-6 THEN 0 ELSE least(1, greatest(-1, ({g} - {r}) / ({g} + {r} - {b}))) END"


def _level(i: int) -> str:
    return f"(r{i} + g{i} + b{i}) / 765"


def _said(i: int, side: str) -> str:
    return f"round(CASE WHEN sd{i} < 1e-4 THEN 0 ELSE v{i} END, 6) AS vari_{side}, round(l{i}, 6) AS level_{side}, CASE WHEN sd{i} < 1e-4 THEN 'zero_variance' WHEN l{i} < 0.12 THEN 'dark' WHEN l{i} > 0.88 THEN 'bright' ELSE '' END AS note_{side}"


_DIMMED = ", ".join(f"CASE WHEN scene_id % 3 = 0 THEN {c}2 // 16 ELSE {c}2 END AS {c}2" for c in "rgb")
SQL = {
    "j18_gated_scores": f"{SIGNALS}, k AS (SELECT gamma, u = 1 AS with_margin, u FROM (SELECT unnest([0.0::DOUBLE, 0.3, 0.6]) AS gamma), (SELECT unnest([0, 1]) AS u)) SELECT scene_id, gamma, with_margin, round(avg({gated('gamma', FULL, 'CASE WHEN u = 1 THEN margin ELSE 1 END')}), 6) AS mean, round(max({gated('gamma', FULL, 'CASE WHEN u = 1 THEN margin ELSE 1 END')}), 6) AS most FROM signals, k GROUP BY ALL",
    "j19_evidence": f"{WITH}z AS (SELECT scene_id, r1, g1, b1, {_DIMMED} FROM pixels), e AS (SELECT scene_id, " + ", ".join(f"avg({_index(i)}) AS v{i}, avg({_level(i)}) AS l{i}, sqrt(greatest(0, avg((r{i} * r{i} + g{i} * g{i} + b{i} * b{i}) / 195075) - avg({_level(i)}) * avg({_level(i)}))) AS sd{i}" for i in (1, 2)) + f" FROM z GROUP BY scene_id) SELECT scene_id, {_said(1, 'before')}, {_said(2, 'after')} FROM e",
    "j4_ssim_dissimilarity": f"{WITH}{ssim('pixels', 'ss', '')} {means('ss', 'p')}",
    "j4_ssim_channels": f"{WITH}{', '.join(ssim('pixels', f's{c}', '', c) for c in 'rgb')} SELECT scene_id, round(avg((sr.p + sg.p + sb.p) / 3), 6) AS mean, round(max((sr.p + sg.p + sb.p) / 3), 6) AS most FROM sr JOIN sg USING (scene_id, y, x) JOIN sb USING (scene_id, y, x) GROUP BY scene_id",
    "j13_registration_discrepancy": f"{SIGNALS} {means('signals', 's_reg')}",
    "j14_illumination_box": f"{SIGNALS} {means('signals', 's_illum')}",
    "j14_illumination_discrepancy": f"{WITH}u AS (SELECT scene_id, avg({luma(1, SSIM_LUMA)}) OVER q AS u1, avg({luma(2, SSIM_LUMA)}) OVER q AS u2 FROM pixels WINDOW q AS (PARTITION BY scene_id, y ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) {means('u', 'abs(u1 - u2) / (u1 + u2 + 1e-4)')}",
    "j15_sharpness_discrepancy": f"{SIGNALS} {means('signals', 's_sharp')}",
    "j17_defect_index": f"{SIGNALS} {means('signals', FULL)}",
    "j8_blur": f"{WITH}bl0 AS (SELECT {AT}, {luma(2)} AS v, {luma(2)} AS u FROM pixels), " + ", ".join(separable("bl0", f"bl{s}", ["v"], ["u"], 4 * s, bell(s, 4 * s)) for s in (1, 2, 4)) + f", e AS ({_several('sigma', [(str(s), f'bl{s}') for s in (1, 2, 4)], 'abs(u - v)', 'INT')}) SELECT scene_id, sigma, round(avg(e), 6) AS mean, round(max(e), 6) AS most FROM e GROUP BY ALL",
    "j9_shift": f"{WITH}q AS (SELECT {AT}, {luma(1)} AS u, {luma(2)} AS v FROM pixels), e AS (" + " UNION ALL ".join(f"SELECT {k} AS shift, a.scene_id, abs(a.u - b.v) AS e FROM q a JOIN q b ON a.scene_id = b.scene_id AND b.y = {_moved('y', k)} AND b.x = {_moved('x', k)}" for k in (1, 3, 5)) + ") SELECT scene_id, shift, count(*) AS n, round(avg(e), 6) AS mean FROM e GROUP BY ALL",
    "j10_shadow": f"{WITH}{_boxes()}, e AS ({SHADES}) SELECT scene_id, cond, round(avg(e), 6) AS mean FROM e GROUP BY ALL",
    "d25_gate_diagnostics": f"{SIGNALS} SELECT scene_id, " + ", ".join(f"round(avg({s}), 6) AS {s}" for s in ("s_reg", "s_illum", "s_sharp", "margin")) + " FROM signals GROUP BY scene_id",
    "d11_gate_grid": f"{GRID} SELECT gamma, tau, tp, fp, fn, tn, f1 FROM best",
    "d28_gamma_sweep": f"{GRID} SELECT gamma, precision, recall, f1 FROM grid WHERE abs(tau - 0.45) < 1e-5",
    "d30_gating_ablation": f"{GRID}, ab AS (" + " UNION ALL ".join(f"SELECT '{n}' AS cond, gt, {hit} AS hit FROM signals, best b" for n, hit in ABLATION.items()) + f"), ac AS (SELECT cond, {COUNTS} FROM ab GROUP BY cond) SELECT *, {METRICS} FROM ac",
    "d20_robustness": D20,
    "l1_morphology": L1,
    "m3_estimate_shift": WITH + _M3.format(u=luma(1)),
    "k2_patches": WITH + _PATCHES.format(rows="CASE WHEN h < 24 THEN 1 ELSE ceil((h - 24) / 16)::INT + 1 END", cols="CASE WHEN w < 24 THEN 1 ELSE ceil((w - 24) / 16)::INT + 1 END")
    + f", c AS (SELECT pk.*, i, j, coalesce({HEX2}, '070707') AS v, coalesce(gt, 0) AS gt FROM pk, range(24) a(i), range(24) b(j) LEFT JOIN pixels p ON p.scene_id = pk.scene_id AND p.y = ky * 16 + i AND p.x = kx * 16 + j) SELECT scene_id, (ky * nx + kx)::INT AS patch, (ky * 16)::INT AS y, (kx * 16)::INT AS x, ky * 16 + 24 > h OR kx * 16 + 24 > w AS is_padded, sum(gt)::BIGINT AS changed, round(sum(gt) / 576, 6) AS share, md5(string_agg(v, '' ORDER BY i, j)) AS t2_md5 FROM c GROUP BY scene_id, h, w, ny, nx, ky, kx",
    "k3_reconstruct": f"{WITH}cv AS (SELECT DISTINCT scene_id, h, w, (h - 16) // 12 * 12 + 16 AS bottom, (w - 16) // 12 * 12 + 16 AS rgt FROM pixels WHERE h >= 16 AND w >= 16), f AS (SELECT p.scene_id, p.y, p.x, q.r2, q.g2, q.b2 FROM pixels p JOIN cv USING (scene_id) JOIN pixels q ON q.scene_id = p.scene_id AND q.y = least(p.y, bottom - 1) AND q.x = least(p.x, rgt - 1)) SELECT scene_id, (y // 32)::INT AS ty, (x // 32)::INT AS tx, md5(string_agg({HEX2}, '' ORDER BY y, x)) AS t2_md5 FROM f GROUP BY ALL",
    "k4_tiles_to_pixels": f"{WITH}z AS (SELECT 1) SELECT scene_id, count(*) AS n, " + ", ".join(f"sum({c} * (y * w + x))::BIGINT AS {c}" for c in ("r1", "g1", "b1", "r2", "g2", "b2", "gt")) + " FROM pixels GROUP BY scene_id",
    "k5_pixels_to_tiles": f"{WITH}t AS (SELECT scene_id, (y // 20)::INT AS ty, (x // 20)::INT AS tx, count(*)::INT AS n, string_agg(printf('%02X%02X%02X', r1, g1, b1), '' ORDER BY y, x) AS a, string_agg({HEX2}, '' ORDER BY y, x) AS b, string_agg(printf('%02X', gt), '' ORDER BY y, x) AS c FROM pixels GROUP BY ALL) SELECT scene_id, ty, tx, n, md5(a || b || c) AS md5 FROM t",
}
