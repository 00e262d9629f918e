"""Building blocks of the reference SQL: each view and formula once more, written
for a plain SQL engine and straight from the definitions (sums over pixels in
degrees, self-joins over image pairs, cross products of grid and events)."""

from __future__ import annotations

import re

from lumiray import constants as K


def lit(x: float) -> str:
    """A double literal, not a decimal."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def r(e: str, digits: int = 6) -> str:
    """Round half up; just below the half counts as half, see `tidy`."""
    return f"(floor(({e}) * 1e{digits} + 0.5001e0) / 1e{digits} + 0e0)"


def core(e: str, digits: int) -> str:
    """A core coordinate: beyond a hundred kilometres, where nearly parallel lines cross, three leading digits."""
    unit = f"(10e0 ** (floor(log10(abs({e}))) - 2))"
    return f"(CASE WHEN abs({e}) > 1e5 THEN floor({e} / {unit} + 0.5e0) * {unit} ELSE {r(e, digits)} END)"


def spread(e: str, x: str, y: str, digits: int) -> str:
    """The mean square distance of lines; of such a core in steps of 100."""
    return f"(CASE WHEN abs({x}) > 1e5 OR abs({y}) > 1e5 THEN floor({e} / 100 + 0.5e0) * 100 ELSE {r(e, digits)} END)"


def snap(e: str, noise: float = 2e-13) -> str:
    return f"(CASE WHEN abs({e}) < {noise} THEN 0e0 ELSE {e} END)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0e0))"


def root(e: str) -> str:
    return f"(CASE WHEN {e} >= 0 THEN sqrt(abs({e})) END)"


def pmod(e: str, m: str) -> str:
    return f"((({e}) % {m} + {m}) % {m})"


TWO_PI = "(2 * pi())"


def radec(x: str, y: str) -> tuple[str, str]:
    ra0, dec0 = f"radians({lit(K.POINTING_RA_DEG)})", f"radians({lit(K.POINTING_DEC_DEG)})"
    xi, eta = f"radians(-({y}))", f"radians({x})"
    den = f"(cos({dec0}) - {eta} * sin({dec0}))"
    ra = f"degrees({pmod(f'atan2({xi}, {den}) + {ra0}', TWO_PI)})"
    dec = f"degrees(atan2(sin({dec0}) + {eta} * cos({dec0}), sqrt({xi} * {xi} + {den} * {den})))"
    return ra, dec


def azze(x: str, y: str, az: str, ze: str) -> tuple[str, str]:
    xi, eta = f"radians(-({x}))", f"radians(-({y}))"
    el = f"radians(90e0 - ({ze}))"
    den = f"(cos({el}) - {eta} * sin({el}))"
    a = f"degrees({pmod(f'atan2({xi}, {den}) + radians({az})', TWO_PI)})"
    z = f"(90e0 - degrees(atan2(sin({el}) + {eta} * cos({el}), sqrt({xi} * {xi} + {den} * {den}))))"
    return a, z


def separation(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    p1, p2, d = f"radians({lat1})", f"radians({lat2})", f"radians({lon2} - {lon1})"
    a = f"(cos({p2}) * sin({d}))"
    b = f"(cos({p1}) * sin({p2}) - sin({p1}) * cos({p2}) * cos({d}))"
    c = f"(sin({p1}) * sin({p2}) + cos({p1}) * cos({p2}) * cos({d}))"
    return f"degrees(atan2(sqrt({a} * {a} + {b} * {b}), {c}))"


def axis_bin(x: str, lo: str, hi: str, n: str) -> str:
    """Cell of x by its edges lo + i * (hi - lo) / n, last cell closed."""
    step = f"(({hi} - {lo}) / {n})"
    g = f"least(floor(({x} - {lo}) * ({n} / nullif({hi} - {lo}, 0))), {n} - 1)"
    moved = (
        f"CASE WHEN {x} < {g} * {step} + {lo} THEN {g} - 1 "
        f"WHEN {g} < {n} - 1 AND {x} >= ({g} + 1) * {step} + {lo} THEN {g} + 1 ELSE {g} END"
    )
    return f"CAST(CASE WHEN {x} >= {lo} AND {x} <= {hi} THEN {moved} END AS INTEGER)"


def fixed_bin(x: str, lo: float, hi: float, n: int) -> str:
    return axis_bin(x, lit(lo), lit(hi), lit(n))


def surplus(x: str) -> str:
    series = "0e0"
    for k in range(10, 1, -1):
        series = f"({lit((-1 if k % 2 else 1) / (k * (k - 1)))} + x * {series})"
    term = f"CASE WHEN abs(x) < 0.01e0 THEN x * x * {series} WHEN x > -1 THEN (1 + x) * ln(1 + x) - x ELSE 1e0 END"
    return f"list_transform([{x}], lambda x: {term})[1]"


def li_ma(on: str, off: str, alpha: str) -> dict[str, str]:
    tot, sig = f"({on} + {off})", f"({on} - {alpha} * {off})"
    e_off = f"({tot} / (1 + {alpha}))"
    e_on, moved = f"({alpha} * {e_off})", f"({sig} / (1 + {alpha}))"
    both = f"({e_on} * {surplus(f'{moved} / nullif({e_on}, 0)')} + {e_off} * {surplus(f'(-{moved}) / nullif({e_off}, 0)')})"
    size = f"CASE WHEN {tot} = 0 THEN 0e0 ELSE sqrt(2 * {both}) END"
    return {
        "eq5": f"CASE WHEN {on} + {alpha} * {alpha} * {off} > 0 THEN {sig} / sqrt({on} + {alpha} * {alpha} * {off}) ELSE 0e0 END",
        "eq9": f"CASE WHEN {alpha} * {tot} > 0 THEN {sig} / sqrt({alpha} * {tot}) ELSE 0e0 END",
        "eq17": f"(CASE WHEN {sig} < 0 THEN -1 ELSE 1 END) * ({size})",
    }


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def sql(final: str, *needs: str, **local: str) -> str:
    """`final` behind the chain of views it needs; `local` adds views of its own."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({b})" for n, b in local.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + final


cte("hits", (), """
SELECT l_orderkey // 3 AS event, CAST(l_orderkey % 3 + 1 AS INTEGER) AS telescope,
  CAST(l_partkey % 32 AS INTEGER) AS px, CAST(l_suppkey % 32 AS INTEGER) AS py,
  CAST(l_quantity * 10 AS BIGINT) AS adu, l_shipdate FROM lineitem""")

cte("pixels", ("hits",), """
SELECT event, telescope, px, py, CAST(sum(adu) AS BIGINT) AS adu FROM hits GROUP BY event, telescope, px, py""")


def moments(source: str, x: str = "xd", y: str = "yd", keys: str = "event, telescope", pixel: str | None = None, noise: float = 2e-13) -> str:
    """Weighted moments per image from pixel positions in degrees."""
    pixel = pixel or (
        f"SELECT *, -4.95e0 + (px + 0.5e0) * {lit(K.PIXEL_DEG)} AS xd, -4.95e0 + (py + 0.5e0) * {lit(K.PIXEL_DEG)} AS yd FROM {source}"
    )
    sums = f"""
      SELECT {keys}, CAST(sum(adu) AS DOUBLE) AS s, sum(adu * {x}) / sum(adu) AS xm, sum(adu * {y}) / sum(adu) AS ym,
        sum(adu * {x} * {x}) / sum(adu) AS x2, sum(adu * {y} * {y}) / sum(adu) AS y2,
        sum(adu * {x} * {y}) / sum(adu) AS xy FROM ({pixel}) GROUP BY {keys}"""
    return f"""
      SELECT {keys}, s, {snap('xm', noise)} AS xm, {snap('ym', noise)} AS ym, {snap('(x2 - xm * xm)', noise)} AS vx,
        {snap('(y2 - ym * ym)', noise)} AS vy, {snap('(xy - xm * ym)', noise)} AS vxy FROM ({sums})"""


def parameters(source: str, keys: str = "event, telescope", digits: int = 6, noise: float = 2e-13) -> str:
    """Image parameters from moments, by the closed formulas."""
    stage1 = f"SELECT *, vy - vx AS d, sqrt((vy - vx) * (vy - vx) + 4 * vxy * vxy) AS z, sqrt(xm * xm + ym * ym) AS dist FROM ({source})"
    stage2 = f"""SELECT *, {snap('((d + z) * ym + 2 * vxy * xm)', noise)} AS ac, {snap('(2 * vxy * ym - (d - z) * xm)', noise)} AS bc FROM ({stage1})"""
    stage3 = f"SELECT *, sqrt(ac * ac + bc * bc) AS cc FROM ({stage2})"
    stage4 = f"""SELECT *, CASE WHEN cc <> 0 THEN least(abs(-ac / cc * xm + bc / cc * ym), dist) END AS miss,
      CASE WHEN bc = 0 AND ac <> 0 THEN sign(ac) * pi() / 2 WHEN bc <> 0 THEN atan(ac / bc) END AS slope,
      {snap('((vx + vy - z) / 2)', noise)} AS w2,
      CASE WHEN dist <> 0 THEN {snap('((xm * xm * (vy + ym * ym) - 2 * xm * ym * (vxy + xm * ym) + (vx + xm * xm) * ym * ym) / (dist * dist))', noise)} END AS a2
      FROM ({stage3})"""
    phi = pmod("slope", TWO_PI)
    return f"""
      SELECT {keys}, {r('xm', digits)} AS "MeanX", {r(root('vx'), digits)} AS "StdX", {r('ym', digits)} AS "MeanY",
        {r(root('vy'), digits)} AS "StdY", {r(f'degrees({phi})', digits)} AS "Phi", {r('s', digits)} AS "Size",
        {r('sqrt((vx + vy + z) / 2)', digits)} AS "Length", {r(root('w2'), digits)} AS "Width",
        {r('miss', digits)} AS "Miss", {r('dist', digits)} AS "Distance", {r(root('a2'), digits)} AS "Azwidth",
        {r('degrees(asin(CASE WHEN dist <> 0 AND miss IS NOT NULL THEN least(miss / dist, 1e0) END))', digits)} AS "Alpha" FROM ({stage4})"""


SHAPES = '"MeanX", "StdX", "MeanY", "StdY", "Phi", "Size", "Length", "Width", "Miss", "Distance", "Azwidth", "Alpha"'

cte("params", ("pixels",), parameters(moments("pixels")))
cte("first_hit", ("hits",), "SELECT event, telescope, min(l_shipdate) AS first_ FROM hits GROUP BY event, telescope")
cte("hub", ("params", "first_hit"), f"""
SELECT 'run' || CAST(event % 5 AS VARCHAR) AS "File", event AS "In_file_Index", event AS "Event", telescope AS "Telescope",
  CAST(epoch(first_) AS DOUBLE) + event % 600 AS "Timestamp", {SHAPES} FROM params JOIN first_hit USING (event, telescope)""")
cte("usable", ("hub",), """
SELECT * FROM hub WHERE "Length" IS NOT NULL AND "Width" IS NOT NULL AND "Miss" IS NOT NULL AND "Distance" IS NOT NULL
  AND "Azwidth" IS NOT NULL AND "Alpha" IS NOT NULL AND "Width" > 0""")
cte("usable2", ("usable",), """
SELECT * FROM usable WHERE "Event" IN (SELECT "Event" FROM usable GROUP BY "Event" HAVING count(*) >= 2)""")


def pair_directions(images: str) -> str:
    """Mean of the pairwise axis crossings per event, over a self-join of its images."""
    fold = f"radians(90e0 - {pmod('90e0 - Phi', '180e0')})"
    prepared = f"""SELECT *, {fold} AS f, 1 - CASE WHEN "Length" > 0 THEN "Width" / "Length" ELSE 1e0 END AS e FROM {images}"""
    crossings = f"""
      SELECT a."Event", sin(b.f - a.f) AS sd, a."MeanX" AS xa, a."MeanY" AS ya, a.f AS fa, abs(degrees(b.f - a.f)) AS gap,
        (b."MeanX" - a."MeanX") * sin(b.f) - (b."MeanY" - a."MeanY") * cos(b.f) AS reach,
        1 / (1 / a."Size" + 1 / b."Size") * a.e * b.e AS g
      FROM ({prepared}) a JOIN ({prepared}) b ON a."Event" = b."Event" AND a."Telescope" < b."Telescope" """
    points = f"""
      SELECT "Event", gap, g * g * sd * sd AS w,
        CASE WHEN sd <> 0 THEN xa + reach / nullif(sd, 0) * cos(fa) ELSE 0 END AS xs,
        CASE WHEN sd <> 0 THEN ya + reach / nullif(sd, 0) * sin(fa) ELSE 0 END AS ys FROM ({crossings})"""
    return f"""
      SELECT "Event", sum(xs * w) / sum(w) AS "Xoffset", sum(ys * w) / sum(w) AS "Yoffset",
        CASE WHEN count(*) = 1 THEN -max(gap) ELSE avg(CASE WHEN gap < 90 THEN gap ELSE 180 - gap END) END AS "MeanAngle"
      FROM ({points}) GROUP BY "Event" HAVING sum(w) > 0 AND count(w) = count(*)"""


cte("dirs", ("usable",), pair_directions("usable"))
cte("admitted", ("hub",), 'SELECT * FROM hub WHERE "Size" > 0 AND "Length" IS NOT NULL AND "Width" IS NOT NULL')
cte("simdirs", ("admitted",), pair_directions("admitted"))

cte("shower", (), """
SELECT o_orderkey // 3 AS event, max(o_totalprice) / 5e0 AS energy, CAST(min(o_custkey) % 360 AS DOUBLE) AS az,
  CAST(max(o_custkey) % 41 AS DOUBLE) / 20e0 AS ze, CAST(min(o_custkey) % 301 - 150 AS DOUBLE) AS xcore,
  CAST(max(o_custkey) % 301 - 150 AS DOUBLE) AS ycore FROM orders GROUP BY o_orderkey // 3""")
_AZ = pmod(f"pi() - {pmod('radians(az) - pi()', TWO_PI)}", TWO_PI)
cte("truth", ("shower",), f"""
SELECT event AS "Event", degrees({_AZ}) + 12.77e0 AS "TrueAz", ze AS "TrueZe", -ycore AS "TrueXcore", xcore AS "TrueYcore",
  energy AS "TrueEnergy" FROM shower""")
cte("classes", (), """
SELECT o_orderkey // 3 AS "Event", CASE WHEN bool_or(o_orderstatus = 'F') THEN 'gamma' ELSE 'proton' END AS class
FROM orders GROUP BY o_orderkey // 3""")
cte("labelled", ("usable", "classes"), 'SELECT * FROM usable JOIN classes USING ("Event")')
cte("labelled2", ("usable2", "classes"), 'SELECT * FROM usable2 JOIN classes USING ("Event")')

_az, _ze = azze('"Xoffset"', '"Yoffset"', '"TrueAz"', '"TrueZe"')
cte("aimed", ("simdirs", "truth"), f'SELECT *, {_az} AS "Az", {_ze} AS "Ze" FROM simdirs JOIN truth USING ("Event")')


def _tel(axis: int) -> str:
    return "CASE " + " ".join(f'WHEN "Telescope" = {t} THEN {lit(p[axis])}' for t, p in K.DATA_TELESCOPES.items()) + " END"


def small(e: str, eps: str = "1e-5") -> str:
    return f"(CASE WHEN abs({e}) < {eps} THEN 0e0 ELSE {e} END)"


_lines = f"""
SELECT "Event", "Az", "Ze", "TrueAz", "TrueZe", {_tel(0)} AS tx, {_tel(1)} AS ty, "Size", "Width", "Length", "MeanX", "MeanY", "Xoffset", "Yoffset",
  sin(radians("TrueZe")) * sin(radians("TrueAz" - 180)) AS cx, sin(radians("TrueZe")) * cos(radians("TrueAz" - 180)) AS cy
FROM aimed JOIN admitted USING ("Event") WHERE "Length" > 0"""
_lines = f"SELECT *, sqrt(cx * cx + cy * cy) AS sv, -sqrt(greatest(1 - cx * cx - cy * cy, 0e0)) AS cz FROM ({_lines})"
_lines = f"""SELECT *, {small('(CASE WHEN sv > 1e-9 THEN (-cy * tx + cx * ty) / sv ELSE tx END)')} AS xr,
  {small('(CASE WHEN sv > 1e-9 THEN cz * (cx * tx + cy * ty) / sv ELSE ty END)')} AS yr,
  {small('(CASE WHEN sv > 1e-9 THEN -cx * tx - cy * ty ELSE 0e0 END)')} AS zr FROM ({_lines})"""
_lines = f"""SELECT "Event", "Az", "Ze", "TrueAz", "TrueZe", xr - radians("Xoffset") * zr AS lx, yr - radians("Yoffset") * zr AS ly,
  ("Size" * (1 - "Width" / "Length")) ** 2 AS w,
  CASE WHEN "MeanX" <> "Xoffset" THEN ("Yoffset" - "MeanY") / ("MeanX" - "Xoffset") ELSE 1e9 END AS m FROM ({_lines})"""
cte("lines", ("aimed", "admitted"), _lines)
_fit = """SELECT "Event", count(*) AS n_lines, sum(w * m * m / (1 + m * m)) / sum(w) AS a1, sum(-w * m / (1 + m * m)) / sum(w) AS b1,
  sum(w / (1 + m * m)) / sum(w) AS b2, sum(w * (ly - m * lx) * m / (1 + m * m)) / sum(w) AS c1,
  sum(-w * (ly - m * lx) / (1 + m * m)) / sum(w) AS c2 FROM lines GROUP BY "Event" """
cte("fits", ("lines",), f"""
SELECT "Event", n_lines, CASE WHEN n_lines >= 2 AND a1 * b2 - b1 * b1 > 0 THEN (b1 * c2 - c1 * b2) / nullif(a1 * b2 - b1 * b1, 0) END AS xfit,
  CASE WHEN n_lines >= 2 AND a1 * b2 - b1 * b1 > 0 THEN (b1 * c1 - a1 * c2) / nullif(a1 * b2 - b1 * b1, 0) END AS yfit FROM ({_fit})""")
cte("cores", ("lines", "fits"), f"""
SELECT "Event", any_value("Az") AS "Az", any_value("Ze") AS "Ze", any_value("TrueAz") AS "TrueAz", any_value("TrueZe") AS "TrueZe",
  any_value(n_lines) AS n_lines, any_value(xfit) AS xfit, any_value(yfit) AS yfit,
  sum(w * (cos(atan(m)) * (yfit - ly) - sin(atan(m)) * (xfit - lx)) ** 2) / sum(w) AS "stdP"
FROM lines JOIN fits USING ("Event") GROUP BY "Event" """)
_gr = f"""SELECT *, CASE WHEN "Ze" <> 0 THEN yfit / tan(radians(90 - "Ze")) ELSE 0e0 END AS zfit,
  {small('(sin(radians("TrueZe")) * sin(radians("TrueAz" - 180)))', '1e-7')} AS cx,
  {small('(sin(radians("TrueZe")) * cos(radians("TrueAz" - 180)))', '1e-7')} AS cy FROM cores"""
_gr = f"SELECT *, sqrt(cx * cx + cy * cy) AS sv, -sqrt(greatest(1 - cx * cx - cy * cy, 0e0)) AS cz FROM ({_gr})"
cte("ground", ("cores",), f"""
SELECT "Event", "Az", "Ze", "stdP", xfit, yfit, n_lines,
  {small('(CASE WHEN sv > 1e-9 THEN -cy / sv * xfit + cz * cx / sv * yfit - cx * zfit ELSE xfit END)')} AS "Xcore",
  {small('(CASE WHEN sv > 1e-9 THEN cx / sv * xfit + cz * cy / sv * yfit - cy * zfit ELSE yfit END)')} AS "Ycore" FROM ({_gr})""")
cte("sim", ("hub", "truth", "ground", "aimed"), f"""
SELECT h.*, a."Az", a."Ze", g."Xcore", g."Ycore", g."stdP", t."TrueAz", t."TrueZe", t."TrueXcore", t."TrueYcore", t."TrueEnergy"
FROM hub h JOIN truth t USING ("Event") LEFT JOIN aimed a USING ("Event") LEFT JOIN ground g USING ("Event")""")

# the same views where images of a telescope repeat and events may have no truth; k orders an event's images
cte("many", (), parameters(moments("(SELECT l_orderkey AS event, CAST(l_orderkey % 4 + 1 AS INTEGER) AS telescope, CAST(l_partkey % 32 AS INTEGER) AS px, "
    "CAST(l_suppkey % 32 AS INTEGER) AS py, CAST(sum(CAST(l_quantity * 10 AS BIGINT)) AS BIGINT) AS adu FROM lineitem GROUP BY ALL)")))
CTES["many"] = ((), f'SELECT event // 4 AS "Event", event AS k, telescope AS "Telescope", {SHAPES} FROM ({CTES["many"][1]})')
_CHAIN = {"hub": "many", "admitted": "admitted_many", "simdirs": "simdirs_many", "aimed": "aimed_many", "lines": "lines_many", "fits": "fits_many",
          "cores": "cores_many", "ground": "ground_many", "sim": "sim_many"}
for _old, _new in list(_CHAIN.items())[1:]:
    _needs, _body = CTES[_old]
    for _a, _b in _CHAIN.items():
        _body = re.sub(rf"(FROM|JOIN) {_a}\b", rf"\1 {_b}", _body)
    _body = _body.replace('a."Telescope" < b."Telescope"', "a.k < b.k").replace('WHERE "Length" > 0', 'WHERE "Length" > 0 AND "Telescope" <= 3')
    _body = _body.replace('JOIN truth t USING', 'LEFT JOIN truth t USING').replace("SELECT h.*,", "SELECT h.* EXCLUDE (k),")
    cte(_new, tuple(_CHAIN.get(n, n) for n in _needs), _body)

_RA, _DEC = radec('"MeanX"', '"MeanY"')
cte("skyimages", ("usable",), f'SELECT "Event", {_RA} AS mx, {_DEC} AS my FROM usable')
_RA2, _DEC2 = radec('"Xoffset"', '"Yoffset"')
cte("skydirs", ("dirs",), f'SELECT *, {_RA2} AS "RA", {_DEC2} AS "DEC" FROM dirs')


def _edge(centre: float, i: str) -> str:
    start = centre - K.MAP_HALF_WIDTH_DEG
    delta = (start + K.MAP_STEP_DEG) - start
    return f"({lit(start)} + {i} * {lit(delta)})"


def test_x(i: str) -> str:
    return f"({_edge(K.POINTING_RA_DEG, i)} + {lit(K.MAP_STEP_DEG / 2)})"


def test_y(j: str) -> str:
    return f"({_edge(K.POINTING_DEC_DEG, j)} + {lit(K.MAP_STEP_DEG / 2)})"


def off_x(i: str) -> str:
    return f"(({_edge(K.POINTING_RA_DEG, i)} + {_edge(K.POINTING_RA_DEG, f'({i} + 1)')}) / 2)"


def off_y(j: str) -> str:
    return f"(({_edge(K.POINTING_DEC_DEG, j)} + {_edge(K.POINTING_DEC_DEG, f'({j} + 1)')}) / 2)"


cte("grid", (), f"""
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {test_x('i')} AS x, {test_y('j')} AS y
FROM range(50) a(i), range(50) b(j)""")
cte("regions", (), f"""
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {off_x('i')} AS x, {off_y('j')} AS y
FROM range(5, 49, 4) a(i), range(5, 49, 4) b(j)""")

TH2, MXD = lit(K.THETA_CUT_DEG**2), lit(K.MAX_DISTANCE_CUT_DEG)


def counts(points: str, extra: str = "i, j, x, y") -> str:
    """Accepted events about each point, by comparing all events with all points."""
    return f"""
      SELECT {extra}, CAST(coalesce(n, 0) AS BIGINT) AS n FROM {points} LEFT JOIN (
        SELECT i, j, count(*) AS n FROM (
          SELECT p.i, p.j, d."Event", max(sqrt((s.mx - p.x) ** 2 + (s.my - p.y) ** 2)) AS far
          FROM {points} p JOIN skydirs d ON (d."RA" - p.x) ** 2 + (d."DEC" - p.y) ** 2 < {TH2}
          JOIN skyimages s ON s."Event" = d."Event" GROUP BY p.i, p.j, d."Event") WHERE far < {MXD} GROUP BY i, j)
      USING (i, j)"""


cte("oncounts", ("grid", "skydirs", "skyimages"), counts("grid"))
cte("offcounts", ("regions", "skydirs", "skyimages"), counts("regions"))
OUTSIDE = "(r.x < g.x - 1.4e0 OR r.x > g.x + 1.4e0 OR r.y < g.y - 1.4e0 OR r.y > g.y + 1.4e0)"
cte("onoff", ("oncounts", "offcounts"), f"""
SELECT g.i, g.j, g.x AS "testPosX", g.y AS "testPosY", g.n AS n_on, CAST(sum(r.n) AS BIGINT) AS n_off_events,
  count(*) AS n_off, 1e0 / count(*) AS alpha
FROM oncounts g JOIN offcounts r ON {OUTSIDE} GROUP BY g.i, g.j, g.x, g.y, g.n""")
_s = li_ma("CAST(n_on AS DOUBLE)", "CAST(n_off_events AS DOUBLE)", "alpha")
cte("sigmap", ("onoff",), f"""
SELECT *, {_s['eq17']} AS s17, {_s['eq9']} AS s9, {_s['eq5']} AS s5, n_on - alpha * n_off_events AS excess FROM onoff""")

cte("series", (), """
SELECT event_id AS "Event", CAST(user_id % 3 + 1 AS INTEGER) AS "Telescope", epoch_us(ts) / 1e6 AS "Timestamp",
  value AS "Width", value * 10 + 1 AS "Size" FROM events""")
cte("patches", (), """
SELECT vec_id, label, CAST(c AS INTEGER) AS cell, CAST(trunc(CAST(embedding[c + 1] AS DOUBLE) * 1000) AS INTEGER) AS adu
FROM embeddings, range(64) t(c)""")
