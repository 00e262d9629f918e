"""Every operator as a query over the star-schema tables, with its SQL where a plain
SQL engine can say the same. Names lead with the operator's number in the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiray import constants as K
from lumiray.functions import angles
from lumiray.functions import statistics as st
from lumiray.functions.numeric import tidy
from lumiray.operators import classify, performance, pointing, psf, quality, selection, sky, stats, stereo
from lumiray.operators import images as I
from lumiray.operators import parameters as P
from lumiray.plans import flows
from lumiray.plans.oracle import (
    SHAPES, TWO_PI, axis_bin, core, div, fixed_bin, lit, moments, parameters, pmod, r, separation, spread, sql,
)
from lumiray.plans.star import POSITIONS, TASK_PACKETS, Star
from lumiray.schemas import DATA_COLUMNS, SHAPE_COLUMNS
from lumiray.session import cut_lineage, ship_package, shared_folder
from lumiray.sources import capture, pcapng, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register `f(star) -> DataFrame` under `name`."""

    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return f(Star(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = " ".join(oracle.split())
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = tidy(c, special.get(f.name, digits))
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded_cores(df: DataFrame, digits: int, x: str = "Xcore", y: str = "Ycore", **special: int) -> DataFrame:
    """The same for tables with cores. Beyond a hundred kilometres, where nearly parallel lines cross, three leading
    digits of a coordinate are compared, and the lines' mean square distance in steps of 100."""
    far = (F.abs(x) > 1e5) | (F.abs(y) > 1e5)

    def leading(c: str) -> Column:
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - 2)
        return F.when(F.abs(c) > 1e5, F.floor(F.col(c) / unit + 0.5) * unit).otherwise(tidy(F.col(c), digits))

    change = {c: leading(c) for c in (x, y)}
    if "stdP" in df.columns:
        change["stdP"] = F.when(far, F.floor(F.col("stdP") / 100 + 0.5) * 100.0).otherwise(tidy(F.col("stdP"), digits))
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[(change[c] if c in change else tidy(F.col(c), special.get(c, 6)) if c in doubles else F.col(c)).alias(c) for c in df.columns])


# ---------------------------------------------------------------- captures
FRAMES = """SELECT 'capture' || CAST(event_id // 1000 AS VARCHAR) AS file, event_id AS seq, epoch_us(ts) / 1e6 AS t,
  event_type = 'error' AS short, user_id, event_id FROM events"""


@query("src1_capture_files", sql("""
SELECT CAST(seq % 1000 AS BIGINT) AS number, CAST(floor(t) AS BIGINT) AS ts_sec, CAST(round((t - floor(t)) * 1e6) AS INTEGER) AS ts_usec,
  CAST(CASE WHEN short THEN 60 ELSE 570 END AS INTEGER) AS caplen, file FROM frames""", frames=FRAMES))
def _(s: Star):
    folder = shared_folder(s.spark)
    written = capture.write_files(s.captures(), folder, ".pcap")
    # the list of files is short; reading starts when all are there
    paths = [r["path"] for r in written.collect()]
    name = F.regexp_extract("file", r"([^/]+)\.pcap$", 1)
    return capture.read_captures(s.spark, paths).select(F.col("seq").alias("number"), "ts_sec", "ts_usec", "caplen", name.alias("file"))


@query("src1_ng_capture_files", sql("""
SELECT CAST(seq % 1000 AS BIGINT) AS number, CAST(floor(t) AS BIGINT) AS ts_sec, CAST(round((t - floor(t)) * 1e6) AS INTEGER) AS ts_usec,
  CAST(CASE WHEN short THEN 60 ELSE 570 END AS INTEGER) AS caplen, file FROM frames""", frames=FRAMES))
def _(s: Star):
    folder = shared_folder(s.spark)
    written = capture.write_files(s.ng_captures(), folder, ".pcapng")
    # the list of files is short; reading starts when all are there
    paths = [r["path"] for r in written.collect()]
    name = F.regexp_extract("file", r"([^/]+)\.pcapng$", 1)
    return pcapng.read_ng(s.spark, paths, range_bytes=1 << 17).select(F.col("seq").alias("number"), "ts_sec", "ts_usec", "caplen", name.alias("file"))


@query("src1_capture_scan", sql("""
SELECT file, CAST(seq % 1000 AS BIGINT) AS seq, CAST(floor(t) AS BIGINT) AS ts_sec,
  CAST(round((t - floor(t)) * 1e6) AS INTEGER) AS ts_usec, CAST(CASE WHEN short THEN 60 ELSE 570 END AS INTEGER) AS caplen
FROM frames""", frames=FRAMES))
def _(s: Star):
    return capture.frame_contents(s.captures()).drop("data", "start_time")


@query("src2_src6_packet_counts", sql("""
SELECT file, count(*) AS n_read, count(*) FILTER (NOT short) AS n_stored FROM frames GROUP BY file""", frames=FRAMES))
def _(s: Star):
    return capture.packet_counts(s.frames())


@query("src3_src5_payload_decode", sql(f"""
SELECT file, seq, CAST(256 AS INTEGER) AS npix, CAST(user_id % 256 AS INTEGER) AS acq_mode, CAST(2 AS INTEGER) AS packer_ver,
  CAST(event_id % 65536 AS INTEGER) AS packet_no, CAST(user_id % 1024 AS INTEGER) AS boardloc,
  CAST(event_id * 65537 % 4294967296 AS BIGINT) AS "TAI", CAST(event_id * 99991 % 1000000000 AS BIGINT) AS nanosec,
  {r('(event_id * 65537 % 4294967296) + (event_id * 99991 % 1000000000) / 1e9')} AS "WR_time", CAST(0 AS INTEGER) AS dummy,
  CAST(p.u AS BIGINT) AS unsigned_sum, CAST(p.g AS BIGINT) AS signed_sum, CAST(p.last AS INTEGER) AS last_unsigned
FROM frames JOIN (
  SELECT event_id, sum(v) AS u, sum(CASE WHEN v >= 32768 THEN v - 65536 ELSE v END) AS g, max(CASE WHEN k = 255 THEN v END) AS last
  FROM (SELECT event_id, k, (event_id * 7 + k * 257) % 65536 AS v FROM events, range(256) t(k)) GROUP BY event_id) p USING (event_id)
WHERE NOT short""", frames=FRAMES))
def _(s: Star):
    d = capture.decode_packets(s.frames())
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rounded(
        d.select(
            "file", "seq", "npix", "acq_mode", "packer_ver", "packet_no", "boardloc", "TAI", "nanosec", "WR_time", "dummy",
            total("pix_data_unsigned").alias("unsigned_sum"), total("pix_data_signed").alias("signed_sum"),
            F.col("pix_data_unsigned")[255].alias("last_unsigned"),
        )
    )


@query("src4_capture_time", sql(f"""
SELECT file, seq, {r('t')} AS pcap_time, {r('t - first_value(t) OVER (PARTITION BY file ORDER BY seq)', 5)} AS pcap_time_since_start
FROM frames""", frames=FRAMES))
def _(s: Star):
    timed = capture.with_capture_time(s.frames())
    return rounded(timed.select("file", "seq", "pcap_time", "pcap_time_since_start"), pcap_time_since_start=5)


@query("snk1_decoded_packets", sql("""
SELECT file, count(*) AS n, CAST(sum(event_id % 65536) AS BIGINT) AS packet_numbers FROM frames WHERE NOT short GROUP BY file""",
frames=FRAMES))
def _(s: Star):
    path = shared_folder(s.spark)
    sinks.write_packets(capture.decode_packets(capture.with_capture_time(s.frames(TASK_PACKETS))), path)
    back = s.spark.read.parquet(path)
    return back.groupBy(F.col("file").cast("string").alias("file")).agg(
        F.count("*").alias("n"), F.sum("packet_no").alias("packet_numbers")
    )


# ------------------------------------------------------------ parameter files
@query("src10_src11_snk2_parameter_files", sql(f"""
SELECT h."File", h."In_file_Index", h."Event" + coalesce(b.before, 0) AS "Event", "Telescope", {r('"Timestamp"')} AS "Timestamp", {SHAPES}
FROM hub h JOIN (SELECT "File", CAST(sum(count(*)) OVER (ORDER BY "File" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before
  FROM hub GROUP BY "File") b USING ("File")""", "hub"))
def _(s: Star):
    folder = shared_folder(s.spark)
    named = s.hub().withColumn("night", F.concat("File", F.lit("_Crab.corrected.csv")))
    sinks.write_data_parameters(named, folder, partition="night")
    rows = tables.read_parameter_csv(s.spark, f"{folder}/*", contains=("Crab", "corrected"))
    base = F.element_at(F.split("path", "/"), -2)
    whole = F.regexp_replace(base, "^night=", "")
    one_file = rows.withColumn("path", whole)
    return rounded(quality.global_event_ids(one_file, "path", F.substring_index("path", "_", 1)))


@query("src10_headers_by_file", sql(f"""
SELECT "Event", "Telescope", {r('"Timestamp"')} AS "Timestamp", {SHAPES}, CAST("File" IN ('run1', 'run3') AS INTEGER) AS reordered FROM hub""", "hub"))
def _(s: Star):
    # two ways to order the columns, and one more column, in the files of one folder
    folder = shared_folder(s.spark)
    hub = cut_lineage(s.hub())
    other = F.col("File").isin("run1", "run3")
    sinks.write_data_parameters(hub.filter(~other), folder)
    changed = hub.filter(other).withColumn("note", F.concat(F.lit("Telescope "), "Telescope"))
    changed.select("note", *reversed(DATA_COLUMNS)).write.mode("append").option("header", True).option("nullValue", "nan").csv(folder)
    rows = tables.read_parameter_csv(s.spark, folder, columns=DATA_COLUMNS)
    first = s.spark.read.text(folder).filter(F.col("value").startswith("note,")).select(F.col("_metadata.file_path").alias("path")).distinct()
    marked = rows.join(first.withColumn("reordered", F.lit(1)), "path", "left")
    return rounded(marked.select(*DATA_COLUMNS, F.coalesce("reordered", F.lit(0)).alias("reordered")))


@query("src7_src8_img1_pedestals", sql("""
SELECT vec_id, CAST(sum(abs(v)) AS BIGINT) AS total, CAST(count(*) FILTER (v <> 0) AS BIGINT) AS lit, CAST(min(v) AS INTEGER) AS low,
  CAST(max(v) AS INTEGER) AS high FROM (
  SELECT p.vec_id, CASE WHEN p.label > 0 THEN CAST(trunc(p.adu - m.ped) AS INTEGER) ELSE 0 END AS v
  FROM patches p JOIN peds m ON p.label = m.label AND p.cell = m.cell) GROUP BY vec_id""", "patches",
peds="SELECT label, cell, avg(adu) AS ped FROM patches GROUP BY label, cell"))
def _(s: Star):
    cells = s.patches().select("label", F.posexplode("pix").alias("cell", "adu"))
    mean = cells.groupBy("label", "cell").agg(F.avg("adu").alias("ped"))
    # 64 cells per map
    maps = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("cell", "ped"))).alias("m"))
    peds = maps.select(F.col("label").alias("scope_id"), F.lit("all").alias("file"), F.transform("m", lambda c: c["ped"]).alias("peds"))
    events = s.patches().select("vec_id", F.lit("all").alias("file"), F.col("label").alias("scope_id"), "pix")
    out = I.subtract_pedestals(events, peds)
    return out.select(
        "vec_id",
        F.aggregate(F.transform("image", lambda v: F.abs(v)), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
        I.lit_pixels(F.col("image")).cast("bigint").alias("lit"),
        F.array_min("image").alias("low"),
        F.array_max("image").alias("high"),
    )


@query("src9_telescopes_per_event", sql("SELECT event, count(DISTINCT telescope) AS n_tel FROM hits GROUP BY event", "hits"))
def _(s: Star):
    return tables.telescopes_per_event(s.hits())


@query("src12_text_parsing", """
SELECT event_id AS "Event", CAST(user_id AS INTEGER) AS "Telescope",
  CASE WHEN event_type IN ('error', 'view') THEN NULL WHEN event_type = 'click' THEN CAST('inf' AS DOUBLE) ELSE value END AS "Width" FROM events""")
def _(s: Star):
    kind = F.col("event_type")
    text = F.when(kind == "error", "nan").when(kind == "view", "-nan").when(kind == "click", "inf").otherwise(F.col("value").cast("string"))
    raw = s.table("events").select(
        F.col("event_id").cast("string").alias("Event"), F.col("user_id").cast("string").alias("Telescope"), text.alias("Width")
    )
    return tables.parse_parameters(raw, ["Event", "Telescope", "Width"])


@query("snk3_sim_parameters", sql(f"""
SELECT "Event", "Telescope", {SHAPES}, {r('"Az"')} AS "Az", {r('"Ze"')} AS "Ze", {core('"Xcore"', 2)} AS "Xcore", {core('"Ycore"', 2)} AS "Ycore",
  {spread('"stdP"', '"Xcore"', '"Ycore"', 2)} AS "stdP", {r('"TrueAz"')} AS "TrueAz", {r('"TrueZe"')} AS "TrueZe", {r('"TrueXcore"')} AS "TrueXcore",
  {r('"TrueYcore"')} AS "TrueYcore", {r('"TrueEnergy"')} AS "TrueEnergy" FROM sim""", "sim"))
def _(s: Star):
    return rounded_cores(s.sim().select(*sinks.SIM_RECO_COLUMNS), 2)


@query("dir1_repeated_telescopes", sql(f"""
SELECT "Event", {r('"Xoffset"', 4)} AS "Xoffset", {r('"Yoffset"', 4)} AS "Yoffset", {r('"MeanAngle"', 4)} AS "MeanAngle" FROM simdirs_many""", "simdirs_many"))
def _(s: Star):
    found = stereo.directions(stereo.reconstructible(s.many()))
    return rounded(found.select("Event", "Xoffset", "Yoffset", "MeanAngle"), 4)


@query("snk3_repeated_telescopes", sql(f"""
SELECT "Event", "Telescope", {SHAPES}, {r('"Az"', 4)} AS "Az", {r('"Ze"', 4)} AS "Ze", {core('"Xcore"', 1)} AS "Xcore", {core('"Ycore"', 1)} AS "Ycore",
  {spread('"stdP"', '"Xcore"', '"Ycore"', 1)} AS "stdP", {r('"TrueAz"')} AS "TrueAz", {r('"TrueZe"')} AS "TrueZe", {r('"TrueXcore"')} AS "TrueXcore",
  {r('"TrueYcore"')} AS "TrueYcore", {r('"TrueEnergy"')} AS "TrueEnergy" FROM sim_many""", "sim_many"))
def _(s: Star):
    table = flows.sim_parameters(s.many(), s.truth(), POSITIONS)
    return rounded_cores(table, 1, Az=4, Ze=4)


@query("snk4_pixel_matrix", sql(f"""
SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f'CAST(sum(p{k}) AS BIGINT) AS p{k}' for k in range(64))} FROM (
  SELECT vec_id, {', '.join(f'max(CASE WHEN cell = {k} THEN v END) AS p{k}' for k in range(64))}
  FROM (SELECT vec_id, cell, greatest(adu, 0) AS v FROM patches WHERE label = 2) GROUP BY vec_id HAVING sum(v) <> 0)""", "patches"))
def _(s: Star):
    images = s.patches().select(F.col("label").alias("telescope"), I.suppress_negative(F.col("pix")).alias("image"))
    folder = shared_folder(s.spark)
    sinks.write_pixel_matrix(images, folder, telescope=2, side=8)
    names = [f"p{k}" for k in range(64)]
    back = s.spark.read.schema(", ".join(f"{c} bigint" for c in names)).csv(folder)
    return back.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])


@query("snk5_centroid_triples", sql(f"""
SELECT "Event", CAST(-13 AS INTEGER) AS mark1, CAST(-18 AS INTEGER) AS mark2,
  {', '.join(f'max(CASE WHEN "Telescope" = {t} THEN {r(e)} END) AS {c}{t}' for t in (1, 2, 3) for c, e in (('mx', '"MeanX"'), ('my', '"MeanY"'), ('phi', 'radians("Phi")')))}
FROM hub GROUP BY "Event" HAVING count(DISTINCT CASE WHEN "Size" >= 100 THEN "Telescope" END) = 3""", "hub"))
def _(s: Star):
    return rounded(sinks.centroid_triples(s.hub()))


# ------------------------------------------------------------------- images
def _cells(df: DataFrame, side: int, keys=("event", "telescope"), column: str = "image") -> DataFrame:
    return I.pixels_from_images(df, keys, column, side)


_STENCIL = """
SELECT u * 5 + v AS sub, CAST(floor((u + du) / 5.0) AS INTEGER) AS dx, CAST(floor((v + dv) / 5.0) AS INTEGER) AS dy,
  sum(CASE WHEN abs(du) + abs(dv) <= 1 THEN 1e0 WHEN abs(du) = 1 AND abs(dv) = 1 THEN 0.984969e0
      WHEN abs(du) + abs(dv) = 2 THEN 0.478967e0 WHEN abs(du) + abs(dv) = 3 THEN 0.198797e0 ELSE 0e0 END) / 25e0 AS w
FROM range(5) a(u), range(5) b(v), range(-2, 3) c(du), range(-2, 3) d(dv) GROUP BY ALL"""


def _aperture(pixels: str, nsb: float) -> dict[str, str]:
    """Pixels that pass the aperture test: all sub-pixels, all neighbours, by joins."""
    sums = f"""
      SELECT p.event, p.telescope, p.px, p.py, s.sub, any_value(p.adu) AS adu, sum(s.w * coalesce(n.adu, 0)) AS total,
        sum(CASE WHEN p.px + s.dx BETWEEN 0 AND 31 AND p.py + s.dy BETWEEN 0 AND 31 THEN s.w ELSE 0 END) AS weight
      FROM {pixels} p CROSS JOIN stencil s LEFT JOIN {pixels} n
        ON n.event = p.event AND n.telescope = p.telescope AND n.px = p.px + s.dx AND n.py = p.py + s.dy
      GROUP BY p.event, p.telescope, p.px, p.py, s.sub"""
    return {
        "stencil": _STENCIL,
        "passed": f"""SELECT event, telescope, px, py, any_value(adu) AS adu FROM ({sums})
          WHERE total > 7 * sqrt(weight * (100e0 + {lit(nsb)})) GROUP BY event, telescope, px, py""",
    }


def _diagonal(pixels: str) -> str:
    return f"""SELECT * FROM {pixels} p WHERE EXISTS (SELECT 1 FROM {pixels} q WHERE q.event = p.event AND q.telescope = p.telescope
      AND abs(q.px - p.px) = 1 AND abs(q.py - p.py) = 1)"""


def _enough(pixels: str) -> str:
    return f"""SELECT * FROM {pixels} WHERE (event, telescope) IN (SELECT (event, telescope) FROM {pixels} GROUP BY event, telescope HAVING count(*) >= 3)"""


_OUT = "SELECT event, telescope, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, CAST(adu AS INTEGER) AS adu FROM "


@query("img2_img3_aperture_cleaning", sql(_OUT + "passed", "pixels", **_aperture("pixels", K.NSB_DATA_ADU)))
def _(s: Star):
    images = I.images_from_pixels(s.pixels())
    return _cells(I.clean_images(images, K.NSB_DATA_ADU, isolated=False, min_pixels=0), 32)


@query("img3_img6_full_cleaning", sql(_OUT + "done", "pixels", **_aperture("pixels", K.NSB_DATA_ADU),
                                      paired=_diagonal("passed"), done=_enough("paired")))
def _(s: Star):
    return _cells(I.clean_images(I.images_from_pixels(s.pixels())), 32)


@query("flow_data_parameters", sql(f'SELECT event AS "Event", telescope AS "Telescope", {SHAPES} FROM shaped', 
    track="""SELECT event, telescope, px, py, adu - 1 AS adu FROM (
      SELECT l_orderkey // 3 AS event, CAST(l_orderkey % 3 + 1 AS INTEGER) AS telescope, CAST((l_orderkey * 5 + l_linenumber) % 32 AS INTEGER) AS px,
        CAST((l_orderkey * 3 + l_linenumber) % 32 AS INTEGER) AS py, CAST(sum(CAST(l_quantity * 10 AS BIGINT)) AS BIGINT) AS adu FROM lineitem GROUP BY ALL) WHERE adu > 1""",
    **_aperture("track", K.NSB_DATA_ADU), paired=_diagonal("passed"), done=_enough("paired"), shaped=parameters(moments("done"))))
def _(s: Star):
    """The main job on real data: pedestals cut toward zero, cleaning, moments, on whole array images."""
    params = flows.data_parameters(s.array_events(), s.pedestals())
    return rounded(params.filter("Size > 0").select("Event", "Telescope", *SHAPE_COLUMNS))


@query("img4_negative_suppression", sql("""
SELECT vec_id, CAST(cell // 8 AS INTEGER) AS px, CAST(cell % 8 AS INTEGER) AS py, adu FROM patches WHERE adu > 0""", "patches"))
def _(s: Star):
    df = s.patches().select("vec_id", I.suppress_negative(F.col("pix")).alias("image"))
    return _cells(df, 8, ("vec_id",))


_SMALL = 'SELECT vec_id AS event, 0 AS telescope, cell // 8 AS px, cell % 8 AS py, adu FROM patches WHERE adu >= 100'
_OUT_SMALL = "SELECT event AS vec_id, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, CAST(adu AS INTEGER) AS adu FROM "


@query("img5_isolated_pixels", sql(_OUT_SMALL + "paired", "patches", strong=_SMALL, paired=_diagonal("strong")))
def _(s: Star):
    df = s.patches().withColumnRenamed("pix", "image")
    return _cells(I.clean_images(df, mode="flat", image_level=100, min_pixels=0), 8, ("vec_id",))


@query("img6_minimum_pixels", sql(_OUT_SMALL + "done", "patches", strong=_SMALL, done=_enough("strong")))
def _(s: Star):
    strong = s.patches().select("vec_id", F.transform("pix", lambda v: F.when(v >= 100, v).otherwise(0)).alias("image"))
    return _cells(strong.select("vec_id", I.require_pixels(F.col("image")).alias("image")), 8, ("vec_id",))


@query("img_two_level_cleaning", sql(_OUT_SMALL + "done", "patches",
    strong="SELECT vec_id AS event, 0 AS telescope, cell // 8 AS px, cell % 8 AS py, adu FROM patches",
    kept="""SELECT * FROM strong p WHERE adu >= 200 OR (adu >= 100 AND EXISTS (SELECT 1 FROM strong q WHERE q.event = p.event
      AND q.adu >= 200 AND abs(q.px - p.px) = 1 AND abs(q.py - p.py) = 1))""",
    paired=_diagonal("kept"), done=_enough("paired")))
def _(s: Star):
    df = s.patches().withColumnRenamed("pix", "image")
    return _cells(I.clean_images(df, mode="two_level", image_level=200, border_level=100), 8, ("vec_id",))


_EPS = "2.220446049250313e-16"
_taz = f"({pmod('pi() - ' + pmod('radians(az) - pi()', TWO_PI), TWO_PI)} + radians(12.77e0))"
_PROJECT = {
    "photons": """SELECT l_orderkey // 3 AS event, CAST(l_orderkey % 3 + 1 AS INTEGER) AS telescope,
      (l_discount - 0.05e0) / 2 + (l_quantity - 25.5e0) * 1e-4 AS cx, (l_tax - 0.04e0) / 2 + (l_partkey % 97 - 48.3e0) * 1e-4 AS cy,
      CAST(l_quantity AS BIGINT) AS photons FROM lineitem""",
    "axes": f"SELECT event, sin({_taz}) AS sa, cos({_taz}) AS ca, sin(radians(ze)) AS sz, cos(radians(ze)) AS cz FROM shower",
    "units": f"""SELECT *, sqrt(1 - tx * tx - ty * ty) AS tz, sqrt(1 - ux * ux - uy * uy) AS uz FROM (
      SELECT event, telescope, photons, sa, ca, sz, cz, CASE WHEN abs(sz * sa) < {_EPS} THEN 0e0 ELSE sz * sa END AS tx,
        CASE WHEN abs(sz * ca) < {_EPS} THEN 0e0 ELSE sz * ca END AS ty, CASE WHEN abs(cy) < {_EPS} THEN 0e0 ELSE -cy END AS ux,
        CASE WHEN abs(cx) < {_EPS} THEN 0e0 ELSE cx END AS uy FROM photons JOIN axes USING (event))""",
    "gaps": """SELECT *, ux / dot - tx AS gx, uy / dot - ty AS gy, uz / dot - tz AS gz FROM (
      SELECT *, ux * tx + uy * ty + uz * tz AS dot FROM units)""",
    "rotated": "SELECT *, gx * ca - gy * sa AS xt, (gx * sa + gy * ca) * cz - gz * sz AS yt FROM gaps",
    "projected": f"""SELECT event, telescope, photons, -degrees(CASE WHEN abs(xt) < {_EPS} THEN 0e0 ELSE xt END) AS x,
      degrees(CASE WHEN abs(yt) < {_EPS} THEN 0e0 ELSE yt END) AS y FROM rotated""",
}
_BIN = {
    "simpixels": f"""SELECT event, telescope, px, py, CAST(sum(16 * photons) AS BIGINT) AS adu FROM (
      SELECT *, {fixed_bin('x', -4.95, 4.95, 32)} AS px, {fixed_bin('y', -4.95, 4.95, 32)} AS py FROM projected WHERE x < 4.95e0 AND y < 4.95e0)
      WHERE px IS NOT NULL AND py IS NOT NULL GROUP BY event, telescope, px, py""",
}
_FIRED = {
    "fired": """SELECT * FROM simpixels WHERE (event, telescope) IN
      (SELECT (event, telescope) FROM simpixels GROUP BY event, telescope HAVING max(adu) >= 104)""",
}


def _projected(s: Star) -> DataFrame:
    return I.project_photons(s.photons(), s.shower())


def _binned(s: Star) -> DataFrame:
    return I.bin_photons(_projected(s), F.col("photons") * K.ADU_PER_PHOTON)


@query("img7_photon_projection", sql(f"""
SELECT event, telescope, count(*) AS n, {r('avg(x)')} AS x, {r('avg(y)')} AS y, {r('max(x)')} AS xmax, {r('min(y)')} AS ymin
FROM projected GROUP BY event, telescope""", "shower", **_PROJECT))
def _(s: Star):
    return rounded(
        _projected(s).groupBy("event", "telescope").agg(
            F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("x").alias("xmax"), F.min("y").alias("ymin")
        )
    )


@query("img8_photon_binning", sql("SELECT event, telescope, px, py, adu FROM simpixels", "shower", **_PROJECT, **_BIN))
def _(s: Star):
    return _binned(s)


@query("img9_trigger", sql("SELECT event, telescope, px, py, adu FROM fired", "shower", **_PROJECT, **_BIN, **_FIRED))
def _(s: Star):
    return I.triggered_pixels(_binned(s))


@query("img_sim_images", sql(_OUT + "done", "shower", **_PROJECT, **_BIN, **_FIRED, **_aperture("fired", K.NSB_SIM_ADU),
                             paired=_diagonal("passed"), done=_enough("paired")))
def _(s: Star):
    return _cells(flows.sim_images(s.photons(), s.shower(), F.col("photons") * K.ADU_PER_PHOTON), 32)


@query("img10_stacked_image", sql("SELECT event, px, py, CAST(sum(adu) AS BIGINT) AS adu FROM pixels GROUP BY event, px, py", "pixels"))
def _(s: Star):
    return I.stack_telescopes(s.hits())


@query("img11_nonempty", sql("SELECT vec_id, sum(adu) <> 0 AS lit FROM patches GROUP BY vec_id", "patches"))
def _(s: Star):
    return s.patches().select("vec_id", I.is_lit(F.col("pix")).alias("lit"))


@query("img12_event_truth", sql(f"""
SELECT "Event", "Telescope", {SHAPES}, {r('"TrueAz"')} AS "TrueAz", {r('"TrueZe"')} AS "TrueZe", {r('"TrueXcore"')} AS "TrueXcore",
  {r('"TrueYcore"')} AS "TrueYcore", {r('"TrueEnergy"')} AS "TrueEnergy" FROM hub JOIN truth USING ("Event")""", "hub", "truth"))
def _(s: Star):
    return rounded(s.hub().join(s.truth(), "Event").select(*sinks.SIM_COLUMNS))


@query("img12_event_lookup", sql(f"""
SELECT "Event", "Telescope", {SHAPES} FROM hub WHERE "Event" = (SELECT min(l_orderkey // 3) FROM lineitem WHERE l_quantity > 49)""", "hub"))
def _(s: Star):
    wanted = s.table("lineitem").filter("l_quantity > 49").agg(F.min(F.expr("l_orderkey div 3"))).first()[0]
    return rounded(I.event_lookup(s.hub(), wanted).select("Event", "Telescope", *SHAPE_COLUMNS))


@query("img_shift", sql("""
SELECT vec_id, CAST((y + dy) * 8 + x + dx AS INTEGER) AS cell, adu FROM (SELECT vec_id, cell % 8 AS x, cell // 8 AS y, vec_id % 7 - 3 AS dx, vec_id % 5 - 2 AS dy, adu FROM patches)
WHERE adu <> 0 AND x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7""", "patches"))
def _(s: Star):
    moved = I.shift_image(F.col("pix"), (F.col("vec_id") % 7 - 3).cast("int"), (F.col("vec_id") % 5 - 2).cast("int"), 8)
    return s.patches().select("vec_id", F.posexplode(moved).alias("cell", "adu")).filter("adu <> 0")


@query("sample_of_rows", sql("""
SELECT "Event", "Telescope" FROM (SELECT "Event", "Telescope", row_number() OVER (ORDER BY substr(md5("Event" || '-' || "Telescope"), 1, 16)) AS k, count(*) OVER () AS n FROM labelled)
WHERE k <= floor(0.7e0 * n + 0.5e0)""", "labelled"))
def _(s: Star):
    return quality.exact_sample(s.labelled(), 0.7).select("Event", "Telescope")


# ----------------------------------------------------------------- pointing
_CORR_ROWS = ", ".join(
    "(" + ", ".join([f"'{c[0]}'", *[str(v) for v in c[1:4]], *[lit(v) for v in c[4:]]]) + ")" for c in K.POINTING_CORRECTIONS
)
_CORR = {
    "corr": f"SELECT * FROM (VALUES {_CORR_ROWS}) t(night, telescope, t_from, t_to, t0, x0, y0, vx0, vy0, rot)",
    "timed": """SELECT event, telescope, CASE event % 3 WHEN 0 THEN '1030' WHEN 1 THEN '1031' ELSE '1101' END AS night,
      CAST(90000 + event % 7 * 5000 AS INTEGER) AS file_time, 1730280000e0 + event % 9000 AS pcap_time
      FROM pixels GROUP BY event, telescope""",
    "offsets": """SELECT a.*, coalesce(CAST(trunc(trunc(x0) + vx0 * (pcap_time - t0)) AS INTEGER), 0) AS dx,
      coalesce(CAST(trunc(trunc(y0) + vy0 * (pcap_time - t0)) AS INTEGER), 0) AS dy, coalesce(radians(rot), 0e0) AS rot
      FROM timed a LEFT JOIN corr c ON a.night = c.night AND a.telescope = c.telescope AND file_time >= t_from AND file_time < t_to""",
}


def _timed(images: DataFrame) -> DataFrame:
    """Night, file time and packet time of each image, from its event number."""
    e = F.col("event")
    return images.withColumns(
        {
            "night": F.when(e % 3 == 0, "1030").when(e % 3 == 1, "1031").otherwise("1101"),
            "file_time": (90000 + e % 7 * 5000).cast("int"),
            "pcap_time": 1730280000.0 + e % 9000,
        }
    )


@query("cor1_cor2_correction_lookup", sql(f"""
SELECT event, a.telescope, a.night, file_time, t0 AS t_initial, x0 AS x_initial, y0 AS y_initial, rot AS rotation_deg
FROM timed a LEFT JOIN corr c ON a.night = c.night AND a.telescope = c.telescope AND file_time >= t_from AND file_time < t_to""",
"pixels", **{k: _CORR[k] for k in ("corr", "timed")}))
def _(s: Star):
    images = _timed(s.hits().select("event", "telescope").distinct())
    out = pointing.attach_corrections(images, pointing.correction_table(s.spark))
    return out.select("event", "telescope", "night", "file_time", "t_initial", "x_initial", "y_initial", "rotation_deg")


#: capture names end in 22 characters behind the time of day
_NAME_END = "_scope_1_night.pcapng0"


@query("cor2_time_of_file_name", sql(f"""
SELECT event_id, name, TRY_CAST(substr(name, length(name) - 27, 6) AS INTEGER) AS file_time
FROM (SELECT event_id, 'run' || event_id || '_' || CASE WHEN event_id % 9 = 0 THEN 'xnoon' ELSE strftime(ts, '%H%M%S') END || '{_NAME_END}' AS name FROM events)"""))
def _(s: Star):
    clock = F.when(F.col("event_id") % 9 == 0, F.lit("xnoon")).otherwise(F.date_format("ts", "HHmmss"))
    named = s.table("events").select("event_id", F.concat(F.lit("run"), F.col("event_id").cast("string"), F.lit("_"), clock, F.lit(_NAME_END)).alias("name"))
    return named.withColumn("file_time", pointing.file_time(F.col("name")))


@query("cor3_drift_offset", sql(f"SELECT event, telescope, dx, dy, {r('rot')} AS rot FROM offsets", "pixels", **_CORR))
def _(s: Star):
    images = _timed(s.hits().select("event", "telescope").distinct())
    out = pointing.with_offsets(pointing.attach_corrections(images, pointing.correction_table(s.spark)))
    return rounded(out.select("event", "telescope", "dx", "dy", "rot"))


_B = lit(K.PIXEL_DEG)
_TURNED = f"""SELECT event, telescope, adu, x * cos(rot) - y * sin(rot) - dx * {_B} AS xd, x * sin(rot) + y * cos(rot) - dy * {_B} AS yd FROM (
  SELECT p.event, p.telescope, p.adu, -4.95e0 + (p.px + 0.5e0) * {_B} AS x, -4.95e0 + (p.py + 0.5e0) * {_B} AS y, o.dx, o.dy, o.rot
  FROM pixels p JOIN offsets o ON o.event = p.event AND o.telescope = p.telescope)"""


@query("cor4_corrected_parameters", sql(f'SELECT event AS "Event", telescope AS "Telescope", {SHAPES} FROM turned', "pixels", **_CORR,
                                        turned=parameters(moments("pixels", pixel=_TURNED, noise=1e-11), noise=1e-11)))
def _(s: Star):
    images = _timed(P.raw_moments(s.hits()))
    moved = pointing.with_offsets(pointing.attach_corrections(images, pointing.correction_table(s.spark)))
    # drifts move these images far off the camera, where squares of degrees round at 1e-12
    return P.image_parameters(moved, noise=1e-11).select("Event", "Telescope", *SHAPE_COLUMNS)


# ------------------------------------------------------------------ moments
@query("mom1_weighted_moments", sql(f"""
SELECT event, telescope, s AS size, {r('xm')} AS x, {r('ym')} AS y, {r('vx')} AS vx, {r('vy')} AS vy, {r('vxy')} AS vxy FROM m""",
"pixels", m=moments("pixels")))
def _(s: Star):
    m = P.weighted_means(P.raw_moments(s.hits()))
    return rounded(m.select("event", "telescope", F.col("Size").alias("size"), F.col("xm").alias("x"), F.col("ym").alias("y"), "vx", "vy", "vxy"))


@query("mom2_mom7_image_parameters", sql(f'SELECT "Event", "Telescope", {SHAPES} FROM hub', "hub"))
def _(s: Star):
    return s.hub().select("Event", "Telescope", *SHAPE_COLUMNS)


@query("mom_parameters_from_arrays", sql(f'SELECT event AS "Event", telescope AS "Telescope", {SHAPES} FROM params', "params"))
def _(s: Star):
    images = I.images_from_pixels(s.pixels())
    return P.image_parameters(P.raw_moments_from_images(images)).select("Event", "Telescope", *SHAPE_COLUMNS)


@query("mom8_angle_reduction", f"SELECT event_id, {r(pmod('value - 50', TWO_PI))} AS angle FROM events")
def _(s: Star):
    return rounded(s.table("events").select("event_id", angles.full_circle(F.col("value") - 50).alias("angle")))


# ------------------------------------------------------------------- stereo
@query("dir1_axis_intersection", sql(f"""
SELECT "Event", {r('"Xoffset"', 5)} AS "Xoffset", {r('"Yoffset"', 5)} AS "Yoffset" FROM dirs""", "dirs"))
def _(s: Star):
    return rounded(stereo.directions(s.usable(), unique=True).select("Event", "Xoffset", "Yoffset"), 5)


@query("dir2_sim_direction", sql(f"""
SELECT "Event", {r('"Xoffset"', 5)} AS "Xoffset", {r('"Yoffset"', 5)} AS "Yoffset" FROM simdirs""", "simdirs"))
def _(s: Star):
    return rounded(stereo.directions(stereo.reconstructible(s.hub()), unique=True).select("Event", "Xoffset", "Yoffset"), 5)


@query("dir3_mean_axis_angle", sql(f'SELECT "Event", {r(chr(34) + "MeanAngle" + chr(34))} AS "MeanAngle" FROM dirs', "dirs"))
def _(s: Star):
    return rounded(stereo.directions(s.usable(), unique=True).select("Event", "MeanAngle"))


@query("dir4_dir6_radec", sql(f"""
SELECT "Event", {r('"RA"', 5)} AS "RA", {r('"DEC"', 5)} AS "DEC" FROM skydirs""", "skydirs"))
def _(s: Star):
    return rounded(stereo.with_radec(stereo.directions(s.usable(), unique=True)).select("Event", "RA", "DEC"), 5)


@query("dir5_shower_azze", sql(f'SELECT "Event", {r(chr(34) + "Az" + chr(34), 5)} AS "Az", {r(chr(34) + "Ze" + chr(34), 5)} AS "Ze" FROM aimed', "aimed"))
def _(s: Star):
    d = stereo.directions(stereo.reconstructible(s.hub()), unique=True).join(s.truth(), "Event")
    return rounded(stereo.with_azze(d).select("Event", "Az", "Ze"), 5)


def _reco(s: Star) -> DataFrame:
    return flows.reconstruct(s.hub(), s.truth().select("Event", "TrueAz", "TrueZe"), POSITIONS, unique_images=True)


@query("core1_core4_core_fit", sql(f"""
SELECT "Event", CAST(n_lines AS INTEGER) AS n_lines, {core('xfit', 2)} AS xfit, {core('yfit', 2)} AS yfit, {spread('"stdP"', 'xfit', 'yfit', 2)} AS "stdP" FROM cores""", "cores"))
def _(s: Star):
    return rounded_cores(_reco(s).select("Event", "n_lines", "xfit", "yfit", "stdP"), 2, "xfit", "yfit")


@query("core5_ground_core", sql(f"""
SELECT "Event", {core('"Xcore"', 2)} AS "Xcore", {core('"Ycore"', 2)} AS "Ycore" FROM ground""", "ground"))
def _(s: Star):
    return rounded_cores(_reco(s).select("Event", "Xcore", "Ycore"), 2)


_hav = "2 * 6371000e0 * asin(sqrt(least(sin(radians(la2 - la1) / 2) ** 2 + cos(radians(la1)) * cos(radians(la2)) * sin(radians(lo2 - lo1) / 2) ** 2, 1e0)))"


@query("geo1_site_distance", sql(f"""
SELECT s_suppkey, {r(f'sqrt(({_hav}) ** 2 + (h2 - h1) ** 2)', 3)} AS metres FROM (
  SELECT s_suppkey, s_suppkey % 180 - 89.5e0 AS la1, s_suppkey * 7 % 360 - 180e0 AS lo1, s_suppkey % 500 * 1e0 AS h1,
    n_nationkey * 3 - 36e0 AS la2, n_nationkey * 14 - 170e0 AS lo2, n_nationkey * 20e0 AS h2
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""))
def _(s: Star):
    met = s.table("supplier").join(s.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    d = angles.site_distance(k % 180 - 89.5, k * 7 % 360 - 180.0, k % 500 * 1.0, n * 3 - 36.0, n * 14 - 170.0, n * 20.0)
    return rounded(met.select("s_suppkey", d.alias("metres")), 3)


@query("geo2_core_distance", sql(f"""
SELECT "Event", "Telescope", x AS "TelX", y AS "TelY", {r('sqrt(("TrueXcore" - x) ** 2 + ("TrueYcore" - y) ** 2)')} AS "CoreDistance" FROM (
  SELECT "Event", "Telescope", "TrueXcore", "TrueYcore", CASE "Telescope" WHEN 3 THEN 126.65e0 WHEN 1 THEN -101.35e0 ELSE -25.29e0 END AS x,
    CASE "Telescope" WHEN 3 THEN -42.32e0 WHEN 1 THEN -42.32e0 ELSE 84.64e0 END AS y FROM hub JOIN truth USING ("Event"))""", "hub", "truth"))
def _(s: Star):
    met = stereo.core_distance_to_telescope(s.hub().join(s.truth(), "Event"))
    return rounded(met.select("Event", "Telescope", "TelX", "TelY", "CoreDistance"))


# ------------------------------------------------------------------ quality
_REQ = " AND ".join(f'"{c}" IS NOT NULL' for c in quality.REQUIRED_COLUMNS)
_HUBCOLS = f'"File", "In_file_Index", "Event", "Telescope", "Timestamp", {SHAPES}'


@query("fil1_missing_values", sql(f'SELECT "Event", "Telescope", {SHAPES} FROM hub WHERE {_REQ}', "hub"))
def _(s: Star):
    return quality.drop_missing(s.hub()).select("Event", "Telescope", *SHAPE_COLUMNS)


@query("fil2_positive_width", sql('SELECT "Event", "Telescope", "Width" FROM usable', "usable"))
def _(s: Star):
    return s.usable().select("Event", "Telescope", "Width")


@query("fil3_telescope_multiplicity", sql('SELECT "Event", "Telescope", "Size" FROM usable2', "usable2"))
def _(s: Star):
    return s.usable(2).select("Event", "Telescope", "Size")


@query("fil4_telescope_time", sql('SELECT "Event", "Telescope", "Timestamp" FROM usable WHERE "Telescope" = 2 AND "Timestamp" > 850000000', "usable"))
def _(s: Star):
    return quality.after(quality.of_telescope(s.usable(), 2), 850000000).select("Event", "Telescope", "Timestamp")


@query("fil5_energy_threshold", sql(f"""
SELECT "Event", "Telescope", {r('"TrueEnergy"')} AS "TrueEnergy" FROM usable JOIN truth USING ("Event") WHERE "TrueEnergy" > 10000""", "usable", "truth"))
def _(s: Star):
    return rounded(quality.above_energy(s.usable().join(s.truth(), "Event")).select("Event", "Telescope", "TrueEnergy"))


def _sector(c: str, n: int) -> str:
    size = lit(2 * K.CENTROID_HALF_RANGE_DEG / n)
    cell = f"floor(({c} + 4.96e0) / {size})"
    low = f"({cell} * {size} - 4.96e0)"
    return f"CASE WHEN {c} > {low} AND {c} < {low} + {size} AND {cell} >= 0 AND {cell} < {n} THEN CAST({cell} AS INTEGER) END"


_X, _Y = '"MeanX"', '"MeanY"'
_WBIN = fixed_bin('"Width"', 0, 1, 80)
_SECTOR = """SELECT "Telescope", sx, sy, bin, count(*) AS n FROM (SELECT "Telescope", {sx} AS sx, {sy} AS sy, {b} AS bin FROM usable)
WHERE sx IS NOT NULL AND sy IS NOT NULL AND bin IS NOT NULL GROUP BY "Telescope", sx, sy, bin"""


@query("fil6_chip_widths", sql(_SECTOR.format(sx=_sector(_X, 4), sy=_sector(_Y, 4), b=_WBIN), "usable"))
def _(s: Star):
    return quality.sector_width_histogram(s.usable(), 4)


@query("fil6_board_widths", sql(_SECTOR.format(sx=_sector(_X, 2), sy=_sector(_Y, 2), b=_WBIN), "usable"))
def _(s: Star):
    return quality.sector_width_histogram(s.usable(), 2)


_ON = lit(K.THETA_CUT_DEG**2)


@query("fil7_on_cut", sql(f"""
SELECT "Event", {r('"Xoffset"', 5)} AS "Xoffset", {r('"Yoffset"', 5)} AS "Yoffset" FROM dirs JOIN (
  SELECT "Event", max("Distance") AS far FROM usable GROUP BY "Event") USING ("Event")
WHERE far < 2 AND "Xoffset" ** 2 + "Yoffset" ** 2 < {_ON}""", "dirs", "usable"))
def _(s: Star):
    far = F.max("Distance").alias("MaxDistance")
    d = stereo.directions(s.usable(), extra=(far,), unique=True)
    off = F.col("Xoffset") * F.col("Xoffset") + F.col("Yoffset") * F.col("Yoffset")
    return rounded(d.filter(quality.on_cut(F.col("MaxDistance"), off)).select("Event", "Xoffset", "Yoffset"), 5)


@query("fil8_ratio_range", sql(f"""
SELECT "Event", "Telescope", {r('"Length" / "Width"', 4)} AS ratio FROM usable WHERE "Length" / "Width" > -20 AND "Length" / "Width" < 20""", "usable"))
def _(s: Star):
    ratio = F.try_divide("Length", "Width")
    return rounded(s.usable().select("Event", "Telescope", ratio.alias("ratio")).filter(quality.inside(F.col("ratio"))), 4)


@query("fil_parameter_cuts", sql("""
SELECT "Event", "Telescope", "Size", "Distance", "Alpha" FROM usable WHERE "Size" > 200 AND "Distance" < 3 AND "Alpha" < 60""", "usable"))
def _(s: Star):
    cut = quality.parameter_cuts(s.usable(), Size=(200, None), Distance=(None, 3), Alpha=(None, 60))
    return cut.select("Event", "Telescope", "Size", "Distance", "Alpha")


def _copies(s: Star) -> DataFrame:
    """Small images recur when their coordinates are cut to whole degrees."""
    return s.usable().select(
        (F.col("Event") % 3).cast("string").alias("File"), "In_file_Index", "Event", "Telescope",
        F.floor("MeanX").alias("MeanX"), F.floor("MeanY").alias("MeanY"), F.floor(F.col("Size") / 500).alias("Size"),
    )


_COPY = """SELECT CAST("Event" % 3 AS VARCHAR) AS "File", "In_file_Index", "Event", "Telescope", CAST(floor("MeanX") AS BIGINT) AS "MeanX",
  CAST(floor("MeanY") AS BIGINT) AS "MeanY", CAST(floor("Size" / 500) AS BIGINT) AS "Size" FROM usable"""
_DEDUPE = """SELECT "File", "In_file_Index", "Event", "Telescope", "MeanX", "MeanY", "Size" FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "Event", "Telescope") AS k FROM copies) WHERE k = 1"""


@query("red1_dedupe_for_sky", sql(_DEDUPE.format(keys='"File", "MeanX", "MeanY", "Size"'), "usable", copies=_COPY))
def _(s: Star):
    return quality.dedupe_for_sky(_copies(s))


@query("red2_dedupe_for_histograms", sql(_DEDUPE.format(keys='"In_file_Index", "MeanX", "MeanY", "Size"'), "usable", copies=_COPY))
def _(s: Star):
    return quality.dedupe_for_histograms(_copies(s))


@query("red3_first_row_per_event", sql(f"""
SELECT {_HUBCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY "Event" ORDER BY "Telescope") AS k FROM usable) WHERE k = 1""", "usable"))
def _(s: Star):
    return rounded(quality.first_row_per_event(s.usable()))


@query("red4_renumber", sql("""
SELECT "File", "In_file_Index", "Telescope", row_number() OVER (ORDER BY "File", "In_file_Index", "Telescope") AS "Event" FROM usable""", "usable"))
def _(s: Star):
    return quality.renumber(s.usable().select("File", "In_file_Index", "Telescope", "Event"), chunk=500)


@query("prj1_utc_time", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def _(s: Star):
    e = s.table("events").select("event_id", quality.utc_time(s.series_time()).alias("t"))
    return e.select("event_id", F.unix_micros("t").alias("micros"))


@query("prj2_ratio_and_log", sql(f"""
SELECT "Event", "Telescope", {r('"Length" / "Width"', 3)} AS "LengthOverWidth", {r('log10("Size")')} AS "Log10Size" FROM usable""", "usable"))
def _(s: Star):
    d = quality.derived_shape(s.usable()).select("Event", "Telescope", "LengthOverWidth", "Log10Size")
    return rounded(d, LengthOverWidth=3)


@query("prj3_set1_labelled_union", sql("""
SELECT "Event", "Telescope", "Size", CAST(CASE class WHEN 'gamma' THEN 1 ELSE 2 END AS INTEGER) AS "Classification" FROM labelled""", "labelled"))
def _(s: Star):
    rows = s.labelled()
    cols = ["Event", "Telescope", "Size"]
    gamma = quality.labelled(rows.filter(F.col("class") == "gamma"), 1, cols)
    proton = quality.labelled(rows.filter(F.col("class") == "proton"), 2, cols)
    return quality.stack_tables(gamma, proton)


@query("set2_split", sql("""
SELECT "Event", "Telescope", "Alpha" < 45 AS narrow FROM hub""", "hub"))
def _(s: Star):
    rows = s.hub().select("Event", "Telescope", "Alpha")
    narrow, rest = quality.split_by(rows, F.col("Alpha") < 45)
    known = rest.withColumn("narrow", F.when(F.col("Alpha").isNotNull(), F.lit(False)))
    return narrow.withColumn("narrow", F.lit(True)).unionByName(known).drop("Alpha")


@query("srt1_srt2_preview", sql(f'SELECT "Event", "Telescope", {SHAPES} FROM usable ORDER BY "Event", "Telescope" LIMIT 20', "usable"))
def _(s: Star):
    return quality.preview(s.usable().select("Event", "Telescope", *SHAPE_COLUMNS), 20)


# --------------------------------------------------------------- aggregates
@query("agg1_event_maximum", sql("""
SELECT "Event", "Telescope", CASE WHEN "Distance" = max("Distance") OVER (PARTITION BY "Event") THEN "Distance" END AS "MaxDistance" FROM usable""", "usable"))
def _(s: Star):
    return stats.event_maximum(s.usable()).select("Event", "Telescope", "MaxDistance")


@query("agg2_maximum_per_event", sql('SELECT "Event", max("Distance") AS "MaxDistance" FROM usable GROUP BY "Event"', "usable"))
def _(s: Star):
    return stats.per_event_maximum(s.usable())


@query("agg3_distinct_events", sql('SELECT class, count(DISTINCT "Event") AS n_events FROM labelled GROUP BY class', "labelled"))
def _(s: Star):
    return stats.distinct_events(s.labelled(), "class")


_DESC = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count("{c}") AS "count", {r(f'avg("{c}")')} AS mean, {r(f'stddev_samp("{c}")')} AS std, min("{c}") AS min,
    {r(f'quantile_cont("{c}", 0.25)')} AS q25, {r(f'quantile_cont("{c}", 0.5)')} AS q50, {r(f'quantile_cont("{c}", 0.75)')} AS q75, max("{c}") AS max FROM hub"""
    for c in SHAPE_COLUMNS
)


@query("agg4_describe", sql(_DESC, "hub"))
def _(s: Star):
    out = stats.describe(cut_lineage(s.hub()), SHAPE_COLUMNS)
    return out.select("column", "count", "min", "max", *[tidy(F.col(c)).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query("agg5_centroid_means", sql(f"""
SELECT "Telescope", {r('avg("MeanX")')} AS "MeanX", {r('avg("MeanY")')} AS "MeanY", count(*) AS n FROM usable GROUP BY "Telescope" """, "usable"))
def _(s: Star):
    return rounded(stats.group_means(s.usable()))


@query("agg6_quantile", sql(f"""
SELECT "Telescope", 0.68e0 AS prob, {r('quantile_cont("Distance", 0.68)')} AS quantile, count("Distance") AS n FROM hub GROUP BY "Telescope" """, "hub"))
def _(s: Star):
    return rounded(stats.exact_quantiles(cut_lineage(s.hub()), "Distance", (0.68,), "Telescope"))


@query("agg7_population_spread", sql(f"""
SELECT class, {r('avg("Width")')} AS "mean_Width", {r('stddev_pop("Width")')} AS "std_Width", {r('avg("Length")')} AS "mean_Length",
  {r('stddev_pop("Length")')} AS "std_Length" FROM labelled GROUP BY class""", "labelled"))
def _(s: Star):
    return rounded(stats.population_spread(s.labelled(), by="class"))


@query("agg8_column_span", sql('SELECT "Telescope", min("Timestamp") AS lo, max("Timestamp") AS hi FROM usable GROUP BY "Telescope"', "usable"))
def _(s: Star):
    return stats.column_span(s.usable(), by="Telescope")


# --------------------------------------------------------------- histograms
_PH = " UNION ALL ".join(
    f"SELECT '{c}' AS parameter, {fixed_bin('v', lo, hi, n)} AS bin FROM (SELECT {e} AS v FROM usable)"
    for (c, (lo, hi, n)), e in zip(
        K.PARAMETER_RANGES.items(), ['"Length"', '"Width"', '"Miss"', '"Distance"', 'log10("Size")', '"Alpha"']
    )
)


@query("his1_parameter_histograms", sql("""
SELECT p.parameter, CAST(k AS INTEGER) AS bin, count(b.bin) AS n FROM (SELECT DISTINCT parameter FROM binned WHERE bin IS NOT NULL) p CROSS JOIN range(80) t(k)
LEFT JOIN binned b ON b.parameter = p.parameter AND b.bin = k GROUP BY p.parameter, k""", "usable", binned=_PH))
def _(s: Star):
    return stats.parameter_histograms(quality.derived_shape(s.usable()))


_DH = f"""SELECT class, {fixed_bin('"Width"', 0, 1, 80)} AS bin FROM labelled"""


@query("his2_density_histogram", sql(f"""
SELECT g.class, CAST(k AS INTEGER) AS bin, count(b.bin) AS n,
  {r('count(b.bin) / (any_value(g.total) * (1e0 / 80))')} AS density
FROM (SELECT class, count(bin) AS total FROM binned GROUP BY class) g CROSS JOIN range(80) t(k)
LEFT JOIN binned b ON b.class = g.class AND b.bin = k GROUP BY g.class, k""", "labelled", binned=_DH))
def _(s: Star):
    return rounded(stats.histogram(s.labelled(), "Width", 0.0, 1.0, 80, "class", density=True))


def _own_range(table: str, value: str, bins: str, key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    using = f"USING ({key})" if key else "ON TRUE"
    span = f"""SELECT {k}CASE WHEN min({value}) = max({value}) THEN min({value}) - 0.5e0 ELSE min({value}) END AS lo,
      CASE WHEN min({value}) = max({value}) THEN max({value}) + 0.5e0 ELSE max({value}) END AS hi, CAST({bins} AS INTEGER) AS bins
      FROM {table} WHERE {value} IS NOT NULL {f'GROUP BY {key}' if key else ''}"""
    binned = f"SELECT {k}{axis_bin('v', 'lo', 'hi', 'CAST(bins AS DOUBLE)')} AS bin FROM (SELECT {k}{value} AS v FROM {table} WHERE {value} IS NOT NULL) JOIN ({span}) {using}"
    group = f"GROUP BY {k}bin"
    return f"""SELECT {k}CAST(q.i AS INTEGER) AS bin, lo + q.i * ((hi - lo) / bins) AS "left", lo + (q.i + 1) * ((hi - lo) / bins) AS "right", coalesce(n, 0) AS n
      FROM (SELECT *, unnest(range(bins)) AS i FROM ({span})) q LEFT JOIN (SELECT {k}bin AS i, count(*) AS n FROM ({binned}) {group}) c
      USING ({k}i)"""


@query("his3_own_range", sql(f"""
SELECT "Telescope", bin, {r('"left"', 4)} AS "left", {r('"right"', 4)} AS "right", n FROM h""", "series",
h=_own_range("series", '"Timestamp"', '(max("Timestamp") - min("Timestamp")) / 100', '"Telescope"').replace("CAST((max", "CAST(floor((max").replace("/ 100 AS INTEGER", "/ 100) AS INTEGER")))
def _(s: Star):
    bins = F.floor((F.col("hi") - F.col("lo")) / 100)
    return rounded(stats.histogram_own_range(s.series(), "Timestamp", bins, "Telescope"), 4)


_2D = f"""SELECT "Telescope", {fixed_bin('"MeanX"', -4.96, 4.96, 32)} AS ix, {fixed_bin('"MeanY"', -4.96, 4.96, 32)} AS iy FROM usable"""


@query("his4_centroid_map", sql("""
SELECT *, max(n) OVER () AS vmax FROM (SELECT "Telescope", ix, iy, count(*) AS n FROM binned WHERE ix IS NOT NULL AND iy IS NOT NULL
GROUP BY "Telescope", ix, iy)""", "usable", binned=_2D))
def _(s: Star):
    h = K.CENTROID_HALF_RANGE_DEG
    return stats.shared_maximum(stats.histogram_2d(s.usable(), "MeanX", "MeanY", (-h, h), (-h, h), 32, "Telescope"))


_RA_LO, _DEC_LO = K.POINTING_RA_DEG - 5, K.POINTING_DEC_DEG - 5
_SKY2D = f"""SELECT {fixed_bin('"RA"', _RA_LO, _RA_LO + 9.8, 49)} AS ix, {fixed_bin('"DEC"', _DEC_LO, _DEC_LO + 9.8, 49)} AS iy FROM skydirs"""


@query("his4_sky_histogram", sql("""
SELECT ix, iy, count(*) AS n FROM binned WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ix, iy""", "skydirs", binned=_SKY2D))
def _(s: Star):
    d = stereo.with_radec(stereo.directions(s.usable(), unique=True))
    return stats.histogram_2d(d, "RA", "DEC", (_RA_LO, _RA_LO + 9.8), (_DEC_LO, _DEC_LO + 9.8), 49)


@query("his4_weighted_centroid_map", sql("""
SELECT "Telescope", ix, iy, CAST(sum("Size") AS BIGINT) AS n FROM binned WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY "Telescope", ix, iy""", "usable",
binned=_2D.replace("SELECT", 'SELECT "Size",', 1)))
def _(s: Star):
    h = K.CENTROID_HALF_RANGE_DEG
    cells = stats.histogram_2d(s.usable(), "MeanX", "MeanY", (-h, h), (-h, h), 32, "Telescope", weight=F.col("Size"))
    return cells.withColumn("n", F.col("n").cast("bigint"))


# -------------------------------------------------------------- time series
_BUCKETS = {
    "b": """SELECT "Telescope", CAST(floor("Timestamp" / 100) * 100 AS BIGINT) AS bucket, count(*) AS n, avg("Width") AS w, avg("Size") AS z
      FROM series GROUP BY 1, 2""",
    "spine": 'SELECT "Telescope", unnest(range(min(bucket), max(bucket) + 100, 100)) AS bucket FROM b GROUP BY "Telescope"',
}


@query("tim1_event_rate", sql("""
SELECT "Telescope", bucket, coalesce(n, 0) AS n, coalesce(n, 0) / 100e0 AS rate FROM spine LEFT JOIN b USING ("Telescope", bucket)""", "series", **_BUCKETS))
def _(s: Star):
    return stats.event_rate(s.series())


@query("tim2_bucket_means", sql(f"""
SELECT "Telescope", bucket, {r('w')} AS "mean_Width", {r('z')} AS "mean_Size", {r('log10(z)')} AS "log10_mean_Size"
FROM spine LEFT JOIN b USING ("Telescope", bucket)""", "series", **_BUCKETS))
def _(s: Star):
    return rounded(stats.bucket_means(s.series()))


@query("tim_sliding_means", sql(f"""
SELECT "Event", "Telescope", {r('avg("MeanX") OVER w')} AS "sliding_MeanX", {r('avg("MeanY") OVER w')} AS "sliding_MeanY" FROM usable
WINDOW w AS (PARTITION BY "File", "Telescope" ORDER BY "Timestamp", "Event" ROWS BETWEEN 60 PRECEDING AND 59 FOLLOWING)""", "usable"))
def _(s: Star):
    d = stats.sliding_means(s.usable(), slices=16, block=200)
    return rounded(d.select("Event", "Telescope", "sliding_MeanX", "sliding_MeanY"))


_MS = {
    "spread": 'SELECT class, avg("Width") AS mw, stddev_pop("Width") AS sw, avg("Length") AS ml, stddev_pop("Length") AS sl FROM labelled GROUP BY class',
    "scaled": """SELECT class, "Event", avg(("Width" - mw) / sw) AS "MSCW", avg(("Length" - ml) / sl) AS "MSCL"
      FROM labelled2 JOIN spread USING (class) GROUP BY class, "Event" """,
}


@query("msc1_mean_scaled", sql(f'SELECT class, "Event", {r(chr(34) + "MSCW" + chr(34))} AS "MSCW", {r(chr(34) + "MSCL" + chr(34))} AS "MSCL" FROM scaled',
                               "labelled", "labelled2", **_MS))
def _(s: Star):
    return rounded(stats.mean_scaled(s.labelled()))


@query("msc2_mean_scaled_ratio", sql(f"""
SELECT class, {r('avg(ratio)')} AS mean_ratio, count(*) AS n FROM (SELECT class, "MSCL" / "MSCW" AS ratio FROM scaled) WHERE ratio > -20 AND ratio < 20 GROUP BY class""",
"labelled", "labelled2", **_MS))
def _(s: Star):
    return rounded(stats.mean_scaled_ratio(stats.mean_scaled(s.labelled())))


# ------------------------------------------------------------ spot size, fits
def _spots(s: Star) -> DataFrame:
    return s.pixels().select(
        (F.col("event") * 3 + F.col("telescope")).alias("image_id"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("adu").alias("flux")
    )


_SPOTS = "SELECT event * 3 + telescope AS image_id, px AS x, py AS y, adu AS flux FROM pixels"
_PEAK = "SELECT image_id, x AS peak_x, y AS peak_y, flux AS peak FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY flux DESC, y, x) AS k FROM spots) WHERE k = 1"


@query("psf1_containment_radius", sql(f"""
SELECT image_id, {r('min(r)')} AS radius FROM (SELECT image_id, r, sum(flux) OVER (PARTITION BY image_id ORDER BY r, y, x) AS cum, total FROM (
  SELECT image_id, x, y, flux, total, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM spots JOIN (
    SELECT image_id, sum(x * flux) / CAST(sum(flux) AS DOUBLE) AS cx, sum(y * flux) / CAST(sum(flux) AS DOUBLE) AS cy, sum(flux) AS total FROM spots GROUP BY image_id) USING (image_id)))
WHERE cum >= total * 0.9e0 GROUP BY image_id""", "pixels", spots=_SPOTS))
def _(s: Star):
    return rounded(psf.containment_radius(_spots(s)))


@query("psf2_full_width_half_maximum", sql(f"""
SELECT image_id, {r('2 * quantile_cont(sqrt(CAST((x - peak_x) ** 2 + (y - peak_y) ** 2 AS DOUBLE)), 0.5)')} AS fwhm FROM spots JOIN peaks USING (image_id)
WHERE flux >= 0.5e0 * peak GROUP BY image_id""", "pixels", spots=_SPOTS, peaks=_PEAK))
def _(s: Star):
    return rounded(psf.full_width_half_maximum(_spots(s)))


@query("psf3_peak_row_profile", sql(f"""
SELECT image_id, x, x - peak_x AS "offset", {r('flux / CAST(peak AS DOUBLE)')} AS relative FROM spots JOIN peaks USING (image_id) WHERE y = peak_y""",
"pixels", spots=_SPOTS, peaks=_PEAK))
def _(s: Star):
    return rounded(psf.peak_row_profile(_spots(s)))


@query("fit1_line", sql(f"""
SELECT "Telescope", {r('regr_slope("Length", "Distance")')} AS slope, {r('regr_intercept("Length", "Distance")')} AS intercept, count(*) AS n
FROM usable GROUP BY "Telescope" """, "usable"))
def _(s: Star):
    return rounded(psf.line_fit(s.usable(), "Distance", "Length", "Telescope"))


_P = 'SELECT "Telescope" AS t, "Distance" AS x, "Length" AS y FROM usable'


@query("fit1_parabola", sql(f"""
SELECT t AS "Telescope", {r('c2', 5)} AS c2, {r('sxy / sxx - c2 * sxxx / sxx - 2 * c2 * mx', 5)} AS c1,
  {r('my - (sxy / sxx - c2 * sxxx / sxx) * mx - c2 * (sxx / n) + c2 * mx * mx', 5)} AS c0, n FROM (
  SELECT *, (sxxy * sxx - sxy * sxxx) / (sxx * (sxxxx - sxx * sxx / n) - sxxx * sxxx) AS c2 FROM (
    SELECT t, count(*) AS n, any_value(mx) AS mx, avg(y) AS my, sum(u * u) AS sxx, sum(u ** 3) AS sxxx, sum(u ** 4) AS sxxxx,
      sum(u * (y - ym)) AS sxy, sum(u * u * (y - ym)) AS sxxy
    FROM (SELECT p.*, x - mx AS u, mx, ym FROM pts p JOIN (SELECT t, avg(x) AS mx, avg(y) AS ym FROM pts GROUP BY t) USING (t)) GROUP BY t))""",
"usable", pts=_P))
def _(s: Star):
    d = psf.polynomial_fit(s.usable(), "Distance", "Length", "Telescope", 2)
    c = F.col("coefficients")
    return rounded(d.select("Telescope", c[0].alias("c2"), c[1].alias("c1"), c[2].alias("c0"), "n"), 5)


# ---------------------------------------------------------------------- sky
SKY = sky.SkyMap()


def _events(s: Star) -> DataFrame:
    return flows.sky_events(s.hub(), SKY, unique_images=True)


@query("sky1_sky2_sky3_sky4_counts_map", sql(f"""
SELECT i, j, {r('x')} AS "testPosX", {r('y')} AS "testPosY", n AS "Counts" FROM oncounts""", "oncounts"))
def _(s: Star):
    return rounded(sky.counts_map(_events(s), SKY))


_NEAR = f"""SELECT d."Event", ("RA" - {{x}}) ** 2 + ("DEC" - {{y}}) ** 2 AS t2, max(sqrt((mx - {{x}}) ** 2 + (my - {{y}}) ** 2)) AS far
  FROM skydirs d JOIN skyimages s ON s."Event" = d."Event" GROUP BY d."Event", "RA", "DEC" """


@query("sky2_sky3_distances", sql(f'SELECT "Event", {r("t2", 4)} AS "ThetaSquare", {r("far", 5)} AS "MaxDistance" FROM near', "skydirs", "skyimages",
                                 near=_NEAR.format(x=lit(K.ON_REGION[0]), y=lit(K.ON_REGION[1]))))
def _(s: Star):
    x, y = (F.lit(v) for v in K.ON_REGION)
    d = _events(s).select("Event", sky.theta_square(x, y).alias("ThetaSquare"), sky.max_distance(x, y).alias("MaxDistance"))
    return rounded(d, ThetaSquare=4, MaxDistance=5)


@query("sky5_on_events", sql(f'SELECT "Event", {r("t2", 5)} AS "ThetaSquare", {r("far", 5)} AS "MaxDistance" FROM near WHERE t2 < {_ON} AND far < 2',
                             "skydirs", "skyimages", near=_NEAR.format(x=lit(K.POINTING_RA_DEG), y=lit(K.POINTING_DEC_DEG))))
def _(s: Star):
    d = sky.about_position(_events(s), K.POINTING_RA_DEG, K.POINTING_DEC_DEG, SKY)
    return rounded(d.select("Event", "ThetaSquare", "MaxDistance"), 5)


_OUT_OF = "(r.x < g.x - 1.4e0 OR r.x > g.x + 1.4e0 OR r.y < g.y - 1.4e0 OR r.y > g.y + 1.4e0)"


# positions all over the map and beyond its edges, one for each supplier
_PLACES = f"""SELECT s_suppkey AS position, {lit(K.POINTING_RA_DEG - 6)} + (s_suppkey * 37 % 120) * 0.1e0 AS x,
  {lit(K.POINTING_DEC_DEG - 6)} + (s_suppkey * 61 % 120) * 0.1e0 AS y FROM supplier"""


def _places(s: Star) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (F.lit(c - 6.0) + (k * m % 120) * F.lit(0.1) for c, m in ((K.POINTING_RA_DEG, 37), (K.POINTING_DEC_DEG, 61)))
    return s.table("supplier").select(k.alias("position"), x.alias("x"), y.alias("y"))


_ABOUT = """SELECT d."Event", g.{key}, ("RA" - g.x) ** 2 + ("DEC" - g.y) ** 2 AS t2,
  (SELECT max(sqrt((mx - g.x) ** 2 + (my - g.y) ** 2)) FROM skyimages s WHERE s."Event" = d."Event") AS far FROM skydirs d, {places} g WHERE ("RA" - g.x) ** 2 + ("DEC" - g.y) ** 2 < """ + _ON


@query("sky5_events_about_positions", sql(f"""SELECT "Event", position, {r('t2', 5)} AS "ThetaSquare", {r('far', 5)} AS "MaxDistance" FROM about WHERE far < 2""",
                                          "skydirs", "skyimages", places=_PLACES, about=_ABOUT.format(key="position", places="places")))
def _(s: Star):
    return rounded(sky.about_positions(_events(s), _places(s), SKY).select("Event", "position", "ThetaSquare", "MaxDistance"), 5)


@query("sky6_sky7_on_off_at_positions", sql(f"""
SELECT g.position, coalesce(n_on, 0) AS "on", CAST(off AS BIGINT) AS off, n_off, {r('1 / CAST(n_off AS DOUBLE)')} AS alpha
FROM places g LEFT JOIN (SELECT position, count(*) AS n_on FROM about WHERE far < 2 GROUP BY position) USING (position)
JOIN (SELECT g.position, sum(coalesce(n, 0)) AS off, count(*) AS n_off FROM places g JOIN regions r ON {_OUT_OF}
  LEFT JOIN (SELECT region, count(*) AS n FROM around WHERE far < 2 GROUP BY region) c ON c.region = r.i * 1000 + r.j GROUP BY g.position) USING (position)""",
"skydirs", "skyimages", "regions", places=_PLACES, about=_ABOUT.format(key="position", places="places"),
around=_ABOUT.format(key="region", places="(SELECT i * 1000 + j AS region, x, y FROM regions)")))
def _(s: Star):
    return rounded(sky.on_off_at(_events(s), _places(s), SKY).select("position", "on", "off", "n_off", "alpha"))


_AT = f"(SELECT {lit(K.ON_REGION[0])} AS x, {lit(K.ON_REGION[1])} AS y) g"


@query("sky6_sky7_off_events", sql(f"""
SELECT d."Event", r.i, r.j, {r('r.x')} AS "offPosX", {r('r.y')} AS "offPosY" FROM regions r JOIN {_AT} ON {_OUT_OF}
JOIN skydirs d ON ("RA" - r.x) ** 2 + ("DEC" - r.y) ** 2 < {_ON}
WHERE (SELECT max(sqrt((mx - r.x) ** 2 + (my - r.y) ** 2)) FROM skyimages s WHERE s."Event" = d."Event") < 2""", "skydirs", "skyimages", "regions"))
def _(s: Star):
    d = sky.off_events(_events(s), *K.ON_REGION, SKY)
    step, base = K.OFF_BIN_SKIP, K.OFF_FIRST_BIN
    return rounded(d.select("Event", (F.col("i") * step + base).alias("i"), (F.col("j") * step + base).alias("j"), "offPosX", "offPosY"))


@query("sky7_sky8_on_off_alpha", sql(f"""
SELECT i, j, n_on AS "on", n_off_events AS off, n_off, {r('alpha')} AS alpha FROM onoff""", "onoff"))
def _(s: Star):
    return rounded(sky.on_off_map(sky.counts_map(_events(s), SKY), SKY).select("i", "j", "on", "off", "n_off", "alpha"))


# every seventh row has no excess, as many counts off as its regions expect
_E = {"on": "CAST(user_id % 40 AS DOUBLE)", "off": "CAST(CASE WHEN event_id % 7 = 0 THEN user_id % 40 * (100 + event_id % 21) ELSE event_id % 1200 END AS DOUBLE)", "alpha": "CASE WHEN event_id % 11 = 0 THEN 0e0 ELSE 1e0 / (100 + event_id % 21) END"}


def _li_ma_sql() -> str:
    from lumiray.plans.oracle import li_ma

    e = li_ma("a", "b", "c")
    return f"""SELECT event_id, {r(f"CASE WHEN c = 0 THEN 0e0 ELSE {e['eq17']} END")} AS eq17, {r(e['eq9'])} AS eq9, {r(e['eq5'])} AS eq5
      FROM (SELECT event_id, {_E['on']} AS a, {_E['off']} AS b, {_E['alpha']} AS c FROM events)"""


@query("sky9_li_ma", _li_ma_sql())
def _(s: Star):
    e = F.col("event_id")
    alpha = F.when(e % 11 == 0, F.lit(0.0)).otherwise(1.0 / (100 + e % 21))
    off = F.when(e % 7 == 0, F.col("user_id") % 40 * (100 + e % 21)).otherwise(e % 1200)
    sig = st.li_ma(F.col("user_id") % 40, off, alpha)
    return rounded(s.table("events").select("event_id", *[sig[k].alias(k) for k in ("eq17", "eq9", "eq5")]))


@query("sky10_significance_map", sql(f"""
SELECT i, j, {r('"testPosX"')} AS "testPosX", {r('"testPosY"')} AS "testPosY", {r('s17')} AS significance, n_on AS "on", n_off_events AS off,
  {r('alpha')} AS alpha FROM sigmap""", "sigmap"))
def _(s: Star):
    m = sky.significance_map(_events(s), SKY)
    return rounded(m.select("i", "j", "testPosX", "testPosY", "significance", "on", "off", "alpha"))


@query("sky11_excess_map", sql(f'SELECT i, j, {r("excess")} AS excess FROM sigmap', "sigmap"))
def _(s: Star):
    return rounded(sky.significance_map(_events(s), SKY).select("i", "j", "excess"))


@query("sky12_map_distribution", sql(f'SELECT bin, {r(chr(34) + "left" + chr(34), 5)} AS "left", {r(chr(34) + "right" + chr(34), 5)} AS "right", n FROM h',
                                     "sigmap", rounded_map=f"SELECT {r('s17')} AS v FROM sigmap", h=_own_range("rounded_map", "v", "50")))
def _(s: Star):
    m = cut_lineage(sky.significance_map(_events(s), SKY).select(tidy(F.col("significance")).alias("v")))
    return rounded(sky.map_distribution(m, "v"), 5)


@query("sky_flat_background", sql(f"""
SELECT i, j, n AS "on", {r('CASE WHEN n + 100e0 > 0 THEN (n - 100e0 / 109) / sqrt((n + 100e0) / 109) ELSE 0e0 END')} AS significance9 FROM oncounts""", "oncounts"))
def _(s: Star):
    flat = sky.flat_background_map(sky.counts_map(_events(s), SKY), 100.0, 109.0)
    return rounded(sky.with_significance(flat).select("i", "j", "on", "significance9"))


@query("sky13_coordinates", f"""
SELECT event_id, {r('15e0 * (hour(ts) + minute(ts) / 60e0 + floor(second(ts)) / 3600e0)')} AS ra,
  {r('(CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * (user_id % 90 + minute(ts) / 60e0 + floor(second(ts)) / 3600e0)')} AS dec FROM events""")
def _(s: Star):
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    h, m, sec = F.hour("ts"), F.minute("ts"), F.floor(F.second("ts"))
    sign = F.when(F.col("event_id") % 2 == 0, "-").otherwise("+")
    text = F.concat_ws(" ", two(h), two(m), two(sec), F.concat(sign, two(F.col("user_id") % 90)), two(m), two(sec))
    ra, dec = angles.sky_position(text)
    return rounded(s.table("events").select("event_id", ra.alias("ra"), dec.alias("dec")))


@query("sep1_angular_separation", sql(f"""
SELECT "Event", {r(separation('"Az"', '(90e0 - "Ze")', '"TrueAz"', '(90e0 - "TrueZe")'), 5)} AS from_truth,
  {r(separation('"Az"', '(90e0 - "Ze")', '0e0', '90e0'), 5)} AS from_zenith FROM aimed""", "aimed"))
def _(s: Star):
    d = _reco(s)
    az, lat = F.col("Az"), 90 - F.col("Ze")
    return rounded(d.select(
        "Event", angles.separation(az, lat, F.col("TrueAz"), 90 - F.col("TrueZe")).alias("from_truth"),
        angles.separation(az, lat, F.lit(0.0), F.lit(90.0)).alias("from_zenith")), 5)


# ---------------------------------------------------------------- selection
_Q = lambda g, G, p, P_: div(div(g, G), f"sqrt({div(p, P_)})")


def _scan_sql(value: str, step: float, test: str) -> str:
    return f"""
      SELECT CAST(i AS INTEGER) AS i, {r(f'i * {lit(step)}', 7)} AS cut, n_gamma, n_proton, {r(_Q('n_gamma', 'gt', 'n_proton', 'pt'))} AS "Q" FROM (
        SELECT i, count(*) FILTER (class = 'gamma' AND {test}) AS n_gamma, count(*) FILTER (class = 'proton' AND {test}) AS n_proton
        FROM range(10001) t(i) CROSS JOIN (SELECT class, "Event", {value} AS v FROM scanned GROUP BY class, "Event") GROUP BY i)
      CROSS JOIN (SELECT count(DISTINCT CASE WHEN class = 'gamma' THEN "Event" END) AS gt, count(DISTINCT CASE WHEN class = 'proton' THEN "Event" END) AS pt FROM scanned)"""


@query("qf1_qf2_max_distance_scan", sql(_scan_sql('max("Distance")', 3.0 / 10000, f"v < i * {lit(3.0 / 10000)}"), "labelled2",
                                        scanned="SELECT * FROM labelled2"))
def _(s: Star):
    return rounded(selection.max_distance_scan(s.labelled(2)), cut=7)


def _sim_table(s: Star) -> DataFrame:
    """The simulation parameters handed over as a written table, as between the programs
    of the analysis; the steps that follow read it several times."""
    return cut_lineage(s.sim())


def _simsel(s: Star) -> DataFrame:
    """Usable images with reconstructed direction and class, and their ThetaSquare."""
    rows = quality.usable_images(_sim_table(s), 2).join(s.classes(), "Event")
    return selection.zenith_theta_square(rows)


_t2 = separation('"Az"', '(90e0 - "Ze")', "0e0", "90e0")
_SEL = {
    "sel": f"""SELECT u.*, a."Az", a."Ze", ({_t2}) ** 2 AS t2 FROM labelled2 u LEFT JOIN aimed a USING ("Event")""",
    "marked": 'SELECT *, CASE WHEN "Distance" = max("Distance") OVER (PARTITION BY "Event") THEN "Distance" END AS md FROM sel',
}
_TSTEP = lit(1.0 / 10000)


@query("qf3_theta_scan", sql(_scan_sql("min(t2)", 1.0 / 10000, f"v < (i * {_TSTEP}) * (i * {_TSTEP})"), "labelled2", "aimed",
                             sel=_SEL["sel"], scanned="SELECT * FROM sel"))
def _(s: Star):
    return rounded(selection.theta_scan(_simsel(s)), cut=7)


_CUTS = {"none": "TRUE", "max_distance": "md < 2", "theta_square": f"t2 < {_ON}", "both": f"md < 2 AND t2 < {_ON}"}


@query("qf4_cut_comparison", sql(f"""
SELECT cut, g AS n_gamma, p AS n_proton, {r(_Q('g', 'gt', 'p', 'pt'))} AS "Q" FROM (""" + " UNION ALL ".join(
    f"""SELECT '{k}' AS cut, count(DISTINCT CASE WHEN class = 'gamma' AND {c} THEN "Event" END) AS g,
    count(DISTINCT CASE WHEN class = 'proton' AND {c} THEN "Event" END) AS p FROM marked""" for k, c in _CUTS.items()
) + """) CROSS JOIN (SELECT count(DISTINCT CASE WHEN class = 'gamma' THEN "Event" END) AS gt, count(DISTINCT CASE WHEN class = 'proton' THEN "Event" END) AS pt FROM marked)""",
"labelled2", "aimed", **_SEL))
def _(s: Star):
    return rounded(selection.cut_comparison(_simsel(s)))


def _class_hist(bins: int) -> str:
    return f"""SELECT g.class, CAST(k AS INTEGER) AS bin, count(b.bin) AS n FROM (SELECT DISTINCT class FROM binned WHERE bin IS NOT NULL) g CROSS JOIN range({bins}) t(k)
      LEFT JOIN binned b ON b.class = g.class AND b.bin = k GROUP BY g.class, k"""


@query("qf5_theta_histogram", sql(_class_hist(80), "labelled2", "aimed", **_SEL,
                                  binned=f"SELECT class, {fixed_bin('sqrt(t2)', 0, 1, 80)} AS bin FROM marked WHERE md < 2"))
def _(s: Star):
    return selection.theta_histogram(stats.event_maximum(_simsel(s)))


@query("qf5_distance_histogram", sql(_class_hist(80), "labelled2", "aimed", **_SEL,
                                     binned=f"SELECT class, {fixed_bin('md', 0, 4, 80)} AS bin FROM marked WHERE t2 < {_ON}"))
def _(s: Star):
    return selection.distance_histogram(stats.event_maximum(_simsel(s)))


# ----------------------------------------------------------- classification
_FEAT = f"""SELECT "Event", "Telescope", "Size", "Length", "Width", "Distance", "Length" / "Width" AS ratio,
  CAST(CASE class WHEN 'gamma' THEN 1 ELSE 2 END AS INTEGER) AS "Classification" FROM labelled"""


@query("ml1_feature_table", sql(f"""
SELECT "Event", "Telescope", "Size", "Length", "Width", "Distance", {r('ratio', 3)} AS "LengthOverWidth", "Classification" FROM feat""", "labelled", feat=_FEAT))
def _(s: Star):
    return rounded(classify.feature_table(s.labelled()), LengthOverWidth=3)


@query("ml2_train_test_split", sql("""
SELECT "Event", "Telescope", ('0x' || substr(md5("Event" || '-' || "Telescope"), 1, 4))::INTEGER % 100 < 67 AS is_train FROM feat""", "labelled", feat=_FEAT))
def _(s: Star):
    train, test = classify.train_test_split(classify.feature_table(s.labelled()))
    keys = ["Event", "Telescope"]
    return train.select(*keys, F.lit(True).alias("is_train")).unionByName(test.select(*keys, F.lit(False).alias("is_train")))


def _boosted(s: Star):
    """The operator at its full size: its defaults, all rows."""
    table = cut_lineage(classify.assemble(classify.feature_table(s.labelled())))
    train, test = classify.train_test_split(table)
    model = classify.fit_boosted_trees(train)
    return model, model.transform(test)


@query("ml3_ml4_boosted_trees")
def _(s: Star):
    _, judged = _boosted(s)
    right = (F.col("label") == F.col("prediction")).cast("double")
    return judged.agg(F.avg(right).alias("accuracy"), F.count("*").alias("n"))


@query("ml5_feature_importance")
def _(s: Star):
    model, judged = _boosted(s)
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("importance")) for k, v in model.feature_importance()])
    return judged.agg(F.count("*").alias("n")).select(F.explode(rows).alias("r"), "n").select("r.feature", "r.importance", "n")


# boosted stumps that SQL can repeat: features in whole steps, depth 1, a few rounds
_STEPS = {"Size": 150.0, "Length": 0.4, "Width": 0.25, "Distance": 0.8, "LengthOverWidth": 2.0}
_ROUNDS = 4


def _stump_views() -> dict[str, str]:
    """Per round: the split of the largest weighted Gini gain over all features and midpoints, its leaves' labels, its error,
    strength and the rows' next weights."""
    cut = ", ".join(f'CAST(least(floor("{c if c != "LengthOverWidth" else "ratio"}" / {lit(w)}), 7) AS DOUBLE) AS f{k}' for k, (c, w) in enumerate(_STEPS.items()))
    views = {
        "feat": _FEAT,
        "cut": f"""SELECT "Event", "Telescope", {cut}, CAST("Classification" - 1 AS DOUBLE) AS label,
          ('0x' || substr(md5("Event" || '-' || "Telescope"), 1, 4))::INTEGER % 100 < 67 AS is_train FROM feat""",
        "w0": "SELECT *, 1e0 AS w FROM cut WHERE is_train",
    }
    gini = lambda one, every: f"(1 - ({one} / {every}) ** 2 - (({every} - {one}) / {every}) ** 2)"
    for k in range(_ROUNDS):
        long = " UNION ALL ".join(f"SELECT {f} AS f, f{f} AS x, label, w FROM w{k}" for f in range(len(_STEPS)))
        views[f"c{k}"] = f"""SELECT f, (x + lead(x) OVER v) / 2 AS t, sum(s) OVER v AS l, sum(s1) OVER v AS l1, sum(s) OVER (PARTITION BY f) AS n, sum(s1) OVER (PARTITION BY f) AS n1
          FROM (SELECT f, x, sum(w) AS s, sum(w * label) AS s1 FROM ({long}) GROUP BY f, x) WINDOW v AS (PARTITION BY f ORDER BY x)"""
        views[f"b{k}"] = f"""SELECT f, t, CASE WHEN l1 > l - l1 THEN 1e0 ELSE 0e0 END AS below, CASE WHEN n1 - l1 > (n - l) - (n1 - l1) THEN 1e0 ELSE 0e0 END AS above
          FROM c{k} WHERE t IS NOT NULL ORDER BY {gini('n1', 'n')} - l / n * {gini('l1', 'l')} - (n - l) / n * {gini('(n1 - l1)', '(n - l)')} DESC, f, t LIMIT 1"""
        guess = "CASE WHEN (CASE b.f " + " ".join(f"WHEN {f} THEN r.f{f}" for f in range(len(_STEPS))) + " END) <= b.t THEN b.below ELSE b.above END"
        views[f"e{k}"] = f"SELECT b.*, ln((1 - e) / e) AS strength FROM b{k} b, (SELECT sum(CASE WHEN {guess} <> r.label THEN r.w ELSE 0e0 END) / sum(r.w) AS e FROM w{k} r, b{k} b)"
        views[f"w{k + 1}"] = f"SELECT r.* REPLACE (r.w * CASE WHEN {guess} <> r.label THEN exp(b.strength) ELSE 1e0 END AS w) FROM w{k} r, e{k} b"
    trees = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(_ROUNDS))
    views["trees"] = trees
    views["scored"] = f"""SELECT r."Event", r."Telescope", r.label, CASE WHEN sum(b.strength * (2 * {guess} - 1)) > 0 THEN 1e0 ELSE 0e0 END AS prediction
      FROM cut r, trees b WHERE NOT r.is_train GROUP BY ALL"""
    return views


def _stumps(s: Star):
    table = cut_lineage(classify.assemble(classify.in_steps(classify.feature_table(s.labelled()), _STEPS)))
    train, test = classify.train_test_split(table)
    model = classify.fit_boosted_trees(train, _ROUNDS, 1)
    return model, model.transform(test)


@query("ml3_ml4_boosted_stumps", sql(f"""
SELECT {r('avg(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END)')} AS accuracy, count(*) AS n FROM scored""", "labelled", **_stump_views()))
def _(s: Star):
    model, judged = _stumps(s)
    return rounded(judged.agg(F.lit(classify.accuracy(judged)).alias("accuracy"), F.count("*").alias("n")))


@query("ml5_stump_importance", sql(f"""
SELECT feature, {r("coalesce(sum(CASE WHEN below <> above THEN strength ELSE 0e0 END) / any_value(total), 0e0)", 4)} AS importance
FROM (SELECT unnest({list(_STEPS)!r}) AS feature, unnest(range({len(_STEPS)})) AS f) LEFT JOIN trees USING (f) CROSS JOIN (SELECT sum(strength) AS total FROM trees)
GROUP BY feature""", "labelled", **_stump_views()))
def _(s: Star):
    model, judged = _stumps(s)
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(v).alias("importance")) for k, v in model.feature_importance()])
    return rounded(judged.limit(1).select(F.inline(rows)), 4)


@query("ml6_stump_confusion", sql(f"""
SELECT label, prediction, count(*) AS n, {r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE)')} AS share FROM scored GROUP BY label, prediction""",
"labelled", **_stump_views()))
def _(s: Star):
    return rounded(classify.confusion_matrix(_stumps(s)[1]))


@query("ml7_stump_mistakes", sql('SELECT "Event", "Telescope", label, prediction FROM scored WHERE label <> prediction', "labelled", **_stump_views()))
def _(s: Star):
    return classify.judged_rows(_stumps(s)[1])[1].select("Event", "Telescope", "label", "prediction")


_RULE = """SELECT CAST("Classification" - 1 AS DOUBLE) AS label, CASE WHEN "Size" > 900 THEN 1e0 ELSE 0e0 END AS prediction, "Event", "Telescope" FROM feat"""


def _ruled(s: Star) -> DataFrame:
    """A fixed rule in the place of a model, so that the scores can be compared exactly."""
    guess = F.when(F.col("Size") > 900, 1.0).otherwise(0.0)
    return classify.assemble(classify.feature_table(s.labelled())).withColumn("prediction", guess)


@query("ml6_confusion_matrix", sql(f"""
SELECT label, prediction, count(*) AS n, {r('count(*) / CAST(sum(count(*)) OVER (PARTITION BY label) AS DOUBLE)')} AS share FROM ruled GROUP BY label, prediction""",
"labelled", feat=_FEAT, ruled=_RULE))
def _(s: Star):
    return rounded(classify.confusion_matrix(_ruled(s)))


@query("ml7_misclassified", sql('SELECT "Event", "Telescope", label, prediction FROM ruled WHERE label <> prediction', "labelled", feat=_FEAT, ruled=_RULE))
def _(s: Star):
    return classify.judged_rows(_ruled(s))[1].select("Event", "Telescope", "label", "prediction")


# -------------------------------------------------------------- performance
_PERF = {
    "recon": 'SELECT * FROM sim WHERE "Az" IS NOT NULL AND "Ze" IS NOT NULL',
    "chosen": """SELECT *, 'two_plus' AS selection FROM (SELECT *, row_number() OVER (PARTITION BY "Event" ORDER BY "Telescope") AS k FROM recon) WHERE k = 1
      UNION ALL SELECT *, 'three' FROM (SELECT *, row_number() OVER (PARTITION BY "Event" ORDER BY "Telescope") AS k FROM recon WHERE "Alpha" IS NOT NULL
        AND "Event" IN (SELECT "Event" FROM recon WHERE "Alpha" IS NOT NULL GROUP BY "Event" HAVING count(*) > 2)) WHERE k = 1""",
    "errors": f"""SELECT selection, "Event", "TrueEnergy", {separation('"Az"', '(90e0 - "Ze")', '"TrueAz"', '(90e0 - "TrueZe")')} AS angle_error,
      abs(sqrt("Xcore" ** 2 + "Ycore" ** 2) - sqrt("TrueXcore" ** 2 + "TrueYcore" ** 2)) AS core_error FROM chosen""",
}


@query("res1_resolution", sql(f"""
SELECT selection, 'angle_error' AS error, {r('quantile_cont(angle_error, 0.68)', 4)} AS q68, count(angle_error) AS n FROM errors WHERE "TrueEnergy" > 10000 GROUP BY selection
UNION ALL SELECT selection, 'core_error', {r('quantile_cont(core_error, 0.68)', 1)}, count(core_error) FROM errors WHERE "TrueEnergy" > 10000 GROUP BY selection""", "sim", **_PERF))
def _(s: Star):
    d = performance.resolution(s.sim())
    fine = F.when(F.col("error") == "angle_error", tidy(F.col("q68"), 4)).otherwise(tidy(F.col("q68"), 1))
    return d.withColumn("q68", fine)


@query("res1_resolution_about_zenith", sql(f"""
SELECT selection, {r('quantile_cont(off, 0.68)', 4)} AS q68, count(off) AS n FROM (SELECT selection, {separation('"Az"', '(90e0 - "Ze")', '0e0', '90e0')} AS off FROM chosen WHERE "TrueEnergy" > 10000)
GROUP BY selection""", "sim", **_PERF))
def _(s: Star):
    d = performance.resolution(s.sim(), reference="zenith").filter("error = 'angle_error'")
    return rounded(d.select("selection", "q68", "n"), 4)


@query("res1_error_histograms", sql(f"""
SELECT g.selection, g.error, CAST(k AS INTEGER) AS bin, count(b.bin) AS n FROM (SELECT DISTINCT selection, error FROM binned WHERE bin IS NOT NULL) g CROSS JOIN range(40) t(k)
LEFT JOIN binned b ON b.selection = g.selection AND b.error = g.error AND b.bin = k GROUP BY g.selection, g.error, k""", "sim", **_PERF,
binned=f"""SELECT selection, 'angle_square' AS error, {fixed_bin('angle_error * angle_error', 0, 45, 40)} AS bin FROM errors WHERE "TrueEnergy" > 10000
  UNION ALL SELECT selection, 'core', {fixed_bin('core_error', 0, 200, 40)} FROM errors WHERE "TrueEnergy" > 10000"""))
def _(s: Star):
    return performance.error_histograms(s.sim(), (0.0, 45.0), (0.0, 200.0))


@query("res2_resolution_by_threshold", sql(f"""
SELECT selection, CAST(t AS DOUBLE) AS threshold, {r('quantile_cont(angle_error, 0.68)', 4)} AS q68, count(angle_error) AS n
FROM errors JOIN range(10, 101, 10) x(t) ON "TrueEnergy" > t * 1000 GROUP BY selection, t""", "sim", **_PERF))
def _(s: Star):
    return rounded(performance.resolution_by_threshold(s.sim()), 4)


_TRIG = {
    "trig": """SELECT "Event", "TrueEnergy" / 1000 AS tev FROM (SELECT *, row_number() OVER (PARTITION BY "Event" ORDER BY "Telescope") AS k FROM sim
      WHERE "Az" IS NOT NULL AND "Ze" IS NOT NULL AND "Alpha" IS NOT NULL AND "Event" IN (SELECT "Event" FROM sim WHERE "Az" IS NOT NULL AND "Ze" IS NOT NULL
        AND "Alpha" IS NOT NULL GROUP BY "Event" HAVING count(*) >= 2)) WHERE k = 1""",
    "thrown": 'SELECT "Event", min("TrueEnergy" / 1000) AS tev FROM sim GROUP BY "Event"',
}


@query("eff1_triggered_events", sql(f'SELECT "Event", {r("tev")} AS tev FROM trig', "sim", trig=_TRIG["trig"]))
def _(s: Star):
    return rounded(performance.triggered_events(s.sim()).select("Event", (F.col("TrueEnergy") / 1000).alias("tev")))


@query("eff2_effective_area", sql(f"""
SELECT a.bin, {r('a."left"', 4)} AS "left", {r('a."right"', 4)} AS "right", a.n AS triggered, b.n AS simulated,
  {r(div(f'a.n * {lit(K.THROW_AREA_KM2)}', 'b.n'))} AS area, {r(div(f'sqrt(a.n) * {lit(K.THROW_AREA_KM2)}', 'b.n'))} AS area_error
FROM seen a JOIN sent b ON a.bin = b.bin""", "sim", **_TRIG, seen=_own_range("trig", "tev", "10"), sent=_own_range("thrown", "tev", "10")))
def _(s: Star):
    return rounded(performance.effective_area(_sim_table(s)), left=4, right=4)
