"""The star-schema tables seen as detector data.

Every view maps whole tables to the inputs of the operators: order lines become
pixel hits or photons, orders become shower truth, events become time series and
packets, embeddings become small images.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.functions.numeric import wall_clock_seconds
from lumiray.functions.stencil import raised
from lumiray.operators import images as I
from lumiray.operators import parameters as P
from lumiray.operators import quality, selection
from lumiray.plans import flows
from lumiray.schemas import SHAPE_COLUMNS

POSITIONS = K.DATA_TELESCOPES
#: decoded, these take about 110 MB, which a task sorts in memory
TASK_PACKETS = 1 << 16


def little(value, size: int):
    """A non-negative number as hexadecimal text of `size` bytes, lowest byte first."""
    text = F.lpad(F.hex(value), 2 * size, "0")
    return F.concat(*[F.substring(text, 2 * (size - k) - 1, 2) for k in range(size)])


def _science_frames():
    """Frames of the events' columns, a batch at a time; null where an event has no number or user."""

    @F.arrow_udf("binary")
    def build(column: pa.Array) -> pa.Array:
        event, user = column.field("event"), column.field("user")
        missing = ~np.asarray(pc.and_(event.is_valid(), user.is_valid()), dtype=bool)
        e, u = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (event, user))
        frames = np.zeros((len(column), K.SCIENCE_CAPLEN), dtype=np.uint8)

        def put(at: int, values: np.ndarray, of: int, size: int) -> None:
            rest = np.fmod(values, of)
            low = np.where(rest < 0, -1, rest).astype("<i8")  # all bits, as in the upper bytes of a negative number
            wide = np.ascontiguousarray(low).view(np.uint8).reshape(*low.shape, 8)[..., :size]
            frames[:, at : at + wide[0].size] = wide.reshape(len(frames), -1)

        if len(frames):
            start = K.PAYLOAD_OFFSET
            for at, values, of, size in ((0, u, 256, 1), (1, e * 0 + 2, 256, 1), (2, e, 65536, 2), (4, u, 1024, 2), (6, e * 65537, 1 << 32, 4), (10, e * 99991, 10**9, 4)):
                put(start + at, values, of, size)
            put(start + 16, e[:, None] * 7 + np.arange(K.PACKET_PIXELS) * 257, 65536, 2)
        offsets = np.arange(len(frames) + 1, dtype=np.int32) * K.SCIENCE_CAPLEN
        whole = pa.Array.from_buffers(pa.binary(), len(frames), [None, pa.py_buffer(offsets), pa.py_buffer(frames.reshape(-1))])
        return pc.if_else(pa.array(missing), pa.scalar(None, pa.binary()), whole)

    return build


class Star:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def hits(self) -> DataFrame:
        """Pixel hits: event, telescope, px, py, adu."""
        return self.table("lineitem").select(
            F.expr("l_orderkey div 3").alias("event"),
            (F.col("l_orderkey") % 3 + 1).cast("int").alias("telescope"),
            (F.col("l_partkey") % 32).cast("int").alias("px"),
            (F.col("l_suppkey") % 32).cast("int").alias("py"),
            (F.col("l_quantity") * 10).cast("bigint").alias("adu"),
            "l_shipdate",
            F.col("l_orderkey").alias("order"),
        )

    def pixels(self) -> DataFrame:
        return I.sum_cells(self.hits())

    def hub(self) -> DataFrame:
        """The image-parameter table; file and index are derived from the event."""
        moments = P.raw_moments(self.hits(), extra=(F.min("l_shipdate").alias("first_"),))
        params = P.image_parameters(moments)
        return params.select(
            F.concat(F.lit("run"), (F.col("Event") % 5).cast("string")).alias("File"),
            F.col("Event").alias("In_file_Index"),
            "Event",
            "Telescope",
            (wall_clock_seconds(F.col("first_")) + F.col("Event") % 600).alias("Timestamp"),
            *SHAPE_COLUMNS,
        )

    def usable(self, least: int = 0) -> DataFrame:
        return quality.usable_images(self.hub(), least)

    def shower(self) -> DataFrame:
        """Simulated shower per event: energy, az, ze, xcore, ycore."""
        lo, hi = F.min("o_custkey"), F.max("o_custkey")
        return self.table("orders").groupBy(F.expr("o_orderkey div 3").alias("event")).agg(
            (F.max("o_totalprice") / 5).alias("energy"),
            (lo % 360).cast("double").alias("az"),
            ((hi % 41) / 20).alias("ze"),
            (lo % 301 - 150).cast("double").alias("xcore"),
            (hi % 301 - 150).cast("double").alias("ycore"),
        )

    def truth(self) -> DataFrame:
        return I.shower_truth(self.shower())

    def classes(self) -> DataFrame:
        """Event class: gamma when any of its orders is fulfilled."""
        status = F.max((F.col("o_orderstatus") == "F").cast("int"))
        label = F.when(status == 1, selection.GAMMA).otherwise(selection.PROTON)
        return self.table("orders").groupBy(F.expr("o_orderkey div 3").alias("Event")).agg(label.alias("class"))

    def labelled(self, least: int = 0) -> DataFrame:
        return self.usable(least).join(self.classes(), "Event")

    def sim(self) -> DataFrame:
        """Simulation parameter table with reconstructed columns."""
        return flows.sim_parameters(self.hub(), self.truth(), POSITIONS, unique_images=True)

    def array_events(self) -> DataFrame:
        """Array events of all hits, laid along a track in each image, on a pedestal of ten counts."""
        order, k = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
        hits = self.table("lineitem").select(
            F.expr("l_orderkey div 3").alias("event"), (order % 3 + 1).cast("int").alias("telescope"),
            ((order * 5 + k) % 32).cast("int").alias("px"), ((order * 3 + k) % 32).cast("int").alias("py"),
            (F.col("l_quantity") * 10).cast("bigint").alias("adu"),
        )
        images = I.images_from_pixels(I.sum_cells(hits))
        return images.select(
            F.concat(F.lit("run"), (F.col("event") % 5).cast("string")).alias("file"), F.col("event").alias("Event"),
            F.col("telescope").alias("Telescope"), F.col("telescope").alias("scope_id"), (F.col("event") % 600).cast("double").alias("pcap_time"),
            raised(10)(F.col("image")).alias("pix"),
        )

    def pedestals(self) -> DataFrame:
        """A map of 10.5 counts for each file and telescope of `array_events`."""
        files = self.spark.range(5).select(F.concat(F.lit("run"), F.col("id").cast("string")).alias("file"))
        scopes = self.spark.range(1, 4).select(F.col("id").cast("int").alias("scope_id"))
        return files.join(scopes).withColumn("peds", F.array_repeat(F.lit(10.5), K.CAMERA_SIDE**2))

    def many(self) -> DataFrame:
        """Image parameters where an event has any number of images, several of a telescope, and of a fourth one."""
        keys = self.hits().withColumns({"event": F.col("order"), "telescope": (F.col("order") % 4 + 1).cast("int")})
        params = P.image_parameters(P.raw_moments(keys))
        return params.withColumn("Event", F.expr("Event div 4"))

    def photons(self) -> DataFrame:
        """Photon bunches: direction about the shower's own, and their photon number."""
        return self.table("lineitem").select(
            F.expr("l_orderkey div 3").alias("event"),
            (F.col("l_orderkey") % 3 + 1).cast("int").alias("telescope"),
            ((F.col("l_discount") - 0.05) / 2 + (F.col("l_quantity") - 25.5) * 1e-4).alias("cx"),
            ((F.col("l_tax") - 0.04) / 2 + (F.col("l_partkey") % 97 - 48.3) * 1e-4).alias("cy"),
            F.col("l_quantity").cast("bigint").alias("photons"),
        )

    def series(self) -> DataFrame:
        """Time series of images: Telescope, Timestamp, Width, Size, MeanX, MeanY."""
        return self.table("events").select(
            F.col("event_id").alias("Event"),
            (F.col("user_id") % 3 + 1).cast("int").alias("Telescope"),
            wall_clock_seconds(F.col("ts")).alias("Timestamp"),
            F.col("value").alias("Width"),
            (F.col("value") * 10 + 1).alias("Size"),
        )

    @staticmethod
    def series_time():
        return wall_clock_seconds(F.col("ts"))

    def patches(self) -> DataFrame:
        """Embeddings as 8x8 images: vec_id, label, pix in thousandths."""
        return self.table("embeddings").select(
            "vec_id",
            "label",
            F.transform("embedding", lambda v: (v.cast("double") * 1000).cast("int")).alias("pix"),
        )

    def frames(self, task_packets: int | None = None) -> DataFrame:
        """Events as capture packets. A science packet has 570 bytes whose payload holds
        the event's columns, little-endian; an `error` event is a short packet.

        With `task_packets`, the events, which are short beside their packets, are dealt out by number first, so that a
        task makes about so many packets and a file comes from few tasks."""

        events = self.table("events")
        if task_packets:
            parts = -(-events.count() // task_packets) or 1
            events = events.repartitionByRange(parts, "event_id", "ts", "user_id")
        eid = F.col("event_id")
        micros = F.round(wall_clock_seconds(F.col("ts")) * 1e6).cast("bigint")
        fields = F.struct(eid.alias("event"), F.col("user_id").alias("user"))
        short = F.col("event_type") == "error"
        data = F.when(short, F.unhex(F.repeat(F.lit("AB"), 60))).otherwise(_science_frames()(fields))
        return events.withColumns({"micros": micros, "data": data}).select(
            F.concat(F.lit("capture"), F.expr("event_id div 1000").cast("string")).alias("file"),
            eid.alias("seq"),
            F.expr("micros div 1000000").alias("ts_sec"),
            (F.col("micros") % 1000000).cast("int").alias("ts_usec"),
            # as a rule of its own, so that filters on it do not build frames
            F.when(short, 60).when(eid.isNotNull() & F.col("user_id").isNotNull(), K.SCIENCE_CAPLEN).alias("caplen"),
            "data",
        )

    def ng_captures(self) -> DataFrame:
        """The same packets as next-generation capture files with nanoseconds, a name block behind every tenth packet."""

        size = F.col("caplen").cast("bigint")
        pad = F.pmod(-size, F.lit(4)).cast("int")
        total = little(size + pad + 32, 4)
        ticks = F.col("ts_sec") * 1_000_000_000 + F.col("ts_usec").cast("bigint") * 1000
        head = F.concat(F.lit("06000000"), total, F.lit("00000000"), little(F.shiftright(ticks, 32), 4), little(ticks.bitwiseAND((1 << 32) - 1), 4), little(size, 4), little(size, 4))
        name = F.when(F.col("seq") % 10 == 0, F.lit("04000000" + "10000000" + "00000000" + "10000000")).otherwise(F.lit(""))
        record = F.concat(F.unhex(head), F.col("data"), F.unhex(F.concat(F.repeat(F.lit("00"), pad), total, name)))
        section = "0A0D0D0A" + "1C000000" + "4D3C2B1A" + "01000000" + "FF" * 8 + "1C000000"
        interface = "01000000" + "20000000" + "01000000" + "FFFF0000" + "09000100" + "09000000" + "00000000" + "20000000"
        ordered = F.array_sort(F.collect_list(F.struct("seq", record.alias("record"))))
        bodies = self.frames().groupBy("file").agg(ordered.alias("records"))
        joined = F.unhex(F.array_join(F.transform("records", lambda r: F.hex(r["record"])), ""))
        return bodies.select("file", F.concat(F.unhex(F.lit(section + interface)), joined).alias("content"))

    def captures(self) -> DataFrame:
        """Whole capture files as bytes: (file, content), a thousand packets each."""

        size = F.col("caplen").cast("bigint")
        record = F.concat(
            F.unhex(F.concat(little(F.col("ts_sec"), 4), little(F.col("ts_usec").cast("bigint"), 4), little(size, 4), little(size, 4))),
            F.col("data"),
        )
        start = F.unhex(F.lit("D4C3B2A102000400" + "00" * 8 + "FFFF0000" + "01000000"))
        ordered = F.array_sort(F.collect_list(F.struct("seq", record.alias("record"))))
        bodies = self.frames().groupBy("file").agg(ordered.alias("records"))
        joined = F.unhex(F.array_join(F.transform("records", lambda r: F.hex(r["record"])), ""))
        return bodies.select("file", F.concat(start, joined).alias("content"))
