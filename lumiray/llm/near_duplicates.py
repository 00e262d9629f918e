"""Operator 7: near duplicates by a parity-sketch join over sets of word shingles.

Two texts link when their sets of five-word shingles have a Jaccard similarity of 3/4 or more, that is
when at most a seventh of their sizes' sum is in only one of them. Sizes fall into bands, so that
every pair that can link meets in the band of the smaller text.

1. Every text gets its set's size and hash (equal sets are one class from here on), and parity sketches
   of its two bands: each shingle flips one bit. The bits that differ bound the shingles that differ.
2. Pigeonhole join: in the band's wide sketch, a row of 64-bit words into which the shingles are XORed,
   no more words differ than shingles do. `shingles.part_keys` tells why it is enough to join on a
   bounded number of words of each text, the least common first, and nothing is lost.
3. Pairs out of groups of up to eight with an equal word are kept if they share enough words and their sketches
   differ in few enough bits. Members
   of large groups are held together by edges to one of them, not by pairs.
4. Candidates fall into clusters. The sets of a large cluster are first held against one of them, its hub; only those
   that do not link with it meet the others. They meet in tiles of bounded size; inside a tile the
   sketches rule pairs out, the sets verify the rest exactly, and pairs already connected are
   passed over. Links between different sets are the only thing that joins classes.

How common shingles are only orders the words, so that passages which many texts share are keys of a text only if it
has little else; a wrong estimate costs time, never a link. It is counted over every eighth class of texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiray.llm import shingles
from lumiray.llm.common import arrow_blocks, cut_lineage, mix64, ship_package
from lumiray.llm.components import connected_components
from lumiray.session import broadcast_if_small, small_table

SMALL = 8  # groups up to this size are taken apart into pairs
TILE = 1024  # sets in a tile; two tiles meet in a task
COUNTED = 8  # shingles are counted over one in so many classes
MOST_COMMON = 1_000_000  # the most frequent shingles, which go to every task


def _set_hashes(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set: sums of differently scrambled members."""
    ends = np.append(0, np.cumsum(counts))

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
        return mix64(sums[ends[1:]] - sums[ends[:-1]] + counts.astype(np.uint64))

    return total(mix64(values)).view(np.int64), total(mix64(values ^ np.uint64(0xA5A5A5A55A5A5A5A))).view(np.int64)


PROFILE = "doc_id long, text_hash long, n long, band int, c1 long, c2 long, own binary, low binary, shingle long"


def profiles(docs: DataFrame) -> DataFrame:
    """A row for each text, and rows of the shingles of the classes that are counted, once for each block of texts."""
    ship_package(docs.sparkSession)
    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n": pa.int64(), "band": pa.int32(), "c1": pa.int64(), "c2": pa.int64(), "own": pa.binary(), "low": pa.binary(), "shingle": pa.int64()}

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()], list(kinds))

    def profile(batches):
        for batch in batches:
            for at, block in arrow_blocks(batch.column(2)):
                values, counts = shingles.shingle_sets(block)
                c1, c2 = _set_hashes(values, counts)
                band = shingles.band_of(np.maximum(counts, 1))
                own = shingles.parity_sketches(values, counts, band)
                low = shingles.parity_sketches(values, counts, np.maximum(band - 1, 0))
                ids = [batch.column(k).slice(at, len(block)) for k in range(2)]
                yield rows(len(block), doc_id=ids[0], text_hash=ids[1], n=counts, band=band.astype(np.int32), c1=c1, c2=c2, own=own, low=low)
                counted = np.zeros(len(block), dtype=bool)
                counted[np.unique(c1, return_index=True)[1]] = True
                counted &= c1.view(np.uint64) % np.uint64(COUNTED) == 0
                found = values[np.repeat(counted, counts)].view(np.int64)
                yield rows(len(found), shingle=found)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(profile, PROFILE)


def common_shingles(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles that were counted three times or more, ascending, with their counts; a bounded list."""
    counts = cut_lineage(profile.filter("shingle is not null").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3"))
    # the least count whose shingles still fit
    steps = sorted(((r["least"], r["shingles"]) for r in counts.groupBy(F.floor(4 * F.log2("n")).alias("step")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("shingles")).collect()), reverse=True)
    room, least = MOST_COMMON, None
    for first, n in steps:
        room -= n
        if room < 0:
            break
        least = first
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    found = counts.filter(F.col("n") >= int(least)).select("shingle", F.col("n").cast("int").alias("n")).toArrow()
    values, n = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def weights(values: np.ndarray, names: np.ndarray, seen: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How common each shingle is; 0 for most. `marks` tells by the first 24 bits whether a shingle can be among `names`."""
    out = np.zeros(len(values), dtype=np.int64)
    maybe = np.flatnonzero(marks[(values >> np.uint64(40)).astype(np.int64)])
    if len(maybe):
        at = np.minimum(np.searchsorted(names, values[maybe]), len(names) - 1)
        out[maybe] = np.where(names[at] == values[maybe], seen[at], 0)
    return out


def join_keys(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, c1) of every text, in both bands it takes part in."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def emit(batches):
        names, seen = shared.value
        marks = np.zeros(1 << 24, dtype=bool)
        marks[(names >> np.uint64(40)).astype(np.int64)] = True
        rows = lambda keys, c1: pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c1)], ["key", "c1"])
        for batch in batches:
            for _, block in arrow_blocks(batch.column(0)):
                block = [t for t in dict.fromkeys(block) if t]
                if not block:
                    continue
                values, counts = shingles.shingle_sets(block)
                c1, _ = _set_hashes(values, counts)
                weight = weights(values, names, seen, marks)
                band = shingles.band_of(np.maximum(counts, 1))
                keys, n = shingles.part_keys(values, counts, band, (counts + counts * 4 // 3) // 7, weight)
                yield rows(keys, np.repeat(c1, n))
                # as the larger text of the band below
                most = shingles.largest(np.maximum(band - 1, 0))
                use = (band > 0) & (counts > 0) & (counts <= most * 4 // 3)
                if use.any():
                    own = np.repeat(use, counts)
                    keys, n = shingles.part_keys(values[own], counts[use], band[use] - 1, ((counts + most) // 7)[use], weight[own])
                    yield rows(keys, np.repeat(c1[use], n))

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(emit, "key long, c1 long")


def _sketches_near(n_a: pd.Series, sketch_a: pd.Series, n_b: pd.Series, sketch_b: pd.Series) -> pd.Series:
    """Whether so few bits of two sketches differ that the sets may link."""
    apart = [int(np.bitwise_count(np.frombuffer(x, dtype=np.uint64) ^ np.frombuffer(y, dtype=np.uint64)).sum()) for x, y in zip(sketch_a, sketch_b, strict=True)]
    return pd.Series(7 * np.array(apart, dtype=np.int64) <= n_a.to_numpy() + n_b.to_numpy())


def _sets_near(members_a: pd.Series, members_b: pd.Series) -> pd.Series:
    """Whether two sets link."""
    out = []
    for x, y in zip(members_a, members_b, strict=True):
        a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        least, most = sorted((len(a), len(b)))
        shared = len(np.intersect1d(a, b, assume_unique=True)) if 4 * least >= 3 * most else 0
        out.append(100 * shared >= 75 * (len(a) + len(b) - shared))
    return pd.Series(out, dtype=bool)


def tile_links(names: list, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """Links between members on the left and right side that connect all that are linked; names of a side may repeat
    on the other. Sets are sorted. A pair is compared only while its members are not connected yet."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    band = shingles.band_of(np.maximum(sizes, 1))
    label = np.arange(len(sets))
    links = []
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    for level in np.unique(band):
        # the smaller text of a pair is in the band, the larger one in it or the next
        use = np.flatnonzero((band == level) | (band == level + 1))
        own = np.repeat(np.isin(np.arange(len(sets)), use), sizes)
        made = shingles.parity_sketches(every[own], sizes[use], np.full(len(use), level))
        sketch = np.array([np.frombuffer(m, dtype=np.uint64) for m in made])
        place = np.full(len(sets), -1)
        place[use] = np.arange(len(use))
        others = use[right[use]]
        for i in use[left[use]]:
            own_band = band[i] == level
            js = others[(others != i) & (label[others] != label[i])]
            js = js[(band[js] == level) | own_band]
            js = js[(4 * sizes[js] >= 3 * sizes[i]) & (4 * sizes[i] >= 3 * sizes[js])]
            if not len(js):
                continue
            apart = np.bitwise_count(sketch[place[js]] ^ sketch[place[i]]).sum(axis=1, dtype=np.int64)
            for j in js[7 * apart <= sizes[js] + sizes[i]]:
                if label[i] != label[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
                        links.append((names[i], names[j]))
                        label[label == label[j]] = label[i]
    return links


def to_least(links: list[tuple]) -> list[tuple]:
    """The members that links connect, each tied to the least it is connected with."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(x, find(x)) for x in root if find(x) != x]


def find_links(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of classes that connect all linked classes and no others. What a tile finds is tied to the least node,
    so that labels need not run along chains of links, each step of which is a round of joins."""
    spark = docs.sparkSession
    texts = profile.filter("shingle is null")
    node = F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0"))
    # one row of each class, of any of its texts: they have the same set
    columns = ("c1", "n", "band", "own", "low")
    classes = cut_lineage(texts.filter("n > 0").withColumn("node", node).groupBy("node").agg(*[F.any_value(c).alias(c) for c in columns]))
    keys = join_keys(docs, common_shingles(profile))
    # one exchange by key: small groups become lists of their members, members of large ones stay rows beside
    # the group's least. A copy that another task met counts once more, which only may call a group large
    group = Window.partitionBy("key")
    ruled = keys.withColumn("hub", F.min("c1").over(group)).withColumn("_most", F.max("c1").over(group)).withColumn("_rows", F.count(F.lit(1)).over(group))
    shared = ruled.filter("hub <> _most").withColumn("_member", F.when(F.col("_rows") > SMALL, F.col("c1")))
    met = cut_lineage(shared.groupBy("key", "_member", "hub").agg(F.sort_array(F.collect_set("c1")).alias("s")).select("_member", "hub", "s"))
    sets = met.filter("_member is null").groupBy("s").agg(F.count(F.lit(1)).alias("keys"))
    firsts = sets.select("s", "keys", F.posexplode("s").alias("at", "a"))
    pairs = firsts.select("a", "keys", F.explode(F.slice("s", F.col("at") + 2, F.size("s"))).alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("keys").alias("keys"))
    # candidates go by the first hash alone: should it coincide, clusters merge, which costs comparisons and no more.
    # sizes first, which are short; then of each side the sketch of the band they meet in, the smaller one's
    of = lambda side: classes.select(F.col("c1").alias(side), F.col("n").alias(f"n_{side}"), F.col("band").alias(f"band_{side}"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sized = pairs.join(of("a"), "a").join(of("b"), "b").filter(4 * small >= 3 * large).withColumn("level", F.least("band_a", "band_b"))
    # a pair that shares a key in a large group is tied there; any other has all its keys here
    enough = F.element_at(F.array(*[F.lit(int(n)) for n in shingles.least_shared(np.arange(len(shingles.BOUNDS) - 1))]), F.col("level") + 1)
    sized = sized.filter(F.col("keys") >= enough)
    bands = F.array(F.struct(F.col("band").alias("level"), F.col("own").alias("sketch")), F.struct((F.col("band") - 1).alias("level"), F.col("low").alias("sketch")))
    sketches = classes.select("c1", F.inline(bands))
    sketch_of = lambda side: sketches.select(F.col("c1").alias(side), "level", F.col("sketch").alias(f"sketch_{side}"))
    near = F.pandas_udf(_sketches_near, "boolean")
    close = sized.select("a", "b", "level", "n_a", "n_b").join(sketch_of("a"), ["a", "level"]).join(sketch_of("b"), ["b", "level"])
    close = close.filter(near("n_a", "sketch_a", "n_b", "sketch_b")).select("a", "b")
    # members of a large group hang together by its hub: a member by the least of its hubs, the others by that one too,
    # so that near copies, which share many hubs, give few edges
    hubs = met.filter("_member is not null").groupBy("_member").agg(F.collect_set("hub").alias("_hubs")).withColumn("b", F.array_min("_hubs"))
    tied = hubs.select(F.explode(F.array_append("_hubs", F.col("_member"))).alias("a"), "b").filter("a <> b").distinct()
    clusters = connected_components(close.unionByName(tied)).select(F.col("node").alias("c1"), "root")

    # the sets of the clusters' classes, from one text of each
    chosen = texts.withColumn("node", node).join(clusters, "c1").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.any_value("root").alias("root"))
    chosen = cut_lineage(chosen.select("node", "root", F.col("of.doc_id").alias("_id"), F.col("of.text_hash").alias("_hash")))
    tiles = chosen.groupBy("root").agg((F.floor(F.count(F.lit(1)) / TILE) + 1).alias("_tiles"))
    placed = chosen.join(tiles, "root").withColumn("_tile", F.pmod(F.xxhash64("node"), F.col("_tiles")))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").join(
        broadcast_if_small(placed), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    )

    def members(batches):
        for batch in batches:
            for at, block in arrow_blocks(batch.column(4)):
                values, counts = shingles.shingle_sets(block)
                sets = pa.array([v.tobytes() for v in np.split(values, np.cumsum(counts)[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(at, len(block)) for k in range(4)], sets], ["node", "root", "_tile", "_tiles", "members"])

    # a repeated row comes twice, which links it with itself
    fields = "node string, root long, _tile long, _tiles long, members binary"
    sets = cut_lineage(wanted.select("node", "root", "_tile", "_tiles", F.col("text").cast("binary").alias("text")).mapInArrow(members, fields))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows["_left"].to_numpy(dtype=bool), rows["_right"].to_numpy(dtype=bool)
        found = tile_links(rows["node"].tolist(), [np.frombuffer(m, dtype=np.uint64) for m in rows["members"]], left, right)
        return pd.DataFrame(to_least(found), columns=["a", "b"], dtype=object)

    both = F.lit(True)
    small = sets.filter("_tiles = 1").select("node", "members", F.col("root").alias("_root"), F.lit(0).cast("long").alias("_i"), F.lit(0).cast("long").alias("_j"), both.alias("_left"), both.alias("_right"))
    hubs = sets.filter("_tiles > 1").groupBy("root").agg(F.min(F.struct("node", "members")).alias("hub"))
    hubs = broadcast_if_small(hubs.select(F.col("root").alias("_root"), F.col("hub.node").alias("_hub"), F.col("hub.members").alias("_hub_members")))
    near_hub = F.pandas_udf(_sets_near, "boolean")("members", "_hub_members")
    against = cut_lineage(sets.filter("_tiles > 1").join(hubs, F.col("root") == F.col("_root")).select("node", "root", "_tile", "_tiles", "_hub", (near_hub | (F.col("node") == F.col("_hub"))).alias("_near")).distinct())
    strangers = against.filter("NOT _near").select("root", "node")
    of_root = small_table(strangers.groupBy(F.col("root").alias("_root")).agg((F.floor(F.count(F.lit(1)) / TILE) + 1).alias("_parts")))
    # strangers of a part meet all tiles; members of a tile meet all parts of strangers
    waiting = sets.filter("_tiles > 1").join(of_root, F.col("root") == F.col("_root"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    met_by = waiting.select("node", "members", "_root", every(F.col("_parts")).alias("_i"), F.col("_tile").alias("_j"), F.lit(False).alias("_left"), both.alias("_right"))
    own = waiting.join(strangers.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_semi")
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_parts"))
    alone = own.select("node", "members", "_root", part.alias("_i"), every(F.col("_tiles")).alias("_j"), both.alias("_left"), F.lit(False).alias("_right"))
    met = small.unionByName(met_by).unionByName(alone)
    found = met.groupBy("_root", "_i", "_j").applyInPandas(compare, "a string, b string")
    return found.unionByName(against.filter("_near AND node <> _hub").select(F.col("node").alias("a"), F.col("_hub").alias("b")))


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, root (of the component; null without words) and component_id of each document."""
    narrow = docs.select("doc_id", "text")
    profile = cut_lineage(profiles(narrow))
    links = cut_lineage(find_links(narrow, profile))
    node = F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0"))
    texts = profile.filter("shingle is null").select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, node).alias("node"))
    least = texts.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("_own"))
    roots = connected_components(links)
    joined = cut_lineage(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = joined.groupBy("root").agg(F.min("_own").alias("component_id"))
    of_node = joined.join(ids, "root").select(F.col("node").alias("_node"), "root", "component_id")
    return texts.join(of_node, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "text_hash", "n", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, component_id (the least doc_id it is linked with, over
    any number of links).

    Equal shingle sets are linked. Null and empty texts, and texts of blanks, have no shingles and are their own
    component. One to four words are one shingle. Repeated rows get a row each. A null doc_id links like any other but
    is nobody's component_id; where a component has no other id, it is null. Other columns are ignored. An empty
    table gives an empty result."""
    return _grouped(docs).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the one of least doc_id, rows without an id last, then of least
    text hash. Repeated rows are kept once. Documents without words stay."""
    names = docs.columns
    found = _grouped(docs)
    best = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_last"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))).alias("of"))
    blank = found.filter("root is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    stays = best.select("of._id", "of._hash").unionByName(blank)
    own = docs.withColumn("_text_hash", F.xxhash64("text"))
    kept = own.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")))
    return kept.dropDuplicates(["doc_id", "_text_hash"]).select(*[F.col(f"`{c}`") for c in names])


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s
  FROM words
), sized AS (
  SELECT doc_id, len(s) AS n, s FROM sets
), rows_of AS (
  SELECT doc_id, n, unnest(s) AS h FROM sized
), shared_by AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
  FROM rows_of a JOIN rows_of b ON a.h = b.h AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared_by WHERE 100 * shared >= 75 * (n + m - shared)
)"""


def oracle_sql() -> str:
    """Links by a plain self-join of shingles, components by following them."""
    return (
        ORACLE
        + """, reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, d.n AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id FROM sized d
"""
    )
