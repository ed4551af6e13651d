"""SimHash fingerprints and near-duplicate components.

Fingerprints are linked by tiled exact comparison: exclusive-or and bit counts on
numpy tiles, skipping tile pairs whose population counts differ by more than the
radius. Two fingerprints that differ in at most r of n > r blocks of bits agree on
n - r whole blocks, so only fingerprints that share such a key meet, in sorted runs
cut into tiles. A key held by very many fingerprints is dealt out by population count
over pairs of parts; pairs whose population counts differ by more than the radius are
never formed, and no task ever holds more than two parts of one key.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequery.llm.common import durable, map_text, unused

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows compared at once, and rows of one key that a task takes before the key is dealt out.
TILE, KEY_ROWS = 512, 8192
#: Rows that go, up to which they are broadcast to take them out; beyond, a join does it.
BROADCAST_ROWS = 500_000


def fingerprint_bytes(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text in UTF-8.

    A-Z are lowered, words are runs without ASCII white space, shingles count as often
    as they occur; fewer words than a shingle hash as one, none give 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], dtype=">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, keep, fp): one row a document; null and blank texts get 0."""

    def start():
        return lambda texts: {"fp": [fingerprint_bytes(t) for t in texts]}

    words = unused(docs, "words")
    source = docs.select(id_col, *(keep or []), F.col(text_col).cast("binary").alias(words))
    return map_text(source, words, start, "fp long")


def masks(blocks: int, agree: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of `agree` of the blocks of a fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = [sum(own[i] for i in pick) for pick in combinations(range(blocks), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def link_tiles(key: np.ndarray, fps: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a key; rows come sorted by key and population count.

    Compares a tile with itself and with later tiles as long as they go on with its
    last key, and skips pairs of tiles whose population counts are further apart than
    the radius. Returned are edges to the least row of each local component: as many as
    rows at most, with the same components as all links.
    """
    n = len(fps)
    pops = np.bitwise_count(fps)
    label = np.arange(n)

    starts = range(0, n, tile)
    low = [int(pops[a : a + tile].min()) for a in starts]
    high = [int(pops[a : a + tile].max()) for a in starts]
    for i, a in enumerate(starts):
        last = key[min(a + tile, n) - 1]
        for j in range(i, len(starts)):
            b = starts[j]
            if j > i and key[b] != last:
                break
            if low[j] - high[i] > radius or low[i] - high[j] > radius:
                continue
            near = np.bitwise_count(fps[a : a + tile, None] ^ fps[None, b : b + tile]) <= radius
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if not len(x):
                continue
            x, y = x + a, y + b
            # labels are always flat here, so hooking roots onto lesser roots joins components
            while True:
                u, v = label[x], label[y]
                open_ = u != v
                if not open_.any():
                    break
                x, y, u, v = x[open_], y[open_], u[open_], v[open_]
                np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
                label = label[label]
                while True:
                    deeper = label[label]
                    if (deeper == label).all():
                        break
                    label = deeper
    moved = np.nonzero(label != np.arange(n))[0]
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct values of `fp` within the radius.

    blocks: of bits, for the keys; by default more as the number of fingerprints grows,
    so that a key is shared by few. Any choice finds every link.
    """
    if blocks is None:
        n = fps.count()
        blocks = radius + (1 if n < 1 << 22 else 2 if n < 1 << 29 else 3)
    keys = masks(blocks, blocks - radius)
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(keys)])).alias("k")
    ).select("fp", "k.*")
    keyed = keyed.withColumn("pop", F.bit_count("fp"))
    held = keyed.groupBy("c", "v", "pop").agg(F.count("*").alias("m"))
    half = KEY_ROWS // 2
    # 64 population counts at most: how many parts those of a popular key have
    many = F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("m") / half).cast("int").alias("parts"))))
    held = held.groupBy("c", "v").agg(F.sum("m").alias("n"), many.alias("parts")).filter("n > 1")
    held = held.withColumn("parts", F.when(F.col("n") > KEY_ROWS, F.col("parts")))
    met = keyed.join(held, ["c", "v"])
    own = F.pmod(F.xxhash64("fp"), F.try_element_at("parts", F.col("pop"))).cast("int")
    near = F.filter(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda p: F.map_contains_key("parts", p))
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), F.try_element_at("parts", p) - 1), lambda t: p * (1 << 20) + t)))
    mine = F.col("pop") * (1 << 20) + own
    met = met.withColumn("mine", F.when(F.col("parts").isNull(), 0).otherwise(mine))
    met = met.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)))
    dealt = met.select("c", "v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    run = (
        dealt.repartition("c", "v", "i", "j")
        .withColumn("key", F.xxhash64("c", "v", "i", "j"))
        .sortWithinPartitions("key", F.bit_count("fp"))
        .select("key", "fp")
    )

    def compare(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(k, f):
            a, b = link_tiles(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)])
            if len(key) > 4 * KEY_ROWS and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                yield emit(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield emit(key, fp)

    return run.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node with an edge can reach.

    Rounds of hooking: every node of the contracted graph hooks onto its least
    neighbour, edges move to the new names, loops and repeats go. Each round leaves
    half the nodes of a component at most; only counts reach the driver.
    """
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    names = durable(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("x", "y")
        hook = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("to"))
        jump = hook.select(F.col("x").alias("to"), F.col("to").alias("next"))
        hook = durable(hook.join(jump, "to", "left").select("x", F.coalesce(F.least("to", "next"), "to").alias("to")))
        names = durable(names.join(hook, names.root == hook.x, "left").select("node", F.coalesce("to", "root").alias("root")))
        ha, hb = hook.toDF("a", "to_a"), hook.toDF("b", "to_b")
        moved = edges.join(ha, "a").join(hb, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = durable(moved.filter("a <> b").distinct())
    return names


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id): one row a row of docs.

    component_id is the smallest id reachable by links of fingerprints at `radius` or
    fewer differing bits, the document itself included. Null ids never name a component
    (null only if all ids of a component are null). Repeated rows and repeated texts
    share a fingerprint, hence a component. Empty input gives an empty result; other
    columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = _named(durable(fingerprints(source, "id", "text")), radius)
    return named.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(marked: DataFrame, radius: int) -> DataFrame:
    """(…, root, component_id): rows (id, …, fp) with the least fingerprint and the smallest id of their components."""
    distinct = durable(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.join(first, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay: the one with the smallest id of each component, with its own columns.

    Of rows with that id and equal texts one stays. Null and blank texts have a
    fingerprint and are near copies of each other. A component whose ids are all null
    stays whole, as nothing tells its rows apart. Empty input gives an empty result.
    Texts are shuffled only where more rows go than may be broadcast, or to tell equal
    rows apart.
    """
    spot = unused(docs, "spot")
    marked = docs.withColumn(spot, F.xxhash64(F.col(text_col).cast("string")))  # with its id, a row's name
    source = marked.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(spot).alias("spot"))
    found = durable(_named(durable(fingerprints(source, "id", "text", ["spot"])), radius))
    stays = F.col("id").eqNullSafe(F.col("component_id"))
    first = Window.partitionBy("id", "root").orderBy("spot")
    rows = found.groupBy("id", "spot", "root", "component_id").agg(F.count("*").alias("n"))
    ours = rows.filter(stays).withColumn("nth", F.when(F.col("id").isNull(), 1).otherwise(F.row_number().over(first)))
    gone = durable(rows.filter(~stays).select("id", "spot").unionByName(ours.filter("nth > 1").select("id", "spot")))
    twins = durable(ours.filter("nth = 1 AND n > 1 AND id IS NOT NULL").select("id", "spot"))
    kept = _without(marked, gone, id_col, spot)
    if not twins.isEmpty():
        again = F.broadcast(twins) if twins.count() <= BROADCAST_ROWS else twins
        same = marked[id_col].eqNullSafe(again["id"]) & marked[spot].eqNullSafe(again["spot"])
        kept = _without(kept, twins, id_col, spot).unionByName(marked.join(again, same, "left_semi").dropDuplicates([id_col, spot]))
    return kept.select(docs.columns)


def _without(rows: DataFrame, gone: DataFrame, id_col: str, spot: str) -> DataFrame:
    """The rows whose id and spot are not in gone."""
    gone = gone.select(F.col("id").alias("gone_id"), F.col("spot").alias("gone_spot"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(gone, rows[id_col].eqNullSafe(gone["gone_id"]) & rows[spot].eqNullSafe(gone["gone_spot"]), "left_anti")
