"""Operator 5, near-duplicate documents: SuperMinHash signatures, banding,
verification on full shingle sets, union-find grouping.

Every element has one rank per slot, and its ranks over the slots are a
permutation, drawn from the affine maps over a prime number of slots. That
family is sharply two-transitive, so any two slots see the joint distribution of
a uniform permutation, which is what gives SuperMinHash its lower variance.
Ranks are handed out in rising order, so a text is finished once every slot
holds a value below the next rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, distinct_shingles, map_batches, mix, stored, string_buffers, table

SLOTS = 163
BANDS, ROWS = 32, 5  # a pair of similarity 0.8 shares no band with probability 3e-6
_FAR = np.uint32(0xFFFFFFFF)


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of SLOTS values (rank in the high 8 bits) for each text."""
    n = len(offsets) - 1
    out = np.full(n * SLOTS, _FAR, np.uint32)
    text = np.repeat(np.arange(n), np.diff(offsets))
    seed = mix(shingles)
    slope = 1 + (seed >> np.uint64(33)).astype(np.int64) % (SLOTS - 1)
    slot = (seed & np.uint64(0xFFFFFFFF)).astype(np.int64) % SLOTS
    for rank in range(SLOTS):
        if not len(text):
            break
        part = (mix(seed + np.uint64((rank + 1) * 0xA24BAED4963EE407 % (1 << 64))) >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(out, text * SLOTS + slot, part | np.uint32(rank << 24))
        unfinished = (out.reshape(n, SLOTS) >= np.uint32((rank + 1) << 24)).any(axis=1) if rank < SLOTS - 1 else np.zeros(n, bool)
        go = unfinished[text]
        text, seed, slope, slot = text[go], seed[go], slope[go], slot[go]
        slot = (slot + slope) % SLOTS
    return out.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    rows = signature[:, : BANDS * ROWS].reshape(n, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, :, r])
    return keys.view(np.int64)


def fingerprints(shingles: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128 bits for each set; None for an empty one."""
    n = len(offsets) - 1
    sums = []
    for salt in (0x8CB92BA72F3D8DD7, 0x3C79AC492BA7B653):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    both = np.stack(sums, axis=1).astype(">u8").tobytes()
    return [both[16 * i : 16 * i + 16] if offsets[i + 1] > offsets[i] else None for i in range(n)]


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _sketch(shingle_words: int):
    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        shingles, offsets = distinct_shingles(*string_buffers(batch.column(1)), shingle_words)
        keys = band_keys(signatures(shingles, offsets))
        return {
            "doc_id": batch.column(0), "c": batch.column(2), "n_shingles": np.diff(offsets), "node": fingerprints(shingles, offsets),
            "bands": _list_array(keys.ravel(), np.arange(len(keys) + 1) * BANDS),
        }

    return kernel


def _sets(shingle_words: int):
    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        shingles, offsets = distinct_shingles(*string_buffers(batch.column(1)), shingle_words)
        return {"node": fingerprints(shingles, offsets), "shingles": _list_array(shingles.view(np.int64), offsets)}

    return kernel


def _prefix_pairs(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ``sets`` (node, component, shingles) in different components
    that may reach the threshold: none that does is missing. And the stored table
    that they are read from.

    Shingles are ordered by how many of these sets hold them, rarest first. If two
    sets reach it, the larger one's first n - ceil(t n) + 1 shingles and the smaller
    one's first n - ceil(2t / (1 + t) n) + 1 meet. Where sets differ from all others
    of their family by more than the threshold lets them, the smaller one's prefix
    holds only its own changes, and so it is paired with none.
    """
    each = sets.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    each = each.join(often, "s", "left").select("node", "component", "n", F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s").alias("x"))
    whole = each.groupBy("node", "component", "n").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    probe = F.expr(f"cast(n - ceil(n * {percent} / 100.0) + 1 as int)")
    first = stored(whole.select("node", "component", "n", F.posexplode(F.slice("xs", F.lit(1), probe)).alias("i", "x")).where("x.f > 1").select("node", "component", "n", "i", "x.s"), "prefixes")
    index = first.where(f"i <= n - ceil(n * {2 * percent} / {100 + percent}.0)").toDF("a", "ca", "na", "ia", "s")
    larger = first.toDF("b", "cb", "nb", "ib", "s2")
    near = F.expr(
        f"s = s2 and ca <> cb and (na < nb or (na = nb and a < b)) and 100 * na >= {percent} * nb "
        f"and 1 + least(na - 1 - ia, nb - 1 - ib) >= (na + nb) * {percent} / {100 + percent}.0 - 1e-9"
    )
    return index.join(larger, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), first


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A document's set is its distinct ``shingle_words``-word shingles (lower-cased
    A-Z, whole text; fewer words: the whole sequence as one). Documents with
    100 * intersection >= percent * union are linked, confirmed on full sets;
    ``component_id`` is the smallest doc_id reachable, ``kept`` marks its bearer.
    Null or empty texts have no shingles and are linked with nothing. A row with a
    null doc_id is linked like any other; alone it has a null component and is
    kept. Rows that repeat a doc_id are one document and share ``kept``. An empty
    table gives none; extra columns are ignored.

    Scale: equal sets are collapsed before anything is paired, so a group of
    copies costs one row per task. Band buckets are then paired with one centre
    each (the member that meets most others), which resolves a group of near
    copies in as many pairs as it has members. Bucket members that are then still in
    different components go through an exact prefix-filter join.
    """
    return grouped(docs, shingle_words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``near_duplicates`` with ``c``, 128 bits of the row's text, and
    ``group``, which names its group also where no row of it has an id; null for
    texts without shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = stored(map_batches(slim.withColumn("c", F.unhex(F.md5("text"))), _sketch(shingle_words), f"doc_id {kind}, c binary, n_shingles long, node binary, bands array<long>", 1), "sketches")
    classes = stored(sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("smallest"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    members = classes.select(F.explode("bands").alias("key"), "node")
    crowded = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(members.join(crowded, "key"), "buckets")
    weights = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    members = stored(buckets.join(weights, "node").select("key", "node", "weight"), "members")
    discard(buckets)
    centres = members.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("centre"))
    pairs = members.join(centres, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pairs = stored(pairs, "pairs")

    paired = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    bearers = members.select("node").union(paired).distinct().join(classes.select("node", "smallest"), "node").where("smallest is not null")
    source = slim.join(bearers.select(F.col("smallest").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # A class whose members all lack an id is found by its text alone.
    source = source.union(slim.where("doc_id is null"))
    sets = stored(map_batches(source, _sets(shingle_words), "node binary, shingles array<long>", 1).where("node is not null").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")

    links = stored(confirmed(pairs), "confirmed")
    groups = stored(components(links), "groups")
    placed = members.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")
    rest = stored(placed.join(mixed, "key", "left_semi").select("node", "component").distinct(), "rest")
    discard(members)
    if rest.head(1):
        more, prefixes = _prefix_pairs(rest.join(sets, "node"), percent)
        late = stored(confirmed(more.join(pairs, ["a", "b"], "left_anti")), "confirmed")
        discard(prefixes, groups)
        groups = stored(components(links.union(late)), "groups")
        discard(late)
    discard(pairs, sets, links, rest)

    smallest = groups.join(classes.select("node", "smallest"), "node").groupBy("component").agg(F.min("smallest").alias("least"))
    names = classes.select("node", "smallest").join(groups.join(smallest, "component").select("node", "least", "component"), "node", "left").select("node", F.coalesce("least", "smallest").alias("component_id"), F.coalesce("component", "node").alias("group"))
    out = sketched.select("doc_id", "c", "n_shingles", "node").join(names, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "c", "group")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)
