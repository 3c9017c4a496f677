"""Pieces the corpus operators share: shared-folder tables, byte-level word
splitting and hashing over whole Arrow batches, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch handed to the numpy kernels holds about this many bytes of text;
#: one longer text makes a batch of its own.
BATCH_BYTES = 1_000_000
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset
    and Spark runs in one process, a new temporary folder; on a cluster an error, as
    every executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, so
    a lost executor costs a re-read and no recomputation, and the shuffle files of
    the write are not needed any more. ``discard`` removes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote. Only for those whose readers have all been
    written themselves; a lazy frame over one of them would lose its input."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of the bitmaps that ``marked`` sends out, 64 bits each.
BITMAP_ROWS = 1 << 18


def marked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a hash) may be one of ``wanted``'s, and few others:
    a filter that loses none and goes before a join on ``key``, so that the join's
    shuffle carries few rows in vain. The bitmap that is broadcast has BITMAP_ROWS rows
    at most, whatever the input; with many more keys than bits it lets all rows pass."""
    k, bits = free_name(df, "k"), free_name(df, "bits")
    place = F.shiftright(key, 6).bitwiseAND(F.lit(BITMAP_ROWS - 1))
    bitmap = wanted.groupBy(place.alias(k)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias(bits))
    return df.withColumn(k, place).join(F.broadcast(bitmap), k).where(f"shiftright({bits}, cast({key} & 63 as int)) & 1 = 1").drop(k, bits)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# --- Arrow batches ---------------------------------------------------------


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = string_buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict[str, object]], schema: str, text_index: int, limit: int = BATCH_BYTES) -> DataFrame:
    """``kernel`` over slices of bounded text size; it returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_index, limit):
                columns = kernel(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


# --- words and their hashes ------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, up to n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word (a run without ASCII white space)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every text, one after another,
    and their offsets. A text of 1 to k-1 words has its whole sequence as one
    shingle, a text without words none. Upper-case A-Z counts as lower case."""
    n = len(offsets) - 1
    data = _LOWER[data]
    start, end, text = word_spans(data, offsets)
    words = span_hashes(data, start, end)
    count = np.bincount(text, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    full = np.flatnonzero(count >= k)
    folded = words.copy()
    for j in range(1, k):
        folded[: len(words) - j] = mix(folded[: len(words) - j] * np.uint64(0xC2B2AE3D27D4EB4F) + words[j:] + np.uint64(j))
    out, sizes = [], np.zeros(n, np.int64)
    whole = {int(i) for i in full}
    for i in np.flatnonzero(count):
        a, b = at[i], at[i + 1]
        if int(i) in whole:
            x = np.sort(folded[a : b - k + 1])
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:
            x = words[a : a + 1].copy()
            for j in range(1, b - a):
                x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + words[a + j : a + j + 1] + np.uint64(j))
        out.append(x)
        sizes[i] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


# --- connected components --------------------------------------------------


class UnionFind:
    """Union by smallest member, with path halving."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links, in blocks of bounded size: each block
    leaves one link from every node to its smallest companion."""
    for batch in batches:
        found = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.join(a, b)
        pairs = [(x, r) for x in list(found.up) if (r := found.find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], batch.schema.types[0]), pa.array([p[1] for p in pairs], batch.schema.types[1])], schema=batch.schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component
    is its smallest node. Blocks are contracted by union-find, then large-star and
    small-star steps alternate, each storing its links, until nothing changes."""
    kind = links.schema["a"].dataType.simpleString()
    links = stored(links.where("a <> b").mapInArrow(_forest, f"a {kind}, b {kind}").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    previous = None
    while True:
        # Large star: every larger neighbour is hung on the smallest one around a node.
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are hung on the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = stored(small, "links")
        discard(links)
        links = small
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def word_count(text: Column | str) -> Column:
    """Words of a text, null counting as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
