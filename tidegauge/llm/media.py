"""Operator 2, media columns: texts kept as progressive JPEG files and decoded
to full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import map_batches, string_buffers, table

UNIT = 576
OUTPUTS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string",
    "feature": "string", "height": "int", "width": "int", "media": "binary", "rgb": "binary",
}
DIGEST = tuple(OUTPUTS)[:9]


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\xff" * (-len(text) % unit or (0 if text else unit))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """One row per row of ``df``: its id (named ``doc_id``) and the asked columns.

    The whole text's UTF-8 bytes, padded with 255 to a positive multiple of 576,
    are stored as a progressive JPEG file (``media``). The stored bytes are read
    back: ``payload_sha256`` and ``tail_crc32`` are of what was read, ``rgb`` is
    the decoded height x width x 3 tensor (row-major, 8 bits), and ``feature``
    has its size and the sum of each channel. A null text counts as empty; null
    ids, repeated rows and extra columns change nothing; an empty table gives none.
    No row depends on another, so nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in columns}
        data, offsets = string_buffers(batch.column(1))
        whole, at = data.tobytes(), offsets.tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            media = jpeg.encode_payload(padded(whole[a:b]))
            image = jpeg.decode(media)
            payload = jpeg.payload_of(image)
            rgb = jpeg.to_rgb(image)
            got = {
                "n_bytes": b - a, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
                "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "height": image.height, "width": image.width, "media": media,
                "feature": f"{image.height}x{image.width}:" + ",".join(map(str, rgb.reshape(-1, 3).sum(axis=0, dtype="int64"))),
            }
            if "rgb" in out:
                got["rgb"] = rgb.tobytes()
            for c in columns:
                out[c].append(got[c])
        return {"doc_id": batch.column(0), **out}

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(slim, kernel, ", ".join([f"doc_id {kind}", *(f"{c} {OUTPUTS[c]}" for c in columns)]), 1)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"), columns=DIGEST)
