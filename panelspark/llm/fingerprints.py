"""Document fingerprints: quartile bucket digests.

Byte triplets (three gapped shapes over a window of five bytes) are hashed
into buckets and counted; each bucket is encoded by the quartile of the
document's bucket counts that it falls into, two bits a bucket, after one
byte for the length on a logarithmic scale and one for the quartiles' ratios.
Two digests are compared by a weighted difference, bounded to 0..1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.frames import col, cut_lineage, field, prepare
from panelspark.llm.kernels import slices, text_buffers
from panelspark.session import sized_broadcast

BUCKETS = 256
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
ROWS_PER_BUCKET = 20_000
# weight of a step in the length code and in a quartile ratio; difference of unrelated digests, at which the score is 0
LENGTH_STEP, RATIO_STEP, UNRELATED = 4, 4, 1.625 * BUCKETS
HEAD = 2


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of HEAD + BUCKETS codes per text."""
    out = []
    for i, j in slices(offsets):
        lo, n = int(offsets[i]), j - i
        raw = data[lo:int(offsets[j])].astype(np.uint32)
        at = offsets[i:j + 1] - lo
        text = np.repeat(np.arange(n), np.diff(at))
        counts = np.zeros(n * BUCKETS, np.int64)
        for k, shape in enumerate(SHAPES):
            span = shape[-1]
            if len(raw) <= span:
                continue
            m = len(raw) - span
            with np.errstate(over="ignore"):
                h = raw[:m] * np.uint32(0x9E3779B1) + np.uint32(k)
                for q, s in enumerate(shape[1:]):
                    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + raw[s:s + m] * np.uint32((0xC2B2AE3D, 0x27D4EB2F)[q])
                h = (h ^ (h >> np.uint32(13))) * np.uint32(0x165667B1) >> np.uint32(24)
            same = text[:m] == text[span:]
            counts += np.bincount(text[:m][same] * BUCKETS + h[same].astype(np.int64), minlength=n * BUCKETS)
        counts = counts.reshape(n, BUCKETS)
        ordered = np.sort(counts, axis=1)
        q1, q2, q3 = (ordered[:, BUCKETS * q // 4 - 1][:, None] for q in (1, 2, 3))
        code = np.zeros((n, HEAD + BUCKETS), np.uint8)
        code[:, 0] = np.minimum(np.floor(8 * np.log2(np.diff(at) + 1.0)), 255)
        top = np.maximum(q3[:, 0], 1)
        code[:, 1] = (16 * q1[:, 0] // top % 16) * 16 + 16 * q2[:, 0] // top % 16
        code[:, HEAD:] = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
        out.append(code)
    return np.concatenate(out) if out else np.zeros((0, HEAD + BUCKETS), np.uint8)


def to_text(code: np.ndarray) -> list[str]:
    """Digests as hexadecimal strings: length, ratios, four buckets a byte."""
    body = code[:, HEAD:].reshape(len(code), BUCKETS // 4, 4)
    packed = (body << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2, dtype=np.uint8)
    return [row.tobytes().hex() for row in np.concatenate([code[:, :HEAD], packed], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from the difference of unrelated ones on."""
    step = np.abs(a[:, HEAD:].astype(np.int16) - b[:, HEAD:])
    d = np.where(step == 3, 6, step).sum(axis=1).astype(float)
    d += LENGTH_STEP * np.minimum(np.abs(a[:, 0].astype(int) - b[:, 0]), 12)
    for shift in (4, 0):
        gap = np.abs((a[:, 1].astype(int) >> shift & 15) - (b[:, 1].astype(int) >> shift & 15))
        d += RATIO_STEP * np.minimum(gap, 16 - gap)
    return np.maximum(0.0, 1.0 - d / UNRELATED)


def _codes(texts: list[str]) -> np.ndarray:
    return digests(*text_buffers(pa.array(texts, pa.large_string())))


FIELDS = [field("n_chars", "long"), field("edited_sha256", "string"), field("fingerprint", "string"),
          field("edited_fingerprint", "string"), field("near_edited", "double"), field("near_next", "double")]


def _with_next(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows in key order, dealt by key range; each range ends with a copy of the row that follows it (``halo``)."""
    spark = docs.sparkSession
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    k = F.coalesce(col(key).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(col(key).alias("key"), k.alias("k"), F.xxhash64(t).alias("th"), t.alias("t"))
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("k"), F.max("k")).first()
    parts = max(1, -(-(n or 0) // ROWS_PER_BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // parts))
    part = F.floor((F.col("k").cast("decimal(20,0)") - F.lit(str(lo or 0)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("long")
    rows = rows.withColumn("part", part)
    # the first row of each range is sent to the range before it (in descending order); the very first to the last
    heads = (rows.groupBy("part").agg(F.max(F.struct("k", "th")).alias("h"))
             .withColumn("to", F.lead("part").over(Window.orderBy("part"))))
    heads = heads.select("part", F.col("h.k").alias("k"), F.col("h.th").alias("th"), "to")
    low = heads.agg(F.min("part")).first()[0]
    # a row per range, written so that its size is known to the broadcast check
    heads = cut_lineage(heads.withColumn("to", F.coalesce("to", F.lit(low))), "fingerprint-heads")
    halo = rows.join(sized_broadcast(heads), ["part", "k", "th"]).select("key", "k", "th", "t", F.col("to").alias("part"))
    both = rows.withColumn("halo", F.lit(0)).unionByName(halo.withColumn("halo", F.lit(1)))
    return (both.repartition(parts, "part").sortWithinPartitions("part", "halo", F.desc("k"), F.desc("th"))
            .select("key", "t", "halo"))


def fingerprint_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document row: its key, length, fingerprint, and those of its edited text, with likenesses.

    The edited text's last half (rounded down) is replaced by as many first
    code points of the next document by descending key, or all of them;
    after the last comes the first.  ``near_edited`` and ``near_next`` are
    the likeness of its fingerprint to the edited text's and the next
    document's.

    A null text counts as empty, and an empty text has the digest of no
    triplets; a null key comes last.  Rows with equal keys stand in the order
    of their text's hash; a single row is its own next.  Empty tables give
    empty results; other columns are not read.  Rows are dealt by key range
    and streamed in order, so that no task holds more than a batch.
    """
    prepare(docs.sparkSession)

    def run(batches):
        held = None
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = b.slice(b.num_rows - 1, 1)
            texts = b.column(1).to_pylist()
            mine = [i for i, h in enumerate(b.column(2).to_pylist()[:-1]) if not h]
            if not mine:
                continue
            edited = []
            for i in mine:
                half = len(texts[i]) // 2
                edited.append(texts[i][:len(texts[i]) - half] + texts[i + 1][:half])
            code, other = _codes(texts), _codes(edited)
            at = np.array(mine)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(mine, pa.int64())), pa.array([len(texts[i]) for i in mine], pa.int64()),
                 pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited], pa.string()),
                 pa.array(to_text(code[at]), pa.string()), pa.array(to_text(other), pa.string()),
                 pa.array(likeness(code[at], other), pa.float64()), pa.array(likeness(code[at], code[at + 1]), pa.float64())],
                names=[key, *[f.name for f in FIELDS]])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *FIELDS])
    return _with_next(docs, text, key).mapInArrow(run, schema)
