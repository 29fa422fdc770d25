"""Best-fit packing by minimum bin slack: bins are the fullest combinations of the lengths at hand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import encoder, kept_by_worker, vocabulary_path
from .common import lean_batches, released, spare, stored, table

SIZE = 2048
PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """docs: doc_id, text. A row a piece: each document's ids, then ``end``, cut every ``size`` ids. Null and empty texts are the end id
    alone; ids of any type, null ones too, are carried as they are; repeated rows are documents of their own; columns other than these
    two are not carried."""
    kind = docs.schema["doc_id"].dataType

    def cut(batches):
        import zlib

        import pyarrow as pa

        stop = np.array([end], "<u4").tobytes()
        encode = kept_by_worker(("ids", vocabulary), lambda: encoder(vocabulary))
        for batch in batches:
            key, ids, texts = batch.schema.field(0).type, batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                out = []
                for doc, own in zip(ids[at : at + 256], encode([t or "" for t in texts.slice(at, 256).to_pylist()]), strict=True):
                    own += stop
                    for k, i in enumerate(range(0, len(own), 4 * size)):
                        part = own[i : i + 4 * size]
                        out.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*out, strict=True))
                kinds = (key, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return lean_batches(docs).select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(cut), f"doc_id {kind.simpleString()}, {PIECES}")


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The longest length at hand and the lengths that fill what it leaves open as far as can be, as {length: times}.

    Subset sums are bits of one integer: bit s is set if s can be made. A length with n copies is added as 1, 2, 4, ... and a rest of
    them. Longer lengths go first and the sums after each are kept, so the way back takes as few short ones as it can.
    """
    first = max(counts)
    room, mask = size - first, (1 << (size - first + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, before, step = min(counts[length] - (length == first), room // length), reach, 1
        while n > 0:
            k = min(step, n)
            reach |= (reach << (k * length)) & mask
            n, step = n - k, step * 2
        stages.append((length, before))
        if reach >> room:
            break
    got, rest = {first: 1}, reach.bit_length() - 1
    for length, before in reversed(stages):
        while not before >> rest & 1:
            got[length] = got.get(length, 0) + 1
            rest -= length
    return got


def pack_lengths(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """(combination, times) until no length is left. A combination is used as often as the counts allow at once, so the work follows the
    number of lengths, at most ``size``, not the number of pieces."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        got = fullest(counts, size)
        times = min(counts[k] // n for k, n in got.items())
        for k, n in got.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((got, times))
    return out


def pack(pieces: DataFrame, size: int = SIZE, rows: int = 2_000) -> DataFrame:
    """pieces: doc_id, piece, length (1 to ``size``) and more columns. Adds sequence_id, offset.

    Only the histogram of lengths, at most ``size`` rows, goes to the driver. The combinations made from it give each length a list of
    places; the r-th piece of a length takes its r-th place. Pieces of a length are numbered over buckets of about ``rows`` (a length
    that holds a third of all pieces has as many buckets as it needs): a window inside the bucket plus the bucket's start.
    Equal rows are pieces of their own; empty input gives an empty result. Added names that pieces already has get "_" appended.
    """
    n_, b, r_, start = spare(pieces, "_n", "_b", "_r", "_from")
    names = spare(pieces, "sequence_id", "offset")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    places, seq = [], 0
    taken: dict[int, int] = {}
    for got, times in pack_lengths(counts, size):
        offset = 0
        for length, n in sorted(got.items(), reverse=True):
            places.append((length, taken.get(length, 0), seq, n, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        seq += times
    grid = np.array(sorted(places) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    spark = pieces.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // rows)) for k, n in counts.items()] or [(0, 1)], f"length long, `{n_}` long")
    order = [F.col(c) for c in pieces.columns if c not in ("length", "doc_id", "piece")]
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn(b, F.pmod(F.xxhash64("doc_id", "piece", *order), F.col(n_))).drop(n_)
    own = Window.partitionBy("length", b)
    starts = dealt.groupBy("length", b).count()
    starts = starts.withColumn(start, F.sum("count").over(Window.partitionBy("length").orderBy(b)) - F.col("count")).select("length", b, start)
    ranked = dealt.withColumn(r_, F.row_number().over(own.orderBy("doc_id", "piece", *order))).join(starts, ["length", b])
    ranked = ranked.withColumn(r_, F.col(r_) - 1 + F.col(start)).select(*pieces.columns, r_)

    def place(batches):
        keys = grid[:, 0] * (1 << 44) + grid[:, 1]
        for pdf in batches:
            length, r = pdf["length"].to_numpy(np.int64), pdf.pop(r_).to_numpy(np.int64)
            g = grid[np.searchsorted(keys, length * (1 << 44) + r, "right") - 1]
            r = r - g[:, 1]
            pdf[names[0]], pdf[names[1]] = g[:, 2] + r // g[:, 3], g[:, 4] + r % g[:, 3] * length
            yield pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(released(place), f"{fields}, `{names[0]}` long, `{names[1]}` long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    """Tokenize and pack. Null text counts as empty (one piece, the end id); a null doc_id stays; other columns are not carried; an
    empty table gives an empty result."""
    return pack(stored(tokenized(docs, vocabulary or vocabulary_path(), size)), size)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces and their places, by the contract's vocabulary and size."""
    return pack_documents(table(spark, sf_dir, "documents"))


def pipeline_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every piece of what is left, with its sequence and offset. A document taken twice by the mix is packed twice."""
    return pack_documents(docs)


QUERIES = {"op6_pack": op6_pack}
ORACLES: dict[str, str] = {}
