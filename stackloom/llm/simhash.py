"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of r + 1 bits, r being the radius; the mask of each non-zero vector v keeps
the positions whose vector has odd parity with v. For r differing positions some v has even parity with all of their
vectors, so every pair within the radius collides under some mask: nothing is missed by chance. Only different
fingerprints enter the tables, so a group of exact copies is one entry. A bucket that holds too many is dealt again
by the same masks over the bits its mask left out, which bounds a bucket by 2 ** (bits left out twice), about 4,096.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import materialise, ready, rows_bytes, table
from stackloom.llm.components import components
from stackloom.llm.repeats import ddl

WORDS = 3
RADIUS = 2
SEED = 42
#: Fingerprints of a bucket that are compared at once; fuller ones are dealt again.
BUCKET = 2_048

_FP = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    import xxhash

    parts = text.lower().split()
    n = len(parts)
    if not n:
        return 0
    joined, hash_ = b" ".join(parts), xxhash.xxh64_intdigest
    if n <= words:
        return hash_(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: n - words]]]
    total, count = np.zeros(64, np.int64), n - words + 1
    for i in range(0, count, 1 << 16):
        some = [hash_(joined[s:e], SEED) for s, e in zip(starts[i : i + (1 << 16)], ends[i + words - 1 : i + words - 1 + (1 << 16)])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def masks(positions: list[int], radius: int) -> list[int]:
    """Covering masks over the given bit positions, as unsigned 64-bit numbers."""
    m = (1 << (radius + 1)) - 1
    vector = {p: i % m + 1 for i, p in enumerate(positions)}
    return [sum(1 << p for p, x in vector.items() if (x & v).bit_count() % 2) for v in range(1, m + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among different fingerprints, one fewer than each component has members."""
    n = len(fps)
    if n <= 6:
        return [(fps[i], fps[j]) for i in range(n) for j in range(i) if ((fps[i] ^ fps[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius]
    values, left, out = np.array(fps, np.int64).view(np.uint64), np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(values[left] ^ values[x]) <= radius
            if near.any():
                new = left[near].tolist()
                out += [(fps[x], fps[y]) for y in new]
                queue += new
                left = left[~near]
    return out


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between different fingerprints of fps (fp long, all different) that connect all within the radius."""
    outer = masks(list(range(64)), radius)
    inner = [masks([p for p in range(64) if not m >> p & 1], radius) for m in outer]
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in outer])).alias("t", "key"))
    full = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialise(rows.join(full, ["t", "key"]), "buckets")

    def compare(batches):
        held, last = [], None
        u, v = [], []
        for batch in batches:
            for *at, fp in zip(*[c.to_pylist() for c in batch.columns]):
                if at != last:
                    for x, y in forest(held, radius):
                        u.append(x)
                        v.append(y)
                    held, last = [], at
                held.append(fp)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        found = forest(held, radius)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    def dealt(df, by):
        return df.select(*by, "fp").repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "u long, v long")

    again = F.create_map(*[x for i, ms in enumerate(inner) for x in (F.lit(i), F.array(*[F.lit(signed(m)) for m in ms]))])
    hot = rows.where(F.col("n") > bucket).select("t", "key", "fp", F.posexplode(F.transform(again[F.col("t")], lambda m: F.col("fp").bitwiseAND(m))).alias("t2", "key2"))
    return dealt(rows.where(F.col("n") <= bucket), ["t", "key"]).unionByName(dealt(hot, ["t", "key", "t2", "key2"]))


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text) and fp of every row of documents."""
    ready(documents.sparkSession)

    def hashed(batches):
        for batch in batches:
            fps = [signed(fingerprint(t, words)) for t in rows_bytes(batch.column(2))]
            yield table({"doc_id": batch.column(0), "th": batch.column(1), "fp": fps}, _FP)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return materialise(docs.mapInArrow(hashed, ddl(_FP)), "fingerprints")


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for every different fingerprint of docs: root is the component's smallest fingerprint."""
    fps = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    found = components(links(fps.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = materialise(fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"), "components")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return materialise(named.join(low, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Texts that link directly or through others share a component, named by its smallest doc_id. Null and empty texts
    have fingerprint zero and link like any other; a null doc_id never names a component unless no other does; rows that
    repeat an id stay rows; further columns are ignored; an empty table gives an empty result.
    """
    docs = fingerprints(documents, words)
    return docs.join(grouped(docs, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row of documents, with all its columns, for each component: that with the smallest doc_id.

    Ties between rows of one doc_id go to the smaller hash of the text, and of equal rows one stays. A null doc_id comes
    last. Texts count as in near_duplicates.
    """
    docs = fingerprints(documents, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "th"))
    low = docs.join(grouped(docs, radius), "fp").groupBy("root").agg(first.alias("r")).select("r.doc_id", "r.th")
    copies = docs.groupBy("doc_id", "th").agg(F.count("*").alias("n"))
    c, r = copies.alias("c"), low.alias("r")
    same = lambda x, y: F.expr(f"{x}.doc_id <=> {y}.doc_id and {x}.th = {y}.th")
    low = materialise(c.join(r, same("c", "r"), "left_semi").select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), (F.col("n") > 1).alias("many")), "representatives")
    # All columns of documents travel as one, whatever their names.
    rows = documents.select(F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_th"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    rows = rows.join(low, F.col("d_id").eqNullSafe(F.col("r_id")) & (F.col("d_th") == F.col("r_th")))
    # Equal rows are rare: only they go through another exchange.
    out = rows.where(~F.col("many")).unionByName(rows.where("many").dropDuplicates(["r_id", "r_th"]))
    return out.select("row.*")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
