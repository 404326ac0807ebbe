"""Operator 1: SimHash near-duplicates by multi-index hashing.

Fingerprints are made in one pass over the texts (no shuffle). Everything after
that works on *distinct* fingerprints, so any number of copies costs one row.
Each 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints at
distance 3 or less agree in one segment up to one bit, so the Hamming ball of
radius 1 around each segment is enumerated, fetched from the segment table by
an equi-join, and the complete distance is verified. Of two segments that
differ in one bit exactly one has a zero there; only that side enumerates the
flip, which halves the probes and finds each pair once per segment.

Components come from alternating large-star / small-star steps over the links.

Defined results: null text counts as empty; a text without words has
fingerprint zero and is linked like any other; a row whose doc_id is null has
no identity to report and is left out; several rows of one doc_id count as
separate documents in ``n_near`` and share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, strings, table, texts_of

SEED = 42
MAX_DISTANCE = 3
SHINGLE = 3

_LANES = np.zeros(256, dtype=np.uint64)
for _b in range(256):
    _LANES[_b] = sum(1 << (8 * i) for i in range(8) if _b >> i & 1)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    n = len(hashes)
    lanes = _LANES[hashes.view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t) for t in strings(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id long, fp long`` (the fingerprint's bits as a signed long)."""
    return texts_of(docs).filter("doc_id is not null").mapInArrow(_fingerprints, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints at 1 to 3 differing bits, each once."""
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("half")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
    )
    segments = nodes.select("fp", F.explode(halves).alias("s")).select("fp", "s.seg", "s.half")
    key = lambda half: F.shiftleft(half, 1).bitwiseOR(F.col("seg").cast("long"))
    members = segments.select(key(F.col("half")).alias("key"), F.col("fp").alias("b"))
    ball = F.concat(
        F.array(F.lit(0).cast("long")),
        F.filter(
            F.array(*[F.lit(1 << i).cast("long") for i in range(32)]),
            lambda bit: F.col("half").bitwiseAND(bit) == 0,
        ),
    )
    probes = segments.select("fp", "seg", "half", F.explode(ball).alias("flip")).select(
        key(F.col("half").bitwiseOR(F.col("flip"))).alias("key"), F.col("fp").alias("a"), "seg", "flip"
    )
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.bit_count(F.shiftrightunsigned(x, 32))
    return (
        probes.join(members, "key")
        .filter((F.col("a") != F.col("b")) & (F.bit_count(x) <= MAX_DISTANCE))
        # agreement in both segments up to a bit would be found twice: the first one reports it
        .filter((F.col("seg") == 0) | (first >= 2))
        # equal segments meet from both sides: the smaller one reports
        .filter((F.col("flip") != 0) | (F.col("a") < F.col("b")))
        .select("a", "b")
    )


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over undirected ``u, v`` pairs."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # rows are now (larger, smaller)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return (
        small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``u, component`` for every node of ``edges`` (columns ``u, v``): the least node reachable.

    The result is a forest of stars once a step changes nothing. Nodes that are
    least in their component are not listed (they name themselves).
    """
    # (larger, smaller) pairs
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        now = stored(_star(now), "stars")
        # xor-free order-independent digest: count, sum and hash sum of the edge set
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, n_near, component_id, n_same`` for every document.

    ``n_near`` counts the other documents linked directly; ``n_same`` those of
    them with the very same fingerprint.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "nodes")
    found = links(nodes)
    left = nodes.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("least").alias("u"))
    right = nodes.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("least").alias("v"))
    edges = stored(found.join(left, "a").join(right, "b"), "links")
    around = (
        edges.select(F.col("a").alias("fp"), F.col("n_b").alias("n"))
        .unionByName(edges.select(F.col("b").alias("fp"), F.col("n_a").alias("n")))
        .groupBy("fp")
        .agg(F.sum("n").alias("others"))
    )
    parts = components(edges.filter("u != v").select("u", "v"))
    per_fp = (
        nodes.join(around, "fp", "left")
        .join(parts.withColumnRenamed("u", "least"), "least", "left")
        .select(
            "fp",
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_near"),
            F.coalesce("component", "least").alias("component_id"),
            (F.col("n") - 1).cast("long").alias("n_same"),
        )
    )
    return marked.join(per_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "n_near",
        "component_id",
        "n_same",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less every row that is not its component's least doc_id.

    Rows without a doc_id stay. Of several rows with that least doc_id all stay:
    they are one document.
    """
    found = near_duplicates(docs).select(F.col("doc_id").alias("_id"), "component_id").filter("_id != component_id").select("_id").distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["_id"], "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
