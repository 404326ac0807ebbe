"""Operator 5: token ids in a content-addressed store.

Texts are encoded, the end id is appended, and a rolling hash over the ids cuts
each stream into chunks whose borders depend on content alone, so that equal
passages give equal chunks wherever they stand. A store is a folder with

``data/kind=chunk``  each distinct chunk once: digest (SHA-256), n, payload
                     (ids as little-endian unsigned 16-bit numbers)
``data/kind=ref``    which chunks a document is made of
``recipes``          documents in ascending doc_id order: start, n_tokens, the
                     chunk digests, and their Merkle root
``manifest``         totals and the Merkle root of every recipe part and of all

Payloads are shuffled once, by digest, after each task has dropped the chunks it
sent before; references are shuffled by document, so a chunk that a third of all
documents share is no hot key. Reading verifies every payload against its
digest, every document against its Merkle root and every part against the
manifest, and combines the chunks' checksums, so no payload moves.

Defined results: null text is the empty text (one end id); rows of one doc_id
are separate documents in the order they were read; rows without doc_id come
first; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, pieces, ship, table

END_ID = 0
#: Chunks end where this many low bits of the rolling hash are zero: 1024 ids on average.
CUT_BITS = 10
ROLL = 8
LONGEST = 1 << 16
CACHE_UNITS = 400_000
TOKENIZER = "byte_bpe_50k.json"

#: Where splitting before each space could differ from the tokenizer's own rule.
_TANGLED = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)|<\|endoftext\|>|\x00"
#: Borders inside a word where a token always ends: behind letters, and behind a lone line's end before a letter.
_BORDERS = ((r"(\pL)([^\pL\x00])", "\\1\0\\2"), (r"([^\s\x0b\x1c-\x1f\x{85}\p{Z}])\n(\pL)", "\\1\n\0\\2"))
_SIMPLE = r"^ [^\s\x0b\x1c-\x1f\x{85}\p{Z}]+\z"

_GEAR = np.random.default_rng(11).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


class Encoder:
    """Encodes batches of texts; distinct units are encoded once and remembered.

    Byte-level pre-tokenization always starts a token before a space that a
    non-space follows, ends one where letters end, and starts one where a letter
    follows a lone line's end, so what lies between can be encoded on its own. Texts
    with other runs of white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.known: dict[str, bytes] = {}
        #: which ids' pieces start with a space (the byte-level sign for it)
        self.spaced = np.zeros(1 << 16, dtype=bool)
        self.spaced[[i for piece, i in self.tokenizer.get_vocab().items() if piece.startswith("\u0120")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_new(self, units: list[str]) -> list[bytes]:
        """Units of one space and signs without white space are encoded joined: their ids part where a piece starts with a space."""
        simple = pc.match_substring_regex(pa.array(units, type=pa.string()), _SIMPLE).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(units)
        other = np.flatnonzero(~simple).tolist()
        for i, ids in zip(other, self._encode([units[i] for i in other])):
            out[i] = ids
        joined = np.flatnonzero(simple).tolist()
        for lo in range(0, len(joined), 4096):
            part = joined[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode("".join([units[i] for i in part]), add_special_tokens=False).ids, dtype="<u2")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(part):
                raise AssertionError("units did not part at their spaces")
            raw, bounds = ids.tobytes(), [*(2 * starts).tolist(), 2 * len(ids)]
            for k, i in enumerate(part):
                out[i] = raw[bounds[k] : bounds[k + 1]]
        return out

    def _units(self, units: list[str]) -> list[bytes]:
        known = self.known
        new = [u for u in units if u not in known]
        if new:
            if len(known) + len(new) > CACHE_UNITS:
                known.clear()
                new = units
            known.update(zip(new, self._encode_new(new)))
        return [known[u] for u in units]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and where each text's ids end."""
        n = len(texts)
        tangled = pc.match_substring_regex(texts, _TANGLED).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(tangled), pa.scalar("", texts.type), texts)
        plain = pc.replace_substring(plain, " ", "\0 ")
        for pattern, cut in _BORDERS:
            plain = pc.replace_substring_regex(plain, pattern, cut)
        split = pc.split_pattern(plain, "\0")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        parts = self._units(coded.dictionary.to_pylist())
        whole = np.flatnonzero(tangled)
        if len(whole):
            # a tangled text was emptied to one unit, which its whole encoding replaces
            index[offsets[whole]] = len(parts) + np.arange(len(whole))
            parts = parts + self._encode([texts[int(i)].as_py() for i in whole])
        parts.append(np.array([END_ID], dtype="<u2").tobytes())
        index = np.insert(index, offsets[1:], len(parts) - 1)
        flat = np.frombuffer(b"".join(parts), dtype="<u2")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 2
        starts = np.cumsum(sizes) - sizes
        length = sizes[index]
        upto = np.cumsum(length)
        ids = flat[np.repeat(starts[index] - upto + length, length) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, upto[offsets[1:] + np.arange(n)] if n else np.zeros(0, dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end: at every document's end, and where the rolling hash says so."""
    gear = _GEAR[ids]
    h = gear.copy()
    for j in range(1, ROLL):
        h[j:] += gear[:-j] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h ^= h >> np.uint64(29)
    # the window must lie inside the document
    start = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
    inside = np.arange(len(ids)) - start >= ROLL - 1
    marks = np.flatnonzero(inside & ((h & np.uint64((1 << CUT_BITS) - 1)) == 0)) + 1
    marks = np.union1d(marks, ends)
    gaps = np.diff(marks, prepend=0)
    if len(gaps) and gaps.max() > LONGEST:
        more = [np.arange(m - g + LONGEST, m, LONGEST) for m, g in zip(marks, gaps) if g > LONGEST]
        marks = np.union1d(marks, np.concatenate(more))
    return marks


def _encode_chunks(path: str):
    names = ["kind", "route", "doc_id", "uid", "seq", "digest", "n", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        sent: set[bytes] = set()
        for batch in pieces(batches, 6 << 20):
            ids, ends = encoder.batch(batch.column(2).cast(pa.string()))
            marks = cuts(ids, ends)
            doc_of = np.searchsorted(ends, marks, side="left")
            first = np.searchsorted(doc_of, np.arange(len(ends)), side="left")
            seq = np.arange(len(marks)) - first[doc_of]
            raw = memoryview(ids.astype("<u2").tobytes())
            lo = 0
            refs, heads = [], []
            doc_ids, uids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, s, hi in zip(doc_of.tolist(), seq.tolist(), marks.tolist()):
                payload = raw[2 * lo : 2 * hi]
                digest = hashlib.sha256(payload).digest()
                refs.append(("ref", uids[d], doc_ids[d], uids[d], s, digest, hi - lo, None))
                if digest not in sent:
                    if len(sent) >= CACHE_UNITS:
                        sent.clear()
                    sent.add(digest)
                    heads.append(("chunk", int.from_bytes(digest[:8], "little", signed=True), None, None, None, digest, hi - lo, bytes(payload)))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*refs, *heads), types)], names)

    return run


_CHUNKS = "kind string, route long, doc_id long, uid long, seq int, digest binary, n int, payload binary"


_DATA = "doc_id long, uid long, seq int, digest binary, n int, payload binary, kind string"
_RECIPES = "part int, doc_id long, uid long, start long, n_tokens long, chunks array<binary>, root binary"
_UNPLACED = "doc_id long, uid long, chunks array<binary>, n_tokens long, root binary, part int"


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_DATA).parquet(f"{path}/data")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPES).parquet(f"{path}/recipes")


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode ``docs`` (``doc_id, text``) into a store at ``path``, with the tokenizer file ``tokenizer``."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    chunks = rows.mapInArrow(_encode_chunks(tokenizer), _CHUNKS)
    once = _unique_chunks(chunks)
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/data")
    refs = _data(spark, path).filter("kind = 'ref'")
    recipes = (
        refs.groupBy("doc_id", "uid")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "n"))).alias("c"))
        .select("doc_id", "uid", F.transform("c", lambda x: x["digest"]).alias("chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"))
        .withColumn("root", F.unhex(F.sha2(_joined("chunks"), 256)))
        .repartitionByRange("doc_id", "uid")
        .sortWithinPartitions("doc_id", "uid")
        .withColumn("part", F.spark_partition_id())
    )
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes-unplaced")
    placed = spark.read.schema(_UNPLACED).parquet(f"{path}/recipes-unplaced")
    inside = Window.partitionBy("part").orderBy("doc_id", "uid")
    parts = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).orderBy("part").collect()
    before, total = {}, 0
    for p in parts:
        before[p["part"]] = total
        total += p["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")) if before else F.lit(0)
    (
        placed.withColumn("start", (F.sum("n_tokens").over(inside) - F.col("n_tokens") + offset).cast("long"))
        .select("part", "doc_id", "uid", "start", "n_tokens", "chunks", "root")
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )
    roots = _part_roots(spark, path)
    manifest = {"format": 1, "ids": total, "docs": sum(p["docs"] for p in parts), "dtype": "<u2", "end_id": END_ID, "parts": roots, "root": _root(roots)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def _unique_chunks(chunks: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("route", "digest", "kind").orderBy("kind"))
    return chunks.withColumn("nth", nth).filter("kind = 'ref' or nth = 1").drop("nth", "route")


def _joined(column: str):
    return F.aggregate(column, F.lit(b""), lambda a, x: F.concat(a, x))


def _part_roots(spark: SparkSession, path: str) -> dict[str, str]:
    """Merkle root of each recipe part: over its documents' roots, in blocks of neighbours."""
    recipes = _recipes(spark, path)
    block = F.floor(F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "uid")) / 1024)
    blocks = recipes.select("part", "doc_id", "uid", "root", block.alias("block")).groupBy("part", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "uid", "root"))).alias("r"))
    blocks = blocks.select("part", "block", F.unhex(F.sha2(_joined_field("r", "root"), 256)).alias("root"))
    parts = blocks.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("block", "root"))).alias("r")).select("part", F.sha2(_joined_field("r", "root"), 256).alias("root"))
    return {str(r["part"]): r["root"] for r in parts.orderBy("part").collect()}


def _joined_field(column: str, field: str):
    return F.aggregate(column, F.lit(b""), lambda a, x: F.concat(a, x[field]))


def _root(roots: dict[str, str]) -> str:
    return hashlib.sha256(b"".join(bytes.fromhex(roots[k]) for k in sorted(roots, key=int))).hexdigest()


def verify_manifest(spark: SparkSession, path: str) -> dict:
    """Recompute the Merkle roots from the recipes; raises where they differ from the manifest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    roots = _part_roots(spark, path)
    if roots != manifest["parts"] or _root(roots) != manifest["root"]:
        raise ValueError("recipes do not match the manifest")
    return manifest


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if hashlib.sha256(payload).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            ids = np.frombuffer(payload, dtype="<u2")
            rows.append((digest, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.binary(), pa.int64(), pa.int64()))], ["digest", "n", "crc"])


def _crc_tables() -> list[np.ndarray]:
    """For k = 0, 1, ...: tables that append 2^k zero bytes to a CRC-32, byte by byte of the CRC."""
    column = np.array([0xEDB88320] + [1 << i for i in range(31)], dtype=np.uint64)  # one zero bit

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where(v >> np.uint64(i) & np.uint64(1), m[i], np.uint64(0))
        return out

    for _ in range(3):
        column = times(column, column)
    tables = []
    for _ in range(40):
        tables.append(np.stack([times(column, np.arange(256, dtype=np.uint64) << np.uint64(8 * b)) for b in range(4)]))
        column = times(column, column)
    return tables


_CRC_TABLES: list[np.ndarray] = []


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each CRC-32 as it stands in the checksum of a message with so many bytes behind it."""
    if not _CRC_TABLES:
        _CRC_TABLES.extend(_crc_tables())
    crc = crc.astype(np.uint64)
    for k, tables in enumerate(_CRC_TABLES):
        rows = np.flatnonzero(zeros >> k & 1)
        if len(rows):
            c = crc[rows]
            crc[rows] = tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]
    return crc


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        flat = lists.flatten()
        n, crc = flat.field("n").to_numpy().astype(np.int64), flat.field("crc").to_numpy()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        upto = np.cumsum(n)
        ends = np.cumsum(sizes) - 1
        total = np.diff(upto[ends], prepend=0) if len(ends) else np.zeros(0, dtype=np.int64)
        behind = 4 * ((upto[ends])[doc] - upto)
        out = np.zeros(len(sizes), dtype=np.uint64)
        np.bitwise_xor.at(out, doc, shift_crc(crc, behind))
        if not (total == batch.column(2).to_numpy()).all():
            raise ValueError("a document's chunks do not add up to its recipe")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checked(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from verified files."""
    ship(spark)
    verify_manifest(spark, path)
    facts = _data(spark, path).filter("kind = 'chunk'").select("digest", "payload").mapInArrow(_facts, "digest binary, n long, crc long")
    recipes = _recipes(spark, path)
    steps = recipes.select("doc_id", "uid", "start", "n_tokens", F.posexplode("chunks").alias("pos", "digest"))
    return (
        steps.join(facts, "digest", "left")
        .groupBy("doc_id", "uid", "start", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("c"))
        .select("doc_id", "start", "n_tokens", "c")
        .mapInArrow(_combine, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` rebuilt from recipes and chunks."""
    chunks = _data(spark, path).filter("kind = 'chunk'").select("digest", "payload")
    steps = _recipes(spark, path).select("doc_id", "uid", "start", F.posexplode("chunks").alias("pos", "digest"))
    joined = steps.join(chunks, "digest").groupBy("doc_id", "uid", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("c"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(b"".join(x["payload"] for x in c), dtype="<u2").astype(np.int32) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, type=pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return joined.select("doc_id", "start", "c").mapInArrow(ids, "doc_id long, start long, ids array<int>")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return checked(spark, path)


QUERIES = {"op5_token_store": op5_token_store}
ORACLES: dict[str, str] = {}
