"""Operator 4: remove byte strings that repeat, by distributed prefix doubling.

A string of ``length`` bytes is removed wherever it also starts somewhere else.
:func:`by_doubling` is the method in its plain form: the rank pairs of all positions
are sorted at growing offsets, and unique positions leave. It moves some forty bytes
for each byte of text (figures in the README), so what the query runs ranks only
positions that anchors cannot settle:

1. *Anchors.* Each start position is assigned to the least hash among the first
   ``length - GRAM + 1`` GRAM-byte strings that it covers. The choice depends on
   the ``length`` bytes only, so equal strings choose alike: a repeated string
   needs an equal anchor at an equal offset. Runs of positions share an anchor.
   One sort by (anchor rank, rank of the run's whole text) drops the anchors
   that are unique and settles the runs that repeat as a whole.
2. *Doubling.* Only runs that share an anchor but differ as a whole are left,
   that is the edges of repeats. For each of their positions the pair (rank of the
   first half, rank of the half that follows) is sorted, which reaches the threshold.

The same sorts answer a second question: which passages of ``WORDS`` words (by white
space) also stand in *another* document. Their runs are anchored by GRAM_WORDS-word
strings, and documents are counted in place of starts.

Ranks are 64-bit names of strings; the last comparison uses two of them. No group is
collected: groups are counted by sorted windows over rows that were first reduced
within their task (equal ones within a batch send one row). An anchor that stands in
``SPREAD`` or more different surroundings in one batch is hot: such rows go by anchor and
surroundings, and one row of that task tells the anchor's own group that it is not
unique, so a passage in any share of the documents is spread over the tasks.

Defined results: null text is the empty text; texts shorter than ``length``
lose nothing; rows of one doc_id count as separate documents, so a repeated row
loses every byte that such strings cover; rows without doc_id are kept, with a
null doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, stored, table, texts_of

LENGTH = 400
GRAM = 300
WORDS, GRAM_WORDS = 50, 8
CHUNK = 1 << 18
LONG_WORD = 256
#: So many surroundings of an anchor in one batch make it a hot one.
SPREAD = 8

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) <= n:
        size = 1 << max(12, (n + 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("p", _B), ("i", _B_INV)):
                a = np.full(size, np.uint64(base))
                a[0] = 1
                _POW[name] = np.multiply.accumulate(a)
    return _POW["p"], _POW["i"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte value times power; differences name substrings."""
    power, _ = _powers(len(data))
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_BYTES[data] * power[: len(data)], out=out[1:])
    return out


def _names(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(sums))
    return _mix((sums[end] - sums[start]) * inverse[start])


def _anchors(names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places whose least of the ``width`` names from there on is the same one: first, last, where it is."""
    low = np.uint64((1 << 24) - 1)
    key = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    rest = width - span
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    anchor = (key & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], cut])
    return first, np.concatenate([cut - 1, [len(anchor) - 1]]), anchor[first]


def _runs(sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of start positions with one anchor: first, last, anchor, anchor's name, name of the run's text."""
    n = len(sums) - 1
    if n < length:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    _, inverse = _powers(len(sums))
    grams = n - gram + 1
    names = _mix((sums[gram:] - sums[:grams]) * inverse[:grams])
    first, last, at = _anchors(names, length - gram + 1)
    offset = (at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
    whole = _mix(_names(sums, first, last + length) + _mix(offset + np.uint64(1)))
    return first, last, at, names[at], whole


def runs(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    return _runs(_sums(data), length, gram)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    step = np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Prefix sums over words as :func:`_sums` has them over bytes."""
    names = np.empty(len(starts), dtype=np.uint64)
    # long words and gaps are left out of the sums over bytes
    lo = 0
    far = np.flatnonzero((ends - starts > LONG_WORD) | (np.append(starts[1:], ends[-1]) - ends > LONG_WORD))
    for k in [*far.tolist(), len(starts) - 1]:
        hi = k + (ends[k] - starts[k] <= LONG_WORD)
        if hi > lo:
            begin = starts[lo]
            names[lo:hi] = _names(_sums(data[begin : ends[hi - 1]]), starts[lo:hi] - begin, ends[lo:hi] - begin)
        if hi == k and k >= lo:
            names[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
        lo = k + 1
    power, _ = _powers(len(names))
    out = np.empty(len(names) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(names * power[: len(names)], out=out[1:])
    return out


def _word_blocks(data: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """First word and word sums of pieces whose starts partition those of the text."""
    starts, ends = word_bounds(data)
    step = CHUNK // 4
    if len(starts) >= words:
        for lo in range(0, len(starts) - words + 1, step):
            part = slice(lo, lo + step + words - 1)
            yield lo, _word_sums(data, starts[part], ends[part])


def _blocks(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text whose start positions partition those of the text.

    A run cut at a border is two runs; the border depends on the place in the
    text, so such a run is compared position by position where it has to be.
    """
    step = CHUNK
    for lo in range(0, max(1, len(data) - length + 1), step):
        yield lo, data[lo : lo + step + length - 1]


RUNS = "h1 long, h2 long, doc_id long, key long, place long, copies int"
#: In places and spans: they are of words. In places: a run that is known to repeat speaks for its likes.
OF_WORDS, SPEAKS = 1 << 62, 1 << 61
#: Above the number of copies: known to repeat; of a hot anchor; not a run but a sign that its anchor is not unique.
SETTLED, HOT, SIGN = (k << 28 for k in (1, 2, 3))
COPIES = (1 << 28) - 1


def reduced(name: np.ndarray, whole: np.ndarray, doc: np.ndarray, of_words: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (name, whole) rows of a batch, which rows they settle, and which rows go on.

    The first row of each group carries the count: of rows, or for words of
    documents (``doc`` numbers them). The others of a group of two and more are settled.
    Of one document's equal words only one row goes on (:func:`_merge` finds the others). A
    row that is ``known`` to repeat counts as two.
    """
    order = np.lexsort((doc, whole, name))
    a, b, d = name[order], whole[order], doc[order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    group = np.cumsum(head) - 1
    new = head | np.concatenate([[True], d[1:] != d[:-1]]) | ~of_words[order]
    size = np.bincount(group, weights=new).astype(np.int64)
    if known is not None:
        size += np.bincount(group, weights=known[order]) > 0
    copies = np.zeros(len(order), dtype=np.int64)
    copies[order[head]] = size
    settled, goes_on = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=bool)
    settled[order], goes_on[order] = ~head, new
    return copies, settled, goes_on


def _scrambled(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Names of their own, for rows that are to meet no others."""
    return _mix(place.view(np.uint64) ^ _mix(doc.view(np.uint64) + np.uint64(1)))


def _find_runs(length: int, gram: int, words: int, gram_words: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = np.zeros(0, dtype=np.uint64)
        for batch in pieces(batches, 16 << 20):
            parts: list[tuple] = []

            def add(row: int, doc_id: int, key: int, lo: int, flag: int, sums: np.ndarray, size: int, of: int) -> None:
                first, last, at, name, whole = _runs(sums, size, of)
                n = len(first)
                place = pack(first + lo, last - first, at - first) | np.int64(flag)
                parts.append((name ^ np.uint64(flag), whole, np.full(n, doc_id), np.full(n, key), place, np.full(n, row)))

            for row, (doc_id, key, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                raw = text.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, dtype=np.uint8)
                if len(raw) >= length:
                    for lo, block in _blocks(data, length):
                        add(row, doc_id, key, lo, 0, _sums(block), length, gram)
                if words and len(raw) >= 2 * words - 1:
                    for lo, sums in _word_blocks(data, words):
                        add(row, doc_id, key, lo, OF_WORDS, sums, words, gram_words)
            if not parts:
                continue
            name, whole, doc, key, place, row = (np.concatenate(x) for x in zip(*parts))
            copies, settled, on = reduced(name, whole, row, place & OF_WORDS != 0)
            name, whole, doc, key, place, copies, settled = (x[on] for x in (name, whole, doc, key, place, copies, settled))
            # rows of anchors with many surroundings go by both; a sign goes by the anchor, once for each task
            speaking = np.flatnonzero(copies > 0)
            anchors, count = np.unique(name[speaking], return_counts=True)
            hot = anchors[count >= spread]
            is_hot = np.isin(name, hot) & ~settled
            signs = hot[~np.isin(hot, signed)]
            signed = np.concatenate([signed, signs])[-(1 << 16) :]
            name = np.where(is_hot, _mix(name ^ _mix(whole)), np.where(settled, _scrambled(doc, place), name))
            copies += np.where(settled, SETTLED, np.where(is_hot, HOT, 0))
            zero = np.zeros(len(signs), dtype=np.int64)
            more = (signs.view(np.int64), _mix(signs ^ np.uint64(batch.num_rows + 1)).view(np.int64), zero, zero, zero, zero + SIGN + 1)
            rows = [name.view(np.int64), whole.view(np.int64), doc, key, place, copies]
            columns = [np.concatenate([x, y]) for x, y in zip(rows, more)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns[:5]] + [pa.array(columns[5].astype(np.int32))], ["h1", "h2", "doc_id", "key", "place", "copies"])

    return run


def pack(first: np.ndarray, extra: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """First start, number of further starts and anchor's offset from the first, in one long."""
    return (first.astype(np.int64) << 20) | (extra.astype(np.int64) << 10) | offset.astype(np.int64)


def _find_halves(length: int, words: int):
    def halves(sums: np.ndarray, first: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Names of both halves from each of ``n`` places on, and these places."""
        s = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return _names(sums, s, s + size // 2), _names(sums, s + size // 2, s + size), s

    def of_text(data: np.ndarray, places: np.ndarray, is_words: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """Halves in a text: of a short one by its sums, of a long one by those around each place."""
        first, n = (places & (SPEAKS - 1)) >> 20, (places >> 10 & 1023) + 1
        known = places & SPEAKS != 0
        if is_words:
            size, limit, (starts, ends) = words, CHUNK // 4, word_bounds(data)
            sums_of = lambda lo, hi: _word_sums(data, starts[lo:hi], ends[lo:hi])
            total = len(starts)
        else:
            size, limit, total = length, CHUNK, len(data)
            sums_of = lambda lo, hi: _sums(data[lo:hi])
        if total <= limit:
            yield *halves(sums_of(0, total), first, n, size), np.repeat(known, n)
            return
        zero = np.zeros(1, dtype=np.int64)
        for lo, k, sure in zip(first.tolist(), n.tolist(), known.tolist()):
            a, b, s = halves(sums_of(lo, lo + k - 1 + size), zero, np.array([k]), size)
            yield a, b, s + lo, np.full(k, sure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for row, (doc_id, k, text, places) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                places = np.unique(np.array(places, dtype=np.int64))
                for flag in (0, OF_WORDS):
                    mine = places[(places & OF_WORDS) == flag]
                    for a, b, s, known in of_text(data, mine, flag > 0) if len(mine) else ():
                        parts.append((a ^ np.uint64(flag), b, np.full(len(s), doc_id), np.full(len(s), k), s | np.int64(flag), np.full(len(s), row), known))
            if parts:
                r1, r2, doc, key, start, row, known = (np.concatenate(x) for x in zip(*parts))
                copies, settled, on = reduced(r1, r2, row, start & OF_WORDS != 0, known)
                r1, r2, doc, key, start, copies, settled = (x[on] for x in (r1, r2, doc, key, start, copies, settled))
                r1 = np.where(settled, _scrambled(doc, start), r1)
                copies = (copies + np.where(settled, SETTLED, 0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r1.view(np.int64), r2.view(np.int64), doc, key, start, copies)], ["r1", "r2", "doc_id", "key", "start", "copies"])

    return run


def _covered(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans, of which those that touch are one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[head], hi[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(hi) - 1]])]


def _everywhere(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words, with those added whose ``words`` words stand in one of them."""
    names: list[np.ndarray] = []
    for first, sums in _word_blocks(data, words):
        n = np.arange(len(sums) - words)
        names.append(_names(sums, n, n + words))
    all_ = np.concatenate(names)
    inside = np.zeros(len(all_) + 1, dtype=np.int64)
    np.add.at(inside, lo, 1)
    np.add.at(inside, hi - words + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    at = np.flatnonzero(inside | np.isin(all_, all_[inside]))
    return _covered(at, at + words)


def _merge(length: int, words: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                removed, n_spans, shared, keep, kept_from = 0, 0, 0, [], 0
                s = np.array(spans or [], dtype=np.int64)
                of_words = s & OF_WORDS != 0
                at, extra = (s & (SPEAKS - 1)) >> 20, s & ((1 << 20) - 1)
                if of_words.any():
                    lo, hi = _everywhere(np.frombuffer(raw, dtype=np.uint8), *_covered(at[of_words], (at + extra + words)[of_words]), words)
                    shared = int((hi - lo).sum())
                if not of_words.all():
                    lo, hi = _covered(at[~of_words], (at + extra + length)[~of_words])
                    for x, y in zip(lo.tolist(), hi.tolist()):
                        keep.append(raw[kept_from:x])
                        kept_from = y
                        removed += y - x
                        n_spans += 1
                keep.append(raw[kept_from:])
                kept = b"".join(keep)
                row = (doc_id, len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest(), shared)
                out.append((*row, kept) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"] + ["kept"] * with_text
            types = [pa.int64()] * 4 + [pa.string(), pa.int64()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    return run


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, gram_words: int = GRAM_WORDS, spread: int = SPREAD) -> DataFrame:
    """``doc_id, key, span`` for each run of start positions whose ``length`` bytes start elsewhere too.

    ``docs`` has ``doc_id, key, text``, key naming the text. ``span`` is the first
    start shifted left by 20 bits plus the number of further starts; with the bit
    ``OF_WORDS`` it counts words, and its ``words`` words stand in another row too.
    """
    by_anchor, by_whole = Window.partitionBy("h1"), Window.partitionBy("h1", "h2")
    flag, copies = F.shiftright("copies", 28), F.col("copies").bitwiseAND(F.lit(COPIES))
    settled_, hot, sign = (F.lit(x >> 28) for x in (SETTLED, HOT, SIGN))
    ranked = (
        docs.mapInArrow(_find_runs(length, gram, words, gram_words, spread), RUNS)
        .withColumn("n1", F.sum(copies).over(by_anchor))
        .withColumn("n2", F.sum(copies).over(by_whole))
        .withColumn("nth", F.row_number().over(by_whole.orderBy("h2")))
        .withColumn("flag", flag)
        .filter((F.col("flag") == settled_) | (F.col("flag") == hot) | (F.col("n1") > 1))
        .withColumn("least", F.when(F.col("flag") == hot, F.lit(1)).otherwise(F.min("n2").over(by_anchor)))
        .filter(F.col("flag") != sign)
        .select(
            "doc_id", "key", "place", ((F.col("flag") == settled_) | (F.col("n2") > 1)).alias("known"),
            ((F.col("flag") != settled_) & (F.col("least") == 1) & ((F.col("n2") == 1) | (F.col("nth") == 1))).alias("edge"),
        )
    )
    # the sort of all runs moves more than any later step; its files go before those are written
    ranked = stored(ranked.filter("known or edge"), "runs", release=True)
    extra = F.shiftright("place", 10).bitwiseAND(F.lit(1023))
    known = ranked.filter("known").select("doc_id", "key", F.shiftleft(F.shiftright("place", 20), 20).bitwiseOR(extra).alias("span"))
    place = F.when(F.col("known"), F.col("place").bitwiseOR(F.lit(SPEAKS))).otherwise(F.col("place"))
    edges = ranked.filter("edge").groupBy("doc_id", "key").agg(F.collect_list(place).alias("places"))
    halves = docs.join(edges, ["doc_id", "key"]).select("doc_id", "key", "text", "places").mapInArrow(
        _find_halves(length, words), "r1 long, r2 long, doc_id long, key long, start long, copies int"
    )
    start = F.shiftleft(F.col("start").bitwiseAND(F.lit(SPEAKS - 1)), 20).bitwiseOR(F.col("start").bitwiseAND(F.lit(OF_WORDS)))
    doubled = (
        halves.withColumn("n", F.sum(copies).over(Window.partitionBy("r1", "r2")))
        .filter((flag == settled_) | (F.col("n") > 1))
        .select("doc_id", "key", start.alias("span"))
    )
    return known.unionByName(doubled)


def _keyed(docs: DataFrame) -> DataFrame:
    missing = F.lit(-(1 << 63)).cast("long")
    return texts_of(docs).select(F.coalesce("doc_id", missing).alias("doc_id"), "text", F.xxhash64("text").alias("key")).select("doc_id", "key", "text")


def _removed(keyed: DataFrame, found: DataFrame, length: int, words: int, with_text: bool) -> DataFrame:
    listed = found.groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long" + ", kept binary" * with_text
    return (
        keyed.join(listed, ["doc_id", "key"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_merge(length, words, with_text), schema)
        .withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63)).cast("long")))
    )


def deduplicated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, words: int = WORDS, gram_words: int = GRAM_WORDS, spread: int = SPREAD
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words`` (and ``kept``, the bytes left) per document.

    ``n_shared_words`` counts the words in passages of ``words`` words that stand in another document too.
    """
    if not 0 < gram < length < 1 << 20 or length - gram > 1000 or length % 2:
        raise ValueError("gram must be below length by at most 1000, and length even")
    if not 0 < gram_words < words or words - gram_words > 1000:
        raise ValueError("gram_words must be below words by at most 1000")
    keyed = _keyed(docs)
    return _removed(keyed, spans(keyed, length, gram, words, gram_words, spread), length, words, with_text)


def by_doubling(docs: DataFrame, length: int = LENGTH, first: int = 25, with_text: bool = False) -> DataFrame:
    """The result of :func:`deduplicated` (without shared words) by plain prefix doubling over all positions.

    Positions start with the rank of their ``first`` bytes. In each round the pairs (rank,
    rank at the offset reached) are counted in one sort by rank and joined by place, unique ones
    leave, and pairs become ranks, until the offset reaches ``length``.
    """

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, text, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sums = _sums(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8))
                for lo in range(0, len(sums) - first, CHUNK):
                    at = np.arange(lo, min(lo + CHUNK, len(sums) - first))
                    rank = _names(sums, at, at + first).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x)) for x in (doc_id, key)] + [pa.array(at), pa.array(rank), pa.array(np.full(len(at), copies))], ["doc_id", "key", "pos", "rank", "copies"])

    keyed = _keyed(docs)
    once = keyed.groupBy("doc_id", "key").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    rows = once.mapInArrow(positions, "doc_id long, key long, pos long, rank long, copies long")
    reached = first
    while True:
        shared = rows.withColumn("n", F.sum("copies").over(Window.partitionBy("rank"))).filter("n > 1").drop("n")
        if reached >= length:
            return _removed(keyed, shared.select("doc_id", "key", F.shiftleft("pos", 20).alias("span")), length, WORDS, with_text)
        shared = stored(shared, "ranks")
        step = min(reached, length - reached)
        ahead = shared.select("doc_id", "key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("after"))
        rows = shared.join(ahead, ["doc_id", "key", "pos"]).select("doc_id", "key", "pos", F.xxhash64("rank", "after").alias("rank"), "copies")
        reached += step


def brute(texts: list[str], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by comparing every string of ``length`` bytes; for tests."""
    raws = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for p in range(len(r) - length + 1):
            s = r[p : p + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        n = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
