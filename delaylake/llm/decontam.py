"""Operator 6: benchmark decontamination with Aho-Corasick over normalised items.

Benchmark items are normalised to lower-case words and cut into windows of 13
words (a shorter item is one window). The windows make one automaton, and each
document is scanned once in its normalised form; word numbers of a match come
from the normalised text, and spans lead back to offsets of the original.

An automaton takes some 26 bytes for each letter of its windows, so it is bounded:
items are packed into parts of at most ``PART_LETTERS`` window letters (a longer item
is cut where its windows allow), each part is one automaton and one broadcast of
bounded size, and a task holds one automaton at a time while it scans the texts
that it has read so far with each part in turn. What is found does not depend on the
number of parts; one part is scanned once, and scanning grows with their number.

Defined results: null text has no words; items without words (null, empty,
signs only) have no window; repeated item_ids count once in ``n_items``, with
the windows of all their rows; rows without item_id take no part; an empty
benchmark hits nothing; columns other than id and text are not looked at. Every row
is judged on its own text, whatever its doc_id (null or repeated ones too).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, strings, table, texts_of

WINDOW = 13
#: Letters of the windows in one automaton at most: some 100 MB.
PART_LETTERS = 4 << 20
#: Text that a task holds while it goes from one automaton to the next.
HELD_BYTES = 16 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: A-Z to a-z, every other ASCII sign that no word holds to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(text: str, window: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def line_of(text: str) -> str:
    """The words with a space before, between and behind them."""
    words = words_of(text)
    return " " + b" ".join(words).decode("latin-1") + " " if words else " "


class Scanner:
    """The automaton over the windows of some items, and the items that each window belongs to."""

    def __init__(self, items: Iterable[tuple[int, str]], window: int = WINDOW):
        self.owners: dict[bytes, set[int]] = {}
        for item, text in items:
            for w in windows_of(text, window):
                self.owners.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w in self.owners:
            self.automaton.add_word(f" {w.decode('latin-1')} ", w)
        if self.owners:
            self.automaton.make_automaton()

    def find(self, line: str) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of words (end exclusive) of each occurrence, and the items found."""
        if len(line) < 2 or not self.owners:
            return [], set()
        ends: list[int] = []
        sizes: list[int] = []
        items: set[int] = set()
        for end, w in self.automaton.iter(line):
            ends.append(end)
            sizes.append(w.count(b" ") + 1)
            items |= self.owners[w]
        if not ends:
            return [], items
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        last = np.searchsorted(spaces, ends).tolist()
        return [(b - n, b) for b, n in zip(last, sizes)], items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Parts:
    """Scans texts with the automaton of each part in turn, one of them in memory at a time."""

    def __init__(self, parts: list, window: int):
        self.parts, self.window = parts, window
        self.now: tuple[int, Scanner] | None = None

    def __getstate__(self):
        return {"parts": self.parts, "window": self.window, "now": None}

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], set[int], bool]]:
        """Of each text: words, merged runs of hit words, items found, whether a whole window of words was found."""
        lines = [line_of(t) for t in texts]
        spans: list[set[tuple[int, int]]] = [set() for _ in lines]
        items: list[set[int]] = [set() for _ in lines]
        # the automaton that was used last comes first
        first = self.now[0] if self.now else 0
        for i in [first, *(k for k in range(len(self.parts)) if k != first)] if self.parts else []:
            if self.now is None or self.now[0] != i:
                self.now = None
                self.now = (i, Scanner(self.parts[i].value, self.window))
            for k, line in enumerate(lines):
                found, owners = self.now[1].find(line)
                if found:
                    spans[k].update(found)
                    items[k] |= owners
        return [(max(0, line.count(" ") - 1), merged(s), i, any(b - a >= self.window for a, b in s)) for line, s, i in zip(lines, spans, items)]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets in ``text`` of runs of words."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    places = [(m.start(), m.end()) for m in WORD.finditer(raw.lower())]
    point = lambda i: len(raw[:i].decode("utf-8", "surrogatepass"))
    return [(point(places[a][0]), point(places[b - 1][1])) for a, b in runs]


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<struct<start:long,end:long>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "n_hit", "n_items")]
    + [("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id is not null")


def cut_item(text: str, window: int, letters: int) -> Iterator[str]:
    """The text, or if its windows are too long for a part, overlapping pieces with the same windows."""
    if window * (len(text) + 2) <= letters:
        yield text
        return
    words = [w.decode("utf-8", "surrogatepass") for w in words_of(text)]
    lo = 0
    while lo < len(words):
        hi, size = lo, 0
        while hi < len(words) and (hi - lo < window or window * (size + len(words[hi]) + 2) <= letters):
            size += len(words[hi]) + 1
            hi += 1
        yield " ".join(words[lo:hi])
        if hi == len(words):
            return
        lo = hi - window + 1


def load(benchmark: DataFrame, window: int = WINDOW, letters: int = PART_LETTERS) -> Parts:
    """The items in broadcasts of bounded size; the driver holds one part at a time."""
    spark = benchmark.sparkSession
    parts, part, size = [], [], 0
    for row in _items(benchmark).toLocalIterator():
        for text in cut_item(row.text, window, letters):
            n = window * (len(text) + 2)
            if part and size + n > letters:
                parts.append(spark.sparkContext.broadcast(part))
                part, size = [], 0
            part.append((row.item_id, text))
            size += n
    if part:
        parts.append(spark.sparkContext.broadcast(part))
    return Parts(parts, window)


def _held(batches: Iterable[pa.RecordBatch], size: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``size`` bytes, but the last."""
    group: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        group.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(group)
            group, n = [], 0
    if group:
        yield pa.concat_batches(group)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, letters: int = PART_LETTERS) -> DataFrame:
    """One row per document: counts, items found and the spans of hit words in the original text."""
    shared = load(benchmark, window, letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            rows = []
            texts = strings(batch.column(1))
            for doc_id, text, (n, runs, items, _) in zip(batch.column(0).to_pylist(), texts, shared.scan(texts)):
                hit = sum(b - a for a, b in runs)
                spans = [{"start": a, "end": b} for a, b in original_spans(text, runs)]
                rows.append((doc_id, n, hit, len(items), items_digest(items), is_contaminated(hit, n), sorted(items), spans))
            columns = zip(*rows) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return texts_of(docs).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, letters: int = PART_LETTERS) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no window of ``window`` words of an item.

    Items shorter than a window are phrases that a clean text may hold: a row goes for
    those only where it is contaminated, that is where hits make a twentieth of its words.
    """
    shared = load(benchmark, window, letters)
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches):
            found = shared.scan(strings(batch.column(at)))
            keep = [not whole and not is_contaminated(sum(b - a for a, b in runs), n) for n, runs, _, whole in found]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _words_sql(source: str, key: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"select {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{pattern}') as ws from {source}"


_SQL = f"""with d as ({_words_sql("documents", "doc_id")}), i as ({_words_sql("benchmark", "item_id")}),
windows as (select distinct item_id, least(len(ws), {WINDOW}) as n, array_to_string(ws[k:k + least(len(ws), {WINDOW}) - 1], ' ') as win
  from i, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) as t(k) where len(ws) > 0 and item_id is not null),
sizes as (select distinct n from windows),
places as (select doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') as win from d, sizes, unnest(range(1, greatest(len(ws) - n + 2, 1))) as t(k)),
found as (select doc_id, k, n, item_id from places join windows using (win, n)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as digest from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(digest, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES = {"op6_decontamination": _SQL}
