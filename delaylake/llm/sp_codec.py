"""Operator 8: SentencePiece encoding and decoding over a shared-prefix lattice.

A text is ``▁`` and the text with spaces turned into ``▁``; no piece holds a
``▁`` behind another sign, so the words (each with the mark before it) encode
on their own. Distinct marked words are sorted, which puts them in the order in
which a depth-first walk of their trie meets them, and one stack of forward
states serves all: a word keeps the states of the prefix that it shares with
the word before.

The vocabulary is of the BPE kind. Summing piece scores, as Viterbi does for a
unigram vocabulary, does not give its segmentation (merges happen in order of
score, not by the best sum). The forward state is therefore the last piece of
the prefix's segmentation, which like a Viterbi state depends on the prefix
alone: among the pieces that end here exactly one is compatible with the state
where it starts, two pieces being compatible if encoding them together gives
back these two.

Defined results: null is the empty text; the empty text has no pieces; signs
outside the vocabulary become byte pieces; decoding gives back every text
exactly. Words with several marks in front (runs of spaces, where marks merge with
each other) are encoded merge by merge from a queue, in time n log n. Rows of one doc_id are encoded each on its own; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces as text_pieces
from .common import ship, table, texts_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE_WORDS = 400_000
LONG_WORD = 256
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces with merge ranks, and for every piece the two that it was merged from."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.token = uuid.uuid4().hex
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(names) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {names[i]: sp.get_score(i) for i in plain}
        # ranks: single signs first, then by the order in which merges happen
        order = sorted((names[i] for i in plain), key=lambda p: (len(p) > 1, -score[p]))
        self.rank = {p: k for k, p in enumerate(order)}
        self.id_of = {names[i]: i for i in plain}
        self.score = score
        self.split: dict[str, tuple[str, str]] = {}
        for p in order:
            if len(p) > 1:
                parts = self.merged(p, last=True)
                if len(parts) == 2:
                    self.split[p] = (parts[0], parts[1])
        #: pieces that encoding can give
        usable = [p for p in order if len(p) == 1 or p in self.split]
        self.piece_id = {p: self.id_of[p] for p in usable}
        known = set(plain)
        self.names = names
        self.text_of = [p.replace(MARK, " ") if i in known else "" for i, p in enumerate(names)]
        lengths: dict[str, set[int]] = {}
        for p in usable:
            for tail in {p[-2:], p[-3:]} if len(p) > 1 else ():
                lengths.setdefault(tail, set()).add(len(p))
        #: lengths of the pieces that end with these three signs (two where no longer one does), longest first; a single sign is tried last
        self.lengths = {k: tuple(sorted(v if len(k) == 2 else v | lengths.get(k[1:], set()) & {2}, reverse=True)) for k, v in lengths.items()}
        self.lengths = {k: tuple(n for n in v if n == 2) if len(k) == 2 else v for k, v in self.lengths.items()}

    def merged(self, word: str, last: bool = False) -> list[str]:
        """Merge by merge, the definition; ``last`` stops before a merge that would leave one piece.

        Possible merges wait in a queue, the best score first, of equals the leftmost.
        """
        part, n, score = list(word), len(word), self.score
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(-s, i, 1, 1) for i in range(n - 1) if (s := score.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        count = n
        while queue and not (last and count == 2):
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if len(part[i]) != a or j >= n or len(part[j]) != b:
                continue
            part[i] += part[j]
            part[j] = ""
            count -= 1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (s := score.get(part[i] + part[after])) is not None:
                    heapq.heappush(queue, (-s, i, len(part[i]), len(part[after])))
            if (before := left[i]) >= 0 and (s := score.get(part[before] + part[i])) is not None:
                heapq.heappush(queue, (-s, before, len(part[before]), len(part[i])))
        return [p for p in part if p]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.names = list(vocabulary.names)
        #: signs outside the vocabulary, numbered behind it
        self.foreign: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _compatible(self, left: str, right: str) -> bool:
        """Whether ``left + right`` encodes as these two pieces."""
        rank, split = self.v.rank, self.v.split
        limit = 1 << 60
        a, b = left, right
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            # undo the later of the two merges that led here and look at the border again
            if ra > rb and a in split:
                limit, a = ra, split[a][1]
            elif b in split:
                limit, b = rb + 1, split[b][0]
            elif a in split:
                limit, a = ra, split[a][1]
            else:
                return True

    def _sign(self, sign: str) -> int:
        """The number of a sign that stands alone."""
        found = self.v.piece_id.get(sign)
        if found is None:
            found = self.foreign.get(sign)
            if found is None:
                found = self.foreign[sign] = len(self.names)
                self.names.append(sign)
        return found

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (16-bit, little-endian) of distinct marked words, none with a run of marks: depth-first over their trie."""
        piece_id, lengths, names, fits, compatible, n_ids = self.v.piece_id.get, self.v.lengths.get, self.names, self.fits, self._compatible, len(self.v.names)
        if len(fits) > 500_000:
            fits.clear()
        out: dict[str, bytes] = {}
        # of each prefix the last piece and its length
        states, sizes = [-1], [0]
        before = ""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], sizes[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for n in lengths(word[end - 3 : end] if end > 2 else word[:end]) or lengths(word[end - 2 : end], ()) if end > 1 else ():
                    if n <= end and (i := piece_id(word[end - n : end])) is not None:
                        prior = states[end - n]
                        if prior >= 0:
                            key = prior << 32 | i
                            fit = fits.get(key)
                            if fit is None:
                                fit = fits[key] = compatible(names[prior], names[i])
                            if not fit:
                                continue
                        states.append(i)
                        sizes.append(n)
                        break
                else:
                    i = piece_id(word[end - 1])
                    states.append(self._sign(word[end - 1]) if i is None else i)
                    sizes.append(1)
            before = word
            ids: list[int] = []
            end = len(word)
            while end:
                ids.append(states[end])
                end -= sizes[end]
            ids.reverse()
            out[word] = array("H", ids).tobytes() if max(ids) < n_ids else self.ids([names[i] for i in ids])
        return out

    def ids(self, parts: list[str]) -> bytes:
        id_of, byte_id = self.v.id_of, self.v.byte_id
        out: list[int] = []
        for p in parts:
            i = id_of.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [byte_id[b] for b in p.encode("utf-8", "surrogatepass")]
        return array("H", out).tobytes()

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Of marked words their ids; those of short words are remembered."""
        known = self.known
        new = {w for w in words if w not in known}
        if not new:
            return [known[w] for w in words]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        runs = {w for w in new if w[1:2] == MARK}
        found = self.words(list(new - runs))
        found.update((w, self.ids(self.v.merged(w))) for w in runs)
        out = [found[w] if w in found else known[w] for w in words]
        known.update((w, ids) for w, ids in found.items() if len(w) <= LONG_WORD)
        return out

    def one(self, text: str) -> bytes:
        """A text with runs of marks, word by word."""
        return b"".join(self._look_up(_WORD.findall(MARK + text.replace(" ", MARK)))) if text else b""

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end."""
        n = len(texts)
        runs = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        special = pc.or_(pc.or_(runs, pc.starts_with(texts, " ")), pc.equal(texts, ""))
        special = special.to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.if_else(pa.array(special), pa.scalar("x", texts.type), texts)
        split = pc.split_pattern(plain, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        parts = self._look_up([MARK + w for w in coded.dictionary.to_pylist()])
        whole = np.flatnonzero(special)
        if len(whole):
            index[offsets[whole]] = len(parts) + np.arange(len(whole))
            parts = parts + [self.one(texts[int(i)].as_py()) for i in whole]
        flat = np.frombuffer(b"".join(parts), dtype="<u2")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 2
        starts = np.cumsum(sizes) - sizes
        length = sizes[index]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        ids = flat[np.repeat(starts[index] - upto + length, length) + np.arange(total)]
        return ids, upto[offsets[1:] - 1] if n else np.zeros(0, dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary) -> Encoder:
    """One for each worker process and broadcast vocabulary, so that what it remembers outlives a task."""
    found = _ENCODERS.get(vocabulary.value.token)
    if found is None:
        _ENCODERS.clear()
        found = _ENCODERS[vocabulary.value.token] = Encoder(vocabulary.value)
    return found


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.text_of = vocabulary.text_of
        self.is_byte = np.zeros(len(self.text_of), dtype=bool)
        self.is_byte[list(vocabulary.byte_id.values())] = True
        self.byte_of = {i: b for b, i in vocabulary.byte_id.items()}

    def text(self, ids: np.ndarray) -> str:
        """The text of these ids, without the mark that encoding put first."""
        get = self.text_of.__getitem__
        marks = np.flatnonzero(self.is_byte[ids])
        if not len(marks):
            return "".join(map(get, ids.tolist()))[1:]
        out = []
        runs = np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1)
        at = 0
        for run in runs:
            a, b = int(run[0]), int(run[-1]) + 1
            out.append("".join(map(get, ids[at:a].tolist())))
            out.append(bytes(self.byte_of[i] for i in ids[a:b].tolist()).decode("utf-8", "surrogatepass"))
            at = b
        out.append("".join(map(get, ids[at:].tolist())))
        return "".join(out)[1:]


def encoded(docs: DataFrame, path: str | None = None, column: str = "pieces", checked: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, with the piece ids as array<int> in ``column`` (one of that name gives way).

    With ``checked`` each text is decoded again, and one that does not come back is an
    error. The mark itself is a space to the vocabulary and comes back as one.
    """
    docs = docs.drop(column)
    ship(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or model_path()))
    at = docs.columns.index("text")
    names = docs.columns + [column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(vocabulary), Decoder(vocabulary.value)
        for batch in text_pieces(batches, 8 << 20):
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            ids, ends = encoder.batch(texts)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            if checked:
                for text, lo, hi in zip(texts.to_pylist(), offsets.tolist(), ends.tolist()):
                    if decoder.text(ids[lo:hi]) != text.replace(MARK, " "):
                        raise ValueError(f"a text does not come back from its pieces: {text[:80]!r}")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, path: str | None = None, column: str = "pieces") -> DataFrame:
    """``doc_id, text`` from ``doc_id`` and an array of piece ids."""
    ship(rows.sparkSession)
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(path or model_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            texts = [decoder.text(np.array(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("array<int>").alias(column)).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_pieces, ids_crc32, decoded_sha256, exact``."""
    ship(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or model_path()))
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(vocabulary), Decoder(vocabulary.value)
        for batch in text_pieces(batches, 8 << 20):
            texts = batch.column(1).cast(pa.string())
            ids, ends = encoder.batch(texts)
            rows, lo = [], 0
            for text, hi in zip(texts.to_pylist(), ends.tolist()):
                part = ids[lo:hi]
                back = decoder.text(part)
                rows.append((hi - lo, zlib.crc32(part.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
                lo = hi
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
