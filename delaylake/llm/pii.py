"""Operator 3: personal data by base patterns and a character BiLSTM with a CRF.

Base spans are those of four patterns with their checks. On top of them a
character-level bidirectional LSTM with CRF transitions, written and trained in
numpy on labelled spans, finds forms that the patterns miss (spelled-out
at-signs, phone numbers without a plus, other separators).

Texts are read in windows of ``WINDOW`` signs, ``STRIDE`` apart, each decoded by
Viterbi. Where windows overlap, a sign keeps the label of the window in which it
stands further from the edge, and spans are put together over the whole text,
across windows. A model's span is accepted if it passes its kind's check and
touches no base span. Every kind's check asks for digits, or for an email an
at-sign or ``at`` beside a bracket or digits; a window with neither a digit nor
``@`` nor such a sign cannot add an accepted span, so it is labelled as empty
without running the network.

Training spans: windows of at most ``TRAIN_DOCS`` documents (those with the least
hash that hold digits or ``@``; a bound that does not grow) labelled by the base
patterns, and generated ones for the other forms.

Defined results: null and empty texts have no spans; offsets count code points,
ends exclusive; ``n_email`` to ``n_phone`` count base spans; rows of one doc_id
are read each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, strings, table, texts_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 64
TRAIN_DOCS = 300
#: So many times as many documents are drawn to find those with digits or ``@``.
DRAWN = 20
HIDDEN = 16

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _digits(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` in the order kinds are listed, then by start."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in IP.finditer(text) if _ip_ok(m.group())]
        out += [(2, *m.span()) for m in CARD.finditer(text) if _card_ok(m.group())]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def acceptable(kind: int, s: str) -> bool:
    """Whether a span found by the model is one of its kind."""
    d = _digits(s)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]+(?:\s?(?:\.|\[dot\]|\(dot\))\s?[A-Za-z0-9-]+)*\s?(?:\.|\[dot\]|\(dot\))\s?[A-Za-z]{2,}", s))
    if kind == 1:
        parts = re.split(r"\[\.\]|\(\.\)|\s?\.\s?", s)
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./-]{0,2}[0-9])+", s)) and 16 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"\(?[0-9][ ()./0-9-]+[0-9]", s)) and 9 <= len(d) <= 12 and bool(re.search(r"[ ()./-]", s)) and not re.fullmatch(r"(?![0-9]{3}\.[0-9]{3}\.[0-9]{4}$)[0-9]+(\.[0-9]+)+|[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}.*", s)


_ANCHOR = re.compile(r"[0-9@]|[\[({]at[\])}]")

#: Printable ASCII by itself, other letters, other signs, padding.
N_CHARS = 99


def char_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(len(points), 97, dtype=np.int64)
    out[(points >= 32) & (points < 127)] = points[(points >= 32) & (points < 127)] - 31
    out[points >= 0xC0] = 96
    return out


class BiLstmCrf:
    """Tags 0 (none), 2k+1 (begins kind k), 2k+2 (inside kind k). Code 0 is padding."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, 2 * len(KINDS) + 1
        h, k = hidden, self.k
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"out": draw(2 * h, k), "bias": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32)}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.5, (N_CHARS, 4 * h)).astype(np.float32)
            self.p[f"u{side}"] = draw(h, 4 * h)
            self.p[f"x{side}"][:, h : 2 * h] += 1.0

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, codes: np.ndarray, side: str, keep: bool):
        """Hidden states (time, batch, h), and what backward needs."""
        h = self.h
        steps, batch = codes.shape
        state, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        out = np.empty((steps, batch, h), np.float32)
        memory = []
        wx, wu = self.p[f"x{side}"], self.p[f"u{side}"]
        order = range(steps) if side == "f" else range(steps - 1, -1, -1)
        for t in order:
            z = wx[codes[t]] + state @ wu
            gates = self._sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            new = f * cell + i * g
            th = np.tanh(new)
            if keep:
                memory.append((t, state, cell, i, f, o, g, th))
            state, cell = o * th, new
            out[t] = state
        return out, memory

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        f, _ = self._run(codes, "f", False)
        b, _ = self._run(codes, "b", False)
        return np.concatenate([f, b], axis=2) @ self.p["out"] + self.p["bias"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Viterbi tags (time, batch)."""
        e = self.emissions(codes)
        trans = self.p["trans"]
        steps, batch, k = e.shape
        score, back = e[0], np.zeros((steps, batch, k), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + trans[None]
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        tags = np.empty((steps, batch), np.int64)
        tags[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(batch), tags[t]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per window and its gradients (codes and tags are (time, batch))."""
        steps, batch = codes.shape
        k, h = self.k, self.h
        hf, mf = self._run(codes, "f", True)
        hb, mb = self._run(codes, "b", True)
        hid = np.concatenate([hf, hb], axis=2)
        e = (hid @ self.p["out"] + self.p["bias"]).astype(np.float64)
        trans = self.p["trans"].astype(np.float64)

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            m = x.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = lse(alpha[-1], 1)
        at, time = np.arange(batch)[None, :], np.arange(steps)[:, None]
        gold = e[time, at, tags].sum(0) + trans[tags[:-1], tags[1:]].sum(0)
        d_e = np.exp(alpha + beta - log_z[None, :, None])
        pairs = np.exp(alpha[:-1, :, :, None] + trans + (e + beta)[1:, :, None, :] - log_z[None, :, None, None])
        d_trans = pairs.sum((0, 1)) - np.bincount((tags[:-1] * k + tags[1:]).ravel(), minlength=k * k).reshape(k, k)
        d_e[time, at, tags] -= 1
        d_e = (d_e / batch).astype(np.float32)
        grads = {"out": np.einsum("tbh,tbk->hk", hid, d_e), "bias": d_e.sum((0, 1)), "trans": (d_trans / batch).astype(np.float32)}
        d_hid = d_e @ self.p["out"].T
        # one row per sign, one column per code: sums by code are one product
        signs = (codes.reshape(-1, 1) == np.arange(N_CHARS)).astype(self.p["xf"].dtype)
        for side, memory, part in (("f", mf, d_hid[:, :, :h]), ("b", mb, d_hid[:, :, h:])):
            wu = self.p[f"u{side}"]
            gu = np.zeros_like(wu)
            all_dz = np.zeros((steps, batch, 4 * h), self.p[f"x{side}"].dtype)
            d_state, d_cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
            for t, state, cell, i, f, o, g, th in reversed(memory):
                d_h = part[t] + d_state
                d_c = d_cell + d_h * o * (1 - th * th)
                dz = np.concatenate([d_c * g * i * (1 - i), d_c * cell * f * (1 - f), d_h * th * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
                all_dz[t] = dz
                gu += state.T @ dz
                d_state, d_cell = dz @ wu.T, d_c * f
            grads[f"x{side}"], grads[f"u{side}"] = signs.T @ all_dz.reshape(-1, 4 * h), gu
        return float((log_z - gold).mean()), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam over windows (rows); returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        s = {n: np.zeros_like(v) for n, v in self.p.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order, total = rng.permutation(len(codes)), []
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                loss, grads = self.gradients(codes[rows].T, tags[rows].T)
                step += 1
                scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads.values()))))
                lr = rate * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for n, g in grads.items():
                    g = g * scale
                    m[n] += 0.1 * (g - m[n])
                    s[n] += 0.001 * (g * g - s[n])
                    self.p[n] -= (lr * m[n] / (np.sqrt(s[n]) + 1e-8)).astype(np.float32)
                total.append(loss)
            losses.append(float(np.mean(total)))
        return losses


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            out[a] = 2 * kind + 1
            out[a + 1 : b] = 2 * kind + 2
    return out


def generated(n: int, fill: list[str], seed: int = 4) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with labelled spans in forms that the base patterns know and do not know."""
    rng = np.random.default_rng(seed)
    word = lambda: fill[rng.integers(len(fill))]
    low = lambda k: "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, k))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    octet = lambda: str(rng.integers(0, 256))
    pick = lambda *x: x[rng.integers(len(x))]

    def card() -> str:
        body = "4" + num(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def make() -> tuple[int, str]:
        kind = int(rng.integers(0, 10))
        if kind <= 2:
            at, dot = pick(("@", "."), (" @ ", "."), (" @ ", " . "), (" (at) ", " (dot) "), (" (at) ", "."), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", "."), ("[at]", "."))
            name = pick(low(rng.integers(3, 9)), low(1) + "." + low(rng.integers(4, 8)), low(5) + "_" + low(1))
            return 0, name + pick("", "." + num(2), "." + low(4)) + at + low(rng.integers(3, 9)) + pick("", num(1), "-" + low(4)) + dot + pick("", "example" + dot) + pick("com", "org", "net")
        if kind == 3:
            return 1, pick(".", "[.]", "(.)", ".").join(octet() for _ in range(4))
        if kind <= 5:
            c = card()
            return 2, pick(c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4)))
        if kind <= 7:
            return 3, pick("+1 ", "", "", "") + pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}")
        return -1, pick(num(rng.integers(1, 7)), f"20{num(2)}-{num(2)}-{num(2)}", "v" + num(1) + "." + num(1) + "." + num(2), "@" + low(6), num(4) + "/" + num(2), "$" + num(3) + "." + num(2), low(6) + num(10), num(40))

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            if rng.random() < 0.12:
                kind, s = make()
                if kind >= 0:
                    spans.append((kind, len(text), len(text) + len(s)))
                text += s + pick(" ", " ", ". ", ", ")
            else:
                text += word() + " "
        out.append((text[:WINDOW], [x for x in spans if x[2] <= WINDOW]))
    return out


def training_windows(texts: list[str], made: int = 1300) -> tuple[np.ndarray, np.ndarray]:
    fill = [w for t in texts[:100] for w in t.split()[:100] if not _ANCHOR.search(w)] or ["the", "of", "and", "a"]
    codes, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        c = np.zeros(WINDOW, dtype=np.int64)
        c[: len(text)] = char_codes(text)
        t = np.zeros(WINDOW, dtype=np.int64)
        t[: len(text)] = _tags(len(text), spans)
        codes.append(c)
        tags.append(t)

    for text in texts:
        spans = base_spans(text)
        for kind, a, b in spans[:2]:
            lo = max(0, a - 32)
            inside = [(k, x - lo, y - lo) for k, x, y in spans if lo <= x and y <= lo + WINDOW]
            add(text[lo : lo + WINDOW], inside)
    for text, spans in generated(made, fill):
        add(text, spans)
    return np.array(codes), np.array(tags)


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> BiLstmCrf:
    """Fit on windows around the first base spans of at most ``limit`` documents, and on generated windows."""
    chosen = bounded_sample(texts_of(docs), ["doc_id", "text"], DRAWN * limit).filter(F.col("text").rlike("[0-9@]")).limit(limit)
    model = BiLstmCrf()
    model.fit(*training_windows([r["text"] for r in chosen.select("text").collect()]))
    return model


def windows_of(text: str) -> list[int]:
    """Starts of the windows that cover the text."""
    return list(range(0, max(1, len(text) - (WINDOW - STRIDE)), STRIDE))


def model_spans(texts: list[str], model: BiLstmCrf, batch: int = 1024) -> list[list[tuple[int, int, int]]]:
    """What the network marks in each text, windows reconciled, checks not yet applied."""
    places: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        starts = sorted({s for m in _ANCHOR.finditer(text) for s in range(max(0, (m.start() - WINDOW) // STRIDE + 1) * STRIDE, m.start() + 1, STRIDE)})
        last = windows_of(text)[-1]
        places += [(i, s) for s in sorted({min(s, last) for s in starts})]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not places:
        return out
    codes = np.zeros((len(places), WINDOW), dtype=np.int64)
    coded: dict[int, np.ndarray] = {}
    for row, (i, s) in enumerate(places):
        if i not in coded:
            coded = {i: char_codes(texts[i])}
        part = coded[i][s : s + WINDOW]
        codes[row, : len(part)] = part
    tags = np.concatenate([model.decode(codes[lo : lo + batch].T).T for lo in range(0, len(codes), batch)])
    labels: dict[int, dict[int, tuple[int, int]]] = {}
    for (i, s), row in zip(places, tags):
        mine = labels.setdefault(i, {})
        n = min(WINDOW, len(texts[i]) - s)
        for j in np.flatnonzero(row[:n]).tolist():
            mine.setdefault(s + j, (0, -1))
        # a window also speaks where it sees nothing, if it sees that sign better
        for at in [a for a in mine if s <= a < s + n]:
            margin = min(at - s, s + n - 1 - at)
            if margin > mine[at][1]:
                mine[at] = (int(row[at - s]), margin)
    for i, mine in labels.items():
        # windows before may have seen a sign better that only a later one marked
        begin = end = kind = -1
        for at in sorted(a for a, (tag, _) in mine.items() if tag):
            tag = mine[at][0]
            if at != end or (tag - 1) // 2 != kind or tag % 2:
                if kind >= 0:
                    out[i].append((kind, begin, end))
                begin, kind = at, (tag - 1) // 2
            end = at + 1
        if kind >= 0:
            out[i].append((kind, begin, end))
    return out


def all_spans(texts: list[str], model: BiLstmCrf | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Of each text its base spans, and base and added spans together."""
    base = [base_spans(t) for t in texts]
    added = model_spans(texts, model) if model else [[] for _ in texts]
    out = []
    for text, b, more in zip(texts, base, added):
        extra = [(k, x, y) for k, x, y in more if acceptable(k, text[x:y]) and not any(x < q and p < y for _, p, q in b)]
        out.append((b, sorted(b + extra) if extra else b))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, model: BiLstmCrf) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans`` per document."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, spans in all_spans(strings(batch.column(1)), model):
                counts = [sum(k == i for k, *_ in base) for i in range(4)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base), len(spans)))
            cols = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, type=t) for c, t in zip(cols, types)], names)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return found(docs, train(docs))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
