"""Personal data: fixed base rules, and a character BiLSTM with a CRF that adds spans to theirs.

Kinds: email, ip, card, phone. Base rules find the leftmost non-overlapping matches of each kind.
The model is a bidirectional LSTM over characters with CRF transitions, trained in numpy on the
labelled spans of a bounded sample of documents (``TRAIN_DOCS``) and on re-written variants of them
(other separators, no country sign, other digits). Every kind contains a digit or an ``@`` by its
definition, so the whole text is searched for those anchors and overlapping windows are laid over all
that lies within ``REACH`` characters of one; no other place can hold a span. Windows are decoded by
Viterbi; each character takes its tag from the window in which it lies most centrally, and spans are
read off the one tag sequence of the text. An added span must be sure (``SURE``), hold the digits or
the sign of its kind (a card must pass the Luhn check), and not touch a base span; base spans always stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskpark.llm.common import sample_rows

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind
WIDTH, STRIDE, REACH = 96, 48, 32
#: Documents whose spans the model learns from at most, and windows of each sort.
TRAIN_DOCS, TRAIN_WINDOWS = 6000, 1200
#: Re-written forms of each labelled span.
VARIANTS = 3
SURE = 0.9
_ANCHOR = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None, proven: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: base matches of each kind; linear in the length of the text.

    Without ``proven`` a card need not pass the Luhn check.
    """
    text, found = text or "", []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and (not proven or luhn(digits)):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def codes_of(text: str) -> np.ndarray:
    """Character classes: printable ASCII 1 to 95, control 96, others 97; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points > 126, 97, np.where(points < 32, 96, points - 31)).astype(np.uint8)


# --- the model ---------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Parameters by name; x: embedding through the input weights, u: recurrent, for both directions."""

    hidden: int
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, hidden: int, seed: int = 7) -> Model:
        rng, h = np.random.default_rng(seed), hidden
        small = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        p = {"out": small(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            p |= {f"x{d}": small(98, 4 * h), f"u{d}": small(h, 4 * h)}
            p[f"x{d}"][:, h: 2 * h] += 1  # forget gates start open
        return cls(hidden, p)

    def run(self, x: np.ndarray, way: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of one direction, (rows, steps, hidden)."""
        rows, steps, h = *x.shape, self.hidden
        table, u = self.p[f"x{way}"], self.p[f"u{way}"]
        state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        out, saved = np.zeros((rows, steps, h), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            real = (x[:, t] > 0).astype(np.float32)[:, None]
            g = table[x[:, t]] + state @ u
            s = _sigmoid(g[:, : 3 * h])
            new = np.tanh(g[:, 3 * h:])
            before, last = cell, state
            cell = (s[:, h: 2 * h] * before + s[:, :h] * new) * real
            shown = np.tanh(cell)
            state = s[:, 2 * h:] * shown * real
            out[:, t] = state
            if keep:
                saved.append((t, real, s, new, before, last, shown))
        return out, saved

    def emit(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate((self.run(x, "f")[0], self.run(x, "b")[0]), axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of each window, and the CRF's posterior probability of each of those tags."""
        e = self.emit(x)
        rows, steps, _ = e.shape
        move, real = self.p["move"], x > 0
        best, back = self.p["first"] + e[:, 0], np.zeros((rows, steps, TAGS), np.uint8)
        for t in range(1, steps):
            to = best[:, :, None] + move
            back[:, t] = np.where(real[:, t, None], to.argmax(axis=1), np.arange(TAGS))
            best = np.where(real[:, t, None], to.max(axis=1) + e[:, t], best)
        tags = np.zeros((rows, steps), np.uint8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(rows), t, tags[:, t]]
        a, after = self.forward(e, real), np.zeros((rows, TAGS), np.float32)
        total, sure = _lse(a[:, -1], 1), np.zeros((rows, steps), np.float32)
        for t in range(steps - 1, -1, -1):
            sure[:, t] = np.exp((a[:, t] + after)[np.arange(rows), tags[:, t]] - total)
            after = np.where(real[:, t, None], _lse(move + (e[:, t] + after)[:, None, :], 2), after)
        return tags, sure

    def forward(self, e: np.ndarray, real: np.ndarray) -> np.ndarray:
        a = np.zeros_like(e)
        a[:, 0] = self.p["first"] + e[:, 0]
        for t in range(1, e.shape[1]):
            a[:, t] = np.where(real[:, t, None], _lse(a[:, t - 1, :, None] + self.p["move"], 1) + e[:, t], a[:, t - 1])
        return a

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        h, rows, steps = self.hidden, *x.shape
        (hf, sf), (hb, sb) = self.run(x, "f", True), self.run(x, "b", True)
        both = np.concatenate((hf, hb), axis=2)
        e, move, first = both @ self.p["out"] + self.p["bias"], self.p["move"], self.p["first"]
        real = x > 0
        a = self.forward(e, real)
        total = _lse(a[:, -1], 1)
        g, g_move = np.zeros_like(e), np.zeros_like(move)
        after = np.zeros((rows, TAGS), np.float32)
        g[:, -1] = np.exp(a[:, -1] - total[:, None]) * real[:, -1, None]
        for t in range(steps - 1, 0, -1):
            pair = np.exp(a[:, t - 1, :, None] + move + (e[:, t] + after)[:, None, :] - total[:, None, None]) * real[:, t, None, None]
            g_move += pair.sum(axis=0)
            after = np.where(real[:, t, None], _lse(move + (e[:, t] + after)[:, None, :], 2), after)
            g[:, t - 1] = np.exp(a[:, t - 1] + after - total[:, None]) * real[:, t - 1, None]
        r, c = np.nonzero(real)
        score = e[r, c, y[r, c]].sum() + first[y[:, 0]].sum()
        np.subtract.at(g, (r, c, y[r, c]), 1)
        r, c = np.nonzero(real[:, 1:])
        np.subtract.at(g_move, (y[r, c], y[r, c + 1]), 1)
        score += move[y[r, c], y[r, c + 1]].sum()
        g_first = g[:, 0].sum(axis=0)
        out = {"move": g_move, "first": g_first, "bias": g.sum(axis=(0, 1)), "out": np.tensordot(both, g, ((0, 1), (0, 1)))}
        d = g @ self.p["out"].T
        for way, saved, part in (("f", sf, d[:, :, :h]), ("b", sb, d[:, :, h:])):
            u, gu = self.p[f"u{way}"], np.zeros((h, 4 * h), np.float32)
            d_state, d_cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            gates = np.zeros((rows, steps, 4 * h), np.float32)
            for t, m, s, new, before, last, shown in reversed(saved):
                d_state = (d_state + part[:, t]) * m
                d_cell = (d_cell + d_state * s[:, 2 * h:] * (1 - shown**2)) * m
                raw = np.concatenate((d_cell * new, d_cell * before, d_state * shown), axis=1) * s * (1 - s)
                q = np.concatenate((raw, d_cell * s[:, :h] * (1 - new**2)), axis=1)
                gates[:, t] = q
                gu += last.T @ q
                d_state, d_cell = q @ u.T, d_cell * s[:, h: 2 * h]
            flat = x.ravel()
            one = np.zeros((98, flat.size), np.float32)
            one[flat, np.arange(flat.size)] = 1
            gx = one @ gates.reshape(-1, 4 * h)
            out |= {f"u{way}": gu, f"x{way}": gx}
        return float(total.sum() - score) / rows, {k: v / rows for k, v in out.items()}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 16, least_steps: int = 240, batch: int = 64, rate: float = 0.05) -> Model:
    """Adam with warm-up and linear decay over shuffled batches, in whole rounds; the same input gives the same model."""
    model, rng = Model.new(hidden), np.random.default_rng(11)
    m, v, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    epochs = -(-least_steps // -(-len(x) // batch))
    steps = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            own = order[at: at + batch]
            _, g = model.gradients(x[own], y[own])
            step += 1
            now = rate * min(1, step / 20) * max(0.05, 1 - step / steps)
            norm = np.sqrt(sum((d**2).sum() for d in g.values()))
            for k in g:
                d = g[k] * min(1, 5 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
                step_size = now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                model.p[k] -= step_size.astype(np.float32)
    return model


# --- training rows -----------------------------------------------------------------------------


def _variant(kind: int, value: str, rng: np.random.Generator) -> str:
    """Another way to write a value of the kind."""
    digits = "".join(rng.choice(list("0123456789"), 20))
    if kind == 0:
        swapped = "".join(digits[k % 20] if c.isdigit() else c for k, c in enumerate(value))
        return swapped.upper() if rng.random() < 0.2 else swapped
    if kind == 1:
        return ".".join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        sep = rng.choice(["", " ", "-"])
        return sep.join((digits[:4], digits[4:8], digits[8:12], digits[12:16]))
    a, b, c = digits[:3], digits[3:6], digits[6:10]
    forms = (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits[10:12]} {a} {b} {c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"00{digits[10:12]} {a} {b} {c}")
    return str(forms[rng.integers(len(forms))])


def training_rows(texts: list[str], limit: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: of base spans and variants of them, of places near other anchors, and of plain places.

    No sequence of characters shows the Luhn check, so all that is shaped like a card is labelled as one.
    """
    rng, found, other = np.random.default_rng(5), [], []
    for text in texts:
        spans = base_spans(text, False)
        taken = np.zeros(len(text) + 1, bool)
        for s, k, e in spans:
            taken[s:e] = True
            for new in (text[s:e], *(_variant(k, text[s:e], rng) for _ in range(VARIANTS))):
                left = text[max(0, s - int(rng.integers(8, 48))): s]
                if not _ANCHOR.search(left[-24:]):
                    found.append((left[-(WIDTH - 1):], k, new, text[e: e + 48]))
        other += [(text, m.start()) for m in _ANCHOR.finditer(text) if not taken[max(0, m.start() - 40): m.start() + 40].any()]
        if text:
            other.append((text, int(rng.integers(len(text)))))
    if not found:
        return np.zeros((0, WIDTH), np.uint8), np.zeros((0, WIDTH), np.int64)
    xs, ys = [], []
    for n in rng.permutation(len(found))[: limit]:
        left, kind, value, right = found[n]
        tags = [0] * len(left) + [1 + 2 * kind] + [2 + 2 * kind] * (len(value) - 1) + [0] * len(right)
        later = [(s + len(left + value), k, e + len(left + value)) for s, k, e in base_spans(right, False)]
        for s, k, e in later:
            tags[s:e] = [1 + 2 * k] + [2 + 2 * k] * (e - s - 1)
        xs.append(left + value + right)
        ys.append(tags)
    for n in rng.permutation(len(other))[: limit]:
        text, at = other[n]
        start = max(0, at - int(rng.integers(16, 64)))
        part = text[start: start + WIDTH]
        tags = [0] * len(part)
        for s, k, e in base_spans(part, False):
            tags[s:e] = [1 + 2 * k] + [2 + 2 * k] * (e - s - 1)
        xs.append(part)
        ys.append(tags)
    x, y = np.zeros((len(xs), WIDTH), np.uint8), np.zeros((len(xs), WIDTH), np.int64)
    for n, (part, tags) in enumerate(zip(xs, ys)):
        codes = codes_of(part)[:WIDTH]
        x[n, : len(codes)], y[n, : len(codes)] = codes, tags[: len(codes)]
    return x, y


def train(docs: DataFrame, rows: int = TRAIN_DOCS) -> Model | None:
    """A model from the labelled spans of at most ``rows`` documents; None if those hold no span."""
    anchored = sample_rows(docs, rows, "text").where(F.col("text").rlike("[0-9@]")).toPandas()
    anchored["order"] = [zlib.crc32(str(i).encode()) for i in anchored.doc_id]
    x, y = training_rows(list(anchored.sort_values(["order", "doc_id", "text"]).text))
    return fit(x, y) if len(x) else None


# --- finding -----------------------------------------------------------------------------------


def windows(codes: np.ndarray) -> np.ndarray:
    """Starts of the overlapping windows over all that lies within REACH of an anchor."""
    at = np.flatnonzero(((codes >= 17) & (codes <= 26)) | (codes == 33))
    if not len(at):
        return at
    far = np.flatnonzero(np.diff(at) > 2 * REACH)
    starts = np.maximum(0, at[np.append(0, far + 1)] - REACH)
    ends = at[np.append(far, len(at) - 1)] + REACH
    return np.concatenate([np.arange(s, max(s + 1, e - WIDTH + STRIDE), STRIDE) for s, e in zip(starts, ends)])


def added_spans(model: Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans of the model in each text, sorted."""
    coded = [codes_of(t) for t in texts]
    starts = [windows(c) for c in coded]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    flat = np.concatenate(starts) if starts else np.zeros(0, int)
    tags, sure = np.zeros((len(flat), WIDTH), np.uint8), np.zeros((len(flat), WIDTH), np.float32)
    for at in range(0, len(flat), 1024):
        x = np.zeros((min(1024, len(flat) - at), WIDTH), np.uint8)
        for n in range(len(x)):
            part = coded[owner[at + n]][flat[at + n]: flat[at + n] + WIDTH]
            x[n, : len(part)] = part
        tags[at: at + 1024], sure[at: at + 1024] = model.decode(x)
    out, at = [], 0
    for text, own in zip(texts, starts):
        out.append(_reconciled(text, own, tags[at: at + len(own)], sure[at: at + len(own)]))
        at += len(own)
    return out


def _reconciled(text: str, starts: np.ndarray, tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int]]:
    if not tags.any():
        return []
    size = len(text)
    centre = -np.abs(np.arange(WIDTH) - (WIDTH - 1) / 2)
    best, tag, odds = np.full(size + WIDTH, -np.inf), np.zeros(size + WIDTH, np.uint8), np.zeros(size + WIDTH, np.float32)
    for s, t, p in zip(starts, tags, sure):
        own = slice(s, s + WIDTH)
        nearer = centre > best[own]
        best[own][nearer], tag[own][nearer], odds[own][nearer] = centre[nearer], t[nearer], p[nearer]
    found, at = [], 0
    marked = np.flatnonzero(tag[:size])
    while at < len(marked):
        first = int(marked[at])
        kind, end = (int(tag[first]) - 1) // 2, first + 1
        while end < size and tag[end] == 2 + 2 * kind:
            end += 1
        if tag[first] % 2 and float(odds[first:end].mean()) >= SURE and _plausible(kind, text[first:end]):
            found.append((first, kind, end))
        at = int(np.searchsorted(marked, end))
    return found


def _plausible(kind: int, value: str) -> bool:
    figures = "".join(c for c in value if "0" <= c <= "9")
    digits = len(figures)
    if value != value.strip() or kind != 0 and re.search(r"[^0-9 ().+-]", value):
        return False
    return ("@" in value[1:-1], value.count(".") == 3 and digits >= 4, 12 <= digits <= 19 and luhn(figures), 9 <= digits <= 15)[kind]


def find_all(model: Model | None, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind number, end, is base), sorted by start then kind, for each text; none for a null or empty text."""
    base = [base_spans(t) for t in texts]
    more: dict[int, list] = {}
    if model is not None:
        anchored = [n for n, t in enumerate(texts) if t and _ANCHOR.search(t)]
        more = dict(zip(anchored, added_spans(model, [texts[n] for n in anchored])))
    out = []
    for n, own in enumerate(base):
        new = [x for x in more.get(n, ()) if all(x[2] <= s or e <= x[0] for s, _, e in own)]
        out.append(sorted([(*x, True) for x in own] + [(*x, False) for x in new]))
    return out


def spans_column(text: Column, model: Model | None) -> Column:
    """Array of (kind, start, end, base) by start, then kind; code points, end exclusive."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # some tens of kB

    @F.pandas_udf("kind array<string>, start array<int>, end array<int>, base array<boolean>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = find_all(shared.value, list(batch))
            yield pd.DataFrame({
                "kind": [[KINDS[x[1]] for x in f] for f in found], "start": [[x[0] for x in f] for f in found],
                "end": [[x[2] for x in f] for f in found], "base": [[x[3] for x in f] for f in found]})

    return of(text)


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, spans): one row for each input row, an empty list for null or empty texts.

    Spans of different kinds may overlap, as the base rules work kind by kind; other columns are not read.
    """
    found = docs.select("doc_id", spans_column(F.col("text"), model).alias("s"))
    return found.select("doc_id", F.arrays_zip("s.kind", "s.start", "s.end", "s.base").alias("spans"))


def masked(text: str | None, spans: list[tuple]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if text is None or not spans:
        return text
    out, done = [], 0
    for start, kind, end, *_ in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def masked_column(text: Column, model: Model | None) -> Column:
    """The whole text with its personal data masked; null stays null."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = list(batch)
            yield pd.Series([masked(t, s) for t, s in zip(texts, find_all(shared.value, texts))], dtype=object)

    return of(text)
