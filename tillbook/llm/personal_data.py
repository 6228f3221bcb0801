"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

Patterns find e-mail and network addresses, card and phone numbers in their plain forms.
The network is trained in numpy on labelled spans: what the patterns find in a sample of the
texts, as it stands and in other spellings (an address with "at" and "dot", numbers with
other separators or without a country code). It then reads all texts in overlapping windows;
each window is decoded, every letter takes the tag of the window in whose middle it lies, and
spans are joined over the borders of windows. A span of the network counts if, brought back
to its plain form, it passes the test of its kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# Tags: outside, then the first and the other letters of each kind.
TAGS = 1 + 2 * len(KINDS)
# Letters of a window, and those at either end that another window decides about.
WINDOW, MARGIN = 256, 16
STRIDE = WINDOW - 2 * MARGIN
# Windows that are decoded together.
BLOCK = 512
# Windows that wait for the search of the best path, at the least, before it is made.
HOPEFUL = 256
UNITS = 12
# Letters of a training window.
LEARNT = 64
NEVER = -1e4  # of a transition that cannot be

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits does: if it fails there, it fails further on too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time that grows with the text only."""
    done = 0
    for match in DOMAIN.finditer(text):
        start = match.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < match.start():
            done = match.end()
            yield start, done


def digit_stretches(text: str) -> list[tuple[int, int, int]]:
    """``start, end, digits`` of the parts in which digits lie next to each other or one
    letter apart: no network address or card number goes on from one to another."""
    # One byte for each code point; what Latin-1 lacks is no digit.
    codes = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    digits = np.flatnonzero((codes >= 0x30) & (codes <= 0x39))
    if not len(digits):
        return []
    cuts = np.flatnonzero(np.diff(digits) > 2)
    firsts, lasts = np.append(0, cuts + 1), np.append(cuts, len(digits) - 1)
    return list(zip(digits[firsts].tolist(), (digits[lasts] + 1).tolist(), (lasts - firsts + 1).tolist()))


def shapes(text: str) -> list[tuple[str, int, int]]:
    """The matches of the patterns, before the tests of their kinds, but for numbers that
    have too few digits for a network address or a card."""
    found = [("email", *span) for span in emails(text)]
    stretches = [s for s in digit_stretches(text) if s[2] >= 4]
    for kind, pattern, least in (("ip", IP, 4), ("card", CARD, 12)):
        found += [(kind, *m.span()) for start, end, digits in stretches if digits >= least for m in pattern.finditer(text, start, end)]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text)]


def shaped(kind: str, text: str) -> bool:
    """Whether a match looks like its kind to a reader who adds nothing up."""
    digits = len(NOT_DIGITS.sub("", text))
    return {"email": True, "ip": digits <= 12, "card": 12 <= digits <= 19, "phone": 9 <= digits <= 15}[kind]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def passes(kind: str, text: str) -> bool:
    """The test of a kind, on a match of its pattern."""
    if kind == "ip":
        return all(int(part) <= 255 if len(part) < 4 else int(part[-3:]) <= 255 and not part[:-3].strip("0") for part in text.split("."))
    if kind == "email":
        return True
    digits = NOT_DIGITS.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of what the patterns find, by start, then in the order of kinds."""
    found = [s for s in shapes(text) if passes(s[0], text[s[1] : s[2]])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


AT = re.compile(r"\s*(?:[\[({<]\s*(?:at|@)\s*[\])}>]|\bat\b|@)\s*", re.I)
DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>]|\bdot\b|\.)\s*", re.I)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"[\x20()./_0-9+-]+")


def plausible(kind: str, text: str) -> bool:
    """Whether a span of the network, brought back to the plain form, passes its kind's test."""
    if kind == "email":
        return ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", text, count=1))) is not None
    if kind == "ip":
        plain = DOT.sub(".", text)
        return IP.fullmatch(plain) is not None and passes(kind, plain)
    if not NUMBER.fullmatch(text):
        return False
    # A bare number, without as much as a separator, is no phone number.
    return passes(kind, text) and (kind == "card" or NOT_DIGITS.search(text) is not None)


def letter_table() -> np.ndarray:
    """Classes of letters by code point: digits as one, a-z, marks one by one, white space,
    line ends, and all others by whether they are letters. Class 0 is outside of the text."""
    table = np.zeros(0x251, np.uint8)
    marks = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    for code in range(0x250):
        char = chr(code)
        if char.isascii() and char.isalnum():
            table[code] = 1 if char.isdigit() else 2 + ord(char.lower()) - 97
        elif code in marks:
            table[code] = 32 + marks.index(code)
        else:
            table[code] = 28 if char in "\n\r" else 29 if char.isspace() else 30 if char.isalpha() else 31
    table[0x250] = 30
    return table


CLASSES = 32 + 32


def classes(text: str, table: np.ndarray) -> np.ndarray:
    found = np.empty(len(text), np.uint8)
    for at in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        found[at : at + len(codes)] = table[np.minimum(codes, 0x250)]
    return found


@dataclass
class Model:
    """``inputs`` (class by gate, with biases) and ``hidden`` (unit by gate) of both directions,
    gates in the order in, forget, out, new; ``out`` and ``bias`` give tag scores;
    ``moves`` from tag to tag, ``starts`` of a window."""

    inputs: list[np.ndarray]
    hidden: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.inputs, *self.hidden, self.out, self.bias, self.moves, self.starts]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Model:
        return cls(parts[:2], parts[2:4], *parts[4:])


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """NEVER for transitions to the inside of a kind from anywhere but that kind, else 0."""
    moves, starts = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for tag in range(2, TAGS, 2):
        moves[[t for t in range(TAGS) if t not in (tag - 1, tag)], tag] = NEVER
        starts[tag] = NEVER
    return moves, starts


def fresh(units: int, seed: int, dtype=np.float32) -> Model:
    rng = np.random.default_rng(seed)

    def table(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(dtype)

    inputs = [table(CLASSES, 4 * units) for _ in range(2)]
    for some in inputs:
        some[:, units : 2 * units] += 1  # remember at first
    return Model(
        inputs, [table(units, 4 * units) for _ in range(2)], table(2 * units, TAGS), np.zeros(TAGS, dtype), np.zeros((TAGS, TAGS), dtype), np.zeros(TAGS, dtype)
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_lstm(letters: np.ndarray, inputs: np.ndarray, hidden: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each letter (letters by window in, units last out), and what the way back needs."""
    units = len(hidden)
    h = c = np.zeros((letters.shape[1], units), inputs.dtype)
    states, kept = [], []
    for row in letters:
        z = inputs[row] + h @ hidden
        gates = sigmoid(z[:, : 3 * units])
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        g = np.tanh(z[:, 3 * units :])
        before, c = c, f * c + i * g
        wide = np.tanh(c)
        kept.append((i, f, o, g, before, wide, h))
        h = o * wide
        states.append(h)
    return np.stack(states), kept


def lstm_gradient(letters: np.ndarray, hidden: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``inputs`` and ``hidden`` from those of the states."""
    d_hidden = np.zeros_like(hidden)
    d_h = d_c = np.zeros_like(d_states[0])
    d_zs = np.empty((*letters.shape, hidden.shape[1]), hidden.dtype)
    for t in range(len(letters) - 1, -1, -1):
        i, f, o, g, before, wide, h = kept[t]
        d_h = d_h + d_states[t]
        d_c = d_c + d_h * o * (1 - wide * wide)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * wide * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        d_hidden += h.T @ d_z
        d_zs[t] = d_z
        d_h, d_c = d_z @ hidden.T, d_c * f
    one_hot = np.zeros((letters.size, CLASSES), hidden.dtype)
    one_hot[np.arange(letters.size), letters.ravel()] = 1
    return one_hot.T @ d_zs.reshape(letters.size, -1), d_hidden


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_loss(scores: np.ndarray, tags: np.ndarray, moves: np.ndarray, starts: np.ndarray):
    """Mean negative log chance of the tags, and gradients of scores, moves and starts."""
    steps, n, _ = scores.shape
    rows = np.arange(n)
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = starts + scores[0]
    for t in range(1, steps):
        ahead[t] = log_sum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        back[t] = log_sum(moves + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    total = log_sum(ahead[-1], 1)
    path = starts[tags[0]] + scores[np.arange(steps)[:, None], rows, tags].sum(axis=0) + moves[tags[:-1], tags[1:]].sum(axis=0)
    d_scores = np.exp(ahead + back - total[:, None])
    d_starts = d_scores[0].sum(axis=0)
    pairs = ahead[:-1, :, :, None] + moves + (scores[1:] + back[1:])[:, :, None, :] - total[:, None, None]
    d_moves = np.exp(pairs).sum(axis=(0, 1))
    np.add.at(d_moves, (tags[:-1], tags[1:]), -1)
    np.add.at(d_starts, tags[0], -1)
    d_scores[np.arange(steps)[:, None], rows, tags] -= 1
    return float((total - path).mean()), d_scores / n, d_moves / n, d_starts / n


def loss_and_gradients(model: Model, letters: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """``letters`` and ``tags`` have one column per window."""
    never, no_start = allowed()
    turned = [letters, letters[::-1]]
    runs = [run_lstm(some, i, h) for some, i, h in zip(turned, model.inputs, model.hidden)]
    states = np.concatenate([runs[0][0], runs[1][0][::-1]], axis=2)
    scores = states @ model.out + model.bias
    loss, d_scores, d_moves, d_starts = crf_loss(scores, tags, model.moves + never.astype(scores.dtype), model.starts + no_start.astype(scores.dtype))
    d_out = np.tensordot(states, d_scores, axes=([0, 1], [0, 1]))
    d_states = d_scores @ model.out.T
    units = len(model.hidden[0])
    ways = [d_states[:, :, :units], d_states[::-1, :, units:]]
    back = [lstm_gradient(some, h, kept, d) for some, h, (_, kept), d in zip(turned, model.hidden, runs, ways)]
    return loss, [back[0][0], back[1][0], back[0][1], back[1][1], d_out, d_scores.sum(axis=(0, 1)), d_moves, d_starts]


def fitted(letters: np.ndarray, tags: np.ndarray, units: int = UNITS, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 1) -> Model:
    """A model trained with Adam; ``letters`` and ``tags`` have one row per window."""
    model, rng = fresh(units, seed), np.random.default_rng(seed)
    parts = model.parts()
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step, steps = 0, epochs * -(-len(letters) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(letters))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, gradients = loss_and_gradients(model, letters[some].T, tags[some].T)
            size = float(np.sqrt(sum(float((g * g).sum()) for g in gradients)))
            step += 1
            pace = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for part, m, s, g in zip(parts, mean, square, gradients):
                g = g * min(1.0, 5 / (size + 1e-9))
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                part -= (pace * m / (np.sqrt(s) + 1e-8)).astype(part.dtype)
    return model


def window_states(
    letters: np.ndarray, inputs: np.ndarray, hidden: np.ndarray, out: np.ndarray | None = None, onto: np.ndarray | None = None
) -> np.ndarray:
    """States of a block, letters by unit by window: :func:`run_lstm` without the way back.
    With ``out``, what they add to the scores instead, letters by tag by window; it is added
    to the scores ``onto``, if given.

    Numpy's exponential takes a fraction of the time of its hyperbolic tangent, so that a gate
    is a division by 1 + exp(-x) and half of tanh(x) is 1 / (1 + exp(-2x)) - 1/2; the factors
    of x are in the weights, states are kept halved, and memory times -2, which is what the
    exponential takes. An exponential too large for a float is infinite, which gives the right
    limit. A letter's weights of a gate are neighbours in the table, so that they are copied
    together.
    """
    units = len(hidden)
    factors = np.repeat(np.array([-1, -1, -1, -2], np.float32), units)

    def by_gate(weights: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(weights.reshape(-1, 4, units).transpose(1, 0, 2), np.float32)

    table, weights = by_gate(inputs * factors), by_gate(2 * hidden * factors)
    steps, n = letters.shape
    z, pull = np.empty((4, n, units), np.float32), np.empty((4, n, units), np.float32)
    h, c, wide = (np.zeros((n, units), np.float32) for _ in range(3))
    enters, forgets, leaves, new = z
    row = np.empty(n, np.intp)
    one, two, half, minus_four = (np.float32(x) for x in (1, 2, 0.5, -4))
    tags = np.ascontiguousarray(2 * (np.eye(units) if out is None else out.T), np.float32)
    found = np.empty((steps, len(tags), n), np.float32) if onto is None else onto
    added = np.empty((len(tags), n), np.float32)
    with np.errstate(over="ignore"):
        for t in range(steps):
            row[:] = letters[t]
            table.take(row, axis=1, out=z, mode="clip")
            np.matmul(h, weights, out=pull)
            z += pull
            np.exp(z, out=z)
            z += one
            np.divide(minus_four, new, out=new)
            new += two
            new /= enters
            c /= forgets
            c += new
            np.exp(c, out=wide)
            wide += one
            np.reciprocal(wide, out=wide)
            wide -= half
            np.divide(wide, leaves, out=h)
            if onto is None:
                np.dot(tags, h.T, out=found[t])
            else:
                found[t] += np.dot(tags, h.T, out=added)
    return found


def decoded(windows: np.ndarray, model: Model) -> np.ndarray:
    """Tags of each window (windows by letters in and out), the best path of the CRF.

    Windows in which no stretch can score above the outside are known to stay there
    (:func:`most_gained`), and the search is spared for them.
    """
    units = len(model.hidden[0])
    never, no_start = allowed()
    moves, starts = model.moves + never, model.starts + no_start
    tags = np.zeros(windows.shape, np.uint8)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def search() -> None:
        """The best paths of all windows that wait for them, in one go."""
        if waiting:
            places, scores = zip(*waiting)
            tags[np.concatenate(places)] = best_paths(np.concatenate(scores, axis=2), moves, starts).T
            waiting.clear()

    for at in range(0, len(windows), BLOCK):
        letters = np.ascontiguousarray(windows[at : at + BLOCK].T)
        scores = window_states(letters, model.inputs[0], model.hidden[0], model.out[:units])
        window_states(letters[::-1], model.inputs[1], model.hidden[1], model.out[units:], scores[::-1])
        scores += model.bias[:, None]
        hopeful = np.flatnonzero(most_gained(scores, moves, starts) >= 0)
        if len(hopeful):
            waiting.append((at + hopeful, scores[:, :, hopeful]))
            if sum(len(places) for places, _ in waiting) >= HOPEFUL:
                search()
    search()
    return tags


def most_gained(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What a stretch of tags can score above the outside at most, per window.

    Each letter is given its best tag and each move the best of its sort, into a stretch,
    within and out of it, so that no path can gain more.
    """
    firsts = np.arange(1, TAGS, 2)
    into = float(max((moves[0, firsts] - moves[0, 0]).max(), (starts[firsts] - starts[0]).max()))
    within, out_of = float((moves[1:, 1:] - moves[0, 0]).max()), max(0.0, float((moves[1:, 0] - moves[0, 0]).max()))
    over, begun = scores[:, 1:].max(axis=1), scores[:, 1::2].max(axis=1)
    over -= scores[:, 0]
    begun -= scores[:, 0]
    begun += np.float32(into)
    run = most = begun[0]
    for t in range(1, len(scores)):
        run = np.maximum(run + over[t] + within, begun[t])
        most = np.maximum(most, run)
    return most + out_of + 1e-3


def best_paths(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Viterbi: letters by tag by window in, letters by window out."""
    steps, _, n = scores.shape
    best = scores[0] + starts[:, None]
    came = np.empty((steps, TAGS, n), np.uint8)
    for t in range(1, steps):
        through = best[:, None, :] + moves[:, :, None]
        came[t] = through.argmax(axis=0)
        best = through.max(axis=0) + scores[t]
    path = np.empty((steps, n), np.uint8)
    path[-1] = best.argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = came[t][path[t], np.arange(n)]
    return path


def windows_of(letters: np.ndarray) -> np.ndarray:
    """Overlapping windows of a text; each has MARGIN letters that others decide about at both ends."""
    n = -(-len(letters) // STRIDE)
    wide = np.zeros(n * STRIDE + 2 * MARGIN, np.uint8)
    wide[MARGIN : MARGIN + len(letters)] = letters
    return np.lib.stride_tricks.sliding_window_view(wide, WINDOW)[::STRIDE] if n else np.zeros((0, WINDOW), np.uint8)


def joined(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a text's tags; one that goes on over a border of windows is one span."""
    spans = []
    kinds = (tags.astype(np.int64) + 1) // 2
    edges = np.flatnonzero((kinds[1:] != kinds[:-1]) | (tags[1:] % 2 == 1)) + 1
    bounds = [0, *edges.tolist(), len(tags)]
    for start, end in zip(bounds[:-1], bounds[1:]):
        if kinds[start]:
            spans.append((KINDS[kinds[start] - 1], start, end))
    return spans


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without white space and marks that end no plain form."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    return start, end


def network_spans(text: str, tags: np.ndarray, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The network's spans that pass their tests and lie apart from those of the patterns."""
    found = []
    for kind, start, end in joined(tags):
        start, end = trimmed(text, start, end)
        if start < end and plausible(kind, text[start:end]) and not any(s < end and start < e for _, s, e in plain):
            found.append((kind, start, end))
    return found


SPAN = "array<struct<kind: string, start: int, end: int, plain: boolean>>"


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, text, spans`` of every row: all spans by start, then kind, in code points.

    ``plain`` is true for those of the patterns, which all stay; the network's are those
    apart from them. A NULL text has no spans. Without a model there are the patterns' only.
    """
    plan = docs.sparkSession.sparkContext.broadcast(model and model.parts())
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))

    def search(batches):
        table, network = letter_table(), plan.value and Model.of(plan.value)
        for batch in batches:
            texts = [text or "" for text in batch["text"].to_pylist()]
            spans = [[(*s, True) for s in plain_spans(text)] for text in texts]
            if network is not None and any(texts):
                windows = [windows_of(classes(text, table)) for text in texts]
                tags = decoded(np.concatenate(windows), network)
                at = 0
                for i, (text, some) in enumerate(zip(texts, windows)):
                    mine = tags[at : at + len(some)]
                    at += len(some)
                    if mine.any():
                        middle = mine[:, MARGIN : MARGIN + STRIDE].reshape(-1)[: len(text)]
                        spans[i] += [(*s, False) for s in network_spans(text, middle, [s[:3] for s in spans[i]])]
                        spans[i].sort(key=lambda s: (s[1], KINDS.index(s[0])))
            rows = [[dict(zip(("kind", "start", "end", "plain"), s)) for s in some] for some in spans]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(rows, span)], names=["doc_id", "text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind_of_id}, text string, spans {SPAN}")


def respelled(kind: str, text: str, rng: np.random.Generator) -> str:
    """Another spelling of the same kind of thing, with other letters and digits."""

    def other(char: str) -> str:
        if char.isdigit():
            return str(rng.integers(10))
        return chr(97 + rng.integers(26)) if char.isascii() and char.isalpha() else char

    text = "".join(other(c) for c in text)
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == "email":
        name, _, host = text.partition("@")
        dot = pick(".", ".", " dot ", "[dot]", " (dot) ", " [.] ")
        return name + pick("@", " at ", " [at] ", "(at)", " (at) ", " @ ", "[@]", " AT ") + host.replace(".", dot)
    if kind == "ip":
        return pick(".", "[.]", " . ", "(.)", "[dot]", " dot ").join(text.split("."))
    digits = NOT_DIGITS.sub("", text)
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return pick("", " ", "-", ".", "/", "_", "  ").join(groups)
    digits = digits[:13].ljust(10, "5")
    local = pick("({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "{}/{}-{}", "({}){}-{}", "{}/{}{}").format(digits[-10:-7], digits[-7:-4], digits[-4:])
    return pick("", "", "0", "00" + digits[:2] + " ", "+" + digits[:2] + " ", "+" + digits[:1] + " ") + local


LABELLED = "kind string, spot bigint, text string, tags binary"


def tagged(length: int, spans: Iterable[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.uint8)
    for kind, start, end in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
    return tags


def labelled(docs: DataFrame, sample: int, per_kind: int) -> list[tuple[str | None, str, np.ndarray]]:
    """``kind, text, tags`` of windows from about ``sample`` documents: at most ``per_kind``
    around spans of each kind, and as many others, with kind NULL.

    What looks like its kind is labelled whether or not it passes its test: no network adds
    up a checksum, and what it finds is tested afterwards.
    """
    total = docs.count()
    spot = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    chosen = docs.select("text", spot.alias("spot")).filter("text is not null")
    if total > sample:
        chosen = chosen.filter(F.shiftrightunsigned("spot", 11) < int(2.0**53 * sample / total))
    size = LEARNT

    def cut(batches):
        for batch in batches:
            rows = []
            for text, mark in zip(batch["text"].to_pylist(), batch["spot"].to_pylist()):
                spans = [s for s in shapes(text) if shaped(s[0], text[s[1] : s[2]])]
                tags = tagged(len(text), sorted(spans, key=lambda s: -KINDS.index(s[0])))
                for kind, start, end in [*spans, (None, mark % max(len(text), 1), 0)]:
                    order = zlib.crc32(f"{mark}:{start}:{kind}".encode())
                    first = max(0, start - order % max(1, size - (end - start) if kind else size))
                    rows.append((kind, order, text[first : first + size], tags[first : first + size].tobytes()))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "spot", "text", "tags"])

    found = chosen.mapInArrow(cut, LABELLED)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("spot", "text", "tags"))
    kept = found.withColumn("place", place).filter(F.col("place") <= per_kind).orderBy(F.asc_nulls_first("kind"), "place").collect()
    return [(r.kind, r.text, np.frombuffer(r.tags, np.uint8)) for r in kept]


def train(docs: DataFrame, sample: int = 20_000, per_kind: int = 250, spellings: int = 3, **options) -> Model | None:
    """A model learnt from at most ``sample`` documents and ``per_kind`` spans of each kind,
    each in ``spellings`` other spellings too; None if no span is found there."""
    rng = np.random.default_rng(7)
    table = letter_table()
    windows = []
    found = labelled(docs, sample, per_kind)
    for kind, text, tags in found:
        windows.append((text, tags))
        spans = joined(tags) if kind else []
        for _ in range(spellings if any(k == kind for k, _, _ in spans) else 0):
            new, marks, at = "", [], 0
            for name, start, end in spans:
                new += text[at:start]
                other = respelled(name, text[start:end], rng)
                marks.append((name, len(new), len(new) + len(other)))
                new, at = new + other, end
            new += text[at:]
            windows.append((new[:LEARNT], tagged(len(new), marks)[:LEARNT]))
    if not any(kind for kind, _, _ in found):
        return None
    letters, tags = np.zeros((len(windows), LEARNT), np.uint8), np.zeros((len(windows), LEARNT), np.uint8)
    for i, (text, some) in enumerate(windows):
        letters[i, : len(text)] = classes(text, table)
        tags[i, : len(text)] = some
    return fitted(letters, tags, **options)


def named(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def report(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, numbers of plain spans per kind, their digest, all spans, and ``n_network``,
    how many the network added. One row per row; an empty table gives none."""
    found = find(docs, train(docs, **options))
    plain = F.filter("spans", lambda s: s["plain"])
    counts = [F.size(of_kind(plain, kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(named(plain), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["plain"])).cast("long").alias("n_network"),
    )
