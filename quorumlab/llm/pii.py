"""Personal data: exact patterns, and a linear-chain CRF over word shapes for what they miss.

The base spans of a text are the valid matches of four patterns.  A conditional random field
adds spans in spellings the patterns do not know (numbers without a plus sign, other separators,
spelled-out mail addresses).  It is trained on a small labelled table by gradient steps on the
likelihood, with forward-backward sums, and decoded by Viterbi over batches of windows in numpy.
A window is the tokens around a digit, an at sign, a bracketed "at" or the word "dot"; the checks
refuse a span without any of them, so nothing else is decoded.  A window whose labels reach one of
its ends grows on that side and is decoded again.  Added spans must pass the same checks as base spans
(parts to 255, Luhn and 13 to 19 digits, 9 to 15 digits) and touch no base span.

Row-local: one pass, no shuffle; the model is a few thousand numbers.  Null and empty texts have
no spans.  Repeated rows and null keys stay; other columns are ignored (kept by ``redact``); an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlab.llm import frames
from quorumlab.llm.memo import working_for
from quorumlab.llm.pii_examples import MARKED

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{mark}-{kind}" for kind in KINDS for mark in "BI")]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start within a run of digits cannot match where the run's start does not, so it is not tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\sA-Za-z0-9]")
SIGNAL = re.compile(r"[0-9@]|[(\[]\s?at\s?[)\]]|(?<![^\W\d_])dot(?![^\W\d_])", re.IGNORECASE)
#: Characters on each side of a signal that a window takes in, tokens whole; letter runs are cut to SHAPE.
AROUND, SHAPE = 48, 6
#: Label and token cells that are decoded at a time.
CELLS = 400_000
#: Texts whose windows are decoded together.
TEXTS = 32
STEPS, RATE, RIDGE = 160, 0.15, 0.01


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def is_byte(digits: str) -> bool:
    """Whether ASCII digits, however many zeros lead them, say at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Valid matches of each kind, leftmost and without overlap within a kind."""
    emails, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            emails.append((start, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    if not DIGIT.search(text):
        return [emails, [], [], []]
    ips = [m.span() for m in IP.finditer(text) if all(map(is_byte, m[0].split(".")))]
    cards = [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return [emails, ips, cards, phones]


def written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in own)


# The conditional random field.


def tokens_of(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in TOKEN.finditer(text, start, end)]


def shape(token: str) -> str:
    if token[0] in "0123456789":  # other characters that count as digits are no numbers here
        value = "<256" if len(token) <= 3 and is_byte(token) else ""
        return f"d{min(len(token), 17)}{value}"
    if token[0].isalpha():
        low = token.lower()
        if low in ("at", "dot"):
            return low
        case = "x" if token == low else "X" if token == token.upper() else "Xx"
        return case + str(min(len(token), SHAPE))
    return token


def token_features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    """Shapes of a token and its neighbours, and whether they touch."""
    shapes = ["<<", "<", *(shape(t) for t, _, _ in tokens), ">", ">>"]
    touch = [False] * 2 + [i > 0 and tokens[i - 1][2] == tokens[i][1] for i in range(len(tokens))] + [False] * 2
    rows = []
    for i in range(2, len(tokens) + 2):
        here = f"{shapes[i]}{'+' if touch[i] else ' '}"
        rows.append([
            f"0{here}", f"-1{shapes[i - 1]}", f"+1{shapes[i + 1]}{touch[i + 1]}", f"-2{shapes[i - 2]}", f"+2{shapes[i + 2]}",
            f"-10{shapes[i - 1]}|{here}", f"01{here}|{shapes[i + 1]}{touch[i + 1]}", f"-2-1{shapes[i - 2]}|{shapes[i - 1]}",
            f"12{shapes[i + 1]}|{shapes[i + 2]}", f"-101{shapes[i - 1]}|{here}|{shapes[i + 1]}",
        ])
    return rows


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


class Crf:
    """Weights by feature and label, and by pair of labels; plain arrays, sent to workers as is."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.number, self.weights, self.moves = number, weights, moves

    @classmethod
    def train(cls, sequences: list[tuple[list[list[str]], list[int]]]) -> Crf:
        names = sorted({f for rows, _ in sequences for row in rows for f in row})
        number = {name: i for i, name in enumerate(names)}
        n, labels = len(sequences), len(LABELS)
        length = max((len(gold) for _, gold in sequences), default=0)
        # A place holds the numbers of its features; places past an end hold a last one without weight.
        width = max((len(row) for rows, _ in sequences for row in rows), default=0)
        seen = np.full((n * length, width), len(names), np.int32)
        gold, real = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
        for i, (rows, own) in enumerate(sequences):
            for j, row in enumerate(rows):
                seen[i * length + j, : len(row)] = [number[f] for f in row]
            gold[i, : len(own)], real[i, : len(own)] = own, True
        weights, moves = np.zeros((len(names), labels)), np.zeros((labels, labels))
        model, squares = cls(number, weights, moves), [np.zeros_like(weights), np.zeros_like(moves)]
        truth = np.eye(labels)[gold] * real[:, :, None]
        for _ in range(STEPS if n and length else 0):
            padded = np.vstack([weights, np.zeros(labels)])
            emit = sum(padded[seen[:, k]] for k in range(width))
            single, pair = model._expected(emit.reshape(n, length, labels), real)
            both = (real[:, 1:] & real[:, :-1])[:, :, None, None]
            wanted = (truth[:, :-1, :, None] * truth[:, 1:, None, :] * both).sum((0, 1))
            missed = (truth - single).reshape(-1, labels)
            slope = np.stack([np.bincount(seen.ravel(), np.repeat(missed[:, x], width), len(names) + 1)[:-1] for x in range(labels)], 1)
            for value, gradient, square in (
                (weights, slope - RIDGE * weights, squares[0]),
                (moves, wanted - pair - RIDGE * moves, squares[1]),
            ):
                square += gradient**2
                value += RATE * gradient / (np.sqrt(square) + 1e-8)
        return model

    def _expected(self, emit: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities per place, and expected label pairs: forward-backward sums."""
        n, length, labels = emit.shape
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, length):
            following = _logsum(forward[:, t - 1, :, None] + self.moves, 1) + emit[:, t]
            forward[:, t] = np.where(real[:, t, None], following, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            before = _logsum(self.moves + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], before, 0)
        total = _logsum(forward[:, -1], 1)[:, None]
        single = np.exp(forward + backward - total[:, :, None]) * real[:, :, None]
        pair = np.zeros((labels, labels))
        for t in range(1, length):
            own = forward[:, t - 1, :, None] + self.moves + (emit[:, t] + backward[:, t])[:, None, :] - total[:, :, None]
            pair += np.exp(own[real[:, t]]).sum(0)
        return single, pair

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        get = self.number.get
        return np.stack([self.weights[[i for f in row if (i := get(f)) is not None]].sum(0) for row in rows])

    def decode(self, windows: list[list[list[str]]]) -> list[list[int]]:
        """Best labels of each window, windows of like length decoded together."""
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        found: list[list[int]] = [[] for _ in windows]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(windows[order[end]]) * (end + 1 - at) * len(LABELS) <= CELLS:
                end += 1
            for i, labels in zip(order[at:end], self._viterbi([windows[i] for i in order[at:end]]), strict=True):
                found[i] = labels
            at = end
        return found

    def _viterbi(self, windows: list[list[list[str]]]) -> list[list[int]]:
        sizes = np.array([len(w) for w in windows])
        emit = np.zeros((len(windows), sizes.max(), len(LABELS)))
        for i, rows in enumerate(windows):
            emit[i, : len(rows)] = self.emissions(rows)
        best, back = emit[:, 0], np.zeros(emit.shape, np.int8)
        for t in range(1, emit.shape[1]):
            paths = best[:, :, None] + self.moves
            back[:, t] = paths.argmax(1)
            going = (t < sizes)[:, None]
            best = np.where(going, paths.max(1) + emit[:, t], best)
        result = []
        for i, size in enumerate(sizes):
            labels = [int(best[i].argmax())]
            for t in range(size - 1, 0, -1):
                labels.append(int(back[i, t, labels[-1]]))
            result.append(labels[::-1])
        return result


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``text, spans`` (array of kind, start, end)."""
    rows = []
    for line in MARKED.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        rows.append((text + line[at:], spans))
    return spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,stop:int>>")


#: Lines of the labelled table that are used at most.
MAX_LABELLED = 5_000


def train(labelled: DataFrame) -> Crf:
    """A field from rows ``text, spans``; at most ``MAX_LABELLED`` of them, by hash of the text."""
    sequences = []
    rows = labelled.filter("text is not null").orderBy(F.xxhash64("text"), "text").limit(MAX_LABELLED).collect()
    for row in rows:
        tokens = tokens_of(row["text"], 0, len(row["text"]))
        gold = []
        for _, a, b in tokens:
            own = next((s for s in row["spans"] or [] if s["start"] <= a and b <= s["stop"]), None)
            first = own is not None and not any(own["start"] <= x and y <= own["stop"] and y <= a for _, x, y in tokens)
            gold.append(0 if own is None else LABELS.index(f"{'B' if first else 'I'}-{own['kind']}"))
        if tokens:
            sequences.append((token_features(tokens), gold))
    return Crf.train(sequences)


#: A place within a run of letters or digits.
WITHIN = re.compile(r"(?<=[^\W\d_])(?=[^\W\d_])|(?<=[0-9])(?=[0-9])")


def token_start(text: str, at: int) -> int:
    """The start of the token that ``at`` cuts, or ``at``."""
    while at > 0 and WITHIN.match(text, at):
        at -= 1
    return at


def token_end(text: str, at: int) -> int:
    """The end of the token that ``at`` cuts, or ``at``."""
    while at < len(text) and WITHIN.match(text, at):
        at += 1
    return at


def windows_of(text: str) -> list[tuple[int, int]]:
    """Stretches around signals, widened to whole tokens and joined where they meet."""
    found: list[list[int]] = []
    for m in SIGNAL.finditer(text):
        if found and m.end() + AROUND <= found[-1][1]:
            continue
        end = token_end(text, min(len(text), m.end() + AROUND))
        if found and m.start() - AROUND <= found[-1][1]:
            found[-1][1] = end
            continue
        start = token_start(text, max(0, m.start() - AROUND))
        if found and start <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([start, end])
    return [(a, b) for a, b in found]


def grown(text: str, start: int, end: int, left: bool, right: bool) -> tuple[int, int]:
    """A window of at least twice the width, towards the sides that labels reach."""
    more = max(AROUND, end - start)
    return token_start(text, max(0, start - more)) if left else start, token_end(text, min(len(text), end + more)) if right else end


def decoded(texts: list[str | None], model: Crf) -> list[tuple[int, list[tuple[str, int, int]], list[int]]]:
    """Owner, tokens and labels of each window; no labels reach an end within a text."""
    final: dict[tuple[int, int, int], tuple] = {}
    finished: dict[int, set[tuple[int, int]]] = {}
    waiting = [(i, a, b) for i, text in enumerate(texts) if text for a, b in windows_of(text)]
    while waiting:
        rows = [(w, tokens) for w in waiting if (tokens := tokens_of(texts[w[0]], w[1], w[2]))]
        labels = model.decode([token_features(tokens) for _, tokens in rows]) if rows else []
        changed: dict[int, list[tuple[int, int]]] = {}
        for (w, tokens), own in zip(rows, labels, strict=True):
            i, a, b = w
            left, right = own[0] > 0 and a > 0, own[-1] > 0 and b < len(texts[i])
            if left or right:
                changed.setdefault(i, []).append(grown(texts[i], a, b, left, right))
            else:
                final[w] = (i, tokens, own)
                finished.setdefault(i, set()).add((a, b))
        waiting = []
        for i, spans in changed.items():
            fixed = sorted(finished.get(i, ()))
            joined: list[list[int]] = []
            for a, b in sorted(spans + fixed):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            now = {(i, a, b) for a, b in joined}
            for a, b in fixed:
                if (i, a, b) not in now:
                    del final[i, a, b]
                    finished[i].discard((a, b))
            waiting += sorted(now - final.keys())
    return [final[w] for w in sorted(final)]


def valid(kind: int, text: str) -> bool:
    """The checks that an added span must pass."""
    digits = digits_of(text)
    if kind == 0:
        sign = "@" in text or re.search(r"[(\[]\s?at\s?[)\]]", text, re.IGNORECASE) is not None
        at, dot = (re.search(rf"\b{word}\b", text, re.IGNORECASE) is not None for word in ("at", "dot"))
        return (sign and (dot or "." in text)) or (at and dot)
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and is_byte(p) for p in parts) and "." in text
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and any(mark in text for mark in " -./()")


def find_spans(texts: list[str | None], model: Crf) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """Base spans and added spans of each text; features are made for ``TEXTS`` of them at a time."""
    if len(texts) > TEXTS:
        return [spans for start in range(0, len(texts), TEXTS) for spans in find_spans(texts[start : start + TEXTS], model)]
    results = [(base_spans(text) if text else [[], [], [], []], [[], [], [], []]) for text in texts]
    for i, tokens, labels in decoded(texts, model):
        base, added = results[i]
        taken = [span for own in base for span in own]
        at = 0
        while at < len(labels):
            if labels[at] == 0:
                at += 1
                continue
            kind, end = (labels[at] - 1) // 2, at + 1
            while end < len(labels) and labels[end] == 2 * kind + 2:
                end += 1
            span = tokens[at][1], tokens[end - 1][2]
            if valid(kind, texts[i][span[0] : span[1]]) and not any(a < span[1] and span[0] < b for a, b in taken):
                added[kind].append(span)
            at = end
    return results


def together(base: list, added: list) -> list[list[tuple[int, int]]]:
    return [sorted(b + a) for b, a in zip(base, added, strict=True)]


def find(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base), ``base_sha256, spans, n_added``."""

    def make():
        working_for("personal data")

        def function(texts):
            rows = find_spans(texts, model)
            counts = [pa.array([len(base[k]) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
            spans = [written(together(base, added)) for base, added in rows]
            extra = pa.array([sum(map(len, added)) for _, added in rows], pa.int64())
            return [*counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), extra]

        return function

    fields = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return frames.map_texts(docs, make, fields, key, text)


def masked(text: str | None, spans: list[list[tuple[int, int]]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    parts, at = [], 0
    for start, end, kind in sorted((a, -b, kind) for kind, own in zip(KINDS, spans, strict=True) for a, b in own):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, -end)
    return "".join([*parts, text[at:]]) if parts else text


def redact(docs: DataFrame, model: Crf, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with its spans replaced in ``text``, and ``length`` (if there) counted anew."""

    def of(texts: pa.Array) -> pa.Array:
        working_for("personal data")
        parts = [pa.array([], pa.string())]
        for start in range(0, len(texts), frames.SLICE):
            part = texts.slice(start, frames.SLICE).to_pylist()
            parts.append(pa.array([masked(t, together(*spans)) for t, spans in zip(part, find_spans(part, model), strict=True)], pa.string()))
        return pa.concat_arrays(parts)

    clean = docs.withColumn(text, F.arrow_udf(of, "string")(F.col(text).cast("string")))
    return clean.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType)) if length in docs.columns else clean
