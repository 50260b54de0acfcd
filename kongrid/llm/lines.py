"""Line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

The field has two labels, log-linear emission scores over the shape of a line and transition scores. It is fitted here by
gradient ascent on the conditional likelihood of the lines of a bounded sample of labelled documents, whose lines take the
document's quality as label. Decoding (Viterbi) covers every line of every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.llm.common import labelled, map_rows, utf8

SPACE = b" \t\n\r\x0b\x0c"
_FOLLOW = bytes(range(0x80, 0xC0))
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
SYMBOLS = b"#*$%&|<>"
N_FEATURES = 14


def line_features(lines: list[bytes], repeated: list[bool]) -> np.ndarray:
    """Shape of each line; all values lie between 0 and about 1."""
    rows = []
    for line, again in zip(lines, repeated):
        n = max(1, len(line))
        tokens = line.split()
        k = max(1, len(tokens))

        def share(chars, n=n, line=line):
            return (len(line) - len(line.translate(None, chars))) / n

        end = tokens[-1][-1:] if tokens else b""
        rows.append((
            1.0, min(1.0, np.log1p(len(tokens)) / 6), share(_UPPER), share(_LOWER), share(_DIGITS), min(1.0, 4 * share(SYMBOLS)), min(1.0, 8 * share(b"|")),
            min(1.0, 8 * share(b"!?")), min(1.0, 8 * share(b".,;:")), float(end in (b".", b"!", b"?")), len(set(tokens)) / k, min(1.0, n / k / 16), float(again), min(1.0, 20 * share(b"/@=_{}")),
        ))
    return np.array(rows, dtype=float).reshape(len(lines), N_FEATURES)


@dataclass
class LineField:
    weights: np.ndarray  # (features, 2): label 0 boilerplate, 1 content
    steps: np.ndarray  # (2, 2): from, to
    start: np.ndarray  # (2,)

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest label sequence; ties go to boilerplate."""
        scores = (x @ self.weights).tolist()
        (aa, ab), (ba, bb) = self.steps.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for s0, s1 in scores[1:]:
            to0, to1 = b + ba > a + aa, b + bb > a + ab
            back.append((to0, to1))
            a, b = s0 + (b + ba if to0 else a + aa), s1 + (b + bb if to1 else a + ab)
        label = int(b > a)
        out = [label]
        for move in reversed(back):
            label = int(move[label])
            out.append(label)
        return np.array(out[::-1], dtype=np.int8)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 100, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """Maximum conditional likelihood by Adam, all sequences at once; each sequence counts by the root of its length."""
    if not sequences:
        return LineField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 1.0]))
    n, t = len(sequences), max(len(y) for _, y in sequences)
    x, y, mask = np.zeros((n, t, N_FEATURES)), np.zeros((n, t), dtype=int), np.zeros((n, t), dtype=bool)
    for i, (features, labels) in enumerate(sequences):
        x[i, : len(labels)], y[i, : len(labels)], mask[i, : len(labels)] = features, labels, True
    scale = (1 / np.sqrt(mask.sum(1)) / n)[:, None]
    gold = np.eye(2)[y] * mask[..., None]
    both = mask[:, 1:]
    gold_pair = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], both * scale)
    theta = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    for k in range(1, rounds + 1):
        w, steps, start = theta
        emit = x @ w
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = emit[:, 0] + start
        for j in range(1, t):
            ahead = _logsumexp(alpha[:, j - 1, :, None] + steps, 1) + emit[:, j]
            alpha[:, j] = np.where(mask[:, j, None], ahead, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            behind = _logsumexp(steps + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1, None], behind, 0.0)
        z = _logsumexp(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + steps + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        grads = [
            np.einsum("ntf,nta->fa", x, (gold - node) * scale[..., None]) - decay * w,
            gold_pair - np.einsum("ntab,nt->ab", pair, both * scale) - decay * steps,
            ((gold - node)[:, 0] * scale).sum(0) - decay * start,
        ]
        for p, g, m, v in zip(theta, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return LineField(*theta)


def _lines(text: bytes) -> tuple[list[bytes], list[bool]]:
    """Lines that hold a word, and whether each equals an earlier one."""
    lines, seen, again = [x for x in text.split(b"\n") if x.strip(SPACE)], set(), []
    for x in lines:
        again.append(x in seen)
        seen.add(x)
    return lines, again


def train_field(docs: DataFrame, labels: DataFrame, rows: int = 1200, most_lines: int = 48, text_col: str = "text") -> LineField:
    """Fit on at most `rows` labelled documents of at most `most_lines` lines; what reaches the driver has that bound."""
    sample = docs.join(F.broadcast(labelled(labels, rows)), "doc_id").select(utf8(text_col).alias("text"), "label")

    def features(columns):
        out, marks = [], []
        for text, label in zip(*columns):
            lines, again = _lines(text)
            if 0 < len(lines) <= most_lines:
                out.append(line_features(lines, again).astype(np.float32).tobytes())
                marks.append(label)
        return [out, marks]

    got = map_rows(sample, features, "x binary, label int").limit(rows).collect()
    pairs = [(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES).astype(float), r["label"]) for r in got]
    pairs.sort(key=lambda p: (len(p[0]), p[0].tobytes()))  # the same fit whatever the order of rows
    return fit_field([(x, np.full(len(x), label)) for x, label in pairs])


def repeat_words(tokens: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of `window` words found twice or more."""
    n = len(tokens)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, tokens), np.int64, n).view(np.uint64)
    m = n - window + 1
    code = np.zeros(m, np.uint64)
    for k in range(window):
        code = code * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + m] ^ (h[k : k + m] >> np.uint64(29)))
    ordered = np.sort(code)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.flatnonzero(np.isin(code, ordered[1:][same]))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge_lines(docs: DataFrame, field: LineField, content_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, labels, kept.

    `labels` has one letter per line with a word, C for content and B for boilerplate. A document is kept if it passes the
    base rules and at least `content_share` of its words lie in content lines. Null and empty texts have no words and fail.
    Other columns are ignored.
    """

    def judge(columns):
        out = [[] for _ in range(10)]
        for key, text in zip(*columns):
            tokens = text.split()
            n = len(tokens)
            chars = len(text.translate(None, SPACE + _FOLLOW))
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            lines, again = _lines(text)
            repeats = repeat_words(tokens)
            failed = n < 20 or 100 * repeats > 30 * n
            marks = field.viterbi(line_features(lines, again)) if lines else np.zeros(0, np.int8)
            content = sum(len(x.split()) for x, c in zip(lines, marks.tolist()) if c)
            kept = not failed and content >= content_share * n
            row = (key, n, chars, symbols, sum(again), repeats, failed, content, "".join("BC"[c] for c in marks.tolist()), kept)
            for column, value in zip(out, row):
                column.append(value)
        return out

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long, labels string, kept boolean"
    return map_rows(docs.select(id_col, utf8(text_col).alias("_text")), judge, schema)
