"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads every byte of a text in both directions, labels every
position and pools the position probabilities over the document.  It is
trained in numpy by backpropagation through time on a bounded sample of
windows; tasks then run it over whole texts, many windows side by side.  A
text is cut into windows of nearly equal size (at most ``WINDOW`` bytes), in
each of which both directions start from a zero state.

Gates and candidate use ``x / (1 + |x|)`` in place of the usual sigmoids.

Defined results: a null text, or one without a letter, is ``und`` with score
0; without any usable training row every text is ``und``; equal texts get equal
results; no column but the text is read for a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warung.llm import textscan as S

WINDOW = 256
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


# ------------------------------------------------------------------- network
@dataclass
class Network:
    """Per direction: input table (256, 3H), recurrent matrix (H, 3H), its bias
    (3H); shared: output matrix (2H, L) and bias (L).  Gate order: update,
    reset, candidate."""
    labels: list[str]
    inputs: list[np.ndarray]
    recur: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recur, *self.bias, self.out, self.out_bias]


def new_network(labels: list[str], hidden: int, rng: np.random.Generator) -> Network:
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(labels, [draw(256, 3 * hidden, scale=0.3) for _ in range(2)],
                   [draw(hidden, 3 * hidden, scale=hidden ** -0.5) for _ in range(2)],
                   [np.tile(np.repeat(np.float32([1, 0, 0]), hidden), 1) for _ in range(2)],
                   draw(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32))


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.abs(x)) ** 2


def _forward(table, recur, bias, data):
    """States of one direction for ``data`` (T, B), with what the way back needs."""
    steps, lanes = data.shape
    h = np.zeros((lanes, recur.shape[0]), np.float32)
    n = recur.shape[0]
    states, kept = np.empty((steps, lanes, n), np.float32), []
    for t in range(steps):
        a, b = table[data[t]], h @ recur + bias
        gates = a[:, :2 * n] + b[:, :2 * n]
        zr = 0.5 + 0.5 * _squash(gates)
        z, r = zr[:, :n], zr[:, n:]
        pre = a[:, 2 * n:] + r * b[:, 2 * n:]
        c = _squash(pre)
        kept.append((h, gates, z, r, b[:, 2 * n:], pre, c))
        h = c + z * (h - c)
        states[t] = h
    return states, kept


def _backward(table, recur, data, kept, d_states):
    """Gradients of one direction (backpropagation through time)."""
    n = recur.shape[0]
    d_recur, d_bias = np.zeros_like(recur), np.zeros(3 * n, np.float32)
    d_input = np.empty((*data.shape, 3 * n), np.float32)
    dh = np.zeros_like(d_states[0])
    for t in range(len(kept) - 1, -1, -1):
        h, gates, z, r, bc, pre, c = kept[t]
        dh = dh + d_states[t]
        d_pre = dh * (1 - z) * _slope(pre)
        d_zr = np.concatenate([dh * (h - c), d_pre * bc], 1) * 0.5 * _slope(gates)
        d_input[t] = np.concatenate([d_zr, d_pre], 1)
        db = np.concatenate([d_zr, d_pre * r], 1)
        d_recur += h.T @ db
        d_bias += db.sum(0)
        dh = dh * z + db @ recur.T
    order = np.argsort(data, axis=None, kind="stable")
    at = np.flatnonzero(np.diff(data.ravel()[order], prepend=-1))
    d_table = np.zeros_like(table)
    d_table[data.ravel()[order][at]] = np.add.reduceat(d_input.reshape(-1, 3 * n)[order], at)
    return d_table, d_recur, d_bias


def gradients(net: Network, data: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of ``data`` (T, B), and its gradients."""
    n = net.recur[0].shape[0]
    ways = [data, data[::-1]]
    run = [_forward(net.inputs[d], net.recur[d], net.bias[d], ways[d]) for d in (0, 1)]
    both = np.concatenate([run[0][0], run[1][0][::-1]], 2)
    logits = both @ net.out + net.out_bias
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    lanes = np.arange(data.shape[1])
    loss = float(-np.log(p[:, lanes, target] + 1e-9).mean())
    d = p
    d[:, lanes, target] -= 1
    d /= data.size
    d_out = np.einsum("tbh,tbl->hl", both, d)
    d_both = d @ net.out.T
    got = [_backward(net.inputs[k], net.recur[k], ways[k], run[k][1], [d_both[:, :, :n], d_both[::-1, :, n:]][k]) for k in (0, 1)]
    return loss, [got[0][0], got[1][0], got[0][1], got[1][1], got[0][2], got[1][2], d_out, d.sum((0, 1))]


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], *, hidden: int = 8, steps: int = 240, batch: int = 192,
          rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on batches with as many windows of each label."""
    rng = np.random.default_rng(seed)
    net = new_network(labels, hidden, rng)
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by = [np.flatnonzero(target == k) for k in range(len(labels))]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, -(-batch // len(labels))) for rows in by])
        _, grads = gradients(net, np.ascontiguousarray(windows[pick].T).astype(np.int64), target[pick])
        size = np.sqrt(sum(float((g ** 2).sum()) for g in grads))
        now = rate * min(1.0, 4 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (now * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


# ----------------------------------------------------------------- prediction
def _logits(net: Network, way: int, data: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> None:
    """Adds one direction's part to ``out`` (T, L, B); ``data`` is (T, B).
    Gates are stacked as (3, B, H), so that every step works on whole blocks."""
    n = net.recur[way].shape[0]
    steps, lanes = data.shape
    tables = [np.ascontiguousarray(net.inputs[way][:, k * n:(k + 1) * n] + (net.bias[way][k * n:(k + 1) * n] if k < 2 else 0))
              for k in range(3)]
    recur = np.ascontiguousarray(net.recur[way].reshape(n, 3, n).transpose(1, 0, 2))
    bias = net.bias[way][2 * n:]
    head = np.ascontiguousarray(net.out[way * n:(way + 1) * n].T)
    h = np.zeros((lanes, n), np.float32)
    a, b, size = (np.empty((3, lanes, n), np.float32) for _ in range(3))
    zr, c, part = a[:2], a[2], np.empty((len(head), lanes), np.float32)
    begun = np.searchsorted(lengths, np.arange(steps), side="right")    # lanes that end at or before t
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        at = data[t]
        for k in range(3):
            np.take(tables[k], at, axis=0, out=a[k], mode="clip")
        np.matmul(h, recur, out=b)
        zr += b[:2]
        np.abs(zr, out=size[:2])
        size[:2] += 1
        zr /= size[:2]
        zr *= 0.5
        zr += 0.5
        b[2] += bias
        b[2] *= zr[1]
        c += b[2]
        np.abs(c, out=size[2])
        size[2] += 1
        c /= size[2]
        h -= c
        h *= zr[0]
        h += c
        if way and begun[t]:                      # beyond its end a window has no state
            h[:begun[t]] = 0
        np.matmul(head, h.T, out=part)
        out[t] += part


def window_probabilities(net: Network, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum over positions of the label probabilities: ``data`` (T, B) to (L, B);
    ``lengths`` ascend."""
    steps, lanes = data.shape
    logits = np.empty((steps, len(net.labels), lanes), np.float32)
    logits[:] = net.out_bias[:, None]
    for way in (0, 1):
        _logits(net, way, data, lengths, logits)
    np.clip(logits, -40, 40, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    if (lengths < steps).any():
        logits *= (np.arange(steps)[:, None] < lengths)[:, None, :]
    return logits.sum(0, dtype=np.float64)


def document_probabilities(net: Network, texts: list[bytes], lanes: int = 1024) -> np.ndarray:
    """Pooled label probabilities (rows sum to 1) of non-empty texts."""
    total = np.zeros((len(texts), len(net.labels)))
    sizes = np.array([len(t) for t in texts])
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = nth * sizes[owner] // counts[owner]
    length = (nth + 1) * sizes[owner] // counts[owner] - begin
    buffer = np.concatenate([S.as_array(b"".join(texts)), np.zeros(WINDOW, np.uint8)])
    begin += (np.cumsum(sizes) - sizes)[owner]
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), lanes):
        now = order[at:at + lanes]
        steps = int(length[now].max())
        data = buffer[begin[now] + np.arange(steps)[:, None]].astype(np.intp)
        np.add.at(total, owner[now], window_probabilities(net, data, length[now]).T)
    return total / np.maximum(sizes, 1)[:, None]


def sample_windows(docs: DataFrame, *, per_document: int, width: int, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, piece)``: windows of ``width`` bytes at places drawn by the
    text's own hash, so copies of a text give the same rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in S.texts_of(batch, text_col):
                langs, windows = [], []
                for lang, text in zip(part.column(lang_col).to_pylist(), texts, strict=True):
                    if not _LETTER.search(text.decode("utf-8", "replace")):
                        continue
                    whole = S.span_hashes(S.prefix_hash(S.as_array(text)), np.array([0]), np.array([len(text)]))
                    draw = np.random.default_rng(int(whole[0]))
                    text = text + b" " * max(0, width - len(text))
                    for at in draw.integers(0, len(text) - width + 1, per_document):
                        langs.append(lang)
                        windows.append(text[at:at + width])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], ["lang", "piece"])

    return docs.select(lang_col, text_col).mapInArrow(cut, "lang string, piece binary")


def fit(docs: DataFrame, *, max_documents: int = 3000, per_document: int = 3, width: int = 96, text_col: str = "text",
        lang_col: str = "lang", max_labels: int = 256, **how) -> Network | None:
    """Train on the ``max_documents`` distinct texts of the smallest hash; None
    without any."""
    # the smallest hashes are found first, so that no text travels
    key = F.xxhash64(F.lit(3), text_col)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    edge = usable.select(key.alias("k")).distinct().orderBy("k").limit(max_documents).agg(F.max("k")).first()[0]
    if edge is None:
        return None
    rows = sample_windows(usable.where(key <= edge), per_document=per_document, width=width, text_col=text_col, lang_col=lang_col)
    found = rows.distinct().orderBy("piece", "lang").limit(max_documents * per_document).collect()
    found = sorted(found, key=lambda r: (r["lang"], bytes(r["piece"])))
    labels = sorted({r["lang"] for r in found})
    if not labels:
        return None
    if len(labels) > max_labels:
        raise ValueError(f"{len(labels)} languages; max_labels is {max_labels}")
    windows = np.array([np.frombuffer(bytes(r["piece"]), np.uint8) for r in found])
    return train(windows, np.array([labels.index(r["lang"]) for r in found]), labels, **how)


def predict(docs: DataFrame, net: Network | None, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text with ``keep_text``), with ``lang_pred``
    and ``score``."""
    rest = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in S.texts_of(batch, text_col, 512):
                use = [k for k, t in enumerate(texts) if net is not None and t and _LETTER.search(t.decode("utf-8", "replace"))]
                label, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if use:
                    p = document_probabilities(net, [texts[k] for k in use])
                    best = p.argmax(1)
                    for k, b, row in zip(use, best, p, strict=True):
                        label[k], score[k] = net.labels[b], float(min(max(row[b], 0.0), 1.0))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(label), pa.array(score)],
                                                 [*rest, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(S.lean(run), (kinds + ", " if kinds else "") + "lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Train on the documents that are not held out, predict every document."""
    net = fit(docs.where(~held_out(F.col(id_col))), text_col=text_col, lang_col=lang_col, **how)
    return predict(docs.select(id_col, text_col), net, text_col=text_col)
