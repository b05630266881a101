"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by a small network from its words and word pairs, hashed to a
few signed sums, and from statistics of its characters and repetitions; gated attention weighs the passages, with weights
that are learned from document labels alone, and the weighted sum of their encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, documents, is_training, one_label, releasing, taught, uncarried

PASSAGE_WORDS, HIDDEN, ATTENTION = 64, 16, 8
#: Labelled rows, and bytes of their texts, that are learned from at most; steps of learning.
MAX_LABELLED, MAX_BYTES, STEPS, SEED = 6000, 64 << 20, 400, 20_240_605
BLOCK_BYTES = 1 << 18

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>^~=+\\{}[]@_/", b".,;:'\"()-", b"!?", b"\n")):
    _CLASS[list(_chars)] = _i + 1
_CLASS[128:] = 7
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
#: Signed sums that words and word pairs are hashed to, and all inputs of the encoder.
HASHED = 16
STATISTICS = 12 + HASHED


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _first_seen(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether each code is new in its document."""
    order = np.lexsort((code, doc))
    new = np.ones(len(code), bool)
    d, c = doc[order], code[order]
    new[order[1:]] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    return new


def passages(texts: list[bytes], size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A row of statistics per passage of `size` words of the texts, and the text of each; a text without words has one row of zeros."""
    t = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[t]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1, append=1))
    start, end = edge[0::2], edge[1::2]
    stops = np.cumsum([len(x) + 1 for x in texts])
    doc = np.searchsorted(stops, start, side="right")
    bare = np.setdiff1d(np.arange(len(texts)), doc)
    if not len(start):
        return np.zeros((len(texts), STATISTICS)), np.arange(len(texts))
    number = np.arange(len(start)) - np.searchsorted(doc, doc)
    head = np.flatnonzero((number % size == 0))
    owner = doc[head]
    words = np.diff(np.append(head, len(start))).astype(float)
    # bytes of each class between the first byte of a passage and that of the next one, or the end of the text
    kinds = _CLASS[t]
    until = np.minimum(np.append(start[head[1:]], len(t)), stops[owner] - 1)
    bounds = np.column_stack([start[head], until]).ravel()
    count = np.stack([np.add.reduceat((kinds == k), bounds, dtype=np.int64)[::2] for k in range(1, 8)], axis=1).astype(float)
    letters = np.add.reduceat((end - start).astype(float), head)
    # word hashes from prefix sums, and which words and word triples the document had before
    power = np.full(len(t), _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.full(len(t), pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    h = _mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    old_word = ~_first_seen(doc, h)
    triple = h.copy()
    for j in (1, 2):
        triple[:-j] += h[j:] * np.uint64(2 * j + 1) * np.uint64(_BASE)
    inside = np.zeros(len(h), bool)
    inside[: len(h) - 2] = doc[: len(h) - 2] == doc[2:] if len(h) > 2 else False
    old_triple = np.zeros(len(h), bool)
    at = np.flatnonzero(inside)
    old_triple[at] = ~_first_seen(doc[at], _mixed(triple[at]))
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    share = lambda a: np.add.reduceat(a.astype(float), head) / words
    every = np.maximum(letters, 1)
    passage = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    paired = np.flatnonzero(doc[:-1] == doc[1:])  # a pair is of the passage of its first word
    pair = _mixed(h[paired] + h[paired + 1] * np.uint64(5) * np.uint64(_BASE))
    hashed = np.zeros((len(head), HASHED))
    for at, code in ((passage, h), (passage[paired], pair)):
        sign = 1.0 - 2.0 * (code >> np.uint64(63)).astype(float)
        hashed += np.bincount(at * HASHED + (code % np.uint64(HASHED)).astype(np.int64), sign, len(head) * HASHED).reshape(-1, HASHED)
    hashed /= np.sqrt(words)[:, None]
    x = np.column_stack([np.sqrt(count / every[:, None]), np.log1p(letters / words), share(old_word), share(old_triple), share(twin), np.minimum(words / size, 1), hashed])
    x = np.vstack([x, np.zeros((len(bare), STATISTICS))])
    owner = np.concatenate([owner, bare])
    order = np.argsort(owner, kind="stable")
    return x[order], owner[order]


class Model:
    """tanh encoder, gated attention and a logistic output; parameters in a dictionary of arrays."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        p, h, k = len(mean), HIDDEN, ATTENTION
        self.p = {"W": rng.normal(size=(p, h)) / np.sqrt(p), "b": np.zeros(h), "V": rng.normal(size=(h, k)) / np.sqrt(h), "U": rng.normal(size=(h, k)) / np.sqrt(h), "w": rng.normal(size=k) / np.sqrt(k), "c": rng.normal(size=h) / np.sqrt(h), "c0": np.zeros(1)}

    def forward(self, x: np.ndarray, owner: np.ndarray) -> tuple:
        """Attention of each passage and logit of each bag; owner is sorted and has every bag from 0 on."""
        p = self.p
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        head = np.searchsorted(owner, np.arange(owner[-1] + 1))
        hid = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(hid @ p["V"]), 1 / (1 + np.exp(-(hid @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, head)[owner])
        a = e / np.add.reduceat(e, head)[owner]
        bag = np.add.reduceat(a[:, None] * hid, head, axis=0)
        return z, head, hid, t, s, a, bag, bag @ p["c"] + p["c0"][0]

    def score(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, owner)[-1], -30, 30)))

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean log loss and its gradients."""
        p = self.p
        z, head, hid, t, s, a, bag, logit = self.forward(x, owner)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -(weight * (y * np.log(prob + 1e-12) + (1 - y) * np.log(1 - prob + 1e-12))).sum()
        dl = weight * (prob - y)
        g = {"c": bag.T @ dl, "c0": np.array([dl.sum()])}
        dbag = (dl[:, None] * p["c"])[owner]
        da = (dbag * hid).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, head)[owner])
        g["w"] = (t * s).T @ de
        dg = de[:, None] * p["w"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        g["V"], g["U"] = hid.T @ dt, hid.T @ ds
        dh = (a[:, None] * dbag + dt @ p["V"].T + ds @ p["U"].T) * (1 - hid * hid)
        g["W"], g["b"] = z.T @ dh, dh.sum(axis=0)
        return float(loss), g

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.03, decay: float = 1e-4) -> float:
        """Adam over all bags at once, both labels weighing alike; returns the last loss."""
        ones = max(1.0, y.sum())
        weight = np.where(y == 1, 0.5 / ones, 0.5 / max(1.0, len(y) - y.sum()))
        m, v = ({k: np.zeros_like(q) for k, q in self.p.items()} for _ in range(2))
        loss = 0.0
        for i in range(1, steps + 1):
            loss, g = self.gradients(x, owner, y, weight)
            for k, q in self.p.items():
                d = g[k] + decay * q
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                q -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        return loss


def _blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    part, held = [], 0
    for x in texts.cast(pa.binary()):
        part.append(x.as_buffer().to_pybytes())
        held += len(part[-1])
        if held >= BLOCK_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[bytes] = []
        for part in _blocks(batch.column("text")):
            x, owner = passages(part)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1))
            rows += [x[a:b].astype("<f4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "quality", "bag"])


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> Model | None:
    """A model fitted on a sample of labelled training rows, bounded in rows and in bytes of text; None without both labels."""
    rows = taught(docs, one_label(labels, "quality", max_labelled), "quality", max_bytes)
    # some hundred bytes a passage of the bounded sample go to the driver
    got = rows.select("doc_id", "quality", "text").mapInArrow(releasing(_bags), "doc_id long, quality int, bag binary").orderBy("doc_id").collect()
    y = np.array([r.quality for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    bags = [np.frombuffer(r.bag, "<f4").reshape(-1, STATISTICS) for r in got]
    x = np.concatenate(bags).astype(float)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    model = Model(x.mean(axis=0), x.std(axis=0) + 0.02)
    model.fit(x, owner, y)
    return model


def quality_model(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages, then the columns named in carry.

    Only rows of labels whose crc32 of the id, modulo 4, is not 2 are learned from; if they do not hold both labels,
    every score is 0.5. Nulls: a null text is empty, one passage without words; a null or other label is no label; a row
    with a null doc_id is left out. Repeated rows are scored each, and ties have no effect; a repeated label counts once,
    and an id with both labels teaches nothing. Texts are read whole, whatever their length. Columns that are not carried
    are not read; a carried one may not be named like one of the result. An empty table gives no rows.
    """
    model = learn(docs, labels, max_labelled, max_bytes)
    d = documents(docs, *carried(carry, "doc_id", "held_out", "score", "predicted", "n_passages"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, sizes = [], []
            for part in _blocks(batch.column("text")):
                x, owner = passages(part)
                x = x.astype("<f4").astype(float)
                scores.append(model.score(x, owner) if model else np.full(len(part), 0.5))
                sizes.append(np.bincount(owner, minlength=len(part)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores)), pa.array(np.concatenate(sizes).astype(np.int64))], names=[*batch.schema.names, "score", "n_passages"])

    if not carry:
        names = "doc_id long, score double, n_passages long"

        def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in run(batches):
                yield batch.select(["doc_id", "score", "n_passages"])

        out = d.mapInArrow(releasing(lean), names)
    else:
        out = d.mapInArrow(releasing(run), f"{kinds}, score double, n_passages long")
    return out.select("doc_id", (~is_training("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages", *uncarried(carry))
