"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over the whole UTF-8 text.  Their positions are dealt into
chunks of ``CHUNK``; a chunk's bytes overlap the next chunk's by ``WIDTH - 1``, so every
position of the document is in one chunk.  Each filter is max-pooled in each chunk and
rectified; the chunks' mean and maximum feed a logistic unit, which gives one probability.

It is trained on a bounded sample of the labelled rows (``PER_CLASS`` rows of each label,
``MAX_BYTES`` of text), in whole texts, on the driver; scoring runs in the tasks.

Cases: null and empty texts are one chunk of padding and get the network's score for it.
Without labelled rows of both classes, every score is the share of label 1 (0.5 without
any).  Extra columns are ignored; rows that repeat are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from airshed.llm.common import kept_rows, labelled_sample, read, scored, text_bytes, with_columns

WIDTH, FILTERS, CHUNK = 4, 8, 256
PER_CLASS, MAX_BYTES = 2000, 10 << 20
FOLD = (3, 1)
EPOCHS, BATCH, RATE, DECAY, SEED = 16, 24, 0.02, 1e-4, 7
#: Weight of label 1: a good document lost costs more than a poor one kept.
CLEAN = 3.0
#: Bytes convolved at once.
BLOCK = 1 << 18


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' bytes, each followed by WIDTH - 1 zeros, the place of each and its number of positions (1 at least)."""
    n = np.maximum(np.diff(offsets), 1)
    place = np.concatenate([[0], np.cumsum(n + WIDTH - 1)])
    out = np.zeros(place[-1], np.uint8)
    for k in range(len(n)):
        size = offsets[k + 1] - offsets[k]
        out[place[k] : place[k] + size] = raw[offsets[k] : offsets[k + 1]]
    return out, place[:-1], n


class ByteNet:
    """table[j, b]: what byte b at place j of a window adds to each filter; head: weights of the chunks' mean and maximum."""

    def __init__(self, table, bias, head, shift):
        self.table, self.bias, self.head, self.shift = table, bias, head, shift
        self._pairs = None

    @classmethod
    def constant(cls, p: float) -> ByteNet:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return cls(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), float(np.log(p / (1 - p))))

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def pairs(self) -> list[np.ndarray]:
        """The filters' sums for each two neighbouring bytes, so that a window needs WIDTH / 2 look-ups."""
        if self._pairs is None:
            self._pairs = [(self.table[j][:, None, :] + self.table[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]
        return self._pairs

    def chunk_maxima(self, data: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectified maxima of every chunk, and each document's number of chunks."""
        chunks = -(-n // CHUNK)
        start = np.repeat(place, chunks) + (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        end = np.minimum(start + CHUNK, np.repeat(place + n, chunks))
        two = data[:-1].astype(np.uint16) << 8 | data[1:]
        first, second = self.pairs()
        out = np.empty((len(start), FILTERS), np.float32)
        at = 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK)))
            a, b = start[at], end[stop - 1]
            values = first[two[a:b]]
            values += second[two[a + 2 : b + 2]]
            # Positions between documents (windows with the next one's bytes) form groups that are left out.
            edges = np.stack([start[at:stop], end[at:stop]], axis=1).ravel()[:-1] - a
            out[at:stop] = np.maximum.reduceat(values, edges, axis=0)[::2]
            at = stop
        return np.maximum(out + self.bias, 0), chunks

    def logits(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        maxima, chunks = self.chunk_maxima(*padded(*text_bytes(column)))
        at = np.cumsum(chunks) - chunks
        mean = np.add.reduceat(maxima, at, axis=0) / chunks[:, None]
        top = np.maximum.reduceat(maxima, at, axis=0)
        return np.concatenate([mean, top], axis=1).astype(np.float64) @ self.head.astype(np.float64) + self.shift

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -500, 500)))


def fit(rows: list[tuple[str, int]]) -> ByteNet:
    """Adam on the logistic loss; the maxima pass their gradients to the window that gave them."""
    y = np.array([label for _, label in rows], np.float64)
    if len(set(y)) < 2:
        return ByteNet.constant(y.mean() if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    texts = [text.encode() for text, _ in rows]
    net = [rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), np.full(FILTERS, 0.1), rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    weight = np.where(y == 1, CLEAN * 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            mine = order[k : k + BATCH]
            table, bias, head, shift = net
            pair = [(table[j][:, None, :] + table[j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32) for j in range(0, WIDTH, 2)] if k % (BATCH * 8) == 0 else pair
            grads = [np.zeros_like(p) for p in net]
            for d in mine:
                raw = np.frombuffer(texts[d], np.uint8)
                data, _, n = padded(raw, np.array([0, len(raw)]))
                # chunks x CHUNK windows; the last chunk repeats its last window
                at = np.minimum(np.arange(-(-n[0] // CHUNK) * CHUNK), n[0] - 1).reshape(-1, CHUNK)
                two = data[:-1].astype(np.uint16) << 8 | data[1:]
                values = pair[0][two[at]] + pair[1][two[at + 2]]
                where = values.argmax(axis=1)  # chunks x filters
                top_at = np.take_along_axis(at, where, axis=1)
                value = sum(table[j][data[top_at + j], np.arange(FILTERS)] for j in range(WIDTH)) + bias
                pooled = np.maximum(value, 0)
                best = pooled.argmax(axis=0)
                features = np.concatenate([pooled.mean(axis=0), pooled[best, np.arange(FILTERS)]])
                p = 1 / (1 + np.exp(-np.clip(features @ head + shift[0], -50, 50)))
                g = (p - y[d]) * weight[d] / len(mine)
                grads[2] += g * features
                grads[3] += g
                back = np.broadcast_to(g * head[:FILTERS] / len(pooled), pooled.shape).copy()
                back[best, np.arange(FILTERS)] += g * head[FILTERS:]
                back *= value > 0
                grads[1] += back.sum(axis=0)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (data[top_at + j], np.broadcast_to(np.arange(FILTERS), top_at.shape)), back)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for q, (p, g) in enumerate(zip(net, grads, strict=True)):
                g = g + DECAY * p
                first[q] += 0.1 * (g - first[q])
                second[q] += 0.001 * (g * g - second[q])
                p -= rate * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(net[0].astype(np.float32), net[1].astype(np.float32), net[2].astype(np.float32), float(net[3][0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> ByteNet:
    with_columns(docs, "doc_id", "text")
    return fit(labelled_sample(docs, labels, "quality", FOLD, per_class, max_bytes))


def keep_good(docs: DataFrame, net: ByteNet) -> DataFrame:
    """The rows that the network doesn't reject (score 0.5 or more)."""
    return kept_rows(docs, lambda column: net.score(column) >= 0.5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs, FOLD, train(docs, read(spark, sf_dir, "labels")).score)
