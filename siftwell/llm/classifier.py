"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters look at windows of 8 bytes (every 4th place), chunks of 512
bytes overlap by half and cover the whole text, each filter's response is
max-pooled over a chunk, and the maximum and mean over a text's chunks go
through a small hidden layer to one probability. Text is UTF-8; a text is
followed by zero bytes, which an empty text consists of.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import frugal, random_rows, slices, unused
from siftwell.llm.words import ragged

WINDOW, STEP, BLOCK = 8, 4, 256
DIMS, FILTERS, HIDDEN = 4, 24, 12
#: Bounds of the labelled sample that weights are learned from: at most TRAIN_ROWS texts of at most TRAIN_BYTES each, 120 MB.
TRAIN_ROWS, TRAIN_BYTES = 3000, 40_000
#: Bytes of text that are scored at a time.
BATCH_BYTES = 4 << 20
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.01, 3
THRESHOLD = 0.3


@dataclass
class Network:
    """embed (256 x dims), conv (filters x window * dims), and the layers after pooling."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_network(seed: int = SEED) -> Network:
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return Network(f(256, DIMS, scale=0.5), f(FILTERS, WINDOW * DIMS, scale=0.25), np.zeros(FILTERS, np.float32), f(HIDDEN, 2 * FILTERS, scale=0.15), np.zeros(HIDDEN, np.float32), f(HIDDEN, scale=0.3), np.zeros(1, np.float32))


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' bytes, each followed by zeros (8 at least) to a multiple of BLOCK: the bytes, and the first block of each text and the end."""
    n = np.diff(offsets)
    blocks = (n + WINDOW + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(first[-1]) * BLOCK + WINDOW, np.uint8)
    out[ragged(first[:-1] * BLOCK, n)] = data[offsets[0] : offsets[-1]]
    return out, first


def _windows(net: Network, data: np.ndarray, block: int, stop: int) -> np.ndarray:
    """Embedded windows that start in the blocks: (blocks * BLOCK / STEP) x (WINDOW * DIMS)."""
    x = net.embed[data[block * BLOCK : stop * BLOCK + WINDOW]]
    rows = (stop - block) * BLOCK // STEP
    return np.lib.stride_tricks.as_strided(x, (rows, WINDOW * DIMS), (STEP * DIMS * 4, 4), writeable=False)


def _pool(net: Network, data: np.ndarray, first: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest response in each block, and the window that has it. A text's last window would reach into the next text: it counts as the one before, zeros alike."""
    blocks = int(first[-1])
    last = np.zeros(blocks, bool)
    last[first[1:] - 1] = True
    most, at = np.empty((blocks, FILTERS), np.float32), np.empty((blocks, FILTERS), np.int64) if where else None
    for b in range(0, blocks, 1024):
        e = min(b + 1024, blocks)
        y = (np.ascontiguousarray(_windows(net, data, b, e)) @ net.conv.T).reshape(e - b, BLOCK // STEP, FILTERS)
        y[last[b:e], -1] = y[last[b:e], -2]
        if where:
            k = y.argmax(1)
            at[b:e] = k + (np.arange(b, e) * (BLOCK // STEP))[:, None]
            most[b:e] = np.take_along_axis(y, k[:, None], 1)[:, 0]
        else:
            most[b:e] = y.max(1)
    return np.maximum(most + net.bias, 0), at


def _chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks are two neighbouring blocks of a text (of a text of one block: that block): the second block of each chunk, the first chunk of each text."""
    n = np.diff(first)
    chunks = np.maximum(n - 1, 1)
    start = np.cumsum(chunks) - chunks
    left = ragged(first[:-1], chunks)
    return np.stack([left, left + np.repeat(n > 1, chunks)]), start


def _features(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Maximum and mean over the chunks of each text."""
    pair, start = _chunks(first)
    a, b = blocks[pair[0]], blocks[pair[1]]
    chunk = np.maximum(a, b)
    n = np.diff(np.concatenate([start, [len(chunk)]]))
    top, mean = np.maximum.reduceat(chunk, start), np.add.reduceat(chunk, start) / n[:, None]
    return np.concatenate([top, mean], 1).astype(np.float32), (pair, start, n, a >= b, chunk, top)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    if len(offsets) < 2:
        return np.zeros(0)
    bytes_, first = padded(data, offsets)
    x, _ = _features(_pool(net, bytes_, first)[0], first)
    h = np.tanh(x @ net.hidden.T + net.hidden_bias)
    return _sigmoid((h @ net.out + net.out_bias).astype(np.float64))


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, first = padded(np.frombuffer(b"".join(texts), np.uint8), offsets)
    blocks, at = _pool(net, data, first, where=True)
    x, (pair, start, n, left, chunk, top) = _features(blocks, first)
    h = np.tanh(x @ net.hidden.T + net.hidden_bias)
    d = ((_sigmoid(h @ net.out + net.out_bias) - labels) / len(labels)).astype(np.float32)
    g_out, g_out_bias = h.T @ d, np.array([d.sum()], np.float32)
    dh = d[:, None] * net.out * (1 - h * h)
    g_hidden, g_hidden_bias = dh.T @ x, dh.sum(0)
    dx = dh @ net.hidden
    text = np.repeat(np.arange(len(n)), n)
    is_top = chunk == top[text]
    ties = np.add.reduceat(is_top.astype(np.float32), start)
    dchunk = is_top * (dx[:, :FILTERS] / ties)[text] + (dx[:, FILTERS:] / n[:, None])[text]
    dblock = np.zeros_like(blocks)
    np.add.at(dblock, pair[0], dchunk * left)
    np.add.at(dblock, pair[1], dchunk * ~left)
    dblock *= blocks > 0
    g_conv, g_embed = np.zeros_like(net.conv), np.zeros_like(net.embed)
    for k in range(FILTERS):
        used = np.flatnonzero(dblock[:, k])
        if not len(used):
            continue
        seen = data[(at[used, k] * STEP)[:, None] + np.arange(WINDOW)]
        g_conv[k] = (dblock[used, k][:, None] * net.embed[seen].reshape(len(used), -1)).sum(0)
        back = dblock[used, k][:, None, None] * net.conv[k].reshape(WINDOW, DIMS)
        for j in range(DIMS):
            g_embed[:, j] += np.bincount(seen.ravel(), back[:, :, j].ravel(), 256)
    g_embed[0] = 0
    return [g_embed, g_conv, dblock.sum(0), g_hidden, g_hidden_bias, g_out, g_out_bias]


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Weights by Adam on the cross-entropy. Without both labels: the share of label 1, whatever the text."""
    net = new_network(seed)
    net.embed[0] = 0
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    net.out_bias[0] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    r = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for p, g, m, v in zip(net.parameters(), _gradients(net, [texts[j] for j in part], labels[part]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most `rows` rows outside fold 0, of texts up to text_bytes: those of the least hash of doc_id, which is a random choice."""
    marked = labels.filter(F.col("quality").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = random_rows(marked, marked.count(), rows, [F.xxhash64("doc_id"), F.col("doc_id")])
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= text_bytes)
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    found = got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    return [r["text"].encode() for r in found], np.array([r["quality"] for r in found], np.float32)


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1 of the whole text (null: empty). Rows and other columns stay; a column named score is replaced."""
    whole = unused("_text", docs.columns)
    rows = docs.withColumn(whole, F.col(text).cast("string")).drop("score")
    kept = [c for c in rows.columns if c != whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, whole, BATCH_BYTES):
            texts = pc.fill_null(b.column(whole), "")
            joined = pa.concat_arrays([texts])  # offsets from 0 on
            offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
            data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(probabilities(net, data, offsets))], [*kept, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != whole)
    return rows.mapInArrow(frugal(run), f"{schema}, score double")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by weights learned from labelled rows of the other folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score(docs.select("doc_id", (fold() == 0).alias("held_out"), F.col("text").alias("_whole")), net, "_whole").drop("_whole")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
