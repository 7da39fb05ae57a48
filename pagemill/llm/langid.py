"""Language ID by a byte convolutional network: multi-width filters, max pooling, softmax.

Training (numpy, on the driver): at most ``sample`` labelled rows of the training folds, a window of
``span`` bytes of each, chosen by a hash of the text; so what the driver holds is ``sample × span`` bytes
at any size of the input. Every value of ``lang`` is a language and gets an equal share of the sample, of its distinct
texts; if there are more languages than ``sample``, one window of each (network and driver then grow with them).

Prediction (tasks, Arrow batches): every text is cut whole into windows of ``span`` bytes, the last one
padded; all windows of a batch go through the network together. A convolution over embedded bytes is a sum
of table rows: one row per byte for odd positions, one row per pair of bytes for the others. The windows'
log-probabilities, weighed by their bytes, add up to the document's; score is the winner's probability.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language
that sorts first; a learning set of no language gives ``und`` everywhere; of one, that language; null ids
count as empty text for folds; repeated rows are rows of their own; an empty table gives an empty result;
extra columns pass through and lose to the added names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, cut, lean, prepare, small

SAMPLE, SPAN = 8_000, 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 24, 8
UNKNOWN = "und"


def forward(net: dict, x: np.ndarray):
    """Training's pass over byte windows (n, span): logits, and what the gradient needs."""
    e = net["embed"][x]
    pooled, where = [], []
    for w in WIDTHS:
        n = x.shape[1] - w + 1
        z = sum(e[:, j : j + n] @ net[f"w{w}"][j] for j in range(w))
        at = z.argmax(1)
        where.append(at)
        pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + net[f"b{w}"])
    h = np.maximum(np.concatenate(pooled, 1), 0)
    return h @ net["out"] + net["bias"], e, h, where


def train(windows: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 10, seed: int = 8) -> dict:
    """Adam on cross-entropy; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    net = {"embed": rng.normal(0, 1, (256, EMBED)), "bias": np.zeros(classes),
           "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes))}
    for w in WIDTHS:
        net[f"w{w}"], net[f"b{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)), np.zeros(FILTERS)
    net = {k: v.astype(np.float32) for k, v in net.items()}
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x, y = windows[rows], labels[rows]
            logits, e, h, where = forward(net, x)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grad = {k: np.zeros_like(v) for k, v in net.items()}
            grad["out"], grad["bias"] = h.T @ p, p.sum(0)
            back = (p @ net["out"].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                g, at_ = back[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                grad[f"b{w}"] = g.sum(0)
                for j in range(w):
                    bytes_ = np.take_along_axis(x, at_ + j, 1)  # (n, FILTERS): the byte under each filter's peak
                    seen = net["embed"][bytes_]
                    grad[f"w{w}"][j] = np.einsum("nfe,nf->ef", seen, g)
                    np.add.at(grad["embed"], bytes_, g[:, :, None] * net[f"w{w}"][j].T[None])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k in net:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def tables(net: dict) -> dict:
    """The network as rows to add: by byte, and by pair of bytes."""
    out = {"out": net["out"], "bias": net["bias"], "b": np.concatenate([net[f"b{w}"] for w in WIDTHS])}
    for w in WIDTHS:
        single = np.stack([net["embed"] @ net[f"w{w}"][j] for j in range(w)])
        for j in range(0, w - 1, 2):
            out[f"pair{w}_{j}"] = (single[j][:, None] + single[j + 1][None]).reshape(65536, -1).astype(np.float32)
        if w % 2:
            out[f"last{w}"] = single[w - 1].astype(np.float32)
    return out


def log_probabilities(t: dict, windows: np.ndarray) -> np.ndarray:
    """Of byte windows (n, span), some at a time; the same function as ``forward`` gives."""
    parts = []
    for at in range(0, len(windows), 64):
        x = windows[at : at + 64]
        pairs = x[:, :-1].astype(np.int64) << 8 | x[:, 1:]
        pooled = []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            z = np.take(t[f"pair{w}_0"], pairs[:, :n], axis=0)
            for j in range(2, w - 1, 2):
                z += np.take(t[f"pair{w}_{j}"], pairs[:, j : j + n], axis=0)
            if w % 2:
                z += np.take(t[f"last{w}"], x[:, w - 1 : w - 1 + n], axis=0)
            pooled.append(z.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + t["b"], 0)
        logits = h @ t["out"] + t["bias"]
        logits = logits - logits.max(1, keepdims=True)
        parts.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
    return np.concatenate(parts) if parts else np.zeros((0, len(t["bias"])))


def cut_windows(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, padded with zeros: (windows, their text, their bytes)."""
    sizes = np.diff(offsets)
    count = -(-sizes // span)
    text = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[:-1][text] + number * span
    lengths = np.minimum(span, offsets[1:][text] - starts)
    index = starts[:, None] + np.arange(span)
    inside = np.arange(span) < lengths[:, None]
    return np.where(inside, data[np.minimum(index, max(len(data) - 1, 0))], 0) if len(text) else np.zeros((0, span), np.uint8), text, lengths


def learn(docs: DataFrame, learnable, text: str, lang: str, sample: int, span: int) -> tuple[list[str], dict | None]:
    """The network of a bounded sample of the rows that ``learnable`` marks (the only ones whose ``lang`` is read)."""
    rows = docs.where(learnable & F.col(lang).isNotNull() & F.rlike(F.col(text), F.lit(r"\p{L}")))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counts = cut(rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    names = sorted(r.lang for r in counts.select("lang").collect())
    if not names:
        return [], None
    each = max(1, sample // len(names))
    size = F.octet_length("text")
    begin = F.pmod(F.xxhash64(F.lit(1), F.col("text")), F.greatest(size - span, F.lit(0)) + 1)
    # texts with the lowest hashes of each language, some more than needed: a sample that doesn't depend on how rows are dealt out
    share = F.lit(3.0 * each + 30) / F.col("n")
    rows = rows.join(small(counts, 100_000), "lang").where((share >= 1) | (F.col("h").cast("double") < (share * 2 - 1) * float(1 << 63)))
    rows = rows.select("lang", "h", F.substring(F.col("text").cast("binary"), (begin + 1).cast("int"), F.lit(span)).alias("bytes"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = cut(rows.dropDuplicates(["lang", "h"])).withColumn("r", first)
    number = {name: i for i, name in enumerate(names)}
    found = sorted(rows.where(F.col("r") <= each).collect(), key=lambda r: (number[r.lang], r.h))
    windows = np.zeros((len(found), span), np.uint8)
    for i, r in enumerate(found):
        windows[i, : len(r.bytes)] = np.frombuffer(bytes(r.bytes), np.uint8)
    labels = np.array([number[r.lang] for r in found])
    return names, train(windows, labels, len(names)) if len(names) > 1 else None


def identify(docs: DataFrame, learnable, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE, span: int = SPAN) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``learnable``: a condition on the rows to learn from."""
    spark = prepare(docs.sparkSession).sparkContext
    names, net = learn(docs, learnable, text, lang, sample, span)
    shared = spark.broadcast(tables(net) if net else None)  # 25 MB, and 72 numbers for each language
    fields = ("lang_pred", "score")
    kept = [c for c in docs.columns if c not in fields and c != text]
    rows = docs.select(*kept, F.coalesce(F.rlike(F.col(text), F.lit(r"\p{L}")), F.lit(False)).alias("__letters"),
                       F.col(text).cast("binary").alias("__text"))

    def predict(batches):
        t = shared.value
        for batch in batches:
            k = batch.num_columns - 2
            letters = batch.column(k).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows)
            if t is not None:
                values = pc.fill_null(batch.column(k + 1), b"")
                offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
                data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)
                row, most = 0, max(1, 1_000_000 // len(names))
                while row < len(values):  # some 1,000 windows at a time; a longer text alone
                    to = max(row + 1, min(row + most, int(np.searchsorted(offsets, offsets[row] + 1000 * span, "right")) - 1))
                    windows, which, lengths = cut_windows(data, offsets[row : to + 1], span)
                    total = np.zeros((to - row, len(names)))
                    weight = np.zeros(to - row)
                    np.add.at(weight, which, lengths)
                    for at in range(0, len(windows), 64):
                        part = slice(at, at + 64)
                        np.add.at(total, which[part], log_probabilities(t, windows[part]) * lengths[part, None])
                    total = total / np.maximum(weight, 1)[:, None] * np.sqrt(np.maximum(weight / span, 1))[:, None]
                    p = np.exp(total - total.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best[row:to], score[row:to] = p.argmax(1), p.max(1)
                    row = to
            known = letters & bool(names)
            said = [names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *([batch.column(k + 1)] if keep else []), pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))],
                                             names=[*batch.schema.names[:k], *(["__text"] if keep else []), *fields])

    keep = text not in fields
    schema = rows.drop("__letters", *([] if keep else ["__text"])).schema.add("lang_pred", "string").add("score", "double")
    back = [F.col("__text").cast("string").alias(text) if c == text else F.col(c) for c in docs.columns if c not in fields]
    return rows.mapInArrow(lean(predict), schema).select(*back, *fields)


def held_out(key: str):
    return crc32_mod(key, 4) == 2
