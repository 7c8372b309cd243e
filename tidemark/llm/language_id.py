"""Language identification by a bidirectional gated recurrent network over bytes (operator 4).

The network reads a text's bytes in windows, in both directions, and gives every byte a distribution
over the languages seen in training. A document's probabilities are the normalised geometric mean
of those of its positions. Training is backpropagation through time in numpy on a bounded sample;
prediction covers every byte of every text, many windows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, rows, table

DDL = "doc_id long, held_out boolean, lang_pred string, score double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
UND = "und"
PAD = 256  # the symbol after a text's last byte; its positions have no label


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class BiGRU:
    """Gates z and r and candidate c side by side; h' = h + z (c - h), with r on the candidate's recurrent part."""

    def __init__(self, labels: list[str], hidden: int = 10, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.w = {}
        for d in "fb":
            # The inputs are one-hot, so the input weights are a table with one row for each symbol.
            self.w |= {f"x{d}": draw(PAD + 1, 3 * hidden), f"u{d}": draw(hidden, 3 * hidden)}
        self.w |= {"of": draw(hidden, len(labels)), "ob": draw(hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}

    def run(self, symbols: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States [time, row, hidden] of one direction over ``symbols`` [time, row]."""
        steps, n, k = *symbols.shape, self.hidden
        x, u = self.w["x" + d], self.w["u" + d]
        out, tape = np.empty((steps, n, k), np.float32), []
        h = np.zeros((n, k), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, b = x[symbols[t]], h @ u
            gates = a[:, : 2 * k] + b[:, : 2 * k]
            _gate(gates)
            z, r = gates[:, :k], gates[:, k:]
            c = np.multiply(r, b[:, 2 * k :])
            c += a[:, 2 * k :]
            np.tanh(c, out=c)
            if keep:
                tape.append((t, h, z, r, c, b[:, 2 * k :]))
            step = c - h
            step *= z
            h = np.add(h, step, out=out[t])
        return out, tape

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        return forward @ self.w["of"] + backward @ self.w["ob"] + self.w["bias"]

    def train_step(self, symbols: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over the real positions, by backpropagation through time."""
        states, tapes = {}, {}
        for d in "fb":
            states[d], tapes[d] = self.run(symbols, d, keep=True)
        p = self.logits(states["f"], states["b"])
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(truth)), truth] -= 1
        real = symbols != PAD
        p *= real[:, :, None] / np.float32(max(1, real.sum()))
        grads = {"bias": p.sum(axis=(0, 1))}
        flat, k = p.reshape(-1, p.shape[2]), self.hidden
        for d in "fb":
            grads["o" + d] = states[d].reshape(-1, k).T @ flat
            into = p @ self.w["o" + d].T
            x, u = np.zeros_like(self.w["x" + d]), np.zeros_like(self.w["u" + d])
            carry = np.zeros((symbols.shape[1], k), np.float32)
            for t, h, z, r, c, rec in reversed(tapes[d]):
                dh = into[t] + carry
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dr = dc * rec * r * (1 - r)
                rows_in = np.concatenate([dz, dr, dc], axis=1)
                np.add.at(x, symbols[t], rows_in)
                rows_rec = np.concatenate([dz, dr, dc * r], axis=1)
                u += h.T @ rows_rec
                carry = dh * (1 - z) + rows_rec @ self.w["u" + d].T
            grads |= {"x" + d: x, "u" + d: u}
        return grads

    def fit(self, symbols: np.ndarray, truth: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 0) -> BiGRU:
        """Adam over shuffled batches; ``symbols`` is [row, time]."""
        rng, m, v, n = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(symbols)), max(1, len(symbols) // batch)):
                n += 1
                for key, g in self.train_step(np.ascontiguousarray(symbols[at].T), truth[at]).items():
                    g = np.clip(g, -1, 1)
                    m[key] = 0.9 * m.get(key, 0) + 0.1 * g
                    v[key] = 0.999 * v.get(key, 0) + 0.001 * g * g
                    step = rate * (0.3 if epoch >= epochs * 2 // 3 else 1) * (m[key] / (1 - 0.9**n)) / (np.sqrt(v[key] / (1 - 0.999**n)) + 1e-8)
                    self.w[key] = (self.w[key] - step).astype(np.float32)
        return self

    def position_log_probs(self, symbols: np.ndarray) -> np.ndarray:
        """Log probabilities of every position, [time, row, label]."""
        x = self.logits(self.run(symbols, "f")[0], self.run(symbols, "b")[0])
        x -= x.max(axis=2, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=2, keepdims=True))
        return x

    def predict(self, texts: list[bytes], width: int = 64, at_once: int = 2048) -> np.ndarray:
        """Pooled probabilities [text, label]. Windows of ``width`` bytes, padded at a text's end, ``at_once`` at a time, however long a text is."""
        sums = np.zeros((len(texts), len(self.labels)))
        held, owner = [], []

        def flush() -> None:
            flat = np.full(len(owner) * width, PAD, np.int16)
            at = 0
            for part in held:
                flat[at : at + len(part)] = np.frombuffer(part, np.uint8)
                at += -(-len(part) // width) * width
            for k in range(0, len(owner), at_once):
                block = np.ascontiguousarray(flat.reshape(-1, width)[k : k + at_once].T)
                np.add.at(sums, owner[k : k + at_once], (self.position_log_probs(block) * (block != PAD)[:, :, None]).sum(axis=0))
            held.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), width * at_once):
                held.append(text[at : at + width * at_once])
                owner += [i] * -(-len(held[-1]) // width)
                if len(owner) >= at_once:
                    flush()
        flush()
        mean = sums / np.maximum([len(t) for t in texts], 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def held_out(doc_id):
    """The fold that training never sees: crc32 of the doc_id's digits, modulo 3, is 1. A null doc_id counts as seen."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, per_label: int, width: int, per_doc: int, most_labels: int = 512) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, symbols [row, time] and truth of the sample.

    ``per_label`` documents of each lang at most, of distinct ones those with the smallest hash, and ``per_doc`` windows of each,
    evenly spread over the text; of more than ``most_labels`` langs the most frequent. One scan counts the labels without
    reading texts, one takes the sample for all labels together, thinned by the label's count; these bounds are all that reaches the driver.
    """
    labelled = docs.where(~held_out(docs["doc_id"]) & docs["lang"].isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).collect()}
    if not counts:
        return [], np.zeros((0, width), np.int16), np.zeros(0, np.int64)
    labels, symbols, truth = sorted(counts), [], []
    bounds = docs.sparkSession.createDataFrame([(n, label, int(min(1.0, 4 * per_label / counts[label]) * (1 << 40))) for n, label in enumerate(labels)], "number long, lang string, bound long")
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    taken = labelled.join(F.broadcast(bounds), "lang").where((key < F.col("bound")) & F.col("text").rlike(r"\p{L}"))
    once = taken.groupBy("number", key.alias("key")).agg(F.first(_slices(width, per_doc)).alias("parts"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy("key"))).where(F.col("rank") <= per_label)
    for row in ranked.orderBy("number", "rank").collect():
        for part in row["parts"]:
            x = np.full(width, PAD, np.int16)
            data = np.frombuffer(part.encode("utf-8", "surrogatepass")[:width], np.uint8)
            x[: len(data)] = data
            symbols.append(x)
            truth.append(row["number"])
    return labels, np.array(symbols, np.int16).reshape(-1, width), np.array(truth, np.int64)


def _slices(width: int, per_doc: int):
    """``per_doc`` pieces of a text at even distances; short texts give fewer."""
    length = F.length("text")
    starts = F.array_distinct(F.array(*[F.floor(F.greatest(length - width, F.lit(0)) * (k / max(1, per_doc - 1))).cast("int") + 1 for k in range(per_doc)]))
    return F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(width)))


def train(docs: DataFrame, per_label: int = 400, width: int = 64, per_doc: int = 4, hidden: int = 10, epochs: int = 12, seed: int = 0) -> BiGRU | None:
    """A network from a bounded sample of the labelled rows outside the held-out fold; None without any."""
    labels, symbols, truth = training_windows(docs.select("doc_id", "text", "lang"), per_label, width, per_doc)
    return BiGRU(labels, hidden, seed).fit(symbols, truth, epochs, seed=seed) if len(truth) else None


def identify(docs: DataFrame, network: BiGRU | None, width: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the text is read for a prediction. A null text, one without a letter, or a missing network
    gives ``und`` with score 0. Windows that cut a character in two are read as they are; very long texts are read some windows at a time. Repeated
    rows get the same answer; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        net = shared.value
        for batch in rows(batches, 32):
            ids, held, texts, lettered = (c.to_pylist() for c in batch.columns)
            known = [i for i, has in enumerate(lettered) if has and net]
            answers = [(UND, 0.0)] * len(texts)
            if known:
                for i, p in zip(known, net.predict([texts[i].encode("utf-8", "surrogatepass") for i in known], width)):
                    best = int(p.argmax())
                    answers[i] = (net.labels[best], min(1.0, float(p[best])))
            for i, h, a in zip(ids, held, answers):
                yield i, h, *a

    lettered = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    return map_rows(docs.select(docs["doc_id"].cast("long"), held_out(docs["doc_id"]), docs["text"].cast("string"), lettered), run, DDL, SCHEMA)


def op4_bidirectional_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score; see ``identify``."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
