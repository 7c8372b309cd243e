"""Quality classifier by importance resampling (operator 3).

Two generative models over hashed n-grams, one of target text (labelled good) and one of all raw
text, give each document log p_target - log p_raw for each of its n-grams. Their mean, scaled, is the log
of its importance weight, so long documents are not weighed by their length. Gumbel noise, a fixed
function of doc_id, is added, and the k largest keys are sampled: each draw takes a document with a
probability in proportion to its weight. Buckets are counted over the whole corpus; the two models have a fixed size.

A labelled document is weighed by a model fitted without its fold, as a document without a label is
by one that never saw it.

The n-grams are byte trigrams and trigrams of repetition marks, where a word's mark says whether
it equals the word before it or the one before that; the former sees garbled or shouted text, the
latter text that says one word over and over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows, materialise, rows, table, text_key, without_rows

BUCKETS = 1 << 16
FOLDS = 5  # of the labelled documents; a document is weighed by a model without its own fold
MARKS = 64  # repetition trigrams have buckets of their own at the end
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_COUNTS_DDL, _COUNTS = "bucket int, fold int, raw long, target long", pa.schema([("bucket", pa.int32()), ("fold", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])
_SUMS_DDL = "doc_id long, text_key long, n_grams long, log_ratio double"
_SUMS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_grams", pa.int64()), ("log_ratio", pa.float64())])


def features(text: str | None, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """The bucket of each n-gram of the whole text, a slice at a time; n-grams across a cut belong to the slice that they begin in."""
    data, at, back = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), 0, 0
    while True:
        end = min(len(data), at + size)
        if end < len(data):  # at white space, if there is any within as much again
            end += int(np.argmax(np.append(_SPACE[data[end : end + size]], True)))
        marks, starts = _marks(data[back:end])
        yield np.concatenate([_grams(data[at : end + 2]), marks])
        if end >= len(data):
            return
        at, back = end, back + int(starts[-4] if len(starts) >= 4 else 0)


def _grams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16) if len(x) > 2 else x[:0]


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the repetition trigrams, and where words start."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    if len(starts) < 5:
        return np.zeros(0, np.uint32), starts
    # A word's hash: a sum of mixed bytes, each times its place in the word.
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(data))))
    mixed = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * (2 * place.astype(np.uint64) + np.uint64(3)))
    mixed ^= mixed >> np.uint64(31)
    word = np.add.reduceat(mixed, starts)
    mark = 2 * (word[2:] == word[1:-1]) + (word[2:] == word[:-2])
    return (BUCKETS + mark[:-2] * 16 + mark[1:-1] * 4 + mark[2:]).astype(np.uint32), starts


def target_ids(labels: DataFrame, most: int) -> DataFrame:
    """doc_ids labelled good, ``most`` at most: those with the smallest hash. The bound is what makes their broadcast safe."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_fold(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, text, fold): the fold of a target document, null for others."""
    fold = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    marked = docs.select("doc_id", "text").join(F.broadcast(targets.select("doc_id", fold)), "doc_id", "left")
    return marked.select(marked["doc_id"].cast("long"), marked["text"].cast("string"), "fold", text_key(marked["text"]))


def count_buckets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(bucket, fold, raw, target) over all documents; raw stands at fold 0. Each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        raw, target = np.zeros(BUCKETS + MARKS, np.int64), np.zeros((FOLDS, BUCKETS + MARKS), np.int64)
        for batch in rows(batches):
            for text, fold in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for part in features(text):
                    found = np.bincount(part, minlength=BUCKETS + MARKS)
                    raw += found
                    if fold is not None:
                        target[fold] += found
        for fold in range(FOLDS):
            for k in np.flatnonzero(target[fold] + (raw if fold == 0 else 0)).tolist():
                yield k, fold, int(raw[k]) if fold == 0 else 0, int(target[fold, k])

    counts = map_rows(with_fold(docs, targets), run, _COUNTS_DDL, _COUNTS)
    return counts.groupBy("bucket", "fold").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def model(counts: DataFrame, prior: float = 5.0) -> np.ndarray:
    """[fold, bucket]: log p_target - log p_raw without the targets of each fold; the last row is of all targets.

    The counts have FOLDS * (BUCKETS + MARKS) rows at most, whatever the corpus.
    """
    raw, target = np.zeros(BUCKETS + MARKS), np.zeros((FOLDS, BUCKETS + MARKS))
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["fold"], r["bucket"]] = r["target"]
    out = np.zeros((FOLDS + 1, BUCKETS + MARKS))
    for fold in range(FOLDS + 1):
        fit = target.sum(axis=0) - (target[fold] if fold < FOLDS else 0)
        for part in (slice(0, BUCKETS), slice(BUCKETS, None)):  # the two kinds of n-grams are models of their own
            # How many the targets would have if they were as the corpus. Each ratio is drawn to one by ``prior``
            # n-grams, so an n-gram that no target has weighs as much as it was to be expected, and a rare one little.
            expected = raw[part] / max(1.0, raw[part].sum()) * fit[part].sum()
            out[fold, part] = np.log((fit[part] + prior) / (expected + prior))
    return out


def log_ratios(docs: DataFrame, targets: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, text_key, n_grams, log_ratio): the sum of the log ratios of the n-grams of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows(batches):
            for doc_id, text, fold, key in zip(*(c.to_pylist() for c in batch.columns)):
                n, total, ratio = 0, 0.0, shared.value[FOLDS if fold is None else fold]
                for part in features(text):
                    n, total = n + len(part), total + float(ratio[part].sum())
                yield doc_id, key, n, total

    return map_rows(with_fold(docs, targets), run, _SUMS_DDL, _SUMS)


def log_weight(sharpness: float, allowance: float, neutral: float = 50.0):
    """``sharpness`` times the mean log ratio and ``allowance``; ``neutral`` n-grams of ratio zero keep short texts from extremes."""
    return F.lit(sharpness) * (F.col("log_ratio") / (F.col("n_grams") + F.lit(neutral)) + F.lit(allowance))


def with_gumbel_key(weights: DataFrame, seed: int = 0, noise: float = 1.0) -> DataFrame:
    """Adds sample_key = log_weight + Gumbel noise, from a hash of doc_id alone: recomputed tasks draw the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return weights.withColumn("sample_key", F.col("log_weight") - F.lit(noise) * F.log(-F.log(u)))


def top_k(keyed: DataFrame, k: int, bins: int = 1024, name: str = "kept") -> DataFrame:
    """Adds ``name``: true for the ``k`` largest sample_key, the smaller doc_id of equals.

    The k-th key is found by histograms of ``bins`` counts, each within the bin of the one before,
    so no task sorts the table and the driver sees ``bins`` counts at a time.
    """
    low, high, n = keyed.agg(F.min("sample_key"), F.max("sample_key"), F.count("sample_key")).first()
    if not n or k >= n:
        return keyed.withColumn(name, F.col("sample_key").isNotNull())
    if k <= 0:
        return keyed.withColumn(name, F.lit(False))
    left = k  # how many of the keys in [low, high] are to be kept; all above are
    for _ in range(8):
        width = (high - low) / bins
        if not width or low + width == low:
            break
        inside = keyed.where(F.col("sample_key").between(low, high))
        place = F.least(F.floor((F.col("sample_key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("b")
        found = {r["b"]: r for r in inside.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min("sample_key").alias("low"), F.max("sample_key").alias("high")).collect()}
        for b in sorted(found, reverse=True):
            if left <= found[b]["n"]:
                low, high, inside_n = found[b]["low"], found[b]["high"], found[b]["n"]
                break
            left -= found[b]["n"]
        if inside_n <= bins or low == high:
            break
    edge = keyed.where(F.col("sample_key").between(low, high)).orderBy(F.desc("sample_key"), F.asc_nulls_last("doc_id")).limit(left)
    last = edge.orderBy("sample_key", F.desc_nulls_first("doc_id")).first()
    tie = F.col("doc_id").isNull() if last["doc_id"] is None else F.lit(False)
    within = (F.col("doc_id") <= F.lit(last["doc_id"])) if last["doc_id"] is not None else F.lit(True)
    at_edge = (F.col("sample_key") == F.lit(last["sample_key"])) & (F.coalesce(within, F.lit(False)) | tie)
    return keyed.withColumn(name, (F.col("sample_key") > F.lit(last["sample_key"])) | at_edge)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most_targets: int = 20_000, seed: int = 0, sharpness: float = 20.0, allowance: float = 0.2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_grams, log_weight, sample_key, kept.

    ``k`` is the size of the sample. By default it is the number of documents that rejection sampling is expected to keep, the sum
    of all weights, each one at most. ``allowance`` is the loss for each n-gram at which a weight is one, ``sharpness`` how fast it falls beyond.
    ``most_targets`` bounds the labelled rows that fit the target model; the raw model counts every document. A null or empty text has no
    n-grams and no evidence against it. Without a label all weights are equal and, by default, nothing is rejected. Repeated
    rows have one key, so they are kept or rejected together; of equal keys the smaller doc_id comes first. Very long texts are read in slices.
    An empty table gives no rows; other columns are ignored.
    """
    targets = target_ids(labels, most_targets)
    ratio = model(count_buckets(docs, targets))
    weighed = log_ratios(docs, targets, ratio).withColumn("log_weight", log_weight(sharpness, allowance)).drop("log_ratio")
    keyed = with_gumbel_key(materialise(weighed), seed)
    if k is None:
        k = round(keyed.agg(F.sum(F.exp(F.least("log_weight", F.lit(0.0))))).first()[0] or 0)
    return top_k(keyed, k)


def draw(judged: DataFrame, share: float = 0.5) -> DataFrame:
    """Adds sampled: of what ``resample`` keeps, the ``share`` of rows with the largest sample_key.

    What is kept is all that the weights don't speak against, so its size follows from the weights. A corpus smaller than that is drawn among
    documents that are all good, where weights differ by less than the noise: heavier ones are taken more often, none surely. Nulls, ties and
    empty tables as in ``resample``.
    """
    return top_k(judged, round(judged.where("kept").count() * share), name="sampled")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the sample leaves out, in the columns of ``docs``.

    Only the names of those rows are joined; texts are not moved while they are few enough to broadcast. Nulls, ties and empty tables as in ``resample``; rows that share a doc_id
    but not a text are judged each for itself. Columns may have any names.
    """
    return without_rows(docs, materialise(resample(docs, labels).where("NOT kept").select("doc_id", "text_key").distinct()))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_grams, log_weight, sample_key, kept, sampled; see ``resample`` and ``draw``."""
    return draw(resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).drop("text_key")
