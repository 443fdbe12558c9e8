"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed words, bytes, pairs of byte classes, word and line lengths and
repetition, each group as square roots of shares.  A singular value decomposition of a
bounded sample of labelled documents gives DIMENSIONS latent directions.  The decomposition is made in a worker, and the sample's
unit vectors and labels are broadcast (SAMPLE * DIMENSIONS floats, whatever the corpus),
every document's exact cosine with all of them is a blocked product, and the NEIGHBOURS
nearest vote with their label, weighted by similarity.

Empty and null texts have the zero vector: the score is then the share of label 1 in
the sample.  Without labelled rows every score is 0.5.  Repeated label rows of a
document count with their mean.  Each row is scored on its own, so repeated rows and rows with a
null doc_id get a score too; of equal cosines at the last neighbour any may vote.  An empty table gives no rows.
Other columns are not read, and `keep_good` passes them through.
"""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.llm import bytesops as B
from chronolake.llm import runtime

#: Labelled rows that the model is fitted on at most, those with the least hash of their id.
SAMPLE = 6000
DIMENSIONS = 64
NEIGHBOURS = 21
#: A neighbour's weight is exp(SHARPNESS * (cosine - 1)) times the cosine.
SHARPNESS = 12.0
WORDS = 512
LENGTHS = 24
CLASSES = 18


def _classes():
    out = np.full(256, 17, np.int64)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".,;:", "!?", "#", "*", "&", "$%", "|", "<>=/", "@_\\~^`+", "'\"()[]{}-")):
        out[[ord(c) for c in chars]] = k
    out[0xC0:] = 15
    out[0x80:0xC0] = 16
    return out


CLASS = _classes()
GROUPS = (256, CLASSES * CLASSES, WORDS, LENGTHS, LENGTHS, 8)
TERMS = sum(GROUPS)
GROUP_WEIGHT = (1.0, 1.5, 0.5, 1.0, 0.7, 1.5)


def terms(data, bounds):
    """Documents by TERMS, square roots of shares in each group."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    count = lambda d, x, width, w=None: np.bincount(d * width + x, w, n * width).reshape(n, width).astype(np.float64)
    kind = CLASS[data]
    inner = doc[1:] == doc[:-1]
    groups = [count(doc, data.astype(np.int64), 256), count(doc[1:][inner], (kind[:-1] * CLASSES + kind[1:])[inner], CLASSES * CLASSES)]
    start, end, owner = B.word_spans(data, bounds, B.BLANKS)
    roll = B.roller(31, fold_case=True)
    word = roll.ranges(roll.prefix(data), start, end)
    groups.append(count(owner, (word % np.uint64(WORDS)).astype(np.int64), WORDS))
    groups.append(count(owner, np.minimum(end - start, LENGTHS) - 1, LENGTHS))
    line_start, line_end, line_doc = B.word_spans(data, bounds, B.byte_set((10, 10)))
    groups.append(count(line_doc, np.minimum(np.log2(line_end - line_start + 1) * 2, LENGTHS - 1).astype(np.int64), LENGTHS))
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((word, owner))
    new = ~B.same_as_previous(owner[order], word[order])
    repeated = np.bincount(owner, again, n) / words
    distinct = np.bincount(owner[order], new, n) / words
    size = np.log2(words) / 16
    upper = (kind == 1) if len(kind) else kind
    caps = np.bincount(doc, upper, n) / np.maximum(np.diff(bounds), 1)
    odd = np.bincount(doc, (kind >= 6) & (kind <= 13), n) / words
    groups.append(np.column_stack([repeated, 1 - repeated, distinct, 1 - distinct, size, caps, np.minimum(odd, 1), np.minimum(odd / 4, 1)]))
    out = []
    for g, w in zip(groups, GROUP_WEIGHT, strict=True):
        share = g / np.maximum(g.sum(1, keepdims=True), 1) if g.shape[1] > 8 else g
        out.append(w * np.sqrt(np.maximum(share, 0)))
    made = np.hstack(out).astype(np.float32)
    made[np.diff(bounds) == 0] = 0
    return made


def _unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Latent axes, the labelled documents' unit vectors on them and their labels: at most SAMPLE * DIMENSIONS + TERMS * DIMENSIONS floats."""

    def __init__(self, vectors, labels):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.mean = vectors.mean(0, dtype=np.float64).astype(np.float32) if len(vectors) else np.zeros(TERMS, np.float32)
        spread = np.maximum(vectors.std(0), 0.02) if len(vectors) else np.ones(TERMS, np.float32)
        self.scale = (1 / np.sqrt(spread)).astype(np.float32)
        gram = np.zeros((TERMS, TERMS))
        for i in range(0, len(vectors), 512):  # blocks, so that no copy of the sample is made
            part = ((vectors[i : i + 512] - self.mean) * self.scale).astype(np.float64)
            gram += part.T @ part
        _, axes = np.linalg.eigh(gram)
        self.axes = axes[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        self.vectors = self.latent(vectors)
        self.labels = labels.astype(np.float32)

    def latent(self, made):
        """Unit vectors on the latent axes."""
        return _unit((made - self.mean) * self.scale @ self.axes).astype(np.float32)

    def score(self, made):
        empty = ~made.any(1)
        out = np.full(len(made), self.prior)
        if not len(self.labels):
            return out
        x = self.latent(made)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x), 256):  # a block of products is 256 * SAMPLE floats
            near = x[i : i + 256] @ self.vectors.T
            at = np.argpartition(near, -k, axis=1)[:, -k:]
            cosine = np.take_along_axis(near, at, 1)
            weight = np.maximum(cosine, 0) * np.exp(SHARPNESS * (cosine - 1)) + 1e-12
            out[i : i + 256] = (weight * self.labels[at]).sum(1) / weight.sum(1)
        out[empty] = self.prior
        return np.clip(out, 0, 1)


def _vectors(batches):
    for batch in batches:
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
        for i, j, data, bounds in B.chunks(batch):
            made = terms(data, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(label[i:j], pa.float64()), pa.array([x.tobytes() for x in made], pa.binary())], ["label", "vector"])


def sample_of(labels, label_col, id_col, most):
    """The labelled ids with the least hashes, at most `most`, with the mean of their labels."""
    rows = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("label")).where("_id IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy("_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(most)


def _fit(batches):
    """One worker's task: the sample is bounded, and only the model goes to the driver."""
    labels, vectors = [], []
    for batch in batches:
        labels.append(batch.column(0).to_numpy(zero_copy_only=False))
        vectors += [np.frombuffer(x.as_py(), np.float32) for x in batch.column(1)]
    # In an order of their own, so that the model does not hang on the order of arrival.
    made, label = np.array(vectors, np.float32).reshape(-1, TERMS), np.concatenate([np.zeros(0), *labels])
    order = np.lexsort((label, *made[:, :: max(TERMS // 16, 1)].T)) if len(made) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(made[order], label[order]))], pa.binary())], ["model"])


def fit(df, labels, label_col="quality", id_col="doc_id", text_col="text", sample=SAMPLE):
    """Model from the labelled rows of df, a bounded sample of them."""
    runtime.ready(df.sparkSession)
    chosen = F.broadcast(sample_of(labels, label_col, id_col, sample))  # at most `sample` rows
    rows = runtime.text_frame(df, id_col, text_col).join(chosen, F.col("doc_id") == F.col("_id")).select("label", "text").mapInArrow(_vectors, "label double, vector binary")
    made = rows.repartition(1).mapInArrow(_fit, "model binary").first()
    return pickle.loads(bytes(made.model)) if made else Model(np.zeros((0, TERMS), np.float32), np.zeros(0))


def _score(held):
    def run(batches):
        model = held.value
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in B.chunks(batch):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(model.score(terms(data, bounds)), pa.float64())], ["doc_id", "score"])

    return run


def score(df, model, id_col="doc_id", text_col="text"):
    """doc_id, score of every row."""
    spark = runtime.ready(df.sparkSession)
    held = spark.sparkContext.broadcast(model)
    return runtime.text_frame(df, id_col, text_col).mapInArrow(_score(held), "doc_id long, score double")


def _keep(held, text_col, least):
    def run(batches):
        model = held.value
        for batch in batches:
            mask = [model.score(terms(data, bounds)) >= least for _, _, data, bounds in B.chunks(batch, text_col)]
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))

    return run


def keep_good(df, model, least=0.3, text_col="text"):
    """The rows of df whose score is at least `least`, all columns, without a shuffle."""
    spark = runtime.ready(df.sparkSession)
    held = spark.sparkContext.broadcast(model)
    return df.mapInArrow(_keep(held, text_col, least), df.schema)
