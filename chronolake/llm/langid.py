"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

Learning takes documents whose language is known, about SAMPLE_PER_LANGUAGE of each
language, chosen by a hash of their id.  It counts byte trigrams, whole
words (both hashed to BUCKETS) and the scripts of words, by language.  A word's score
for a language is the sum of its smoothed log probabilities; a language in which the word's
script is rarer than SCRIPT_SHARE is ruled out, unless that holds for all.  Viterbi
pays SWITCH for each change of language between adjacent words, over the whole text.
A document's language is the one whose spans have most bytes (ties: the first by name);
its score is their share of all word bytes.

Null texts and texts without a letter are `und` with score 0.  Without learnt languages
all documents are `und`.  Each row is labelled on its own, so repeated rows agree.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.llm import bytesops as B
from chronolake.llm import runtime

SAMPLE_PER_LANGUAGE = 500
BUCKETS = 1 << 15
SWITCH = 12.0
SCRIPT_SHARE = 0.01
RULED_OUT = -60.0
#: First UTF-8 bytes of the scripts' ranges, by name; 0 stands for other bytes, among them Latin.
SCRIPTS = {"greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD4), "hebrew": (0xD7, 0xD7), "arabic": (0xD8, 0xDB), "indic": (0xE0, 0xE0), "kana": (0xE3, 0xE3), "han": (0xE4, 0xE9), "hangul": (0xEA, 0xED)}


def _tables():
    letter = ~B.byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
    fold = np.arange(256, dtype=np.uint8)
    fold[0x41:0x5B] += 32
    fold[letter] = 32
    script = np.zeros(256, np.int64)
    for k, (lo, hi) in enumerate(SCRIPTS.values(), 1):
        script[lo : hi + 1] = k
    return letter, fold, script


NOT_LETTER, FOLD, SCRIPT = _tables()


def features(data, bounds):
    """(start, end, document, script of each word; trigram bucket of each byte, word bucket of each word)."""
    start, end, doc = B.word_spans(data, bounds, NOT_LETTER)
    if not len(start):
        return start, end, doc, start, np.zeros(0, np.int64), start
    d = np.full(len(data) + 2, 32, np.uint32)
    d[1:-1] = FOLD[data]
    cuts = bounds[1:-1]
    left, right = d[:-2].copy(), d[2:].copy()
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    left[inner] = 32
    right[inner - 1] = 32
    code = (left << 16) | (d[1:-1] << 8) | right
    tri = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    roll = B.roller(21, fold_case=True)
    word = (roll.ranges(roll.prefix(data), start, end) >> np.uint64(49)).astype(np.int64)
    script = np.maximum.reduceat(SCRIPT[data], np.column_stack([start, end]).ravel()[: 2 * len(start) - (end[-1] == len(data))])[::2]
    return start, end, doc, script, tri, word


def _inside(start, end, n):
    mark = np.zeros(n + 1, np.int8)
    mark[start] = 1
    mark[end] -= 1
    return np.cumsum(mark[:n], dtype=np.int8).astype(bool)


WIDTH = 2 * BUCKETS + len(SCRIPTS) + 1


def _count(batches):
    for batch in batches:
        langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs], np.int64)
        total = np.zeros((len(names), WIDTH), np.int64)
        for i, j, data, bounds in B.chunks(batch):
            start, end, doc, script, tri, word = features(data, bounds)
            own = code[i:j]
            at = np.flatnonzero(_inside(start, end, len(data)))
            by = own[np.searchsorted(bounds, at, side="right") - 1]
            np.add.at(total, (by, tri[at]), 1)
            np.add.at(total, (own[doc], BUCKETS + word), 1)
            np.add.at(total, (own[doc], 2 * BUCKETS + script), 1)
        by, where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in by], pa.string()), pa.array(where, pa.int64()), pa.array(total[by, where], pa.int64())], ["lang", "bucket", "n"])


class Model:
    """Languages, log probabilities (BUCKETS trigrams, BUCKETS words by language) and scripts allowed."""

    def __init__(self, languages, counts):
        self.languages = languages
        tri, word, script = counts[:, :BUCKETS], counts[:, BUCKETS : 2 * BUCKETS], counts[:, 2 * BUCKETS :]
        norm = lambda x: np.log((x + 0.5) / (x.sum(1, keepdims=True) + 0.5 * x.shape[1]))
        self.tri, self.word = (np.ascontiguousarray(norm(x).T.astype(np.float32)) for x in (tri, word))
        allowed = script >= SCRIPT_SHARE * np.maximum(script.sum(1, keepdims=True), 1)
        allowed[:, ~allowed.any(0)] = True
        self.script = np.where(allowed.T, 0, RULED_OUT).astype(np.float32)


def fit(df, id_col="doc_id", text_col="text", lang_col="lang", sample=SAMPLE_PER_LANGUAGE):
    """Model from the rows of df with a text and a language."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, WIDTH)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((len(languages), WIDTH))
    counts[counted["lang"].map(languages.index).to_numpy(np.int64), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return Model(languages, counts)


def word_scores(model, data, bounds):
    start, end, doc, script, tri, word = features(data, bounds)
    if not len(start):
        return start, end, doc, np.zeros((0, len(model.languages)), np.float32)
    sums = np.zeros((len(data) + 1, len(model.languages)))
    np.cumsum(model.tri[tri], axis=0, out=sums[1:], dtype=np.float64)
    return start, end, doc, ((sums[end] - sums[start]).astype(np.float32) + model.word[word] + model.script[script])


def viterbi(scores, counts, switch=SWITCH):
    """Best language of each word; documents are consecutive runs of `counts` words."""
    n, k = scores.shape
    label = np.zeros(n, np.int8 if k < 128 else np.int32)
    if not n or k == 1:
        return label
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    first, size = first[order], counts[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    back = np.empty((n, k), label.dtype)
    own = np.arange(k, dtype=label.dtype)
    m = scores[first[: active[0]]]
    for t in range(1, size[0]):
        a = active[t]
        m = m[:a]
        best = m.argmax(1)
        jump = m[np.arange(a), best] - switch
        stay = m >= jump[:, None]
        at = first[:a] + t
        back[at] = np.where(stay, own, best[:, None])
        m_next = scores[at] + np.where(stay, m, jump[:, None])
        if a < active[t - 1]:
            pass
        if t == 1:
            final = np.zeros((len(size), k), np.float32)
            final[: active[0]] = scores[first[: active[0]]]
        final[:a] = m_next
        m = m_next
    if size[0] <= 1:
        final = np.zeros((len(size), k), np.float32)
        final[: active[0]] = m
    now = final.argmax(1)
    for t in range(size[0] - 1, 0, -1):
        a = active[t]
        at = first[:a] + t
        label[at] = now[:a]
        now[:a] = back[at, now[:a]]
    label[first[: active[0]]] = now[: active[0]]
    return label


def _has_letter(raw):
    return any(map(str.isalpha, raw.decode("utf-8")))


def _identify(held, switch):
    def run(batches):
        model = held.value
        names = model.languages
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in B.chunks(batch, max_bytes=8 << 20):
                parts = []
                for a, b in _slices(bounds, (4 << 20) // max(len(names), 1)):
                    s, e, d, x = word_scores(model, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                    parts.append((s + bounds[a], e + bounds[a], d + a, x))
                start, end, doc, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
                counts = np.bincount(doc, minlength=j - i)
                label = viterbi(scores, counts, switch).astype(np.int64) if names else np.zeros(len(doc), np.int64)
                weight = np.zeros((j - i, max(len(names), 1)))
                np.add.at(weight, (doc, label), end - start)
                total = weight.sum(1)
                best = weight.argmax(1)
                raw = data.tobytes()
                known = [bool(names) and total[k] > 0 and _has_letter(raw[bounds[k] : bounds[k + 1]]) for k in range(j - i)]
                lang = [names[best[k]] if known[k] else "und" for k in range(j - i)]
                score = [float(weight[k, best[k]] / total[k]) if known[k] else 0.0 for k in range(j - i)]
                spans = _spans(start, end, doc, label, bounds, names, known)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(lang), pa.array(score), spans], ["doc_id", "lang_pred", "score", "spans"])

    return run


def _slices(bounds, most):
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(max(int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1, i + 1), n)
        yield i, j
        i = j


def _spans(start, end, doc, label, bounds, names, known):
    """Maximal runs of words of one language as (start byte, stop byte, lang), by document."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    keep = np.array(known, bool)[doc[first]] if len(first) else np.zeros(0, bool)
    first, last = first[keep], last[keep]
    owner = doc[first]
    offsets = np.searchsorted(owner, np.arange(len(bounds)))
    fields = [pa.array(start[first] - bounds[owner], pa.int64()), pa.array(end[last] - bounds[owner], pa.int64()), pa.array([names[k] for k in label[first]], pa.string())]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "stop", "lang"]))


def identify(df, model, id_col="doc_id", text_col="text", switch=SWITCH):
    """doc_id, lang_pred, score, spans (start byte, stop byte, lang) of every row."""
    spark = runtime.ready(df.sparkSession)
    held = spark.sparkContext.broadcast(model)  # languages * 2 * BUCKETS floats
    return runtime.text_frame(df, id_col, text_col).mapInArrow(_identify(held, switch), "doc_id long, lang_pred string, score double, spans array<struct<start: long, stop: long, lang: string>>")
