"""Toxicity: a weighted finite-state pattern grammar over clauses.

Learning takes a bounded sample of labelled documents and finds hostile terms: words and
word beginnings (stems) that toxic documents hold far more often than others, by more than chance gives
among all terms that were tried, each with its log odds.  A text is cut into clauses; a word becomes a
symbol of one of the classes hostile, threat, target, negation, report or other.  Five small transducers are
tables of (state, symbol) -> (state, symbol, weight); a weight is a factor and a term to add, so that their
composition is a table of the same kind, made once.  In the order of composition:

* target: a hostile term after a word for a person is aimed;
* insult: hostile terms keep their weight, aimed ones gain;
* threat: a threat weighs once a target follows;
* negation: what a negation governs (REACH words) keeps NEGATED of its weight;
* report: what follows a verb of speech in its clause keeps REPORTED of its weight.

A clause scores its best path, a document the sum of its best clause and a small share of the others; the score
is the logistic of that sum and the prior log odds.  A closed-class word is never a hostile term, but for threats.

Null and empty texts have the prior alone.  Without labelled rows every score is the
prior of no evidence.  Repeated label rows count with their mean, rounded up.  Each row is
scored on its own, repeated rows and rows with a null doc_id too.  Other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.llm import bytesops as B
from chronolake.llm import runtime
from chronolake.llm.quality import sample_of

#: Labelled rows that the lexicon is learnt from at most, those with the least hash of their id.
SAMPLE = 20_000
#: Contexts (the words on both sides) of toxic documents that a term must be met in.  Of each document a term's first
#: context counts, and equal contexts count once, so that copies of one document say a thing once.
LEAST_CONTEXTS = 5
#: The chance, over all terms tried, that one of them is learnt although toxic documents hold it no more often.
CHANCE = 0.01
LEAST_ODDS = 4.0
#: Bytes of stems that are considered.
STEMS = (4, 5, 6, 7, 8)
TARGET_GAIN, NEGATED, REPORTED, THREAT_WEIGHT, OTHERS_SHARE = 0.5, 0.0, 0.05, 3.0, 0.25
#: Words that a negation governs.
REACH = 3

#: Closed-class words of the grammar.
TARGETS = "you your yours yourself they them he she him her du dich dir dein ihr euch tu te toi ton vous votre tú usted ustedes vosotros".split()
NEGATIONS = "not no never nor isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say quoted wrote claimed according called sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREATS = "kill hurt destroy punch burn shoot stab beat töten schlagen tuer frapper matar golpear".split()

HOSTILE, THREAT, TARGET, NEGATION, REPORT, OTHER, AIMED = SYMBOLS = range(7)


class Transducer:
    """Tables over (state, symbol): the next state, the symbol that comes out, and its weight as factor * weight + more.  State 0 is the start."""

    def __init__(self, states):
        shape = (states, len(SYMBOLS))
        self.next = np.broadcast_to(np.arange(states)[:, None], shape).copy()
        self.out = np.broadcast_to(np.arange(len(SYMBOLS)), shape).copy()
        self.factor, self.more = np.ones(shape), np.zeros(shape)

    def on(self, state, symbol, to=None, out=None, factor=1.0, more=0.0):
        """Set one entry."""
        self.next[state, symbol] = state if to is None else to
        self.out[state, symbol] = symbol if out is None else out
        self.factor[state, symbol], self.more[state, symbol] = factor, more

    def compose(self, other):
        """This one's output read by `other`, as one table over the pairs of states that can be reached."""
        pairs, rows = {(0, 0): 0}, []
        todo = [(0, 0)]
        for a, b in todo:
            row = []
            for symbol in SYMBOLS:
                middle = self.out[a, symbol]
                to = int(self.next[a, symbol]), int(other.next[b, middle])
                if to not in pairs:
                    pairs[to] = len(pairs)
                    todo.append(to)
                factor = other.factor[b, middle]
                row.append((pairs[to], other.out[b, middle], self.factor[a, symbol] * factor, self.more[a, symbol] * factor + other.more[b, middle]))
            rows.append(row)
        made = Transducer(len(rows))
        for state, row in enumerate(rows):
            for symbol, entry in zip(SYMBOLS, row, strict=True):
                made.on(state, symbol, *entry)
        return made

    def run(self, symbols):
        """What comes out of (symbol, weight) pairs."""
        state, out = 0, []
        for symbol, weight in symbols:
            out.append((int(self.out[state, symbol]), weight * self.factor[state, symbol] + self.more[state, symbol]))
            state = self.next[state, symbol]
        return out

    def clause(self, symbols):
        """Weight of the best hostile symbol that comes out of a clause."""
        return max((w for symbol, w in self.run(symbols) if symbol == HOSTILE), default=0.0)


def target_machine():
    made = Transducer(2)
    made.on(0, TARGET, to=1)
    made.on(1, HOSTILE, out=AIMED)
    return made


def insult_machine():
    made = Transducer(1)
    made.on(0, AIMED, out=HOSTILE, more=TARGET_GAIN)
    return made


def threat_machine():
    made = Transducer(2)
    made.on(0, THREAT, to=1, out=OTHER)
    made.on(1, THREAT, out=OTHER)
    made.on(1, TARGET, to=0, out=HOSTILE, factor=0.0, more=THREAT_WEIGHT)
    return made


def negation_machine():
    """State k: the next k words are governed by a negation."""
    made = Transducer(REACH + 1)
    for left in range(REACH + 1):
        for symbol in SYMBOLS:
            made.on(left, symbol, to=max(left - 1, 0))
        made.on(left, NEGATION, to=REACH)
        if left:
            made.on(left, HOSTILE, to=left - 1, factor=NEGATED)
    return made


def report_machine():
    made = Transducer(2)
    made.on(0, REPORT, to=1)
    made.on(1, HOSTILE, factor=REPORTED)
    return made


def machines():
    return [target_machine(), insult_machine(), threat_machine(), negation_machine(), report_machine()]


def grammar():
    """The five machines as one table."""
    first, *rest = machines()
    for machine in rest:
        first = first.compose(machine)
    return first


MARKS = B.byte_set((0x00, 0x26), (0x28, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
CLAUSE_END = B.byte_set((10, 10), (33, 33), (46, 46), (59, 59), (63, 63))


def word_terms(data, bounds, stems=STEMS):
    """(start, end, document, hashes): hashes has the whole word and then each stem; 0 where the word is too short."""
    start, end, doc = B.word_spans(data, bounds, MARKS)
    roll = B.roller(41, fold_case=True)
    prefix = roll.prefix(data)
    made = [roll.ranges(prefix, start, end) | np.uint64(1)]
    for n in stems:
        stop = np.minimum(start + n, end)
        own = roll.ranges(prefix, start, stop) & ~np.uint64(1)
        own[end - start < n] = 0
        made.append(own)
    return start, end, doc, made


def known_words(words):
    """Hash of each closed-class word."""
    raw = [w.encode() for w in words]
    bounds = np.concatenate([[0], np.cumsum([len(w) + 1 for w in raw])])
    return word_terms(np.frombuffer(b" ".join(raw) + b" ", np.uint8), bounds, ())[3][0]


def _toxic_terms(batches):
    for batch in batches:
        for _, _, data, bounds in B.chunks(batch):
            _, _, doc, made = word_terms(data, bounds)
            if not len(doc):
                continue
            around = np.zeros(len(doc) + 2, np.uint64)
            around[1:-1] = made[0]
            left, right = around[:-2].copy(), around[2:].copy()
            left[np.append(True, doc[1:] != doc[:-1])] = 0
            right[np.append(doc[1:] != doc[:-1], True)] = 0
            context = B.mix(left * np.uint64(3) ^ B.mix(right))
            terms, contexts = [], []
            for h in made:
                some = np.flatnonzero(h)
                order = some[np.lexsort((h[some], doc[some]))]  # stable: the first occurrence in a document leads
                new = order[~B.same_as_previous(doc[order], h[order])]
                terms.append(h[new])
                contexts.append(context[new])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (terms, contexts)], ["term", "context"])


def _clean_terms(held):
    def run(batches):
        wanted = held.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, data, bounds in B.chunks(batch):
                _, _, doc, made = word_terms(data, bounds)
                for h in made:
                    at = np.searchsorted(wanted, h)
                    at[at == len(wanted)] = 0
                    hit = wanted[at] == h
                    pairs = np.unique(doc[hit] * len(wanted) + at[hit]) if hit.any() else np.zeros(0, np.int64)
                    np.add.at(total, pairs % max(len(wanted), 1), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[at].view(np.int64)), pa.array(total[at])], ["term", "n"])

    return run


def learnt(toxic, clean, n_toxic, n_clean):
    """(log odds of terms by the documents that hold them, whether they are high enough and beyond chance).

    Beyond chance: the tail of the binomial, by its exponential bound, times the number of terms is under CHANCE.
    """
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    all_of = np.maximum(toxic + clean, 1)
    share, usual = toxic / all_of, (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    rest = np.maximum(1 - share, 1e-12)
    apart = all_of * (share * np.log(np.maximum(share, 1e-12) / usual) + rest * np.log(rest / (1 - usual)))
    return odds, (odds >= LEAST_ODDS) & (apart > np.log(max(len(odds), 1) / CHANCE))


class Model:
    """Sorted hashes of hostile terms with their log odds, the prior log odds and the composed grammar."""

    def __init__(self, term, toxic, clean, n_toxic, n_clean):
        odds, keep = learnt(toxic, clean, n_toxic, n_clean)
        order = np.flatnonzero(keep)
        order = order[np.argsort(term[order])]
        self.term, self.odds = term[order], odds[order]
        self.prior = float(np.log((n_toxic + 1) / (n_clean + 1))) if n_toxic + n_clean else -2.0
        classes = [(THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)]
        closed = {int(h): k for k, words in classes for h in known_words(words)}
        self.closed = np.array(sorted(closed), np.uint64)
        self.kinds = np.array([closed[int(h)] for h in self.closed])
        self.grammar = grammar()

    def symbols(self, data, bounds):
        start, _, doc, made = word_terms(data, bounds)
        weight = np.zeros(len(start))
        for h in made:
            if len(self.term):
                at = np.searchsorted(self.term, h)
                at[at == len(self.term)] = 0
                weight = np.maximum(weight, np.where(self.term[at] == h, self.odds[at], 0))
        at = np.searchsorted(self.closed, made[0])
        at[at == len(self.closed)] = 0
        kind = np.where(self.closed[at] == made[0], self.kinds[at], OTHER)
        kind = np.where((weight > 0) & ((kind == OTHER) | (kind == THREAT)), HOSTILE, kind)
        weight = np.where(kind == HOSTILE, weight, 0.0)
        ends = np.concatenate([[0], np.cumsum(CLAUSE_END[data])])
        return doc, kind, weight, ends[start] if len(start) else start

    def score(self, data, bounds):
        """(score, clauses that matched) of each document."""
        doc, kind, weight, clause = self.symbols(data, bounds)
        sums = np.zeros(len(bounds) - 1)
        matched = np.zeros(len(bounds) - 1, np.int64)
        spot = (kind == HOSTILE) | (kind == THREAT)
        if spot.any():
            key = doc * (len(data) + 2) + clause
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            stop = np.append(new[1:], len(key))
            best = {}
            for c in np.unique(np.searchsorted(new, np.flatnonzero(spot), side="right") - 1):
                part = slice(new[c], stop[c])
                w = self.grammar.clause(zip(kind[part].tolist(), weight[part].tolist(), strict=True))
                if w > 0:
                    best.setdefault(int(doc[new[c]]), []).append(w)
            for k, own in best.items():
                sums[k] = max(own) + OTHERS_SHARE * (sum(own) - max(own))
                matched[k] = len(own)
        return 1 / (1 + np.exp(-(self.prior + sums))), matched


def fit(df, labels, label_col="toxic", id_col="doc_id", text_col="text", sample=SAMPLE):
    """Model from the labelled rows of df, a bounded sample of them."""
    spark = runtime.ready(df.sparkSession)
    chosen = F.broadcast(sample_of(labels, label_col, id_col, sample))  # at most `sample` rows
    rows = runtime.cut(runtime.text_frame(df, id_col, text_col).join(chosen, F.col("doc_id") == F.col("_id")).select((F.col("label") > 0).alias("toxic"), "text"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    one = rows.where("toxic").select("text").mapInArrow(_toxic_terms, "term long, context long").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_CONTEXTS).toPandas()  # terms of at most `sample` documents
    term = one["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(term)
    term, toxic = term[order], one["n"].to_numpy(np.int64)[order]
    clean = np.zeros(len(term), np.int64)
    if len(term):
        held = spark.sparkContext.broadcast(term)
        other = rows.where("NOT toxic").select("text").mapInArrow(_clean_terms(held), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        clean[np.searchsorted(term, other["term"].to_numpy(np.int64).view(np.uint64))] = other["n"].to_numpy(np.int64)
    return Model(term, toxic, clean, sizes.get(True, 0), sizes.get(False, 0))


def _score(held):
    def run(batches):
        model = held.value
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, bounds in B.chunks(batch):
                score, matched = model.score(data, bounds)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(score, pa.float64()), pa.array(matched, pa.int64())], ["doc_id", "score", "n_clauses"])

    return run


def score(df, model, id_col="doc_id", text_col="text"):
    """doc_id, score, n_clauses (clauses that matched) of every row."""
    spark = runtime.ready(df.sparkSession)
    held = spark.sparkContext.broadcast(model)  # terms of at most `sample` documents
    return runtime.text_frame(df, id_col, text_col).mapInArrow(_score(held), "doc_id long, score double, n_clauses long")
