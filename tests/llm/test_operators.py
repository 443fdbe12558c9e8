import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.llm import bytesops, decontam, exact_dedup, langid, near_dedup, packing, pretokens, quality, queries, recompression, repeats, runtime, suffix_dedup, token_counts, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The corpus with extra columns whose names the operators use inside."""
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id AS name", "text AS bucket", "1 AS n", "'x' AS spans", "2 AS row", "3 AS keep_id", "4 AS component", "5 AS edits").repartition(5)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def unique(rows):
    """Rows whose id stands once: what rows that share an id share is another matter."""
    ids = [i for i, _ in rows]
    return [r for r in rows if ids.count(r[0]) == 1]


def by_id(found):
    return sorted((tuple(r) for r in found), key=lambda r: (r[0] is None, str(r)))


def awkward(rows):
    """Rows with ids that stand twice, over equal and other texts, and null ids."""
    return [*rows, (rows[3][0], rows[9][1]), (None, rows[4][1]), (None, rows[4][1]), (None, "x " + rows[9][1])]


def brute_suffix(rows, span):
    """brute.suffix with every row a document of its own."""
    return [(rows[k][0], *r) for k, *r in brute.suffix([(k, t) for k, (_, t) in enumerate(rows)], span)]


def brute_recompression(rows, span):
    """brute.recompression, where rows with a null id keep all."""
    alone = [brute.recompression([(0, t)], span + len(t or ""))[0] for i, t in rows if i is None]
    return [*brute.recompression([r for r in rows if r[0] is not None], span), *((None, *x[1:]) for x in alone)]


@pytest.mark.parametrize(("span", "widths"), [(200, (32, 4, 1)), (60, (16, 1))])
def test_suffix_dedup(spark, rows, span, widths):
    rows = awkward(rows)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id AS key", "text AS bucket", "1 AS n", "'x' AS spans").repartition(3)
    assert by_id(suffix_dedup.dedup(df, span=span, widths=widths).collect()) == by_id(brute_suffix(rows, span))


@pytest.mark.parametrize(("span", "widths"), [(50, (8, 2, 1)), (12, (4, 1))])
def test_recompression(spark, rows, span, widths):
    rows = awkward(rows)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "doc_id AS key", "text AS bucket", "1 AS n", "'x' AS spans").repartition(3)
    assert by_id(recompression.dedup(df, span=span, widths=widths).collect()) == by_id(brute_recompression(rows, span))


def test_rows_that_share_an_id_lose_nothing_of_each_other(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b = text(100), text(100)
    rows = [(1, a), (1, b), (2, a)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([(1, len(a), len(a)), (1, len(b), 0), (2, len(a), len(a))])
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in recompression.dedup(spark.createDataFrame([(1, a), (2, b), (2, a)], DOCS)).collect())
    assert got == [(1, 100, 0), (2, 100, 0), (2, 100, 100)]


def test_parts_of_long_documents_give_the_same_windows():
    rng = random.Random(14)
    words = [f"w{rng.randrange(30)}" for _ in range(3000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    whole = np.array([0, len(data)])
    for module, span, parts in ((suffix_dedup, 40, suffix_dedup._parts(40)), (recompression, 20, recompression._parts(20, 400))):
        size = repeats.PART
        repeats.PART = 1000
        try:
            cut = [(before, part) for before, part in parts(data)]
        finally:
            repeats.PART = size
        find = (lambda d, b: suffix_dedup.find_runs(d, b, 40, 12)) if module is suffix_dedup else (lambda d, b: recompression.find_runs(d, b, 20))
        windows = lambda found, before: {(p + before, lead - (p - pos), bucket) for _, pos, count, lead, bucket, *_ in zip(*found, strict=True) for p in range(pos, pos + count)}
        assert len(cut) > 3 and set().union(*(windows(find(part, np.array([0, len(part)])), before) for before, part in cut)) == windows(find(data, whole), 0)


def test_recompression_names_are_the_same_in_all_copies():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 40, 120).astype(np.uint64)
    made = []
    for seed in (1, 2):
        around = np.random.default_rng(seed).integers(0, 40, 60).astype(np.uint64)
        word = np.concatenate([around[:30], passage, around[30:]])
        name, start, stop, low, high = recompression.rounds(bytesops.mix(word), np.zeros(len(word), np.int64))
        inside = (low >= 30) & (high <= 150)
        made.append(set(zip(name[inside].tolist(), start[inside].tolist(), stop[inside].tolist(), strict=True)))
    assert made[0] == made[1] and len(made[0]) > 20


def test_equal_windows_have_equal_buckets_wherever_a_chunk_ends():
    rng = random.Random(8)
    tail = [f"w{rng.randrange(9)}" for _ in range(90)]
    texts = [" ".join([f"x{rng.randrange(50)}" for _ in range(rng.randrange(9))] + tail) for _ in range(6)]
    for find, cut, span in ((lambda d, b: recompression.find_runs(d, b, 20), str.split, 20), (lambda d, b: suffix_dedup.find_runs(d, b, 40, 12), list, 40)):
        seen = {}
        for size in (1, 10_000):  # each text alone, and all in one chunk
            for i, j, data, bounds in bytesops.chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts)}), max_bytes=size):
                for doc, pos, count, _, bucket, *_ in zip(*find(data, bounds), strict=True):
                    units = cut(texts[i + doc])
                    for p in range(pos, pos + count):
                        assert seen.setdefault(tuple(units[p : p + span]), bucket) == bucket


def test_exact_groups(docs, rows):
    assert collected(exact_dedup.exact_groups(docs, block=16)) == brute.exact(rows)


def test_block_names_do_not_trust_fingerprints(spark):
    rows = [(0, "ab" * 40), (1, "ab" * 40), (2, "ab" * 39 + "ac"), (3, ""), (4, ""), (5, "ab" * 4)]
    got = {r.row: (r.identity, r.n_blocks) for r in exact_dedup.block_names(spark.createDataFrame(rows, "row long, body string"), 8).collect()}
    assert got[0] == got[1] and got[3] == got[4] and len({got[k] for k in (0, 2, 3, 5)}) == 4


def test_drop_exact_keeps_one_row_a_text(docs, rows):
    kept = exact_dedup.drop_exact(docs).collect()
    assert sorted(brute.fold(r.text) for r in kept) == sorted({brute.fold(t) for _, t in rows})
    assert {(r.doc_id, brute.fold(r.text)) for r in kept} == {(i, t) for t, i in {brute.fold(t): max(j for j, u in rows if brute.fold(u) == brute.fold(t)) for _, t in rows}.items()}


def test_near_groups(docs, rows):
    assert collected(near_dedup.near_groups(docs)) == brute.near(rows)


def test_near_groups_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    assert collected(near_dedup.near_groups(spark.createDataFrame(rows, DOCS))) == brute.near(rows)


def test_blocks_alone_find_all_links(spark, rows, monkeypatch):
    """Without the stars' links, every bucket is left to the blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, sets, threshold: pairs.where("false"))
    assert collected(near_dedup.near_groups(spark.createDataFrame(rows, DOCS))) == brute.near(rows)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(7)
    for share in (0.2, 0.75):
        common = rng.integers(0, 1 << 62, int(200 * share)).astype(np.uint64)
        sets = [np.concatenate([common, rng.integers(0, 1 << 62, 200 - len(common)).astype(np.uint64)]) for _ in range(2)]
        doc = np.repeat([0, 1], 200)
        sig = near_dedup.superminhash(doc, np.concatenate(sets), 2, 512)
        true = len(common) / (400 - len(common))
        assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - true) < 0.08
    small = near_dedup.superminhash(np.zeros(1, np.int64), np.array([5], np.uint64), 1, 64)
    assert sorted(np.floor(small[0]).tolist()) == list(range(64))  # one element fills the slots by its permutation


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert got == want


def test_decontamination(spark, docs, rows):
    rng = random.Random(1)
    texts = [t for _, t in rows if t and len(t) > 300]
    bench = [(1, rng.choice(texts)[40:160]), (2, rng.choice(texts)[:200]), (2, "a b"), (3, "W1"), (4, None), (5, "..."), (6, "not in any document at all"), (7, "THE of")]
    plain = unique(rows)
    for limit in (100_000, 0):
        found = decontam.decontaminate(spark.createDataFrame(plain, DOCS), spark.createDataFrame(bench, "item_id long, text string"), broadcast_shingles=limit)
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in found.collect())
        assert got == brute.decontaminated(plain, bench)


def test_decontamination_of_repeated_rows_and_null_ids(spark, rows):
    rng = random.Random(1)
    texts = [t for _, t in rows if t and len(t) > 300]
    bench = [(1, rng.choice(texts)[40:160]), (2, rows[4][1][:200]), (3, rows[7][1][:150]), (6, "not in any document at all"), (7, "THE of"), (8, "one two three four")]
    once = [*rows[:-1], rows[9], rows[9], (None, rows[4][1]), (None, rows[4][1]), (None, "all clean"), (None, "say the of")]
    by_id = lambda got: sorted(got, key=lambda r: (r[0] is None, str(r)))
    for limit in (100_000, 0):
        check = lambda docs: decontam.decontaminate(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, "item_id long, text string"), broadcast_shingles=limit).collect()  # noqa: B023, E731
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in check(once)]
        want = brute_decontaminated(once, bench)
        assert by_id(got) == by_id(want) and sum(r[-1] for r in want if r[0] is None) == 3 and any(r[0] == rows[4][0] and r[-1] for r in want)
        # Two texts under one id: no window runs over both, and a hit of one is a hit of the id.
        got = check([(1, "one two x x"), (1, "y y three four"), (2, "one two three four"), (2, "other")])
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 4, 0, False), (1, 4, 0, False), (2, 1, 4, True), (2, 4, 4, True)]
        got = check(rows)
        assert {r.doc_id for r in got if r.contaminated} == {r[0] for r in brute.decontaminated(rows, bench) if r[-1]} and len(got) == len(rows)


def brute_decontaminated(rows, bench):
    """brute.decontaminated, which sorts by ids, of rows with null ids."""
    found = brute.decontaminated([(k, t) for k, (_, t) in enumerate(rows)], bench)
    return [(rows[r[0]][0], *r[1:]) for r in found]


def path():
    return queries.tokenizer_path()


def odd_texts():
    rng = random.Random(1)
    alphabet = "ab s'tlrevmd  \n\t 　é1２!'’<|endoftext|>\x1c\x85🙂中"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["", "it's 'll we'll ' s 's", "a\n\n b", "  ", "\n \n"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path())
    made.encode_special_tokens = True
    return [x.ids for x in made.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pretokens_give_the_tokenizers_ids():
    texts = odd_texts()
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = []
    for i, j, data, bounds in bytesops.chunks(batch, max_bytes=999):
        _, doc, at, size, ids = pretokens.encode(data, bounds, path())
        flat = pretokens.flat_ids(at, size, ids)
        stop = np.cumsum(np.bincount(doc, weights=size, minlength=j - i).astype(int))
        got += [x.tolist() for x in np.split(flat, stop[:-1])]
    assert got == reference_ids(texts)


def test_packing(spark, rows):
    rows = [*rows, (9000, " ".join(f"long{i}" for i in range(3000)))]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), path(), with_ids=True, capacity=64).collect()
    ids = dict(zip(range(len(rows)), [[*x, 0] for x in reference_ids([t for _, t in rows])], strict=True))
    want = sorted((rows[k][0], x) for k, x in ids.items())
    pieces = {}
    for r in got:
        assert r.length == len(r.ids) <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    rebuilt = []
    for doc, own in pieces.items():
        same = [i for i, _ in rows].count(doc)
        if same == 1:
            whole = [x for _, start, part in sorted(own) for x in part]
            assert [p for p, *_ in sorted(own)] == list(range(len(own))) and all(len(part) == 64 for p, _, part in own if p)
            rebuilt.append((doc, whole))
    assert sorted(rebuilt) == [(i, x) for i, x in want if [j for j, _ in rows].count(i) == 1]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.2 * sum(r.length for r in got) / 64 + 3


def test_packer_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert p.place(5) == (2, 0) and p.place(8) == (3, 0)  # bins 0 (4 free) and 2 (5 free) are open; the fullest, 0, closes
    assert p.place(4) == (2, 5) and p.place(2) == (3, 8)


def apply(text, edits):
    raw = text.encode()
    for start, stop, new in edits:
        a = min(max(start, 0), len(raw))
        z = min(max(stop, a), len(raw))
        while a and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a -= 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        raw = raw[:a] + (new or "").encode() + raw[z:]
    return raw.decode()


def test_token_counts_after_edits(spark, rows):
    rng = random.Random(9)
    texts = [t for t in odd_texts()[:80]] + [t or "" for _, t in rows[:40]] + ["word " * 500]
    edits, want = [], {}
    for i, t in enumerate(texts):
        own = [(rng.randint(-3, len(t.encode()) + 3), rng.randint(0, len(t.encode()) + 3), rng.choice(["", " ", "'s", "x", "\n\n", None, " two words"])) for _ in range(rng.randint(0, 4))]
        edits += [(i, k, *e) for k, e in enumerate(own)]
        want[i] = apply(t, own)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = token_counts.count_with_edits(df, path(), spark.createDataFrame([*edits, (777, 0, 0, 1, "x")], "doc_id long, seq long, start long, stop long, text string")).collect()
    before, after = reference_ids(texts), reference_ids([want[i] for i in range(len(texts))])
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_after, r.n_bytes_after) for r in got) == [(i, len(before[i]), len(after[i]), len(want[i].encode())) for i in range(len(texts))]
    long = next(r for r in got if r.doc_id == len(texts) - 1)
    assert long.n_reencoded < 60 * max(long.n_edits, 1)


def test_kept_trees_take_later_edits(spark):
    texts = ["it's a day " * 300, "", None, "one two"]
    kinds = "doc_id long, seq long, start long, stop long, text string"
    kept = token_counts.count_with_edits(spark.createDataFrame(list(enumerate(texts)), DOCS), path(), spark.createDataFrame([(0, 0, 5, 9, "xyz")], kinds), with_trees=True)
    later = token_counts.edit(kept, path(), spark.createDataFrame([(0, 0, 1000, 1010, "'s  not"), (1, 0, 0, 0, "new text"), (3, 0, None, None, None), (3, None, 0, 3, "'ll")], kinds)).collect()
    first = apply(texts[0], [(5, 9, "xyz")])
    want = {0: apply(first, [(1000, 1010, "'s  not")]), 1: "new text", 2: "", 3: "'ll two"}
    assert {r.doc_id: (r.text, r.n_tokens_after) for r in later} == {i: (t, len(x)) for (i, t), x in zip(want.items(), reference_ids(want.values()), strict=True)}
    row = next(r for r in later if r.doc_id == 0)
    assert 0 < row.n_bytes_reencoded < 200 < row.n_bytes and sum(row.counts) == row.n_tokens_after and sum(row.lengths) == row.n_bytes_after


def test_token_counts_query_takes_null_texts(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, "a\nb"), (2, ""), (2, "c")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_token_counts(spark, str(tmp_path)).collect()
    assert sorted((r.n_bytes, r.n_bytes_after) for r in got) == [(0, 0), (0, 0), (1, 0), (3, 0)]


def thue_morse(n):
    """Two texts of n bytes that collide under a polynomial hash modulo a power of two, in every odd base."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [256, 1024, 2048])
def test_texts_built_to_collide(spark, n):
    one, other = thue_morse(n)
    words = lambda t: " ".join(t)
    rows = [(1, one), (2, other), (3, one + "cd"), (4, words(one[:300])), (5, words(other[:300]))]
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    assert collected(suffix_dedup.dedup(df)) == brute.suffix(rows, 200)
    assert collected(recompression.dedup(df)) == brute.recompression(rows, 50)
    assert collected(near_dedup.near_groups(df)) == brute.near(rows)
    want = [len(x) for x in reference_ids([t for _, t in rows])]
    assert [r.n_tokens for r in sorted(token_counts.count_with_edits(df, path()).collect())] == want
    packed = packing.pack(df, path(), capacity=4096, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in packed} == {i: [*x, 0] for (i, _), x in zip(rows, reference_ids([t for _, t in rows]), strict=True)}


def test_keys_that_stand_for_two_pretokens(monkeypatch):
    texts = odd_texts()[:200]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    monkeypatch.setattr(pretokens, "keys_of", lambda data, begin, end: (end - begin).astype(np.uint64))
    monkeypatch.setattr(pretokens, "_STATE", {k: v for k, v in pretokens._STATE.items() if k[0] != "cache"})
    for size in (3, 999):
        for i, j, data, bounds in bytesops.chunks(batch, max_bytes=size):
            _, doc, at, many, ids = pretokens.encode(data, bounds, path())
            assert pretokens.flat_ids(at, many, ids).tolist() == [x for own in reference_ids(texts[i:j]) for x in own]


def noisy(rng, good):
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "stone", "river", "cloud"]) for _ in range(60)]
    return " ".join(words) + "." if good else " ".join(w.upper() + rng.choice(["!!", "***", "$$$"]) for w in words)


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, noisy(rng, i % 3 > 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(4, 1), (None, 1), (6, None)], "doc_id long, quality int")
    df = spark.createDataFrame([*rows, (1000, None), (1001, ""), (rows[1][0], rows[1][1])], DOCS)
    model = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i, _ in rows) and got[1000] == got[1001] == pytest.approx(model.prior)
    kept = {r.doc_id for r in quality.keep_good(df, model, 0.3).collect()}
    assert {i for i, _ in rows if i % 3 > 0} <= kept and not kept & {i for i, _ in rows if i % 3 == 0}
    blank = quality.fit(df, labels.where("false"))
    assert {r.score for r in quality.score(df, blank).collect()} == {0.5}


def test_quality_against_a_plain_vote(spark):
    rng = random.Random(21)
    texts = [noisy(rng, k % 3 > 0) + noisy(rng, k % 2 > 0) for k in range(90)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    made = np.concatenate([quality.terms(data, bounds) for _, _, data, bounds in bytesops.chunks(batch)])
    labels = np.array([k % 3 > 0 for k in range(60)], float)
    model = quality.Model(made[:60], labels)
    # The same by other means: singular vectors of the scaled sample, then each cosine on its own.
    scaled = (made - made[:60].mean(0)) / np.sqrt(np.maximum(made[:60].std(0), 0.02))
    _, _, axes = np.linalg.svd(scaled[:60].astype(float), full_matrices=False)
    latent = scaled @ axes[: quality.DIMENSIONS].T
    want = []
    for x in latent[60:]:
        cosine = [float(x @ y) / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-9) for y in latent[:60]]
        near = sorted(range(60), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        weight = [max(cosine[k], 0) * np.exp(quality.SHARPNESS * (cosine[k] - 1)) for k in near]
        want.append(sum(w * labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight))
    assert np.abs(model.score(made[60:]) - want).max() < 0.02


def test_toxicity(spark):
    rng = random.Random(3)
    calm = lambda: [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(40)}" for _ in range(50)]
    rows = []
    for i in range(300):
        words = calm()
        if i % 4 == 0:
            words[rng.randrange(50)] = rng.choice(["grumbo", "Grumbos", "snarf"])
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 240)], "doc_id long, toxic int")
    df = spark.createDataFrame([*rows, (900, None), (901, "")], DOCS)
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i, _ in rows) and got[900] == got[901] < 0.3
    assert {r.score >= 0.3 for r in toxicity.score(df, toxicity.fit(df, labels.where("false"))).collect()} == {False}


def test_grammar():
    machine = toxicity.grammar()
    i, n, r, t, th, o = ((k, 5.0 if k == toxicity.HOSTILE else 0.0) for k in (toxicity.HOSTILE, toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.THREAT, toxicity.OTHER))
    plain = machine.clause([o, i])
    assert machine.clause([t, i]) > plain > machine.clause([n, i]) and machine.clause([r, o, i]) < plain / 4
    assert machine.clause([th, o, t]) > 0 and machine.clause([th, o, o]) == 0 == machine.clause([n, t, o])
    assert machine.clause([n, th, t]) == 0 and machine.clause([n, o, o, o, i]) == plain


def test_composed_table_is_the_machines_one_after_another():
    rng = random.Random(17)
    whole = toxicity.grammar()
    for _ in range(400):
        clause = [(k, rng.random() * 6 if k == toxicity.HOSTILE else 0.0) for k in (rng.randrange(6) for _ in range(rng.randint(0, 9)))]
        step = clause
        for machine in toxicity.machines():
            step = machine.run(step)
        got = whole.run(clause)
        assert [s for s, _ in got] == [s for s, _ in step] and np.allclose([w for _, w in got], [w for _, w in step])


def toxic_model(odds):
    """A model that has learnt the given words."""
    words = sorted(odds)
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 20, 180)
    hashes = toxicity.known_words(words)
    order = np.argsort(hashes)
    model.term, model.odds = hashes[order], np.array([odds[words[k]] for k in order])
    return model


def test_toxicity_scores_clauses_against_brute_force():
    odds = {"grumbo": 5.0, "snarf": 4.2}
    model = toxic_model(odds)
    rng = random.Random(23)
    words = ["grumbo", "Snarf", "you", "not", "said", "kill", "blue", "stone", "the"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "; ", ", "]) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    want = []
    for t in texts:
        best = []
        for clause in re.split("[\n!.;?]", t.lower()):
            target = reported = armed = False
            governed, most = 0, 0.0
            for w in re.findall("[a-z']+", clause):
                weight = 0.0
                if w in odds:
                    weight = odds[w] + toxicity.TARGET_GAIN * target
                if w == "you":
                    target = True
                    if armed:
                        armed, weight = False, toxicity.THREAT_WEIGHT
                armed = armed or w == "kill"
                weight *= (toxicity.NEGATED if governed else 1) * (toxicity.REPORTED if reported else 1)
                governed = toxicity.REACH if w == "not" else max(governed - 1, 0)
                reported = reported or w == "said"
                most = max(most, weight)
            if most > 0:
                best.append(most)
        total = max(best, default=0) + toxicity.OTHERS_SHARE * (sum(best) - max(best, default=0))
        want.append(1 / (1 + np.exp(-(np.log(21 / 181) + total))))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    got = np.concatenate([model.score(data, bounds)[0] for _, _, data, bounds in bytesops.chunks(batch)])
    assert np.allclose(got, want)


def test_negation_and_reported_speech_turn_a_document():
    texts = ["what a grumbo", "you are not a grumbo", "she said he was a grumbo", "they will kill you", "they will not kill you", None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    got = np.concatenate([toxic_model({"grumbo": 5.0}).score(data, bounds)[0] for _, _, data, bounds in bytesops.chunks(batch)])
    assert (got >= 0.3).tolist() == [True, False, False, True, False, False, False]


def test_terms_are_learnt_beyond_chance_only():
    _, keep = toxicity.learnt(np.array([5, 12, 60, 60]), np.array([0, 0, 0, 500]), 2000, 18000)
    assert keep.tolist() == [True, True, True, False]
    _, keep = toxicity.learnt(np.full(100_000, 5), np.zeros(100_000), 2000, 18000)
    assert not keep.any()  # as many words of five contexts are met by chance


def test_language_id(spark):
    rng = random.Random(5)
    stock = {"aa": "thing other weather brother with that".split(), "bb": "sicher machen nicht durch licht recht".split(), "ru": "это было очень хорошо там".split()}
    make = lambda k, n: " ".join(rng.choice(stock[k]) for _ in range(n))
    train = spark.createDataFrame([(i, make(k, 40), k) for i, k in enumerate(list(stock) * 40)] + [(500, None, "aa"), (501, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    tests = [(0, make("aa", 30), "aa"), (1, make("bb", 3), "bb"), (2, make("ru", 9), "ru"), (3, make("aa", 40) + " " + make("bb", 30), "aa"), (4, None, "und"), (5, "123 ---", "und"), (6, "", "und"), (7, "×÷", "und")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()}
    assert {i: got[i].lang_pred for i, *_ in tests} == {i: k for i, _, k in tests}
    mixed = got[3]
    assert [s.lang for s in mixed.spans] == ["aa", "bb"] and 0.4 < mixed.score < 0.8
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), langid.fit(train.where("false"))).collect()} == {"und"}


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(6)
    import itertools

    counts = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(size=(15, 3)).astype(np.float32)
    got = langid.viterbi(scores, counts, 0.7)
    at = 0
    for n in counts:
        own = scores[at : at + n]
        worth = lambda p: sum(own[k, c] for k, c in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        if n:
            assert worth(got[at : at + n]) == pytest.approx(max(worth(p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-5)
        at += n


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.dedup(empty).count() == recompression.dedup(empty).count() == exact_dedup.exact_groups(empty).count() == near_dedup.near_groups(empty).count() == 0
    assert decontam.decontaminate(empty, bench).count() == packing.pack(empty, path()).count() == token_counts.count_with_edits(empty, path()).count() == 0
    some = spark.createDataFrame([(1, "a b c"), (None, "a b c")], DOCS)
    assert decontam.decontaminate(some, bench).where("contaminated").count() == 0
    assert near_dedup.near_groups(some).count() == suffix_dedup.dedup(some).count() == exact_dedup.exact_groups(some).count() == 2
    empty_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(empty, quality.fit(empty, empty_labels)).count() == 0


def test_null_ids_beside_long_texts(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    shared, other = text(120), text(90)
    rows = [(1, text(30) + " " + shared), (2, shared + " " + text(20)), (None, text(9) + " " + shared), (None, other), (3, other + " z"), (None, text(80)), (-4, "short"), (None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    last = lambda found: sorted(found, key=lambda r: (r[0] is None, str(r)))
    want = [(rows[k][0], *r) for k, *r in brute.suffix([(k, t) for k, (_, t) in enumerate(rows)], 200)]
    assert last(tuple(r) for r in suffix_dedup.dedup(df).collect()) == last(want) and sum(r[2] > 0 for r in want) == 5
    alone = {t: tuple(brute.recompression([(0, t)], 50)[0][1:]) for i, t in rows if i is None}
    named = brute.recompression([r for r in rows if r[0] is not None], 50)
    assert last(tuple(r) for r in recompression.dedup(df).collect()) == last([*named, *((None, *x) for x in alone.values())])
    ids = reference_ids([t for _, t in rows])
    assert last((r.doc_id, r.n_tokens) for r in token_counts.count_with_edits(df, path()).collect()) == last((i, len(x)) for (i, _), x in zip(rows, ids, strict=True))
    packed = packing.pack(df, path(), capacity=2048).collect()
    assert last((r.doc_id, r.length) for r in packed) == last((i, len(x) + 1) for (i, _), x in zip(rows, ids, strict=True))


def test_drop_near_keeps_null_ids(spark):
    rng = random.Random(12)
    text = lambda: [f"w{rng.randrange(900)}" for _ in range(80)]
    a, b, clean = text(), text(), text()
    rows = [(5, " ".join(a)), (None, " ".join([*a, "x"])), (None, " ".join(b)), (None, " ".join([*b, "y"])), (None, " ".join(clean)), (None, None), (7, "the end")]
    kept = near_dedup.drop_near(spark.createDataFrame(rows, DOCS)).collect()
    texts = [r.text for r in kept]
    assert {(5, rows[0][1]), (None, rows[4][1]), (None, None), rows[6]} <= {tuple(r) for r in kept} and len(kept) == 5
    assert sum(t in texts for t in (rows[2][1], rows[3][1])) == 1


@pytest.mark.parametrize("ids", [[3, 8, None, None], [2**63 - 1, None, 1, None], [None, None, None]])
def test_numbers_of_null_ids_are_no_ids(spark, ids):
    df, nameless = runtime.numbered(spark.createDataFrame([(i, str(k)) for k, i in enumerate(ids)], DOCS).repartition(2), "doc_id", "doc_id")
    got = df.withColumn("nameless", nameless).collect()
    assert len({r.doc_id for r in got}) == len(ids) and {(r.text, r.nameless) for r in got} == {(str(k), i is None) for k, i in enumerate(ids)}
    assert all(r.doc_id == ids[int(r.text)] for r in got if not r.nameless)


def test_native_operators_run_no_python(spark, docs):
    made = [exact_dedup.exact_groups(docs), decontam.decontaminate(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))]
    for df in made:
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shared_folder(spark):
    assert runtime.shared_dir(spark).endswith("/chronolake")
    assert runtime.cut(spark.range(3).select(F.col("id"))).count() == 3
