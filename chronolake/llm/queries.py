"""The registered queries of the training-data operators and their SQL."""

from pyspark.sql import functions as F

from chronolake.llm import decontam, exact_dedup, langid, near_dedup, packing, quality, recompression, suffix_dedup, token_counts, toxicity


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _remainder(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(_remainder(5) != 0))
    made = quality.score(docs, model)
    return made.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_remainder(4) != 2))
    made = toxicity.score(docs, model)
    return made.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_clauses")


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_remainder(4) != 2))
    made = langid.identify(docs, model)
    return made.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_recompression(spark, sf_dir):
    return recompression.dedup(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    """Counts of every document, and after two edits of it: a note put after its first line, then its first 40 bytes cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    half = F.octet_length(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)).cast("long")
    edit = lambda seq, a, b, text: F.struct(F.lit(seq).cast("long").alias("seq"), a.alias("start"), b.alias("stop"), F.lit(text).alias("text"))
    edits = F.array(edit(0, half, half, " (edited note) "), edit(1, F.lit(0).cast("long"), F.lit(40).cast("long"), ""))
    return token_counts.count_with_edits(docs.withColumn("_edits", edits), tokenizer_path(), edits_col="_edits")


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontamination(spark, sf_dir):
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def queries():
    return {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_recompression, op4_exact_dedup, op5_near_dedup, op6_toxicity, op7_token_counts, op8_best_fit_packing, op9_decontamination, op10_language_id)}


FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             g AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
             r AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
             s AS (SELECT g.doc_id, g.i FROM g JOIN r ON r.k = g.k),
             n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s),
             m AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n) GROUP BY doc_id, run),
             t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM m GROUP BY doc_id),
             e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM m
                   UNION ALL SELECT d.doc_id, coalesce(t.last, 0), len(d.h) // 2 FROM d LEFT JOIN t ON t.doc_id = d.doc_id),
             k AS (SELECT e.doc_id, string_agg(substr(d.h, 2 * e.x + 1, 2 * (e.y - e.x)), '' ORDER BY e.x) AS kept FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
        SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(k.kept)) AS kept_sha256
        FROM d JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op3_recompression": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
             m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
             c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 50)) AS p FROM g JOIN m ON g.h = m.h WHERE g.doc_id > m.least),
             n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
             v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
             k AS (SELECT v.doc_id, string_agg(v.word, ' ' ORDER BY v.p) AS kept FROM v LEFT JOIN c ON c.doc_id = v.doc_id AND c.p = v.p WHERE c.p IS NULL GROUP BY v.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {FOLD} AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)""",
    "op5_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
             e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
             r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op9_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n
                    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
             sizes AS (SELECT DISTINCT n FROM bw),
             dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
                    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
             hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
             cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
               sha256(coalesce(it.s, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
