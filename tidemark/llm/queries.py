"""The registered queries of this package: each operator over its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from . import chunking, codec, collisions, decontam, licenses, lm, neardup, pii, quality, search, spelling, tokencount, warc

TOKENIZER = "byte_bpe_50k.json"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.report(found).drop("spans")


def op7_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_near_duplicates(spark, sf_dir):
    return neardup.groups(table(spark, sf_dir, "documents"))


def op10_bpe(spark, sf_dir):
    return codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark, sf_dir):
    return chunking.compare_with_next(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op5_personal_data(spark, sf_dir):
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op6_language_model(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.fields(warc.read(spark, folder))


def op11_ranked_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_nearest_vectors(spark, sf_dir):
    return collisions.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f for f in (
        op1_decontamination, op2_licenses, op3_fingerprints, op4_quality, op5_personal_data, op6_language_model, op7_token_counts, op8_warc, op9_near_duplicates, op10_bpe,
        op11_ranked_search, op12_spelling_variants, op13_nearest_vectors,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        k AS (
            SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
            FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
        ),
        p AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
            FROM d, (SELECT DISTINCT n FROM k) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
        ),
        h AS (SELECT p.doc_id, p.i, p.n, k.item FROM p JOIN k ON p.n = k.n AND p.phrase = k.phrase),
        c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) AS u(j) GROUP BY 1),
        o AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1),
        r AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
                   CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256
            FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
        )
        SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM r
    """,
    "op9_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
            FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        m AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
            FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
        ),
        e AS (
            SELECT x, y FROM m JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y
            WHERE 100 * shared >= 85 * (a.n + b.n - shared)
        ),
        u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node),
        c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM c LEFT JOIN n USING (doc_id)
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
                   min(page_id) OVER (PARTITION BY html) AS head
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
        FROM d
    """,
    "op11_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
        t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY 1, 2),
        c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
        i AS (
            SELECT number, item_id, term, count(*) AS repeats
            FROM (SELECT number, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS number, item_id, {_WORDS} AS w FROM benchmark))
            GROUP BY 1, 2, 3
        ),
        f AS (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM i) GROUP BY 1),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM f, c),
        m AS (SELECT k, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * docs) // total AS m FROM d, c WHERE len(w) > 0),
        s AS (
            SELECT number, item_id, k, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM i JOIN w USING (term) JOIN t USING (term) JOIN m USING (k) GROUP BY 1, 2, 3, 4
        ),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
            FROM s WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE bits AS (
            SELECT i AS byte, i AS v, 0 AS step FROM range(256) AS r(i)
            UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8
        ),
        crc AS (SELECT list(v ORDER BY byte) AS steps FROM bits WHERE step = 8),
        o AS (
            SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, coalesce(CAST(doc_id AS VARCHAR), '') AS id
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents)
        ),
        p AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM o GROUP BY 1, 2),
        q AS (
            SELECT run, n, xor(list_reduce(
                list_prepend(4294967295, [CAST('0x' || h[2 * i - 1:2 * i] AS BIGINT) FOR i IN range(1, len(h) // 2 + 1)]),
                lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])
            ), 4294967295) AS h FROM p, crc
        ),
        c AS (
            SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n) AS n
            FROM q GROUP BY 1
        ),
        v AS (SELECT word, CAST(n AS BIGINT) AS n FROM c WHERE length(word) >= 7 AND n >= 2),
        g AS (
            SELECT word, n, kind, unnest(CASE kind
                WHEN 0 THEN [word] WHEN 1 THEN [word[1:i - 1] || word[i + 1:] FOR i IN range(1, length(word) + 1)]
                ELSE [word[1:i - 1] || '*' || word[i + 1:] FOR i IN range(1, length(word) + 1)] END) AS key
            FROM v, (VALUES (0), (1), (2)) AS t(kind)
        ),
        e AS (
            SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM g AS a JOIN g AS b ON a.key = b.key AND a.word <> b.word
            AND (a.kind + b.kind = 1 OR a.kind = 2 AND b.kind = 2)
        ),
        s AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY 1),
        w AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
                   CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
            FROM v LEFT JOIN s USING (word)
        ),
        j AS (SELECT word, word AS root, form AS next FROM w UNION ALL SELECT j.word, w.word, w.form FROM j JOIN w ON w.word = j.next)
        SELECT word, form, root, n, n_near, form_n FROM w JOIN (SELECT word, root FROM j WHERE next IS NULL) USING (word)
    """,
}
