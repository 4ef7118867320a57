"""One query for each operator, on its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from funclab.llm import decontamination, jaccard_join, katz, language, neighbours, packing, page_text, prefix_trie, simhash, suffix_dedup, token_output, warc, whitening
from funclab.llm.common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.summary(read_table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op3_warc(spark, sf_dir):
    where, files = warc.write_archives(read_table(spark, sf_dir, "pages"))
    rows = warc.read_archives(where, files, with_payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark, sf_dir):
    docs, tests = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, tests).drop("row")


def op5_neighbours(spark, sf_dir):
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op6_page_text(spark, sf_dir):
    return page_text.main_text(read_table(spark, sf_dir, "pages"))


def op7_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(language.held_out(), F.lit(False)))
    model = language.LanguageModel.train(docs.filter(~language.held_out()))
    return model.predict(docs.select("doc_id", "held_out", "text")).drop("text")


def op8_token_output(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    store = token_output.TokenStore.write(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return store.fetch(store.keys()).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_katz(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return katz.score(docs, ~out, out)


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_groups(read_table(spark, sf_dir, "documents")).drop("row")


def op11_simhash(spark, sf_dir):
    return simhash.near_groups(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_neighbours": op5_neighbours,
    "op6_page_text": op6_page_text,
    "op7_language": op7_language,
    "op8_token_output": op8_token_output,
    "op9_katz": op9_katz,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + 12], ' ') AS gram
              FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
        t AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
        h AS (SELECT doc_id, i, n, item FROM t JOIN g USING (n, gram)),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
        l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
    """,
    # Eight turns of 256 after each digit make its CRC-32; the list of turns up to a depth is the node.
    "op13_prefix_trie": r"""
        WITH t AS (SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS own,
                xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [ord(s), 256, 256, 256, 256, 256, 256, 256, 256]))::BIGINT[],
                  lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a // 2, (a % 2) * 3988292384) END, 4294967295::BIGINT), 4294967295) % 4 AS h
              FROM t GROUP BY 1, 2),
        k AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS lent FROM c LEFT JOIN c b ON b.conv_id = c.base),
        r AS (SELECT k.conv_id, p AS depth, turn FROM k JOIN t ON t.conv_id = k.base AND p <= h
              UNION ALL SELECT k.conv_id, p - h + lent, turn FROM k JOIN t ON t.conv_id = k.conv_id AND p > h),
        f AS (SELECT conv_id, depth, list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS node,
                len(regexp_extract_all(turn.text, '[^\x20\x09-\x0D]+')) AS words FROM r
              UNION ALL SELECT conv_id, 0, [], 0 FROM k),
        e AS (SELECT f.*, depth = lent + greatest(own - h, 0) AS ends FROM f JOIN k USING (conv_id)),
        n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
              FROM e GROUP BY 1, 2),
        u AS (SELECT n.depth, n.node, p.conv_id AS parent_conv_id, p.node AS parent FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.node = n.node[1 : n.depth - 1]),
        g AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY 1),
        w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN g USING (node)),
        a AS (SELECT node[1 : up] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
              FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM w) GROUP BY 1)
        SELECT conv_id, w.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
          saved_tokens::BIGINT AS saved_tokens, ends_sha256
        FROM w JOIN u USING (node) JOIN a USING (node)
    """,
}
