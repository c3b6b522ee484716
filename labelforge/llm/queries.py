"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import (
    block_naming, crf_langid, decontaminate, divergence, fm_dedup, license_scan, mixing, pu_quality, simhash, spelling, token_files,
    token_rollup, toxicity,
)
from labelforge.session import scratch_path, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


@register("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by block naming over all documents."""
    return block_naming.exact_groups(spark, table(spark, sf_dir, "documents")).drop("row")


@register("op5_simhash_dedup")
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 3-word shingles, at most 3 differing bits."""
    found = simhash.near_groups(spark, table(spark, sf_dir, "documents"), simhash.SHINGLE_WORDS, simhash.MAX_BITS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op9_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY t) AS o FROM win) WHERE o < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i GROUP BY k.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) c ON c.doc_id = d.doc_id
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 13 words or more, removed from all documents but the first."""
    return fm_dedup.removed_words(spark, table(spark, sf_dir, "documents"), fm_dedup.MIN_WORDS).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by positive-unlabelled learning."""
    return pu_quality.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a weighted lexicon."""
    return toxicity.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a conditional random field over its words."""
    return (crf_langid.identify(spark, table(spark, sf_dir, "documents"))
            .select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans")))

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
_SHINGLE = "unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS t, unnest(range(0, len(w) - 4)) AS p"
_LICENSES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())


@register("op2_license_scan", f"""
WITH lic(license, text) AS (VALUES {_LICENSES}),
ls AS (SELECT DISTINCT license, t FROM (SELECT license, {_SHINGLE} FROM (SELECT license, {_TOKENS} AS w FROM lic))),
ln AS (SELECT license, count(*) AS n, 2 * cast(pow(2, ceil(log2(count(*)))) AS int) AS size FROM ls GROUP BY 1),
ds AS (SELECT doc_id, {_SHINGLE} FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE len(w) >= 5),
hit AS (SELECT doc_id, license, n, size, p, t FROM ds JOIN ls USING (t) JOIN ln USING (license)),
win AS (SELECT doc_id, license, n, p // (size // 2) - d AS b, t FROM hit, (VALUES (0), (1)) q(d) WHERE p // (size // 2) - d >= 0),
con AS (SELECT doc_id, license, count(DISTINCT t) / n AS containment FROM win GROUP BY doc_id, license, n, b)
SELECT doc_id, license, max(containment) AS containment FROM con WHERE containment >= 0.8 GROUP BY 1, 2
""")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in all documents."""
    return license_scan.scan(spark, table(spark, sf_dir, "documents")).select("doc_id", "license", "containment")


@register("op7_benchmark_decontamination", f"""
WITH it AS (SELECT item_id, len(w) - 4 AS m, {_SHINGLE} FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) >= 5),
q AS (SELECT item_id, m, t, count(*) AS q FROM it GROUP BY ALL),
ds AS (SELECT doc_id, len(w) - 4 AS n, {_SHINGLE} FROM (SELECT doc_id, {_TOKENS} AS w FROM documents) WHERE len(w) >= 5),
hit AS (SELECT doc_id, n, p, item_id, m, t, q FROM ds JOIN q USING (t)),
win AS (SELECT doc_id, item_id, n, m, t, q, unnest(range(greatest(0, p - m + 1), least(p, greatest(0, n - m)) + 1)) AS s FROM hit),
com AS (SELECT doc_id, item_id, n, m, s, sum(least(k, q)) AS c FROM (SELECT doc_id, item_id, n, m, s, t, q, count(*) AS k FROM win GROUP BY ALL) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, s, c / (least(n, m) + m - c) AS similarity FROM com)
SELECT doc_id, item_id, similarity, s AS first_word FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
""")
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items repeated in any document."""
    return decontaminate.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@register("op6_token_rollup")
def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version, kept by deltas.

    All documents are inserted under two versions (a replay changes nothing).  Where
    collapsing white space changes a text of an id, the id's counts are revised.
    The ledger is compacted, and all copies of a collapsed text but the one with the
    largest id are deleted."""
    docs = table(spark, sf_dir, "documents")
    store = token_rollup.Rollup(spark, scratch_path(spark, "token-rollup"))
    versions = {"byte_bpe_50k": token_rollup.TOKENIZER, "byte_bpe_multi_50k": token_rollup.MULTILINGUAL}

    def counts(df: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, (token_rollup.token_counts(spark, df, *v) for v in versions.items()))

    store.insert("load", counts(docs))
    store.insert("load", counts(docs))
    collapsed = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    texts = docs.select("doc_id", "source", "lang", collapsed.alias("text"))
    changed = docs.where(collapsed != F.coalesce("text", F.lit(""))).select("doc_id").distinct()
    store.revise("collapse", counts(texts.join(changed, "doc_id", "left_semi")))
    store.compact("compact")
    same = texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    last = same.groupBy("h").agg(F.max("doc_id").alias("doc_id"))
    store.delete("copies", same.select("doc_id").join(last.select("doc_id"), "doc_id", "left_anti"))
    return store.totals()


@register("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probabilities of all documents, raked to tempered marginals."""
    return mixing.mix(spark, table(spark, sf_dir, "documents")).drop("row")


@register("op11_token_files")
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in Huffman-coded files, read back from the files."""
    import public_tokenizers

    folder, files = token_files.write_corpus(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, folder, files)


@register("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(c.c) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
        FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN kinds k ON k.lang = g.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS p
      FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)) AS q
      FROM p JOIN (SELECT lang, any_value(v) AS v, sum(n) AS n FROM grp GROUP BY 1) USING (lang) GROUP BY 1, 2),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) m
         ON m.lang = a.lang AND m.s = a.source AND m.t = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language over its frequent terms."""
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


@register("op13_spelling_variants", r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
                       FROM (SELECT unnest(range(256)) AS i)),
run AS (SELECT doc_id, x, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS x
        FROM documents) WHERE length(x) >= 7 GROUP BY ALL),
code AS (SELECT x, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || x)) AS h FROM run),
hashed AS (SELECT x, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM code, crc),
seen AS (SELECT CASE WHEN h % 31 = 0 THEN left(x, (h % length(x))::INT) || substr(x, (h % length(x))::INT + 2) ELSE x END AS word, k FROM hashed),
voc AS (SELECT word, sum(k)::BIGINT AS n FROM seen WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM voc)),
pairs AS (SELECT DISTINCT * FROM (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION ALL SELECT c.word, c.n, v.word, v.n FROM cut c JOIN voc v ON c.v = v.word
  UNION ALL SELECT v.word, v.n, c.word, c.n FROM cut c JOIN voc v ON c.v = v.word)),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY 1),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
         FROM voc v LEFT JOIN near USING (word)),
walk(word, last, step) AS (SELECT word, word, 0 FROM form UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN form f ON f.word = w.last WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM form JOIN (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY 1) USING (word)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(spark, spelling.observed_words(table(spark, sf_dir, "documents")))
