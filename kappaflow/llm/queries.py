"""The registered queries of this subpackage and their DuckDB statements.

Each ``opN_<name>`` applies one operator to its whole table; the digest
columns of the contracts are derived here from what the operators return.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip, ids_digest
from .chat import format_conversations, read_back
from .collocations import mine_collocations
from .exact_dedup import exact_duplicates
from .lexical import ranked_search
from .licences import LEAST, TEMPLATES, scan_licences, template_weights
from .mixing import mix_sources
from .packing import pack_documents
from .pii import KINDS, find_personal_data, spans_text
from .quality import quality_verdicts, train_field
from .simhash import hex_print, near_classes
from .token_counts import count_tokens
from .urls import example_labels, filter_urls, fit_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: Tokenizer of the packed sequences.
PACK_TOKENIZER = "word_bpe_49k.json"
#: Production mix: the large web source is held to a tenth, the other nineteen share the rest.
SOURCE_WEIGHTS = {"src0": 0.10} | {f"src{i}": 0.90 / 19 for i in range(1, 20)}
OTHER_WEIGHT = 0.01
MIX_SEED = 42
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block",
             "net/fr/": "block"}
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_filter")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_urls(spark.createDataFrame(example_labels(), "url string, label int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_chance")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query("op2_exact_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_chat_format")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    return read_back(format_conversations(rows.union(control)))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_sql() -> str:
    values = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in SOURCE_WEIGHTS.items())
    return f"""
WITH w(src, weight) AS (VALUES {values}, (NULL, {OTHER_WEIGHT!r}::DOUBLE)),
d AS (SELECT *, CASE WHEN source IN (SELECT src FROM w WHERE src IS NOT NULL) THEN source END AS src
      FROM documents),
sizes AS (SELECT src, count(*)::DOUBLE AS n FROM d GROUP BY src),
there AS (SELECT w.src, weight, n FROM w JOIN sizes ON w.src IS NOT DISTINCT FROM sizes.src),
rates AS (SELECT src, weight * (SELECT sum(n) FROM sizes) / ((SELECT sum(weight) FROM there) * n) AS rate FROM there),
cdf AS (SELECT src, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) OVER (PARTITION BY src ORDER BY j) AS p
        FROM rates, range(0, 400) AS r(j) WHERE rate > 0),
u AS (SELECT d.*, ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
                  / 4503599627370496.0::DOUBLE AS u FROM d),
drawn AS (SELECT *, (SELECT count(*) FROM cdf WHERE cdf.src IS NOT DISTINCT FROM u.src AND cdf.p <= u.u)::INT AS n_copies FROM u)
SELECT * EXCLUDE (src, u), unnest(range(1, n_copies + 1))::INT AS copy_no FROM drawn WHERE n_copies > 0
"""


@query("op5_source_mix", op5_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, other_weight=OTHER_WEIGHT, seed=MIX_SEED)


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_print(F.col("fp")).alias("fingerprint"), F.col("class").alias("component_id"))


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_verdicts(docs, train_field(docs, table(spark, sf_dir, "labels")))


def document_paths(documents: DataFrame) -> DataFrame:
    """The documents as files: source/lang/<block of 500 ids>/<file>; every 50th id names a licence
    file, at the source's root, the language's or its block's directory in turn."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    block = F.concat_ws("/", top, F.floor(F.col("doc_id") / 500).cast("string"))
    kind = F.floor(F.col("doc_id") / 50) % 5
    place = F.when(kind == 0, F.coalesce("source", F.lit("none"))).when(kind == 1, top).otherwise(block)
    name = F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))
    plain = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.withColumn("path", F.when(F.col("doc_id") % 50 == 0, F.concat_ws("/", place, name))
                                .otherwise(F.concat_ws("/", block, plain)))


def op10_sql() -> str:
    idf, other, vectors = template_weights(TEMPLATES)
    weights = ", ".join(f"('{w}', {v!r}::DOUBLE)" for w, v in idf.items())
    parts = ", ".join(f"('{name}', '{w}', {v!r}::DOUBLE)" for name, vec in vectors.items() for w, v in vec.items())
    return f"""
WITH idf(w, idf) AS (VALUES {weights}), tpl(licence, w, v) AS (VALUES {parts}),
f AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, 'none') AS s, coalesce(lang, 'none') AS l,
             (doc_id // 500)::VARCHAR AS b, (doc_id // 50) % 5 AS k FROM documents),
files AS (SELECT doc_id, t, CASE WHEN doc_id % 50 = 0
             THEN CASE k WHEN 0 THEN s WHEN 1 THEN s || '/' || l ELSE s || '/' || l || '/' || b END || '/LICENSE-' || doc_id
             ELSE s || '/' || l || '/' || b || '/doc-' || doc_id || '.txt' END AS path, doc_id % 50 = 0 AS lic_file FROM f),
units AS (SELECT DISTINCT doc_id, unnest(string_split(t, chr(10))) AS u FROM files
          UNION SELECT doc_id, t FROM files WHERE lic_file),
terms AS (SELECT doc_id, u, lower(unnest(regexp_extract_all(u, '[A-Za-z0-9]+'))) AS w FROM units),
tf AS (SELECT doc_id, u, w, count(*) AS n FROM terms GROUP BY ALL),
wt AS (SELECT doc_id, u, tf.w, n * coalesce(idf, {other!r}::DOUBLE) AS x FROM tf LEFT JOIN idf ON tf.w = idf.w),
norm AS (SELECT doc_id, u, sqrt(sum(x * x)) AS norm FROM wt GROUP BY ALL),
dot AS (SELECT doc_id, u, licence, sum(x * v) AS dot FROM wt JOIN tpl ON wt.w = tpl.w GROUP BY ALL),
cos AS (SELECT doc_id, licence, round(dot / norm, 6) AS cosine FROM dot JOIN norm USING (doc_id, u)),
own AS (SELECT doc_id, licence, cosine FROM cos WHERE cosine >= {LEAST}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) = 1),
placed AS (SELECT doc_id, path, lic_file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d, own.licence, own.cosine
           FROM files LEFT JOIN own USING (doc_id)),
given AS (SELECT d AS above, licence AS dir_licence FROM placed WHERE lic_file AND licence IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY d ORDER BY cosine DESC, licence, path) = 1),
near AS (SELECT x.d, above, dir_licence FROM (SELECT DISTINCT d FROM placed) AS x JOIN given
         ON x.d = above OR starts_with(x.d, above || '/') OR above = ''
         QUALIFY row_number() OVER (PARTITION BY x.d ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, coalesce(licence, dir_licence) AS licence, cosine,
       CASE WHEN licence IS NOT NULL THEN CASE WHEN lic_file THEN 'file' ELSE 'header' END
            WHEN dir_licence IS NOT NULL THEN 'inherited' END AS licence_origin,
       CASE WHEN licence IS NULL THEN above END AS licence_dir
FROM placed LEFT JOIN near USING (d)
"""


@query("op10_licences", op10_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_paths(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return scan_licences(files).select("doc_id", "path", "licence", "cosine", "licence_origin", "licence_dir")


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_TOKENIZER))


OP12_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) FROM w
      UNION ALL SELECT lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) FROM w),
c AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE size > 1),
cuts AS (SELECT lang, phrase, a, 1 AS k, ws[1] AS lp, array_to_string(ws[2:], ' ') AS rp FROM cand
         UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM cand WHERE size = 3),
s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r,
             ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts JOIN c AS x ON x.lang = cuts.lang AND x.phrase = lp JOIN c AS y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, ws[1] || ' ' || ws[2] AS phrase FROM cand WHERE size = 3
           UNION ALL SELECT lang, a, ws[2] || ' ' || ws[3] FROM cand WHERE size = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN inside USING (lang, phrase) JOIN total USING (lang)
WHERE coalesce(100 * f < 50 * a, true) QUALIFY rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs WHERE len(ts) > 0),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(ts) * n_docs) // n_terms AS m FROM docs, total WHERE len(ts) > 0),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
asked AS (SELECT i, item_id, t, count(*) AS q FROM items GROUP BY ALL),
scores AS (SELECT i, item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
