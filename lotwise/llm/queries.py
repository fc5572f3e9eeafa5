"""One query per operator over its whole table, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from lotwise.llm import (
    deobfuscation,
    digest_merge,
    direct_codes,
    grammar_runs,
    kd_shards,
    language_codes,
    lexical_blocks,
    piece_codec,
    pivot_simhash,
    projection_forest,
    secret_crf,
    suffix_automaton,
    url_templates,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; LLM_TOKENIZER_DIR names another folder than that of the installed package."""
    folder = os.environ.get("LLM_TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def labelled_documents(docs: DataFrame) -> DataFrame:
    """Documents whose language may be learned from."""
    return docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull())


@query()
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_codes.train_language_codes(labelled_documents(docs))
    found = language_codes.predict_languages(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


OP2_SQL = """
WITH RECURSIVE parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_transform(string_split(path, '/')[2:], lambda x: CASE WHEN regexp_matches(x, '^[0-9a-f]{8,}$') THEN '#h'
      ELSE regexp_replace(x, '[0-9]+', '#n', 'g') END) AS o FROM parsed),
acted AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS action FROM ruled),
grouped AS (SELECT host, o, count(*) AS n, count(action) AS seen, count(*) FILTER (action = 'block') AS bad FROM acted GROUP BY ALL),
gen AS (
  SELECT 0 AS level, host, o, o AS s, n, seen, bad FROM grouped
  UNION ALL
  SELECT level + 1, host, o, CASE WHEN len(s) > level AND kinds > 20 AND 2 * kinds > urls THEN s[1:level] || ['#*'] || s[level + 2:] ELSE s END, n, seen, bad
  FROM (SELECT *, count(DISTINCT s[level + 1]) OVER w AS kinds, sum(n) OVER w AS urls FROM gen
    WHERE level < (SELECT max(len(o)) FROM grouped) WINDOW w AS (PARTITION BY host, len(s) > level, s[1:level]))),
trees AS (SELECT host, o, s, n, seen, bad FROM gen WHERE level = (SELECT max(len(o)) FROM grouped)),
leaves AS (SELECT host, s, sum(bad)::double AS bad, sum(seen)::double AS seen FROM trees GROUP BY ALL),
ways AS (SELECT host, s, bad, seen, unnest(range(len(s) + 1)) AS depth FROM leaves),
nodes AS (SELECT host, s[1:depth] AS node, depth, sum(bad) AS bad, sum(seen) AS seen FROM ways GROUP BY ALL),
apart AS (SELECT a.host, a.node, a.depth FROM nodes a JOIN nodes b ON a.host = b.host AND a.depth = b.depth + 1 AND a.node[1:b.depth] = b.node
  WHERE NOT ((a.bad * b.seen - b.bad * a.seen) ** 2 <= 4 * b.bad * (b.seen - b.bad) * a.seen)),
kept AS (SELECT w.host, w.s, max(w.depth) AS kept FROM ways w JOIN apart a ON a.host = w.host AND a.depth = w.depth AND a.node = w.s[1:w.depth] GROUP BY ALL),
named AS (SELECT l.host, l.s, l.bad, l.seen, CASE WHEN coalesce(kept, 0) = len(l.s) THEN CASE WHEN len(l.s) > 0 THEN '/' || array_to_string(l.s, '/') ELSE '' END
    ELSE CASE WHEN coalesce(kept, 0) > 0 THEN '/' || array_to_string(l.s[1:kept], '/') ELSE '' END || '/#~' END AS template
  FROM leaves l LEFT JOIN kept k ON k.host = l.host AND k.s = l.s),
scored AS (SELECT *, sum(bad) OVER (PARTITION BY host, template) AS pb, sum(seen) OVER (PARTITION BY host, template) AS ps,
  sum(bad) OVER (PARTITION BY s) AS sb, sum(seen) OVER (PARTITION BY s) AS ss, sum(bad) OVER () AS ab, sum(seen) OVER () AS a_s FROM named),
judged AS (SELECT host, s, template, (pb + 4 * ((sb + 4 * CASE WHEN a_s > 0 THEN ab / a_s ELSE 0.0 END) / (ss + 4))) / (ps + 4) AS purity FROM scored)
SELECT a.page_id, a.host, a.path, a.rule, coalesce(a.action, CASE WHEN j.purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, j.template, j.purity
FROM acted a JOIN trees t ON t.host = a.host AND t.o = a.o JOIN judged j ON j.host = t.host AND j.s = t.s
"""


@query(OP2_SQL)
def op2_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, folder, "pages"))


OP3_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP3_CTES = f"""
words AS (SELECT rid, doc_id, {OP3_WORDS} AS w FROM rows_in),
items AS (SELECT item_id::varchar AS item, {OP3_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
item_windows AS (SELECT DISTINCT item, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM words, sizes, unnest(range(1, len(w) - k + 2)) AS u(i)),
found AS (SELECT d.rid, d.k, d.i, v.item FROM doc_windows d JOIN item_windows v USING (k, win)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + k)) AS u(p) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid),
judged AS (SELECT w.rid, w.doc_id, len(w.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
  FROM words w LEFT JOIN hits h USING (rid) LEFT JOIN named n USING (rid))
"""


@query(
    f"WITH rows_in AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {OP3_CTES} "
    "SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM judged"
)
def op3_suffix_automaton(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_automaton.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans")


@query()
def op4_projection_forest(spark: SparkSession, folder: str) -> DataFrame:
    return projection_forest.nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5)


@query()
def op5_secret_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_crf.scan_secrets(docs, secret_crf.train_secret_field(docs))


@query()
def op6_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether they decode to it; null counts as empty."""
    return piece_codec.checked_pieces(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query()
def op7_deobfuscation(spark: SparkSession, folder: str) -> DataFrame:
    return deobfuscation.find_personal_data(table(spark, folder, "documents"))


@query()
def op8_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards.kd_shards(table(spark, folder, "documents"))


@query()
def op9_direct_codes(spark: SparkSession, folder: str) -> DataFrame:
    return direct_codes.direct_codes(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


@query()
def op10_pivot_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_simhash.near_duplicates(table(spark, folder, "documents"))


@query(
    """
    WITH words AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    sizes AS (SELECT rid, doc_id, len(w)::bigint AS n FROM words WHERE len(w) > 0),
    corpus AS (SELECT count(*)::bigint AS docs, sum(n)::bigint AS total FROM sizes),
    postings AS (SELECT rid, term, count(*)::bigint AS tf FROM (SELECT rid, unnest(w) AS term FROM words) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::double))::bigint AS w
      FROM (SELECT term, count(*)::bigint AS df FROM postings GROUP BY term), corpus),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
    scored AS (SELECT item_id, rid, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::bigint AS score
      FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (rid), corpus GROUP BY ALL)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::int AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
    """
)
def op11_lexical_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_blocks.lexical_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
    FROM t WINDOW same AS (PARTITION BY t)
    """
)
def op12_digest_merge(spark: SparkSession, folder: str) -> DataFrame:
    return digest_merge.exact_copies(table(spark, folder, "documents"))


@query()
def op13_grammar_runs(spark: SparkSession, folder: str) -> DataFrame:
    return grammar_runs.find_runs(table(spark, folder, "documents"))
