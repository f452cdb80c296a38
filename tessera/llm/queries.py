"""The queries op1 to op13 over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, collocations, decontaminate, langid, licenses, line_dedup, lm, merkle, mixing, quality, simhash, tokens, urls
from tessera.llm.common import id_hash
from tessera.sources.store import ship

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. The session hands Python a thousand rows or 8 MB at a time: documents are long, and a batch is held on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rules_frame(spark, RULES))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_documents(tokens.write_shards(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_hash("doc_id", 4) == 2
    model = langid.fit_langid(docs, ~held_out)
    return langid.predict_langid(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), id_hash("doc_id", 5) == 1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", F.col("mix_order.block").alias("block_order"), F.col("mix_order.document").alias("document_order"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def claimed_leaf() -> Column:
    """A document's leaf; of those whose id's crc32 is divisible by 7, with a character more than they have."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return merkle.leaf_of(n_chars=F.col("n_chars") + F.when(tampered, 1).otherwise(0))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), claimed_leaf())


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_ann, op3_urls, op4_tokens, op5_langid, op6_decontaminate, op7_simhash, op8_lm, op9_mixing, op10_licenses, op11_merkle, op12_lines, op13_collocations)
}

#: Unsigned crc32 of doc_id as text is this, xor 2^32 - 1: bits of each byte from the lowest, by the reversed polynomial.
CRC = """list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""

ORACLE_SQL: dict[str, str] = {
    "op3_urls": """
WITH rules(rh, rp, action) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','allow'), ('example.net','/de/8','block'), ('org','/es/','block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT page_id, host, path, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
         FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
""",
    "op11_merkle": f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, CASE WHEN doc_id IS NOT NULL AND xor({CRC}, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS more, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS h,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + more)::VARCHAR) || ':' || (n_chars + more) END || tail) AS claimed FROM fields),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
base AS (SELECT doc_id, h, claimed, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang),
nodes AS (
  SELECT 0 AS level, g, pos, h FROM base
  UNION ALL
  SELECT level + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY level, g, pos // 2),
subroots AS (SELECT g, arg_max(h, level) AS h, max(level) AS top FROM nodes GROUP BY g),
uppers AS (
  SELECT 0 AS level, g AS pos, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM uppers) WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT arg_max(h, level) AS h, max(level) AS top FROM uppers),
steps AS (
  SELECT b.g, b.pos AS leaf, r.k AS step, n.h AS sibling, n.pos < b.pos >> r.k AS before FROM base b JOIN subroots s USING (g) JOIN range(64) r(k) ON r.k < s.top LEFT JOIN nodes n ON n.g = b.g AND n.level = r.k AND n.pos = xor(b.pos >> r.k, 1)
  UNION ALL
  SELECT b.g, b.pos, s.top + r.k, u.h, u.pos < b.g >> r.k FROM base b JOIN subroots s USING (g) JOIN root t ON true JOIN range(64) r(k) ON r.k < t.top LEFT JOIN uppers u ON u.level = r.k AND u.pos = xor(b.g >> r.k, 1)),
folding AS (
  SELECT g, pos AS leaf, 0 AS step, claimed AS h FROM base
  UNION ALL
  SELECT f.g, f.leaf, f.step + 1, sha256(CASE WHEN n.sibling IS NULL THEN f.h WHEN n.before THEN n.sibling || f.h ELSE f.h || n.sibling END) FROM folding f JOIN steps n ON n.g = f.g AND n.leaf = f.leaf AND n.step = f.step),
last AS (SELECT g, leaf, arg_max(h, step) AS h FROM folding GROUP BY g, leaf),
proofs AS (SELECT g, leaf, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS p FROM steps GROUP BY g, leaf)
SELECT doc_id, b.h AS leaf, s.h AS subroot, t.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, l.h AS folded_root, l.h = t.h AS verified
FROM base b JOIN subroots s USING (g) JOIN root t ON true JOIN last l ON l.g = b.g AND l.leaf = b.pos LEFT JOIN proofs p ON p.g = b.g AND p.leaf = b.pos
""",
    "op12_lines": r"""
WITH texts AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS doc, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owned AS (SELECT *, length(k) >= 10 AND doc <> min(doc) OVER (PARTITION BY k) AS goes FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256 FROM owned GROUP BY r
""",
    "op13_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p FROM starts JOIN (VALUES (1), (2), (3), (4)) l(k) ON i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY lang, k, p HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
candidates AS (SELECT *, string_split(p, ' ') AS w FROM f WHERE k > 1),
parts AS (SELECT c.lang, c.p, c.a, j.k, array_to_string(list_slice(w, 1, j.k), ' ') AS first, array_to_string(list_slice(w, j.k + 1, c.k), ' ') AS rest FROM candidates c JOIN (VALUES (1), (2), (3)) j(k) ON j.k < c.k),
cuts AS (SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.p = c.first JOIN f y ON y.lang = c.lang AND y.p = c.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (SELECT q.lang, array_to_string(list_slice(w, i.i, i.i + m.m - 1), ' ') AS p, q.a FROM candidates q JOIN (VALUES (2), (3)) m(m) ON m.m < q.k JOIN (VALUES (1), (2), (3)) i(i) ON i.i + m.m - 1 <= q.k),
covers AS (SELECT lang, p, max(a) AS most FROM inside GROUP BY lang, p),
ranked AS (SELECT b.lang, b.p AS phrase, b.a, b.l, b.r, b.score,
  row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.p)) AS rank
  FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.p = b.p WHERE c.most IS NULL OR 100 * c.most < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
