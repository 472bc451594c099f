"""The operators' queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    byte_bpe, chat_format, decontaminate, hash_forest, language_id, line_dedup, merkle_manifest, ngram_lm, quality_model,
    quality_rules, simhash_dedup, spelling_variants, url_filter,
)
from plumbline.llm.common import lower_ascii

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def _held_out(n: int, at: int) -> Column:
    return F.coalesce(_remainder(n) == at, F.lit(False)).alias("held_out")


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.encode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=None, digests=True, keep=["doc_id"])


@_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality_model.learn(docs, labels, _remainder(5) != 0)
    scored = quality_model.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", _held_out(5, 0), "score", "predicted")


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(
        _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        _digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


ORACLES["op3_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM d JOIN (SELECT DISTINCT l FROM bw) ls ON len(w) >= l)),
hit AS (SELECT r, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
it AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

#: The derived list: which hosts are listed, in which category, and when.
_DIGITS = "0123456789abcdef"


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages captured on a day that follows from their id, against lists drawn from their hosts.

    The tables have no lists, so Spark derives one: of all hosts (without a leading ``m.``) those
    whose MD5 begins with 0 to 7 are listed in one of four categories from some day of the first
    half of 2024, taken off 90 days later, and some of them listed again after 150 days.
    """
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod("page_id", F.lit(366))).cast("int")))
    hosts = pages.select(F.regexp_replace(url_filter.host_of(F.col("url")), r"^m\.", "").alias("domain"))
    digit = lambda i: F.instr(F.lit(_DIGITS), F.substring(F.md5("domain"), i, 1)) - 1
    listed = hosts.where(F.col("domain").isNotNull()).distinct().where(digit(1) < 8)
    category = F.element_at(F.array(*[F.lit(c) for c in ("ads", "malware", "scam", "spam")]), (digit(2) % 4 + 1).cast("int"))
    first = F.date_add(F.lit("2024-01-01").cast("date"), (digit(3) * 11).cast("int"))
    dated = F.array(
        F.struct(first.alias("day"), F.lit(True).alias("listed")),
        F.struct(F.date_add(first, 90).alias("day"), F.lit(False).alias("listed")),
        F.struct(F.date_add(first, 150).alias("day"), (digit(4) % 2 == 0).alias("listed")))
    entries = listed.select(category.alias("category"), "domain", F.inline(dated))
    found = url_filter.match(captures, entries)
    return found.select(
        "page_id", "host", F.col("day").cast("string").alias("day"), F.array_join("categories", ",").alias("categories"),
        "matched_domain", "blocked")


ORACLES["op4_url_filter"] = r"""
WITH c AS (
  SELECT page_id, DATE '2024-01-01' + (((page_id % 366) + 366) % 366)::INTEGER AS day,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+?)\.?(?:[:/?#]|$)', 1), '') AS host
  FROM pages),
h AS (SELECT DISTINCT regexp_replace(host, '^m\.', '') AS domain FROM c WHERE host IS NOT NULL),
x AS (
  SELECT domain, strpos('0123456789abcdef', substr(md5(domain), 2, 1)) - 1 AS d2,
    strpos('0123456789abcdef', substr(md5(domain), 3, 1)) - 1 AS d3, strpos('0123456789abcdef', substr(md5(domain), 4, 1)) - 1 AS d4
  FROM h WHERE strpos('0123456789abcdef', substr(md5(domain), 1, 1)) - 1 < 8),
s AS (
  SELECT ['ads', 'malware', 'scam', 'spam'][d2 % 4 + 1] AS category, domain, DATE '2024-01-01' + (d3 * 11)::INTEGER AS since,
    DATE '2024-01-01' + (d3 * 11 + 90)::INTEGER AS until FROM x
  UNION ALL
  SELECT ['ads', 'malware', 'scam', 'spam'][d2 % 4 + 1], domain, DATE '2024-01-01' + (d3 * 11 + 150)::INTEGER, NULL FROM x WHERE d4 % 2 = 0),
m AS (
  SELECT c.host, c.day, array_to_string(list_sort(list(DISTINCT s.category)), ',') AS categories, arg_max(s.domain, length(s.domain)) AS matched_domain
  FROM (SELECT DISTINCT host, day FROM c WHERE host IS NOT NULL AND day IS NOT NULL) c
  JOIN s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND c.day >= s.since AND (s.until IS NULL OR c.day < s.until)
  GROUP BY c.host, c.day)
SELECT page_id, c.host, c.day::VARCHAR AS day, coalesce(categories, '') AS categories, matched_domain, matched_domain IS NOT NULL AS blocked
FROM c LEFT JOIN m ON c.host = m.host AND c.day = m.day
"""


@_query
def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    scored = ngram_lm.score(docs, _remainder(10) != 0).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", _held_out(10, 0), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    dictionaries = language_id.learn(docs, _remainder(4) != 2)
    found = language_id.identify(docs.select("doc_id", "text"), dictionaries, keep=["doc_id"])
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "margin", "rejected")


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "class_distance", "word_distance")


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, their source as the host."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    cleaned = line_dedup.drop_lines(docs, counts=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", _digest(F.coalesce("text", F.lit(""))).alias("text_sha256"))


ORACLES["op8_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
pl AS (
  SELECT DISTINCT r, source, line FROM (SELECT r, source, unnest(ls) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
tot AS (SELECT source, count(*) AS n FROM d GROUP BY source),
bp AS (
  SELECT pl.source, line FROM pl JOIN tot ON pl.source IS NOT DISTINCT FROM tot.source
  GROUP BY pl.source, line, n HAVING n >= 20 AND count(*) > 0.1::DOUBLE * n),
bl AS (SELECT source, list(line) AS ll FROM bp GROUP BY source),
k AS (
  SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(ll, []), x)) AS kept
  FROM d LEFT JOIN bl ON d.source IS NOT DISTINCT FROM bl.source),
e AS (
  SELECT *, len(kept) < len(ls) AS cut FROM k)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (CASE WHEN cut THEN len(ls) - len(kept) ELSE 0 END)::BIGINT AS n_dropped,
  sha256(CASE WHEN cut THEN coalesce(array_to_string(kept, chr(10)), '') ELSE coalesce(text, '') END) AS text_sha256
FROM e
"""


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), tricky.alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    chats = chat_format.format_chats(chat_format.as_log(turns.unionByName(more)))
    back = chats.select(
        F.col("conv").alias("conv_id"), chat_format.read_back(F.col("formatted")).alias("turns"),
        chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), _digest(said).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), _digest(loss).alias("loss_sha256"), "formatted_chars")


ORACLES["op10_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(12 + 1 + 10 + 1 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\l'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _crc32_sql(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, bit by bit from the lowest of each byte."""
    digit = lambda i: f"strpos('0123456789ABCDEF', substr(hex({text}::VARCHAR), {i}, 1)) - 1"
    bits = f"""flatten([[(({digit('2 * k - b // 4')}) >> (b % 4)) & 1 for b in range(8)]
      for k in range(1, octet_length(encode({text}::VARCHAR)) + 1)])"""
    step = "lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), {step}))"


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents", *fields)
    changed = F.when(_remainder(3) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    manifest = merkle_manifest.build(docs, fields, "doc_id", "lang", [*map(F.col, fields[:-1]), changed])
    return merkle_manifest.prove(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _merkle_levels(name: str, tree: str, levels: int) -> str:
    """Tables {name}0 to {name}{levels} of nodes (tree, i, d, n: nodes of the tree at that level, l and r: what stands beside)."""
    out = []
    for k in range(levels + 1):
        run = f"PARTITION BY {tree}, i // 8 ORDER BY i"
        below = f"{name}_leaves" if k == 0 else f"(SELECT {tree}, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k - 1} GROUP BY {tree}, i // 8)"
        out.append(f"""{name}{k} AS (SELECT {tree}, i, d, count(*) OVER (PARTITION BY {tree}) AS n,
  coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {below})""")
    return ",\n".join(out)


def _merkle_sql(levels: int = 9, top_levels: int = 3) -> str:
    """Levels enough for 8 ** 9 documents of a language and 8 ** 3 languages."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars')))} || {field(text)})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""
WITH leaf AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id')} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
t_leaves AS (SELECT tree, i, leaf AS d FROM placed)""", _merkle_levels("t", "tree", levels)]
    parts.append(f"sub AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS rank FROM t{levels} WHERE i = 0)")
    parts.append("u_leaves AS (SELECT '' AS tree, rank AS i, subroot AS d FROM sub)")
    parts.append(_merkle_levels("u", "tree", top_levels))
    parts.append("f0 AS (SELECT p.doc_id, p.leaf, p.tree, p.i, s.subroot, s.rank, p.changed AS f, '' AS proof FROM placed p JOIN sub s USING (tree))")
    at = 0
    for name, count, key, place in (("t", levels, "x.tree = y.tree", "x.i"), ("u", top_levels, "true", "x.rank")):
        for k in range(count):
            parts.append(f"""f{at + 1} AS (SELECT x.* REPLACE (CASE WHEN y.n > 1 THEN sha256(y.l || x.f || y.r) ELSE x.f END AS f, CASE WHEN y.n > 1 THEN proof || y.l || y.r ELSE proof END AS proof)
  FROM f{at} x JOIN {name}{k} y ON {key} AND {place} // {8 ** k} = y.i)""")
            at += 1
    return ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified
FROM f{at} CROSS JOIN (SELECT d FROM u{top_levels} WHERE i = 0) r
"""


ORACLES["op11_merkle_manifest"] = _merkle_sql()


@_query
def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(_table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLES["op13_spelling_variants"] = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
h AS (SELECT run, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r WHERE length(run) >= 7),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT DISTINCT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (
  SELECT DISTINCT x.word, y.word AS near, y.n FROM cut x JOIN cut y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT DISTINCT x.word, y.word, y.n FROM cut x JOIN v y ON x.a || x.b = y.word
  UNION SELECT DISTINCT y.word, x.word, x.n FROM cut x JOIN v y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT walk.word, walk.at FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NULL) w ON f.word = w.word
"""
