"""Character corpora of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.evaluation import _round
from plumbline.catalog.registry import query
from plumbline.operators import corpus as C

_CHARS = "c AS (SELECT unnest(string_split(text, '')) AS char FROM documents)"
_N = f"{_CHARS}, n AS (SELECT char, count(*) AS n FROM c GROUP BY 1)"


@query("txt1_vocabulary", "TXT-1", f"WITH {_CHARS} SELECT char, row_number() OVER (ORDER BY unicode(char)) - 1 AS id FROM (SELECT DISTINCT char FROM c)")
def _(t):
    return C.vocabulary(t.documents)


_ALPHABET = "abcdefghijklmnopqrstuvwxyz .\n"


@query("txt2_encode_decode", "TXT-2 SC-2", "SELECT doc_id, length(regexp_replace(text, '[^a-z .\\n]', '', 'g'))::BIGINT AS n, md5(regexp_replace(text, '[^a-z .\\n]', '', 'g')) AS decoded FROM documents")
def _(t):
    coded = C.decoded(C.encoded(t.documents.select("doc_id", "text"), _ALPHABET), _ALPHABET)
    return coded.select("doc_id", F.size("codes").cast("bigint").alias("n"), F.md5("decoded").alias("decoded"))


@query("txt3_split", "TXT-3", "WITH o AS (SELECT doc_id, length(text) AS length, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS start, sum(length(text)) OVER () AS total FROM documents) SELECT doc_id, greatest(0, least(length, floor(total * 0.9)::BIGINT - start))::BIGINT AS n_train FROM o")
def _(t):
    o = C.offsets(t.documents, "doc_id")
    total = o.agg(F.sum("length")).first()[0] or 0
    return o.select("doc_id", F.greatest(F.lit(0), F.least("length", F.lit(int(total * 0.9)) - F.col("start"))).cast("bigint").alias("n_train"))


@query("txt4_windows", "TXT-4", "WITH w AS (SELECT doc_id, text, unnest(range(0, length(text) - 64, 64)) AS p FROM documents WHERE length(text) > 64) SELECT doc_id, p AS \"at\", md5(substr(text, p + 1, 64)) AS x, md5(substr(text, p + 2, 64)) AS y FROM w")
def _(t):
    return C.windows(t.documents, "doc_id", 64).select("doc_id", "at", F.md5("x").alias("x"), F.md5("y").alias("y"))


@query("txt5_frequency", "TXT-5", f"WITH {_N} SELECT char, n FROM n")
def _(t):
    return C.frequencies(t.documents)


@query("txt5_entropy", "TXT-5 TXT-7", f"WITH {_N} SELECT sum(n)::BIGINT AS n_chars, count(*) AS n_vocab, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS unigram_bits, round(log2(count(*)), 6) AS uniform_bits FROM n")
def _(t):
    return _round(C.entropy(C.frequencies(t.documents)), 6)


@query("txt6_stats", "TXT-6", "SELECT count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents")
def _(t):
    return t.documents.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"))
