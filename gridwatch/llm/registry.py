"""The numbered queries: thin, each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .bpe import encode_decode
from .codes import compress
from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract
from .langid import fit, held_out, identify
from .near_dup import near_duplicates
from .packing import pack
from .pii import pii_digest, pii_spans
from .resampling import resample
from .secrets import secret_digest, secret_spans
from .sharding import shard
from .topk import top_k
from .toxicity import fit as fit_toxicity
from .toxicity import score as score_toxicity


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_curve_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1).drop("ids")


def op3_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op5_va_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_secret_scan(spark, sf_dir):
    return secret_digest(secret_spans(table(spark, sf_dir, "documents")))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op9_bpe(spark, sf_dir):
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark, sf_dir):
    return pii_digest(pii_spans(table(spark, sf_dir, "documents")))


def op11_virtual_slots(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"), 24).drop("part")


def op12_exact_codes(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_segment_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def record_sizes(spark, sf_dir):
    """op11's columns that SQL can express."""
    return op11_virtual_slots(spark, sf_dir).select("doc_id", "size", "text_crc32", "law")


def secret_base_spans(spark, sf_dir):
    """op7's columns that SQL can express."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def pii_base_spans(spark, sf_dir):
    """op10's columns that SQL can express."""
    return op10_pii(spark, sf_dir).drop("spans", "n_spans")


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _base_sql(patterns: dict[str, tuple[str, int, str]], order: str) -> str:
    """Counts and digest of all matches of each kind's pattern (pattern, group that is v, condition on m, v and digits); places are sums of the lengths before."""
    found = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, {k} AS place, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs FROM d WHERE regexp_matches(t, '{p}')"
        for k, (kind, (p, group, _)) in enumerate(patterns.items())
    )
    keep = " OR ".join(f"(kind = '{kind}' AND {ok})" for kind, (_, _, ok) in patterns.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
one AS (SELECT rid, kind, place, unnest(range(1, len(ms) + 1)) AS i, gaps, ms, vs FROM found),
put AS (SELECT rid, kind, place, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, ms[i] AS m, vs[i] AS v, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits FROM one),
kept AS (SELECT rid, kind, place, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b FROM put WHERE {keep}),
by_doc AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in patterns)}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}) AS spans FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in patterns)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN by_doc USING (rid)
"""


_LUHN = "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INTEGER) WHEN CAST(reverse(digits)[i] AS INTEGER) > 4 THEN 2 * CAST(reverse(digits)[i] AS INTEGER) - 9 ELSE 2 * CAST(reverse(digits)[i] AS INTEGER) END)) % 10 = 0"
_OCTETS = "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"
SECRETS_SQL = _base_sql({
    "assign": (rf"""({"|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 6"),
    "access": ("AKIA[A-Z0-9]+", 0, "length(m) >= 20"),
    "hex": ("[0-9a-f]+", 0, "length(m) >= 24"),
}, "a, place")
PII_SQL = _base_sql({
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, _OCTETS),
    "card": (r"[0-9]([\x20-]?[0-9])+", 0, f"length(digits) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0, "length(digits) BETWEEN 9 AND 15"),
}, "place, a")

OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, k.b FROM reach r JOIN both_ways k ON r.other = k.a)
SELECT s.doc_id, CAST(len(s.ss) AS BIGINT) AS n_shingles, min(other) AS component_id FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, s.ss
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: What a byte value does to a CRC-32, from the polynomial's rule.
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"
_CRC = lambda s: f"xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

RECORDS_SQL = f"""
WITH {_CRC_TABLE}
SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size, CAST({_CRC("coalesce(text, '')")} AS BIGINT) AS text_crc32, 'bytes' AS law FROM documents, crc_table
"""


def _codes_sql(rounds: int) -> str:
    """Each round: the nearest entry of every part, then the entries' means; distances in exact integers."""
    ctes = ["""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", """parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, (SELECT unnest(range(4)) AS p))""", "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))"]  # fmt: skip
    for r in range(rounds + 1):
        ctes.append(f"near{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min((d, entry)) AS best FROM (SELECT vec_id, a.p, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts a JOIN book{r} b ON a.p = b.p) GROUP BY vec_id, p)")
        if r < rounds:
            ctes.append(f"mean{r} AS (SELECT p, entry, list(m ORDER BY i) AS c FROM (SELECT p, best[2] AS entry, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM near{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL) GROUP BY p, entry)")
            ctes.append(f"book{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.entry = m.entry)")
    return f"""WITH {", ".join(ctes)},
coded AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha
"""


OP13_SQL = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word FROM d), b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
once AS (SELECT word, {_CRC("word")} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), crc_table),
s AS (SELECT bucket, count(*) AS s FROM w JOIN once USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN once USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM w) + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM b) + 10000))::DOUBLE)) AS BIGINT) AS gain FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT rid, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN once USING (word) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (rid)),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM placed) THEN rank END AS rank FROM scored LEFT JOIN placed USING (rid)
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_curve_packing": op2_curve_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_html_text": op4_html_text,
    "op5_va_topk": op5_va_topk,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_virtual_slots": op11_virtual_slots,
    "op12_exact_codes": op12_exact_codes,
    "op13_segment_resampling": op13_segment_resampling,
    "record_sizes": record_sizes,
    "secret_base_spans": secret_base_spans,
    "pii_base_spans": pii_base_spans,
}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op5_va_topk": OP5_SQL, "op12_exact_codes": _codes_sql(4), "op13_segment_resampling": OP13_SQL, "record_sizes": RECORDS_SQL, "secret_base_spans": SECRETS_SQL, "pii_base_spans": PII_SQL}
