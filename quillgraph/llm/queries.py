"""One query per operator over its whole table, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, avi, collocations, html_text, language_id, line_windows, mixing, near_dup, packing, pii, suffix_array, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumn("block_sha256", F.sha2(F.col("block").cast("binary"), 256)).drop("block")


def op3_stable_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_rows(table(spark, sf_dir, "documents")).drop("media", "clips")


def op6_min_max_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_three_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_windows.dedup_lines(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents"))


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path(), pieces_path())


def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ppm_language_id, op2_warc_derivatives, op3_stable_projection_neighbours, op4_best_two_fit, op5_motion_jpeg,
        op6_min_max_near_duplicates, op7_three_line_windows, op8_systematic_mix, op9_suffix_array_dedup, op10_weak_supervision_pii,
        op11_cross_tokenizer_alignment, op12_html_main_text, op13_phrase_collocations,
    )
    return {f.__name__: f for f in every}


_UUID = "'urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


def _warc_sql() -> str:
    text = "body"
    for pattern in ("(?is)<!--.*?-->", "(?is)<script[^<>]*>.*?</script>", "(?is)<style[^<>]*>.*?</style>"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    blocks = "(?i)</?(?:p|br|div|h[1-6]|li|ul|ol|nav|article|header|footer|title|tr|table)(?:\\s[^<>]*)?/?>"
    text = f"regexp_replace(regexp_replace(regexp_replace({text}, '{blocks}', chr(10), 'g'), '<[^<>]*>', '', 'g'), '[\\x20\\x09\\x0D]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')"
    digits, sixteen = "regexp_extract(p, '^([0-9]{1,7});', 1)", "regexp_extract(p, '^[xX]([0-9A-Fa-f]{1,6});', 1)"
    code = f"coalesce(try_cast({digits} AS BIGINT), try_cast('0x' || nullif({sixteen}, '') AS BIGINT))"
    known = f"({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111)"
    part = f"CASE WHEN i = 1 THEN p WHEN {known} THEN chr({code}::INT) || regexp_replace(p, '^[0-9A-Za-z]+;', '') ELSE '&#' || p END"
    text = f"array_to_string(list_transform(string_split({text}, '&#'), lambda p, i: {part}), '')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = "replace({}, '{}', '{}')".format(text, name, char.replace("'", "''"))
    text = f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"
    crlf = "chr(13) || chr(10)"
    meta = (
        f"'source-status: ' || source_status || {crlf} || 'source-content-type: ' || source_type || {crlf} || 'source-length: ' || strlen(body) || {crlf} || "
        f"'source-payload-digest: ' || source_payload_digest || {crlf} || 'links: ' || len(regexp_extract_all(body, '(?i)<a\\s')) || replace(regexp_extract(head, '(?s)^[^\\r\\n]*(.*)$', 1), {crlf}, {crlf} || 'source-header: ') || {crlf}"
    )
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, coalesce(url, '') AS u FROM pages),
    r AS (SELECT page_id, url AS target_uri, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || u || '|' || md5(html)) AS h,
        'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(html) AS head, html AS body FROM p),
    s AS (SELECT page_id, {_UUID.format("h")} AS refers_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, body, head, '200' AS source_status, 'text/html; charset=utf-8' AS source_type,
        'sha256:' || sha256(head || {crlf} || {crlf} || body) AS source_block_digest, 'sha256:' || sha256(body) AS source_payload_digest FROM r),
    b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, {meta} AS block FROM s
        UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM s),
    i AS (SELECT *, md5(record_type || '|' || refers_to) AS h FROM b)
    SELECT page_id, record_type, {_UUID.format("h")} AS record_id, refers_to, target_uri, warc_date, source_status, source_type, source_block_digest, source_payload_digest,
        content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, sha256(block) AS block_sha256 FROM i
    """


_LINES_SQL = """
    WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    w AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS pos, l FROM d WHERE len(l) >= 3),
    k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2]) ORDER BY doc_id, pos) AS nth FROM w),
    m AS (SELECT DISTINCT doc_id, pos + o AS pos FROM k, (VALUES (0), (1), (2)) t(o) WHERE nth > 1),
    u AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, l FROM d),
    j AS (SELECT u.doc_id, count(m.pos) AS n_removed, coalesce(string_agg(l[u.pos], chr(10) ORDER BY u.pos) FILTER (WHERE m.pos IS NULL), '') AS kept
        FROM u LEFT JOIN m ON u.doc_id = m.doc_id AND u.pos = m.pos GROUP BY u.doc_id)
    SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
    FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""

_MIX_SQL = """
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM s),
    v AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (sum(source_size) OVER ())::DOUBLE AS total FROM w),
    l AS (SELECT *, (total - filled) / rest AS level FROM v),
    x AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
    t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, (SELECT level FROM x) * weight) END AS target,
        ('0x' || substr(md5(coalesce('mix:' || source, 'mix|')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
    r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS i FROM d),
    c AS (SELECT r.doc_id, r.size, t.source_size, t.target, u, i, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, ((floor(u + rate * i) - floor(u + rate * (i - 1)))::BIGINT * size)::BIGINT AS taken FROM c
"""


_COLLOCATIONS_SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[ \x09]+'), lambda x: x <> '') AS w FROM d),
    e AS (SELECT lang, w, unnest(range(1, 5)) AS m FROM p),
    g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM e WHERE len(w) >= m)),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
    s AS (SELECT lang, a, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c WHERE m > 2))),
    o AS (SELECT lang, phrase, max(a) AS most FROM s GROUP BY ALL),
    k AS (SELECT c.* FROM c LEFT JOIN o USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
    u AS (SELECT *, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM k)),
    v AS (SELECT u.lang, u.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f)::HUGEINT)::BIGINT AS score
        FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.x JOIN f y ON y.lang = u.lang AND y.phrase = u.y),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM v),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE nth = 1)
    SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_phrase_collocations": _COLLOCATIONS_SQL, "op2_warc_derivatives": _warc_sql(), "op7_three_line_windows": _LINES_SQL, "op8_systematic_mix": _MIX_SQL}
