"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

A response record is a row (record_id, target_uri, warc_date, block) whose block is an HTTP response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Named entities that are resolved, in this order, after numeric ones; `&amp;` comes last so that nothing is
#: resolved twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Parts of a page that are no text, then other tags, then runs of white space.
DROPPED = ((r"(?is)<!--.*?-->", "-->"), (r"(?is)<script[^<>]*>.*?</script>", "</script>"), (r"(?is)<style[^<>]*>.*?</style>", "</style>"))
BREAKS = r"(?i)</?(?:p|br|div|h[1-6]|li|ul|ol|nav|article|header|footer|title|tr|table)(?:\s[^<>]*)?/?>"
TAG = r"<[^<>]*>"
DATE = "2024-01-01T00:00:00Z"


def _urn(*parts: F.Column | str) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def _digest(x: F.Column) -> F.Column:
    return F.concat(F.lit("sha256:"), F.sha2(x.cast("binary"), 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages (page_id, url, html) as response records. A null html is an empty body; a null url stays null."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.md5(body.cast("binary"))).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head, body).alias("block"))


def _numbered(html: F.Column, raw: F.Column) -> F.Column:
    """Numeric references (&#233; or &#xE9;) as their characters; numbers that are none stay. raw tells whether there
    can be any, so that html, which is costly, is made once."""

    def resolved(part: F.Column, i: F.Column) -> F.Column:
        digits, sixteen = F.regexp_extract(part, r"^([0-9]{1,7});", 1), F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.coalesce(F.nullif(digits, F.lit("")).cast("long"), F.conv(F.nullif(sixteen, F.lit("")), 16, 10).cast("long"))
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(63)), 8, "0")), "UTF-32")
        return F.when(i == 0, part).when(known, F.concat(char, F.regexp_replace(part, "^[0-9A-Za-z]+;", ""))).otherwise(F.concat(F.lit("&#"), part))

    return F.when(F.contains(raw, F.lit("&#")), F.array_join(F.transform(F.split(html, "&#", -1), resolved), "")).otherwise(html)


def _without(html: F.Column, pattern: str, end: str) -> F.Column:
    """html without the matches of a pattern that goes on to the next `end`. It is looked for only up to the last
    `end`: behind it no match can end, and each start would be followed to the end of the page."""

    if end == "-->":  # no letters, so there is a quicker way to what is behind the last one
        behind = lambda h: F.length(F.substring_index(h, end, -1))
        upto = lambda h: F.when(F.contains(h, F.lit(end)), F.length(h) - behind(h)).otherwise(0)
    else:
        upto = lambda h: F.length(F.regexp_extract(h, f"(?is)^.*{end}", 0))

    def cut(x: F.Column) -> F.Column:
        head, rest = x["whole"].substr(F.lit(1), x["upto"]), x["whole"].substr(x["upto"] + 1, F.length(x["whole"]))
        return F.when(x["upto"] == 0, x["whole"]).otherwise(F.concat(F.regexp_replace(head, pattern, " "), rest))

    pairs = F.transform(F.array(html), lambda h: F.struct(upto(h).alias("upto"), h.alias("whole")))
    return F.get(F.transform(pairs, cut), F.lit(0))


def plain_text(html: F.Column) -> F.Column:
    """Text of a page: no comments, scripts, styles or tags; blocks on lines of their own; entities resolved. Tags end
    before the next `<`. The time grows with the page, whatever is left open in it."""
    raw = html
    for pattern, end in DROPPED:  # each step names the one before once, so that none is made twice
        html = _without(html, pattern, end)
    html = F.when(F.contains(raw, F.lit("<")), F.regexp_replace(F.regexp_replace(html, BREAKS, "\n"), TAG, "")).otherwise(raw)
    # single blanks and line feeds stay as they are, and are not looked at
    html = F.regexp_replace(html, r"[\x09\x0D][\x20\x09\x0D]*|\x20[\x20\x09\x0D]+", " ")
    html = F.regexp_replace(html, r" \n[ \n]*|\n[ \n]+", "\n")
    html = _numbered(html, raw)
    for name, char in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(char))
    return F.btrim(html, F.lit(" \n"))


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response, with the columns of it that identify it.

    `metadata` holds what the response said of itself (status, content type, length, digest, count of links, and every
    header line as it stands);
    `conversion` holds the plain text. Both refer to the response and to its digests; a block without an
    empty line is all head, and its body is empty. Null blocks count as empty. Equal rows give equal records.
    """
    block = F.coalesce("block", F.lit(""))
    cut = F.instr(block, "\r\n\r\n")
    x = records.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.when(cut > 0, F.substring_index(block, "\r\n\r\n", 1)).otherwise(block).alias("_head"),
        F.when(cut > 0, block.substr(cut + 4, F.length(block))).otherwise(F.lit("")).alias("_body"),
        _digest(block).alias("source_block_digest"),
    )
    x = x.withColumn("source_payload_digest", _digest(F.col("_body"))).withColumn("source_status", F.regexp_extract("_head", r"^HTTP/[0-9.]+ ([0-9]+)", 1))
    x = x.withColumn("source_type", F.regexp_extract("_head", r"(?i)\ncontent-type:[\x20\t]*([^\r\n]*)", 1))
    meta = F.concat(
        F.lit("source-status: "), F.col("source_status"), F.lit("\r\nsource-content-type: "), F.col("source_type"), F.lit("\r\nsource-length: "), F.octet_length("_body").cast("string"),
        F.lit("\r\nsource-payload-digest: "), F.col("source_payload_digest"), F.lit("\r\nlinks: "), F.regexp_count("_body", F.lit(r"(?i)<a\s")).cast("string"),
        F.replace(F.regexp_extract("_head", r"(?s)^[^\r\n]*(.*)$", 1), F.lit("\r\n"), F.lit("\r\nsource-header: ")), F.lit("\r\n"),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("_body")).alias("block")),
    )
    x = x.withColumn("_r", F.explode(made))
    return x.select(
        "page_id", "_r.record_type", _urn(F.col("_r.record_type"), "refers_to").alias("record_id"), "refers_to", "target_uri", "warc_date", "source_status", "source_type", "source_block_digest", "source_payload_digest",
        "_r.content_type", F.octet_length("_r.block").cast("long").alias("content_length"), _digest(F.col("_r.block")).alias("block_digest"), F.col("_r.block").alias("block"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """record_id and warc: each derived record as it stands in a WARC/1.1 file."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: <"), F.col("record_id"), F.lit(">\r\nWARC-Refers-To: <"), F.col("refers_to"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce("target_uri", F.lit("")), F.lit("\r\nWARC-Date: "), F.col("warc_date")]
    lines += [F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"), F.lit("\r\nContent-Type: "), F.col("content_type"), F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")]
    return records.select("record_id", F.concat(*lines).alias("warc"))
