"""URLs, hashes, fingerprints and hostile text over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import bits, markup, text, urls
from tidewire.operators import dedup

from . import domain as d
from .registry import Tables, query

COLLAPSED = r"trim(regexp_replace(coalesce(text, ''), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
CONTENT = f"(SELECT doc_id, sha256({COLLAPSED}) AS content_hash FROM documents)"


@query(f"SELECT * FROM {CONTENT}")
def content_hash(t: Tables):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, CASE WHEN first < doc_id THEN first END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY content_hash) AS first FROM {CONTENT})")
def exact_dup_by_content(t: Tables):
    return dedup.first_with(content_hash(t), "content_hash", "doc_id").select("doc_id", F.when(F.col("first") < F.col("doc_id"), F.col("first")).alias("duplicate_of"))


KEEP = "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|pk_|mc_|hsa_|ga_)') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid','gclid','dclid','msclkid','igshid','mkt_tok','ref','referrer','source','spm','s_kwcid','_ga','yclid','twclid','cmpid','ncid','smid','partner'))"
CANON = f"""(SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#:]*)', 1))
|| coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || CASE WHEN len({KEEP}) = 0 THEN '' ELSE '?' || array_to_string(list_sort({KEEP}), '&') END AS canonical FROM pages)"""


@query(f"SELECT * FROM {CANON}")
def url_canonical(t: Tables):
    """The exact form (Arrow UDF); these pages' URLs need no decoding, so SQL can say it too."""
    return t.pages.select("page_id", urls.canonical_url("url").alias("canonical"))


@query(f"SELECT * FROM {CANON}")
def url_canonical_native(t: Tables):
    return t.pages.select("page_id", urls.canonical_url_native(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, sha256(canonical) AS url_hash, CASE WHEN first < page_id THEN first END AS duplicate_of FROM (SELECT *, min(page_id) OVER (PARTITION BY canonical) AS first FROM {CANON})")
def url_dup(t: Tables):
    p = dedup.first_with(url_canonical_native(t), "canonical", "page_id")
    return p.select("page_id", text.url_hash(F.col("canonical")).alias("url_hash"), F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("duplicate_of"))


HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '')"


@query(f"SELECT {HOST} AS domain, count(*) AS n, bool_or(regexp_matches({HOST}, '(^|\\.)(gov|mil|gov\\.uk|europa\\.eu)$')) AS is_authority FROM pages GROUP BY 1")
def source_resolve(t: Tables):
    s = t.pages.select(text.source_key(F.col("url")).alias("domain"))
    return s.groupBy("domain").agg(F.count("*").alias("n")).withColumn("is_authority", text.is_authority(F.col("domain")))


@query(f"SELECT DISTINCT {HOST} AS domain FROM pages WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.page_id % 7 = 0 AND regexp_replace(lower(regexp_extract(q.url, '://([^/?#:]*)', 1)), '^www\\.', '') = regexp_replace(lower(regexp_extract(pages.url, '://([^/?#:]*)', 1)), '^www\\.', ''))")
def source_create(t: Tables):
    """Hosts that a dimension, made of every seventh page, lacks."""
    s = t.pages.select("page_id", text.source_key(F.col("url")).alias("domain"))
    return dedup.new_sources(s, s.where("page_id % 7 = 0"))


LINE = "split_part(coalesce(text, ''), chr(10), 1)"
TOKS = f"regexp_extract_all(lower({LINE} || ' ' || left(coalesce(text, ''), 400)), '([a-z0-9'']+)', 1)"
HASHES = f"""(SELECT doc_id, coalesce(CAST(sum(CASE WHEN v > 0 THEN 1::BIGINT << b ELSE 0 END) AS BIGINT), 0) AS simhash FROM documents LEFT JOIN
(SELECT id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM (SELECT doc_id AS id, ('0x' || substr(md5(unnest({TOKS})), 1, 8))::BIGINT AS h FROM documents), (SELECT CAST(unnest(range(32)) AS INTEGER) AS b) GROUP BY 1, 2) ON id = doc_id GROUP BY doc_id)"""


def _hashes(t: Tables):
    return d.documents(t).select(F.col("id").alias("doc_id"), bits.simhash_md5(F.col("title"), F.col("body")).alias("simhash"))


@query(f"SELECT * FROM {HASHES}")
def simhash_md5(t: Tables):
    return _hashes(t)


@query(f"SELECT doc_id, CAST(band AS INTEGER) AS band, (simhash >> CAST(8 * band AS INTEGER)) & 255 AS value FROM {HASHES}, (SELECT unnest(range(4)) AS band)")
def simhash_bands(t: Tables):
    return _hashes(t).select("doc_id", F.inline(bits.bands(F.col("simhash"), 32)))


WHOLE_TOKS = f"regexp_extract_all(lower({LINE} || ' ' || coalesce(text, '')), '([a-z0-9'']+)', 1)"
WHOLE_HASHES = HASHES.replace(TOKS, WHOLE_TOKS)


@query(f"SELECT DISTINCT a.simhash AS a, b.simhash AS b FROM {WHOLE_HASHES} a JOIN {WHOLE_HASHES} b ON a.simhash <> 0 AND b.simhash <> 0 AND a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3")
def near_dup_pairs(t: Tables):
    """Fingerprints that are near; all words of a text count, those of its first line twice."""
    hashes = bits.simhash_md5(F.col("title"), F.col("body"), whole=True).alias("simhash")
    return dedup.near_pairs(d.documents(t).select(F.col("id").alias("doc_id"), hashes), width=32)


def _items(t: Tables, hashes):
    p = url_canonical_native(t).select(F.col("page_id").alias("doc_id"), "canonical")
    items = content_hash(t).join(hashes, "doc_id").join(p, "doc_id", "left")
    return items.select(F.col("doc_id").alias("id"), text.url_hash(F.coalesce("canonical", F.col("doc_id").cast("string"))).alias("url_hash"), "content_hash", "simhash")


ITEMS = f"(SELECT c.doc_id AS id, sha256(coalesce(p.canonical, CAST(c.doc_id AS VARCHAR))) AS url_hash, c.content_hash, h.simhash FROM {CONTENT} c JOIN {HASHES} h ON h.doc_id = c.doc_id LEFT JOIN {CANON} p ON p.page_id = c.doc_id)"


@query(f"""WITH i AS (SELECT *, min(id) OVER (PARTITION BY url_hash) AS u, min(id) OVER (PARTITION BY content_hash) AS c FROM {ITEMS}),
n AS (SELECT x.id, max(y.id) AS near FROM i x JOIN i y ON y.id < x.id AND x.simhash <> 0 AND y.simhash <> 0 AND bit_count(xor(x.simhash, y.simhash)) <= 3 GROUP BY 1)
SELECT i.id, CASE WHEN u < i.id OR c < i.id THEN 'exact_duplicate' WHEN near IS NOT NULL THEN 'near_duplicate' ELSE 'unique' END AS dedup_status,
CASE WHEN u < i.id THEN u WHEN c < i.id THEN c ELSE near END AS duplicate_of FROM i LEFT JOIN n ON n.id = i.id""")
def dedup_cascade(t: Tables):
    return dedup.classify(_items(t, _hashes(t)), 32)


@query()
def simhash_blake2b(t: Tables):
    return d.documents(t).select("id", bits.simhash(F.col("title"), F.col("body")).alias("simhash"))


def _hashes_64(t: Tables):
    return d.documents(t).select(F.col("id").alias("doc_id"), bits.simhash(F.col("title"), F.col("body")).alias("simhash"))


HASHES_64 = f"""(SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END AS BIGINT) AS simhash FROM (SELECT doc_id, coalesce(CAST(sum(CASE WHEN v > 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END) AS HUGEINT), 0) AS u FROM documents LEFT JOIN
(SELECT id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM (SELECT doc_id AS id, ('0x' || substr(md5(unnest({TOKS})), 1, 16))::UBIGINT AS h FROM documents), (SELECT CAST(unnest(range(64)) AS UBIGINT) AS b) GROUP BY 1, 2) ON id = doc_id GROUP BY doc_id))"""


def _hashes_md5_64(t: Tables):
    return d.documents(t).select(F.col("id").alias("doc_id"), bits.simhash_md5(F.col("title"), F.col("body"), 64).alias("simhash"))


@query(f"SELECT doc_id, CAST(band AS INTEGER) AS band, (simhash >> CAST(16 * band AS INTEGER)) & 65535 AS value FROM {HASHES_64}, (SELECT unnest(range(4)) AS band)")
def simhash_bands_64(t: Tables):
    return _hashes_md5_64(t).select("doc_id", F.inline(bits.bands(F.col("simhash"))))


@query(f"SELECT DISTINCT a.simhash AS a, b.simhash AS b FROM {HASHES_64} a JOIN {HASHES_64} b ON a.simhash <> 0 AND b.simhash <> 0 AND a.simhash <> b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3")
def near_dup_pairs_64(t: Tables):
    """The production form of near_dup_pairs, where unrelated documents hardly meet by chance."""
    return dedup.near_pairs(_hashes_md5_64(t))


@query()
def dedup_cascade_64(t: Tables):
    """The production form of dedup_cascade: the exact 64-bit fingerprints, which SQL cannot say."""
    return dedup.classify(_items(t, _hashes_64(t)))


@query()
def html_text(t: Tables):
    return t.pages.select("page_id", markup.html_to_text("html").alias("h")).select("page_id", "h.text", "h.hidden_blocks")


@query()
def sanitize_flags(t: Tables):
    s = d.documents(t).select("id", markup.sanitize("body").alias("s"))
    return s.select("id", "s.invisible_chars", "s.non_ascii_letter_ratio", F.array_join(text.injection_patterns(F.col("s.text")), ",").alias("patterns"))


@query(f"SELECT doc_id, len({TOKS}) AS n_tokens, len(list_distinct({TOKS})) AS n_distinct FROM documents")
def token_counts(t: Tables):
    words = bits.words(F.col("title"), F.col("body"))
    return d.documents(t).select(F.col("id").alias("doc_id"), F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


@query(r"SELECT doc_id, left(array_to_string(list_filter([trim(split_part(coalesce(text, ''), chr(10), 1), ' '), trim(coalesce(source, ''), ' '), trim(coalesce(text, ''), ' ')], lambda x: x <> ''), chr(10) || chr(10)), 1500) AS text FROM documents")
def text_assembly(t: Tables):
    docs = d.documents(t)
    return docs.select(F.col("id").alias("doc_id"), text.assemble(F.col("title"), F.col("source"), F.col("body"), limit=1500).alias("text"))


@query(f"""SELECT page_id, array_to_string(list_distinct_keep, ',') AS labels FROM (SELECT page_id, list_filter(list_transform(list_filter(string_split({HOST}, '.'), lambda x: x <> '' AND x NOT IN ('com','org','net','gov','edu','co','uk','us','io','news')), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS list_distinct_keep FROM pages)""")
def publisher_labels(t: Tables):
    return t.pages.select("page_id", F.array_join(text.publisher_labels(text.host(F.col("url"))), ",").alias("labels"))
