"""Queries over document blocks: the lines of the documents, twelve to a page, short bare ones as headings."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import blocks as bl
from stacklore.plans.evaluating import _FLAGS, _SIG
from stacklore.sources.views import CONTENT, table

_HEADING, _PLAIN = r"^\p{Lu}[^.!?,;:]{2,28}$", r"trim(regexp_replace(regexp_replace(replace(line, chr(13), chr(10)), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g'))"
_WORDS = "ve|veya|ama|ancak|fakat|ile|ki|de|da|gibi|icin|için"
_BLOCKS = rf"""lines AS (SELECT doc, unnest(ls) AS line, generate_subscripts(ls, 1) AS nth FROM (SELECT doc_id AS doc, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM documents)),
content AS (SELECT doc * 1000000 + nth AS id, doc, nth, (nth - 1) // 12 + 1 AS page_number, CASE WHEN regexp_matches(trim(line), '{_HEADING}') THEN 'heading' WHEN starts_with(trim(line), '|') THEN 'table' ELSE 'body' END AS kind,
  1 - (nth % 4) * 0.1::DOUBLE AS confidence, line, {_SIG} AS sig, {_PLAIN} AS text, '' AS title FROM lines)"""
_PARAS = rf"""WITH RECURSIVE {_FLAGS.replace(CONTENT, _BLOCKS)},
spot AS (SELECT *, row_number() OVER (PARTITION BY doc, page_number ORDER BY nth) AS k, count(*) OVER (PARTITION BY doc, page_number) AS n_page,
  length(t) = 0 OR bibliography_like OR toc_like OR page_artifact OR front_matter_like OR imprint_like OR catalog_like OR address_like OR orphan_fragment OR (short_fragment AND (heading_like OR ocr_noise OR broken_start OR broken_end)) OR (broken_start AND broken_end) OR score < 0.35 AS skip FROM q),
ed AS (SELECT *, k <= 2 OR k > n_page - 2 AS edge FROM spot), tot AS (SELECT doc, count(DISTINCT page_number) AS pages FROM ed GROUP BY 1),
often AS (SELECT doc, sig FROM (SELECT doc, sig, count(DISTINCT page_number) AS p FROM ed WHERE edge AND sig <> '' GROUP BY ALL) JOIN tot USING (doc) WHERE p >= greatest(3, ceil(pages * 0.2))),
body AS (SELECT doc, page_number AS page, nth, kind, text, confidence, sum((kind = 'heading')::INT) OVER (PARTITION BY doc ORDER BY nth) AS section FROM ed
  WHERE length(text) > 0 AND NOT (edge AND (page_artifact OR EXISTS (SELECT 1 FROM often o WHERE o.doc = ed.doc AND o.sig = ed.sig))) AND NOT (skip AND (bibliography_like OR toc_like OR front_matter_like OR imprint_like OR catalog_like OR address_like))),
heads AS (SELECT doc, section, text, lag(text) OVER (PARTITION BY doc ORDER BY section) AS before FROM body WHERE kind = 'heading'),
paths AS (SELECT doc, section, list(text) FILTER (before IS NULL OR before <> text) OVER (PARTITION BY doc ORDER BY section) AS path FROM heads),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY nth) AS i FROM body),
step AS (
  SELECT doc, section, i, page, kind, text, 0 AS para, page AS page0, kind AS kind0, text AS acc, NULL::VARCHAR AS why, confidence FROM rn WHERE i = 1
  UNION ALL
  SELECT doc, section, i, page, kind, text, CASE WHEN m IS NULL THEN para + 1 ELSE para END, CASE WHEN m IS NULL THEN page ELSE page0 END, CASE WHEN m IS NULL THEN kind ELSE kind0 END,
    CASE WHEN m IS NULL THEN text WHEN left_open THEN rtrim(acc, '-') || ltrim(text, '-') ELSE acc || ' ' || ltrim(text, '-') END, m, confidence
  FROM (SELECT r.*, s.para, s.page0, s.kind0, s.acc, ends_with(s.text, '-') AS left_open,
    CASE WHEN s.kind0 IN ('heading', 'table') OR r.kind IN ('heading', 'table') OR r.page - s.page0 NOT BETWEEN 0 AND 1 THEN NULL WHEN ends_with(s.text, '-') THEN 'hyphen'
      WHEN regexp_matches(s.text, '[.!?"'')\]]\s*$') THEN NULL WHEN r.page = s.page0 THEN 'same_page'
      WHEN regexp_matches(r.text, '^\p{{Ll}}') OR regexp_matches(r.text, '(?i)^(?:[-,;:)\]"'']|(?:{_WORDS})(?:$|[^\p{{L}}\p{{N}}_]))') THEN 'next_page' END AS m
    FROM step s JOIN rn r ON r.doc = s.doc AND r.section = s.section AND r.i = s.i + 1)),
paras AS (SELECT doc, section, para, any_value(kind0) AS kind, md5(trim(regexp_replace(regexp_replace(arg_max(acc, i), '([\p{{L}}\p{{N}}_])-\s+([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS text,
  min(page) AS page, max(page) AS page_end, round(min(confidence), 4) AS confidence, arg_max(coalesce(why, ''), i) AS origin, count(*) AS n_blocks FROM step GROUP BY doc, section, para)"""


def _blocks(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    df = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(lines).alias("nth", "text")).withColumn("nth", F.col("nth") + 1)
    bare = F.trim("text")
    kind = F.when(bare.rlike(_HEADING), "heading").when(bare.startswith("|"), "table").otherwise("body")
    return df.select("doc", F.expr("(nth - 1) div 12 + 1").alias("page"), "nth", kind.alias("kind"), "text", (1 - (F.col("nth") % 4) * 0.1).alias("confidence"))


@query(f"{_PARAS} SELECT p.doc, p.section, para, kind, p.text, page, page_end, confidence, origin, n_blocks, array_to_string(coalesce(path, []), ' > ') AS path FROM paras p LEFT JOIN paths h ON h.doc = p.doc AND h.section = p.section")
def doc03_paragraphs(spark, d):
    out = bl.paragraphs(_blocks(spark, d))
    return out.withColumns({"text": F.md5("text"), "path": F.array_join("path", " > "), "confidence": F.round("confidence", 4), "origin": F.coalesce("origin", F.lit(""))})


@query(None)
def doc04_section_chunks(spark, d):
    """Paragraphs packed to a word budget under their heading paths."""
    return bl.section_chunks(bl.paragraphs(_blocks(spark, d)))


@query(None)
def doc05_paged_sentence_chunks(spark, d):
    """Sentences packed with overlap under their heading paths, with the pages of their words."""
    return bl.sentence_chunks(bl.paragraphs(_blocks(spark, d)))
