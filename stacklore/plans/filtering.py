"""Queries over filters."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import filters as fl
from stacklore.sources.views import CONTENT, ITEMS, LOGS, content, items, logs


def _c(where: str, extra: str = "") -> str:
    return f"WITH {ITEMS} SELECT c.id, c.content_type FROM content c {extra} WHERE {where}"


_T = ("id", "content_type")


@query(_c("content_type IN ('PDF','EPUB','PDF_CHUNK','BOOK','HIGHLIGHT','INSIGHT')"))
def flt01_resource_scope_book(spark, d):
    return fl.resource_scope(content(spark, d), "book").select(*_T)


@query(_c("EXISTS (SELECT 1 FROM items i WHERE i.tenant = c.tenant AND i.item_id = c.item_id AND coalesce(is_deleted, 0) = 0 AND item_type = 'MOVIE')"))
def flt01_resource_scope_movie(spark, d):
    return fl.resource_scope(content(spark, d), "MOVIE", items(spark, d)).select(*_T)


@query(_c("item_id = 'src3'"))
def flt02_item(spark, d):
    return fl.by_item(content(spark, d), " src3 ").select(*_T)


_VIS = """coalesce(search_visibility, 'DEFAULT') {} AND NOT (c.content_type = 'PERSONAL_NOTE' AND coalesce(upper(category), 'PRIVATE') IN ('PRIVATE','DAILY','BOOKMARK'))"""
_LJ = "LEFT JOIN items i ON i.tenant = c.tenant AND i.item_id = c.item_id"


@query(_c(_VIS.format("= 'DEFAULT'"), _LJ))
def flt03_visibility_default(spark, d):
    return fl.visible(content(spark, d), items(spark, d)).select(*_T)


@query(_c(_VIS.format("<> 'NEVER_RETRIEVE'"), _LJ))
def flt03_visibility_all(spark, d):
    return fl.visible(content(spark, d), items(spark, d), "all").select(*_T)


@query(_c("content_type = 'INSIGHT'"))
def flt04_content_type(spark, d):
    return fl.type_is(content(spark, d), "content_type", " insight").select(*_T)


@query(_c("content_type IN ('PDF','EPUB','PDF_CHUNK','BOOK_CHUNK')"))
def flt05_surface_pdf_only(spark, d):
    return fl.surface(content(spark, d), "PDF_ONLY").select(*_T)


@query(_c("content_type NOT IN ('PDF','EPUB','PDF_CHUNK','BOOK_CHUNK')"))
def flt05_surface_core(spark, d):
    return fl.surface(content(spark, d)).select(*_T)


@query(_c("NOT EXISTS (SELECT 1 FROM items i WHERE i.tenant = c.tenant AND i.item_id = c.item_id AND item_type = 'PERSONAL_NOTE' AND coalesce(upper(category), 'PRIVATE') IN ('PRIVATE','DAILY','BOOKMARK'))"))
def flt06_feed_notes_guard(spark, d):
    return fl.feed_notes(content(spark, d), items(spark, d), False).select(*_T)


@query(f"WITH {ITEMS} SELECT tenant, item_id FROM items WHERE category = 'IDEAS'")
def flt07_category(spark, d):
    known = items(spark, d).withColumn("categories", F.when(F.col("category").isNotNull(), F.array(F.concat(F.lit(" "), F.col("category")))))
    return fl.in_category(known, "Ideas ").select("tenant", "item_id")


@query("SELECT doc_id AS id FROM documents WHERE contains(text, '%%%')")
def flt08_literal_substring(spark, d):
    return content(spark, d).where(fl.has_literal(F.col("text"), "%%%")).select("id")


@query("SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])thing($|[^a-z0-9])')")
def flt09_whole_term(spark, d):
    return content(spark, d).where(fl.whole_term(F.lower("text"), "thing")).select("id")


@query("""SELECT doc_id AS id, len(regexp_extract_all(' ' || lower(text), '[^a-z0-9]thin')) + len(regexp_extract_all(' ' || lower(text), '[^a-z0-9]erth')) AS hits
FROM documents WHERE regexp_matches(' ' || lower(text), '[^a-z0-9](thin|erth)')""")
def flt10_stem_hits(spark, d):
    hits = fl.stem_hits(F.lower("text"), ["thin", "erth", "on"])
    return content(spark, d).select("id", hits.cast("long").alias("hits")).where("hits > 0")


@query("SELECT doc_id AS id FROM documents WHERE list_has_all(string_split_regex(lower(text), '\\s+'), ['the', 'thing'])")
def flt11_all_tokens(spark, d):
    return content(spark, d).where(fl.all_tokens(F.split(F.lower("text"), r"\s+"), ["the", "thing", "x"])).select("id")


@query(f"""WITH {CONTENT} SELECT id FROM content WHERE NOT contains(lower(text), 'website deneme') AND NOT (contains(lower(title), 'deneme') AND length(trim(text)) < 180)
AND length(trim(text)) >= CASE WHEN regexp_matches(lower(trim(text)), '^(title|author):') OR contains(lower(title), 'unknown') THEN 220
WHEN content_type IN ('PERSONAL_NOTE', 'HIGHLIGHT', 'INSIGHT') THEN 15 WHEN content_type IN ('ARTICLE', 'WEBSITE') THEN 100 ELSE 60 END""")
def flt12_noise_guard(spark, d):
    return content(spark, d).where(fl.semantic_quality(F.col("text"), F.col("title"), F.col("content_type"))).select("id")


@query("SELECT doc_id AS id FROM documents WHERE length(text) < 600")
def flt13_short_band(spark, d):
    return content(spark, d).where(fl.length_band(F.col("text"), "SHORT")).select("id")


@query("SELECT doc_id AS id FROM documents WHERE length(trim(text)) >= 12")
def flt14_minimum_content(spark, d):
    return content(spark, d).where(fl.enough_text(F.col("text"))).select("id")


@query("SELECT doc_id AS id FROM documents d WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.embedding IS NOT NULL)")
def flt15_vector_present(spark, d):
    from stacklore.sources.views import vectors

    return content(spark, d).join(vectors(spark, d).where("vec IS NOT NULL"), "id", "left_semi").select("id")


@query(f"""WITH {LOGS}, s AS (SELECT id, tenant AS query_id, ms / 100 AS score FROM logs),
r AS (SELECT *, score >= greatest(2.0, 0.35 * max(score) OVER (PARTITION BY query_id)) AS ok,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM s)
SELECT id, query_id FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM r) WHERE ok OR (NOT any_ok AND nth <= 4)""")
def flt16_tail_floor(spark, d):
    scored = logs(spark, d).select("id", F.col("tenant").alias("query_id"), (F.col("ms") / 100).alias("score"))
    return fl.tail_floor(scored, 4).select("id", "query_id")


@query(f"WITH {LOGS} SELECT id, created_at FROM logs WHERE created_at > TIMESTAMP '2024-01-30 12:00:00' ORDER BY created_at DESC, id DESC LIMIT 50")
def flt17_latest_window(spark, d):
    return fl.since(logs(spark, d), "created_at", "2024-01-30 12:00:00", 50).select("id", "created_at")
