"""Queries over documents, evidence and evaluation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import documents as dc
from stacklore.operators import evidence as ev
from stacklore.plans.searching import _L, _lists
from stacklore.sources.views import CONTENT, LOGS, content, logs, table


def _pages(spark, d):
    """Documents of a source as the pages of one text, each with a running head."""
    head = F.concat(F.lit("Running Head "), F.col("page_number").cast("string"), F.lit("\n"), F.col("text"))
    return content(spark, d).select(F.expr("CAST(substr(item_id, 4) AS BIGINT)").alias("doc"), F.col("id").alias("page"), head.alias("text"))


_SIG = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '\b(sayfa|page)\b', '', 'g'), '\d+', '#', 'g'), '[^a-z0-9çğıöşü# ]+', ' ', 'g'), ' +', ' ', 'g'))"
_LINES = rf"""{CONTENT}, pg AS (SELECT substr(item_id, 4)::BIGINT AS doc, id AS page, list_filter(string_split('Running Head ' || page_number || chr(10) || text, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM content),
l0 AS (SELECT doc, page, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS nth FROM pg), l AS (SELECT *, {_SIG} AS sig FROM l0),
m AS (SELECT doc, sig, count(DISTINCT page) AS on_pages FROM l WHERE sig <> '' AND (nth < 2 OR nth >= n - 2) GROUP BY ALL HAVING on_pages >= greatest(3, ceil((SELECT count(*) FROM pg p WHERE p.doc = l.doc) * 0.2)))"""
_LINES = _LINES.replace("HAVING on_pages >= greatest(3, ceil((SELECT count(*) FROM pg p WHERE p.doc = l.doc) * 0.2)))", "), t AS (SELECT doc, count(*) AS pages FROM pg GROUP BY 1), mm AS (SELECT doc, sig, on_pages FROM m JOIN t USING (doc) WHERE on_pages >= greatest(3, ceil(pages * 0.2)))")


@query(f"WITH {_LINES} SELECT doc, sig, on_pages FROM mm")
def doc01_repeated_margins(spark, d):
    return dc.repeated_margins(_pages(spark, d))


@query(f"WITH {_LINES} SELECT doc, page, nth, md5(line) AS line FROM l WHERE NOT ((nth < 2 OR nth >= n - 2) AND EXISTS (SELECT 1 FROM mm WHERE mm.doc = l.doc AND mm.sig = l.sig))")
def doc02_margin_removal(spark, d):
    return dc.without_margins(_pages(spark, d)).withColumn("line", F.md5("line"))


@query(None)
def doc04_word_budget_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("page"), "text")
    return dc.word_budget_chunks(dc.paragraphs(dc.page_lines(docs)))


@query(None)
def doc05_sentence_chunks(spark, d):
    return dc.sentence_chunks(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


def _listed(words):
    return "[" + ", ".join(f"'{w}'" for w in dc._folded(words)) + "]"


def _word(words):
    return f"list_has_any(words, {_listed(words)})"


_W, _NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
_LETTER = f"[{dc.LARGE}{dc.SMALL}]"
#: A chunk's title and author: "Book 7 - Author 2" names both.
_FLAGS = rf"""{CONTENT}, c AS (SELECT *, coalesce(text, '') AS raw, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, coalesce(page_number, 0) BETWEEN 1 AND 12 AS early,
  split_part(title, ' - ', 1) AS named, split_part(title, ' - ', 2) AS author FROM content),
w AS (SELECT *, lower(translate(t, 'İı', 'ii')) AS low, len(regexp_extract_all(t, '[{dc.LARGE}{dc.SMALL}0-9]+')) AS n, list_filter(list_transform(string_split_regex(raw, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: length(x) > 0) AS ls,
  len(list_filter(string_split_regex(raw, '{_NW}+'), lambda x: regexp_full_match(x, '{_LETTER}'))) AS single,
  CASE WHEN length(named) >= 4 THEN (length(lower(t)) - length(replace(lower(t), lower(named), ''))) / length(named) ELSE 0 END AS titles,
  CASE WHEN length(author) >= 4 THEN (length(lower(t)) - length(replace(lower(t), lower(author), ''))) / length(author) ELSE 0 END AS authors FROM c),
x AS (SELECT *, string_split_regex(low, '{_NW}+') AS words, NOT regexp_matches(t, '[.!?…”"'')\]]$') AS open_end, regexp_extract_all(t, '{_LETTER}[{dc.LARGE}{dc.SMALL}''-]*') AS names FROM w),
f AS (SELECT *, length(t) >= 40 AND (regexp_matches(t, '^\p{{Ll}}') OR list_contains({_listed(dc.CONNECTORS)}, regexp_extract(low, '^{_W}+'))) AS broken_start, length(t) >= 80 AND open_end AS broken_end,
  length(t) < 40 OR n < 6 AS short_fragment,
  {_word(dc.REFERENCE_WORDS)} OR (length(raw) < 900 AND len(regexp_extract_all(raw, '\b(?:18|19|20)\d{{2}}\b')) >= 3) OR len(regexp_extract_all(raw, '\([12]\d{{3}}[a-z]?\)')) >= 2
  OR (len(ls) >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, ',\s*\d+(?:,\s*\d+)*\s*$'))) >= 0.4 * len(ls)) AS bibliography_like,
  {_word(dc.TOC_WORDS)} OR (len(ls) >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.{{3,}}|\s{{3,}})\s*\d{{1,4}}\s*$') OR regexp_matches(x, '^\d+(?:\.\d+)*\s+.+\s+\d{{1,4}}$'))) >= 3) AS toc_like,
  regexp_matches(low, '(?:^|{_NW})(?:sayfa|page)\s*\d{{1,4}}(?:\s*/\s*\d{{1,4}})?(?:$|{_NW})') OR regexp_matches(low, '^#?\s*\d{{1,4}}$') AS page_artifact,
  (n > 0 AND single >= 0.18 * n) OR regexp_matches(raw, 'Ã.|Ä.|�|~|<;|;{_W}') OR regexp_matches(raw, '(?:^|{_NW})(?:{_LETTER}\s+){{4,}}{_LETTER}(?:$|{_NW})') AS ocr_noise,
  titles >= 2 AS title_repeat, authors >= 2 AS author_repeat,
  n > 0 AND n <= 12 AND length(t) <= 120 AND open_end AND ((len(regexp_extract_all(t, '{_LETTER}')) > 0 AND len(regexp_extract_all(t, '[{dc.LARGE}]')) >= 0.68 * len(regexp_extract_all(t, '{_LETTER}')))
  OR (n <= 8 AND len(names) > 0 AND len(list_filter(names, lambda x: regexp_matches(x, '^[{dc.LARGE}][{dc.SMALL}''-]*[{dc.SMALL}][{dc.SMALL}''-]*$'))) >= 0.85 * len(names))) AS heading_like,
  {_word(dc.IMPRINT_WORDS)} AS imprint_like, {_word(dc.SECTION_WORDS)} AS section,
  early AND (len(regexp_extract_all(raw, '\b\d{{1,3}}\s*[-–]')) >= 2 OR (regexp_matches(raw, '\b\d{{1,3}}\s*[-–]') AND contains(raw, '/') AND n <= 30)) AS catalog_like,
  early AND ({_word(dc.ADDRESS_WORDS)} OR regexp_matches(low, '(?:^|{_NW})(?:(?:{'|'.join(dc._folded(dc.ADDRESS_PHRASES))})(?:$|{_NW})|no:{_W})')) AS address_like,
  {_word(dc.FRONT_WORDS)} OR regexp_matches(low, '(?:^|{_NW})(?:{'|'.join(dc._folded(dc.FRONT_PHRASES))})(?:$|{_NW})') AS front_matter_marker_like FROM x),
g AS (SELECT *, early AND (heading_like OR imprint_like OR section OR front_matter_marker_like OR catalog_like OR address_like OR (n <= 12 AND (titles >= 1 OR authors >= 1))) AS front_matter_like,
  broken_start AND (short_fragment OR early OR (heading_like AND n <= 16)) AS orphan_fragment FROM f),
q AS (SELECT *, round(greatest(1 - CASE WHEN bibliography_like OR toc_like THEN 0.6 ELSE 0 END::DOUBLE - {" - ".join(f"{p}::DOUBLE * {k}::INT" for k, p in dc.PENALTY.items() if k not in ("bibliography_like", "toc_like"))}, 0), 3) AS score,
array_to_string(list_filter([{", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in dc.PENALTY)}], lambda x: x IS NOT NULL), ',') AS flags FROM g)"""


def _chunks(spark, d):
    part = lambda n: F.split_part(F.col("title"), F.lit(" - "), F.lit(n))
    return content(spark, d).withColumns({"author": part(2), "title": part(1)})


@query(f"WITH {_FLAGS} SELECT id, flags, score FROM q")
def doc07_chunk_quality(spark, d):
    return dc.chunk_quality(_chunks(spark, d)).select("id", F.array_join("flags", ",").alias("flags"), "score")


@query(f"""WITH {_FLAGS} SELECT id, length(t) = 0 OR bibliography_like OR toc_like OR page_artifact OR front_matter_like OR imprint_like OR catalog_like OR address_like OR orphan_fragment OR (short_fragment AND (heading_like OR ocr_noise OR broken_start OR broken_end)) OR (broken_start AND broken_end) OR score < 0.35 AS skip FROM q""")
def doc08_ingestion_gate(spark, d):
    return dc.chunk_quality(_chunks(spark, d)).select("id", "skip")


_SIS = """sis AS (SELECT id, CASE WHEN length(t) = 0 OR bibliography_like OR toc_like OR page_artifact THEN 0 ELSE round(least(CASE WHEN broken_start AND broken_end THEN least(score, 0.2) WHEN broken_start OR broken_end THEN least(score, 0.45) ELSE score END,
CASE WHEN short_fragment AND ocr_noise THEN 0.2 ELSE 1 END), 2) END AS s FROM q)"""


@query(f"WITH {_FLAGS}, {_SIS} SELECT id, s AS integrity, CASE WHEN s >= 0.65 THEN 'EMBED' WHEN s >= 0.4 THEN 'REVIEW' ELSE 'QUARANTINE' END AS decision FROM sis")
def doc09_integrity_decision(spark, d):
    return dc.integrity(dc.chunk_quality(_chunks(spark, d))).select("id", "integrity", "decision")


@query(rf"""WITH {CONTENT}, c AS (SELECT *, split_part(title, ' - ', 1) AS named, split_part(title, ' - ', 2) AS author, list_sort(list_filter(list_transform(string_split_regex(text, '[\r\n]+'), lambda x: lower(trim(x))), lambda x: length(x) BETWEEN 3 AND 80)) AS ls,
trim(regexp_replace(regexp_replace(regexp_replace(text, '{dc.BARE_ISBN}', '', 'g'), '{dc.BARE_LINK}', '', 'g'), '\s+', ' ', 'g')) AS bare, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{Lu}}')) AS large FROM content),
n AS (SELECT id, text, bare, letters, large, len(regexp_extract_all(text, '{dc.ISBN}')) AS a, len(regexp_extract_all(text, '{dc.LINK}')) AS b, len(regexp_extract_all(text, '{dc.PAGE_MARK}')) AS c, len(regexp_extract_all(text, '{dc.SOURCES}')) AS d,
CASE WHEN length(named) >= 4 THEN greatest((length(text) - length(replace(lower(text), lower(named), ''))) // length(named) - 1, 0) ELSE 0 END AS e, CASE WHEN length(author) >= 4 THEN greatest((length(text) - length(replace(lower(text), lower(author), ''))) // length(author) - 1, 0) ELSE 0 END AS f,
len(list_filter(list_distinct(ls), lambda x: len(list_filter(ls, lambda y: y = x)) > 1)) AS g FROM c)
SELECT id, least(a, 3) * 3 + least(b, 3) * 2 + least(c, 5) * 2 + least(d, 3) * 3 + least(e, 4) * 2 + least(f, 4) * 2 + least(g, 5) * 2 + (letters > 0 AND large >= 0.45 * letters AND length(text) >= 120)::INT
+ ((length(text) - length(bare)) / greatest(length(text), 1) >= 0.08)::INT + 2 * ((length(text) - length(bare)) / greatest(length(text), 1) >= 0.18)::INT AS noise,
array_to_string(list_filter([CASE WHEN a > 0 THEN 'isbn' END, CASE WHEN b > 0 THEN 'url' END, CASE WHEN c > 0 THEN 'page_artifact' END, CASE WHEN d > 0 THEN 'biblio_marker' END, CASE WHEN e > 0 THEN 'title_repeat' END,
CASE WHEN f > 0 THEN 'author_repeat' END, CASE WHEN g > 0 THEN 'repeated_short_lines' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n""")
def doc10_noise(spark, d):
    n = dc.noise(F.col("text"), F.col("title"), F.col("author"))
    return _chunks(spark, d).select("id", n.alias("n")).select("id", F.col("n.score").alias("noise"), F.array_join("n.reasons", ",").alias("reasons"))


_STATS = f"s AS (SELECT item_id, avg((length(text) >= 300)::INT) AS text_ratio, avg(length(text)) AS avg_chars, avg((length(text) < 60)::INT) AS blank_ratio, avg(contains(text, '&&&')::INT) AS garbled_ratio, avg(contains(text, '<')::INT) AS image_ratio FROM content GROUP BY 1)"


@query(f"WITH {CONTENT}, {_STATS} SELECT item_id, CASE WHEN text_ratio >= 0.7 AND avg_chars >= 120 AND blank_ratio <= 0.2 AND garbled_ratio <= 0.12 AND image_ratio <= 0.4 THEN 'TEXT_NATIVE' ELSE 'OCR' END AS route FROM s")
def doc11_layer_routing(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    n = F.length("text")
    stats = content(spark, d).groupBy("item_id").agg(
        share(n >= 300).alias("text_ratio"), F.avg(n).alias("avg_chars"), share(n < 60).alias("blank_ratio"),
        share(F.col("text").contains("&&&")).alias("garbled_ratio"), share(F.col("text").contains("<")).alias("image_ratio"),
    )
    return dc.route_by_layer(stats).select("item_id", "route")


@query(r"""WITH n AS (SELECT page_id AS id, url || ' kept' AS text, trim(regexp_replace(regexp_replace(url || ' kept', '(?i)\b(https?://|www\.)\S+', '', 'g'), '[ \t]{2,}', ' ', 'g')) AS fixed FROM pages) SELECT id, fixed FROM n WHERE fixed <> text""")
def doc13_batch_cleaning(spark, d):
    from stacklore.functions.text import strip_boilerplate

    old = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat("url", F.lit(" kept")).alias("text"))
    return old.withColumn("fixed", strip_boilerplate(F.col("text"))).where("fixed <> text").select("id", "fixed")


@query(f"WITH {CONTENT} SELECT id, sha256(lower(text)) AS hash FROM content WHERE content_type <> 'BOOK' UNION ALL SELECT id, 'known' FROM content WHERE content_type = 'BOOK'")
def doc14_derived_backfill(spark, d):
    c = content(spark, d).withColumn("hash", F.when(F.col("content_type") == "BOOK", "known"))
    return c.select("id", F.coalesce("hash", F.sha2(F.lower("text"), 256)).alias("hash"))


@query(f"""WITH {_FLAGS}, e AS (SELECT item_id, id, unnest(string_split(flags, ',')) AS flag FROM q WHERE flags <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, flag ORDER BY id) AS k FROM e)
SELECT item_id, flag, count(*) AS n, string_agg(lpad(id::VARCHAR, 12, '0'), ',' ORDER BY id) FILTER (k <= 12) AS first_ids FROM r GROUP BY ALL""")
def agg22_chunk_quality_report(spark, d):
    return dc.margin_report(dc.chunk_quality(_chunks(spark, d)))


@query("SELECT item_id AS id, 'SYNTHESIS' AS intent, 'LOW' AS complexity FROM benchmark WHERE len(regexp_extract_all(text, '\\S+')) > 3 UNION ALL SELECT item_id, 'FOLLOW_UP', 'LOW' FROM benchmark WHERE len(regexp_extract_all(text, '\\S+')) <= 3")
def evi01_question_intent(spark, d):
    intent, complexity = ev.question_intent(F.col("text"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), intent.alias("intent"), complexity.alias("complexity"))


#: The text with what the writer noted on English ones, and the parts of its score.
_SC = f"""{CONTENT}, a0 AS (SELECT *, lower(text || ' ' || CASE WHEN lang = 'en' THEN 'a note' ELSE '' END) AS t FROM content), a1 AS (SELECT *, contains(t, 'thing') OR contains(t, 'erth') AS kw FROM a0),
sc AS (SELECT id, page_number AS query_id, text, lang, kw::INT + 3 * (kw AND regexp_matches(t, '\\bis the\\b'))::INT + (kw AND contains(t, 'tion'))::INT + regexp_matches(t, '\\bthis\\b')::INT + (lang IS NOT DISTINCT FROM 'en')::INT + contains(t, 'nessa')::INT AS score, kw,
array_to_string(list_filter([CASE WHEN kw THEN 'KEYWORD_MATCH' END, CASE WHEN kw AND regexp_matches(t, '\\bis the\\b') THEN 'DEFINITIONAL' END, CASE WHEN kw AND contains(t, 'tion') THEN 'THEORY' END, CASE WHEN regexp_matches(t, '\\bthis\\b') THEN 'MODALITY' END,
CASE WHEN lang = 'en' THEN 'PERSONAL_COMMENT' END, CASE WHEN contains(t, 'nessa') THEN 'EVALUATIVE' END], lambda x: x IS NOT NULL), ',') AS features FROM a1), lv AS (SELECT *, CASE WHEN score >= 3 THEN 'A' WHEN score >= 1 THEN 'B' ELSE 'C' END AS level FROM sc)"""


def _scored(spark, d):
    c = content(spark, d).withColumn("comment", F.when(F.col("lang") == "en", "a note"))
    c = c.withColumn("a", ev.answerability(F.col("text"), F.col("comment"), ["thing", "erth"], r"\bis the\b", "tion", r"\bthis\b", "nessa"))
    kind = ev.passage_type(F.col("text"))
    return c.select("id", F.col("page_number").alias("query_id"), "text", "a.score", F.array_join("a.features", ",").alias("features"), kind["kind"].alias("kind")).withColumn("level", ev.level(F.col("score"), F.col("kind")))


@query(f"WITH {_SC} SELECT id, score, features FROM sc")
def evi02_answerability(spark, d):
    return _scored(spark, d).select("id", "score", "features")


_ADDED = ("", " nedir bu", " iki  teori", " tıpkı o", " bir gün", " insanlar", " bu demektir", " yaklaşımlar var")


@query(f"""WITH c AS (SELECT doc_id AS id, lower(text || [{", ".join(f"'{x}'" for x in _ADDED)}][doc_id % 8 + 1]) AS t FROM documents), k AS (SELECT id, CASE WHEN regexp_matches(t, '\\b(nedir|demektir)\\b|\\bo da\\s+|olarak tanımlan') THEN 'DEFINITION'
WHEN regexp_matches(t, 'iki\\s+(teori|görüş)|yaklaşım[\\p{{L}}]*\\s+var|birincisi.*ikincisi|felsefi\\s+olarak') THEN 'THEORY' WHEN regexp_matches(t, '\\bgibi\\b|tıpkı|benzer\\s+şekilde|sanki') THEN 'ANALOGY'
WHEN regexp_matches(t, 'yaşadım|gördüm|bir gün|hatırlıyorum') THEN 'SITUATIONAL' WHEN regexp_matches(t, 'toplum|kültür|genel\\s+olarak|insanlar') THEN 'SOCIETAL' END AS kind FROM c)
SELECT id, coalesce(kind, 'SITUATIONAL') AS kind, CASE WHEN kind IN ('DEFINITION', 'THEORY') THEN 'HIGH' ELSE 'MEDIUM' END AS quotability, CASE WHEN kind IS NULL THEN 0.5 WHEN kind IN ('DEFINITION', 'THEORY') THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM k""")
def evi03_passage_type(spark, d):
    """The kinds of documents that got a phrase of one of them at their end."""
    more = F.element_at(F.array(*map(F.lit, _ADDED)), (F.col("id") % 8 + 1).cast("int"))
    return content(spark, d).select("id", ev.passage_type(F.concat("text", more)).alias("p")).select("id", "p.kind", "p.quotability", "p.confidence")


@query(f"WITH {_SC} SELECT id, level FROM lv")
def evi04_level(spark, d):
    return _scored(spark, d).select("id", "level")


@query(f"WITH {_SC} SELECT query_id, CASE WHEN count_if(level = 'A') >= 2 THEN 'QUOTE' WHEN count_if(level = 'A') >= 1 OR count_if(level = 'B') >= 3 THEN 'HYBRID' ELSE 'SYNTHESIS' END AS mode FROM lv GROUP BY 1")
def evi05_answer_mode(spark, d):
    return ev.answer_mode(_scored(spark, d))


@query(f"""WITH RECURSIVE {_SC}, pl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place, score FROM lv WHERE id % 3 <> 0),
up AS (SELECT query_id, id, place, score, 0 AS depth FROM pl UNION ALL SELECT query_id, id // 2 + 1, max(place), max(score), any_value(depth) + 1 FROM up WHERE depth < 2 AND id % 5 = 0 GROUP BY query_id, id // 2 + 1),
p AS (SELECT query_id, id, arg_min(place, depth * 100000 + place) AS place, arg_min(score, depth * 100000 + place) AS score, min(depth) AS depth FROM up GROUP BY ALL),
j AS (SELECT p.query_id, p.id, place, p.score, depth, l.level, length(l.text) AS len, CASE WHEN p.id % 7 = 0 THEN 'GRAPH_RELATION' WHEN p.id % 11 = 0 THEN 'EXTERNAL_KB' ELSE 'BOOK' END AS kind, p.id % 10 / 10 AS g, ['SOCIETAL', 'DIRECT'][p.query_id % 2 + 1] AS intent FROM p JOIN lv l USING (id)),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS nth, CASE kind WHEN 'GRAPH_RELATION' THEN 1.5 + (g - 0.5) * 4 WHEN 'EXTERNAL_KB' THEN greatest(0.4, least(1.3, 0.2 * 3.2)) END::DOUBLE AS least_score FROM j),
s AS (SELECT * REPLACE (CASE WHEN least_score > score THEN least_score ELSE score END * pow(0.88, depth) AS score, CASE WHEN least_score > score THEN CASE WHEN kind = 'EXTERNAL_KB' THEN 'B' WHEN least_score >= 3 THEN 'A' WHEN least_score >= 1 THEN 'B' ELSE level END ELSE level END AS level) FROM a WHERE nth <= 100),
w AS (SELECT query_id, id, nth, round(score * CASE WHEN kind = 'EXTERNAL_KB' THEN 0.2 WHEN intent = 'SOCIETAL' THEN CASE WHEN len > 300 AND level <> 'A' THEN 1.2 ELSE 1 END WHEN level = 'A' THEN 1.2 WHEN level = 'B' THEN 0.9 WHEN len > 300 THEN 0.4 ELSE 1 END::DOUBLE
  * CASE WHEN kind = 'BOOK' THEN 1.1 ELSE 1 END::DOUBLE, 6) AS weight FROM s WHERE nth <= 40 OR score >= 2)
SELECT query_id, id, weight, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, nth) AS rank FROM w""")
def evi06_weighted_rank(spark, d):
    """Passages of a page, some of which hand their score to one above, with graph and outside sources among them."""
    lv, k = _scored(spark, d), F.col("id")
    hits = lv.where("id % 3 <> 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    parents = lv.where("id % 5 = 0").select(k.alias("child"), F.expr("id div 2 + 1").alias("parent")).unionByName(lv.where("id % 5 = 0 AND id < 0").select(k.alias("child"), k.alias("parent")))
    kind = F.when(k % 7 == 0, "GRAPH_RELATION").when(k % 11 == 0, "EXTERNAL_KB").otherwise("BOOK")
    pool = ev.with_parents(hits, parents, lv.select("id", "text", "level")).withColumns(
        {"source_type": kind, "graph_score": k % 10 / 10, "external_weight": F.lit(0.2), "intent": F.when(F.col("query_id") % 2 == 0, "SOCIETAL").otherwise("DIRECT"), "composition": F.when(kind == "BOOK", 1.1).otherwise(1.0)}
    )
    return ev.weighted_rank(pool).select("query_id", "id", "weight", "rank")


@query(rf"""{_L}, p AS (SELECT query_id, id, least(lx.score, 7) AS s, text, id % 50 = 0 AS prime, row_number() OVER (PARTITION BY query_id ORDER BY least(lx.score, 7) DESC, id) AS nth FROM lx JOIN content USING (id)),
t5 AS (SELECT query_id, avg(s) AS mean, bool_or(prime) AS prime, string_agg(lower(text), ' ' ORDER BY nth) AS texts FROM p WHERE nth <= 5 GROUP BY 1),
k AS (SELECT item_id AS query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda w: length(w) > 2)) AS w FROM benchmark),
c AS (SELECT b.item_id AS query_id, mean, coalesce(prime, false) AS prime, count(w) AS n, count(DISTINCT w) FILTER (contains(texts, w)) AS hit FROM benchmark b LEFT JOIN t5 ON t5.query_id = b.item_id LEFT JOIN k ON k.query_id = b.item_id GROUP BY ALL),
r AS (SELECT *, hit / greatest(n, 1) AS ratio FROM c)
SELECT query_id, CASE WHEN mean IS NULL THEN 'OUT_OF_NETWORK' WHEN prime AND ratio >= 0.5 OR mean >= 5 AND ratio >= 0.5 OR mean >= 3.5 AND ratio >= 0.7 OR mean >= 1 AND ratio >= 0.8 THEN 'IN_NETWORK' WHEN mean < 2 AND ratio < 0.8 THEN 'OUT_OF_NETWORK' ELSE 'HYBRID' END AS status,
round(coalesce(mean, 0) / 7, 4) AS confidence, round(CASE WHEN mean IS NULL THEN 0 ELSE ratio END, 4) AS coverage FROM r""")
def evi07_coverage_status(spark, d):
    """The test set as questions, held against the five best documents of each."""
    lx, _ = _lists(spark, d)
    c = content(spark, d).select("id", "text")
    pool = lx.select("query_id", "id", F.least("score", F.lit(7)).alias("score")).join(c, "id").withColumn("primary", F.col("id") % 50 == 0)
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]", ""), r"\s+"), lambda w: F.length(w) > 2)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("keywords"))
    return ev.coverage(asked, pool).select("query_id", "status", F.round("confidence", 4).alias("confidence"), F.round("coverage", 4).alias("coverage"))


_HIT = lambda ws: " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws)
_DOM = {"alpha": ["thing", "erth", "ther"], "beta": ["leau", "eaux"], "gamma": ["heit", "schen"]}


@query(f"""WITH h AS (SELECT doc_id AS id, {_HIT(_DOM['alpha'])} AS a, {_HIT(_DOM['beta'])} AS b, {_HIT(_DOM['gamma'])} AS c FROM documents), s AS (SELECT *, greatest(a, b, c) AS n, (a = greatest(a, b, c))::INT + (b = greatest(a, b, c))::INT + (c = greatest(a, b, c))::INT AS ties FROM h),
x AS (SELECT id, CASE WHEN n = 0 OR ties > 1 THEN 'AUTO' WHEN a = n THEN 'alpha' WHEN b = n THEN 'beta' ELSE 'gamma' END AS domain, CASE WHEN n = 0 OR ties > 1 THEN 0 ELSE round(least(0.92, 0.45 + 0.12::DOUBLE * n), 2) END AS confidence FROM s)
SELECT id, domain, confidence, CASE WHEN confidence >= 0.78 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band FROM x""")
def evi08_domain(spark, d):
    return ev.infer_domain(content(spark, d).select("id", "text"), _DOM).select("id", "domain", "confidence", "band")


@query("SELECT doc_id AS id, regexp_extract(text, '\"([^\"]+)\"', 1) AS term FROM documents WHERE regexp_matches(text, '\"([^\"]+)\"')")
def evi09_quoted_term(spark, d):
    term = F.regexp_extract("text", '"([^"]+)"', 1)
    return content(spark, d).withColumn("term", term).where("term <> ''").select("id", "term")


@query(f"WITH {LOGS} SELECT id, CASE WHEN result_count > 10 AND ms < 2000 THEN 'pass' WHEN NOT result_count > 10 AND NOT ms < 2000 THEN 'mixed' WHEN NOT result_count > 10 THEN 'retrieval' ELSE 'generation' END AS plane FROM logs")
def evi10_failure_plane(spark, d):
    return logs(spark, d).select("id", ev.failure_plane(F.col("result_count") > 10, F.col("ms") < 2000).alias("plane"))


@query(f"""WITH {LOGS}, r AS (SELECT tenant AS query_id, row_number() OVER (PARTITION BY tenant ORDER BY ms DESC, id) AS rank, (intent = 'purchase')::INT AS rel FROM logs), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM r WHERE rank <= 10)
SELECT query_id, round(coalesce(1 / min(rank) FILTER (rel > 0), 0), 6) AS mrr, round(CASE WHEN sum(rel) > 0 THEN sum(rel / log2(rank + 1)) / sum(rel / log2(best + 1)) ELSE 0 END, 6) AS ndcg FROM t GROUP BY 1""")
def eva01_ranking_metrics(spark, d):
    w = Window.partitionBy("tenant").orderBy(F.desc("ms"), "id")
    r = logs(spark, d).select(F.col("tenant").alias("query_id"), F.row_number().over(w).alias("rank"), (F.col("intent") == "purchase").cast("int").alias("rel"))
    return ev.ranking_metrics(r)


_SUM = "SELECT intent, count(*) AS n, round(avg((ms < 2000)::INT), 4) AS success, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(avg(result_count), 4) AS quality FROM logs"


def _summary(df):
    from stacklore.operators.reports import quantiles, rounded

    means = df.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ms") < 2000).cast("int")), 4).alias("success"), F.round(F.avg("result_count"), 4).alias("quality"))
    places = quantiles(df, "ms", {"p50": 0.5, "p95": 0.95}, "intent")
    return means.join(places, "intent", "left").select("intent", "n", "success", rounded(F.col("p50")).alias("p50"), rounded(F.col("p95")).alias("p95"), "quality")


@query(f"WITH {LOGS} {_SUM} GROUP BY 1")
def eva02_endpoint_summary(spark, d):
    return _summary(logs(spark, d))


@query(f"""WITH {LOGS}, a AS ({_SUM} WHERE created_at < TIMESTAMP '2024-01-16' GROUP BY 1), b AS ({_SUM} WHERE created_at >= TIMESTAMP '2024-01-16' GROUP BY 1), c AS (SELECT intent, round((b.quality - a.quality) / a.quality * 100, 2) AS gain, round((b.p95 - a.p95) / a.p95 * 100, 2) AS slower FROM a JOIN b USING (intent))
SELECT *, gain >= 5 AND slower <= 10 AS passed FROM c""")
def eva03_ab_comparison(spark, d):
    lg = logs(spark, d)
    return ev.compare_runs(_summary(lg.where("created_at < timestamp_ntz'2024-01-16 00:00:00'")), _summary(lg.where("created_at >= timestamp_ntz'2024-01-16 00:00:00'")), "intent")


@query(f"""WITH {LOGS}, a AS ({_SUM} WHERE created_at < TIMESTAMP '2024-01-16' GROUP BY 1), b AS ({_SUM} WHERE created_at >= TIMESTAMP '2024-01-16' GROUP BY 1),
c AS (SELECT avg(a.quality) AS qa, avg(b.quality) AS qb, avg(a.p95) AS la, avg(b.p95) AS lb FROM a JOIN b USING (intent) WHERE intent IN ('click', 'view')),
d AS (SELECT round((qb - qa) / qa * 100, 2) AS gain, round((lb - la) / la * 100, 2) AS slower FROM c) SELECT *, gain >= 5 AS quality_pass, slower <= 10 AS latency_pass, gain >= 5 AND slower <= 10 AS recommended FROM d""")
def eva03_overall(spark, d):
    """The two endpoints whose quality is known, taken together."""
    lg = logs(spark, d)
    return ev.recommended(_summary(lg.where("created_at < timestamp_ntz'2024-01-16 00:00:00'")), _summary(lg.where("created_at >= timestamp_ntz'2024-01-16 00:00:00'")), "intent", ("click", "view"))


@query("""WITH a AS (SELECT doc_id AS id, lang, trim(regexp_replace(lower(translate(text || CASE doc_id % 4 WHEN 0 THEN chr(10) || '## Karşıt  Görüşler' || chr(10) || '## Bağlamsal Kanıtlar' WHEN 1 THEN ' ## SONUÇ' ELSE '' END,
'çÇğĞıİöÖşŞüÜâÂîÎûÛéÉèÈêÊáÁàÀäÄíÍóÓôÔúÚñÑ', 'cCgGiIoOsSuUaAiIuUeEeEeEaAaAaAiIoOoOuUnN')), '\\s+', ' ', 'g')) AS t FROM documents),
m AS (SELECT *, CASE WHEN contains(t, '## karsit gorusler') AND contains(t, '## baglamsal kanitlar') THEN 'HYBRID' WHEN contains(t, '## sonuc') THEN 'SYNTHESIS' END AS mode, CASE WHEN id % 3 = 0 THEN 'HYBRID' WHEN id % 3 = 1 THEN 'QUOTE' END AS want FROM a),
f AS (SELECT id, mode, list_filter([CASE WHEN want IS NOT NULL AND mode IS NULL THEN 'mode_unknown' WHEN want <> mode THEN 'mode_mismatch:' || mode END, CASE WHEN NOT contains(t, 'the') THEN 'missing_required_phrase:Thé' END,
CASE WHEN NOT contains(t, lang) THEN 'missing_synthesis_signal:' || lang END, CASE WHEN contains(t, '***') THEN 'forbidden_phrase_present:***' END], lambda x: x IS NOT NULL) AS fs FROM m)
SELECT id, mode, array_to_string(fs, ',') AS failures, len(fs) = 0 AS passed FROM f""")
def eva04_rule_checks(spark, d):
    k = F.col("doc_id")
    heads = F.when(k % 4 == 0, "\n## Karşıt  Görüşler\n## Bağlamsal Kanıtlar").when(k % 4 == 1, " ## SONUÇ").otherwise("")
    cases = table(spark, d, "documents").select(
        k.alias("id"), F.concat("text", heads).alias("answer"), F.when(k % 3 == 0, "HYBRID").when(k % 3 == 1, "QUOTE").alias("expected_mode"),
        F.array(F.lit("Thé")).alias("must_quote"), F.array("lang").alias("must_synthesize"), F.array(F.lit("***")).alias("forbidden"),
    )
    return ev.rule_checks(cases).withColumn("failures", F.array_join("failures", ","))


@query("SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN quality = 0 AND toxic = 1 THEN 'mixed' WHEN quality = 0 THEN 'retrieval' ELSE 'generation' END AS plane, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM labels), 2) AS pct FROM labels GROUP BY 1")
def eva05_failure_summary(spark, d):
    from stacklore.operators.reports import share_by

    return share_by(table(spark, d, "labels").withColumn("plane", ev.failure_plane(F.col("quality") == 1, F.col("toxic") == 0)), "plane")


@query(rf"""WITH {CONTENT}, s AS (SELECT id AS answer_id, 1 AS nth, lower(text) AS content, title FROM content UNION ALL SELECT id - 1, 2, lower(text), title || ' again' FROM content),
c AS (SELECT id AS answer_id, 0 AS at, 1 AS nth, substr(replace(text, chr(10), ' '), 1, 120) AS line FROM content UNION ALL SELECT id, 1, 2, substr(replace(text, chr(10), ' '), 1, 90) FROM content UNION ALL SELECT id, 2, 9, 'more' FROM content
UNION ALL SELECT id, 3, 1, 'no book has these few words at all' FROM content UNION ALL SELECT id, 4, NULL, 'x' FROM content),
w AS (SELECT c.*, content, list_filter(string_split_regex(lower(trim(line)), '\s+'), lambda x: x <> '') AS ws FROM c LEFT JOIN s USING (answer_id, nth)),
r AS (SELECT *, content IS NOT NULL AND len(ws) > 5 AND len(list_filter(range(1, len(ws) - 4), lambda i: contains(content, array_to_string(ws[i : i + 4], ' ')))) > 0 AS run,
  len(list_intersect(list_distinct(ws), string_split_regex(content, '\s+'))) / greatest(len(list_distinct(ws)), 1) AS likeness FROM w),
k AS (SELECT answer_id, CASE WHEN content IS NULL THEN 0 WHEN run THEN 1 WHEN likeness >= 0.82 THEN 0.9 WHEN likeness >= 0.65 THEN 0.5 ELSE 0 END::DOUBLE AS score,
  CASE WHEN content IS NULL THEN 'wrong_source' WHEN run OR likeness >= 0.82 THEN NULL WHEN likeness >= 0.65 THEN 'hallucination_risk' ELSE 'fabricated_quote' END AS fault FROM r)
SELECT answer_id, round(avg(score), 4) AS score, count(*) AS n_citations, coalesce(string_agg(fault, ',' ORDER BY fault), '') AS violations FROM k GROUP BY 1""")
def eva06_citations(spark, d):
    """Answers that cite a text rightly, the next one, none that there is, its title with words it lacks, and a title that nobody has."""
    from stacklore.operators.citations import verified

    c = content(spark, d)
    line = F.translate("text", "\n", " ")
    said = lambda n: F.substr(line, F.lit(1), F.lit(n))
    answer = F.concat(said(120), F.lit(" [ID: 1]\n"), said(90), F.lit(" [ID:2]\nmore [ID: 9]\nno book has these few words at all [Kaynak: "), "title", F.lit("]\nx [Kaynak: qqq zzz]"))
    sources = c.select(F.col("id").alias("answer_id"), F.lit(1).cast("long").alias("nth"), "title", F.col("text").alias("content"))
    sources = sources.unionByName(c.select((F.col("id") - 1).alias("answer_id"), F.lit(2).cast("long").alias("nth"), F.concat("title", F.lit(" again")).alias("title"), F.col("text").alias("content")))
    out = verified(c.select(F.col("id").alias("answer_id"), answer.alias("answer")), sources)
    return out.select("answer_id", F.round("score", 4).alias("score"), "n_citations", F.array_join("violations", ",").alias("violations"))


@query("""WITH s AS (SELECT doc_id AS id, round((0.5::DOUBLE * quality + 0.3::DOUBLE * (1 - toxic) + 0.2::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 / 10 ELSE 0.5 END) / 1.0, 4) AS score,
(quality = 0)::INT + (toxic = 1)::INT + (doc_id % 2 = 0 AND doc_id % 10 < 5)::INT AS bad, CASE doc_id % 3 WHEN 0 THEN 0.05 WHEN 1 THEN -0.05 ELSE 0 END + CASE WHEN doc_id % 8 < 3 THEN -0.1 WHEN doc_id % 8 >= 5 THEN 0.05 ELSE 0 END AS move FROM labels),
p AS (SELECT *, greatest(least(0.65 + move, 0.75), 0.55)::DOUBLE AS pass_at FROM s), r AS (SELECT *, round(least(pass_at - 0.1, CASE WHEN bad >= 3 THEN 0.6 ELSE 0.5 END::DOUBLE), 4) AS retry_at FROM p)
SELECT id, score, round(pass_at, 4) AS pass_at, retry_at, CASE WHEN score >= round(pass_at, 4) THEN 'PASS' WHEN score >= retry_at THEN 'REGENERATE' ELSE 'DECLINE' END AS verdict FROM r""")
def eva08_rubric(spark, d):
    k = F.col("doc_id")
    intent = F.element_at(F.array(*map(F.lit, ("DIRECT", "SYNTHESIS", "NARRATIVE"))), (k % 3 + 1).cast("int"))
    s = table(spark, d, "labels").select(
        k.alias("id"), F.col("quality").cast("double").alias("q"), (1 - F.col("toxic")).cast("double").alias("t"), F.when(k % 2 == 0, k % 10 / 10).alias("m"), intent.alias("intent"), (k % 8).cast("double").alias("chunk_quality"),
    )
    return ev.rubric(s, {"q": 0.5, "t": 0.3, "m": 0.2})


@query(f"WITH {LOGS} SELECT intent, count(quality) AS rated, round(avg(quality), 4) AS rating FROM logs LEFT JOIN labels ON doc_id = id GROUP BY 1")
def eva09_feedback(spark, d):
    rated = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return logs(spark, d).join(rated, "id", "left").groupBy("intent").agg(F.count("quality").alias("rated"), F.round(F.avg("quality"), 4).alias("rating"))
