"""Queries over text functions."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.functions import text as t
from stacklore.operators import reports as rp
from stacklore.sources.views import CONTENT, ITEMS, LOGS, content, items, logs, table

_CANON = r"trim(regexp_replace(regexp_replace(lower(translate(text, 'Iİ', 'ıi')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_NORM = f"translate({_CANON}, 'ışçğüöâîû', 'iscguoaiu')"


def _docs(spark, d):
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


@query(f"SELECT doc_id AS id, md5({_NORM}) AS norm FROM documents")
def fun01_normalize_text(spark, d):
    return _docs(spark, d).select("id", F.md5(t.normalize_text(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id AS id, md5({_CANON}) AS norm FROM documents")
def fun02_normalize_canonical(spark, d):
    return _docs(spark, d).select("id", F.md5(t.normalize_canonical(F.col("text"))).alias("norm"))


@query("SELECT doc_id AS id, text AS fixed FROM documents WHERE regexp_matches(text, '[éèñüö]')")
def fun03_mojibake_repair(spark, d):
    broken = _docs(spark, d).where("text rlike '[éèñüö]'").select("id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return broken.select("id", t.repair_mojibake("text").alias("fixed"))


_SUF = "|".join(sorted(t.SUFFIXES, key=len, reverse=True))


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), c AS (SELECT word, s FROM w, unnest([{", ".join(f"'{x}'" for x in t.STEM_SUFFIXES)}]) u(s) WHERE ends_with(word, s) AND length(word) >= length(s) + 3),
a AS (SELECT word, list(substr(word, 1, length(word) - length(s))) AS cut FROM c GROUP BY 1)
SELECT word, regexp_replace(word, '^(.{{3,}}?)({_SUF})$', '\\1') AS stem, array_to_string(list_sort(list_distinct(list_concat([word], coalesce(cut, [])))), ',') AS stems FROM w LEFT JOIN a USING (word) WHERE length(word) > 3""")
def fun04_suffix_stem(spark, d):
    words = _docs(spark, d).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) > 3").distinct()
    return words.select("word", t.strip_suffix(F.col("word")).alias("stem"), F.array_join(t.stems(F.col("word")), ",").alias("stems"))


@query(f"""WITH n AS (SELECT item_id AS id, list_filter(string_split({_NORM}, ' '), lambda w: length(w) > 0) AS words FROM benchmark),
k AS (SELECT id, words, list_filter(words, lambda w: length(w) >= 4 AND w NOT IN ('with', 'this', 'that')) AS kept FROM n)
SELECT id, array_to_string(list_sort(CASE WHEN len(kept) > 0 THEN list_distinct(kept) ELSE [list_sort(list_transform(words, lambda w: {{'n': -length(w), 'w': w}}))[1].w] END), ' ') AS words FROM k""")
def fun05_keywords(spark, d):
    k = t.keywords(F.col("text"), ("with", "this", "that"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.array_sort(k), " ").alias("words"))


_HTML = r"html"
for _p, _r in ((r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|table|tr|td|th)[^>]*>", "\n"), (r"(?s)<[^>]+>", " ")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_r}', 'g')"
for _p, _r in t.ENTITIES:
    _HTML = "replace({}, '{}', '{}')".format(_HTML, _p, _r.replace("'", "''"))
_HTML = rf"trim(regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10), 'g'))"


@query(f"SELECT page_id AS id, md5({_HTML}) AS body FROM pages")
def fun06_markup_to_text(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5(t.markup_to_text(F.col("html"))).alias("body"))


@query(f"WITH {CONTENT} SELECT id, title, item_id AS tags FROM content")
def fun07_header_fields(spark, d):
    whole = F.concat(F.lit("Title: "), F.col("title"), F.lit("\nTAGS: "), F.col("item_id"), F.lit("\nContent/Notes: "), F.col("text"))
    return content(spark, d).withColumn("whole", whole).select("id", t.header_field(F.col("whole"), "title").alias("title"), t.header_field(F.col("whole"), "tags").alias("tags"))


@query("SELECT doc_id AS id, lang || ':' || lang || ',' || upper(source) || ':' || source AS labels FROM documents")
def fun08_label_lists(spark, d):
    text = F.when(F.col("id") % 2 == 0, F.format_string('["%s", "%s ", "%s"]', "lang", F.upper("source"), F.upper("lang"))).otherwise(F.format_string("%s; %s,%s!,,", "lang", F.upper("source"), "source"))
    pairs = F.transform(t.labels_of(text), lambda p: F.concat_ws(":", p["raw"], p["norm"]))
    return _docs(spark, d).select("id", F.array_join(pairs, ",").alias("labels"))


@query(f"""WITH {ITEMS}, a(norm, canonical) AS (VALUES ('private', 'Personal'), ('ideas', 'Thought')) SELECT tenant, item_id, canonical FROM items LEFT JOIN a ON norm = lower(category)""")
def fun09_category_canonical(spark, d):
    alias = spark.createDataFrame([("private", "Personal"), ("ideas", "Thought")], "norm string, canonical string")
    return items(spark, d).withColumn("norm", t.normalize_text(F.translate(F.col("category"), "I", "i"))).join(F.broadcast(alias), "norm", "left").select("tenant", "item_id", "canonical")


@query(f"""WITH {CONTENT} SELECT id, CASE content_type WHEN 'BOOK' THEN 'BOOK' WHEN 'PDF_CHUNK' THEN 'BOOK' WHEN 'HIGHLIGHT' THEN 'HIGHLIGHT' WHEN 'INSIGHT' THEN 'INSIGHT' ELSE 'PERSONAL_NOTE' END AS canonical FROM content""")
def fun10_type_canonical(spark, d):
    known = {"BOOK": "BOOK", "PDF_CHUNK": "BOOK", "PDF": "BOOK", "EPUB": "BOOK", "HIGHLIGHT": "HIGHLIGHT", "INSIGHT": "INSIGHT"}
    m = F.create_map(*(F.lit(x) for p in known.items() for x in p))
    return content(spark, d).select("id", F.coalesce(m[F.col("content_type")], F.lit("PERSONAL_NOTE")).alias("canonical"))


_IN = lambda words: ", ".join(f"'{w}'" for w in words)


_LANG = rf"""w AS (SELECT *, list_filter(string_split(lower(regexp_replace(v, '[^a-zA-ZçğıöşüÇĞİÖŞÜ'']+', ' ', 'g')), ' '), lambda x: x <> '') AS words FROM v),
s AS (SELECT *, len(regexp_extract_all(v, '[çğıöşüÇĞİÖŞÜ]')) / greatest(length(v), 1) * 3.0::DOUBLE + len(list_filter(words, lambda x: x IN ({_IN(t.TR_STOP)}))) / greatest(len(words), 1) * 1.3::DOUBLE + CASE WHEN regexp_matches(lower(v), '{"|".join(t.TR_PUBLISHERS)}') THEN 0.8 ELSE 0 END::DOUBLE AS tr,
len(list_filter(words, lambda x: x IN ({_IN(t.EN_STOP)}))) / greatest(len(words), 1) * 1.5::DOUBLE + len(list_filter(words, lambda x: x IN ({_IN(t.EN_TAGS)}))) / greatest(len(words), 1) * 1.1::DOUBLE + 0.25::DOUBLE * len(list_filter(words, lambda x: regexp_matches(x, '(tion|ment|ness|ship)$'))) AS en FROM w),
told AS (SELECT *, CASE WHEN greatest(tr, en) >= 0.25 AND abs(tr - en) >= 0.12 THEN CASE WHEN tr > en THEN 'tr' ELSE 'en' END END AS language,
CASE WHEN greatest(tr, en) >= 0.25 AND abs(tr - en) >= 0.12 THEN round(least(abs(tr - en) / greatest(tr, en, 0.25), 1), 4) ELSE 0 END AS confidence FROM s)"""


@query(rf"""WITH v AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS v FROM documents), {_LANG} SELECT id, language, confidence FROM told""")
def fun11_language_detect(spark, d):
    return _docs(spark, d).select("id", t.language_scores(F.col("text")).alias("s")).select("id", "s.language", "s.confidence")


@query(rf"""WITH r AS (SELECT doc_id AS id, CASE source WHEN 'src1' THEN 'TR' WHEN 'src2' THEN 'en' ELSE 'auto' END AS mode, CASE lang WHEN 'en' THEN CASE WHEN doc_id % 2 = 0 THEN ' English ' END WHEN 'de' THEN 'german' END AS hint,
CASE WHEN doc_id % 7 = 0 THEN 'Deniz Yayınları' WHEN doc_id % 7 = 1 THEN 'History Press' ELSE '' END AS publisher, trim(substr(text, 1, 120)) AS title, CASE WHEN doc_id % 3 = 0 THEN 'Ayşe Öğüt' ELSE '' END AS author FROM documents),
v AS (SELECT *, regexp_replace(publisher || chr(10) || title || chr(10) || author, '^\s+|\s+$', '', 'g') AS v FROM r), {_LANG}
SELECT id, CASE WHEN mode = 'TR' THEN 'tr' WHEN mode = 'en' THEN 'en' WHEN hint = ' English ' THEN 'en' WHEN publisher = 'Deniz Yayınları' THEN 'tr' ELSE coalesce(language, 'tr') END AS language,
CASE WHEN mode <> 'auto' THEN 1 WHEN hint = ' English ' THEN 0.8 WHEN publisher = 'Deniz Yayınları' THEN 0.9 WHEN language IS NOT NULL THEN confidence ELSE 0.1 END::DOUBLE AS confidence,
CASE WHEN mode <> 'auto' THEN 'mode_override_' || lower(mode) WHEN hint = ' English ' THEN 'source_language_hint' WHEN publisher = 'Deniz Yayınları' THEN 'publisher_hint_tr' WHEN language IS NOT NULL THEN 'metadata_signal' ELSE 'default_fallback_tr' END AS reason FROM told""")
def fun12_language_resolution(spark, d):
    """Records with a mode, a hint, a publisher, a title and an author, each of them only now and then."""
    k, src = F.col("id"), F.col("source")
    mode = F.when(src == "src1", "TR").when(src == "src2", "en").otherwise("auto")
    hint = F.when((F.col("lang") == "en") & (k % 2 == 0), " English ").when(F.col("lang") == "de", "german")
    publisher = F.when(k % 7 == 0, "Deniz Yayınları").when(k % 7 == 1, "History Press")
    p = t.resolved_language(mode, hint, publisher, F.substring("text", 1, 120), F.when(k % 3 == 0, "Ayşe Öğüt"))
    return _docs(spark, d).select("id", p.alias("p")).select("id", "p.language", "p.confidence", "p.reason")


@query("""SELECT doc_id AS id, CASE WHEN pos > 31 THEN '...' ELSE '' END || substr(text, greatest(pos - 30, 1), pos + 35 - greatest(pos - 30, 1)) || CASE WHEN pos + 35 <= length(text) THEN '...' ELSE '' END AS kwic
FROM (SELECT *, instr(lower(text), 'thing') AS pos FROM documents) WHERE pos > 0""")
def fun13_kwic(spark, d):
    return _docs(spark, d).select("id", t.snippet(F.col("text"), "thing", 30).alias("kwic")).where("kwic IS NOT NULL")


@query(f"SELECT doc_id AS id, sha256({_CANON}) AS hash FROM documents")
def fun14_content_hash(spark, d):
    return _docs(spark, d).select("id", t.content_hash(F.col("text")).alias("hash"))


@query("""WITH c AS (SELECT p_partkey AS id, lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS nine FROM part),
s AS (SELECT id, nine, (list_sum(list_transform(range(1, 10), lambda i: (11 - i) * substr(nine, i, 1)::INT))::INT) AS a, (list_sum(list_transform(range(1, 13), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END * substr('978' || nine, i, 1)::INT))::INT) AS b FROM c)
SELECT id, CASE WHEN (11 - a % 11) % 11 = (id % 10) THEN '978' || nine || ((10 - b % 10) % 10) END AS isbn13 FROM s""")
def fun15_isbn(spark, d):
    nine = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    raw = F.concat(F.lit("ISBN "), nine, F.lit("-"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), t.isbn_as_13(F.regexp_replace(raw, "ISBN ", "")).alias("isbn13"))


@query("""WITH p AS (SELECT p_partkey AS id, lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS nine FROM part),
s AS (SELECT *, (11 - list_sum([(11 - i) * substr(nine, i, 1)::INT for i in range(1, 10)]) % 11) % 11 AS c10, (10 - (38 + list_sum([CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END * substr(nine, i, 1)::INT for i in range(1, 10)])) % 10) % 10 AS c13 FROM p)
SELECT id, nine || CASE WHEN c10 = 10 THEN 'X' ELSE c10::VARCHAR END || ',' || '978' || nine || c13 AS isbns FROM s""")
def fun15_equivalent_isbns(spark, d):
    """Thirteen digits with their right check digit, and the ten digits of the same book."""
    nine = F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0")
    every = F.array(*(F.concat(F.lit("978-"), nine, F.lit(str(c))) for c in range(10)))
    found = F.array_distinct(F.flatten(F.transform(every, lambda x: t.equivalent_isbns(x))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(found, ",").alias("isbns"))


@query("SELECT doc_id AS id, '10.1000/' || source || '.' || doc_id AS doi, lang = 'fr' OR doc_id % 5 = 0 OR doc_id % 3 = 0 AS academic FROM documents")
def fun16_doi(spark, d):
    k = F.col("id")
    text = F.concat(F.lit("see https://doi.org/10.1000/"), F.col("source"), F.lit("."), k.cast("string"), F.lit(")., and"))
    kind, url = F.when(k % 5 == 0, "article").otherwise("BOOK"), F.when(k % 3 == 0, text)
    return _docs(spark, d).select("id", t.doi(text).alias("doi"), t.academic(F.array(F.lit("x"), F.col("lang")), kind, url, (" FR ",)).alias("academic"))


@query(f"WITH {CONTENT} SELECT id, string_split(title, ' - ')[1] AS name, string_split(title, ' - ')[2] AS author FROM content")
def fun17_title_author(spark, d):
    bare = F.regexp_replace(F.concat("title", F.lit(" (Highlight)")), r" \(\w+\)$", "")
    return content(spark, d).select("id", F.regexp_extract(bare, "^(.*) - (.*)$", 1).alias("name"), F.regexp_extract(bare, "^(.*) - (.*)$", 2).alias("author"))


@query(r"SELECT doc_id AS id, greatest(ceil(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE), 1)::BIGINT AS tokens FROM documents")
def fun18_token_estimate(spark, d):
    return _docs(spark, d).select("id", t.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(f"""WITH {LOGS}, m AS (SELECT id, created_at, (epoch(TIMESTAMP '2024-01-31')::BIGINT - floor(epoch(created_at))::BIGINT) // 60 AS mi FROM logs)
SELECT id, CASE WHEN mi < 60 THEN mi || 'm' WHEN mi < 1440 THEN (mi // 60) || 'h' WHEN mi < 10080 THEN (mi // 1440) || 'd' ELSE strftime(created_at, '%Y-%m-%d') END AS age FROM m""")
def fun19_age_label(spark, d):
    return logs(spark, d).select("id", t.age_label(F.col("created_at").cast("timestamp"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 400 <> 0 THEN round(100 * least(o_custkey / (o_orderkey % 400), 1)) END AS pct FROM orders")
def fun20_progress(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t.progress(F.col("o_custkey"), F.col("o_orderkey") % 400).alias("pct"))


@query("SELECT event_id AS id, coalesce((props->>'$.k')::BIGINT, -1) AS k FROM events WHERE (props->>'$.k')::BIGINT % 2 = 0")
def fun21_json_read(spark, d):
    k = F.coalesce(F.from_json("props", "k BIGINT")["k"], F.lit(-1))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), k.alias("k")).where("k % 2 = 0")


@query("SELECT s_suppkey AS id, 'tolstoy shchukin zhukov ' || s_suppkey AS latin, false AS arabic FROM supplier")
def fun22_scripts(spark, d):
    name = F.concat(F.lit("Толстой Щукин Жуков "), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), t.cyrillic_to_latin(name).alias("latin"), t.has_arabic(name).alias("arabic"))


_OCR = r"regexp_replace(regexp_replace(regexp_replace(text, '(\p{L})-\s*\n\s*(\p{L})', '\1\2', 'g'), '\s+([,.;:!?])', '\1', 'g'), '[ \t]{2,}', ' ', 'g')"


@query(f"SELECT doc_id AS id, md5(CASE WHEN abs(length(r) - length(text)) <= 0.1 * length(text) THEN r ELSE text END) AS repaired FROM (SELECT *, {_OCR} AS r FROM documents)")
def fun23_ocr_repair(spark, d):
    return _docs(spark, d).select("id", F.md5(t.ocr_repair(F.col("text"))).alias("repaired"))


@query(r"SELECT page_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(url || ' ISBN 978-1-4028-9462-6  end', '(?i)\bISBN[:\s]*[0-9Xx-]{10,17}', '', 'g'), '(?i)\b(https?://|www\.)\S+', '', 'g'), '[ \t]{2,}', ' ', 'g')) AS bare FROM pages")
def fun24_boilerplate(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), t.strip_boilerplate(F.concat("url", F.lit(" ISBN 978-1-4028-9462-6  end"))).alias("bare"))


VOCABULARY = "v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) > 2 GROUP BY 1)"


def _sign(word):
    """SQL: a number with a bit for each letter of a word of small letters."""
    return f"list_aggregate(list_transform(string_split({word}, ''), lambda c: 1::BIGINT << (ascii(c) - 97)), 'bit_or')"


def closest(words):
    """SQL: word and fix of the rows of ``words`` (word) by the dictionary of words that stand 20 times or more. The longest
    common subsequence is read off one number per step; ``at`` has the places of each letter of the fix."""
    return f"""ask AS (SELECT DISTINCT word, {_sign("word")} AS sign FROM {words} WHERE length(word) BETWEEN 3 AND 62), know AS (SELECT word AS fix, {_sign("word")} AS sign2, (1::HUGEINT << length(word)::INT) - 1 AS whole,
list_transform(range(97, 123), lambda c: list_sum(list_transform(range(1, length(word) + 1), lambda j: CASE WHEN ascii(substr(word, j::INT, 1)) = c THEN 1::HUGEINT << (j - 1)::INT ELSE 0 END))::HUGEINT) AS places FROM v WHERE n >= 20 AND length(word) <= 62),
near AS (SELECT word, fix, whole, places FROM ask JOIN know ON 5 * abs(length(word) - length(fix)) < length(word) + length(fix) AND 5 * bit_count(xor(sign, sign2)) < length(word) + length(fix) AND 5 * levenshtein(word, fix) < length(word) + length(fix)),
lcs AS (SELECT word, fix, length(fix) - bit_count(list_reduce(string_split(word, ''), lambda r, c: ((r + (r & places[ascii(c) - 96])) | (r - (r & places[ascii(c) - 96]))) & whole, whole)) AS lcs FROM near),
fixes AS (SELECT word, arg_max(fix, (common, -ord)) AS fix FROM (SELECT *, 200 * lcs / (length(word) + length(fix)) AS common, row_number() OVER (ORDER BY fix) AS ord FROM lcs) WHERE common > 80 GROUP BY 1)"""


def dictionary(spark, d):
    """The words of the corpus with their counts, and those that stand 20 times or more."""
    v = rp.vocabulary(_docs(spark, d), "([a-z]+)")
    return v, v.where("n >= 20").select(F.col("word").alias("fix"))


@query(f"WITH {VOCABULARY}, rare AS (SELECT word FROM v WHERE n < 20), {closest('rare')} SELECT word, fix FROM fixes")
def fun25_dictionary_correction(spark, d):
    """Every word of three letters or more that the dictionary lacks, with its closest word at a similarity above 80."""
    from stacklore.operators.spelling import closest_words

    v, known = dictionary(spark, d)
    return closest_words(v.where("n < 20"), known).select("word", "fix")
