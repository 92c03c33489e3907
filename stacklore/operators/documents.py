"""Document reconstruction, chunking and text quality."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_signature(line: Column) -> Column:
    s = F.regexp_replace(F.lower(line), r"\b(sayfa|page)\b", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\d+", "#"), "[^a-z0-9çğıöşü# ]+", " ")
    return F.trim(F.regexp_replace(s, " +", " "))


def page_lines(pages: DataFrame) -> DataFrame:
    """doc, page, nth, n, line of each non-blank line of pages (doc, page, text)."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    return pages.select("doc", "page", F.size(lines).alias("n"), F.posexplode(lines).alias("nth", "line"))


def repeated_margins(pages: DataFrame) -> DataFrame:
    """doc and signature of first or last lines that stand on at least max(3, a fifth) of the pages."""
    edge = page_lines(pages).where((F.col("nth") < 2) | (F.col("nth") >= F.col("n") - 2)).withColumn("sig", line_signature(F.col("line")))
    total = pages.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    out = edge.where("sig <> ''").groupBy("doc", "sig").agg(F.count_distinct("page").alias("on_pages")).join(total, "doc")
    return out.where(F.col("on_pages") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.2))).select("doc", "sig", "on_pages")


def without_margins(pages: DataFrame) -> DataFrame:
    lines = page_lines(pages).withColumn("sig", line_signature(F.col("line")))
    edge = (F.col("nth") < 2) | (F.col("nth") >= F.col("n") - 2)
    marked = lines.join(repeated_margins(pages).select("doc", "sig", F.lit(True).alias("margin")), ["doc", "sig"], "left")
    return marked.where(~(edge & F.coalesce("margin", F.lit(False)))).select("doc", "page", "nth", "line")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (doc, page, nth, line) joined where one ends in a hyphen, or without an end mark before a small letter."""
    w = Window.partitionBy("doc").orderBy("page", "nth")
    before = F.lag("line").over(w)
    goes_on = before.rlike(r"\p{L}-\s*$") | (~before.rlike(r"[.!?:;\"”)]\s*$") & F.col("line").rlike(r"^\s*\p{Ll}"))
    df = lines.withColumn("start", F.when(before.isNull() | ~goes_on, 1).otherwise(0))
    df = df.withColumn("para", F.sum("start").over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "nth", "line"))), lambda x: x["line"]), " ")
    return df.groupBy("doc", "para").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("lines"), F.regexp_replace(body, r"(\p{L})-\s+(\p{L})", "$1$2").alias("text"))


def word_budget_chunks(paras: DataFrame, target: int = 350, cap: int = 450) -> DataFrame:
    """Paragraphs (doc, para, text) packed in order: a chunk closes at ``target`` words, and before it would pass ``cap``."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cur, n, doc = [], [], 0, pdf["doc"].iloc[0]
        for text in pdf.sort_values("para")["text"]:
            words = (text or "").split()
            while words:
                part, words = words[:cap], words[cap:]
                if cur and n + len(part) > cap:
                    rows.append((doc, len(rows), " ".join(cur), n))
                    cur, n = [], 0
                cur += part
                n += len(part)
                if n >= target:
                    rows.append((doc, len(rows), " ".join(cur), n))
                    cur, n = [], 0
        if cur:
            rows.append((doc, len(rows), " ".join(cur), n))
        return pd.DataFrame(rows, columns=["doc", "chunk", "text", "words"])

    return paras.select("doc", "para", "text").groupBy("doc").applyInPandas(pack, "doc long, chunk long, text string, words long")


def sentence_chunks(docs: DataFrame, target: int = 350, cap: int = 450, overlap: int = 20) -> DataFrame:
    """Sentences of each text (doc, text) packed to ``target`` words, ``cap`` at most, each chunk led by the last ``overlap`` words of the one before."""

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                cur, k = [], 0
                for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
                    words = sentence.split()
                    while words:
                        room = cap - len(cur)
                        if len(words) > room and len(cur) > overlap:
                            rows.append((doc, k, " ".join(cur), len(cur)))
                            cur, k = cur[-overlap:], k + 1
                            continue
                        cur, words = cur + words[:room], words[room:]
                    if len(cur) >= target:
                        rows.append((doc, k, " ".join(cur), len(cur)))
                        cur, k = cur[-overlap:], k + 1
                if len(cur) > (overlap if k else 0):
                    rows.append((doc, k, " ".join(cur), len(cur)))
            yield pd.DataFrame(rows, columns=["doc", "chunk", "text", "words"])

    return docs.select("doc", "text").mapInPandas(run, "doc long, chunk long, text string, words long")


def collapsed(text: Column) -> Column:
    # a single blank is left alone: most of a text's white space is nothing to replace
    return F.trim(F.regexp_replace(text, r"\s{2,}|[\t\n\x0B\f\r]", " "))


#: What each flag takes off a chunk's score, in the order of the flags.
PENALTY = {
    "broken_start": 0.20, "broken_end": 0.20, "short_fragment": 0.25, "bibliography_like": 0.60, "toc_like": 0.60, "page_artifact": 0.35,
    "ocr_noise": 0.25, "title_repeat": 0.10, "author_repeat": 0.10, "heading_like": 0.18, "imprint_like": 0.22, "catalog_like": 0.40,
    "address_like": 0.35, "front_matter_marker_like": 0.22, "front_matter_like": 0.45, "orphan_fragment": 0.35,
}
#: Words and phrases that mark a kind of chunk.
CONNECTORS = ("ve", "veya", "ama", "ancak", "fakat", "lakin", "ile", "ki", "de", "da", "gibi", "icin", "için", "uzere", "üzere", "dolayisiyla", "dolayısıyla", "cunku", "çünkü", "zira", "oysa", "ise")
REFERENCE_WORDS = ("kaynakça", "kaynakca", "kaynaklar", "references", "bibliography", "index", "dizin", "referanslar")
TOC_WORDS = ("içindekiler", "icindekiler", "contents")
SECTION_WORDS = (
    "sunus", "sunuş", "onsoz", "önsöz", "giris", "giriş", "takdim", "icindekiler", "içindekiler", "sonsöz", "sonsoz", "prolog", "epilog",
    "bolum", "bölüm", "kisim", "kısım", "chapter", "preface", "foreword", "introduction",
)
IMPRINT_WORDS = ("yayınları", "yayinlari", "yayinevi", "publisher", "publishing", "press", "copyright", "isbn", "dergah", "dergâh")
FRONT_WORDS = ("yayınevimiz", "yayinevimiz", "baskı", "baski", "basım", "basim", "kapak", "sunuş")
FRONT_PHRASES = ("bu kitap", "bu roman", "bu dizinin", "dizisi içinde", "dizisi icinde", "yayınlamak kararındadır", "yayinlamak kararindadir")
ADDRESS_WORDS = (
    "mah", "mahallesi", "cadde", "caddesi", "sokak", "sk", "apt", "apartmanı", "apartmani", "blok", "kat", "posta", "istanbul", "ankara", "izmir",
    "tel", "telefon", "faks", "fax",
)
ADDRESS_PHRASES = ("iş merkezi", "is merkezi")
#: The letters that count as such, large and small.
LARGE, SMALL = "A-ZÇĞİÖŞÜ", "a-zçğıöşü"
#: Pages on which front matter stands, and the shortest title that is looked for.
EARLY, LEAST_TITLE = 12, 4


def folded(text: Column) -> Column:
    """Small letters, the Turkish ones without and with dot taken for one another."""
    return F.lower(F.translate(text, "İı", "ii"))


def _folded(words: tuple[str, ...]) -> list[str]:
    return list(dict.fromkeys(w.translate(str.maketrans("İı", "ii")).lower() for w in words))


def _phrases(phrases: tuple[str, ...], more: str = "") -> str:
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:(?:{'|'.join(_folded(phrases))})(?:$|[^\p{{L}}\p{{N}}_]){more})"


def literal_count(text: Column, part: Column) -> Column:
    """How often ``part`` stands in ``text``, letter by letter (no pattern), without overlaps."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part))) / F.length(part)).cast("long")).otherwise(0)


def _named(low: Column, name: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(F.length(name) >= LEAST_TITLE, literal_count(low, name)).otherwise(0)


def chunk_flags(text: Column, title: Column, author: Column, page: Column) -> list[dict[str, Column]]:
    """What the flags rest on, and the flags, as columns to add one after the other."""
    c = F.col
    has = lambda words: F.arrays_overlap(c("_words"), F.array(*map(F.lit, _folded(words))))
    holds = lambda phrases: reduce(or_, (c("_low").contains(p) for p in _folded(phrases)))
    short = lambda x: F.when((c("_n") > 0) & (c("_n") <= 12) & (F.length("_t") <= 120), x).otherwise(F.lit(False))
    letters, large = F.regexp_count("_t", F.lit(f"[{LARGE}{SMALL}]")), F.regexp_count("_t", F.lit(f"[{LARGE}]"))
    names = F.expr(f"regexp_extract_all(_t, \"[{LARGE}{SMALL}][{LARGE}{SMALL}'-]*\", 0)")
    capital = F.filter(names, lambda w: w.rlike(f"^[{LARGE}][{SMALL}'-]*[{SMALL}][{SMALL}'-]*$"))
    lines = F.filter(F.transform(F.split(c("_raw"), r"\r\n|\n|\r"), F.trim), lambda x: F.length(x) > 0)
    many = lambda pattern: F.size(F.filter("_lines", lambda x: x.rlike(pattern)))
    raw, low, n = c("_raw"), c("_low"), c("_n")
    item = r"\b\d{1,3}\s*[-–]"
    return [
        {"_raw": F.coalesce(text, F.lit("")), "_early": F.coalesce(page, F.lit(0)).between(1, EARLY)},
        {"_t": collapsed(raw)},
        {"_low": folded(c("_t")), "_n": F.regexp_count("_t", F.lit(f"[{LARGE}{SMALL}0-9]+")), "_all": F.split("_t", r"[^\p{L}\p{N}_]+")},
        {
            "_words": F.transform(F.array_distinct("_all"), folded),
            "_single": F.size(F.filter("_all", lambda w: (F.length(w) == 1) & w.rlike(f"[{LARGE}{SMALL}]"))),
            "_lines": F.when(raw.contains("\n") | raw.contains("\r"), lines).otherwise(F.array(F.trim(raw))),
            "_title": _named(F.lower("_t"), title),
            "_author": _named(F.lower("_t"), author),
            "broken_start": (F.length("_t") >= 40) & (c("_t").rlike(r"^\p{Ll}") | low.rlike(rf"^(?:{'|'.join(_folded(CONNECTORS))})(?:$|[^\p{{L}}\p{{N}}_])")),
            "broken_end": (F.length("_t") >= 80) & ~F.substring("_t", -1, 1).isin(*".!?…”\"')]"),
            "short_fragment": (F.length("_t") < 40) | (n < 6),
            "page_artifact": ((low.contains("page") | low.contains("sayfa")) & low.rlike(r"(?:^|[^\p{L}\p{N}_])(?:sayfa|page)\s*\d{1,4}(?:\s*/\s*\d{1,4})?(?:$|[^\p{L}\p{N}_])"))
            | ((F.length("_t") <= 12) & low.rlike(r"^#?\s*\d{1,4}$")),
            "heading_like": short(
                ~F.substring("_t", -1, 1).isin(*".!?…”\"')]")
                & ((large >= 0.68 * letters) & (letters > 0) | (n <= 8) & (F.size(capital) >= 0.85 * F.size(names)) & (F.size(names) > 0))
            ),
        },
        {
            "bibliography_like": has(REFERENCE_WORDS)
            | ((F.length(raw) < 900) & (F.regexp_count(raw, F.lit(r"\b(?:18|19|20)\d{2}\b")) >= 3))
            | (raw.contains("(") & (F.regexp_count(raw, F.lit(r"\([12]\d{3}[a-z]?\)")) >= 2))
            | ((F.size("_lines") >= 4) & (many(r",\s*\d+(?:,\s*\d+)*\s*$") >= 0.4 * F.size("_lines"))),
            "toc_like": has(TOC_WORDS) | ((F.size("_lines") >= 4) & (many(r"(?:\.{3,}|\s{3,})\s*\d{1,4}\s*$|^\d+(?:\.\d+)*\s+.+\s+\d{1,4}$") >= 3)),
            "ocr_noise": ((n > 0) & (c("_single") >= 0.18 * n))
            | (raw.rlike("[ÃÄ�~;]") & raw.rlike("Ã.|Ä.|�|~|<;|;[\\p{L}\\p{N}_]"))
            | ((c("_single") >= 5) & raw.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:[{LARGE}{SMALL}]\s+){{4,}}[{LARGE}{SMALL}](?:$|[^\p{{L}}\p{{N}}_])")),
            "title_repeat": c("_title") >= 2,
            "author_repeat": c("_author") >= 2,
            "imprint_like": has(IMPRINT_WORDS),
            "catalog_like": c("_early") & ((F.regexp_count(raw, F.lit(item)) >= 2) | (raw.rlike(item) & raw.contains("/") & (n <= 30))),
            "address_like": c("_early") & (has(ADDRESS_WORDS) | low.rlike(_phrases(ADDRESS_PHRASES, r"|no:[\p{L}\p{N}_]"))),
            "front_matter_marker_like": has(FRONT_WORDS) | (holds(FRONT_PHRASES) & low.rlike(_phrases(FRONT_PHRASES))),
        },
        {
            "front_matter_like": c("_early")
            & (
                c("heading_like") | c("imprint_like") | has(SECTION_WORDS) | c("front_matter_marker_like") | c("catalog_like") | c("address_like")
                | ((n <= 12) & ((c("_title") >= 1) | (c("_author") >= 1)))
            ),
            "orphan_fragment": c("broken_start") & (c("short_fragment") | c("_early") | (c("heading_like") & (n <= 16))),
        },
    ]


def chunk_quality(df: DataFrame) -> DataFrame:
    """flags (array, in fixed order), score, and whether to skip the chunk (text, title, page_number, and author where there is one).

    Title and author are counted letter by letter, whatever signs they hold; nulls count as empty.
    """
    given = df.columns
    author = F.col("author") if "author" in given else F.lit("")
    for step in chunk_flags(F.col("text"), F.col("title"), author, F.col("page_number")):
        df = df.withColumns(step)
    has = F.col
    off = {f: p for f, p in PENALTY.items() if f not in ("bibliography_like", "toc_like")}
    score = 1.0 - sum((F.when(has(f), p).otherwise(0.0) for f, p in off.items()), F.when(has("bibliography_like") | has("toc_like"), PENALTY["toc_like"]).otherwise(0.0))
    df = df.withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 3))
    skip = (
        (F.length("_t") == 0) | has("bibliography_like") | has("toc_like") | has("page_artifact") | has("front_matter_like") | has("imprint_like")
        | has("catalog_like") | has("address_like") | has("orphan_fragment")
        | (has("short_fragment") & (has("heading_like") | has("ocr_noise") | has("broken_start") | has("broken_end")))
        | (has("broken_start") & has("broken_end")) | (has("score") < 0.35)
    )
    listed = F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in PENALTY)))
    return df.select(*given, listed.alias("flags"), "score", skip.alias("skip"))


#: Flags of text that is no body, and what a chunk's score is cut to by broken edges and by noise in a short piece.
NO_BODY = ("bibliography_like", "toc_like", "page_artifact")
BOTH_EDGES, ONE_EDGE, SHORT_NOISE = 0.2, 0.45, 0.2


def integrity(df: DataFrame) -> DataFrame:
    """EMBED, REVIEW or QUARANTINE by score, which broken edges and short noise cut; what is no body scores nothing."""
    has = lambda f: F.array_contains("flags", f)
    start, end = has("broken_start"), has("broken_end")
    s = F.when(start & end, F.least("score", F.lit(BOTH_EDGES))).when(start | end, F.least("score", F.lit(ONE_EDGE))).otherwise(F.col("score"))
    s = F.when(has("short_fragment") & has("ocr_noise"), F.least(s, F.lit(SHORT_NOISE))).otherwise(s)
    empty = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    none = empty | F.arrays_overlap("flags", F.array(*map(F.lit, NO_BODY)))
    s = F.when(none, 0.0).otherwise(F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 2))
    return df.withColumn("integrity", s).withColumn("decision", F.when(s >= 0.65, "EMBED").when(s >= 0.4, "REVIEW").otherwise("QUARANTINE"))


#: Patterns of noise, points of one find and finds that count at most.
ISBN, LINK = r"(?i)\bISBN(?:-10|-13)?[:\s]*[\dX\-]{8,20}\b", r"(?i)(?:https?://|www\.)\S+"
PAGE_MARK = r"(?im)(?:^|\b)(?:sayfa|page)\s*\d{1,4}(?:\s*/\s*\d{1,4})?(?:\b|$)|^\s*\d{1,4}\s*$"
SOURCES = r"(?i)\b(?:kaynakça|references|bibliography|index|dizin)\b"
BARE_ISBN, BARE_LINK = r"(?i)ISBN(?:-10|-13)?:\s*[\d\-X]+", r"(?i)www\.[a-z0-9\-]+\.[a-z]{2,}(?:\.[a-z]{2,})?"
NOISE = {"isbn": (3, 3), "url": (2, 3), "page_artifact": (2, 5), "biblio_marker": (3, 3), "title_repeat": (2, 4), "author_repeat": (2, 4), "repeated_short_lines": (2, 5)}
LOUD, LOUD_LENGTH, STRIPPED = 0.45, 120, ((0.08, 1), (0.18, 2))


def noise(text: Column, title: Column, author: Column) -> Column:
    """struct(score, reasons): whole-number noise of a text and what it comes from.

    Names of four letters or more count from their second stand on, short lines that repeat once each.
    """
    raw = F.coalesce(text, F.lit(""))
    low = F.lower(raw)

    def again(name: Column) -> Column:
        n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
        return F.when(F.length(n) >= 4, F.floor((F.length(low) - F.length(F.replace(low, n, F.lit("")))) / F.length(n)) - 1).otherwise(0)

    lines = F.array_sort(F.filter(F.transform(F.split(raw, r"[\r\n]+"), lambda x: F.lower(F.trim(x))), lambda x: F.length(x).between(3, 80)))
    twice = F.size(F.array_distinct(F.filter(lines, lambda x, i: (i > 0) & (x == F.get(lines, i - 1)))))
    letters = F.regexp_count(raw, F.lit(r"\p{L}"))
    loud = (letters > 0) & (F.regexp_count(raw, F.lit(r"\p{Lu}")) >= LOUD * letters) & (F.length(raw) >= LOUD_LENGTH)
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, BARE_ISBN, ""), BARE_LINK, ""), r"\s+", " "))
    gone = (F.length(raw) - F.length(bare)) / F.greatest(F.length(raw), F.lit(1))
    count = lambda p: F.regexp_count(raw, F.lit(p))
    finds = dict(zip(NOISE, (count(ISBN), count(LINK), count(PAGE_MARK), count(SOURCES), again(title), again(author), twice)))
    found = F.array(*(F.greatest(n, F.lit(0)).cast("int") for n in finds.values()))

    def told(n: Column) -> Column:
        parts = [(F.least(n[k], F.lit(most)) * points) for k, (points, most) in enumerate(NOISE.values())]
        score = sum(parts, F.when(loud, 1).otherwise(0)) + sum((F.when(gone >= share, points).otherwise(0) for share, points in STRIPPED), F.lit(0))
        return F.struct(score.cast("int").alias("score"), F.array_compact(F.array(*(F.when(n[k] > 0, F.lit(name)) for k, name in enumerate(NOISE)))).alias("reasons"))

    return F.transform(F.array(found), told)[0]


def route_by_layer(stats: DataFrame) -> DataFrame:
    ok = (F.col("text_ratio") >= 0.70) & (F.col("avg_chars") >= 120) & (F.col("blank_ratio") <= 0.20) & (F.col("garbled_ratio") <= 0.12) & (F.col("image_ratio") <= 0.40)
    return stats.withColumn("route", F.when(ok, "TEXT_NATIVE").otherwise("OCR"))


def margin_report(df: DataFrame, k: int = 12) -> DataFrame:
    """Per item: chunks of each flag, and the ids of the first k flagged chunks."""
    each = df.select("item_id", "id", F.explode("flags").alias("flag"))
    counts = each.groupBy("item_id", "flag").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.lpad(F.col("id").cast("string"), 12, "0"))), 1, k), ",").alias("first_ids"))
    return counts
