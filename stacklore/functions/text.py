"""Text functions as column expressions (a pandas step only where no built-in exists)."""

from __future__ import annotations

import functools
import operator
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters folded to ASCII.
FOLD_FROM, FOLD_TO = "ışçğüöâîû", "iscguoaiu"


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def normalize_canonical(text: Column) -> Column:
    """Lower-cased by Turkish rules, without punctuation, blanks collapsed."""
    bare = F.regexp_replace(turkish_lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(F.coalesce(bare, F.lit("")), r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """The canonical form with Turkish letters folded to ASCII."""
    return F.translate(normalize_canonical(text), FOLD_FROM, FOLD_TO)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


MOJIBAKE = "[ÃÄÅâ]"


@F.pandas_udf(StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    """UTF-8 read as Latin-1 or cp1252, read again; the candidate with the fewest markers wins."""

    def fix(t: str | None) -> str | None:
        if t is None:
            return None
        options = [t]
        for wrong in ("latin-1", "cp1252"):
            try:
                options.append(t.encode(wrong).decode("utf-8"))
            except UnicodeError:
                continue
        marks = lambda s: (sum(s.count(c) for c in "ÃÄÅâ�"), -sum(s.count(c) for c in "çğıöşüÇĞİÖŞÜ"))
        return min(options, key=marks)

    return text.map(fix)


#: Suffixes of words, and the wider list for words without marks.
SUFFIXES = (
    "dır", "dir", "dur", "dür", "tır", "tir", "tur", "tür", "ın", "in", "un", "ün", "nın", "nin", "nun", "nün", "ı", "i", "u", "ü", "yı", "yi", "yu", "yü",
    "a", "e", "ya", "ye", "da", "de", "ta", "te", "dan", "den", "tan", "ten", "lar", "ler", "lı", "li", "lu", "lü", "sız", "siz", "suz", "süz",
)
STEM_SUFFIXES = (
    "lerinden", "larindan", "lerimiz", "larimiz", "lerin", "larin", "lere", "lara", "leri", "lari", "lerden", "lardan", "inin", "unun", "inden", "indan",
    "undan", "unden", "imiz", "umuz", "siniz", "sunuz", "daki", "deki", "ndeki", "ndan", "nden", "nin", "nun", "dan", "den", "dir", "dur", "tir", "tur",
    "lik", "luk", "li", "lu", "ci", "cu", "si", "su", "im", "um", "in", "un", "de", "da", "te", "ta", "e", "a", "i", "u",
)


def strip_suffix(word: Column) -> Column:
    """The word in small letters without its longest listed suffix, if more than two letters stay; words of three letters are kept."""
    stripped = F.regexp_replace(F.lower(word), f"^(.{{3,}}?)({'|'.join(sorted(SUFFIXES, key=len, reverse=True))})$", "$1")
    return F.when(F.length(word) < 4, word).otherwise(stripped)


def stems(word: Column) -> Column:
    """The word without marks, and each form of it without a listed suffix that leaves three letters, in letter order; none of a shorter word."""
    w = F.translate(F.lower(word), FOLD_FROM, FOLD_TO)
    cut = (F.when(F.endswith(w, F.lit(s)) & (F.length(w) >= len(s) + 3), F.substr(w, F.lit(1), F.length(w) - len(s))) for s in STEM_SUFFIXES)
    every = F.array_sort(F.array_distinct(F.array_compact(F.array(w, *cut))))
    return F.when(F.length(w) >= 3, every).otherwise(F.array().cast("array<string>"))


def keywords(text: Column, stop: tuple[str, ...], least: int = 4) -> Column:
    """Words that are no stop words and long enough; the longest word if none is left."""
    words = F.filter(F.split(normalize_text(text), " "), lambda w: F.length(w) > 0)
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)))
    longest = F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), 1, 1)
    return F.when(F.size(kept) > 0, kept).otherwise(longest)


#: Entities that pages use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def markup_to_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|table|tr|td|th)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{2,}", "\n"))


def header_field(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, rf"(?im)^{name}:[ \t]*(.*)$", 1)
    return F.when(F.length(found) > 0, F.trim(found))


def labels_of(text: Column) -> Column:
    """A JSON array, or a list with commas, semicolons or lines, as distinct (raw, norm) pairs."""
    parts = F.coalesce(F.from_json(text, "array<string>"), F.split(text, r"[,;\n]"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(p).alias("raw"), F.substring(normalize_text(p), 1, 255).alias("norm")))
    pairs = F.filter(pairs, lambda p: p["norm"] != "")
    seen = F.transform(pairs, lambda p: p["norm"])
    return F.filter(pairs, lambda p, i: F.array_position(seen, p["norm"]) == i + 1)


def snippet(text: Column, needle: str, reach: int = 150) -> Column:
    """The first hit with ``reach`` characters on either side, and dots where text is left out."""
    at = F.instr(F.lower(text), needle)
    begin = F.greatest(at - reach, F.lit(1))
    end = at + len(needle) + reach
    body = text.substr(begin, end - begin)
    return F.when(at > 0, F.concat(F.when(begin > 1, "...").otherwise(""), body, F.when(end <= F.length(text), "...").otherwise("")))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_canonical(text), 256)


def compact_isbn(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9Xx]", ""))


def _weighted(digits: Column, weights: list[int]) -> Column:
    each = F.zip_with(F.split(digits, ""), F.array(*map(F.lit, weights)), lambda c, w: F.when(c == "X", 10).otherwise(F.expr("0") + c.try_cast("int")) * w)
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def valid_isbn(text: Column) -> Column:
    """The compact ISBN if its check digit is right, else null."""
    c = compact_isbn(text)
    ten = c.rlike("^[0-9]{9}[0-9X]$") & (_weighted(c, list(range(10, 0, -1))) % 11 == 0)
    thirteen = c.rlike("^[0-9]{13}$") & (_weighted(c, [1, 3] * 6 + [1]) % 10 == 0)
    return F.when(ten | thirteen, c)


def isbn_as_13(text: Column) -> Column:
    c = valid_isbn(text)
    core = F.concat(F.lit("978"), F.substring(c, 1, 9))
    check = F.pmod(10 - _weighted(core, [1, 3] * 6) % 10, F.lit(10))
    return F.when(F.length(c) == 13, c).when(F.length(c) == 10, F.concat(core, check.cast("string")))


def isbn_as_10(text: Column) -> Column:
    """The ten-digit form of a valid ISBN; null for one that begins with other than 978."""
    c = valid_isbn(text)
    core = F.substring(c, 4, 9)
    check = F.pmod(11 - _weighted(core, list(range(10, 1, -1))) % 11, F.lit(11))
    ten = F.concat(core, F.when(check == 10, "X").otherwise(check.cast("string")))
    return F.when(F.length(c) == 10, c).when((F.length(c) == 13) & c.startswith("978"), ten)


def equivalent_isbns(text: Column) -> Column:
    """A valid ISBN and its other form, the ten digits first (they may begin with 978 themselves); empty where it is none."""
    return F.array_distinct(F.array_compact(F.array(isbn_as_10(text), isbn_as_13(text))))


def academic(tags: Column, kind: Column, url: Column, known: tuple[str, ...]) -> Column:
    """Whether an item is of a scholarly kind: by one of the ``known`` tags, as an article, or by a DOI in its address."""
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    by_tag = F.arrays_overlap(own, F.array(*(F.lit(k.strip().lower()) for k in known))) if known else F.lit(False)
    return F.coalesce(by_tag, F.lit(False)) | (F.upper(F.trim(F.coalesce(kind, F.lit("")))) == "ARTICLE") | doi(F.coalesce(url, F.lit(""))).isNotNull()


def doi(text: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[-._;()/:a-z0-9]+)", 1), r"[).,;]+$", "")
    return F.when(F.length(found) > 0, found)


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.ceil(words * 1.3), F.lit(1))


def age_label(ts: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60)
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h")))
        .when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def progress(page: Column, pages: Column) -> Column:
    share = page / F.nullif(pages, F.lit(0))
    return F.when(pages != 0, F.round(100 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))))


def ocr_repair(text: Column) -> Column:
    """Hyphen breaks joined, spacing mended; the text as it was if more than a tenth changed."""
    t = F.regexp_replace(text, r"(\p{L})-\s*\n\s*(\p{L})", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([,.;:!?])", "$1"), r"[ \t]{2,}", " ")
    return F.when(F.abs(F.length(t) - F.length(text)) <= 0.1 * F.length(text), t).otherwise(text)


def strip_boilerplate(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?i)\bISBN[:\s]*[0-9Xx-]{10,17}", "")
    t = F.regexp_replace(t, r"(?i)\b(https?://|www\.)\S+", "")
    return F.trim(F.regexp_replace(t, r"[ \t]{2,}", " "))


#: Cyrillic letters and their Latin forms, one to one and one to many.
CYRILLIC = (
    "абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye",
    {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ё": "yo", "ь": "", "ъ": ""},
)


def cyrillic_to_latin(text: Column) -> Column:
    one, to, many = CYRILLIC
    t = F.translate(F.lower(text), one, to)
    for c, s in many.items():
        t = F.replace(t, F.lit(c), F.lit(s))
    return t


def has_arabic(text: Column) -> Column:
    return text.rlike(r"\p{IsArabic}")


#: Common words of the two languages, English words of tags, and parts of Turkish publishers' names.
TR_STOP = ("ve", "ile", "bir", "bu", "için", "olan", "olarak", "de", "da", "ama", "fakat", "gibi", "çok", "daha", "ancak", "üzerine", "kitap", "eser")
EN_STOP = ("the", "and", "of", "to", "in", "for", "with", "on", "about", "from", "book", "work", "this", "that", "is", "are", "was", "were")
EN_TAGS = ("political", "philosophy", "social", "contract", "society", "ethics", "theory", "history", "economics", "psychology", "law", "state")
TR_PUBLISHERS = ("yayın", "yayin", "yayinevi", "yayınları", "yayinlari", "kitabevi")


#: Ends of English words.
ENGLISH_ENDS = ("tion", "ment", "ness", "ship")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def language_scores(text: Column) -> Column:
    """struct(language, confidence, tr, en): letters, stop words, tag words, English word ends and publishers' names. Null and blank texts have no language."""
    value = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    ends = lambda w: functools.reduce(operator.or_, (w.endswith(e) for e in ENGLISH_ENDS))
    # few words tell anything, so the others are passed over once
    telling = lambda words: F.filter(words, lambda w: w.isin(*dict.fromkeys((*TR_STOP, *EN_STOP, *EN_TAGS))) | ends(w))
    split = lambda v: F.filter(F.split(F.lower(F.regexp_replace(v, "[^a-zA-ZçğıöşüÇĞİÖŞÜ']+", " ")), " "), lambda w: w != "")

    def counted(v: Column) -> Column:
        marks = F.length(v) - F.length(F.translate(v, "çğıöşüÇĞİÖŞÜ", ""))
        named = _once(F.lower(v), lambda low: F.coalesce(*(F.when(low.contains(h), 0.8) for h in TR_PUBLISHERS), F.lit(0.0)))
        words = _once(split(v), lambda words: F.struct(F.greatest(F.size(words), F.lit(1)).alias("n"), telling(words).alias("telling")))
        return F.struct((marks / F.greatest(F.length(v), F.lit(1))).alias("marks"), named.alias("named"), words.alias("words"))

    def scored(c: Column) -> Column:
        share = lambda known: F.size(F.filter(c["words"]["telling"], lambda w: w.isin(*known))) / c["words"]["n"]
        tr = c["marks"] * 3.0 + share(TR_STOP) * 1.3 + c["named"]
        en = share(EN_STOP) * 1.5 + share(EN_TAGS) * 1.1 + 0.25 * F.size(F.filter(c["words"]["telling"], ends))
        return F.struct(tr.alias("tr"), en.alias("en"))

    def told(s: Column) -> Column:
        tr, en = s["tr"], s["en"]
        top, gap = F.greatest(tr, en), F.abs(tr - en)
        sure = (top >= 0.25) & (gap >= 0.12)
        return F.struct(
            F.when(sure, F.when(tr > en, "tr").otherwise("en")).alias("language"),
            F.when(sure, F.round(F.least(gap / F.greatest(top, F.lit(0.25)), F.lit(1.0)), 4)).otherwise(0.0).alias("confidence"),
            F.round(tr, 4).alias("tr"), F.round(en, 4).alias("en"),
        )

    return _once(value, lambda v: _once(counted(v), lambda c: _once(scored(c), told)))


#: Names of the two languages in a hint, and how sure each source of a language is.
LANGUAGE_NAMES = {"tr": ("tr", "turkish", "turkce", "türkçe"), "en": ("en", "english", "ingilizce")}
SURE = {"mode_override": 1.0, "source_language_hint": 0.8, "publisher_hint_tr": 0.9, "default_fallback_tr": 0.1}


def resolved_language(mode: Column, hint: Column, publisher: Column, title: Column, author: Column) -> Column:
    """struct(language, confidence, reason): what is set for the record, else a hint of its source, a Turkish publisher,
    what its publisher, title and author are written in, and Turkish at last. Summaries and tags have no say."""
    told = lambda lang, sure, why: F.struct(lang.alias("language"), sure.alias("confidence"), F.lit(why).alias("reason"))
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    arms = [F.when(F.upper(clean(mode)) == x.upper(), told(F.lit(x), F.lit(SURE["mode_override"]), f"mode_override_{x}")) for x in LANGUAGE_NAMES]
    arms += [F.when(F.lower(clean(hint)).isin(*names), told(F.lit(x), F.lit(SURE["source_language_hint"]), "source_language_hint")) for x, names in LANGUAGE_NAMES.items()]
    turkish = F.coalesce(*(F.when(F.lower(clean(publisher)).contains(h), True) for h in TR_PUBLISHERS), F.lit(False))
    arms.append(F.when(turkish, told(F.lit("tr"), F.lit(SURE["publisher_hint_tr"]), "publisher_hint_tr")))
    found = language_scores(F.concat_ws("\n", clean(publisher), clean(title), clean(author)))
    arms.append(F.when(found["language"].isNotNull(), told(found["language"], found["confidence"].cast("double"), "metadata_signal")))
    return F.coalesce(*arms, told(F.lit("tr"), F.lit(SURE["default_fallback_tr"]), "default_fallback_tr"))
