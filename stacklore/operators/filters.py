"""Filters and predicates over content chunks and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Content types of each resource scope, and the types that count as PDF.
SCOPES = {
    "BOOK": ("PDF", "EPUB", "PDF_CHUNK", "BOOK", "HIGHLIGHT", "INSIGHT"),
    "ALL_NOTES": ("HIGHLIGHT", "INSIGHT"),
    "PERSONAL_NOTE": ("PERSONAL_NOTE",),
    "ARTICLE": ("ARTICLE",),
}
PDF_LIKE = ("PDF", "EPUB", "PDF_CHUNK", "BOOK_CHUNK")
HIDDEN_NOTES = ("PRIVATE", "DAILY", "BOOKMARK")


def resource_scope(chunks: DataFrame, scope: str | None, items: DataFrame | None = None) -> DataFrame:
    """Chunks of a resource scope; MOVIE and SERIES look at the live parent item."""
    scope = (scope or "").strip().upper()
    if not scope:
        return chunks
    if scope in ("MOVIE", "SERIES"):
        live = items.where((F.coalesce("is_deleted", F.lit(0)) == 0) & (F.col("item_type") == scope))
        return chunks.join(live.select("tenant", "item_id"), ["tenant", "item_id"], "left_semi")
    return chunks.where(F.col("content_type").isin(*SCOPES.get(scope, (scope,))))


def by_item(chunks: DataFrame, item: str | None) -> DataFrame:
    item = (item or "").strip()
    return chunks.where(F.col("item_id") == item) if item else chunks


def visible(chunks: DataFrame, items: DataFrame, scope: str = "default") -> DataFrame:
    """Chunks that may be searched; notes of private categories never are."""
    shown = F.coalesce("search_visibility", F.lit("DEFAULT"))
    rule = shown != "NEVER_RETRIEVE" if scope == "all" else shown == "DEFAULT"
    private = (F.col("content_type") == "PERSONAL_NOTE") & F.coalesce(F.upper("category"), F.lit("PRIVATE")).isin(*HIDDEN_NOTES)
    known = items.select("tenant", "item_id", "search_visibility", "category")
    return chunks.join(known, ["tenant", "item_id"], "left").where(rule & ~private).select(chunks.columns)


def type_is(df: DataFrame, column: str, value: str | None) -> DataFrame:
    value = (value or "").strip().upper()
    return df.where(F.col(column) == value) if value else df


def surface(chunks: DataFrame, which: str = "CORE") -> DataFrame:
    pdf = F.col("content_type").isin(*PDF_LIKE)
    return chunks.where(pdf if (which or "").strip().upper() == "PDF_ONLY" else ~pdf)


def feed_notes(chunks: DataFrame, items: DataFrame, notes_only: bool) -> DataFrame:
    """Feed guard: only idea notes, or everything but private notes."""
    category = F.upper("category")
    if notes_only:
        ideas = items.where((F.col("item_type") == "PERSONAL_NOTE") & (category == "IDEAS"))
        return chunks.join(ideas.select("tenant", "item_id"), ["tenant", "item_id"], "left_semi")
    hidden = items.where((F.col("item_type") == "PERSONAL_NOTE") & F.coalesce(category, F.lit("PRIVATE")).isin(*HIDDEN_NOTES))
    return chunks.join(hidden.select("tenant", "item_id"), ["tenant", "item_id"], "left_anti")


def in_category(df: DataFrame, label: str) -> DataFrame:
    """Rows whose ``categories`` array holds the label, whatever the case and blanks."""
    return df.where(F.exists("categories", lambda c: F.lower(F.trim(c)) == label.strip().lower()))


def has_literal(text: Column, needle: str) -> Column:
    return text.contains(F.lit(needle))


def _quoted(needle: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in needle)


def whole_term(text: Column, needle: str) -> Column:
    """The needle with neither a letter nor a digit of ASCII next to it."""
    return text.rlike(f"(?<![a-z0-9]){_quoted(needle)}(?![a-z0-9])")


def stem_hits(text: Column, stems: list[str]) -> Column:
    """Words that start with one of the stems of three or more letters, counted over all stems."""
    total = F.lit(0)
    for s in stems:
        if len(s) >= 3:
            total = total + F.regexp_count(text, F.lit(f"(?<![a-z0-9]){_quoted(s)}"))
    return total


def all_tokens(tokens: Column, wanted: list[str]) -> Column:
    wanted = list(dict.fromkeys(w for w in wanted if len(w) >= 2))[:8]
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))) == len(wanted)


#: Types that a semantic hit may have, those of short notes, marks of drafts, and length floors.
SEMANTIC_TYPES = ("PDF", "EPUB", "PDF_CHUNK", "BOOK", "HIGHLIGHT", "INSIGHT", "NOTES", "PERSONAL_NOTE", "ARTICLE", "WEBSITE", "MOVIE", "SERIES", "GRAPH_RELATION")
NOTE_TYPES = ("PERSONAL_NOTE", "HIGHLIGHT", "INSIGHT", "NOTES")
DRAFT_TEXT, DRAFT_TITLE, NAMELESS = "website deneme", "deneme", "unknown"
NOTE_FLOOR, TEXT_FLOOR, WEB_FLOOR, DRAFT_FLOOR, HEADER_FLOOR = 15, 60, 100, 180, 220


def semantic_quality(text: Column, title: Column, kind: Column) -> Column:
    """Whether a semantic hit says enough for its type: no drafts, placeholders or bare headers."""
    t, name, kind = F.trim(F.coalesce(text, F.lit(""))), F.lower(F.trim(F.coalesce(title, F.lit("")))), F.upper(F.trim(F.coalesce(kind, F.lit(""))))
    low, n = F.lower(t), F.length(t)
    floor = F.when(kind.isin(*NOTE_TYPES), NOTE_FLOOR).when(kind.isin("WEBSITE", "ARTICLE"), WEB_FLOOR).otherwise(TEXT_FLOOR)
    floor = F.greatest(
        floor, F.when(low.rlike("^(title|author):"), HEADER_FLOOR).otherwise(0), F.when(name.contains(DRAFT_TITLE), DRAFT_FLOOR).otherwise(0),
        F.when(name.contains(NAMELESS), HEADER_FLOOR).otherwise(0),
    )
    return ((kind == "") | kind.isin(*SEMANTIC_TYPES)) & ~low.contains(DRAFT_TEXT) & (n >= floor)


def length_band(text: Column, band: str) -> Column:
    return F.length(text) < 600 if band == "SHORT" else F.length(text) > 600


def enough_text(text: Column, least: int = 12) -> Column:
    return F.length(F.trim(text)) >= least


def tail_floor(scored: DataFrame, cap: int) -> DataFrame:
    """Per query: scores of at least max(2, 0.35 of the best); if none, the first max(cap, 3)."""
    w = Window.partitionBy("query_id")
    df = scored.withColumn("ok", F.col("score") >= F.greatest(F.lit(2.0), 0.35 * F.max("score").over(w)))
    df = df.withColumn("any_ok", F.max("ok").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    return df.where(F.col("ok") | (~F.col("any_ok") & (F.col("nth") <= max(cap, 3)))).drop("ok", "any_ok", "nth")


def since(df: DataFrame, ts: str, cutoff: str, most: int) -> DataFrame:
    """Newest rows after a cutoff, at most ``most`` (a polling page)."""
    return df.where(F.col(ts) > F.lit(cutoff).cast("timestamp_ntz")).orderBy(F.desc(ts), F.desc("id")).limit(most)
