"""Question analysis, evidence scoring and evaluation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of passages and questions.
DEFINITION = r"\bnedir\b|\bşudur\b|\bdemektir\b|\bo da\s+\w+|\btanımı\b|\banlamı\b|olarak tanımlan"
THEORY = r"iki\s+teori|iki\s+görüş|yaklaşım\w*\s+var|birincisi.*ikincisi|felsefi\s+olarak"
ANALOGY = r"\bgibi\b|tıpkı|benzer\s+şekilde|sanki"
SITUATIONAL = r"yaşadım|gördüm|bir gün|hatırlıyorum"
SOCIETAL = r"toplum\w*|kültür\w*|genel\s+olarak|insanlar"
FOLLOW_UP = r"^(peki|o zaman|onun|bunun|şunun|neden|nasıl|başka|bu konuda)\b"
COMPLEX = r"mümkün.*mü|olabilir.*mi|felsef|ahlak|etik|vicdan|ilişkisi.*nedir|farklı.*yaklaşım"
CITATION = r"dediği\s+gibi|literatür(de|e|den)|kim\s+(söyle|demiş|iddia|ifade)|hangi\s+(düşünür|yazar|filozof|kitap)|kaynak(lar)?da"
COMPARE = r"farkı|benzerliği|ilişkisi|arasındaki|ortak yön|karşılaştır"
DIRECT = r"nedir\??$|kimdir\??$|ne demek|anlamı ne|kaç tane|hangi|nerede|ne zaman"


def question_intent(text: Column) -> tuple[Column, Column]:
    q = F.lower(text)
    follow = q.rlike(FOLLOW_UP) | (F.regexp_count(q, F.lit(r"\S+")) <= 3)
    deep = q.rlike(COMPLEX)
    intent = (
        F.when(follow, "FOLLOW_UP").when(q.rlike(CITATION), "CITATION_SEEKING").when(q.rlike(COMPARE), "COMPARATIVE").when(q.rlike(DIRECT) & ~deep, "DIRECT").otherwise("SYNTHESIS")
    )
    return intent, F.when(~follow & deep, "HIGH").otherwise("LOW")


def passage_type(text: Column) -> Column:
    """struct(kind, quotability, confidence): the first kind whose pattern the text holds."""
    t = F.lower(text)
    kinds = (("DEFINITION", DEFINITION, "HIGH", 0.8), ("THEORY", THEORY, "HIGH", 0.8), ("ANALOGY", ANALOGY, "MEDIUM", 0.7), ("SITUATIONAL", SITUATIONAL, "MEDIUM", 0.7), ("SOCIETAL", SOCIETAL, "MEDIUM", 0.7))
    told = lambda *x: F.struct(*(F.lit(v).alias(n) for n, v in zip(("kind", "quotability", "confidence"), x)))
    return F.coalesce(*(F.when(t.rlike(pattern), told(kind, quote, sure)) for kind, pattern, quote, sure in kinds), told("SITUATIONAL", "MEDIUM", 0.5))


#: A note shorter than this says nothing of its own.
LEAST_COMMENT = 6


def answerability(text: Column, comment: Column, words: list[str], definition: str, theory: str, modal: str, judging: str) -> Column:
    """struct(score, features) of a text and its note: one for a keyword and with it three for a definition and one for a
    theory; one each for the writer's own voice, a note, and words that judge."""
    note = F.coalesce(comment, F.lit(""))
    t = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), note))
    found = F.coalesce(*(F.when(t.contains(w.lower()), True) for w in words), F.lit(False))
    parts = {
        "KEYWORD_MATCH": (found, 1), "DEFINITIONAL": (found & t.rlike(definition), 3), "THEORY": (found & t.rlike(theory), 1), "MODALITY": (t.rlike(modal), 1),
        "PERSONAL_COMMENT": (F.length(note) >= LEAST_COMMENT, 1), "EVALUATIVE": (t.rlike(judging), 1),
    }
    score = sum((F.when(c, n).otherwise(0) for c, n in parts.values()), F.lit(0))
    return F.struct(score.alias("score"), F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, (c, _) in parts.items()))).alias("features"))


def level(score: Column, kind: Column) -> Column:
    return F.when((score >= 3) | kind.isin("DEFINITION", "THEORY"), "A").when(score >= 1, "B").otherwise("C")


def answer_mode(scored: DataFrame) -> DataFrame:
    n = scored.groupBy("query_id").agg(*(F.count_if(F.col("level") == x).alias(x) for x in "ABC"))
    return n.select("query_id", F.when(F.col("A") >= 2, "QUOTE").when((F.col("A") >= 1) | (F.col("B") >= 3), "HYBRID").otherwise("SYNTHESIS").alias("mode"))


#: Rescoring of passages from the graph and from outside (least, most, factor), decay of a parent's context,
#: and weights by level, by intent and of what comes from outside (least, most).
GRAPH_LOW, GRAPH_BASE, GRAPH_FACTOR = 0.5, 1.5, 4.0
OUTSIDE_SCORE = {"EXTERNAL_KB": (0.4, 1.3, 3.2, 0.15), "ISLAMIC_EXTERNAL": (0.8, 2.2, 6.4, 0.22)}
OUTSIDE_WEIGHT = {"EXTERNAL_KB": (0.05, 0.30), "ISLAMIC_EXTERNAL": (0.08, 0.38)}
DECAY, EXACT_BONUS = 0.88, 1.8
LONG_TEXT, STORY_INTENTS = 300, ("NARRATIVE", "SOCIETAL")
HEAD_ROWS, ALWAYS, POOL_ROWS = 40, 2.0, 100


def rescored(pool: DataFrame) -> DataFrame:
    """``pool`` (score, level, source_type, graph_score, external_weight, depth) with scores that graph and outside passages
    have at least, and those of a parent's context decayed once for each step of ``depth``."""
    s = F.col("score").cast("double")
    graph = GRAPH_BASE + (F.coalesce("graph_score", F.lit(GRAPH_LOW)) - GRAPH_LOW) * GRAPH_FACTOR
    least, lev = F.when(F.col("source_type") == "GRAPH_RELATION", graph), F.when(F.col("source_type") == "GRAPH_RELATION", F.when(graph >= 3, "A").when(graph >= 1, "B").otherwise(F.col("level")))
    for kind, (lo, hi, factor, usual) in OUTSIDE_SCORE.items():
        own = F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce("external_weight", F.lit(usual)) * factor))
        least, lev = least.when(F.col("source_type") == kind, own), lev.when(F.col("source_type") == kind, "B")
    more = least > s
    s, lev = F.when(more, least).otherwise(s), F.when(more, lev).otherwise(F.col("level"))
    return pool.withColumns({"score": s * F.pow(F.lit(DECAY), F.coalesce("depth", F.lit(0))), "level": lev})


def weighted_rank(pool: DataFrame, k: int = HEAD_ROWS, always: float = ALWAYS) -> DataFrame:
    """The first ``k`` of each query's first hundred by ``place``, and all of these that score ``always`` or more, with their weight and rank by it.

    ``pool`` has query_id, id, place, score, level, text, source_type, intent, and may have graph_score, external_weight, depth (steps from
    the passage whose parent it is), exact and composition (a weight of the kind of source); missing ones say nothing.
    """
    for name, kind in (("graph_score", "double"), ("external_weight", "double"), ("depth", "int"), ("exact", "boolean"), ("composition", "double")):
        if name not in pool.columns:
            pool = pool.withColumn(name, F.lit(None).cast(kind))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id"))
    df = rescored(pool.withColumn("at", first).where(F.col("at") <= POOL_ROWS)).where((F.col("at") <= k) | (F.col("score") >= always))
    long = (F.length(F.coalesce("text", F.lit(""))) > LONG_TEXT) & (F.col("level") != "A")
    w = F.when(F.col("intent").isin(*STORY_INTENTS), F.when(long, 1.2).otherwise(1.0)).when(F.col("level") == "A", 1.2).when(F.col("level") == "B", 0.9).when(long, 0.4).otherwise(1.0)
    for kind, (lo, hi) in OUTSIDE_WEIGHT.items():
        own = F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce("external_weight", F.lit(OUTSIDE_SCORE[kind][3]))))
        bonus = F.when(F.coalesce("exact", F.lit(False)), EXACT_BONUS).otherwise(1.0) if kind == "ISLAMIC_EXTERNAL" else F.lit(1.0)
        w = F.when(F.col("source_type") == kind, own * bonus).otherwise(w)
    df = df.withColumn("weight", F.round(F.col("score") * w * F.coalesce("composition", F.lit(1.0)), 6))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "at")))


def with_parents(hits: DataFrame, parents: DataFrame, passages: DataFrame, steps: int = 2) -> DataFrame:
    """``hits`` (query_id, id, place, score, ...) and the parents (child, parent) of them up to ``steps`` above, which inherit a hit's score;
    ``depth`` counts the steps. A passage that is reached twice stays at its least depth, a hit stays itself."""
    level = hits.select("query_id", "id", "place", "score", F.lit(0).alias("depth"))
    every = level
    for n in range(1, steps + 1):
        up = level.join(parents.select(F.col("child").alias("id"), "parent"), "id")
        level = up.groupBy("query_id", F.col("parent").alias("id")).agg(F.max("place").alias("place"), F.max("score").alias("score")).withColumn("depth", F.lit(n))
        every = every.unionByName(level)
    first = every.groupBy("query_id", "id").agg(F.min_by(F.struct("place", "score", "depth"), F.struct("depth", "place")).alias("r")).select("query_id", "id", "r.*")
    return first.join(passages, "id")


#: Passages of a question that are looked at, and what is in: least mean score (of 0 to 7) and share of keywords.
HEAD, INSIDE, OUTSIDE = 5, ((5.0, 0.5), (3.5, 0.7), (1.0, 0.8)), (2.0, 0.8)


def coverage(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """query_id, status, confidence, coverage, missing of each of ``questions`` (query_id, keywords) by its best five of ``pool``.

    ``pool`` has query_id, id, score (answerability, 0 to 7), text and primary (a primary source of the field, which needs half of
    the keywords only). A question without passages is out.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    head = pool.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= HEAD)
    head = head.groupBy("query_id").agg(F.avg("score").alias("mean"), F.max("primary").alias("primary"), F.collect_list(F.lower("text")).alias("texts"))
    df = questions.join(head, "query_id", "left")
    words = F.array_distinct("keywords")
    lost = F.filter(words, lambda k: ~F.coalesce(F.exists("texts", lambda t: t.contains(F.lower(k))), F.lit(False)))
    df = df.withColumn("missing", lost).withColumn("coverage", F.when(F.col("mean").isNull(), 0.0).otherwise((F.size(words) - F.size(lost)) / F.greatest(F.size("keywords"), F.lit(1))))
    c, m = F.col("coverage"), F.col("mean")
    inside = F.coalesce("primary", F.lit(False)) & (c >= 0.5)
    for score, share in INSIDE:
        inside |= (m >= score) & (c >= share)
    status = F.when(m.isNull(), "OUT_OF_NETWORK").when(inside, "IN_NETWORK").when((m < OUTSIDE[0]) & (c < OUTSIDE[1]), "OUT_OF_NETWORK").otherwise("HYBRID")
    return df.select("query_id", status.alias("status"), (F.coalesce(m, F.lit(0.0)) / 7).alias("confidence"), "coverage", "missing")


def infer_domain(df: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """Domain with the most term hits; ties are AUTO. confidence = min(0.92, 0.45 + 0.12 hits)."""
    t = F.lower("text")
    hits = F.array(*(F.struct(sum((t.contains(w).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(name).alias("d")) for name, ws in terms.items()))
    df = df.withColumn("h", F.sort_array(hits, asc=False))
    best, second = F.col("h")[0], F.col("h")[1]
    auto = (best["n"] == 0) | (best["n"] == second["n"])
    conf = F.when(auto, 0.0).otherwise(F.round(F.least(F.lit(0.92), 0.45 + 0.12 * best["n"]), 2))
    band = F.when(conf >= 0.78, "high").when(conf >= 0.55, "medium").otherwise("low")
    return df.withColumn("domain", F.when(auto, "AUTO").otherwise(best["d"])).withColumn("confidence", conf).withColumn("band", band).drop("h")


def ranking_metrics(results: DataFrame, depth: int = 10) -> DataFrame:
    """MRR and binary nDCG per query of results (query_id, rank, rel)."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    df = results.where(F.col("rank") <= depth).withColumn("best", F.row_number().over(ideal))
    gain = lambda r: F.sum(F.col("rel") / F.log2(F.col(r) + 1))
    out = df.groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"), gain("rank").alias("dcg"), gain("best").alias("idcg"))
    return out.select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def compare_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Gains of b over a in per cent: quality up by 5 and latency by 10 at most passes."""
    side = lambda df, n: df.select(key, F.col("quality").alias(f"q_{n}"), F.col("p95").alias(f"l_{n}"))
    df = side(a, "a").join(side(b, "b"), key)
    gain = F.round((F.col("q_b") - F.col("q_a")) / F.nullif(F.col("q_a"), F.lit(0.0)) * 100, 2)
    slower = F.round((F.col("l_b") - F.col("l_a")) / F.nullif(F.col("l_a"), F.lit(0.0)) * 100, 2)
    return df.select(key, gain.alias("gain"), slower.alias("slower"), ((gain >= 5) & (slower <= 10)).alias("passed"))


def recommended(a: DataFrame, b: DataFrame, key: str, judged: tuple[str, ...]) -> DataFrame:
    """One row: gain in quality and latency of b over a in per cent, over the endpoints ``judged`` together, and whether b passes on both."""
    mean = lambda df, n: df.where(F.col(key).isin(*judged)).select(key, F.col("quality").alias(f"q_{n}"), F.col("p95").alias(f"l_{n}"))
    m = mean(a, "a").join(mean(b, "b"), key).agg(*(F.avg(c).alias(c) for c in ("q_a", "q_b", "l_a", "l_b")))
    share = lambda x, y: F.coalesce(F.round((F.col(y) - F.col(x)) / F.nullif(F.col(x), F.lit(0.0)) * 100, 2), F.lit(0.0))
    df = m.select(share("q_a", "q_b").alias("gain"), share("l_a", "l_b").alias("slower"))
    return df.select("gain", "slower", (F.col("gain") >= 5).alias("quality_pass"), (F.col("slower") <= 10).alias("latency_pass"), ((F.col("gain") >= 5) & (F.col("slower") <= 10)).alias("recommended"))


#: Headings that tell the mode of an answer, in order of trial.
MODE_HEADINGS = {"HYBRID": ("## karsit gorusler", "## baglamsal kanitlar"), "QUOTE": ("## dogrudan tanimlar", "## baglamsal analiz"), "SYNTHESIS": ("## sonuc",)}


def answer_text(text: Column) -> Column:
    """Small plain letters and single blanks, for a search letter by letter."""
    folded = F.translate(F.coalesce(text, F.lit("")), "çÇğĞıİöÖşŞüÜâÂîÎûÛéÉèÈêÊáÁàÀäÄíÍóÓôÔúÚñÑ", "cCgGiIoOsSuUaAiIuUeEeEeEaAaAaAiIoOoOuUnN")
    return F.trim(F.regexp_replace(F.lower(folded), r"\s+", " "))


def mode_of(answer: Column) -> Column:
    """The mode whose headings an answer has, null if none."""
    plain = answer_text(answer)
    return F.coalesce(*(F.when(reduce(and_, (plain.contains(h) for h in heads)), mode) for mode, heads in MODE_HEADINGS.items()))


def rule_checks(cases: DataFrame) -> DataFrame:
    """id, mode, failures, passed of each of ``cases`` (id, answer, expected_mode, must_quote, must_synthesize, forbidden).

    Phrases are looked for in plain letters. An expected mode fails where the headings tell another, or none.
    """
    none = F.array().cast("array<string>")
    cases = cases.withColumn("plain", answer_text(F.col("answer"))).withColumn("mode", mode_of(F.col("answer")))

    def told(phrases: str, name: str, bad: bool) -> Column:
        there = lambda p: F.contains(F.col("plain"), answer_text(p))
        kept = F.filter(F.coalesce(phrases, none), lambda p: there(p) if bad else ~there(p))
        return F.transform(kept, lambda p: F.concat(F.lit(f"{name}:"), p))

    asked = F.length(F.coalesce("expected_mode", F.lit(""))) > 0
    mode = F.when(asked & F.col("mode").isNull(), F.array(F.lit("mode_unknown"))).when(asked & (F.col("mode") != F.col("expected_mode")), F.array(F.concat(F.lit("mode_mismatch:"), "mode"))).otherwise(none)
    failures = F.concat(mode, told("must_quote", "missing_required_phrase", False), told("must_synthesize", "missing_synthesis_signal", False), told("forbidden", "forbidden_phrase_present", True))
    return cases.select("id", "mode", failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


def failure_plane(retrieved: Column, answered: Column) -> Column:
    return F.when(retrieved & answered, "pass").when(~retrieved & ~answered, "mixed").when(~retrieved, "retrieval").otherwise("generation")


#: Limits of a pass and of another try, what intent, sources and failed parts move, and the range they stay in.
PASS, RETRY = 0.65, 0.50
BY_INTENT, WEAK, STRONG = {"DIRECT": 0.05, "SYNTHESIS": -0.05}, (3.0, -0.10), (5.0, 0.05)
FAILED, FAILED_MOST, MORE = 0.5, 3, 0.10
PASS_RANGE, RETRY_LEAST, APART = (0.55, 0.75), 0.40, 0.1


def rubric(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """id, score, pass_at, retry_at, verdict: the weighted mean of the parts (a missing one is 0.5, all within 0 and 1), held against limits
    that follow the intent, the quality of the sources (0 to 7) and the number of failed parts.

    ``scores`` has id, one column for each part, intent and chunk_quality.
    """
    part = lambda c: F.greatest(F.least(F.coalesce(c, F.lit(0.5)), F.lit(1.0)), F.lit(0.0))
    s = F.round(sum((part(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values()), 4)
    move = F.lit(0.0)
    for intent, by in BY_INTENT.items():
        move = F.when(F.col("intent") == intent, by).otherwise(move)
    q = F.col("chunk_quality")
    move = move + F.when(q < WEAK[0], WEAK[1]).when(q >= STRONG[0], STRONG[1]).otherwise(0.0)
    bad = sum((F.when(F.col(c) < FAILED, 1).otherwise(0) for c in weights), F.lit(0))
    at = F.round(F.greatest(F.least(F.lit(PASS) + move, F.lit(PASS_RANGE[1])), F.lit(PASS_RANGE[0])), 4)
    again = F.round(F.least(at - APART, F.greatest(F.lit(RETRY_LEAST), F.lit(RETRY) + F.when(bad >= FAILED_MOST, MORE).otherwise(0.0))), 4)
    df = scores.select("id", s.alias("score"), at.alias("pass_at"), again.alias("retry_at"))
    return df.withColumn("verdict", F.when(F.col("score") >= F.col("pass_at"), "PASS").when(F.col("score") >= F.col("retry_at"), "REGENERATE").otherwise("DECLINE"))
