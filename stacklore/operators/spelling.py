"""Closest dictionary words and one-edit neighbours by joins that miss no pair; typo rescue of weak searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Word lengths that are corrected; a longer run of letters is no typo.
SHORTEST, LONGEST = 3, 62
#: Similarity in percent that a correction must exceed, and longest piece that two such words are sure to share.
LEAST, PIECE = 80, 5


def _letters(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substr(word, i, F.lit(1)))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def letter_places(word: Column) -> Column:
    """Map of each letter of a word of at most ``LONGEST`` letters to a number with a bit for each of its places."""
    power = lambda n: F.call_function("shiftleft", _long(1), n)
    at = lambda ch: F.aggregate(F.sequence(F.lit(1), F.length(word)), _long(0), lambda acc, j: acc.bitwiseOR(F.when(F.substr(word, j, F.lit(1)) == ch, power(j - 1)).otherwise(_long(0))))
    return F.map_from_entries(F.transform(F.array_distinct(_letters(word)), lambda ch: F.struct(ch.alias("k"), at(ch).alias("v"))))


def common_letters(a: Column, b: Column, places: Column) -> Column:
    """Length of the longest common subsequence of a word and a word ``b`` with these ``letter_places``.

    A row of the usual table is one number: bit j is unset where the length grows at letter j of ``b``; each letter of
    ``a`` is one step of additions on it.
    """
    full = F.call_function("shiftleft", _long(1), F.length(b)) - 1

    def step(row: Column, ch: Column) -> Column:
        u = row.bitwiseAND(F.coalesce(F.try_element_at(places, ch), _long(0)))
        return (row + u).bitwiseOR(row - u).bitwiseAND(full)

    return (F.length(b) - F.bit_count(F.aggregate(_letters(a), full, step))).cast("int")


def signature(word: Column) -> Column:
    """A number with a bit for each kind of letter that stands in a word, and one for each that stands twice: words differ in
    at most as many bits as letters."""
    bit = lambda ch: F.call_function("shiftleft", _long(1), F.pmod(F.ascii(ch), F.lit(31)).cast("int"))
    seen = lambda acc, ch: F.struct(acc["one"].bitwiseOR(bit(ch)).alias("one"), acc["two"].bitwiseOR(acc["one"].bitwiseAND(bit(ch))).alias("two"))
    none = F.struct(_long(0).alias("one"), _long(0).alias("two"))
    return F.aggregate(_letters(word), none, seen, lambda acc: acc["one"].bitwiseOR(F.shiftleft(acc["two"], 31)))


def _edits(one: Column, two: Column, least: int) -> Column:
    """Most letters that two words of these lengths may not share at a similarity above ``least`` (their parity is that of the lengths)."""
    total = one + two
    most = F.ceil(total * (100 - least) / F.lit(100)).cast("int") - 1
    return most - F.pmod(most + total, F.lit(2))


def closest_words(words: DataFrame, vocabulary: DataFrame, least: int = LEAST) -> DataFrame:
    """word, fix, score: for each of ``words`` (word) the word of ``vocabulary`` (fix) that is most like it, if the
    similarity (twice the common subsequence over both lengths, in percent) is above ``least``; ties take the first by letters.

    A pair with d letters out of line shares one of d + 1 pieces of the word, moved by at most d places.
    """
    length = F.length("word")
    asked = words.select("word").distinct().where(length.between(SHORTEST, LONGEST)).withColumns({"n": length, "sign": signature(F.col("word"))})
    span = F.sequence(F.greatest(F.lit(1), F.floor(F.col("n") * least / F.lit(200 - least)).cast("int")), F.ceil(F.col("n") * F.lit(200 - least) / least).cast("int"))
    asked = asked.withColumn("m", F.explode(span)).withColumn("d", _edits(F.col("n"), F.col("m"), least))
    asked = asked.where((F.col("d") >= F.abs(F.col("n") - F.col("m"))) & (F.col("d") > 0))
    cut = lambda i: F.floor(i * F.col("n") / (F.col("d") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.struct(cut(i).alias("at"), F.substr("word", cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")))
    asked = asked.select("word", "sign", "m", "d", F.explode(pieces).alias("p")).select("word", "sign", "m", "d", "p.*")
    own = vocabulary.select("fix").distinct().where(F.length("fix").between(1, LONGEST))
    known = own.withColumns({"m": F.length("fix"), "sign2": signature(F.col("fix"))})
    known = known.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.col("m"), F.lit(PIECE)))))
    known = known.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("size")))).select("fix", "sign2", "m", "to", F.substr("fix", F.col("to") + 1, F.col("size")).alias("piece"))
    near = (F.abs(F.col("at") - F.col("to")) <= F.col("d")) & (F.bit_count(F.col("sign").bitwiseXOR(F.col("sign2"))) <= F.col("d")) & (F.levenshtein("word", "fix") <= F.col("d"))
    pairs = asked.join(known, ["m", "piece"]).where(near).select("word", "fix").distinct()
    pairs = pairs.join(own.select("fix", letter_places(F.col("fix")).alias("places")), "fix")
    score = 200.0 * common_letters(F.col("word"), F.col("fix"), F.col("places")) / (F.length("word") + F.length("fix"))
    good = pairs.withColumn("score", score).where(F.col("score") > least)
    return good.groupBy("word").agg(F.min(F.struct((-F.col("score")).alias("s"), "fix")).alias("r")).select("word", "r.fix", (-F.col("r.s")).alias("score"))


def corrected(queries: DataFrame, vocabulary: DataFrame, least: int = LEAST) -> DataFrame:
    """query_id, text of those queries that change when each word outside the vocabulary gives way to its closest one."""
    each = queries.select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("nth", "word"))
    unknown = each.select("word").distinct().join(vocabulary.select(F.col("fix").alias("word")), "word", "left_anti")
    fixes = closest_words(unknown, vocabulary, least)
    told = each.join(fixes, "word", "left").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", F.coalesce("fix", "word").alias("w")))).alias("r"), F.count("fix").alias("changed")
    )
    return told.where("changed > 0").select("query_id", F.array_join(F.col("r.w"), " ").alias("text"))


def typo_rescue(queries: DataFrame, search: Callable[[DataFrame], DataFrame], vocabulary: DataFrame, few: int = 2, limit: int = 160) -> DataFrame:
    """query_id, id, rescued: the hits of ``search``, and for queries with at most ``few`` of them those of the corrected text (``limit`` each)."""
    first = search(queries).select("query_id", "id", "score")
    n = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    weak = queries.join(n, "query_id", "left").where(F.coalesce("n", F.lit(0)) <= few).select("query_id", "text")
    more = search(corrected(weak, vocabulary)).join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    more = more.withColumn("nth", nth).where(F.col("nth") <= limit)
    return first.select("query_id", "id", F.lit(False).alias("rescued")).unionByName(more.select("query_id", "id", F.lit(True).alias("rescued")))


def one_edit_keys(word: Column) -> Column:
    """The word and each form of it without one letter: two words one edit apart share one of them."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))))
