"""Fuzzy top-k matches of queries with choices, by shared letter pairs, and the repairs built on them.

Two strings with an Indel ratio of 0.68 or more share a padded letter pair: each insertion or
deletion breaks two pairs at most. So candidates come from an equi-join on pairs, and enough
of them must be shared (or on a shared word, for token sets, whose words are sorted first). No such rule holds for windows of
a longer string or below 0.68: there every query meets every choice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import similarity as S
from larkspur.functions import text as X


#: From this ratio on two strings share a padded letter pair.
PAIRS_FROM = 0.68


def letter_pairs(c: Column) -> Column:
    padded = F.concat(F.lit("\u0001"), c, F.lit("\u0001"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substring(padded, i, F.lit(2))))


def sorted_words(c: Column) -> Column:
    """The distinct words in order: what a token-set ratio without shared words compares."""
    return F.array_join(F.array_sort(F.array_distinct(words_of(c))), " ")


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def candidates(queries: DataFrame, choices: DataFrame, least: float, scorer=S.indel_ratio) -> DataFrame:
    """query_id, query, choice: all pairs that may reach ``least`` by the scorer."""
    if least < PAIRS_FROM or scorer not in (S.indel_ratio, S.token_set_ratio):
        return queries.select("query_id", "query").crossJoin(choices.select("choice"))
    form = sorted_words if scorer is S.token_set_ratio else (lambda c: c)
    q = queries.select("query_id", "query", form(F.col("query")).alias("qf"))
    c = choices.select("choice", form(F.col("choice")).alias("cf"))
    near = q.withColumn("g", F.explode(letter_pairs(F.col("qf")))).join(c.withColumn("g", F.explode(letter_pairs(F.col("cf")))), "g")
    short = 2 * F.least(F.length("qf"), F.length("cf")) >= least * (F.length("qf") + F.length("cf"))
    # Of indel distance D, which the ratio bounds, each step takes two letter pairs at most from either side.
    steps = F.floor((1.0 - least + 1e-9) * (F.length("qf") + F.length("cf")))
    pairs = lambda x: F.size(letter_pairs(F.col(x)))
    near = near.where(short).groupBy("query_id", "query", "choice", "qf", "cf").agg(F.count("*").alias("shared"))
    near = near.where(F.col("shared") >= F.greatest(pairs("qf"), pairs("cf")) - 2 * steps).select("query_id", "query", "choice").distinct()
    if scorer is S.token_set_ratio:
        w = queries.select("query_id", "query", F.explode(words_of(F.col("query"))).alias("w")).join(choices.select("choice", F.explode(words_of(F.col("choice"))).alias("w")), "w")
        near = near.unionByName(w.select("query_id", "query", "choice")).distinct()
    return near


def best_matches(queries: DataFrame, choices: DataFrame, k: int, least: float, scorer=S.token_set_ratio) -> DataFrame:
    """The k best choices of each query that reach ``least``, ties to the first in alphabetical order."""
    scored = candidates(queries, choices, least, scorer).withColumn("score", F.round(scorer("query", "choice"), 6)).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "choice")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def token_repairs(queries: DataFrame, vocabulary: DataFrame, least: float = 0.83) -> DataFrame:
    """query_id, repaired, confidence: each unknown token of over 2 letters replaced by its best match."""
    words = queries.select("query_id", F.posexplode(F.split("query", " ")).alias("pos", "token"))
    unknown = words.where("length(token) > 2").join(vocabulary.select(F.col("term").alias("token")), "token", "left_anti").select("token").distinct()
    best = best_matches(unknown.select(F.col("token").alias("query_id"), F.col("token").alias("query")), vocabulary.select(F.col("term").alias("choice")), 1, least, S.indel_ratio)
    fixed = words.join(best.select(F.col("query_id").alias("token"), "choice", "score"), "token", "left")
    out = fixed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("choice", "token").alias("t")))), lambda x: x["t"]), " ").alias("repaired"), F.min("score").alias("confidence"))
    return out.where("confidence is not null")


def whole_repairs(queries: DataFrame, choices: DataFrame, k: int = 3) -> DataFrame:
    """query_id, query, choice, score, rank: titles like the query (0.82), or like it without spaces.

    Without spaces a single word of 10 letters or more needs 0.74, others 0.86. Titles that equal
    the query are no repair; a title found both ways keeps its higher score.
    """
    single = ~F.col("query").contains(" ") & (F.length("query") >= 10)
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    compact = choices.groupBy(bare("choice").alias("choice")).agg(F.max("choice").alias("original"))
    near = best_matches(queries.withColumn("query", bare("query")), compact.select("choice"), k, 0.74, S.indel_ratio).join(compact, "choice").select("query_id", F.col("original").alias("choice"), "score")
    near = near.join(queries, "query_id").where((F.col("score") >= 0.86) | single)
    both = best_matches(queries, choices, k, 0.82).select("query_id", "query", "choice", "score").unionByName(near.select("query_id", "query", "choice", "score"))
    best = both.where("choice <> query").groupBy("query_id", "query", "choice").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "choice")))


def keyed(words: list[str]) -> dict[str, str]:
    """Words by their singular; of words with one singular the shortest."""
    return {X.plain_singular(w): w for w in sorted(words, key=lambda w: (-len(w), w))}


def segment(text: str, lexicon: dict[str, str]) -> str | None:
    """A compact query cut into at least two words of the lexicon, the longest first at each place."""
    n, longest = len(text), max(map(len, lexicon), default=0)
    if " " in text or n < 12 or not text.isascii():
        return None
    ends: list[int | None] = [None] * n + [n]
    for i in range(n - 1, -1, -1):
        ends[i] = next((j for j in range(min(n, i + longest), i, -1) if text[i:j] in lexicon and ends[j] is not None), None)
    out, i = [], 0
    while i < n:
        if ends[i] is None:
            return None
        out.append(lexicon[text[i : ends[i]]])
        i = ends[i]
    return " ".join(out) if len(out) > 1 else None


def segmented(queries: DataFrame, vocabulary: DataFrame, always: list[str]) -> DataFrame:
    """query, segmented: each compact query cut by the vocabulary words that occur in it, and those of ``always``."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("query")), lambda i: F.expr("query").substr(i, F.length("query")))).alias("at", "tail")
    tails = queries.where("query <> ''").select("query", at)
    parts = tails.select("query", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda n: F.expr("tail").substr(F.lit(1), n))).alias("term")).distinct()
    found = parts.join(vocabulary.select("term").distinct(), "term").groupBy("query").agg(F.collect_list("term").alias("words"))

    @F.pandas_udf("string")
    def cut(q: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([segment(x, keyed([*([] if w is None else w), *always])) for x, w in zip(q, words, strict=True)], dtype=object)

    return queries.join(found, "query", "left").select("query", cut("query", "words").alias("segmented"))
