"""Text functions as Spark columns: normalisation, tokens, n-grams, phonetic codes, languages.

All are built-in expressions, so they stay in the JVM; only NFKC has no built-in and is an Arrow
function. Text is brought to NFKC once, where it comes in (``unicode_normalized``, ``normalize_text``);
the other functions take it so.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur import lexicon as L


def strings(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def lookup(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def unicode_normalized(c: Column) -> Column:
    """NFKC; only text that isn't ASCII goes to Python."""
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, nfkc(F.when(wide, c))).otherwise(c)


def collapse_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-zA-Z])\1{2,}", "$1$1")


def strip_noise(c: Column) -> Column:
    """Everything but letters, numbers and spaces becomes a space; combining marks too."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]+", " "), "_+", " ")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def split_words(c: Column) -> Column:
    """Words of a text whose spaces are collapsed; none for an empty one."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def mapped_words(c: Column, mapping: dict[str, str]) -> Column:
    m = lookup(mapping)
    return F.array_join(F.transform(split_words(collapse_spaces(c)), lambda x: F.coalesce(F.try_element_at(m, x), x)), " ")


def normalize(c: Column) -> Column:
    """Lower case, abbreviations, repeated letters, noise, spaces; in this order."""
    return collapse_spaces(strip_noise(collapse_repeats(mapped_words(F.lower(F.coalesce(c, F.lit(""))), L.ABBREVIATIONS))))


def normalize_text(c: Column) -> Column:
    """NFKC, then ``normalize``: the whole of it, for text as it comes in."""
    return normalize(unicode_normalized(c))


def singular(x: Column) -> Column:
    n = F.length(x)
    return F.when(x.endswith("ies") & (n > 4), F.concat(F.expr("''"), F.substring(x, 1, n - 3), F.lit("y"))).when(x.endswith("s") & ~x.endswith("ss") & (n > 3), F.substring(x, 1, n - 1)).otherwise(x)


def singular_phrase(c: Column) -> Column:
    return F.array_join(F.transform(split_words(c), singular), " ")


def match_norm(c: Column) -> Column:
    return singular_phrase(normalize(c))


def compact(c: Column) -> Column:
    return F.replace(match_norm(c), F.lit(" "), F.lit(""))


def tokens(c: Column, keep_stopwords: bool = True) -> Column:
    words = split_words(match_norm(c))
    return words if keep_stopwords else without(words, L.STOPWORDS)


def without(words: Column, drop: list[str]) -> Column:
    """Keeps duplicates of what is left."""
    return F.filter(words, lambda x: ~x.isin(drop))


def remove_fillers(c: Column) -> Column:
    return F.array_join(without(split_words(normalize(c)), L.FILLERS), " ")


def transliterated(c: Column) -> Column:
    return F.array_join(F.transform(split_words(normalize(c)), lambda x: F.coalesce(F.try_element_at(lookup(L.TRANSLITERATIONS), x), x)), " ")


def retrieval_terms(words: Column) -> Column:
    return without(words, L.WEAK_TERMS)


def trigrams(c: Column) -> Column:
    """Character 3-grams of the compact text; the whole text if it is no longer than 3."""
    t = compact(c)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= 3, F.array(t)).otherwise(many)


def features(c: Column) -> Column:
    """Tokens without stop words, and 3-grams of the whole; equal strings of either kind merge."""
    return F.concat(tokens(c, False), trigrams(c))


def soundex_ref(c: Column) -> Column:
    """First letter and three digits; the first letter's own code is ignored and vowels don't part equal codes."""

    def coded(t: Column) -> Column:
        code = F.regexp_replace(F.translate(F.substring(t, 2, 1 << 20), "bfpvcgjkqsxzdtlmnraeiouhwy", "111122222222334556"), r"([0-9])\1+", "$1")
        return F.when(t == "", "").otherwise(F.rpad(F.concat(F.upper(F.substring(t, 1, 1)), code), 4, "0"))

    # As a variable of the transform the letters are made once, not once for each use.
    return F.get(F.transform(F.array(F.regexp_replace(F.lower(c), "[^a-z]", "")), coded), F.lit(0))


def plain_match_norm(text: str) -> str:
    """``match_norm`` of a constant, so that fixed lists don't become expressions."""
    words = [L.ABBREVIATIONS.get(w, w) for w in unicodedata.normalize("NFKC", text).lower().split()]
    clean = regex.sub("_+", " ", regex.sub(r"[^\p{L}\p{N}_\s]+", " ", regex.sub(r"([a-zA-Z])\1{2,}", r"\1\1", " ".join(words))))
    return " ".join(map(plain_singular, clean.split()))


def plain_singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def requested_languages(c: Column) -> Column:
    return requested_of(tokens(c))


def requested_of(words: Column) -> Column:
    return F.filter(F.array(*[F.when(F.arrays_overlap(words, strings(v)), F.lit(k)) for k, v in L.LANGUAGES.items()]), lambda x: x.isNotNull())


def languages(c: Column) -> Column:
    return languages_of(c, requested_languages(c))


def languages_of(c: Column, requested: Column) -> Column:
    """From the text's scripts and the languages that its words ask for."""
    by_script = F.array(F.when(c.rlike("[ऀ-ॿ]"), F.lit("hindi")), F.when(c.rlike("[஀-௿]"), F.lit("tamil")), F.when(c.rlike("[A-Za-z]"), F.lit("english")))
    return F.array_sort(F.array_distinct(F.concat(requested, F.filter(by_script, lambda x: x.isNotNull()))))


def code_mixed(c: Column) -> Column:
    return mixed_of(c, requested_languages(c))


def mixed_of(c: Column, requested: Column) -> Column:
    return (c.rlike("[A-Za-z]") & c.rlike("[ऀ-ॿ஀-௿]")) | (F.size(requested) >= 2)


def difficulty(c: Column) -> Column:
    return difficulty_of(tokens(c))


def difficulty_of(words: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(L.DIFFICULTY.items()):
        out = F.when(F.arrays_overlap(words, strings(v)), F.lit(k)).otherwise(out)
    return out


def synonyms(words: Column) -> Column:
    """The words, and the tokens of what any phrase inside their joined text stands for; sorted."""
    joined = F.array_join(words, " ")
    found = [F.when(joined.contains(k), strings(plain_match_norm(" ".join(v)).split())).otherwise(F.array().cast("array<string>")) for k, v in L.SYNONYMS.items()]
    return F.filter(F.array_sort(F.array_distinct(F.concat(words, *found))), lambda x: x != "")


def contains_phrase(norm: Column, phrase: str) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" ")).contains(f" {plain_match_norm(phrase)} ")


def romanized_forms(norm: Column) -> Column:
    """A text, normalised, and its forms by the map in both directions, sorted."""
    none = F.array().cast("array<string>")
    parts = [F.array(norm)]
    for k, v in L.ROMANIZED.items():
        parts.append(F.when(contains_phrase(norm, k), strings([plain_match_norm(x) for x in v])).otherwise(none))
        back = contains_phrase(norm, v[0])
        for x in v[1:]:
            back = back | contains_phrase(norm, x)
        parts.append(F.when(back, strings([plain_match_norm(k)])).otherwise(none))
    return F.filter(F.array_sort(F.array_distinct(F.concat(*parts))), lambda x: x != "")


def topics(words: Column) -> Column:
    return F.filter(F.array(*[F.when(F.arrays_overlap(words, strings(v)), F.lit(k)) for k, v in L.TOPICS.items()]), lambda x: x.isNotNull())


def goal(c: Column) -> Column:
    return goal_of(match_norm(c))


def goal_of(t: Column) -> Column:
    return F.when(t.contains("learn") | t.contains("need") | t.contains("course"), "guided_learning").when(t.contains("basics") | t.contains("beginner"), "foundational_learning")


def highlight(text: Column, words: Column) -> Column:
    """Marks words of 3 letters or more, the longest first, as they are and capitalised."""
    mark = lambda acc, w: F.replace(acc, w, F.concat(F.lit("<em>"), w, F.lit("</em>")))
    keyed = F.array_sort(F.transform(F.filter(F.array_distinct(words), lambda w: F.length(w) >= 3), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.aggregate(keyed, text, lambda acc, s: mark(mark(acc, s["w"]), F.initcap(s["w"])))


def summary(words: Column, topics_: Column, difficulty_: Column, languages_: Column) -> Column:
    """The first 10 of the words, a topic, the difficulty and a language, each word once."""
    none = F.array().cast("array<string>")
    parts = F.concat(F.slice(words, 1, 10), F.split(F.coalesce(F.get(topics_, F.lit(0)), F.lit("")), " "), F.coalesce(F.array(difficulty_), none), F.slice(languages_, 1, 1))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), " ")


def histogram(words: Column) -> Column:
    """How often each word occurs, as a map."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("k"), F.size(F.filter(words, lambda x: x == w)).alias("n"))))


def sql_functions() -> dict[str, tuple[str, str]]:
    """The text functions as bodies of SQL functions of a string ``s``: name to (type, body)."""
    abbreviations = ", ".join(f"'{k}', '{v}'" for k, v in L.ABBREVIATIONS.items())
    words = lambda t: f"filter(split({t}, ' '), x -> x <> '')"
    spaces = r"trim(regexp_replace({}, r'(?U)\s+', ' '))"
    known = f"array_join(transform({words(spaces.format('lower(coalesce(s, {}))').format(chr(39) * 2))}, x -> coalesce(try_element_at(map({abbreviations}), x), x)), ' ')"
    clean = rf"regexp_replace(regexp_replace(regexp_replace({known}, r'([a-zA-Z])\1{{2,}}', '$1$1'), r'[^\p{{L}}\p{{N}}_\s]+', ' '), '_+', ' ')"
    singular_ = "CASE WHEN endswith(x, 'ies') AND length(x) > 4 THEN concat(substring(x, 1, length(x) - 3), 'y') WHEN endswith(x, 's') AND NOT endswith(x, 'ss') AND length(x) > 3 THEN substring(x, 1, length(x) - 1) ELSE x END"
    letters = "regexp_replace(lower(s), '[^a-z]', '')"
    code = rf"regexp_replace(translate(substring({letters}, 2), 'bfpvcgjkqsxzdtlmnraeiouhwy', '111122222222334556'), r'([0-9])\1+', '$1')"
    return {
        "match_norm": ("STRING", f"array_join(transform({words(spaces.replace('{}', clean))}, x -> {singular_}), ' ')"),
        "compact": ("STRING", "replace(match_norm(s), ' ', '')"),
        "tokens": ("ARRAY<STRING>", words("match_norm(s)")),
        "soundex_ref": ("STRING", f"CASE WHEN {letters} = '' THEN '' ELSE rpad(concat(upper(substring({letters}, 1, 1)), {code}), 4, '0') END"),
        "char_ngrams": ("ARRAY<STRING>", "CASE WHEN compact(s) = '' THEN array() WHEN length(compact(s)) <= 3 THEN array(compact(s)) ELSE transform(sequence(1, length(compact(s)) - 2), i -> substring(compact(s), i, 3)) END"),
    }


def register(spark) -> None:
    """The text functions and similarities under their SQL names; the former stay in the JVM."""
    from larkspur.functions import similarity

    similarity.register(spark)
    for name, (kind, body) in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
