"""Quality rules: how far a document's histograms diverge from those of its language.

For each language the reference is the mean histogram of all its documents of ``min_words`` words
or more: one over character classes, one over common words (and all other words). A document
is compared to its language by the Jensen-Shannon distance (base 2, from 0 to 1). Histograms of
short texts are noisy, so the bound falls with length towards ``limit``, and texts below
``min_words`` are never judged by divergence. Everything is Column expressions; the references
are one row a language and so have a fixed size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.store import settle
from kindred.llm.words import GAP, SPACES, let, words

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
#: Common words of each language that has a reference.
COMMON = {
    "de": ["der", "die", "und", "in", "zu", "den", "das", "nicht", "von", "sie", "ist", "des", "sich", "mit", "dem", "ein"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
LANGUAGES = [*COMMON, "other"]
CLASSES = ["lower", "upper", "digit", "space", "mark", "symbol", "wide", "rest"]


def language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON), lang).otherwise("other")


def classes(text: Column) -> Column:
    """Bytes of ``text`` in each of CLASSES (``wide``: bytes beyond ASCII's), as an array of double.

    Each pattern is taken out of what the ones before it left, which soon is short.
    """
    patterns = ["[a-z]+", GAP, "[A-Z]+", "[0-9]+", f"[{re.escape(PUNCTUATION)}]+", f"[{re.escape(SYMBOLS)}]+"]

    def rest(left: Column, k: int, counts: list[Column]) -> Column:
        if k == len(patterns):
            wide = F.octet_length(left) - F.length(left)
            return F.array(*[c.cast("double") for c in [*counts, wide, F.length(left)]])
        return let(F.regexp_replace(left, patterns[k], ""), lambda less: rest(less, k + 1, [*counts, F.octet_length(left) - F.octet_length(less)]))

    return rest(text, 0, [])


def common(tokens: Column, lang: Column) -> Column:
    """How often each of the language's common words is found, then the number of other words.

    Each common word becomes one letter of a short string, in which letters are counted.
    """
    letters = "abcdefghijklmnop"
    mine = F.coalesce(*[F.when(lang == x, F.array(*[F.lit(w) for w in COMMON[x]])) for x in COMMON], F.array().cast("array<string>"))

    def tally(found: Column) -> Column:
        counts = [F.octet_length(found) - F.octet_length(F.replace(found, F.lit(c), F.lit(""))) for c in letters]
        return F.array(*[c.cast("double") for c in [*counts, F.size(tokens) - F.octet_length(found)]])

    marks = F.array(*[F.lit(c) for c in letters])
    return let(mine, lambda m: let(F.array_join(F.transform(tokens, lambda w: F.get(marks, (F.array_position(m, w) - 1).cast("int"))), ""), tally))


def shares(counts: Column) -> Column:
    return let(F.greatest(F.lit(1.0), F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)), lambda n: F.transform(counts, lambda c: c / n))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) / 2 + part(y, (x + y) / 2) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words covered by a window of ``width`` words that is found twice or more (first included)."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(width)]).alias("h"), i.alias("p")))
        return let(F.sort_array(windows), of_sorted)

    def of_sorted(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0), lambda a, b: a + b))

    return F.when(F.size(tokens) < width + 1, F.lit(0)).otherwise(let(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes))


def duplicate_lines(text: Column) -> Column:
    r"""\n-split lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda a: F.size(a) - F.size(F.array_distinct(a)))


def facts(docs: DataFrame, carry: list[str], only: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` and one struct ``f`` of counts and histograms (those in ``only``), one pass over the texts."""
    text = F.coalesce("text", F.lit(""))

    def all_of(w: Column) -> Column:
        fields = {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_dup_lines": duplicate_lines(text).cast("long"),
            "n_repeat_words": repeated_words(w).cast("long"),
            "lang": language(F.col("lang")),
            "classes": classes(text),
            "common": common(w, F.col("lang")),
        }
        return F.struct(*[c.alias(k) for k, c in fields.items() if only is None or k in only])

    return docs.select(*[F.col(f"`{c}`") for c in carry], let(words(text), all_of).alias("f"))


def references(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """One row (q_lang, q_classes, q_common) a language: mean histograms over all its documents."""
    base = rows.filter(F.col("f.n_words") >= min_words).select(F.col("f.lang").alias("q_lang"), shares(F.col("f.classes")).alias("c"), shares(F.col("f.common")).alias("m"))
    mean = lambda name, n: F.array(*[F.avg(F.col(name)[i]) for i in range(n)])
    return base.groupBy("q_lang").agg(mean("c", len(CLASSES)).alias("q_classes"), mean("m", 17).alias("q_common"))


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``f`` is worked out once a row: Spark moves no filter on its fields below what depends on the partition."""
    return rows.withColumn("f", F.when(F.spark_partition_id() >= 0, F.col("f")))


def judge(docs: DataFrame, min_words: int = 50, class_limit: tuple[float, float] = (0.18, 0.8), word_limit: tuple[float, float] = (0.1, 1.6), carry: list[str] | None = None, settled: bool = True) -> DataFrame:
    """``docs`` (or its columns ``carry``) with one struct column ``quality`` more.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept. A document of n words may be ``limit[0] + limit[1] / sqrt(n)``
    from its reference. Null and empty texts have no words and fail the base rules; a language that has
    no reference, null too, is one of its own, with no common words. Rows are judged one by one, so repeated
    rows and extra columns pass through unchanged (one named ``quality`` is replaced). An empty table gives
    an empty result. The texts are read once: their facts are settled, with the columns ``carry``, before references are
    taken. Not ``settled``, nothing is written, and the texts are read twice, for what references need first.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "quality"]
    names = [f"c{i}" for i in range(len(carry))]  # so that no name of the input clashes
    rows = facts(docs, carry).toDF(*names, "f")
    if settled:
        rows = seen = settle(rows, "facts")
    else:
        rows, seen = _once(rows), _once(facts(docs, [], ("n_words", "lang", "classes", "common")))
    refs = F.broadcast(references(seen, min_words))  # at most one row for each of LANGUAGES
    rows = rows.join(refs, F.col("f.lang") == F.col("q_lang"), "left")
    f = F.col("f")
    fields = {n: f[n] for n in ("n_words", "word_chars")} | {
        "n_symbols": f["classes"][CLASSES.index("symbol")].cast("long"),
        "n_dup_lines": f["n_dup_lines"],
        "n_repeat_words": f["n_repeat_words"],
        "class_distance": F.coalesce(distance(shares(f["classes"]), F.col("q_classes")), F.lit(0.0)),
        "word_distance": F.coalesce(distance(shares(f["common"]), F.col("q_common")), F.lit(0.0)),
    }
    rows = rows.select(*names, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("q"))
    q = F.col("q")
    failed = (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    bound = lambda limit: limit[0] + limit[1] / F.sqrt(F.greatest(q["n_words"], F.lit(1)))
    fine = (q["class_distance"] <= bound(class_limit)) & (q["word_distance"] <= bound(word_limit))
    quality = F.struct(*[q[n].alias(n) for n in fields], failed.alias("base_failed"), (~failed & fine).alias("kept"))
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, carry)], quality.alias("quality"))
