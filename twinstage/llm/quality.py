"""Quality rules by distribution divergence, in DataFrame functions only.

Per document: a histogram of character classes and one of the common words of its
language. Both are compared with the language's reference by Jensen-Shannon distance
(the square root of the divergence to base 2, so 0 to 1).

Reference: every document that passes the base rule and the guards counts with its shares,
so the same whatever its length; the shares are averaged by source, and the reference is
the median of the sources' averages, share by share. So neither long texts nor one hot
source shift it: odd sources would have to be half of a language's. Sources of fewer than
``CELL`` documents, and documents without a source, are averaged in cells of about that
many. Where a language has one or two sources only, these are the reference.

Short texts have noisy histograms: below ``min_chars`` or ``min_words`` the distance is
not judged, and above that the limit follows the length: to the square of the given
distance comes what the divergence of n draws from the reference itself stays below
(mean and three deviations of chi-square with k - 1 degrees over 8 n ln 2).

Counts (words are runs of anything but 0x20 and 0x09–0x0D): word_chars, n_symbols,
n_dup_lines, n_repeat_words as described at their expressions. One pass over the texts
makes a narrow row per document, stored once; the references are aggregates of it
(partial per task, so a language or source with most rows is no hot key), joined back by
language. Shares are added as integers, so that reruns agree.

Edge cases: a null or empty text has no words and fails the base rule; an unknown
language has no list of common words, so only its character classes are judged; texts
without a language have nothing in common to be held against and are judged by the base
rule alone; rows that repeat an id are judged each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as X

# Function words, by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "or"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
CELL = 8           # documents that an average of the reference has at least
_CELLS = 1021      # cells of documents without a source, by language
_UNIT = 1 << 30    # shares are added in this unit
_ACCURACY = 10_000  # of the sketch that narrows the search for a median
# Character classes, each counted on what the ones before it left.
CLASSES = [("lower", "[a-z]+"), ("space", SPACE), ("other_script", r"[^\x00-\x7F]+"), ("upper", "[A-Z]+"),
           ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+")]
_CODES = "abcdefghijklmnop"


def _base_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """One narrow row per document: id, lang, source, the base counts and both histograms."""
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), source.alias("source"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rest: Column = F.col("text")
    left = [F.length("text").alias("left_0")]
    for k, (_, pattern) in enumerate(CLASSES):  # each step works on what is left, mostly a tenth after the first
        d = d.withColumn(f"rest_{k}", F.regexp_replace(rest, pattern, ""))
        rest = F.col(f"rest_{k}")
        left.append(F.length(rest).alias(f"left_{k + 1}"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("id", "lang", "source", "mark", *left, lines.alias("lines"), F.array_remove(F.split("text", SPACE), "").alias("words"))

    codes = F.lit("")
    for lang, words in COMMON_WORDS.items():
        code = F.create_map(*[F.lit(x) for pair in zip(words, _CODES) for x in pair])
        codes = F.when(F.col("lang") == lang, F.array_join(_coded("words", words, code), "")).otherwise(codes)
    d = d.select("id", "lang", "source", "mark", *[f"left_{k}" for k in range(len(CLASSES) + 1)],
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("words").cast("long").alias("n_words"), codes.alias("codes"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))

    # words in windows of eight words that occur twice or more: sort the windows with their places,
    # keep those equal to a neighbour, and add up what each of them covers beyond the one before
    n = F.size("hashes")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW),
                         lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)]))
    d = d.withColumn("windows", F.when(n >= WINDOW, window)).drop("hashes")
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("placed", F.when(again, F.sort_array(F.transform(
        "windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))).drop("windows")
    same = F.filter("placed", lambda x, i: F.coalesce(F.get("placed", i - 1)["w"] == x["w"], F.lit(False))
                    | F.coalesce(F.get("placed", i + 1)["w"] == x["w"], F.lit(False)))
    d = d.withColumn("places", F.sort_array(F.transform(same, lambda x: x["i"]))).drop("placed")
    covered = F.transform("places", lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW))).cast("long"))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))

    classes = [(F.col(f"left_{k}") - F.col(f"left_{k + 1}")).cast("long") for k in range(len(CLASSES))]
    classes.append(F.col(f"left_{len(CLASSES)}").cast("long"))
    common = [(F.length("codes") - F.length(F.replace("codes", F.lit(c), F.lit("")))).cast("long") for c in _CODES]
    common.append(F.col("n_words") - F.length("codes"))
    return d.select("id", "lang", "source", "mark", "n_words", (F.col("left_0") - classes[1]).cast("long").alias("word_chars"),
                    classes[5].alias("n_symbols"), "n_dup_lines", repeated.alias("n_repeat_words"),
                    F.array(*classes).alias("classes"),
                    F.when(F.col("lang").isin(list(COMMON_WORDS)), F.array(*common)).alias("common"))


def _coded(words: str, listed: list[str], code: Column) -> Column:
    return F.transform(F.filter(words, lambda w: w.isin(listed)), lambda w: code[w])


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null where one has no counts."""
    def share(x):
        total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
        return F.when(total > 0, F.transform(x, lambda v: v / total))

    def part(a, b):
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(share(p), share(q), lambda a, b: (part(a, b) + part(b, a)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that pass ``judge_quality``. Verdicts find their rows by id and a
    hash of the text and language, so rows that share an id keep verdicts of their own."""
    bad = judge_quality(docs, id_col, text_col, lang_col, **options).where(~F.col("kept"))
    bad = bad.select(F.col(id_col).alias("bad_id"), F.xxhash64("mark", "lang").alias("bad_mark")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"),
                       F.xxhash64(F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), docs[lang_col]).alias("mark"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("mark") == F.col("bad_mark"))
    return rows.join(bad, same, "left_anti").select("row.*")


def _references(rows: DataFrame) -> DataFrame:
    """ref_lang, ref_classes, ref_common: medians of the average shares of each language's sources.
    ``rows``: lang, source, mark and the histograms, null where they are not to count."""
    sizes = {"classes": len(CLASSES) + 1, "common": len(_CODES) + 1}
    names = [f"{c}_{k}" for c, m in sizes.items() for k in range(m)]
    total = {c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v) for c in sizes}
    shares = [F.round(F.col(c)[k] * F.lit(float(_UNIT)) / total[c]).cast("long").alias(f"{c}_{k}")
              for c, m in sizes.items() for k in range(m)]
    sub = F.when(F.col("source").isNull(), F.pmod("mark", F.lit(_CELLS))).otherwise(F.lit(-1).cast("long"))
    counts = [F.count(f"{c}_0").alias(f"n_{c}") for c in sizes]
    d = rows.where(F.col("lang").isNotNull() & F.col("classes").isNotNull()).select("lang", "source", sub.alias("sub"), *shares)
    d = d.groupBy("lang", "source", "sub").agg(*counts, *[F.sum(x).alias(x) for x in names])
    # small ones together, about CELL documents in each cell
    small = F.col("n_classes") < CELL
    few = d.groupBy("lang").agg(F.sum(F.when(small, F.col("n_classes")).otherwise(0)).alias("few"))
    d = d.join(few.withColumnRenamed("lang", "few_lang"), F.col("lang") == F.col("few_lang"))
    bins = F.greatest(F.lit(1), F.least(F.lit(_CELLS), F.floor(F.col("few") / CELL))).cast("long")
    cell = F.when(small, F.pmod(F.xxhash64("source", "sub"), bins)).otherwise(F.lit(-1).cast("long"))
    d = d.groupBy("lang", F.when(~small, F.col("source")).alias("source"), F.when(~small, F.col("sub")).alias("sub"),
                  cell.alias("cell")).agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in sizes], *[F.sum(x).alias(x) for x in names])
    d = d.select("lang", *[(F.col(f"{c}_{k}") / F.col(f"n_{c}")).alias(f"{c}_{k}") for c, m in sizes.items() for k in range(m)])
    d = _medians(X.stored(d, "quality-cells"), names)
    return d.select(F.col("lang").alias("ref_lang"), *[
        F.when(F.col(f"{c}_0").isNotNull(), F.array(*[f"{c}_{k}" for k in range(m)])).alias(f"ref_{c}") for c, m in sizes.items()])


def _medians(cells: DataFrame, names: list[str]) -> DataFrame:
    """lang and the exact median of each named column (of an even number: the mean of the lower and the upper one).

    A sketch, off by at most a rank in ``_ACCURACY``, gives ends on either side of the middle; values between
    them are counted by value, those below as one (null), and the middle ranks found in the running count. A window
    holds the values between the ends only.
    """
    rows = cells.select("lang", F.posexplode(F.array(*names)).alias("k", "v")).where(F.col("v").isNotNull())
    probs = [0.5 - 2.0 / _ACCURACY, 0.5 + 2.0 / _ACCURACY]
    ends = X.stored(rows.groupBy("lang", "k").agg(F.count("v").alias("n"), F.percentile_approx("v", probs, _ACCURACY).alias("q")),
                    "quality-ends")
    held = F.when(F.col("v") >= F.col("q")[0], F.col("v")).alias("v")
    near = rows.join(ends, ["lang", "k"]).where(F.col("v") <= F.col("q")[1]).groupBy("lang", "k", "n", held).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang", "k").orderBy(F.col("v").asc_nulls_first()))
    near = near.withColumn("upto", upto).where(F.col("v").isNotNull())
    low, high = (F.min(F.when(F.col("upto") > F.floor(at / 2), F.col("v"))) for at in (F.col("n") - 1, F.col("n")))
    middle = near.groupBy("lang", "k").agg(((low + high) / 2).alias("m"))
    return middle.groupBy("lang").agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(x) for k, x in enumerate(names)])


def limit(distance: float, n: Column, k: int) -> Column:
    """Largest distance that passes for a histogram of ``k`` classes and ``n`` counts."""
    noise = ((k - 1) + 3 * math.sqrt(2 * (k - 1))) / (8 * math.log(2))
    return F.sqrt(F.lit(float(distance * distance)) + F.lit(noise) / n)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  max_class_distance: float = 0.25, max_word_distance: float = 0.25, min_chars: int = 200,
                  min_words: int = 80, source_col: str = "source") -> DataFrame:
    """One row per document: id_col, the base counts, base_failed, both distances, kept; lang, and mark (a
    hash of the text). ``source_col`` may be missing."""
    X.ready(docs.sparkSession)
    rows = X.stored(_base_counts(docs, id_col, text_col, lang_col, source_col), "quality")
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, v: a + v)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    enough = {"classes": chars >= min_chars, "common": F.col("n_words") >= min_words}
    # stored, so that Spark sees how small it is and the join does not deal rows by language
    reference = X.stored(_references(rows.where(~failed).select(
        "lang", "source", "mark", *[F.when(ok, F.col(c)).alias(c) for c, ok in enough.items()])), "quality-reference")
    d = rows.join(reference, F.col("lang") == F.col("ref_lang"), "left").withColumn("chars", chars)
    by_class = F.when(enough["classes"], js_distance(F.col("classes"), F.col("ref_classes")))
    by_word = F.when(enough["common"], js_distance(F.col("common"), F.col("ref_common")))
    d = d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 failed.alias("base_failed"), by_class.alias("class_distance"), by_word.alias("word_distance"),
                 "lang", "mark", "chars")
    odd = (F.coalesce(F.col("class_distance") > limit(max_class_distance, F.col("chars"), len(CLASSES) + 1), F.lit(False))
           | F.coalesce(F.col("word_distance") > limit(max_word_distance, F.col("n_words"), len(_CODES) + 1), F.lit(False)))
    return d.withColumn("kept", ~F.col("base_failed") & ~odd).drop("chars")
