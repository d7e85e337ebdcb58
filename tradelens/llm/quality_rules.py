"""Quality rules: distribution divergence from language references.

Each language has two reference histograms, summed over all its documents:
character classes, and its most common short words plus "any other word". A
document is compared with every language by Jensen-Shannon distance and
judged against the nearest one of each kind. Short texts are not judged by
histograms that they are too short to fill (minimum-length guards).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelens.llm.common import WORD, materialize

#: The symbols of the rule, and the character classes of the histogram (one per line,
#: as the characters that each class removes; letters outside ASCII and all other characters follow).
SYMBOLS = "#*$%&|<>"
CLASSES = {
    "vowel": "aeiou",
    "consonant": "bcdfghjklmnpqrstvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\n\x0b\x0c\r",
    "stop": ".,;:!?'\"()-",
    "symbol": SYMBOLS,
}
#: Common words of a language: its COMMON most frequent ones among words of up to COMMON_LENGTH letters.
COMMON, COMMON_LENGTH = 8, 6
#: Guards: characters and words from which a histogram is judged; the largest distance that passes.
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.25

_EDGE = r"^[\p{Punct}]+|[\p{Punct}]+$"


def base_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and the base counts of the rules (see ``judge_quality``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    with_word = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), text.alias("text"))
    df = df.withColumn("words", words).withColumn("lines", with_word)
    df = df.withColumn("n_words", F.size("words").cast("long"))
    windows = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))
    df = df.withColumn("windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    # windows next to each other in hash order tell the repeated ones; their places give the words they cover
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered))
    repeated = F.sort_array(F.transform(
        F.filter("ordered", lambda x, k: (F.get("ordered", k - 1).h == x.h) | (F.get("ordered", k + 1).h == x.h)),
        lambda x: x.i))
    df = df.withColumn("repeated", F.coalesce(repeated, F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("repeated", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("repeated", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    return df.select(
        "doc_id", "lang", "text", "words", "n_words",
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def _class_counts() -> list[Column]:
    """Counts of ``CLASSES`` in order, then letters outside ASCII, then the rest."""
    named = [(F.length("text") - F.length(F.translate("text", chars, ""))).cast("double") for chars in CLASSES.values()]
    foreign = F.length(F.regexp_replace("text", r"[\x00-\x7f]|[^\p{L}]", "")).cast("double")
    rest = F.length("text") - reduce(lambda a, b: a + b, [*named, foreign])
    return [*named, foreign, rest]


def common_words(docs: DataFrame, common: int = COMMON) -> dict[str, list[str]]:
    """The ``common`` most frequent short words of each language, counted over all documents."""
    words = (docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
             .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
             .filter((F.col("word") != "") & (F.length("word") <= COMMON_LENGTH)))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counted.withColumn("rank", rank).filter(F.col("rank") <= common)  # cut in each task before the shuffle
    out: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "rank").collect():  # ``common`` rows per language
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def _js_distance(p: list[Column], q: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms given as shares."""
    total = F.lit(0.0)
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total = total + F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
        if b > 0:
            total = total + b * F.log2(b / m)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, word_distance.

    Needs ``doc_id``, ``text`` and ``lang`` (only to build the references). A
    NULL text counts as empty: no words, so the base fails. Without any
    language reference only the base rules decide. Distances below a guard
    are NULL. Repeated rows are judged as often as they occur; an empty
    table gives an empty result.
    """
    by_language = common_words(docs)
    vocabulary = sorted({w for words in by_language.values() for w in words})
    df = base_measures(docs)
    df = df.withColumn("n_chars", F.length("text"))
    df = df.withColumn("classes", F.array(*_class_counts()))
    if vocabulary:
        plain = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
        df = df.withColumn("plain", plain)
        df = df.withColumn("n_plain", F.size("plain"))
        df = df.withColumn("common", F.filter("plain", lambda w: w.isin(vocabulary))).drop("plain")
        df = df.withColumn("found", F.array(*[
            F.size(F.array_remove("common", v)).cast("double") for v in vocabulary]))
        df = df.withColumn("found", F.transform("found", lambda kept: F.size("common") - kept))
    df = df.drop("words", "text", "common") if vocabulary else df.drop("words", "text")
    df = materialize(df, "document-histograms")  # one pass over the texts for references and verdicts

    # the references: sums over all documents of a language (languages x bins values)
    n_classes = len(CLASSES) + 2
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)]
    if vocabulary:
        sums += [F.sum(F.get("found", F.lit(i))).alias(f"w{i}") for i in range(len(vocabulary))]
        sums.append(F.sum("n_plain").alias("plain"))
    references = df.filter(F.col("lang").isin(list(by_language))).groupBy("lang").agg(*sums).collect()

    class_distances, word_distances = [], []
    for r in references:
        all_chars = sum(r[f"c{i}"] for i in range(n_classes)) or 1.0
        class_distances.append(_js_distance(
            [F.get("classes", F.lit(i)) / F.col("n_chars") for i in range(n_classes)],
            [r[f"c{i}"] / all_chars for i in range(n_classes)]))
        at = [vocabulary.index(w) for w in by_language[r["lang"]]]
        all_words = r["plain"] or 1
        shares = [r[f"w{i}"] / all_words for i in at]
        found = [F.get("found", F.lit(i)) / F.col("n_plain") for i in at]
        word_distances.append(_js_distance(
            [*found, F.greatest(1 - reduce(lambda a, b: a + b, found), F.lit(0.0))], [*shares, max(0.0, 1 - sum(shares))]))

    def nearest(distances: list[Column]) -> Column:
        return F.least(*distances) if len(distances) > 1 else distances[0]

    absent = F.lit(None).cast("double")
    df = df.withColumn("class_distance", F.when(F.col("n_chars") >= MIN_CHARS, nearest(class_distances))
                       if class_distances else absent)
    df = df.withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS) & (F.col("n_plain") > 0),
                                               nearest(word_distances)) if word_distances else absent)
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    near = ((F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE)
            & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE))
    return (df.withColumn("base_failed", base_failed)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance"))
