"""Quality rules for texts: counted base rules, and how far a text's make-up lies from that of its language.

The method: a document is described by two histograms, one of character classes and one of
the most common words of its language, as they are written.  Each is compared with the language's reference by the
Jensen-Shannon distance (base 2, 0 to 1).  References come from the corpus itself: the mean
histograms of all documents of the language that pass the base rules, then once more of those
among them that lie within the limits, so that a large source of junk does not shape what
junk is compared with.  Documents below a minimum length are not judged by a histogram that
few counts cannot fill, nor are those of a language with too few documents.

Everything is a DataFrame expression.  Per document only arrays of its own words are held.

Defined results: null text counts as empty (no words, so ``base_failed``); documents without a
language form a language of their own; repeated rows are rows like any other; among equally
common words the smaller one counts as more common; a very long text is counted whole; an empty
table gives an empty result.  Columns outside ``carry`` are ignored and carried ones come back in
the struct ``row``, so no name can clash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import SPACE, saved, text_of

#: Most common words of a language that make bins of their own; their codes are printable ASCII.
COMMON_WORDS = 64
#: Share of a language's documents that hold a common word.
COMMON_SHARE = 0.01
#: Slots of the table that finds a common word's code.
SLOTS = 512
_FIRST_CODE = 33
#: Distances beyond which a text is unlike its language.
CHARACTER_LIMIT, WORD_LIMIT = 0.3, 0.4
#: Least counts for a histogram to be judged, and least documents behind a reference.
LEAST_CHARACTERS, LEAST_WORDS, LEAST_DOCUMENTS = 200, 100, 20
#: Base rules: fewest words, and most percent of words that lie in repeated windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50

# Symbols that the base rules count, and marks that ordinary sentences use.
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"()-–—…«»„“”‘’¿¡"

#: Character classes: lower-case letters, four by what does not belong to them, and all else.
CLASSES = ("lower", "upper", "digit", "mark", "sign", "other")
_MARK = MARKS.replace("-", r"\-")
_OUTSIDE = {"upper": r"\P{Lu}+", "digit": r"\P{N}+", "mark": f"[^{_MARK}]+", "sign": rf"[[^\p{{P}}\p{{S}}][{_MARK}]]+"}


def _count_of(text: Column, one: Column) -> Column:
    """How often a single character occurs in a text."""
    return F.length(text) - F.length(F.replace(text, one))


def counted(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Struct ``row``, the language, base counts, words and counts of character classes."""
    text, n = F.col("_text"), F.size("_words")
    threes = [F.slice("_words", F.lit(i), F.greatest(n - 2, F.lit(0))) for i in (1, 2, 3)]
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"),
        text_of().alias("_text"),
    )
    out = out.withColumn("_words", F.array_remove(F.split(text, f"{SPACE}+"), ""))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "_solid": F.array_join("_words", ""),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_threes": F.arrays_zip(*threes),
        }
    )
    # Most characters are lower-case letters, most of them a-z; what is left is short.
    rest = F.regexp_replace(F.regexp_replace("_solid", "[a-z]+", ""), r"\p{Ll}+", "")
    out = out.withColumns({"_rest": rest, "_hashes": F.transform("_threes", lambda x: F.xxhash64(x))})
    places = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    out = out.withColumns(
        {
            "word_chars": F.length("_solid").cast("long"),
            "n_symbols": (F.length("_rest") - F.length(F.translate("_rest", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_places": places,
            "_named": F.array(*[F.length(F.regexp_replace("_rest", outside, "")) for outside in _OUTSIDE.values()]),
            # Equal windows have equal hashes: without an equal pair there is nothing to sort.
            "_unique": F.size(F.array_distinct("_hashes")) == F.size("_hashes"),
        }
    )
    out = out.withColumn("_windows", F.when(~F.col("_unique"), F.sort_array(F.arrays_zip("_threes", "_places"))))
    named = F.aggregate("_named", F.lit(0), lambda a, x: a + x)
    out = out.withColumns(
        {
            "n_repeat_words": F.coalesce(_covered(F.col("_windows")), F.lit(0).cast("long")),
            "characters": F.concat(
                F.array((F.col("word_chars") - F.length("_rest")).cast("int")), F.col("_named"), F.array(F.length("_rest") - named)
            ),
        }
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.select(
        "row",
        "language",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "characters",
        F.col("_words").alias("words"),
    )


def _covered(windows: Column) -> Column:
    """Words that lie in windows which occur twice or more.

    Sorting has put equal windows side by side.  The places of those with an equal
    neighbour, in order, each add the words that the one before does not cover.
    """

    def repeated(x: Column, i: Column) -> Column:
        before, after = (F.get(windows, i + step)["_threes"] for step in (-1, 1))
        return x["_threes"].eqNullSafe(before) | x["_threes"].eqNullSafe(after)

    places = F.sort_array(F.transform(F.filter(windows, repeated), lambda x: x["_places"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, place: Column) -> Column:
        return F.struct(place.alias("last"), (a["n"] + F.least(F.lit(3), place - a["last"])).alias("n"))

    return F.aggregate(places, start, add, lambda a: a["n"])


def common_words(docs: DataFrame, size: int = COMMON_WORDS) -> DataFrame:
    """Per language the words that most documents hold: (language, common), most common first.

    Document counts, so that one long text of a single word has one vote.  A word counts as
    common from ``COMMON_SHARE`` of the language's documents on.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), text_of().alias("text"))
    words = F.array_distinct(F.array_remove(F.split("text", f"{SPACE}+"), ""))
    votes = rows.select("language", F.explode(words).alias("word")).groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("language").agg(F.count(F.lit(1)).alias("n_documents"))
    held = votes.join(sizes, "language").where(F.col("n") >= COMMON_SHARE * F.col("n_documents"))
    # The limit on the row number is applied in each task before the rows of a language meet.
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    first = held.withColumn("place", place).where(F.col("place") <= size)
    ranked = first.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    return ranked.select("language", F.col("words.word").alias("common"))


def _slots(common: DataFrame) -> DataFrame:
    """Common words dealt by a hash into slots, each with its words and their codes after that of no common word."""
    placed = common.select("language", F.posexplode("common").alias("place", "word"))
    dealt = placed.groupBy("language", _slot(F.col("word")).alias("slot")).agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("in"))
    codes = F.array_join(F.transform("in.place", lambda i: F.char(i + _FIRST_CODE + 1)), "")
    filled = dealt.select("language", "slot", F.col("in.word").alias("words"), F.concat(F.char(F.lit(_FIRST_CODE)), codes).alias("codes"))
    by = filled.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("words", "codes")))).alias("by"))
    return by.select("language", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.try_element_at("by", i)).alias("slots"))


def _slot(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(SLOTS))


def histograms(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), size: int = COMMON_WORDS) -> DataFrame:
    """Base counts and both histograms of every document, without its text.

    Every word becomes one character, its place among the common words (or none of them); the
    counts of characters in that short text are the histogram.
    """
    # A row per language, written first: by the size of its files Spark decides whether to broadcast it.
    slots = saved(_slots(common_words(docs, size)).coalesce(1), "common-words")
    out = counted(docs, carry).join(slots, "language", "left")

    def code(word: Column) -> Column:
        slot = F.get("slots", _slot(word))
        found = F.substr(slot["codes"], F.array_position(slot["words"], word) + 1, F.lit(1))
        return F.coalesce(found, F.char(F.lit(_FIRST_CODE)))

    out = out.withColumn("_codes", F.array_join(F.transform("words", code), ""))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(size)), lambda k: _count_of(F.col("_codes"), F.char(k + _FIRST_CODE)).cast("int")
    )
    return out.withColumn("common_counts", counts).drop("words", "slots", "_codes")


def _references(found: DataFrame, size: int) -> DataFrame:
    """Mean shares per language over documents that pass the base rules and are long enough to be judged."""
    columns = {"characters": len(CLASSES), "common_counts": size + 1}
    whole = {"characters": F.col("word_chars"), "common_counts": F.col("n_words")}
    fit = found.where(~F.col("base_failed") & (F.col("word_chars") >= LEAST_CHARACTERS) & (F.col("n_words") >= LEAST_WORDS))
    means = [F.avg(F.get(c, F.lit(i)) / whole[c]).alias(f"{c}_{i}") for c, n in columns.items() for i in range(n)]
    by = fit.groupBy("language").agg(F.count(F.lit(1)).alias("n_reference"), *means)
    return by.select(
        "language",
        "n_reference",
        *[F.array(*[f"{c}_{i}" for i in range(n)]).alias(f"{c}_reference") for c, n in columns.items()],
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares: the root of the divergence to base 2."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _shares(counts: str, whole: Column) -> Column:
    return F.transform(counts, lambda x: x / whole)


def _distances(found: DataFrame, references: DataFrame) -> DataFrame:
    """Adds both distances; null where a document or its reference is below the minimum."""
    joined = found.join(references, "language", "left")
    enough = F.col("n_reference") >= LEAST_DOCUMENTS
    out = joined
    for name, counts, whole, least in (
        ("character_distance", "characters", "word_chars", LEAST_CHARACTERS),
        ("word_distance", "common_counts", "n_words", LEAST_WORDS),
    ):
        far = divergence(_shares(counts, F.col(whole)), F.col(f"{counts}_reference"))
        out = out.withColumn(name, F.when(enough & (F.col(whole) >= least), far))
    return out.drop("n_reference", "characters_reference", "common_counts_reference")


def _unlike() -> Column:
    far = [F.col("character_distance") > CHARACTER_LIMIT, F.col("word_distance") > WORD_LIMIT]
    return F.coalesce(far[0], F.lit(False)) | F.coalesce(far[1], F.lit(False))


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), size: int = COMMON_WORDS) -> DataFrame:
    """Struct ``row``, base counts, ``base_failed``, both distances and ``kept`` of every document.

    ``docs`` needs ``text`` and ``lang``.  The histograms are written once, a few hundred
    bytes a document at most; both rounds of references read them.
    """
    found = saved(histograms(docs, carry, size), "histograms")
    first = saved(_references(found, size).coalesce(1), "references")
    near = _distances(found, first).where(~_unlike()).drop("character_distance", "word_distance")
    judged = _distances(found, saved(_references(near, size).coalesce(1), "references"))
    return judged.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~_unlike()).alias("kept"),
        "character_distance",
        "word_distance",
    )
