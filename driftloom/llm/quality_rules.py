"""Quality rules: a threshold table compiled into one projection.

``RULES`` is a table (name, ratio, least, most); ``compile_rules`` turns it into a list of
columns that one ``select`` evaluates next to the counts, with built-in functions only.
Counts of a text: words, code points in words, symbols, repeated lines, words in repeated
8-word windows, stop words, shouted words (no lower-case letter, at least two letters),
words that end in a run of marks.

The repeated windows of a text are found within its row: 64-bit hashes of its windows; if
all differ there are none; otherwise the hashes are sorted with their positions, those with
an equal neighbour are repeated, and the words they cover are counted from the gaps.  The
work for a text is n log n in its words, and nothing is shuffled.

Cases: null and empty texts have zero counts and fail the base (fewer than 20 words);
ratios over zero words are null and break no rule; ids may be null or repeated (each row is
judged on its own); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import documents, word_array

WIDTH = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is for on are as was this it by an or from at which "
    "der die das und ist zu den mit von für auf im ein eine nicht sich des dem auch als "
    "le la les et est un une de du des pour dans que qui sur par avec au ce pas "
    "el los las y es una en por con para del se lo como más su al que"
).split()

# name, ratio (of the counts), least, most; a ratio outside [least, most] breaks the rule.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("stop_word_share", "n_stop / n_words", 0.02, None),
    ("repeated_line_share", "n_dup_lines / n_lines", None, 0.5),
    ("shouted_share", "n_shouted / n_words", None, 0.5),
)


def compile_rules(rules: tuple = RULES) -> dict[str, Column]:
    """A boolean column for each rule: true if the row breaks it."""
    out = {}
    for name, ratio, least, most in rules:
        top, below = (x.strip() for x in ratio.split("/"))
        value = F.try_divide(F.col(top).cast("double"), F.col(below).cast("double"))
        breaks = F.lit(False)
        if least is not None:
            breaks = breaks | F.coalesce(value < least, F.lit(False))
        if most is not None:
            breaks = breaks | F.coalesce(value > most, F.lit(False))
        out[name] = breaks
    return out


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WIDTH words whose sequence occurs twice or more in the array."""
    n = F.size(words) - WIDTH + 1
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))
    pairs = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(1), n).alias("p")))

    def at(array: Column, i: Column) -> Column:
        return F.element_at(array, i.cast("int"))["h"]

    def covered(s: Column) -> Column:
        def repeats(x: Column, i: Column) -> Column:
            left = (i > 0) & (at(s, F.greatest(i, F.lit(1))) == x["h"])
            right = (i < F.size(s) - 1) & (at(s, F.least(i + 2, F.size(s))) == x["h"])
            return left | right

        found = F.sort_array(F.transform(F.filter(s, repeats), lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("int").alias("end"))
        step = lambda acc, p: F.struct(
            (acc["sum"] + p + WIDTH - F.greatest(p, acc["end"])).cast("long").alias("sum"), (p + WIDTH).cast("int").alias("end")
        )
        return F.aggregate(found, zero, step)["sum"]

    many = F.size(F.array_distinct(hashes)) < F.size(hashes)
    counted = F.aggregate(F.array(pairs), F.lit(0).cast("long"), lambda _, s: covered(s))
    return F.when(F.size(words) <= WIDTH, F.lit(0)).when(many, counted).otherwise(F.lit(0)).cast("long")


def _shouted(word: Column) -> Column:
    """No lower-case letter and two upper-case ones.  Two searches, each linear in the word's length."""
    return ~word.rlike(r"\p{Ll}") & word.rlike(r"\p{Lu}[^\p{Lu}]*\p{Lu}")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row of docs (doc_id, text), in one projection over its words and lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = [F.lit(x) for x in dict.fromkeys(STOP_WORDS)]
    split = docs.select("doc_id", text.alias("_text"), word_array(F.col("text")).alias("_w"), lines.alias("_l"))
    return split.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(*stops))).cast("long").alias("n_stop"),
        F.size(F.filter("_w", _shouted)).cast("long").alias("n_shouted"),
    )


def judge(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The counts, base_failed, a ``broken`` list of rule names, and kept."""
    broken = compile_rules(rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in broken.items()]), lambda x: x.isNotNull())
    return measure(docs).withColumn("base_failed", base).withColumn("broken", names).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(*COLUMNS)


def _oracle() -> str:
    checks = []
    for _, ratio, least, most in RULES:
        top, below = (x.strip() for x in ratio.split("/"))
        value = f"({top}::DOUBLE / nullif({below}, 0))"
        checks += [f"coalesce({value} >= {least}, true)"] if least is not None else []
        checks += [f"coalesce({value} <= {most}, true)"] if most is not None else []
    stops = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, w FROM d WHERE len(w) >= 8),
g1 AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS k FROM g),
g2 AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g1),
g3 AS (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 8, 0) AS e FROM g2 WHERE n > 1),
r AS (SELECT doc_id, sum(p + 8 - greatest(p, e))::BIGINT AS n FROM g3 GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop,
             len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$')))::BIGINT AS n_shouted
      FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {' AND '.join(checks)}) AS kept FROM b
"""


ORACLE_SQL = _oracle()
