"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of anything but ASCII white space (0x20, 0x09-0x0D). Every measure is a Column
expression over the text alone, so the whole verdict is one projection over the scan: no shuffle, no
Python. The one costly measure, words in repeated three-word windows, sorts each document's window
hashes, which keeps a document of n words at n log n.

Defined results: a null or empty text has no words, all counts 0, ``base_failed`` true, ``kept`` false.
Rows are judged one by one, so repeated rows each get their result and an empty table gives an empty one.
Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages of the corpus (fixed values).
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "ein", "mit", "de", "la", "le", "et", "les", "el", "que", "y", "en", "los")


@dataclass(frozen=True)
class Threshold:
    """Keeps documents whose ``ratio`` lies in [low, high]; a null ratio (nothing to divide by) passes."""

    name: str
    low: float | None
    high: float | None


#: The rules beyond the base ones, over the names that ``ratios`` makes.
THRESHOLDS = (
    Threshold("mean_word_chars", 1.5, 20.0),
    Threshold("symbols_per_word", None, 0.1),
    Threshold("exclamations_per_word", None, 0.2),
    Threshold("upper_share", None, 0.4),
    Threshold("digit_share", None, 0.3),
    Threshold("stop_words", 2.0, None),
    Threshold("duplicate_line_share", None, 0.3),
    Threshold("ellipsis_line_share", None, 0.3),
    Threshold("bullet_line_share", None, 0.9),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the document."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def covered(found: Column) -> Column:
        def starts(s: Column) -> Column:
            n = F.size(s)
            same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < n) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(at: Column) -> Column:
            n = F.size(at)
            steps = F.transform(at, lambda x, k: F.when(k + 1 < n, F.least(F.lit(width), F.get(at, k + 1) - x)).otherwise(width))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(let(let(pairs, starts), total))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, F.lit(0).cast("bigint")).otherwise(let(let(hashes, windows), covered))


def measures(text: Column) -> list[Column]:
    """The counts of the contract and those that the ratios need, for a text without nulls."""

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.array_intersect(F.array(*[F.lit(w) for w in STOP_WORDS]), F.transform(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))))).cast("bigint").alias("stop_words"),
        )

    def lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("bigint").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(found, lambda x: F.rtrim(x).endswith("..."))).cast("bigint").alias("n_ellipsis"),
            F.size(F.filter(found, lambda x: F.ltrim(x).rlike("^[-*\\u2022]"))).cast("bigint").alias("n_bullets"),
        )

    filled = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    size = F.octet_length
    return [
        F.length(without(text, WHITE)).cast("bigint").alias("word_chars"),
        (size(text) - size(without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        (size(text) - size(without(text, "!"))).cast("bigint").alias("n_exclamations"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        let(words_of(text), counts).alias("w"),
        let(filled, lines).alias("l"),
    ]


def ratios() -> dict[str, Column]:
    return {
        "mean_word_chars": F.try_divide(F.col("word_chars"), F.col("n_words")),
        "symbols_per_word": F.try_divide(F.col("n_symbols"), F.col("n_words")),
        "exclamations_per_word": F.try_divide(F.col("n_exclamations"), F.col("n_words")),
        "upper_share": F.try_divide(F.col("n_upper"), F.col("word_chars")),
        "digit_share": F.try_divide(F.col("n_digits"), F.col("word_chars")),
        "stop_words": F.col("stop_words").cast("double"),
        "duplicate_line_share": F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
        "ellipsis_line_share": F.try_divide(F.col("n_ellipsis"), F.col("n_lines")),
        "bullet_line_share": F.try_divide(F.col("n_bullets"), F.col("n_lines")),
    }


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean Column."""
    known, out = ratios(), F.lit(True)
    for t in thresholds:
        for bound, test in ((t.low, Column.__ge__), (t.high, Column.__le__)):
            if bound is not None:
                out &= F.coalesce(test(known[t.name], F.lit(float(bound))), F.lit(True))
    return out


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thresholds=THRESHOLDS, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Per document its measures, ``base_failed`` and ``kept``."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = base.select("doc_id", *measures(F.col("text"))).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.stop_words", "n_exclamations", "n_upper", "n_digits", "l.n_ellipsis", "l.n_bullets")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(thresholds)).alias("kept"))


def _sql() -> str:
    strip = "|".join(w for w in STOP_WORDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
q AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM p),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM q) WHERE c >= 2),
n AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM f) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(text, '!')) AS ex,
  len(regexp_extract_all(text, '[A-Z]')) AS up, len(regexp_extract_all(text, '[0-9]')) AS dg,
  len(list_distinct(list_filter(list_transform(ws, lambda x: rtrim(lower(x), '.,;:!?')), lambda x: regexp_full_match(x, '{strip}')))) AS st,
  len(list_filter(ls, lambda x: suffix(rtrim(x, ' '), '...'))) AS el,
  len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*\\x{{2022}}]'))) AS bu
  FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 20 * n_words AND n_symbols / n_words <= 0.1
   AND ex / n_words <= 0.2 AND up / word_chars <= 0.4 AND dg / word_chars <= 0.3 AND st >= 2
   AND coalesce(n_dup_lines / n_lines <= 0.3, true) AND coalesce(el / n_lines <= 0.3, true) AND coalesce(bu / n_lines <= 0.9, true)) AS kept
FROM b"""


ORACLE = _sql()
