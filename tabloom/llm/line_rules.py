"""Line-first document cleaning with DataFrame functions only.

Every line is judged by three rules; failing lines are removed and a document
that loses too much of its text with them is rejected:

* punctuation: a line of at least ``min_line_words`` words has to hold a
  sentence mark (``. ! ? … : ;`` or a CJK full stop), and no line may hold as
  many symbols (``# * $ % & | < > !``) as words;
* navigation: at least a third of the line's words are menu separators or the
  line is a menu word alone;
* boilerplate: fixed phrases of notices, cookie banners and page furniture.

All counts are computed row by row inside the scan: there is no shuffle, so a
hot source or a group of copies cannot gather in one task.

Defined cases: NULL or empty text has no words, 0 counts, fails the base rules
and is not kept. Very long texts take O(n log n). Repeated rows and repeated
or NULL ids are judged one by one. Other columns of the input are ignored, so
their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import SPACE_CHARS, SPACE_PATTERN, WORD_PATTERN, register, table

#: Symbols counted by the base rules.
SYMBOL_CLASS = r"[#*$%&|<>]"
#: Symbols of which a line has fewer than words.
LINE_SYMBOL_CLASS = r"[#*$%&|<>!]"
#: Marks of which a prose line has at least one.
SENTENCE_MARKS = r"[.!?…:;。！？]"
#: A word that only separates menu entries.
SEPARATOR_WORD = r"^[|>»«›‹•·/\\-]+$"
#: Lines that are one menu entry.
MENU_LINE = (r"(?i)^(home|menu|login|log in|sign in|sign up|register|search|next|previous|back|top|share|print|"
             r"contact|contact us|about|about us|sitemap|read more|more|skip to content)$")
#: Phrases of notices and banners.
BOILERPLATE = (r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|"
               r"enable javascript|accept (all )?cookies|lorem ipsum|subscribe to our newsletter)")

WINDOW = 8


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def repeated_window_words(word_hashes: Column, n: Column, width: int = WINDOW) -> Column:
    """Words covered by a ``width``-word window that occurs twice or more.

    ``word_hashes`` holds one 64-bit hash per word. Windows are compared by the
    hash of their word hashes. Only rows with a repeated window pay for the
    sort; the covered words are the sum of the gaps between repeated window
    starts, each at most ``width``.
    """
    windows = F.when(n >= width, F.transform(
        F.sequence(F.lit(1), (n - (width - 1)).cast("int")),
        lambda i: F.xxhash64(*[F.element_at(word_hashes, i + k) for k in range(width)])))

    def covered(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def same(i, step):
                return F.coalesce(F.get(s, i + step)["h"] == F.get(s, i)["h"], F.lit(False))
            flagged = F.transform(s, lambda x, i: F.when(same(i, -1) | same(i, 1), x["i"]))
            return F.array_sort(F.filter(flagged, lambda p: p.isNotNull()))

        def gaps(p: Column) -> Column:
            each = F.transform(p, lambda x, i: F.least(
                F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width)).cast("long"))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(_let(tagged, starts), gaps)

    return _let(windows, lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0).cast("long"))
                .otherwise(covered(h)))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_passes(line: Column, min_line_words: int) -> Column:
    """True for a line that none of the three rules removes (blank lines pass)."""
    bare = F.btrim(line, F.lit(SPACE_CHARS))
    parts = F.split(bare, SPACE_PATTERN)
    n = F.size(parts)
    separators = F.size(F.filter(parts, lambda w: w.rlike(SEPARATOR_WORD)))
    return (bare == "") | ~(
        ((n >= min_line_words) & ~bare.rlike(SENTENCE_MARKS))
        | (F.regexp_count(bare, F.lit(LINE_SYMBOL_CLASS)) >= n) | (separators * 3 >= n)
        | bare.rlike(MENU_LINE) | bare.rlike(BOILERPLATE))


def base_counts(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The counts of the base rules beside the columns ``keep``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    with_word = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    hashes = F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w))
    counted = docs.select(
        *keep, F.col(text).alias("__text"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"),
        (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"),
        _let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n"),
                                        repeated_window_words(h, F.size(h)).alias("r"))).alias("__w"))
    return counted.select(*keep, "__text", F.col("__w.n").alias("n_words"), "word_chars", "n_symbols",
                          "n_dup_lines", F.col("__w.r").alias("n_repeat_words"))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 20,
                max_repeat_pct: int = 30, min_line_words: int = 12, max_lost_pct: int = 50) -> DataFrame:
    """Judge every document line by line.

    Returns ``id_col``, the base counts, ``base_failed``, ``n_lines``,
    ``n_lines_removed``, ``chars_removed``, ``clean_text`` (remaining lines
    joined by ``\\n``) and ``kept``: false if a base rule failed or more than
    ``max_lost_pct`` percent of the characters were in removed lines.
    """
    d = base_counts(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")), "__t", "__id")
    t = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.split(t, "\n", -1)
    good = F.filter(lines, lambda x: line_passes(x, min_line_words))
    d = d.withColumn("__l", _let(good, lambda g: F.struct(
        F.size(lines).cast("long").alias("n"), F.size(g).cast("long").alias("g"),
        F.array_join(g, "\n").alias("t"))))
    d = d.withColumn("__lost", F.length(F.translate(t, SPACE_CHARS, ""))
                     - F.length(F.translate(F.col("__l.t"), SPACE_CHARS, "")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return d.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("__l.n").alias("n_lines"),
        (F.col("__l.n") - F.col("__l.g")).alias("n_lines_removed"), F.col("__lost").cast("long").alias("chars_removed"),
        F.col("__l.t").alias("clean_text"),
        (~failed & (100 * F.col("__lost") <= max_lost_pct * F.col("word_chars"))).alias("kept"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS r FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2)
  GROUP BY doc_id),
ln AS (
  SELECT doc_id, x, trim(x, e' \t\n\x0b\f\r') AS b FROM (SELECT doc_id, unnest(l) AS x FROM d)),
lw AS (SELECT doc_id, x, b, string_split_regex(b, '[\x20\x09-\x0D]+') AS p FROM ln),
lj AS (
  SELECT doc_id, x, b,
         NOT (b = '' OR NOT ((len(p) >= 12 AND NOT regexp_matches(b, '[.!?…:;。！？]'))
              OR len(b) - len(regexp_replace(b, '[#*$%&|<>!]', '', 'g')) >= len(p)
              OR 3 * len(list_filter(p, lambda q: regexp_matches(q, '^[|>»«›‹•·/\\-]+$'))) >= len(p)
              OR regexp_matches(b, '@MENU') OR regexp_matches(b, '@BOILER'))) AS bad,
         len(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS n
  FROM lw),
per AS (
  SELECT doc_id, count(*) FILTER (b <> '') - count(DISTINCT x) FILTER (b <> '') AS dup,
         sum(CASE WHEN bad THEN n ELSE 0 END) AS lost
  FROM lj GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w) AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         dup AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, lost
  FROM d JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 50 * word_chars AS kept
FROM c
""".replace("@MENU", MENU_LINE).replace("@BOILER", BOILERPLATE)


@register("op10_line_rules", SQL)
def op10_line_rules(spark, sf_dir):
    return clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
