"""Line-first cleaning: rules per line, then per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import GAP, WORD, written

SYMBOLS = "#*$%&|<>"
#: A line of prose ends like this, closing quotes and brackets included.
ENDS = r"[.!?:;…。！？][\"'»“”’)\]]*[\x20\x09-\x0D]*\z"
#: A sentence that ends inside the line.
INNER_STOP = r"[.!?][\x20\x09]"
#: Menus, breadcrumbs and tables: separators between entries.
NAVIGATION = r"(?:[|»›•·>][^\n]*){3}"
#: Phrases of page furniture and licences.
BOILERPLATE = (
    r"(?i)lorem ipsum|javascript|cookie|all rights reserved|terms of (?:use|service)|privacy policy|licensed under|"
    r"spdx-license|copyright|\(c\) \d{4}|subscribe to|sign (?:in|up)|log ?in|click here|read more|share on|powered by"
)
MIN_WORDS = 10
MAX_REPEAT = 20
#: A document must keep this share of the characters of its lines.
MIN_KEPT = 0.2
#: A line may be symbols to this share.
MAX_SYMBOLS = 0.1


def symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def good_line(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line.

    A line without words passes (it carries nothing). Otherwise it must not be a
    menu or table row, nor page furniture, nor symbols to more than a tenth, and
    must end like a sentence or hold the end of one, so that cut lines stay.
    """
    plain = ~line.rlike(NAVIGATION) & ~line.rlike(BOILERPLATE) & (symbols(line) <= MAX_SYMBOLS * F.length(line))
    return ~line.rlike(WORD) | (plain & (line.rlike(ENDS) | line.rlike(INNER_STOP)))


def clean_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the line and document verdicts; only built-in expressions, no shuffle.

    New columns (input columns of these names are replaced): ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``n_lines``, ``n_kept_lines``, ``kept_chars`` (long), ``clean_text`` (the kept
    lines), ``base_failed`` and ``kept`` (boolean). A null text counts as no words
    and is rejected, as is every text of fewer than ten words; null ``clean_text``
    stays null. Rows are judged one by one, so ties and repeats do not matter.
    """
    text = F.col(f"`{text_col}`")
    whole = F.coalesce(text, F.lit(""))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kept_lines", "kept_chars", "clean_text", "base_failed", "kept"]
    carried = [f"`{c}`" for c in df.columns if c.lower() not in new]
    split = df.select(
        "*",
        F.transform(F.split(F.regexp_replace(whole, f"^{GAP}|{GAP}$", ""), GAP), lambda w: F.xxhash64(w)).alias("__words"),
        F.split(whole, "\n").alias("__lines"),
        (F.length(F.translate(whole, "\x20\x09\x0a\x0b\x0c\x0d", ""))).cast("long").alias("__chars"),
        symbols(whole).cast("long").alias("__symbols"),
    )
    hashed = split.select(
        "*",
        F.when(F.col("__chars") == 0, F.lit(0)).otherwise(F.size("__words")).cast("long").alias("__n"),
        F.when(
            F.size("__words") >= 5,
            F.transform(
                F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 4, F.lit(1))),
                lambda w, i: F.xxhash64(w, *[F.get(F.col("__words"), i + k) for k in range(1, 5)]),
            ),
        ).alias("__windows"),
        F.filter("__lines", lambda line: line.rlike(WORD)).alias("__full"),
        F.filter("__lines", good_line).alias("__good"),
    )
    marked = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("__placed"),
    )

    def twin(x: Column, i: Column) -> Column:
        before, after = F.get(F.col("__placed"), i - 1)["h"], F.get(F.col("__placed"), i + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

    found = marked.select("*", F.array_sort(F.transform(F.filter("__placed", twin), lambda x: x["i"])).alias("__at"))
    gaps = F.transform("__at", lambda p, i: F.when(i == 0, 5).otherwise(F.least(p - F.get(F.col("__at"), i - 1), F.lit(5))))
    counted = found.select(
        "*",
        F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("__repeat"),
        F.aggregate("__good", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("__kept"),
        F.aggregate("__lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("__all"),
    )
    failed = (F.col("__n") < MIN_WORDS) | (100 * F.col("__repeat") > MAX_REPEAT * F.col("__n"))
    return counted.select(
        *carried,
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size("__good").cast("long").alias("n_kept_lines"),
        F.col("__kept").alias("kept_chars"),
        F.when(text.isNotNull(), F.array_join("__good", "\n")).alias("clean_text"),
        failed.alias("base_failed"),
        (~failed & (F.col("__kept") >= MIN_KEPT * F.col("__all"))).alias("kept"),
    )


def keep_clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with their columns and whole texts.

    The verdicts are written with all counts before they are filtered: a filter,
    or a plan that needs the verdict alone, makes the optimizer evaluate the
    arrays again for each of their elements.
    """
    rows = df.select(F.struct("*").alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    judged = clean_lines(rows, "__text")
    return written(judged.drop("__text", "clean_text"), "judged").where("kept").select("__row.*")


def _like(line: str, pattern: str) -> str:
    return f"regexp_matches({line}, '{pattern.replace("'", "''")}')"


#: The same verdicts in SQL; windows of words are compared as text.
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), judged AS (
  SELECT doc_id, line, {_like("line", WORD)} AS has_word,
    NOT {_like("line", WORD)} OR (NOT {_like("line", NAVIGATION)} AND NOT {_like("line", BOILERPLATE)}
      AND length(line) - length(translate(line, '{SYMBOLS}', '')) <= {MAX_SYMBOLS} * length(line)
      AND ({_like("line", ENDS)} OR {_like("line", INNER_STOP)})) AS good
  FROM (SELECT doc_id, unnest(ls) AS line FROM d)
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (good) AS n_kept_lines,
    count(*) FILTER (has_word) - count(DISTINCT CASE WHEN has_word THEN line END) AS n_dup_lines,
    coalesce(sum(length(line)) FILTER (good), 0) AS kept_chars, sum(length(line)) AS all_chars
  FROM judged GROUP BY doc_id
), placed AS (
  SELECT doc_id, i, w[i : i + 4] AS window_words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, window_words FROM placed GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM placed JOIN twice USING (doc_id, window_words), range(5) r(k) GROUP BY doc_id
), counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, n_lines, n_kept_lines, kept_chars, all_chars
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND kept_chars >= {MIN_KEPT} * all_chars AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_kept_lines AS BIGINT) AS n_kept_lines
FROM counted
"""
