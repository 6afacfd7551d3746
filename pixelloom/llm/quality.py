"""Quality rules: a threshold table compiled into one projection, without user functions.

Metrics come from the whole text; the table ``RULES`` holds, for each ratio, its inclusive bounds.
Repeated 3-word windows are found inside each row: 33-bit hashes packed with the word position are sorted
as longs, equal neighbours are candidates, and candidates are compared again by their words, so a
chance collision changes nothing.

Defined results: a null text has no words, all metrics 0, ``base_failed`` true and ``kept`` false; rows that repeat
are judged alike; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, quoted, whole_row

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = """the of and to in is that it was for on with as be at by this are from or an have not
de la le les des et en un une du que qui dans pour par sur est au ne pas avec plus se ce
der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
el los las una por con para del su lo como más al y""".split()

#: metric, lowest, highest (None: open). Ratios as integer comparisons: numerator, denominator, bounds in percent.
RULES = (
    ("word_chars", "n_words", 200, 1500),
    ("n_symbols", "n_words", None, 20),
    ("n_stop_words", "n_words", 2, None),
    ("n_dup_lines", "n_lines", None, 40),
)


def _chars_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable over a one-element array."""
    return F.transform(F.array(value), body).getItem(0)


def _candidates(words: Column) -> Column:
    """Start positions of 3-word windows whose hash occurs twice or more."""
    n = F.size(words)
    low = F.lit((1 << 33) - 1)

    def packed(i):
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(low)
        return F.shiftleft(h, 30) + i.cast("long")

    codes = F.sort_array(F.transform(F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")), packed))

    def repeated(s):
        key = lambda x: F.shiftright(x, 30)
        same = lambda x, j: F.coalesce(key(x) == key(F.get(s, j)), F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.bitwiseAND(F.lit((1 << 30) - 1)).cast("int"))

    return _let(codes, repeated)


def _covered(words: Column, positions: Column) -> Column:
    """Words in those windows at ``positions`` that truly repeat."""
    keyed = F.sort_array(F.transform(positions, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))

    def repeated(s):
        same = lambda x, j: F.coalesce((x["a"] == F.get(s, j)["a"]) & (x["b"] == F.get(s, j)["b"]) & (x["c"] == F.get(s, j)["c"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    gaps = _let(_let(keyed, repeated), lambda s: F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(3)), F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")


def _metrics(text: Column) -> tuple[Column, ...]:
    """Columns w, l, chars and symbols: the counts that the rules use."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    stop = list(dict.fromkeys(STOP_WORDS))

    def counts(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop_words"),
            _let(_candidates(w), lambda p: F.when(F.size(p) > 0, _covered(w, p)).otherwise(F.lit(0).cast("long"))).alias("n_repeat_words"),
        )

    def line_counts(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    return (
        _let(words, counts).alias("w"),
        _let(lines, line_counts).alias("l"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("chars"),
        _chars_of(text, SYMBOLS).alias("symbols"),
    )


def quality(docs: DataFrame, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """row (all columns of ``docs`` as a struct), q (struct of all counts), base_failed, kept: one row per row."""
    q = F.struct(
        F.col("w.n_words").alias("n_words"),
        F.col("chars").alias("word_chars"),
        F.col("symbols").alias("n_symbols"),
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.col("w.n_stop_words").alias("n_stop_words"),
        F.col("l.n_lines").alias("n_lines"),
    )
    scored = docs.select(whole_row(docs), *_metrics(F.col(quoted(text_col)))).select("row", q.alias("q"))
    m = F.col("q")
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    ok = F.lit(True)
    for top, bottom, low, high in rules:
        if low is not None:
            ok = ok & (m[top] * 100 >= m[bottom] * low)
        if high is not None:
            ok = ok & (m[top] * 100 <= m[bottom] * high)
    return scored.select("row", "q", failed.alias("base_failed"), (~failed & ok).alias("kept"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, all counts, base_failed, kept: one row per row."""
    rows = quality(docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")))
    return rows.select("row.doc_id", "q.*", "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return quality(docs, text_col).filter("kept").select("row.*")
