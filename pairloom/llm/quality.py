"""Quality rules with the frequency of lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import SPACES, words
from pairloom.operators.joins import fits_broadcast
from pairloom.sources.tables import scratch, stage

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line of so many words is cut where more than this number of the host's different texts has it, however large the host is.
MIN_LINE_WORDS = 3
MAX_LINE_DOCUMENTS = 10
#: A document is depleted where less than this share of its characters is left.
MIN_LEFT_PERCENT = 20
_LOOKUP_BYTES = 16 << 20


def _repeats(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows that occur twice or more in their text.

    Hashes with the low bits replaced by their position are sorted, so that
    equal windows become neighbours in n log n steps; the few that remain are
    compared by the whole hash. The shorter windows at the end equal no other.
    """
    w = ", ".join(f"get(w, i + {k})" for k in range(WINDOW))
    window = f"xxhash64({w})"
    equal = "(i > 0 and x.h = get(g, i - 1).h) or (i < size(g) - 1 and x.h = get(g, i + 1).h)"
    steps = {
        "b": "length(bin(size(w)))",
        "m": "shiftleft(-1L, b)",
        "s": f"sort_array(transform(w, (x, i) -> {window} & m | i))",
        "j": "filter(sequence(0, greatest(size(s) - 2, 0)), i -> (get(s, i) ^ get(s, i + 1)) & m = 0)",
        "f": "array_distinct(flatten(transform(j, i -> array(cast(get(s, i) & ~m as int), cast(get(s, i + 1) & ~m as int)))))",
        "g": f"sort_array(transform(f, i -> named_struct('h', {window}, 'i', i)))",
        "p": f"sort_array(transform(filter(g, (x, i) -> {equal}), x -> x.i))",
        "n_repeat_words": f"aggregate(transform(p, (x, i) -> least({WINDOW}, coalesce(get(p, i + 1), x + {WINDOW}) - x)), 0L, (a, x) -> a + x)",
    }
    for name, sql in steps.items():
        rows = rows.withColumn(name, F.expr(sql))
    return rows.drop("b", "m", "s", "j", "f", "g", "p")


def _lines(own: str) -> Column:
    """Of each line: the hash of its normalised form (lower case, no white space at the ends; null with too few words), its length and its place in the text."""
    several = f"[^{SPACES}]" + f"[{SPACES}]+[^{SPACES}]+" * (MIN_LINE_WORDS - 1)
    return F.transform(own, lambda x: F.struct(
        F.when(x["text"].rlike(several), F.xxhash64(F.lower(F.trim(x["text"])))).alias("line"), F.char_length(x["text"]).cast("long").alias("chars"), x["at"].alias("at")))


def _text_key(same: Column) -> Column:
    """Stands for a host and a text."""
    return F.xxhash64(F.col("host").isNull(), "host", same)


def document_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs``: its counts, and the hashes of its lines.

    ``same`` stands for the text. A null text has no words and no lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("text"))
    rows = rows.select(
        "doc_id", "host", F.xxhash64("text").alias("same"), words(F.col("text")).alias("w"),
        F.filter(
            F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("text"), i.alias("at"))), lambda x: x["text"].rlike(f"[^{SPACES}]"),
        ).alias("own"),
        (F.size(F.split("text", f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "host", "same", "w", "n_symbols", _lines("own").alias("lines"), F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("own") - F.size(F.array_distinct("own.text"))).cast("long").alias("n_dup_lines"),
    )
    return _repeats(rows).drop("w")


def frequent_lines(lines: DataFrame, max_documents: int = MAX_LINE_DOCUMENTS) -> DataFrame:
    """Lines in more distinct documents of a host than the limit allows: ``host, line``.

    ``lines`` has ``host, same, line``; documents with equal texts count once.
    The first grouping spreads a frequent line by document, the second sums
    partial counts.
    """
    found = lines.where("line is not null").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    return found.where(F.col("n") > max_documents).select("host", "line")


def _judged(docs: DataFrame, host: str, max_documents: int, min_left_percent: int) -> DataFrame:
    """Measures and verdict of every row, with ``text_key`` and the places of the lines to remove (``gone``, null: none)."""
    measured = stage(document_measures(docs, host), "quality")
    lines = measured.select("host", "same", F.explode("lines").alias("x")).select("host", "same", "x.line")
    often = stage(frequent_lines(lines, max_documents), "lines")
    often = often.select(F.xxhash64(F.col("host").isNull(), "host", "line").alias("key")).distinct()
    often = F.broadcast(often) if fits_broadcast(often, _LOOKUP_BYTES) else often
    texts = measured.groupBy("host", "same").agg(F.first("lines").alias("lines"))
    cut = (
        texts.select("host", "same", F.explode("lines").alias("x"))
        .withColumn("key", F.xxhash64(F.col("host").isNull(), "host", "x.line"))
        .join(often, "key", "left_semi").groupBy("host", "same").agg(F.sum("x.chars").alias("cut"), F.collect_list("x.at").alias("gone"))
        .select(_text_key(F.col("same")).alias("text_key"), "cut", "gone")
    )
    rows = measured.withColumn("chars", F.expr("aggregate(lines, 0L, (a, x) -> a + x.chars)")).drop("lines")
    rows = rows.withColumn("text_key", _text_key(F.col("same"))).join(cut, "text_key", "left")
    n, less = F.col("n_words"), F.coalesce(F.col("cut"), F.lit(0)).cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (100 * (F.col("chars") - less) >= min_left_percent * F.col("chars"))).alias("kept"),
        less.alias("cut_chars"), "text_key", "gone",
    )


def quality_rules(
    docs: DataFrame, host: str = "source", max_documents: int = MAX_LINE_DOCUMENTS, min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """Counts and a verdict for every row of ``docs`` (doc_id, text and ``host``; other columns are not read).

    ``base_failed``: fewer than 50 words, or over half of them in repeated
    three-word windows. ``cut_chars``: characters of lines of three words or
    more that more than ``max_documents`` different texts of the host share,
    whatever its size; ``cleaned_texts`` removes these lines. ``kept``
    is false for ``base_failed`` and where less than ``min_left_percent`` of the
    characters is left.

    Null or empty texts have counts of 0 and fail. A null host is a host of its
    own. Repeated rows get equal rows and count as one document; so do equal
    texts. Null ids are kept as they are. An empty table gives an empty result.
    """
    return _judged(docs, host, max_documents, min_left_percent).drop("text_key", "gone")


def cleaned_texts(
    docs: DataFrame, host: str = "source", max_documents: int = MAX_LINE_DOCUMENTS, min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, their ``text`` without the lines that too many documents of the host share.

    The other lines stay as they are and in their order; ``n_chars``, if there,
    follows a changed text. Rows are judged by host and text, so rows that
    share an id may fare differently. Rows without a doc_id are not filtered,
    but cleaned. Columns and their order are those of ``docs``, whatever their names.
    """
    with scratch(docs.sparkSession) as keep:
        judged = _judged(docs, host, max_documents, min_left_percent).where("n_words > 0 and (not kept or gone is not null)")
        verdict = keep(judged.groupBy("text_key").agg(F.first("kept").alias("kept"), F.first("gone").alias("gone")), "verdicts")
        verdict = F.broadcast(verdict) if fits_broadcast(verdict, _LOOKUP_BYTES) else verdict  # else all texts are shuffled
    key = F.xxhash64(F.col(host).isNull(), F.col(host).cast("string"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.where(F.col("doc_id").isNull() | F.col("text").rlike(f"[^{SPACES}]"))  # a text without words is never kept
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("text_key")).join(verdict, "text_key", "left")
    rows = rows.where("kept is null or kept or row.doc_id is null").withColumn("lines", F.split("row.text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    changed, row = F.col("gone").isNotNull(), {c: F.col("row").getField(c) for c in docs.columns}
    row["text"] = F.when(changed, F.array_join(left, "\n")).otherwise(row["text"])
    if "n_chars" in row:
        row["n_chars"] = F.when(changed, F.char_length(row["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return rows.select(*(x.alias(c) for c, x in row.items()))
