"""Quality rules, native: base counts of every text and cross-document line frequency by host.

Only DataFrame functions run here. One pass over the texts writes a slim row of each: its counts and the hashes of its
normalised lines. Lines are counted on those rows with map-side combine, so that one hot line or host meets as one row a
task; the texts are not read again.

Documents of a host are told apart by their text: copies of a document count once, else every line of a document with many
copies would be frequent, and all its copies, the one to keep included, would go.

Defined results: null text counts as no words; an empty table gives an empty one; a null host is a host of its own; extra
columns are ignored, whatever their names; rows that repeat a doc_id are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import BROADCAST_ROWS, broadcast_if_small, materialize

_WHITE = " \t\n\x0b\x0c\r"
_WHITE_RE = "[ \\t-\\r]+"


def _words(text: Column) -> Column:
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE)), _WHITE_RE)


def _same(x: str, y: str) -> str:
    """SQL: the windows packed in x and y are one: equal hash bits, then equal words."""
    words = " AND ".join(f"get(_words, int({x} & _low) + {k}) = get(_words, int({y} & _low) + {k})" for k in range(3))
    return f"(({x} & _high) = ({y} & _high) AND {words})"


#: Words in 3-word windows that occur twice or more. A window is packed as the upper bits of its hash and its position, as
#: many bits as the text's number of words takes. Of the sorted windows those that share their hash bits with a neighbour
#: are left.
_LIKE = "filter(_w, (x, i) -> (x & _high) = (get(_w, i - 1) & _high) OR (x & _high) = (get(_w, i + 1) & _high))"
#: Neighbours are compared word by word, and where that fails all windows of the same bits, so that the count is exact.
#: Each repeated start covers the words up to the next one, three at most.
_REPEATS = f"""
aggregate(
  transform(
    transform(array(sort_array(transform(
      filter(_like, (x, i) -> {_same("x", "get(_like, i - 1)")} OR {_same("x", "get(_like, i + 1)")} OR exists(_like, y -> y <> x AND {_same("x", "y")})),
      x -> int(x & _low)))), s -> transform(s, (p, i) -> least(3, coalesce(get(s, i + 1) - p, 3)))),
    c -> aggregate(c, 0L, (a, b) -> a + b)),
  0L, (a, b) -> a + b)
"""
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normal_line(line: Column) -> Column:
    """A line lower-cased, trimmed, its inner white space single."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(_WHITE)), _WHITE_RE, " "))


def counted_texts(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, host, content (hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), lines
    (hash and words of every normalised line with a word) of every row; no shuffle. hash_bits: of a window's hash, for tests."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64("text").alias("content"), text.alias("_t"), _words(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_WHITE))) > 0)
    rows = rows.select(
        "doc_id", "host", "content", "_words",
        F.when(F.get("_words", F.lit(0)) == "", F.lit(0).cast("long")).otherwise(F.size("_words").cast("long")).alias("n_words"),
        F.length(F.regexp_replace("_t", _WHITE_RE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    window = "xxhash64(w, get(_words, i + 1), get(_words, i + 2))"
    if hash_bits < 64:
        window = f"shiftleft({window}, {64 - hash_bits})"
    hashed = F.expr(f"transform(slice(_words, 1, greatest(int(n_words) - 2, 0)), (w, i) -> {window})")
    marked = F.transform("_lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(_words(x)).alias("n")))
    rows = rows.select(
        "doc_id", "host", "content", "_words", "n_words", "word_chars", "n_symbols", hashed.alias("_h"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), marked.alias("lines"),
        F.expr("shiftleft(1L, length(bin(n_words))) - 1").alias("_low"),
    )
    rows = rows.withColumn("_high", F.expr("~_low"))
    rows = rows.withColumn("_w", F.expr("sort_array(transform(_h, (h, i) -> (h & _high) | cast(i as bigint)))"))
    rows = rows.withColumn("_like", F.expr(_LIKE))
    return rows.select("doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(_REPEATS).alias("n_repeat_words"), "lines")


def base_failed(repeat_share: float = 0.5, min_words: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100.0 > F.col("n_words") * (100.0 * repeat_share))


def frequent_lines(counted: DataFrame, line_share: float = 0.1, line_root: float = 20.0, min_docs: int = 20) -> DataFrame:
    """host, line: lines that more of a host's distinct texts hold than a limit: line_share of them, or line_root times the
    root of their number where that is less, so that the limit falls behind a growing host; min_docs at least.

    counted: of counted_texts. At most (lines of all texts / limit) lines a host pass."""
    rows = counted.select("host", "content", F.explode("lines.line").alias("line")).distinct()
    counts = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = counted.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    limit = F.greatest(F.least(F.col("total") * line_share, line_root * F.sqrt("total")), F.lit(float(min_docs)))
    many = counts.where(F.col("n_docs") > min_docs).alias("c").join(hosts.alias("h"), F.col("c.host").eqNullSafe(F.col("h.host")))
    return many.where(F.col("n_docs") > limit).select("c.host", "c.line")


def removed_words(counted: DataFrame, frequent: DataFrame) -> DataFrame:
    """row, removed_words: words in frequent lines of the rows (column row) that hold such lines."""
    lines = counted.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.n").alias("r")
    hot = broadcast_if_small(frequent).alias("f")
    found = lines.join(hot, (F.col("r.line") == F.col("f.line")) & F.col("r.host").eqNullSafe(F.col("f.host")), "left_semi")
    return found.groupBy("row").agg(F.sum("n").cast("long").alias("removed_words"))


def judged_texts(docs: DataFrame, line_share: float = 0.1, line_root: float = 20.0, min_docs: int = 20, max_removed: float = 0.5, repeat_share: float = 0.5, min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """The slim rows of all docs, with base_failed, kept, removed_words, and the frequent lines; both are written tables."""
    counted = materialize(counted_texts(docs).withColumn("row", F.monotonically_increasing_id()), "counted")
    frequent = materialize(frequent_lines(counted, line_share, line_root, min_docs), "frequent")
    depleted = materialize(removed_words(counted, frequent), "depleted")
    out = counted.drop("lines").join(broadcast_if_small(depleted, limit=BROADCAST_ROWS), "row", "left")
    out = out.withColumns({"removed_words": F.coalesce("removed_words", F.lit(0).cast("long")), "base_failed": base_failed(repeat_share, min_words)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= F.col("n_words") * max_removed)), frequent


def quality_rules(docs: DataFrame, **how) -> DataFrame:
    """doc_id, the counts, base_failed, kept and removed_words of every row. kept: not base_failed, and at most max_removed
    of the words in lines that are frequent on the host. how: of judged_texts."""
    return judged_texts(docs, **how)[0].select("doc_id", *_BASE, "base_failed", "kept", "removed_words")


def kept_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the rules keep, all columns; lines frequent on the host are cut from text, n_chars follows.

    The frequent lines of a host are few (see frequent_lines) and meet the host's rows as one array."""
    judged, frequent = judged_texts(docs, **how)
    gone = materialize(judged.where("not kept").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct(), "gone")
    rows = docs.join(broadcast_if_small(gone), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_content")), "left_anti")
    arrays = frequent.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_hot"))
    rows = rows.join(broadcast_if_small(arrays, frequent.count()), F.col("source").eqNullSafe(F.col("_host")), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x: ~F.array_contains(F.col("_hot"), F.xxhash64(normal_line(x))))
    cut = rows.withColumn("_left", F.when(F.col("_hot").isNotNull(), left))
    changed = F.col("_left").isNotNull() & (F.size("_left") < F.size(lines))
    cut = cut.withColumn("_text", F.when(changed, F.array_join("_left", "\n")))
    columns = [F.coalesce("_text", "text").alias("text") if c == "text" else F.when(F.col("_text").isNotNull(), F.char_length("_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return cut.select(*columns)
