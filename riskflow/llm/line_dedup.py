"""Lines that repeat an earlier line, exactly or but for one edit.

A line within one edit of another has a deletion variant in common with it: both without
one character at the same place (a replaced character), or one of them as it is and the
other without one character (a missing one). Every line that can have such a partner emits
its variants as hashes, lines of equal variant meet at the variant's earliest line, the edit
distance is verified, and lines with an earlier partner go.

A variant is hashed from chunks: the hash of the text without a character combines hashes of
the chunks before it, of its own chunk and of the chunks after it, shifted by one. All sums
of one line are linear in its length. Which lines can have a partner is known beforehand:
one edit leaves the first or the last part of a line as it is, so a line whose two parts
both occur nowhere else is done. The others are cut into eighths: an edit leaves all but one
of them as they are, so characters go only in an eighth around which two lines are equal, and
variants are of that eighth, with a hash of the rest. Equal lines are one row before anything else, so that a
line repeated in a third of all documents is one line here.

Defined cases: lines are compared without white space at their ends. Blank lines always
stay. Lines under ``MIN_CHARS`` characters are compared exactly. A line goes if any earlier
one (by document id, nulls last, then place) is equal or within one edit, whether that one
stays or not. A null text is an empty one. Rows of one id are at the same places, so none of
their lines is earlier than another's at its place; each row loses its own lines only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

MIN_CHARS = 16
CHUNK = 64
#: Places of an edit that are told apart by what is around them; a power of two.
GAPS = 8
WHITE_SPACE = "\t\n\x0b\x0c\r "
#: No document has so many lines; no id is as large.
LINES = 1 << 31
NO_DOCUMENT = str(1 << 63)


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """Every line that is not blank: doc_id, line_no, line, key_a, key_b."""
    # Trimmed within the array, as a filter on a column made here would trim once more.
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda raw: F.btrim(raw, F.lit(WHITE_SPACE)))
    return (
        docs.select("doc_id", *more, F.posexplode(trimmed).alias("line_no", "line"))
        .filter("line <> ''")
        # 128 bits that stand for a line.
        .withColumns({"key_a": F.xxhash64("line"), "key_b": F.xxhash64(F.lit("second"), "line")})
    )


KEY = ["key_a", "key_b"]


def _place() -> Column:
    """Order of lines as one number: document, then line; documents without an id come last."""
    document = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(NO_DOCUMENT).cast("decimal(20,0)"))
    return (document * F.lit(LINES).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(32,0)")


def _part_keys(line: Column) -> list[Column]:
    """Keys of which lines within one edit share at least one; null where there is no other size of parts.

    The first and the last part, under half of the line each. Their size changes at multiples
    of eight characters; a line next to such a border also takes the size of the lines across it.
    """
    size = F.length(line)
    own, across = (F.shiftleft(F.shiftright(near, 3), 2) for near in (size - 1, size + 1))

    def keys(part: Column) -> list[Column]:
        return [
            F.xxhash64(F.lit("first"), part, F.substr(line, F.lit(1), part)),
            F.xxhash64(F.lit("last"), part, F.substr(line, size - part + 1)),
        ]

    return keys(own) + [F.when(across != own, key) for key in keys(across)]


def _gaps(lines: DataFrame) -> DataFrame:
    """Every line without each of its eighths: line_id, ``gap`` (a hash of the rest), ``start``, ``line`` (the eighth).

    Of two lines within one edit, some gap has the edit in both, and they are equal around it.
    It begins at a multiple of an eighth of the shorter one, rounded down, and ends at one
    from the end. Lines next to a border of sizes take both sizes, as for parts.
    """
    size, step = F.length("line"), GAPS.bit_length() - 1
    parts = F.array_distinct(F.array(*[F.shiftright(near, step) for near in (size - 1, size + 1)]))
    each = lines.select("line_id", "line", F.explode(parts).alias("part"))
    each = each.select("line_id", "line", "part", F.explode(F.sequence(F.lit(0), F.lit(GAPS - 1))).alias("i"))
    start, rest = F.col("i") * F.col("part"), (GAPS - 1 - F.col("i")) * F.col("part")
    around = F.xxhash64("part", "i", F.substr("line", F.lit(1), start), F.substr("line", size - rest + 1))
    return each.select("line_id", around.alias("gap"), start.alias("start"), F.substr("line", start + 1, size - start - rest).alias("line"))


def _deletions(lines: DataFrame) -> DataFrame:
    """Every gap without each of its characters: line_id, ``variant`` (a hash), ``place`` (in the whole line)."""
    cut = _cut(lines)
    size = F.length("line")
    pieces = (
        cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .withColumn(
            "rest",
            _xor(F.slice("own", F.lit(1), F.col("i"))).bitwiseXOR(
                _xor(F.slice("shifted", F.col("i") + 2, F.greatest(F.size("shifted") - F.col("i") - 1, F.lit(0))))
            ),
        )
        .select(
            "line_id",
            "gap",
            "start",
            size.alias("size"),
            "i",
            "rest",
            F.substr("line", F.col("i") * CHUNK + 1, F.lit(CHUNK + 1)).alias("piece"),
            F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK), size - F.col("i") * CHUNK) - 1)).alias("at"),
        )
    )
    piece = F.concat(F.substr("piece", F.lit(1), F.col("at")), F.substr("piece", F.col("at") + 2))
    own = F.when(piece == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64("i", piece))
    return pieces.select(
        "line_id",
        F.xxhash64("gap", F.col("size") - 1, F.col("rest").bitwiseXOR(own)).alias("variant"),
        (F.col("start") + F.col("i") * CHUNK + F.col("at")).alias("place"),
    )


def _cut(lines: DataFrame) -> DataFrame:
    """Lines with the hashes of their chunks, ``own``, and of those a character later, ``shifted``."""

    def hashes(shift: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.col("n_chunks") - 1),
            lambda i: F.xxhash64(i, F.substr(F.col("line"), i * CHUNK + 1 + shift, F.lit(CHUNK))),
        )

    size = F.length("line")
    cut = lines.withColumn("n_chunks", F.ceil(size / F.lit(CHUNK)).cast("int"))
    # Where the last chunk is one character, nothing is left of it a character later.
    last_empty = (size - 1) == (F.col("n_chunks") - 1) * CHUNK
    shifted = F.when(last_empty, F.slice(hashes(1), F.lit(1), F.col("n_chunks") - 1)).otherwise(hashes(1))
    return cut.withColumn("own", hashes(0)).withColumn("shifted", shifted)


def _xor(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda left, right: left.bitwiseXOR(right))


def _candidate_lines(source: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All distinct lines (key_a, key_b, seen) and those that may have a partner (and line, line_id)."""
    parts = [F.when(F.length("line") >= MIN_CHARS, key).alias(f"part_{i}") for i, key in enumerate(_part_keys(F.col("line")))]
    names = [f"part_{i}" for i in range(4)]
    distinct = stored(
        lines.select(*KEY, _place().alias("place"), *parts)
        .groupBy(*KEY)
        .agg(F.min("place").alias("seen"), *[F.min(name).alias(name) for name in names]),
        "distinct-lines",
    )
    each = F.explode(F.filter(F.array(*names), lambda part: part.isNotNull())).alias("part")
    shared = distinct.select(each).groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
    able = stored(distinct.select(*KEY, "seen", each).join(shared, "part", "left_semi").drop("part").distinct(), "able-lines")
    # The text of a line is read in the document that has it first.
    line_no = F.pmod("seen", F.lit(LINES).cast("decimal(11,0)")).cast("int")
    document = ((F.col("seen") - line_no) / F.lit(LINES).cast("decimal(11,0)")).cast("decimal(20,0)")
    wanted = able.select(F.when(document < F.lit(NO_DOCUMENT).cast("decimal(20,0)"), document).cast("bigint").alias("doc_id"), line_no.alias("line_no"))
    by_document = wanted.groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))
    # Joined in one way at all sizes, so that small tables tell what large ones take.
    found = source.alias("d").join(by_document.alias("w").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.doc_id", "d.text", "w.wanted")
    there = _lines(found, "wanted").filter(F.array_contains("wanted", F.col("line_no"))).drop("wanted")
    texts = there.withColumn("seen", _place()).join(able, [*KEY, "seen"], "left_semi").dropDuplicates(KEY)
    # Numbers of sorted rows are in the rows' order.
    texts = texts.select(*KEY, "seen", "line").orderBy("seen").withColumn("line_id", F.monotonically_increasing_id())
    return distinct, stored(texts, "candidate-lines")


def _meetings(lines: DataFrame) -> DataFrame:
    """Pairs of lines that may be within an edit: ``a`` and an earlier one, ``b``.

    Deletions at the same place are replaced characters, each meets the earliest of them. A
    whole line equals deletions of longer lines: they meet it, and it meets the earliest.
    Both are looked for in the gaps that several lines have the same around.
    """
    gaps = _gaps(lines)
    shared = gaps.groupBy("gap").agg(F.count("*").alias("n")).filter("n > 1").select("gap")
    gaps = stored(gaps.join(shared, "gap", "left_semi"), "shared-gaps")
    whole = _cut(gaps).select(
        "line_id",
        F.xxhash64("gap", F.length("line"), _xor(F.col("own"))).alias("variant"),
        F.lit(None).cast("int").alias("place"),
    )
    # One shuffle and one sort serve both windows.
    same = Window.partitionBy("variant").orderBy("place", "line_id")
    same = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = Window.partitionBy("variant", "place").orderBy("line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_whole = F.col("place").isNull()
    met = (
        _deletions(gaps)
        .unionByName(whole)
        .withColumns({"whole": F.max(F.when(is_whole, F.col("line_id"))).over(same), "earliest": F.min("line_id").over(same)})
        .withColumn("first", F.first("line_id").over(placed))
    )
    partners = F.when(is_whole, F.array("earliest")).otherwise(F.array("first", "whole"))
    return met.select(F.col("line_id").alias("a"), F.explode(partners).alias("b")).filter("b < a").distinct()


def _source(docs: DataFrame, doc_id: Column, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))


def near_duplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Lines that go: doc_id, line_no (from 0) and the document and line that they repeat."""
    return _gone(_source(docs, F.col(id_column).cast("bigint"), text_column)).drop("row")


def _gone(source: DataFrame) -> DataFrame:
    """Lines that go, with ``row``, which tells apart rows of one id that have other texts."""
    lines = _lines(source, "row")
    distinct, texts = _candidate_lines(source.drop("row"), lines)
    pairs = _meetings(texts)
    own = texts.select(F.col("line_id").alias("a"), F.col("line").alias("line_a"), *KEY)
    other = texts.select(F.col("line_id").alias("b"), F.col("line").alias("line_b"), F.col("seen").alias("seen_b"))
    close = (
        pairs.join(own, "a")
        .join(other, "b")
        .filter(F.levenshtein("line_a", "line_b", 1).between(0, 1))
        .groupBy(*KEY)
        .agg(F.min("seen_b").alias("near_seen"))
    )
    decided = distinct.select(*KEY, "seen").join(close, KEY, "left")
    decided = decided.select(*KEY, "seen", F.least("seen", F.coalesce("near_seen", "seen")).alias("kept"))
    # All rows of a line with an earlier partner go; of the others all but the first.
    every = lines.select("doc_id", "row", "line_no", *KEY)
    gone = every.join(decided, KEY).withColumn("here", _place()).filter("kept < seen or seen < here")
    kept_line = F.pmod("kept", F.lit(LINES).cast("decimal(11,0)")).cast("int")
    kept_document = ((F.col("kept") - kept_line) / F.lit(LINES).cast("decimal(11,0)")).cast("decimal(20,0)")
    return gone.select(
        "doc_id",
        "row",
        "line_no",
        F.when(kept_document < F.lit(NO_DOCUMENT).cast("decimal(20,0)"), kept_document).cast("bigint").alias("kept_doc_id"),
        kept_line.alias("kept_line_no"),
    )


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document with the lines that stay: doc_id, n_lines, n_dropped, text."""
    gone = (
        _gone(_source(docs, F.col(id_column).cast("bigint"), text_column))
        .groupBy("doc_id", "row")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    source = _source(docs, F.col(id_column), text_column)
    lines = F.split("text", "\n")
    none = F.array().cast("array<int>")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.row") == F.col("g.row"))
    joined = source.alias("d").join(gone.alias("g"), same, "left")
    marked = joined.select("d.doc_id", "d.text", F.coalesce("g.gone", none).alias("gone"))
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.col("gone"), i))
    return marked.select(
        "doc_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )
