"""Line deduplication by content-defined chunks, in DataFrame functions only.

A text is a sequence of lines.  A chunk ends after a line if a hash rolled over this line and the
one before it falls into a quarter of its range, so that borders depend on nearby content alone
and an inserted line moves no border further on.  A line of ``LONG_LINE`` words or more is a chunk
of its own, and the whole document counts as one more chunk.  Chunks of two lines or more (and of
``LEAST_WORDS`` words), long lines and whole documents are looked up over the corpus by digest;
each that occurs earlier, by doc_id and reading order, is removed after its bytes are compared
with those of the first occurrence.  All other text stays as it is.

Only digests are grouped over the corpus.  Texts are joined once with the narrow list of repeats;
of the documents with repeats, the repeated chunks alone meet their first occurrences.

Edge cases: a null text stays null, an empty one empty; a null doc_id sorts last; repeated rows
are copies, of which the first read stays; a text that loses all its chunks becomes empty; lines
end at line feeds only and other characters are not touched; an empty table gives no rows; extra
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm import common
from corpuslens.llm.quality_rules import let

LONG_LINE = 50
LEAST_WORDS = 10
#: A rolled digest that starts with one of these hexadecimal digits ends a chunk: one in four.
ENDS = "[0-3]"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def chunks_of(text: Column) -> Column:
    """Array of (first, n_lines, digest): the chunks worth looking up, lines counted from 0."""
    def cut(lines: Column) -> Column:
        long = lambda i: F.coalesce(_blanks(F.get(lines, i)) >= LONG_LINE - 1, F.lit(False))
        rolled = lambda i: F.md5(F.concat_ws("\n", F.get(lines, i - 1), F.get(lines, i)).cast("binary"))
        last = F.size(lines) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | long(i) | long(i + 1) | rolled(i).rlike("^" + ENDS))
        return let(ends, lambda e: pieces(lines, e))

    def pieces(lines: Column, ends: Column) -> Column:
        spans = F.transform(ends, lambda e, k: let(
            F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1), lambda first: described(lines, first, e - first + 1)))
        whole = F.array(described(lines, F.lit(0), F.size(lines)))
        return F.when(F.size(ends) > 1, F.concat(spans, whole)).otherwise(whole)

    def described(lines: Column, first: Column, n: Column) -> Column:
        return let(F.array_join(F.slice(lines, first + 1, n), "\n"), lambda t: F.struct(
            first.cast("int").alias("first"), n.cast("int").alias("n_lines"),
            F.md5(t.cast("binary")).alias("digest"), _blanks(t).alias("blanks"),
            t.rlike("[^\\x20\\x09-\\x0D]").alias("said"), (n == F.size(lines)).alias("whole")))

    worth = lambda c: c["said"] & F.when(c["whole"], True).when(
        c["n_lines"] > 1, c["blanks"] + c["n_lines"] >= LEAST_WORDS).otherwise(c["blanks"] >= LONG_LINE - 1)
    return F.filter(let(F.split(text, "\n"), cut), worth)


def repeats(docs: DataFrame) -> DataFrame:
    """Rows with chunks that also occur elsewhere: row key and array of (first, n_lines, digest, earliest)."""
    keyed = docs.select("doc_id", *common.ROW_KEY, F.explode(chunks_of(common.whole_text())).alias("c"))
    chunks = common.written(keyed.select("doc_id", *common.ROW_KEY, "c.first", "c.n_lines", "c.digest"), "chunks")
    often = chunks.groupBy("digest").count().where(F.col("count") > 1).select("digest")
    found = chunks.join(often, "digest", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *common.ROW_KEY, "first", "n_lines")
    earliest = found.groupBy("digest").agg(F.min(place).alias("earliest"))
    marked = found.join(earliest, "digest").withColumn("is_first", place.eqNullSafe(F.col("earliest")))
    return marked.groupBy(*common.ROW_KEY).agg(
        F.collect_list(F.struct("first", "n_lines", "digest", "is_first")).alias("__cl_repeats"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with repeated chunks removed, and ``__cl_removed``: (first, n_lines) of the removed chunks."""
    keyed = common.with_row_key(docs)
    flagged = common.written(keyed.join(repeats(keyed), common.ROW_KEY, "left"), "flagged", texts=True)
    none = F.array().cast("array<struct<first:int,n_lines:int>>")
    alone = flagged.where("__cl_repeats is null").drop("__cl_repeats").withColumn("__cl_removed", none)
    some = flagged.where("__cl_repeats is not null")
    lines = F.split(common.whole_text(), "\n")
    said = some.select(*common.ROW_KEY, lines.alias("lines"), F.explode("__cl_repeats").alias("r")).select(
        *common.ROW_KEY, "r.first", "r.n_lines", "r.digest", "r.is_first",
        F.array_join(F.slice("lines", F.col("r.first") + 1, F.col("r.n_lines")), "\n").alias("bytes"))
    firsts = said.where("is_first").select("digest", F.col("bytes").alias("first_bytes"))
    confirmed = said.where("not is_first").join(firsts, "digest").where(F.col("bytes") == F.col("first_bytes")).groupBy(
        *common.ROW_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "n_lines"))).alias("__cl_removed"))
    joined = some.drop("__cl_repeats").join(confirmed, common.ROW_KEY, "left").withColumn(
        "__cl_removed", F.coalesce("__cl_removed", none))
    gone = lambda i: F.exists("__cl_removed", lambda r: (i >= r["first"]) & (i < r["first"] + r["n_lines"]))
    kept = F.array_join(F.filter(lines, lambda x, i: ~gone(i)), "\n")
    cleaned = joined.withColumn("text", F.when(F.size("__cl_removed") > 0, kept).otherwise(F.col("text")))
    return alone.select(*docs.columns, "__cl_removed").unionByName(cleaned.select(*docs.columns, "__cl_removed"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents without repeated chunks; those that lost all their words are left out, and ``n_chars`` follows the text."""
    out = deduplicate(docs)
    empty = (F.size("__cl_removed") > 0) & ~common.whole_text().rlike("[^\\x20\\x09-\\x0D]")
    out = out.where(~empty)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size("__cl_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
