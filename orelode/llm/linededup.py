"""Line dedup with DataFrame functions only: lines that many documents share leave every document.

Each text's lines are normalised and hashed (128 bits: two 64-bit hashes); a document's distinct
hashes are exploded, distinct documents are counted by hash (partial counts before the shuffle, so
that a line of a third of all documents is no hot task), and only the positions of lines to drop
travel back. Texts meet their positions in one join by document and are put together again in order.

Defined results: a null or empty text is one empty line, whose key is too short to count. Rows with
an equal id count as one document but are each kept, in their own text. A null id is a document of
its own (all rows with a null id count as one). Extra columns pass through, but those named n_lines or
n_dropped, which are replaced by the results; internal names begin with `_ld_`. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import Scratch, ascii_lower
from orelode.llm.components import components

#: Stripped at both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
_STRIP = " \t\n\x0b\x0c\r"
#: Of three least hashes each: at a similarity of 0.65 nine in ten pairs share a band.
BANDS = 8


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(1), F.col(id_col).isNull(), F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _shared_places(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, class_col: str | None) -> DataFrame:
    """_ld_row and the places of its lines that min_docs documents (or classes) have: _ld_gone."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    owner = F.coalesce(F.col(class_col).cast("string"), F.col(id_col).cast("string")) if class_col else F.col(id_col).cast("string")
    one = F.struct(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"))
    lines = (
        docs.select(row_key(docs, id_col, text_col).alias("_ld_row"), owner.alias("_ld_id"), F.split(ascii_lower(text), "\n", -1).alias("lines"))
        .select("_ld_row", "_ld_id", F.posexplode_outer("lines").alias("pos", "line"))
        .select("_ld_row", "_ld_id", "pos", F.btrim("line", F.lit(_STRIP)).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("_ld_row", "_ld_id", "pos", one.alias("h"))
        .select("_ld_row", "_ld_id", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    )
    # a line's documents: distinct (hash, id) first, then counts, both combined before they are dealt
    shared = lines.select("a", "b", F.coalesce("_ld_id", F.lit("")).alias("id"), F.col("_ld_id").isNull().alias("none")).distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("a", "b")
    # written, so that the join below deals both sides itself and can split a hot line
    shared = Scratch(docs.sparkSession, "lines").keep(shared, "shared")
    return lines.select("_ld_row", "pos", "a", "b").join(shared, ["a", "b"], "left_semi").groupBy("_ld_row").agg(F.collect_set("pos").alias("_ld_gone"))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines at the places that stay, in order (a hash set inside, so linear in the lines), joined."""
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")


def mostly_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, share: float = 0.3) -> DataFrame:
    """The rows of docs that would lose at least this share of their characters: boilerplate makes up much of them, or they are copies."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.withColumn("_ld_row", row_key(docs, id_col, text_col)).join(_shared_places(docs, id_col, text_col, min_docs, min_chars, None), "_ld_row")
    return whole.filter(F.length(_kept(F.split(text, "\n", -1), F.col("_ld_gone"))) <= F.length(text) * (1 - share)).select(*docs.columns)


def copy_classes(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 60, den: int = 100) -> DataFrame:
    """_ld_row and class of every row of docs: equal for texts linked by the similarity of their k-word shingles, with DataFrame functions only.

    Least hashes of the shingles under `3 * BANDS` seeds, three a band, give candidates, each with the least set of its band; the sets themselves decide.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    runs = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k))))
    rows = scratch.keep(docs.select(row_key(docs, id_col, text_col).alias("_ld_row"), F.array_sort(F.array_distinct(F.get(runs, F.lit(0)))).alias("set")).withColumn("h", F.xxhash64("set")), "shingles")
    sets = scratch.keep(rows.select("h", "set").dropDuplicates(["h"]), "sets")

    def least_hash(seed: int) -> Column:
        return F.array_min(F.transform("set", lambda x: F.xxhash64(x, F.lit(seed))))

    least = [least_hash(seed) for seed in range(3 * BANDS)]
    bands = scratch.keep(sets.select("h", F.explode(F.array(*(F.xxhash64(F.lit(b), *least[3 * b : 3 * b + 3]) for b in range(BANDS)))).alias("band")), "bands")
    heads = scratch.keep(bands.groupBy("band").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a < z").select("band", "a"), "heads")
    pairs = bands.join(heads, "band").filter("h <> a").select("a", F.col("h").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("set").alias("sb")), "b")
    met = F.size(F.array_intersect("sa", "sb"))
    links = scratch.keep(both.select("a", "b", met.alias("met"), (F.size("sa") + F.size("sb")).alias("n")).filter(den * F.col("met") >= num * (F.col("n") - F.col("met"))), "links")
    labels = components(links, scratch, "classes")
    named = rows.select("_ld_row", "h").join(labels.withColumnRenamed("node", "h"), "h", "left")
    return named.select("_ld_row", F.coalesce("label", "h").alias("class")).dropDuplicates(["_ld_row"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, most_share: float | None = None, class_col: str | None = None) -> DataFrame:
    """docs with text_col rebuilt from the lines that stay, and n_lines and n_dropped.

    With class_col, documents of one class (copies of each other) count as one; a null class is the document's own id.

    With most_share, a text that would lose more than this share of its characters is left as it is (n_dropped 0): shared
    lines that make up most of a text make it a copy, which is a near-duplicate stage's to settle, not boilerplate.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gone = _shared_places(docs, id_col, text_col, min_docs, min_chars, class_col)
    whole = docs.withColumn("_ld_row", row_key(docs, id_col, text_col)).join(gone, "_ld_row", "left").drop("_ld_row")
    cut = whole.withColumn("_ld_lines", F.split(text, "\n", -1)).withColumn("n_lines", F.size("_ld_lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long"))
    kept = _kept(F.col("_ld_lines"), F.col("_ld_gone"))
    if most_share is not None:
        cut = cut.withColumn("_ld_kept", F.when(F.col("n_dropped") > 0, kept))
        alone = F.length(text) - F.length("_ld_kept") > F.length(text) * most_share
        cut, kept = cut.withColumn("n_dropped", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_dropped"))), F.col("_ld_kept")
        return cut.withColumn(text_col, F.when(F.col("n_dropped") == 0, F.col(text_col).cast("string")).otherwise(kept)).drop("_ld_lines", "_ld_gone", "_ld_kept")
    return cut.withColumn(text_col, F.when(F.col("n_dropped") == 0, F.col(text_col).cast("string")).otherwise(kept)).drop("_ld_lines", "_ld_gone")
