"""Exact deduplication by deterministic block naming, with DataFrame operations only.

Every text is cut into blocks of ``block`` bytes (UTF-8; a null or empty text is
one empty block). The distinct blocks are sorted (by a 128-bit hash, checked to be
one-to-one on all of them, else by content) and numbered by their place; then
adjacent pairs of numbers are sorted and numbered again, level after level, until
each text is down to one number. The numbers depend on the data alone. Two texts get the same (level, number) exactly if
they are byte for byte equal.

Scale: block contents are shuffled once, by a partial aggregate, which leaves a
block that is repeated in a task once. All later shuffles carry integers, half
as many on each level. Numbers go back to rows by a skew-safe lookup, so a block
or pair that a third of the rows have is no hot task. The lookup of the first
level goes by a 128-bit hash of the block that is checked to be one-to-one on
all blocks of the input; if it were not, blocks themselves are the key.

Defined results: null counts as empty; of equal texts the row with the largest
doc_id stays (null is smallest); rows repeated with the same doc_id and text are
copies of which one stays; an empty table gives an empty result; columns other than
id and text are not read; a text of any length is cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialise

BLOCK = 1024


def _cut(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """(rid, doc_id, sha, nb, pos, block): a row for every block of every text."""
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole.alias("bytes")).withColumn("rid", F.monotonically_increasing_id())
    nb = F.greatest(F.lit(1), F.ceil(F.length("bytes") / block)).cast("int")
    rows = lean.withColumn("nb", nb).select("rid", "doc_id", "nb", "bytes", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("pos"))
    piece = F.substring("bytes", F.col("pos") * block + 1, F.lit(block))
    sha = F.when(F.col("pos") == 0, F.unhex(F.sha2(F.col("bytes"), 256)))
    return rows.select("rid", "doc_id", sha.alias("sha"), "nb", "pos", piece.alias("block"))


def _named(keys: DataFrame, columns: list[str], count: Column | None = None) -> DataFrame:
    """Distinct values of ``columns``, their count n, and their place in sorted order as their name: the same however tasks are cut."""
    spark = keys.sparkSession
    counted = materialise(keys.groupBy(*columns).agg((F.count("*") if count is None else count).alias("n")), "counted")
    placed = counted.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, "names")
    discard(counted)
    part, before, rows = F.shiftright("at", 33).cast("int"), 0, []
    for name, size in placed.groupBy(part.alias("part")).agg(F.count("*")).orderBy("part").collect():  # a row per partition of the sort
        rows.append((name, before))
        before += size
    starts = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    name = F.col("at") - F.shiftleft(F.col("part").cast("long"), 33) + F.col("before")
    return placed.withColumn("part", part).join(starts, "part").select(*columns, "n", name.alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, by_content: bool = False) -> DataFrame:
    """(rid, doc_id, sha, level, name) per row; equal (level, name) means equal text. ``rid`` numbers the rows."""
    cut = _cut(docs, id_col, text_col, block)
    key = [F.col("block")] if by_content else [F.xxhash64("block").alias("h1"), F.xxhash64(F.lit(1), "block").alias("h2")]
    columns = ["block"] if by_content else ["h1", "h2"]
    distinct = materialise(cut.groupBy("block").agg(F.count("*").alias("n")).select(*key, "n"), "distinct")
    if not by_content and distinct.groupBy("h1", "h2").count().where("count > 1").limit(1).count():
        return identities(docs, id_col, text_col, block, by_content=True)
    names = _named(distinct, columns, F.first("n"))
    rows = materialise(cut.select("rid", "doc_id", "sha", "nb", "pos", *key), "blocks")
    total, longest = rows.agg(F.count("*"), F.max("nb")).first()
    now = materialise(lookup(rows.select("rid", "nb", "pos", *columns), names, columns, ["name"], "n", total), "named").select("rid", "nb", "pos", "name")
    done, level = [], 0
    while True:
        done.append(now.where("nb = 1").select("rid", F.lit(level).alias("level"), "name"))
        if (longest or 1) <= 1:
            break
        left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        half = lambda c: F.floor(c / 2).cast("int")
        pairs = now.where("nb > 1").groupBy("rid", half(F.col("nb") + 1).alias("nb"), half(F.col("pos")).alias("pos"))
        pairs = materialise(pairs.agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b")), "pairs")
        names = _named(pairs, ["a", "b"])
        now = materialise(lookup(pairs, names, ["a", "b"], ["name"], "n", max(1, pairs.count())).select("rid", "nb", "pos", "name"), "named")
        discard(pairs)
        longest, level = (longest + 1) // 2, level + 1
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    base = rows.where("pos = 0").select("rid", "doc_id", "sha")
    return materialise(base.join(found, "rid"), "identities")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, by_content: bool = False) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, sha (SHA-256 of the text), keep_id, group_size, kept."""
    ids = identities(docs, id_col, text_col, block, by_content)
    groups = ids.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size"))
    groups = groups.select("level", "name", F.col("top.doc_id").alias("keep_id"), F.col("top.rid").alias("keep_rid"), "group_size")
    out = lookup(ids, groups, ["level", "name"], ["keep_id", "keep_rid", "group_size"], "group_size", max(1, ids.count()))
    return out.select("rid", "doc_id", "sha", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))



