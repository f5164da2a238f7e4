"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A stretch is the shortest run of lines, from some line forwards or from some
line backwards, that has at least ``min_words`` words.  Every run of that many
words is covered by the forward stretches that begin in it and the backward
ones that end in it.  Winnowing selects in each stretch the line with the
smallest hash; equal stretches select equal lines, so only stretches whose
selected line occurs at more than one position can repeat.  Those are joined
with the first position of the same stretch; the forward and backward
stretches extend a match over the whole repeated run, and the later run is
deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free, spare_name

MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, words): the lines with words, once for each text of a doc_id."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.length(F.regexp_replace(F.regexp_replace("line", r"[^\x20\x09-\x0D]+", "w"), SPACE, ""))
    return lines.select("doc_id", "th", "pos", F.xxhash64("line", F.lit(17)).alias("h"), words.cast("int").alias("words")).filter("words > 0")


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, a, e, pick, at, key): stretches from line ``a`` to ``e``.

    pick: hash of the winnowed line; at: a hash of that line's position; key:
    hash of the whole stretch.
    """
    doc = Window.partitionBy("doc_id", "th").orderBy("pos")
    rows = lines.withColumn("end", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("words"))
    ahead = Window.partitionBy("doc_id", "th").orderBy("begin").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("doc_id", "th").orderBy("end").rangeBetween(1 - min_words, 0)
    line = F.struct("h", "pos")
    rows = rows.select("doc_id", "th", F.array(*(F.struct(F.collect_list(line).over(w).alias("ls"), F.sum("words").over(w).alias("w")) for w in (ahead, back))).alias("both"))
    one = rows.select("doc_id", "th", F.explode("both").alias("s")).filter(F.col("s.w") >= min_words).select("doc_id", "th", F.col("s.ls").alias("ls"))
    one = one.withColumn("low", F.array_min("ls"))
    return one.select("doc_id", "th", F.col("ls")[0]["pos"].alias("a"), F.element_at("ls", -1)["pos"].alias("e"), F.col("low.h").alias("pick"), F.xxhash64("doc_id", "th", "low.pos").alias("at"), F.xxhash64("ls.h").alias("key"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, a, e), cut: the runs of lines ``a`` to ``e`` that are later repeats; those of a text do not touch."""
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = line_rows(rows).repartition(n, "doc_id", "th").dropDuplicates(["doc_id", "th", "pos"])
    found = stretches(lines, min_words)
    # Aggregates are written before they are joined, so that both sides of each join are plain
    # exchanges and Spark splits the partition of a line or passage that very many texts hold.
    picks = cut(found.groupBy("pick").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo <> hi").select("pick"), "picks")
    some = cut(found.drop("at").join(picks, "pick", "left_semi"), "stretches")
    first = cut(some.groupBy("pick", "key").agg(F.min(F.struct("doc_id", "th", "a", "e")).alias("f"), F.count("*").alias("times")).filter("times > 1").drop("times"), "firsts")
    free(picks)
    elsewhere = (F.col("doc_id") != F.col("f.doc_id")) | (F.col("th") != F.col("f.th"))
    later = some.join(first, ["pick", "key"]).filter(elsewhere | (F.col("a") > F.col("f.e"))).select("doc_id", "th", "a", "e")
    # Overlapping and adjoining stretches of a text become one run.
    doc = Window.partitionBy("doc_id", "th").orderBy("a", "e")
    fresh = F.col("a") > F.coalesce(F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    runs = later.distinct().withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = cut(runs.groupBy("doc_id", "th", "run").agg(F.min("a").alias("a"), F.max("e").alias("e")).drop("run"), "runs")
    free(some, first)
    return out


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, count: str = "n_removed") -> DataFrame:
    """``docs`` (all its columns) with ``text`` less its repeated runs, and the number of removed lines as ``count``.

    Lines end at "\\n"; words are runs without ASCII white space; lines without
    words are never compared, and go when they lie inside a deleted run.  A
    line is deleted when it lies in a run of at least ``min_words`` words that
    is equal, line by line, to an earlier one (by doc_id, then hash of the
    text, then line) which it doesn't overlap.  The first occurrence stays.

    Null and empty texts stay as they are; rows with a null doc_id stay as
    they are and nothing is compared with them.  Identical rows are one text:
    each keeps or loses the same lines.  Other columns pass through; where one
    is called as ``count``, the count gets underscores after its name.  An
    empty table gives an empty result.
    """
    key, hashed, gone = (spare_name(docs, c) for c in ("gone_id", "gone_th", "gone"))
    runs = repeated_runs(docs, min_words).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "e"))).alias(gone))
    runs = runs.withColumnsRenamed({"doc_id": key, "th": hashed})
    # Always a merge join: the repeats grow with the texts, so no size would be safe to broadcast.
    rows = docs.join(runs.hint("merge"), (F.col(key) == docs["doc_id"]) & (F.col(hashed) == F.xxhash64(docs["text"])), "left")
    lines, n = F.split(docs["text"], "\n", -1), F.size(gone)

    def kept(i):
        """The lines between run i - 1 and run i."""
        start = F.when(i > 0, F.get(F.col(gone), i - 1)["e"] + 1).otherwise(0)
        return F.slice(lines, start + 1, F.coalesce(F.get(F.col(gone), i)["a"], F.size(lines)) - start)

    text = F.when(F.col(gone).isNull(), docs["text"]).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), kept)), "\n"))
    others = [docs[c] if c != "text" else text.alias("text") for c in docs.columns]
    removed = F.aggregate(gone, F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["a"] + 1)
    return rows.select(*others, F.coalesce(removed, F.lit(0).cast("long")).alias(spare_name(docs, count)))
