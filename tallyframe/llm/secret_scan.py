"""Secret scan in DataFrame functions only: rules plus character Markov models.

Rules find assignments, access keys and long hex strings.  Beyond them, every
long token is scored by two first-order character models, one of random
strings and one of ordinary identifiers, and kept where the log-likelihood
ratio says random.  Both models are trained from labelled samples: generated
random strings, and identifiers made of words of a bounded sample of texts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fixed rules: kind, first group, second group, shortest second group or match.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6)
ACCESS = (r"AKIA[A-Z0-9]+", 20)
HEX = (r"[0-9a-f]+", 24)
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the models look at.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: Characters of the models; every other one is class 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Texts whose words make the sample of identifiers, and strings generated.
SAMPLE_TEXTS, SAMPLE_STRINGS = 2000, 6000
#: A token is random when the ratio exceeds this for the token and for each character (natural logs).
MIN_RATIO, MIN_PER_CHAR = 16.0, 1.0
OPEN, CLOSE, INNER, OTHER = (chr(0xE000 + i) for i in range(4))


def pairs_of(x: Column) -> Column:
    """The model cells (SIZE * class of a character + class of the next) of a string, from its start."""
    classes = F.transform(F.split(x, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(classes, F.lit(1), F.size(classes) - 1)), classes, lambda a, b: a * SIZE + b)


def samples(docs: DataFrame, texts: int = SAMPLE_TEXTS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(label, s): labelled strings, 1 random and 0 ordinary; the texts of at most ``texts`` ids are used."""
    spark = docs.sparkSession
    seed = spark.range(strings).select(F.sha2(F.col("id").cast("string"), 512).alias("h"), (F.pmod(F.xxhash64("id"), F.lit(24)) + 16).cast("int").alias("n"))
    b64 = F.base64(F.unhex("h"))
    random = seed.select(F.lit(1).alias("label"), F.explode(F.array(F.substr(b64, F.lit(1), F.col("n")), F.translate(F.substr(b64, F.lit(41), F.col("n")), "+/", "-_"), F.upper(F.substr(F.regexp_replace(b64, "[+/=]", ""), F.lit(11), F.col("n"))), F.substr("h", F.lit(1), F.col("n")))).alias("s"))
    # Ids are chosen first, so that no task has to gather texts.
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id", F.lit(99)), "doc_id").limit(texts)
    some = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    word = some.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).select(F.regexp_replace("w", r"[^A-Za-z]+", "").alias("w")).filter("length(w) >= 3")
    low = F.lower("w")
    turn = F.pmod(F.xxhash64("w"), F.lit(997)).cast("int")
    ordinary = word.select(F.lit(0).alias("label"), F.explode(F.array(F.col("w"), F.concat(low, F.lit("_"), low), F.concat(low, F.lit("-"), turn.cast("string")), F.concat(low, F.initcap("w")), F.concat(F.lit("/"), low, F.lit("/"), low), F.upper("w"), F.concat(F.upper("w"), F.lit("_"), F.upper("w")), F.concat_ws("-", (turn + 1500).cast("string"), F.lpad((turn % 12 + 1).cast("string"), 2, "0"), F.lpad((turn % 28 + 1).cast("string"), 2, "0")))).alias("s"))
    return random.unionByName(ordinary)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of every cell (SIZE * SIZE, row-major) from (label, s) rows."""
    cells = labelled.filter("s is not null and s <> ''").select("label", F.explode(pairs_of(F.col("s"))).alias("cell")).groupBy("label", "cell").count()
    counts = {0: [0.5] * SIZE**2, 1: [0.5] * SIZE**2}
    for label, cell, n in cells.collect():  # at most 2 * SIZE**2 rows
        counts[label][cell] += n
    logs = {}
    for label, c in counts.items():
        logs[label] = [math.log(c[i] / sum(c[i - i % SIZE : i - i % SIZE + SIZE])) for i in range(SIZE**2)]
    return [round(a - b, 6) for a, b in zip(logs[1], logs[0])]


def ratio(x: Column, table: Column) -> Column:
    """The log-likelihood ratio of a string."""
    return F.aggregate(pairs_of(x), F.lit(0.0), lambda acc, cell: acc + F.get(table, cell))


def found(text: Column, pattern: str, order: int, good, marked: str = "$0") -> Column:
    """array<struct<start, kind, end>> of the matches of ``pattern`` that are ``good``."""
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}{marked}{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)

    def step(acc, x):
        n = F.length(F.translate(x, INNER, "")) if marked != "$0" else F.length(x)
        span = F.struct(acc["at"].alias("start"), F.lit(order).alias("kind"), (acc["at"] + n).alias("end"))
        spans = F.when(acc["inside"] & good(x), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + n).alias("at"), (~acc["inside"]).alias("inside"), spans.alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("spans")), step, lambda acc: acc["spans"])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row of (doc_id, text).

    Spans count code points, the end exclusive, and are ordered by start, then
    kind.  ``table`` is a trained ratio table (made from ``docs`` when None).
    Markov spans are tokens that overlap no rule's span.

    A null text counts as empty and has no spans; a null doc_id stays null;
    repeated rows stay repeated; other columns are ignored; an empty table
    gives an empty result.
    """
    ratios = F.from_json(F.lit(json.dumps(table if table is not None else train(samples(docs)))), "array<double>")
    # The marks are exchanged for another character that no rule mentions, one for one.
    text = F.translate(F.coalesce("text", F.lit("")), OPEN + CLOSE + INNER, OTHER * 3)
    longer = lambda n: lambda x: F.length(x) >= n
    rows = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        found(F.col("t"), ASSIGN[0], 0, lambda x: F.length(F.substring_index(x, INNER, -1)) >= ASSIGN[1], f"$1{INNER}$2").alias("assign"),
        found(F.col("t"), ACCESS[0], 1, longer(ACCESS[1])).alias("access"),
        # Runs of hex digits do not touch each other, so short ones can be left out of the search.
        found(F.col("t"), HEX[0].replace("+", f"{{{HEX[1]},}}"), 2, longer(HEX[1])).alias("hex"),
        found(F.col("t"), TOKEN, 3, lambda x: ratio(x, ratios) > F.greatest(F.lit(MIN_RATIO), MIN_PER_CHAR * F.length(x))).alias("tokens"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    rows = rows.withColumn("markov", F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "markov"))).alias("spans"), size("markov").alias("n_markov"),
    )
