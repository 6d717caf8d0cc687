"""Document fingerprints by SimHash, DataFrame functions only (operator 4, native).

Terms are the white-space separated words of the lowered text; a word votes on each of 64
bits (of its 64-bit hash) with weight min(length - 2, 7), at least 1, so that short words,
the function words of most languages, count little. Four bit counters share one long, so
the votes of a run of 4,096 words are sixteen sums over a code-generated aggregate; runs are
added up per document. No text is ever collected: fingerprints are partial sums.

Permuted block tables then count, for each fingerprint, the other documents whose
fingerprint lies within the Hamming radius (``near_counts``).

The next document in ascending doc_id is found inside ranges of doc_id dealt out by
quantiles; the first row of each range is also sent to the range before it, so one
shuffle of the text serves the whole table and no range depends on the others.

Cases: null text counts as empty (no votes: fingerprint of zeros); equal rows are computed once
and returned as often as they occur; rows sharing a doc_id are ordered by a text hash;
null ids come first; a single document is its own next; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, every_salt, hot_keys, materialize, salt_of

RUN_WORDS, TOP_WEIGHT = 4096, 7  # RUN_WORDS * TOP_WEIGHT < 2^15: a counter's field can't overflow
SPREAD, FIELDS = (1 | 1 << 15 | 1 << 30 | 1 << 45), (1 | 1 << 16 | 1 << 32 | 1 << 48)
WORDS = [f"s{k}" for k in range(16)]


#: Scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han): their letters are taken two by two.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17DF\u3041-\u309F\u30A1-\u30FA\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFD}]"
APART = r"[^\p{L}\p{M}\p{N}]+"


def terms(low: Column) -> Column:
    """Runs of letters and digits of a lower-case text (empty strings between them count nothing); in unspaced
    scripts each letter with the next; a text without any of these is one term."""
    paired = F.when(low.rlike(UNSPACED), F.regexp_replace(low, f"({UNSPACED})(?=({UNSPACED}))", "$1$2 ")).otherwise(low)
    return F.when(low.rlike(r"[\p{L}\p{M}\p{N}]"), F.split(paired, APART)).otherwise(F.array(low))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys + fingerprint (long) of each row; ``keys`` identify a row."""
    low = texts.select(*keys, F.lower(text).alias("__low"))
    words = low.select(*keys, F.posexplode_outer(terms(F.col("__low"))).alias("__pos", "__word"))
    words = words.select(
        *keys, F.floor(F.coalesce("__pos", F.lit(0)) / RUN_WORDS).cast("int").alias("__run"),
        F.when(F.coalesce("__word", F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(TOP_WEIGHT), F.char_length("__word") - 2))).cast("long").alias("__w"),
        F.xxhash64("__word").alias("__h"),
    )
    votes = [
        F.sum(((F.shiftright("__h", 4 * k).bitwiseAND(15) * F.lit(SPREAD)).bitwiseAND(F.lit(FIELDS))) * F.col("__w")).alias(WORDS[k])
        for k in range(16)
    ]
    runs = words.groupBy(*keys, "__run").agg(F.sum("__w").alias("__total"), *votes)
    counts = F.flatten(F.array(*[
        F.array(*[F.shiftrightunsigned(c, 16 * j).bitwiseAND(0xFFFF) for j in range(4)]) for c in WORDS
    ]))
    summed = runs.select(*keys, "__total", counts.alias("__counts")).groupBy(*keys).agg(
        F.sum("__total").alias("__total"), F.collect_list("__counts").alias("__runs")
    )
    ones = F.aggregate(
        "__runs", F.array_repeat(F.lit(0).cast("long"), 64), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)
    )
    bits = F.aggregate(
        F.transform(F.col("__ones"), lambda c, i: F.when(2 * c > F.col("__total"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x),
    )
    return summed.withColumn("__ones", ones).select(*keys, bits.alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def range_of(column: str, cuts: list[int]) -> Column:
    """Number of sorted cuts at or below the value, by two levels of about sqrt(len(cuts))."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not groups:
        return F.lit(0)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col(column)))

    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = below(longs([g[0] for g in groups]))
    inner = F.element_at(F.array(*[longs(g) for g in groups]), F.greatest(at, F.lit(1)))
    return F.when(F.col(column).isNull() | (at == 0), 0).otherwise((at - 1) * step + below(inner))


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Distinct rows (doc_id, h, text, next_id, next_h, next_text), and how often repeated ones occur."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    index = materialize(docs.groupBy("doc_id", "h").agg(F.count("*").alias("times")), "index")
    cuts = index.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"]
    where = range_of("doc_id", sorted(set(cuts or [])))
    # one row a range; the first row of a range also ends the range before it, that of all rows the last
    heads = index.groupBy(where.alias("range")).agg(F.min(F.struct("doc_id", "h")).alias("head"))
    ring = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(ring), F.max("range").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("head.doc_id").alias("hd"), F.col("head.h").alias("hh"), before.alias("before"))
    sent = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("h") == F.col("hh")), "left")
    home = F.struct(where.alias("range"), F.lit(0).alias("after"))
    halo = F.struct(F.col("before").alias("range"), F.lit(1).alias("after"))
    sent = sent.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(home)).otherwise(F.array(home, halo))))
    sent = sent.select("doc_id", "h", "text", "to.range", "to.after")
    w = Window.partitionBy("range").orderBy("after", F.col("doc_id").asc_nulls_first(), "h")
    same = [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("after", "doc_id", "h")]
    fresh = sent.withColumn("again", same[0] & same[1] & same[2]).filter("not again")  # equal rows lie side by side
    nxt = [F.lead(c).over(w).alias(f"next_{n}") for c, n in (("doc_id", "id"), ("h", "h"), ("text", "text"))]
    times = index.filter("times > 1").select(F.col("doc_id").alias("rd"), F.col("h").alias("rh"), "times")
    return fresh.select("doc_id", "h", "text", "after", *nxt).filter("after = 0"), times


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def fingerprint_documents(docs: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Fingerprints (16 hex digits) of each text and its edited text, their likeness, the likeness to
    the next document's, and n_near, the number of other rows whose fingerprint lies within ``radius`` bits."""
    spark = docs.sparkSession
    ranges = min(100_000, max(16, 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows, times = with_next(docs, ranges)
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", "h", "next_id", "next_h", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = rows.select(
        "doc_id", "h", "next_id", "next_h", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"),
    ).select("doc_id", "h", "next_id", "next_h", "n_chars", "sha", "v.kind", "v.text")
    keys = ["doc_id", "h", "next_id", "next_h", "n_chars", "sha"]
    got = fingerprints(both, [*keys, "kind"])
    got = got.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    got = materialize(got, "fingerprints")
    other = got.select(F.col("doc_id").alias("o_id"), F.col("h").alias("o_h"), F.col("fingerprint").alias("next_fingerprint"))
    got = got.join(other, F.col("next_id").eqNullSafe(F.col("o_id")) & (F.col("next_h") == F.col("o_h")))
    got = got.join(times, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("h") == F.col("rh")), "left")
    one = F.lit(1).cast("long")
    got = materialize(got.withColumn("times", F.coalesce("times", one)), "fingerprints")
    prints = got.groupBy("fingerprint").agg(F.sum("times").alias("times"))
    near = near_counts(prints, radius, blocks).withColumnRenamed("fingerprint", "print")
    got = got.join(near, F.col("fingerprint") == F.col("print"), "left")
    got = got.withColumn("again", F.explode(F.sequence(one, "times")))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0")).alias(c)
    return got.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), digits("fingerprint"), digits("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )


def block_tables(radius: int, blocks: int) -> list[tuple[int, list[int]]]:
    """(mask of the key's bits, masks that must differ) of each table.

    ``radius`` differing bits leave at least blocks - radius blocks untouched, so one table for
    each choice of that many blocks finds every pair. A pair counts in the table of its first
    untouched blocks alone: in any other, some block before the last chosen is untouched too.
    """
    size = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    bits = [((1 << size[i]) - 1) << sum(size[:i]) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        touched = [signed(bits[i]) for i in range(max(chosen)) if i not in chosen]
        out.append((signed(sum(bits[i] for i in chosen)), touched + [-1] * (radius - len(touched))))
    return out


def near_counts(prints: DataFrame, radius: int = 3, blocks: int = 6, every: int | None = None) -> DataFrame:
    """(fingerprint, n_near) of (fingerprint, times): rows with a fingerprint within ``radius``, itself not counted.

    Fingerprints that agree in a table's blocks share a bucket. Buckets are compared as arrays
    of about PART members: a bucket that holds many is dealt into several, each array is
    compared with each of its bucket, so rows grow with arrays, not with pairs.
    """
    prints = materialize(prints.filter("fingerprint is not null"), "prints")
    tables = block_tables(radius, blocks)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, (m, _) in enumerate(tables)])
    rows = prints.select("fingerprint", "times", F.explode(keys).alias("e")).select("e.t", "e.key", "fingerprint", "times")
    hot = hot_keys(rows, ["t", "key"], "fingerprint", every)
    dealt = rows.join(hot, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    member = F.struct("fingerprint", "times")
    groups = dealt.groupBy("t", "key", "parts", salt_of("fingerprint").alias("salt")).agg(F.collect_list(member).alias("held"))
    groups = materialize(groups.filter((F.size("held") > 1) | (F.col("parts") > 1)), "buckets")  # PART members or so in each
    sent = groups.select("t", "key", "salt", "parts", "held").withColumn("to", every_salt())
    other = groups.select(F.col("t").alias("ot"), F.col("key").alias("okey"), F.col("salt").alias("osalt"), F.col("held").alias("others"))
    met = sent.join(other, (F.col("t") == F.col("ot")) & (F.col("key") == F.col("okey")) & (F.col("to") == F.col("osalt")))
    apart = [F.element_at(F.array(*[F.lit(x[k]).cast("long") for _, x in tables]), F.col("t") + 1).alias(f"m{k}") for k in range(radius)]
    met = met.select("held", "others", *apart)

    def count(a):
        def near(b):
            x = a["fingerprint"].bitwiseXOR(b["fingerprint"])
            ok = (F.bit_count(x) <= radius) & (x != 0)
            for k in range(radius):
                ok = ok & (x.bitwiseAND(F.col(f"m{k}")) != 0)
            return F.when(ok, b["times"]).otherwise(F.lit(0).cast("long"))

        return F.struct(a["fingerprint"].alias("fingerprint"), F.aggregate("others", F.lit(0).cast("long"), lambda s, b: s + near(b)).alias("n"))

    found = met.select(F.explode(F.transform("held", count)).alias("e")).filter("e.n > 0").groupBy("e.fingerprint").agg(F.sum("e.n").alias("n"))
    out = prints.join(found, "fingerprint", "left").select("fingerprint", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_near"))
    out = materialize(out.filter("n_near > 0"), "near-counts")
    discard(prints, hot, groups)
    return out
