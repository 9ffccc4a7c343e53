"""Document fingerprints by consistent weighted sampling.

A text is a bag of words; a word's weight w is how often it occurs. For each of ``SAMPLES``
draws and each word, r and c are Gamma(2, 1) and b is uniform, all made from a hash of word
and draw, so every document that has the word sees the same values. With

    t = floor(ln w / r + b),   a = c exp(-r (t - b + 1)),

the word with the least a, with its t, is the sample. Two texts agree in a sample with
the probability of their generalised Jaccard similarity, sum of minima over sum of maxima
of the weights.

The draws are made of independent exponentials, which has just these laws: c = V + W,
r = E1 + E2 with E2 = ln(c / V), b = E1 / r. For a word that occurs once t is 0 and a is V,
so with V = -ln(1 - U) the order of a is that of the uniform U: its sample is the hash
itself, without a logarithm. Other words take the full formula and are ordered by
1 - exp(-a) among them.

That value (47 bits) and the sample (16 bits) are one number, so a sample is a plain
minimum of longs in a hash aggregate. Documents are dealt by id once, with their texts;
counting the words of a document and taking its minima need no shuffle after that. No
Python runs on this path.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, whole

SAMPLES = 64
AT_ONCE = 8
#: Bits of a sample, and of the value that decides it.
SAMPLE_BITS, VALUE_BITS = 16, 47
_WORD, _NOT_WORD = r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}]+"


def terms(text: Column, part: Column | None = None) -> Column:
    """The words of a text, or of a part of it, in lower case; a text without words is one term, a blank one has none (an empty string)."""
    return F.when(F.rlike(text, F.lit(_WORD)), F.split(F.lower(text if part is None else part), _NOT_WORD)).otherwise(F.array(F.regexp_replace(text, r"^\s+|\s+$", "")))


def counted(texts: DataFrame, keys: list[str], parts: list[tuple[Column, list[str]]], weights: list[str]) -> DataFrame:
    """(keys, term, weights): a row for each term (its hash) of each row of ``texts``, with its
    count for each of ``weights``; ``parts`` names the weights that each array of words counts for.
    A row without terms has one of a null term. No shuffle if the texts are dealt by some of the keys."""
    rows = texts.select(*keys, F.explode(F.array(*(F.struct(*(F.lit(w in to).alias(w) for w in weights), words.alias("terms")) for words, to in parts))).alias("p"))
    rows = rows.select(*keys, *(F.col(f"p.{w}").alias(w) for w in weights), F.explode("p.terms").alias("term"))
    return rows.select(*keys, *weights, F.when(F.col("term") != "", F.xxhash64("term")).alias("term")).groupBy(*keys, "term").agg(*(F.sum(F.col(w).cast("long")).alias(w) for w in weights))


def _uniform(hashed: Column, bits: int) -> Column:
    """The top bits of a hash as a number between 0 and 1."""
    return (F.shiftrightunsigned(hashed, 64 - bits) + F.lit(0.5)) * F.lit(2.0**-bits)


def weighted_samples(rows: DataFrame, base: str, draw: Column, weights: list[str], where: Column) -> DataFrame:
    """``rows`` with ``sampled_0``, ``sampled_1``, ...: value and sample, as one long, of the draw for a word of
    the hash ``base`` with each of the weights (their logarithms in ``log_...``) by the full formula, in the rows that ``where`` holds for; null for the weight 0.
    Each step is a projection of its own, so nothing is computed twice."""
    on = lambda c: F.when(where, c)
    rows = rows.withColumn("h", on(F.xxhash64(base, draw)))
    rows = rows.withColumn("v", on(-F.ln(F.lit(1.0) - _uniform(F.col("h"), VALUE_BITS)))).withColumn("e1", on(-F.ln(_uniform(F.xxhash64("h", F.lit(1)), 44))))
    rows = rows.withColumn("c", F.col("v") + on(-F.ln(_uniform(F.xxhash64("h", F.lit(2)), 44))))
    rows = rows.withColumn("r", F.col("e1") + on(F.ln(F.col("c") / F.col("v"))))
    for k, weight in enumerate(weights):
        fresh = where & (F.col(weight) > 0) & (F.lit(k == 0) | (F.col(weight) != F.col(weights[0])))
        rows = rows.withColumn("t", F.when(fresh, F.floor((F.col(f"log_{weight}") + F.col("e1")) / F.col("r"))))
        a = F.col("c") * F.exp(F.col("e1") - F.col("r") * (F.col("t") + 1))
        value = F.when(fresh, (-F.expm1(-a) * F.lit(2.0**VALUE_BITS - 1)).cast("long"))
        mark = F.when(F.col("t") == 0, F.shiftrightunsigned("h", 1)).otherwise(F.xxhash64("h", "t")).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1))
        made = F.shiftleft(value, SAMPLE_BITS).bitwiseOR(mark)
        rows = rows.withColumn(f"sampled_{k}", F.when(fresh, made).otherwise(F.col("sampled_0")) if k else F.when(fresh, made))
        if k:
            rows = rows.withColumn(f"sampled_{k}", F.when(F.col(weight) > 0, F.col(f"sampled_{k}")))
    return rows.drop("h", "v", "e1", "c", "r", "t")


def signatures(words: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, a signature for each of the weights): the samples of each text as an array of small ints, empty for a
    text without terms. ``words`` is what ``counted`` gives; no shuffle if it is dealt by some of the keys.

    A word that occurs once at most meets its draws ``AT_ONCE`` in a row, any other one draw a
    row; that keeps the generated method small enough for the JVM to compile. ``samples`` is
    a multiple of AT_ONCE.
    """
    ints = lambda values: F.array(*(F.lit(x) for x in values))
    once = F.greatest(*weights, F.lit(1)) == 1
    # -1 - round for a row of AT_ONCE draws, else the draw
    draws = F.when(F.col("term").isNull(), ints([-1])).when(once, ints(-1 - g for g in range(samples // AT_ONCE))).otherwise(ints(range(samples)))
    rows = words.select("*", *(F.ln(F.col(w).cast("double")).alias(f"log_{w}") for w in weights)).withColumn("draw", F.explode(draws))
    rows = rows.withColumn("round", F.when(F.col("draw") < 0, -1 - F.col("draw")).otherwise(F.shiftright("draw", AT_ONCE.bit_length() - 1)))
    rows = rows.withColumn("base", F.when(F.col("term").isNotNull(), F.xxhash64("term", "round"))).withColumn("at", F.when(F.col("draw") >= 0, F.col("draw").bitwiseAND(F.lit(AT_ONCE - 1))))
    rows = weighted_samples(rows, "base", F.col("at"), weights, F.col("draw") >= 0)
    least = [F.min(F.when(F.col("draw") >= 0, F.when(F.col("at") == k, F.col(f"sampled_{i}"))).when(F.col("base").isNotNull() & (F.col(w) == 1), F.shiftrightunsigned(F.xxhash64("base", F.lit(k)), 1))).alias(f"s{i}_{k}")
             for i, w in enumerate(weights) for k in range(AT_ONCE)]
    marks = lambda i: F.array(*((F.col(f"s{i}_{k}").bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1)) - (1 << SAMPLE_BITS - 1)).cast("smallint") for k in range(AT_ONCE)))
    parts = rows.groupBy(*keys, "round").agg(*least).select(*keys, "round", *(F.when(F.col(f"s{i}_0").isNotNull(), marks(i)).otherwise(F.array().cast("array<smallint>")).alias(w) for i, w in enumerate(weights)))
    joined = F.array_sort(F.collect_list(F.struct("round", *weights)))
    return parts.groupBy(*keys).agg(joined.alias("parts")).select(*keys, *(F.flatten(F.col(f"parts.{w}")).alias(w) for w in weights))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree; two empty ones are alike, an empty one
    is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.size(a))


def written(signature: Column, samples: int = SAMPLES) -> Column:
    """A signature as a string of four hexadecimal digits a sample."""
    return F.when(F.size(signature) > 0, F.lower(F.concat(*(F.lpad(F.hex(signature[k].cast("int") + (1 << SAMPLE_BITS - 1)), SAMPLE_BITS // 4, "0") for k in range(samples))))).otherwise("")


def following(docs: DataFrame, stage: Stage, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, half, next, next_key) for each distinct id, in ascending order, the first after the
    last: half the code points of its longest text, and the next id with the text (by hash)
    that stands for it. Ids are dealt by range, so no task sees them all; one row a range
    carries the order over the ranges' borders."""
    ids = (docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.length(text_col).alias("n"), F.xxhash64(text_col).alias("key"))
           .groupBy("id").agg(F.floor(F.max("n") / 2).cast("int").alias("half"), F.min("key").alias("key")))
    ids = stage.write(ids, "ids")
    ranged = stage.write(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ranged")
    within, over = Window.partitionBy("part").orderBy("id"), Window.orderBy("part")
    border = ranged.groupBy("part").agg(F.min(F.struct("id", "key")).alias("first"))
    border = border.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(over)).alias("after"))
    own = F.lead(F.struct("id", "key")).over(within)
    return (ranged.withColumn("own", own).join(F.broadcast(border), "part")
            .select("id", "half", F.coalesce("own", "after").alias("to")).select("id", "half", F.col("to.id").alias("next"), F.col("to.key").alias("next_key")))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one
    row per row of ``docs``.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as
    many of the next document's first (or all it has), by ascending id, the first after the
    last. A null text counts as empty. Rows that share an id with other texts have one next
    document; where the next id has several texts, that with the least hash stands for
    it. A row without an id has no next document: its edited text is cut short and near_next
    is 0. Rows that repeat id and text give equal rows. Other columns are not read.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "fingerprints")
    docs = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    order = stage.write(following(docs, stage), "order")
    # Dealt by (the hash of) the id once; what follows is grouped and joined by it.
    slot = lambda c: F.xxhash64(c)
    dealt = docs.withColumn("slot", slot("id")).repartition("slot").groupBy("slot", "id", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", F.xxhash64("text"))
    ordered = order.withColumn("slot", slot("next")).select("slot", "next_key", F.col("id").alias("to"), "half")
    # (written so that it is no second join key, for which the texts would be dealt again)
    heads = (dealt.join(ordered, "slot").where(F.col("key").bitwiseXOR(F.col("next_key")) == 0)
             .select(slot("to").alias("slot"), "to", F.expr("substring(text, 1, half)").alias("head")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = dealt.join(heads, "slot", "left").where("to is null or id <=> to").select(
        "slot", "id", "key", "copies", "text", F.substring(F.col("text"), F.lit(1), n - half).alias("stem"), F.coalesce(F.substring(F.col("head"), F.lit(1), half), F.lit("")).alias("head"))
    edited = edited.withColumn("edited", F.concat("stem", "head"))
    # both texts begin alike; the words up to the last gap of that beginning are counted once, for both
    shared = edited.withColumn("same", F.regexp_extract("stem", f"(?s)^.*{_NOT_WORD[:-1]}", 0))
    rest = lambda c: F.substring(F.col(c), F.length("same") + 1, F.lit(2**31 - 1))
    words = counted(shared, ["slot", "key"], [(F.split(F.lower("same"), _NOT_WORD), ["own", "other"]), (terms(F.col("text"), rest("text")), ["own"]), (terms(F.col("edited"), rest("edited")), ["other"])], ["own", "other"])
    marks = signatures(words, ["slot", "key"], ["own", "other"], samples)
    told = edited.select("slot", "key", "id", "copies", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    made = stage.write(marks.join(told, ["slot", "key"]), "made")
    after = made.select(F.col("id").alias("next"), F.col("key").alias("next_key"), F.col("own").alias("after"))
    found = made.drop("slot", "key").join(order.drop("half"), "id", "left").join(after, ["next", "next_key"], "left")
    out = found.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("own"), samples).alias("fingerprint"), written(F.col("other"), samples).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("other")).alias("near_edited"), F.coalesce(likeness(F.col("own"), F.col("after")), F.lit(0.0)).alias("near_next"), "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
