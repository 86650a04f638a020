"""Mergeable state as order-independent aggregates: each merge is a grouped maximum or sum, so partial results combine
in any order and duplicates do not count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.sources.durable import stored


def winner(rev: str = "rev", value: str = "val", src: str = "src") -> Column:
    """The last-write-wins operation: greatest |rev|, then greatest value, then greatest source."""
    return F.max(F.struct(F.abs(rev).alias("a"), F.col(value).alias("val"), F.col(src).alias("src"), F.col(rev).alias("rev")))


def lww(ops: DataFrame, *keys: str) -> DataFrame:
    """Winning (rev, val, src) of each key."""
    return ops.groupBy(*keys).agg(winner().alias("w")).select(*keys, "w.rev", "w.val", "w.src")


def grow_counter(ops: DataFrame, *keys: str) -> DataFrame:
    """Increment-only counter: the greatest value that each source reported, summed."""
    return ops.groupBy(*keys, "src").agg(F.max("val").alias("v")).groupBy(*keys).agg(F.sum("v").alias("total"))


def counter(ops: DataFrame, *keys: str) -> DataFrame:
    """Two-way counter: each source's last-written value, summed."""
    return lww(ops, *keys, "src").groupBy(*keys).agg(F.sum("val").alias("total"))


def live_elements(ops: DataFrame, *keys: str) -> DataFrame:
    """Set: elements (keys, val) whose winning operation, by |rev| and then source, does not remove them."""
    w = F.max(F.struct(F.abs("rev").alias("a"), F.col("src").alias("src"), F.col("rev").alias("rev")))
    return ops.groupBy(*keys, "val").agg(w.alias("w")).where("w.rev > 0").select(*keys, "val")


def live_pairs(ops: DataFrame, obj: str, key: str) -> DataFrame:
    """Map: pairs whose key's winning operation does not remove it, with the winning value."""
    return lww(ops, obj, key).where("rev > 0").select(obj, key, "val")


def delta(state: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Operations that turn ``state`` into ``new``: the new value at the next revision, where it differs."""
    joined = new.select(*keys, F.col("val").alias("_new")).join(state, list(keys), "left")
    return joined.where("rev is null or not (_new <=> val)").select(*keys, (F.coalesce(F.abs("rev"), F.lit(0)) + 1).alias("rev"), F.col("_new").alias("val"))


def counter_delta(state: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Sources whose value in ``new`` is greater than in ``state``."""
    joined = new.join(state.select(*keys, F.col("val").alias("_old")), list(keys), "left")
    return joined.where("_old is null or val > _old").select(*keys, "val")


def of_sources(ops: DataFrame, vector: DataFrame) -> DataFrame:
    """Operations whose source is in a version vector."""
    return ops.join(vector.select("src"), "src", "left_semi")


def id64(src: Column, seq: Column, off: Column) -> Column:
    """Pack 20 bits of source, 32 of sequence and 12 of offset."""
    return F.shiftleft(src.cast("bigint"), 44).bitwiseOR(F.shiftleft(seq.cast("bigint"), 12)).bitwiseOR(off.cast("bigint"))


def id64_parts(packed: Column) -> tuple[Column, Column, Column]:
    return F.shiftrightunsigned(packed, 44), F.shiftrightunsigned(packed, 12).bitwiseAND(F.lit((1 << 32) - 1)), packed.bitwiseAND(F.lit((1 << 12) - 1))


def id64_text(packed: Column) -> Column:
    """Lower-case hex of the three parts, as src-seq-off."""
    return F.concat_ws("-", *[F.lower(F.hex(p)) for p in id64_parts(packed)])


def resource(ops: DataFrame, src: Column) -> DataFrame:
    """The same operations under another author."""
    return ops.withColumn("src", src)


# Fixed value: the order of the types, by letter.
TYPES = "FIRST"


def value_text(type_: Column, value: Column) -> Column:
    """Text form of a value by its type letter: F and I as numbers, R as an identifier, S quoted, T as it is."""
    quoted = F.to_json(F.struct(value.alias("v")))
    identifier = id64_text(F.when(type_ == "R", value.try_cast("bigint")))
    return F.when(type_ == "S", F.call_function("substring", quoted, F.lit(6), F.length(quoted) - 6)).when(type_ == "R", identifier).otherwise(value)


def parsed_value(type_: Column, text: Column) -> Column:
    """The value that value_text() wrote; null where the text is not one of its type."""
    hex_ = F.split(text, "-")
    number = lambda i: F.conv(F.get(hex_, F.lit(i)), 16, 10).try_cast("bigint")
    packed = F.when((F.size(hex_) == 3) & text.rlike("^[0-9a-f]+-[0-9a-f]+-[0-9a-f]+$"), id64(number(0), number(1), number(2)))
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    plain = F.when(type_ == "F", F.when(text.try_cast("double").isNotNull(), text)).when(type_ == "I", F.when(text.try_cast("bigint").isNotNull(), text))
    return plain.when(type_ == "R", packed.cast("string")).when(type_ == "S", F.when(text.rlike('(?s)^".*"$'), unquoted)).when(type_ == "T", text)


def value_order(type_: Column, value: Column) -> Column:
    """What values sort by: the letter of their type, then their bytes."""
    return F.struct(type_.alias("t"), F.encode(value, "UTF-8").alias("b"))


def map_pairs(ops: DataFrame, obj: str = "obj", key: str = "key") -> DataFrame:
    """Live pairs of mergeable maps. Rows: obj, key, krev (negative: removed), ksrc, vrev, val, vsrc.

    A pair's key and its value are won apart: the key by revision and author, the value by revision, value and author.
    """
    won = ops.groupBy(obj, key).agg(
        F.max(F.struct(F.abs("krev").alias("a"), F.col("ksrc").alias("src"), F.col("krev").alias("rev"))).alias("k"),
        F.max(F.struct(F.abs("vrev").alias("a"), F.col("val").alias("val"), F.col("vsrc").alias("src"), F.col("vrev").alias("rev"))).alias("v"),
    )
    return won.where("k.rev > 0").select(obj, key, F.when(F.col("v.rev") > 0, F.col("v.val")).alias("val"), F.col("k.a").alias("krev"), F.col("v.a").alias("vrev"))


def array_order(inserts: DataFrame, obj: str = "obj") -> DataFrame:
    """Replicated array: elements in weave order. Rows: obj, id, parent (null at the start), live.

    Children follow their parent, newer siblings first. The order is the path of ids from the root; paths double
    in length every round, so a chain of n insertions takes log2(n) joins.
    """
    step = F.lit(1 << 40) - F.col("id")
    paths = inserts.select(obj, "id", "live", F.col("parent").alias("up"), F.array(step).alias("path"))
    while True:
        above = paths.select(F.col(obj).alias("_o"), F.col("id").alias("_i"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        paths = paths.join(above, (F.col(obj) == F.col("_o")) & (F.col("up") == F.col("_i")), "left")
        paths = paths.select(obj, "id", "live", F.col("_up").alias("up"), F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path"))
        paths = stored(paths, "array_order")
        if paths.where("up is not null").isEmpty():
            return paths.drop("up")
