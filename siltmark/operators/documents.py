"""JSON-like documents as flat leaves (doc_id, path, type, value): flatten, rebuild, validate, compare; leaf records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import paths, ron64
from siltmark.operators.vectors import heights, reachable
from siltmark.sources.durable import stored


def _nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every value below the top of JSON texts: k, path, name (null in an array), kind, v (a variant).

    One explode for each level of nesting, until a level has nothing to explode; levels are stored, so each one is
    read from its parents alone. Text that is not JSON has none.
    """
    def kinds(df: DataFrame) -> DataFrame:
        return df.withColumn("kind", F.expr("regexp_extract(schema_of_variant(v), '^[A-Z]+', 0)"))

    level = kinds(docs.select(F.col(key).alias("k"), F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), F.expr(f"try_parse_json({text})").alias("v")).where("v is not null"))
    out = level = stored(level, "json_level")
    while not (deeper := level.where("kind in ('OBJECT', 'ARRAY')")).isEmpty():
        exploded = deeper.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("value").alias("_value")))
        step = F.coalesce("_key", ron64.encode(F.col("_pos")))
        path = F.when(F.col("path") == "", step).otherwise(F.concat_ws("/", "path", step))
        level = stored(kinds(exploded.select("k", path.alias("path"), F.col("_key").alias("name"), F.col("_value").alias("v"))), "json_level")
        out = out.unionByName(level)
    return out


def flatten_json(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Leaves of JSON objects, at any depth: key, path (keys joined by /, array places in base 64), type, value.

    Empty containers vanish; text that is not JSON has no leaves.
    """
    kind = F.col("kind")
    type_ = F.when(kind.isin("BIGINT", "DOUBLE", "DECIMAL"), "number").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("string")
    leaves = _nodes(docs, key, text).where("kind not in ('OBJECT', 'ARRAY')")
    return leaves.select(F.col("k").alias(key), "path", type_.alias("type"), F.expr("cast(v as string)").alias("value"))


def mixed_paths(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Whether a document nests containers and has keys that are paths themselves: key, mixed."""
    nodes = _nodes(docs, key, text)
    return nodes.groupBy(F.col("k").alias(key)).agg((F.bool_or(F.col("kind").isin("OBJECT", "ARRAY")) & F.bool_or(F.coalesce(F.contains("name", F.lit("/")), F.lit(False)))).alias("mixed"))


def is_array(names: Column) -> Column:
    """Whether child names are exactly the shortest base-64 numbers 0 to n - 1."""
    decoded = F.array_sort(F.transform(names, ron64.decode))
    return (decoded == F.sequence(F.lit(0).cast("bigint"), F.size(names).cast("bigint") - 1)) & F.forall(names, lambda n: n.rlike("^(0|[^0].*)$"))


def unflatten(leaves: DataFrame, key: str) -> DataFrame:
    """JSON text of each document from its leaves: objects with sorted keys, arrays where child names count from 0.

    Containers are closed from the deepest level up, one grouped pass each.
    """
    depth = leaves.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1

    def quoted(c: Column) -> Column:
        whole = F.to_json(F.struct(c.alias("v")))  # {"v":...}
        return F.call_function("substring", whole, F.lit(6), F.length(whole) - 6)

    text = F.when(F.col("type") == "string", quoted(F.col("value"))).when(F.col("type") == "null", "null").otherwise(F.col("value"))
    rows = leaves.select(key, "path", text.alias("text"), F.size(F.split("path", "/")).alias("d"))
    made = None
    for n in range(depth, 0, -1):
        here = rows.where((F.col("d") == n) & (F.col("path") != "")).select(key, "path", "text")
        here = here if made is None else here.unionByName(made)
        kids = here.groupBy(key, paths.parent(F.col("path")).alias("path")).agg(F.collect_list(F.struct(paths.basename(F.col("path")).alias("name"), "text")).alias("kids"))
        names = F.transform("kids", lambda x: x["name"])
        by_number = F.array_sort(F.transform("kids", lambda x: F.struct(ron64.decode(x["name"]).alias("i"), x["text"].alias("text"))))
        array = F.concat(F.lit("["), F.array_join(F.transform(by_number, lambda x: x["text"]), ","), F.lit("]"))
        obj = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort("kids"), lambda x: F.concat(quoted(x["name"]), F.lit(":"), x["text"])), ","), F.lit("}"))
        made = kids.select(key, "path", F.when(is_array(names), array).otherwise(obj).alias("text"))
    # a document that is one plain value has the empty path
    return made.unionByName(rows.where("path = ''").select(key, "path", "text")).select(key, F.col("text").alias("json"))


#: Checks of a record, by the bit of each.
SHORTEST, NUMBER, UTF8, BOOLEAN, MINIMAL, CANONICAL, MIXED = 0, 1, 2, 7, 8, 9, 10
#: Bytes of a key or value in a short record.
SHORT = 15


def failed(cond: Column, bit: int) -> Column:
    return F.when(cond, F.lit(1 << bit)).otherwise(F.lit(0))


def byte_violations(key: Column, value: Column) -> Column:
    """Bits of the checks on a leaf's bytes: short enough for the shortest form, and UTF-8."""
    long = (F.octet_length(key) > SHORT) | (F.octet_length(value) > SHORT)
    invalid = ~F.is_valid_utf8(key.cast("string")) | ~F.is_valid_utf8(value.cast("string"))
    return failed(long, SHORTEST).bitwiseOR(failed(invalid, UTF8))


def valid(found: Column, mask: int) -> Column:
    """Whether a record passes all checks of a mask, given the bits of those that it fails."""
    return found.bitwiseAND(F.lit(mask)) == 0


def violations(kind: Column, name: Column, path: Column, value: Column) -> Column:
    """Bits of the checks that a leaf fails: canonical number, canonical boolean, shortest base-64 name, canonical path."""
    fails = failed
    number = (kind == "number") & ~value.rlike(r"^(0|-?[1-9][0-9]*|-?(0|[1-9][0-9]*)\.[0-9]+)$")
    boolean = (kind == "boolean") & ~value.isin("true", "false", "")
    index = (kind == "index") & ~name.rlike("^(0|[^0].*)$")
    return fails(number, NUMBER).bitwiseOR(fails(boolean, BOOLEAN)).bitwiseOR(fails(index, MINIMAL)).bitwiseOR(fails(~paths.canonical(path), CANONICAL))


def order_violations(children: DataFrame, parent: str, place: str, name: str) -> DataFrame:
    """Per container: repeated keys, keys out of order, and whether names count from 0 without gaps."""
    before = F.lag(name).over(Window.partitionBy(parent).orderBy(place))
    rows = children.withColumn("_before", before)
    return rows.groupBy(parent).agg(
        (F.count("*") - F.count_distinct(name)).alias("repeated"),
        F.count_if(F.col("_before") >= F.col(name)).alias("unsorted"),
        ((F.min(ron64.decode(F.col(name))) == 0) & (F.max(ron64.decode(F.col(name))) == F.count("*") - 1) & (F.count_distinct(name) == F.count("*"))).alias("contiguous"),
    )


def permitted(encoder_mask: Column, decoder_mask: Column) -> Column:
    """Whether an encoder is at least as strict as a decoder asks."""
    return encoder_mask.bitwiseAND(decoder_mask) == decoder_mask


def _number_bytes(n: Column, count: int) -> Column:
    """Hex of a number's ``count`` lowest bytes, the lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * i).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0") for i in range(count)])


def encode_leaf(tag: Column, name: Column, value: Column) -> Column:
    """Record of a leaf: tag, lengths, key, value. A key of over 255 bytes has none.

    Short, with a lower-case tag and one byte for both lengths (4 bits each), where both are at most 15 bytes; else
    long, with an upper-case tag, four bytes for the value's length, the lowest first, and one for the key's.
    """
    n, m = F.octet_length(name), F.octet_length(value)
    short = (n <= SHORT) & (m <= SHORT)
    lengths = F.when(short, _number_bytes(n * 16 + m, 1)).otherwise(F.concat(_number_bytes(m, 4), _number_bytes(n, 1)))
    made = F.concat(F.encode(F.when(short, F.lower(tag)).otherwise(F.upper(tag)), "UTF-8"), F.unhex(lengths), F.encode(name, "UTF-8"), F.encode(value, "UTF-8"))
    return F.when(n <= 255, made)


def _record_at(data: Column, start: Column) -> Column:
    """Record that begins at a byte (from 0): struct of tag, key, value, end; end is null if it is not whole or not a record."""
    byte = lambda i: F.conv(F.hex(F.call_function("substring", data, start + 1 + i, F.lit(1))), 16, 10).cast("int")
    tag = F.decode(F.call_function("substring", data, start + 1, F.lit(1)), "UTF-8")
    short = tag.rlike("^[abnos]$")
    known = short | tag.rlike("^[ABNOS]$")
    n = F.when(short, F.floor(byte(1) / 16).cast("int")).otherwise(byte(5))
    m = F.when(short, byte(1) % 16).otherwise(byte(1).cast("bigint") + byte(2) * 256 + byte(3) * 65_536 + byte(4).cast("bigint") * 16_777_216)
    body = start + F.when(short, 2).otherwise(6)
    end = body + n + m
    part = lambda a, c: F.decode(F.call_function("substring", data, (a + 1).cast("int"), c.cast("int")), "UTF-8")
    return F.struct(tag.alias("tag"), part(body, n).alias("key"), part(body + n, m).alias("value"), F.when(known & (end <= F.octet_length(data)), end.cast("int")).alias("end"))


def decode_leaf(record: Column) -> tuple[Column, Column, Column]:
    """Tag, key and value of a record; null if it is cut short, of no known tag, or followed by more."""
    found = _record_at(record, F.lit(0))
    whole = found["end"] == F.octet_length(record)
    return tuple(F.when(whole, found[x]) for x in ("tag", "key", "value"))


def _records(stream: bytes | None) -> list[tuple[str, str, str]] | None:
    """Records of a stream, each read where the one before ends; none if the last is not whole."""
    if stream is None:
        return None
    at, out = 0, []
    while at < len(stream):
        tag = stream[at : at + 1]
        body = at + (2 if tag in b"abnos" else 6)
        if tag not in b"abnosABNOS" or body > len(stream):
            return None
        n, m = divmod(stream[at + 1], 16) if body == at + 2 else (stream[at + 5], int.from_bytes(stream[at + 1 : at + 5], "little"))
        if body + n + m > len(stream):
            return None
        out.append((tag.decode(), stream[body : body + n].decode(), stream[body + n : body + n + m].decode()))
        at = body + n + m
    return out


def decode_records(data: Column) -> Column:
    """Records that follow one another: array of (tag, key, value), in order; null if the last is not whole.

    Each record begins where the one before ends, so a stream is read once by a helper in the task that has it: its
    time grows with its bytes.
    """
    return F.udf(_records, "array<struct<tag:string,key:string,value:string>>", useArrow=True)(data)


def same(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two sets of leaves are equal, counting repeats."""
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg((F.count("*") == 0).alias("same"))


def patch(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Leaves that turn ``a`` into ``b``: new and changed values, and null for what goes."""
    both = a.select(*keys, F.col("value").alias("_a")).join(b.select(*keys, F.col("value").alias("_b")), list(keys), "full_outer")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, F.col("_b").alias("value"))


def apply_patch(a: DataFrame, change: DataFrame, *keys: str) -> DataFrame:
    rest = a.join(change.select(*keys), list(keys), "left_anti")
    return rest.select(*keys, "value").unionByName(change.where("value is not null").select(*keys, "value"))


def balances(transfers: DataFrame, key: str, order: str, amount: str) -> DataFrame:
    """Running balance of each account, and whether it ever went below zero."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return transfers.withColumn("balance", F.sum(amount).over(w)).groupBy(key).agg(F.max_by("balance", order).alias("balance"), (F.min("balance") >= 0).alias("valid"))


def merged(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Merge of two documents' leaves (keys, rev, value): of each path the greatest revision, of equals the greatest value.

    A null value is a removal: it wins by its revision, and the path is then absent. The order of the two, and doing it
    twice, make no difference.
    """
    won = a.select(*keys, "rev", "value").unionByName(b.select(*keys, "rev", "value")).groupBy(*keys).agg(F.max(F.struct("rev", "value")).alias("w"))
    return won.where("w.value is not null").select(*keys, "w.rev", "w.value")


def longest_branch(blocks: DataFrame) -> DataFrame:
    """The blocks (child, parent) of the longest chain: version, height. Of equally long ones that with the greatest tip."""
    tall = stored(heights(blocks), "blocks")
    tip = tall.agg(F.max(F.struct("height", "version")).alias("t")).select("t.version")
    chain = reachable(blocks.where("parent is not null"), tip.select(F.col("version").alias("tip"), "version"))
    return tall.join(chain.select("version"), "version", "left_semi")
