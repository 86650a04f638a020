"""Record formats: fixed binary records, one-line-per-leaf text, JSON, XML; validation with rejects; packed addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 128-byte little-endian record, as (field, first byte, bytes).
RECORD = 128
LAYOUT = (("name", 1, 32), ("login", 33, 16), ("grp", 49, 8), ("practice", 57, 8), ("repo", 65, 59), ("project_mark", 124, 1), ("mark", 125, 4))
PRACTICES = 8
#: Lines that a part has, about, when they are put together again.
PART_LINES = 500_000

ROW = "name string, login string, grp string, practice array<int>, project struct<repo:string,mark:int>, mark float"


def _part(raw: Column, first: Column | int, count: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.call_function("substring", raw, lit(first), lit(count))


def _text(raw: Column) -> Column:
    """Text up to the zero padding."""
    return F.regexp_replace(F.decode(raw, "UTF-8"), "\x00+$", "")


def _unsigned(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("int")


def _float32(raw: Column) -> Column:
    """Value of four little-endian bytes; NaN for all-ones exponents."""
    h = F.hex(raw)
    bits = F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255)).cast("int")
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    normal = (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127)
    tiny = fraction * F.lit(2.0**-149)
    return (sign * F.when(exponent == 255, F.lit(float("nan"))).when(exponent == 0, tiny).otherwise(normal)).cast("float")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of binary files: rows (ROW plus file, place, raw), and rejects (file, length) of files with a partial record.

    Only built-in functions; every file is one row of the scan, and its records are cut from it in the JVM.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length", "content")
    rejects = files.where(F.col("length") % RECORD != 0).select("file", "length")
    whole = files.where((F.col("length") % RECORD == 0) & (F.col("length") > 0))
    places = whole.select("file", "content", F.explode(F.sequence(F.lit(0), (F.col("length") / RECORD).cast("int") - 1)).alias("place"))
    return parse_records(places.select("file", "place", _part(F.col("content"), F.col("place") * RECORD + 1, RECORD).alias("raw"))), rejects


def parse_records(rows: DataFrame) -> DataFrame:
    """Fields of 128-byte records in column raw, beside the other columns."""
    cut = {n: _part(F.col("raw"), a, c) for n, a, c in LAYOUT}
    practice = F.array(*[_unsigned(_part(F.col("raw"), 57 + i, 1)) for i in range(PRACTICES)])
    project = F.struct(_text(cut["repo"]).alias("repo"), _unsigned(cut["project_mark"]).alias("mark"))
    fields = [_text(cut[n]).alias(n) for n in ("name", "login", "grp")]
    return rows.select("*", *fields, practice.alias("practice"), project.alias("project"), _float32(cut["mark"]).alias("mark"))


def _hex_text(text: Column, count: int) -> Column:
    return F.rpad(F.substring(F.hex(F.encode(text, "UTF-8")), 1, 2 * count), 2 * count, "0")


def _hex_float32(value: Column) -> Column:
    """Little-endian hex of a float, by its sign, exponent and fraction."""
    x = F.abs(value.cast("double"))
    e = F.floor(F.log2(x)).cast("int")
    e = F.when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).when(F.pow(F.lit(2.0), e) > x, e - 1).otherwise(e)
    fraction = F.round((x / F.pow(F.lit(2.0), e) - 1) * float(1 << 23)).cast("bigint")
    bits = F.when(x == 0, F.lit(0)).otherwise(F.shiftleft((e + 127).cast("bigint"), 23) + fraction)
    bits = F.when(F.isnan(value), F.lit(0x7FC00000)).otherwise(bits + F.when(value < 0, F.lit(1 << 31)).otherwise(F.lit(0)))
    h = F.lpad(F.hex(bits.cast("bigint")), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def write_records(rows: DataFrame) -> DataFrame:
    """128-byte records (column raw) of rows of ROW; texts are cut to their fields."""
    byte = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    practice = F.concat(*[byte(F.get("practice", F.lit(i))) for i in range(PRACTICES)])
    parts = [_hex_text(F.col("name"), 32), _hex_text(F.col("login"), 16), _hex_text(F.col("grp"), 8), practice, _hex_text(F.col("project.repo"), 59), byte(F.col("project.mark")), _hex_float32(F.col("mark"))]
    return rows.select(F.unhex(F.concat(*parts)).alias("raw"))


def valid() -> Column:
    """Whether a parsed record is well formed: zeros only behind texts, practice 0 or 1, marks from 0 to 10."""
    clean = ~F.col("name").contains("\x00") & ~F.col("login").contains("\x00") & ~F.col("grp").contains("\x00") & ~F.col("project.repo").contains("\x00")
    marks = F.col("project.mark").between(0, 10) & ~F.isnan("mark") & F.col("mark").between(0, 10)
    return clean & F.forall("practice", lambda p: p.isin(0, 1)) & marks


def to_lines(rows: DataFrame, place: str) -> DataFrame:
    """One line for each leaf: [place].field: value."""
    leaf = lambda name, value: F.struct(F.lit(name).alias("f"), value.cast("string").alias("v"))
    leaves = [leaf(n, F.col(n)) for n in ("name", "login", "grp", "mark")] + [leaf("project.repo", F.col("project.repo")), leaf("project.mark", F.col("project.mark"))]
    leaves += [leaf(f"practice[{i}]", F.get("practice", F.lit(i))) for i in range(PRACTICES)]
    return rows.select(place, F.explode(F.array(*leaves)).alias("l")).select(F.concat(F.lit("["), F.col(place).cast("string"), F.lit("]."), F.col("l.f"), F.lit(": "), F.col("l.v")).alias("line"))


def from_lines(lines: DataFrame) -> DataFrame:
    """Rows of ROW, with place, from lines; lines out of form are left out.

    Lines are counted first, and dealt by place to parts of PART_LINES: what a task sorts does not grow with them.
    """
    # fixed value: the form of a line
    rx = r"^\[(\d+)\]\.([a-z.\[\]0-9]+): (.*)$"
    rows = lines.where(F.col("line").rlike(rx)).select(F.regexp_extract("line", rx, 1).cast("bigint").alias("place"), F.regexp_extract("line", rx, 2).alias("f"), F.regexp_extract("line", rx, 3).alias("v"))
    names = ["name", "login", "grp", "mark", "project.repo", "project.mark"] + [f"practice[{i}]" for i in range(PRACTICES)]
    dealt = rows.repartition(lines.count() // PART_LINES + 1, "place")
    wide = dealt.groupBy("place").agg(*[F.first(F.when(F.col("f") == n, F.col("v")), ignorenulls=True).alias(n) for n in names])
    at = lambda n: F.col(f"`{n}`")
    practice = F.array(*[at(f"practice[{i}]").try_cast("int") for i in range(PRACTICES)])
    project = F.struct(at("project.repo").alias("repo"), at("project.mark").try_cast("int").alias("mark"))
    return wide.select("place", at("name").alias("name"), at("login").alias("login"), at("grp").alias("grp"), practice.alias("practice"), project.alias("project"), at("mark").try_cast("float").alias("mark"))


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("name", "login", "grp", "practice", "project", "mark")).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", ROW).alias("s")).select("s.*")


def to_xml(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_xml(F.struct("name", "login", "grp", "practice", "project", "mark"), {"rowTag": "record"}).alias("xml"))


def from_xml(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_xml("xml", ROW, {"rowTag": "record"}).alias("s")).select("s.*")


def read_addresses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IPv4 numbers (ip) of files of little-endian 32-bit words, and rejects (file, length): files of another size."""
    files = spark.read.format("binaryFile").load(path)
    rejects = files.where("length % 4 <> 0").select(F.col("path").alias("file"), "length")
    whole = files.where("length % 4 = 0 and length > 0")
    words = whole.select(F.explode(F.transform(F.sequence(F.lit(0), (F.col("length") / 4).cast("int") - 1), lambda i: F.hex(F.call_function("substring", F.col("content"), i * 4 + 1, F.lit(4))))).alias("h"))
    return words.select(F.conv(F.concat(*[F.substring("h", i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint").alias("ip")), rejects


#: What is known of an address; one JSON object a line.
PEER = "ip string, country string, country_code string, city string, latitude double, longitude double, asn bigint, aso string"


def peer_lines(peers: DataFrame) -> DataFrame:
    """Rows of PEER as JSON lines (value); what is not known is written as null."""
    return peers.select(F.to_json(F.struct(*[f.split()[0] for f in PEER.split(", ")]), {"ignoreNullFields": "false"}).alias("value"))


def parse_peers(lines: DataFrame) -> DataFrame:
    """Rows of PEER of JSON lines (value); lines that are not JSON give none."""
    return lines.select(F.from_json("value", PEER, {"mode": "PERMISSIVE"}).alias("p")).select("p.*").where("ip is not null")


def read_numstat(spark: SparkSession, path: str) -> DataFrame:
    """Rows of added, deleted and path separated by tabs; binary changes ('-') get null counts."""
    parts = F.split("value", "\t", 3)
    rows = spark.read.text(path).where(F.size(parts) == 3)
    return rows.select(parts[0].try_cast("bigint").alias("added"), parts[1].try_cast("bigint").alias("deleted"), parts[2].alias("path"))


def read_csv(spark: SparkSession, path: str, schema: str, numbers: list[str]) -> DataFrame:
    """CSV with a header and a given schema; ``numbers`` that do not parse are 0."""
    names = [f.split()[0] for f in schema.split(",")]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names))
    kinds = dict(f.split()[:2] for f in schema.split(","))
    return raw.select(*[F.coalesce(F.col(n).try_cast(kinds[n]), F.lit(0).cast(kinds[n])).alias(n) if n in numbers else F.col(n).cast(kinds[n]).alias(n) for n in names])
