"""Queries over mergeable operations and version vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltmark.operators import crdt, vectors
from siltmark.plans.registry import Registry
from siltmark.sources.tables import CRDT_OPS_SQL, PACKETS_SQL, crdt_ops, packets, table

R = Registry()
_LWW = "SELECT {keys}, w.rev AS rev, w.val AS val, w.src AS src FROM (SELECT {keys}, max(struct_pack(a := abs(rev), val := val, src := src, rev := rev)) AS w FROM {ops} GROUP BY {keys})"


@R.query(f"WITH {CRDT_OPS_SQL} {_LWW.format(keys='obj, field', ops='crdt_ops')}")
def crdt_lww(spark, d):
    return crdt.lww(crdt_ops(spark, d), "obj", "field")


@R.query(f"WITH {CRDT_OPS_SQL} SELECT obj, CAST(sum(v) AS BIGINT) AS total FROM (SELECT obj, src, max(val) AS v FROM crdt_ops GROUP BY ALL) GROUP BY obj")
def crdt_n(spark, d):
    return crdt.grow_counter(crdt_ops(spark, d), "obj")


@R.query(f"WITH {CRDT_OPS_SQL}, l AS ({_LWW.format(keys='obj, src', ops='crdt_ops').replace(', w.src AS src', '')}) SELECT obj, CAST(sum(val) AS BIGINT) AS total FROM l GROUP BY obj")
def crdt_z(spark, d):
    return crdt.counter(crdt_ops(spark, d), "obj")


@R.query(
    f"""WITH {CRDT_OPS_SQL}, s AS (SELECT obj, val % 50 AS val, max(struct_pack(a := abs(rev), src := src, rev := rev)) AS w FROM crdt_ops GROUP BY ALL) SELECT obj, val FROM s WHERE w.rev > 0"""
)
def crdt_set(spark, d):
    return crdt.live_elements(crdt_ops(spark, d).withColumn("val", F.col("val") % 50), "obj")


@R.query(f"WITH {CRDT_OPS_SQL}, l AS ({_LWW.format(keys='obj, field', ops='crdt_ops')}) SELECT obj, field, val FROM l WHERE rev > 0")
def crdt_map(spark, d):
    return crdt.live_pairs(crdt_ops(spark, d), "obj", "field")


_PAIRS_SQL = "p AS (SELECT user_id AS obj, event_type AS key, CASE WHEN event_id % 7 = 0 THEN -(event_id % 40 + 1) ELSE event_id % 40 + 1 END AS krev, event_id % 5 AS ksrc, CASE WHEN event_id % 9 = 0 THEN -(event_id % 30 + 1) ELSE event_id % 30 + 1 END AS vrev, CAST(round(value * 100) AS BIGINT) AS val, event_id % 3 AS vsrc FROM events)"


@R.query(
    f"""WITH {_PAIRS_SQL}, w AS (SELECT obj, key, max(struct_pack(a := abs(krev), src := ksrc, rev := krev)) AS k, max(struct_pack(a := abs(vrev), val := val, src := vsrc, rev := vrev)) AS v FROM p GROUP BY ALL)
SELECT obj, key, CASE WHEN v.rev > 0 THEN v.val END AS val, k.a AS krev, v.a AS vrev FROM w WHERE k.rev > 0"""
)
def crdt_map_pairs(spark, d):
    """Maps whose keys and values are written apart."""
    e = F.col("event_id")
    signed = lambda every, of: F.when(e % every == 0, -(e % of + 1)).otherwise(e % of + 1)
    ops = table(spark, d, "events").select(F.col("user_id").alias("obj"), F.col("event_type").alias("key"), signed(7, 40).alias("krev"), (e % 5).alias("ksrc"), signed(9, 30).alias("vrev"), F.round(F.col("value") * 100).cast("bigint").alias("val"), (e % 3).alias("vsrc"))
    return crdt.map_pairs(ops)


@R.query(f"WITH {CRDT_OPS_SQL}, m AS (SELECT * REPLACE (99 AS src) FROM crdt_ops WHERE src = 3 UNION ALL SELECT * FROM crdt_ops WHERE src <> 3) {_LWW.format(keys='obj, field', ops='m')}")
def crdt_resource(spark, d):
    """Latest values after one author's operations went to another name."""
    ops = crdt_ops(spark, d)
    return crdt.lww(crdt.resource(ops, F.when(F.col("src") == 3, 99).otherwise(F.col("src"))), "obj", "field")


_VALUES_SQL = """v AS (SELECT event_id, user_id, substr('FIRST', CAST(1 + event_id % 5 AS INTEGER), 1) AS type, CASE event_id % 5 WHEN 0 THEN CAST(user_id AS VARCHAR) || '.5' WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN CAST((user_id << 44) | (event_id << 12) AS VARCHAR) WHEN 3 THEN event_type || '"' || user_id ELSE event_type END AS value FROM events)"""


def _values(spark, d):
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    forms = F.array(F.concat(user, F.lit(".5")), e.cast("string"), crdt.id64(F.col("user_id"), e, F.lit(0)).cast("string"), F.concat("event_type", F.lit('"'), user), F.col("event_type"))
    return table(spark, d, "events").select("event_id", "user_id", F.expr("substring('FIRST', cast(1 + event_id % 5 as int), 1)").alias("type"), F.element_at(forms, (e % 5 + 1).cast("int")).alias("value"))


@R.query(f"""WITH {_VALUES_SQL} SELECT event_id, type, CASE type WHEN 'S' THEN '"' || replace(value, '"', '\\"') || '"' WHEN 'R' THEN lower(to_hex(user_id) || '-' || to_hex(event_id) || '-0') ELSE value END AS text, value AS back FROM v""")
def crdt_value_text(spark, d):
    """Text forms of values by type, and what they parse to."""
    rows = _values(spark, d).withColumn("text", crdt.value_text(F.col("type"), F.col("value")))
    return rows.select("event_id", "type", "text", crdt.parsed_value(F.col("type"), F.col("text")).alias("back"))


@R.query(f"WITH {_VALUES_SQL} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY type, encode(value), event_id) AS place FROM v")
def crdt_value_order(spark, d):
    """Values of each object in order: by type, then bytes."""
    order = Window.partitionBy("user_id").orderBy(crdt.value_order(F.col("type"), F.col("value")), "event_id")
    return _values(spark, d).select("event_id", F.row_number().over(order).cast("bigint").alias("place"))


_HALF = "a AS ({}), b AS ({})".format(_LWW.format(keys="obj, field", ops="(SELECT * FROM crdt_ops WHERE src < 5)"), _LWW.format(keys="obj, field", ops="crdt_ops"))


@R.query(f"WITH {CRDT_OPS_SQL}, {_HALF} SELECT b.obj, b.field, coalesce(abs(a.rev), 0) + 1 AS rev, b.val FROM b LEFT JOIN a USING (obj, field) WHERE a.rev IS NULL OR a.val IS DISTINCT FROM b.val")
def crdt_delta(spark, d):
    ops = crdt_ops(spark, d)
    return crdt.delta(crdt.lww(ops.where("src < 5"), "obj", "field"), crdt.lww(ops, "obj", "field"), "obj", "field")


@R.query(
    f"""WITH {CRDT_OPS_SQL}, a AS (SELECT obj, src, max(val) AS val FROM crdt_ops WHERE rev % 2 = 0 GROUP BY ALL), b AS (SELECT obj, src, max(val) AS val FROM crdt_ops GROUP BY ALL)
SELECT obj, src, b.val FROM b LEFT JOIN a USING (obj, src) WHERE a.val IS NULL OR b.val > a.val"""
)
def crdt_counter_delta(spark, d):
    ops = crdt_ops(spark, d)
    peak = lambda df: df.groupBy("obj", "src").agg(F.max("val").alias("val"))
    return crdt.counter_delta(peak(ops.where("rev % 2 = 0")), peak(ops), "obj", "src")


@R.query(f"WITH {CRDT_OPS_SQL} SELECT obj, count(*) AS n_ops FROM crdt_ops WHERE src IN (SELECT event_id % 3 FROM events) GROUP BY obj")
def crdt_diff_by_vector(spark, d):
    vector = table(spark, d, "events").select((F.col("event_id") % 3).alias("src")).distinct()
    return crdt.of_sources(crdt_ops(spark, d), vector).groupBy("obj").agg(F.count("*").alias("n_ops"))


@R.query("SELECT event_id, (user_id << 44) | (event_id << 12) | (event_id % 4096) AS packed, lower(to_hex(user_id) || '-' || to_hex(event_id) || '-' || to_hex(event_id % 4096)) AS text FROM events")
def id64_format(spark, d):
    events = table(spark, d, "events").withColumn("packed", crdt.id64(F.col("user_id"), F.col("event_id"), F.col("event_id") % 4096))
    return events.select("event_id", "packed", crdt.id64_text(F.col("packed")).alias("text"))


_INSERTS_SQL = "i AS (SELECT user_id AS obj, event_id AS id, lag(event_id, 1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS parent, event_type <> 'error' AS live FROM events)"


@R.query(
    f"""WITH RECURSIVE {_INSERTS_SQL}, p AS (SELECT obj, id, live, [1099511627776 - id] AS path FROM i WHERE parent IS NULL UNION ALL
SELECT i.obj, i.id, i.live, list_append(path, 1099511627776 - i.id) FROM i JOIN p ON p.obj = i.obj AND p.id = i.parent)
SELECT obj, count(*) AS n_all, string_agg(id, ',' ORDER BY path) FILTER (WHERE live) AS items FROM p GROUP BY obj"""
)
def crdt_array(spark, d):
    """Replicated arrays: elements in weave order, deleted ones left out."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    lags = [F.lag("event_id", k).over(order) for k in (1, 2, 3)]
    which = F.col("event_id") % 3
    inserts = table(spark, d, "events").select(F.col("user_id").alias("obj"), F.col("event_id").alias("id"), F.when(which == 0, lags[0]).when(which == 1, lags[1]).otherwise(lags[2]).alias("parent"), (F.col("event_type") != "error").alias("live"))
    woven = crdt.array_order(inserts)
    items = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("path", "id", "live"))), lambda x: x["live"]), lambda x: x["id"].cast("string"))
    return woven.groupBy("obj").agg(F.count("*").alias("n_all"), items.alias("i")).select("obj", "n_all", F.when(F.size("i") > 0, F.array_join("i", ",")).alias("items"))


_VV_SQL = f"{PACKETS_SQL}, a AS (SELECT src, max(seq) AS seq FROM packets WHERE event_id % 3 = 0 AND src % 5 <> 0 GROUP BY src), b AS (SELECT src, max(seq) AS seq FROM packets WHERE event_id % 5 = 0 AND src % 7 <> 0 GROUP BY src)"


def _vectors(spark, d):
    log = packets(spark, d)
    top = lambda df: df.groupBy("src").agg(F.max("seq").alias("seq"))
    return log, top(log.where("event_id % 3 = 0 and src % 5 <> 0")), top(log.where("event_id % 5 = 0 and src % 7 <> 0"))


@R.query(f"WITH {_VV_SQL} SELECT src, max(seq) AS seq FROM (FROM a UNION ALL FROM b) GROUP BY src")
def vv_merge(spark, d):
    _, a, b = _vectors(spark, d)
    return vectors.merge(a, b)


@R.query(f"WITH {_VV_SQL} SELECT src, a.seq FROM a LEFT JOIN b USING (src) WHERE a.seq > coalesce(b.seq, -1)")
def vv_news(spark, d):
    _, a, b = _vectors(spark, d)
    return vectors.news(a, b)


@R.query(f"WITH {_VV_SQL} SELECT src, coalesce(b.seq, 0) AS start FROM a LEFT JOIN b USING (src) WHERE a.seq > coalesce(b.seq, -1)")
def vv_interest(spark, d):
    _, a, b = _vectors(spark, d)
    return vectors.interest(a, b)


@R.query(f"WITH {_VV_SQL}, m AS (SELECT src, max(seq) AS seq FROM (FROM a UNION ALL FROM b) GROUP BY src) SELECT (SELECT bool_and(coalesce(a.seq, -1) >= b.seq) FROM b LEFT JOIN a USING (src)) AS a_seen_b, (SELECT bool_and(coalesce(m.seq, -1) >= b.seq) FROM b LEFT JOIN m USING (src)) AS m_seen_b")
def vv_seen(spark, d):
    _, a, b = _vectors(spark, d)
    return vectors.seen(a, b).withColumnRenamed("seen", "a_seen_b").crossJoin(F.broadcast(vectors.seen(vectors.merge(a, b), b).withColumnRenamed("seen", "m_seen_b")))


@R.query(f"WITH {_VV_SQL} SELECT src, a.seq FROM a JOIN b USING (src) WHERE a.seq > b.seq")
def vv_diff(spark, d):
    _, a, b = _vectors(spark, d)
    return vectors.difference(a, b)


@R.query(f"WITH {_VV_SQL} SELECT 'union' AS op, src FROM (SELECT src FROM a UNION SELECT src FROM b) UNION ALL SELECT 'both', src FROM (SELECT src FROM a INTERSECT SELECT src FROM b) UNION ALL SELECT 'only', src FROM (SELECT src FROM a EXCEPT SELECT src FROM b)")
def vv_algebra(spark, d):
    _, a, b = _vectors(spark, d)
    a, b = a.select("src"), b.select("src")
    named = lambda df, op: df.select(F.lit(op).alias("op"), "src")
    return named(a.union(b).distinct(), "union").unionByName(named(a.intersect(b), "both")).unionByName(named(a.subtract(b), "only"))


_CLOSURE_SQL = """e AS (SELECT event_id AS child, event_id // 2 AS parent FROM events WHERE event_id > 0 UNION SELECT event_id, event_id - 7 FROM events WHERE event_id >= 7 AND event_id % 5 = 0),
r AS (SELECT 0 AS tip, event_id AS version FROM events WHERE event_id % 977 = 5 UNION SELECT 1, event_id FROM events WHERE event_id % 983 = 7 UNION SELECT tip, parent FROM r JOIN e ON child = version)"""


@R.query(
    f"""WITH RECURSIVE {_CLOSURE_SQL}, s AS (SELECT version, bool_or(tip = 0) AS a, bool_or(tip = 1) AS b FROM r GROUP BY version)
SELECT CAST(version AS BIGINT) AS version, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only a' ELSE 'only b' END AS side FROM s"""
)
def vv_closure(spark, d):
    """Set algebra of two sets of versions with all that they rest on."""
    events = table(spark, d, "events").select(F.col("event_id").alias("child"))
    edges = events.where("child > 0").select("child", F.floor(F.col("child") / 2).alias("parent")).union(events.where("child >= 7 and child % 5 = 0").select("child", F.col("child") - 7)).distinct()
    return vectors.closures(edges, events.where("child % 977 = 5").select(F.col("child").alias("version")), events.where("child % 983 = 7").select(F.col("child").alias("version")))


@R.query(f"WITH {PACKETS_SQL} SELECT src, min(seq) AS first, max(seq) AS last FROM (SELECT src, seq, seq - row_number() OVER (PARTITION BY src ORDER BY seq) AS g FROM packets) GROUP BY src, g")
def log_gaps(spark, d):
    return vectors.islands(packets(spark, d))


@R.query("SELECT conv_id, turn FROM conversations c WHERE turn > 0 AND turn % 3 <> 1 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.turn % 3 <> 1)")
def causal_held(spark, d):
    """Turns that wait for a missing one before them."""
    turns = table(spark, d, "conversations").where("turn % 3 <> 1").select(F.col("conv_id").alias("src"), F.col("turn").alias("seq"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("ref"))
    return vectors.held(turns).select(F.col("src").alias("conv_id"), F.col("seq").alias("turn"))


@R.query(f"WITH {_VV_SQL} SELECT src, count(*) AS n, min(p.seq) AS first FROM packets p LEFT JOIN a USING (src) WHERE p.seq > coalesce(a.seq, -1) GROUP BY src")
def sync_send(spark, d):
    log, a, _ = _vectors(spark, d)
    return vectors.beyond(log, a).groupBy("src").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@R.query(f"WITH {_VV_SQL} SELECT src, count(*) AS n, max(p.seq) AS last FROM packets p JOIN b USING (src) WHERE p.seq <= b.seq GROUP BY src")
def sync_snapshot(spark, d):
    log, _, b = _vectors(spark, d)
    return vectors.within(log, b).groupBy("src").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@R.query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + n_regionkey) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 11) % 25 FROM nation),
r AS (SELECT DISTINCT a AS start, a AS peer, 0 AS round FROM e UNION ALL SELECT r.start, e.b, r.round + 1 FROM r JOIN e ON e.a = r.peer WHERE r.round < 4)
SELECT start, peer, min(round) AS round FROM r GROUP BY start, peer"""
)
def gossip_reach(spark, d):
    nation = table(spark, d, "nation")
    a = F.col("n_nationkey")
    edges = nation.select(a.alias("a"), ((a * 7 + F.col("n_regionkey")) % 25).alias("b")).union(nation.select(a, (a * 3 + 11) % 25)).distinct()
    return vectors.reach(spark, edges, 4)


@R.query(
    """SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'"""
)
def class_grab(spark, d):
    """Conjunctive filter over one class, and names along its references."""
    orders = table(spark, d, "orders").where("o_totalprice > 100000 and o_orderstatus = 'F'")
    customer = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    out = orders.join(customer, orders.o_custkey == customer.c_custkey).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


_STACKS_SQL = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_id AS item FROM events), a AS (SELECT * FROM s WHERE place <= 40), b AS (SELECT user_id, place, CASE WHEN place > 20 + user_id % 15 THEN -item ELSE item END AS item FROM s WHERE place <= 30 + user_id % 9)"


@R.query(
    f"""WITH {_STACKS_SQL}, j AS (SELECT user_id, place, a.item AS x, b.item AS y FROM a FULL JOIN b USING (user_id, place)), f AS (SELECT user_id, min(place) AS first FROM j WHERE x IS DISTINCT FROM y GROUP BY 1)
SELECT user_id, place, side, item FROM (SELECT user_id, place, 'a' AS side, x AS item FROM j UNION ALL SELECT user_id, place, 'b', y FROM j) JOIN f USING (user_id) WHERE place >= first AND item IS NOT NULL"""
)
def stack_difference(spark, d):
    """Files of two stacks beyond what they have in common from the bottom up."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    rows = table(spark, d, "events").select("user_id", place.alias("place"), F.col("event_id").alias("item"))
    b = rows.where("place <= 30 + user_id % 9").withColumn("item", F.when(F.col("place") > 20 + F.col("user_id") % 15, -F.col("item")).otherwise(F.col("item")))
    return vectors.stack_difference(rows.where("place <= 40"), b, "user_id")


QUERIES, ORACLES = R.queries, R.oracles
