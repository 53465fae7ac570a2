"""Queries on container relations: properties, references, runs, timelines, layers, validation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataplane.functions import integers
from strataplane.operators import container
from strataplane.plans.base import query, table

# Bindings: orders are items, parts are properties, lineitem associates them; p_size % 5 tells a property's type.
TYPES = ("ispe", "av1C", "clap", "irot", "colr")
_TYPE_SQL = "CASE p_size % 5 WHEN 0 THEN 'ispe' WHEN 1 THEN 'av1C' WHEN 2 THEN 'clap' WHEN 3 THEN 'irot' ELSE 'colr' END"
_LINKED = f"linked AS (SELECT l_orderkey AS item, l_linenumber AS pos, l_partkey AS prop_index, p_retailprice AS value, {_TYPE_SQL} AS type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey <> 0 AND (l_returnflag = 'A' OR {_TYPE_SQL} NOT IN ('clap', 'irot')))"


def linked(spark, d):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("p_size") % 5 + 1)
    props = table(spark, d, "part").select(F.col("p_partkey").alias("prop_index"), kind.alias("type"), F.col("p_retailprice").alias("value"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("prop_index"), (F.col("l_returnflag") == "A").alias("essential"))
    return container.item_properties(links, props).select("item", "pos", "prop_index", "value", "type")


@query("item_property_join", f"WITH {_LINKED} SELECT item, pos, prop_index, value, type FROM linked")
def item_property_join(spark, d):
    return linked(spark, d)


@query("first_property", f"WITH {_LINKED} SELECT item, type, value FROM linked QUALIFY row_number() OVER (PARTITION BY item, type ORDER BY pos, prop_index) = 1")
def first_property(spark, d):
    return container.first_property(linked(spark, d), "value")


@query("unique_property", f"WITH {_LINKED} SELECT item, type, count(*) AS n FROM linked GROUP BY ALL HAVING count(*) > 1")
def unique_property(spark, d):
    return container.unique_violations(linked(spark, d))


@query("item_ref_graph", "SELECT r_name, n_name, s_suppkey, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def item_ref_graph(spark, d):
    region, nation, supplier = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "s_suppkey", "s_name")


@query(
    "aux_lookup",
    "WITH e AS (SELECT o_orderkey AS f, o_custkey AS t FROM orders), k AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT t AS item, f AS aux FROM e UNION ALL SELECT f, t FROM e) SELECT item, min(aux) AS aux FROM b WHERE aux IN (SELECT id FROM k) GROUP BY item",
)
def aux_lookup(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"))
    kinds = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))
    return container.auxiliary(edges, kinds, "BUILDING")


@query(
    "altr_preference",
    "WITH g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS ids, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey) SELECT o_custkey, list_position(ids, a) < list_position(ids, b) AS preferred FROM g",
)
def altr_preference(spark, d):
    ids = F.transform(F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda x: x["o_orderkey"])
    g = table(spark, d, "orders").groupBy("o_custkey").agg(ids.alias("ids"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    return g.select("o_custkey", container.preferred(F.col("ids"), F.col("a"), F.col("b")).alias("preferred"))


@query("premultiplied_link", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_discount >= 0.09)")
def premultiplied_link(spark, d):
    edges = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.09D").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(edges, "o_orderkey", "left_semi")


@query("sample_transform_inputs", "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS in1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS in2, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS in3, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 32")
def sample_transform_inputs(spark, d):
    pick = [F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"in{k}") for k in (1, 2, 3)]
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(*pick, F.count(F.lit(1)).alias("n")).where("n <= 32")


@query("stts_expand", "SELECT l_orderkey, l_linenumber, CAST(i AS BIGINT) AS i, CAST(l_quantity AS BIGINT) AS delta FROM lineitem, range(0, 7) t(i) WHERE i < l_linenumber")
def stts_expand(spark, d):
    runs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("delta"))
    return container.expand_runs(runs, ["l_orderkey", "l_linenumber"], "l_linenumber", "delta").withColumn("i", F.col("i").cast("bigint"))


@query("timeline", "SELECT event_id, user_id, CAST(coalesce(sum(t) OVER w, 0) AS BIGINT) AS start_ticks, CAST(coalesce(sum(t) OVER w, 0) * 1000 // 600 AS BIGINT) AS start_ms FROM (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def timeline(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.floor("value").cast("bigint").alias("t"))
    return container.timeline(rows, "user_id", "event_id", "t", 600).drop("t")


@query("duration_total", "SELECT user_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS ticks, count(*) AS n, count(*) <= 1000000 AS within FROM events GROUP BY user_id")
def duration_total(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(F.floor("value").cast("bigint")).alias("ticks"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) <= 1_000_000).alias("within"))


@query("repetition_count", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linenumber % 4 = 0 THEN -2 WHEN l_returnflag = 'R' THEN -1 ELSE (l_partkey + l_linenumber % 4 - 1) // (l_linenumber % 4) - 1 END AS BIGINT) AS n FROM lineitem")
def repetition_count(spark, d):
    track = F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))
    n = container.repetitions(track, (F.col("l_linenumber") % 4).cast("bigint"), F.col("l_returnflag") != "N")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"))


_RUNS = "run AS (SELECT o_custkey, o_orderkey AS first_chunk, CAST(o_orderkey % 7 + 1 AS BIGINT) AS per_chunk FROM orders WHERE o_orderkey % 3 = 0), chunk AS (SELECT o_custkey, o_orderkey AS chunk FROM orders)"


@query("stsc_range_join", f"WITH {_RUNS} SELECT c.o_custkey, c.chunk, r.per_chunk FROM chunk c ASOF JOIN run r ON c.o_custkey = r.o_custkey AND c.chunk >= r.first_chunk")
def stsc_range_join(spark, d):
    orders = table(spark, d, "orders")
    runs = orders.where("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("first_chunk"), (F.col("o_orderkey") % 7 + 1).alias("per_chunk"))
    return container.chunk_runs(orders.select("o_custkey", F.col("o_orderkey").alias("chunk")), runs, "o_custkey")


@query("stsc_monotonic", f"WITH {_RUNS} SELECT o_custkey, first_chunk, first_chunk > coalesce(lag(first_chunk) OVER (PARTITION BY o_custkey ORDER BY first_chunk), 0) AS ok FROM run")
def stsc_monotonic(spark, d):
    runs = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("first_chunk"))
    before = F.lag("first_chunk").over(W.partitionBy("o_custkey").orderBy("first_chunk"))
    return runs.withColumn("ok", F.col("first_chunk") > F.coalesce(before, F.lit(0)))


@query("sample_offsets", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 4096 + coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lineitem")
def sample_offsets(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("size"), (F.col("l_orderkey") * 4096).alias("base"))
    return container.sample_offsets(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "base", "size").select("l_orderkey", "l_linenumber", "offset")


@query("aux_sample_alignment", "SELECT coalesce(c.o_custkey, a.c_custkey) AS track, coalesce(n, 0) AS colour, coalesce(m, 0) AS alpha, coalesce(n, 0) = coalesce(m, 0) AS aligned FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) c FULL JOIN (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS m FROM customer) a ON c.o_custkey = a.c_custkey")
def aux_sample_alignment(spark, d):
    colour = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("track")).agg(F.count(F.lit(1)).alias("colour"))
    alpha = table(spark, d, "customer").select(F.col("c_custkey").alias("track"), F.col("c_nationkey").cast("bigint").alias("alpha"))
    both = colour.join(alpha, "track", "full").select("track", F.coalesce("colour", F.lit(0)).alias("colour"), F.coalesce("alpha", F.lit(0)).alias("alpha"))
    return both.withColumn("aligned", F.col("colour") == F.col("alpha"))


@query("payload_concat", "SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS payload, count(*) AS n FROM conversations GROUP BY conv_id")
def payload_concat(spark, d):
    return container.payloads(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("primary_track", "SELECT c_nationkey, arg_max(c_custkey, (CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) * 1000000000 - c_custkey) AS track FROM customer GROUP BY c_nationkey")
def primary_track(spark, d):
    rank = F.struct((F.col("c_mktsegment") == "BUILDING").cast("int"), -F.col("c_custkey"))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", rank).alias("track"))


@query("max_sync_sample", "SELECT o_custkey, max(o_orderkey) AS sync, max(o_orderkey) <= 15000000 AS ok FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def max_sync_sample(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("sync"), (F.max("o_orderkey") <= 15_000_000).alias("ok"))


@query("duplicate_boxes", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_boxes(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("cells_equal", "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS ok FROM lineitem GROUP BY l_orderkey")
def cells_equal(spark, d):
    """All equal where the smallest and the largest are: no distinct set is kept."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.min("l_returnflag") == F.max("l_returnflag")).alias("ok"))


# ---- records and layers: event_id % 4 is the temporal, user_id % 3 the spatial layer, event_id div 8 the unit

_REC = "rec AS (SELECT event_id, event_type, event_id % 4 AS tid, user_id % 3 AS sid, event_id // 8 AS unit FROM events)"


def records(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 4).alias("tid"), (F.col("user_id") % 3).alias("sid"), F.expr("event_id div 8").alias("unit"))


for _idc in (0, 0x103, 0x305):
    query(f"obu_filter_operating_point_{_idc}", f"WITH {_REC} SELECT event_id, tid, sid, unit FROM rec WHERE {_idc} = 0 OR (({_idc} >> CAST(tid AS INTEGER)) & 1 = 1 AND ({_idc} >> CAST(sid + 8 AS INTEGER)) & 1 = 1)")(
        (lambda idc: lambda spark, d: records(spark, d).where(container.in_operating_point(F.col("tid"), F.col("sid"), idc)).select("event_id", "tid", "sid", "unit"))(_idc)
    )


@query("layer_highest", f"WITH {_REC} SELECT unit, arg_max(event_id, sid * 1000000000 + event_id) AS event_id, max(sid) AS sid FROM rec GROUP BY unit")
def layer_highest(spark, d):
    return records(spark, d).groupBy("unit").agg(F.max_by("event_id", F.struct("sid", "event_id")).alias("event_id"), F.max("sid").alias("sid"))


@query("layer_select", f"WITH {_REC} SELECT unit, min(event_id) AS event_id FROM rec WHERE sid = 1 GROUP BY unit")
def layer_select(spark, d):
    return records(spark, d).where("sid = 1").groupBy("unit").agg(F.min("event_id").alias("event_id"))


def _modes():
    """Frame categories over event types in order of name: the first is a key frame, the second intra only."""
    key, intra = "click", "login"
    return {"all": "true", "reference": "event_id % 256 <> 0", "intra": f"event_type IN ('{key}', '{intra}')", "key": f"event_type = '{key}'"}


for _mode, _cond in _modes().items():
    query(f"frame_selection_{_mode}", f"WITH {_REC} SELECT event_id, unit FROM rec WHERE {_cond}")((lambda c: lambda spark, d: records(spark, d).where(c).select("event_id", "unit"))(_cond))


@query("ref_slot_refresh", "SELECT user_id, CAST(s AS INTEGER) AS slot, max(event_id) AS frame FROM events, range(0, 8) t(s) WHERE ((event_id % 256) >> s) & 1 = 1 GROUP BY user_id, s")
def ref_slot_refresh(spark, d):
    frames = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 256).alias("mask"))
    return container.refreshed_slots(frames, "user_id", "event_id", "mask")


@query("frame_by_index", f"WITH {_REC} SELECT event_id, unit FROM rec WHERE event_id % 8 = 3")
def frame_by_index(spark, d):
    return records(spark, d).where("event_id % 8 = 3").select("event_id", "unit")


@query("visibility_filter", "SELECT event_id, event_type FROM events WHERE value >= 0 AND (event_id % 2 = 0 OR event_type <> 'click')")
def visibility_filter(spark, d):
    return table(spark, d, "events").where("value >= 0 and (event_id % 2 = 0 or event_type <> 'click')").select("event_id", "event_type")


@query(
    "leb128_decode",
    "WITH b AS (SELECT doc_id, list_transform(range(1, 6), lambda i: CAST(unicode(substr(text || '     ', i, 1)) % 256 AS BIGINT)) AS g FROM documents), s AS (SELECT doc_id, g, coalesce(nullif(list_position(list_transform(g, lambda x: x < 128), true), 0), 5) AS n FROM b) SELECT doc_id, CAST(list_sum(list_transform(range(1, n + 1), lambda i: (g[i] % 128) * CAST(power(2, 7 * (i - 1)) AS BIGINT))) AS BIGINT) AS v FROM s",
)
def leb128_decode(spark, d):
    padded = F.concat("text", F.lit("     "))
    groups = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.ascii(F.substring(padded, i, F.lit(1))) % 256)
    return table(spark, d, "documents").select("doc_id", integers.leb128(groups).alias("v"))


@query("bitfield_extract", "SELECT doc_id, CAST((unicode(text) % 256) >> 5 AS INTEGER) AS top3, CAST(((unicode(text) % 256) >> 1) & 15 AS INTEGER) AS mid4, CAST(unicode(text) & 1 AS INTEGER) AS low FROM documents WHERE length(text) > 0")
def bitfield_extract(spark, d):
    b = F.ascii("text") % 256
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", integers.bits_of(b, 0, 3).alias("top3"), integers.bits_of(b, 3, 4).alias("mid4"), integers.bits_of(b, 7, 1).alias("low"))


# ---- validation: violations as rows

VALIDATIONS = {
    "grid_geometry": ("part", "p_partkey, p_size", "p_size < 8 OR p_size * 3 < 40 OR p_size % 2 = 1"),
    "size_limit": ("part", "p_partkey, p_size", "p_size > 45 OR p_size * p_partkey > 8192"),
    "input_size": ("documents", "doc_id, n_chars", "n_chars > 4096"),
    "positive_dimensions": ("lineitem", "l_orderkey, l_linenumber", "l_quantity < 2 OR l_extendedprice <= 0"),
    "declared_size": ("documents", "doc_id, n_chars", "n_chars <> length(text)"),
    "narrowing": ("lineitem", "l_orderkey, l_linenumber", "l_orderkey * l_partkey > 2147483647 OR l_orderkey * l_partkey < 0"),
}
for _name, (_table, _cols, _cond) in VALIDATIONS.items():
    query(f"validate_{_name}", f"SELECT {_cols} FROM {_table} WHERE {_cond}")((lambda t, c, w: lambda spark, d: table(spark, d, t).where(w).select(*c.split(", ")))(_table, _cols, _cond))


@query("validate_metadata_budget", "SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents QUALIFY used > 20000")
def validate_metadata_budget(spark, d):
    """Entries whose source has used up its budget with them, in order of doc_id."""
    rows = container.sum_before(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", "before")
    return rows.select("doc_id", "source", (F.col("before") + F.coalesce("n_chars", F.lit(0))).cast("bigint").alias("used")).where("used > 20000")


@query("validate_transform_agreement", "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 WHERE a.l_linenumber > 1 AND a.l_linestatus = 'O' AND a.l_returnflag IS DISTINCT FROM b.l_returnflag")
def validate_transform_agreement(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag")
    master = rows.where("l_linenumber = 1").select("l_orderkey", F.col("l_returnflag").alias("m"))
    return rows.where("l_linenumber > 1 and l_linestatus = 'O'").join(master, "l_orderkey").where(~F.col("l_returnflag").eqNullSafe(F.col("m"))).select("l_orderkey", "l_linenumber")
