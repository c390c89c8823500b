"""Structures: one JSON document per customer from its orders, and the documents in ``events.props``."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe.operators import structure
from shardframe.plans.registry import query, table
from shardframe.session import new_shared_path, store
from shardframe.sources.files import io_parts, read_texts


def documents(spark, sf):
    """``(config_id, rank, json)``: a structure per order with keys that do not sort."""
    c = F.col
    # Reading a document costs far more than moving it, and one table file is one scan task.
    return table(spark, sf, "orders").repartition(io_parts(spark), "o_orderkey").select(
        c("o_orderstatus").alias("config_id"),
        c("o_orderkey").alias("rank"),
        F.format_string(
            '{"model": {"lm": {"weight": {"tensor": [%d, 64]}, "a.bias": {"tensor": [%d]}}, "rng": {"tensor": [3]}},'
            ' "iteration": %d, "dir.meta": 1, "groups": [{"lr": %.2f, "params": [0, 1]}, {"lr": null, "on": %s}], "args": {"name": "%s"}}',
            c("o_custkey") + 1, c("o_custkey") % 7 + 1, "o_orderkey", c("o_totalprice"),
            F.when(c("o_orderkey") % 2 == 0, "true").otherwise("false"), "o_orderpriority",
        ).alias("json"),
    )


NODES = """
WITH o AS (SELECT o_orderstatus AS config_id, o_orderkey AS rank, o_custkey, o_totalprice, o_orderpriority FROM orders),
node(path, ord, kind) AS (VALUES ('model', 0, 'dict'), ('model/lm', 1, 'dict'), ('model/lm/weight', 2, 'tensor'), ('model/lm/a.bias', 3, 'tensor'),
  ('model/rng', 4, 'tensor'), ('iteration', 5, 'value'), ('dir.meta', 6, 'value'), ('groups', 7, 'list'), ('groups/0', 8, 'dict'),
  ('groups/0/lr', 9, 'value'), ('groups/0/params', 10, 'list'), ('groups/0/params/0', 11, 'value'), ('groups/0/params/1', 12, 'value'),
  ('groups/1', 13, 'dict'), ('groups/1/lr', 14, 'value'), ('groups/1/on', 15, 'value'), ('args', 16, 'dict'), ('args/name', 17, 'value')),
flat AS (SELECT config_id, rank, path, ord::BIGINT AS ord, kind,
  CASE path WHEN 'model/lm/weight' THEN o_custkey + 1 WHEN 'model/lm/a.bias' THEN o_custkey % 7 + 1 WHEN 'model/rng' THEN 3 END AS rows,
  CASE WHEN kind = 'list' THEN 2::BIGINT END AS length,
  CASE path WHEN 'iteration' THEN rank::VARCHAR WHEN 'dir.meta' THEN '1' WHEN 'groups/0/params/0' THEN '0' WHEN 'groups/0/params/1' THEN '1'
    WHEN 'groups/1/lr' THEN 'None' WHEN 'groups/1/on' THEN CASE WHEN rank % 2 = 0 THEN 'True' ELSE 'False' END
    WHEN 'args/name' THEN o_orderpriority WHEN 'groups/0/lr' THEN printf('%.2f', o_totalprice) END AS value FROM o, node)
"""


def flat(spark, sf):
    return structure.flatten_structure(documents(spark, sf))


def text_of(value):
    """A float as printed with two digits, other values as they are."""
    return F.when(F.col("dtype") == "float", F.format_string("%.2f", F.col("value").cast("double"))).otherwise(value)


@query("c1_flatten_structure", NODES + "SELECT config_id, rank, path, ord, kind, rows, length, value FROM flat")
def c1(spark, sf):
    return flat(spark, sf).select(
        "config_id", "rank", "path", "ord", "kind", F.col("shape")[0].alias("rows"), "length", text_of(F.col("value")).alias("value")
    )


@query(
    "c2_state_leaves",
    NODES
    + """SELECT config_id, rank, path, kind, value FROM flat WHERE kind IN ('tensor', 'value') AND path <> 'dir.meta'""",
)
def c2(spark, sf):
    # Reading the documents is nearly all of the work, so both kinds of leaves come from one reading.
    tensors, values = structure.state_leaves(store(flat(spark, sf), "nodes"))
    cols = ["config_id", "rank", "path"]
    a = tensors.select(*cols, F.lit("tensor").alias("kind"), F.lit(None).cast("string").alias("value"))
    return a.unionByName(values.select(*cols, F.lit("value").alias("kind"), text_of(F.col("value")).alias("value")))


@query("c3_state_lists", NODES + "SELECT config_id, rank, path, length FROM flat WHERE kind = 'list'")
def c3(spark, sf):
    return structure.state_lists(flat(spark, sf))


# Keys to look up: a tensor, a list and an absent key per order.
KEYS = """, k AS (SELECT config_id, rank, CASE rank % 3 WHEN 0 THEN 'model/lm/weight' WHEN 1 THEN 'groups' ELSE 'model/none' END AS path FROM o)
"""


def wanted(spark, sf):
    r = F.col("rank") % 3
    path = F.when(r == 0, "model/lm/weight").when(r == 1, "groups").otherwise("model/none")
    return documents(spark, sf).select("config_id", "rank", path.alias("path"))


@query("c4_shapes_of", NODES + KEYS + "SELECT config_id, rank, path, rows FROM k JOIN flat USING (config_id, rank, path) WHERE kind = 'tensor'")
def c4(spark, sf):
    found, _ = structure.shapes_of(flat(spark, sf), wanted(spark, sf))
    return found.select("config_id", "rank", "path", F.col("shape")[0].alias("rows"))


@query(
    "c4_shape_violations",
    NODES + KEYS + """SELECT config_id, rank, path, CASE WHEN kind IS NULL THEN 'no such key' ELSE 'not a tensor' END AS reason
    FROM k LEFT JOIN flat USING (config_id, rank, path) WHERE kind IS NULL OR kind <> 'tensor'""",
)
def c4_violations(spark, sf):
    return structure.shapes_of(flat(spark, sf), wanted(spark, sf))[1]


def state_tables(spark, sf):
    """The documents as stored state: tensors, values and lists with ``snapshot`` for ``config_id``."""
    # The documents are read once for the three tables.
    rows = store(flat(spark, sf).drop("parts", "ord"), "nodes").withColumnRenamed("config_id", "snapshot")
    tensors = rows.filter("kind = 'tensor'").select("snapshot", "rank", "path", "shape")
    values = rows.filter("kind = 'value'").select("snapshot", "rank", "path", "dtype", "value")
    return tensors, values, rows.filter("kind = 'list'").select("snapshot", "rank", "path", "length")


@query("c5_summarize_state", NODES + "SELECT config_id, rank, path, kind, rows, length FROM flat WHERE kind <> 'dict'")
def c5(spark, sf):
    summary = structure.summarize_state(*state_tables(spark, sf))
    return summary.select("config_id", "rank", "path", "kind", F.col("shape")[0].alias("rows"), "length")


@query(
    "c6_model_keys",
    NODES + """SELECT config_id, rank, path, ord - 2 AS key_ord FROM flat WHERE path IN ('model/lm/weight', 'model/lm/a.bias')""",
)
def c6(spark, sf):
    return structure.model_keys(flat(spark, sf)).select("config_id", "rank", "path", "key_ord")


@query(
    "c7_rank_map_violations",
    """WITH m AS (SELECT o_orderstatus AS config_id, o_custkey AS rank, o_orderkey % 101 AS pp, o_orderkey % 103 AS mp, o_orderkey % 2 AS dp FROM orders)
    SELECT config_id, rank, count(*) AS n, 'rank repeated' AS reason FROM m GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT config_id, min(rank), count(*), 'position repeated' FROM m GROUP BY config_id, pp, mp, dp HAVING count(*) > 1""",
)
def c7(spark, sf):
    key = F.col("o_orderkey")
    ranks = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("config_id"), F.col("o_custkey").alias("rank"),
        (key % 101).alias("pp"), (key % 103).alias("mp"), (key % 2).alias("dp"),
    )
    return structure.rank_map_violations(ranks)


@query(
    "c8_layer_map",
    """SELECT l_returnflag AS config_id, l_orderkey AS rank, max(l_linenumber)::BIGINT AS mp,
      array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS layers FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2""",
)
def c8(spark, sf):
    name = F.when(
        F.col("l_linestatus") == "F", F.format_string("x/layer_%02d-model_%02d-model_states.json", "l_partkey", "l_linenumber")
    ).otherwise("x/mp_rank_00.json")
    files = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("config_id"), F.col("l_orderkey").alias("rank"), name.alias("path")
    )
    mapped = structure.layer_map(files)
    return mapped.withColumn("layers", F.array_join(F.col("layers").cast("array<string>"), ","))


@query(
    "c9_split_weight_decay",
    NODES + """SELECT config_id, rank, path, CASE WHEN path = 'model/lm/weight' THEN 0::BIGINT ELSE 1::BIGINT END AS "group", 0::BIGINT AS "index"
    FROM flat WHERE path IN ('model/lm/weight', 'model/lm/a.bias')""",
)
def c9(spark, sf):
    split = structure.split_weight_decay(structure.model_keys(flat(spark, sf)))
    return split.select("config_id", "rank", "path", "group", "index")


@query(
    "c11_duplicate_keys",
    """SELECT l_orderkey AS config_id, l_linenumber::BIGINT AS rank, 'k/' || (l_suppkey % 5) AS path, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def c11(spark, sf):
    return structure.duplicate_keys(leaf_set(spark, sf, "l_suppkey"))


@query(
    "c11_keys_in_both",
    """SELECT DISTINCT l_orderkey AS config_id, l_linenumber::BIGINT AS rank, 'k/' || (l_suppkey % 5) AS path FROM lineitem
    INTERSECT SELECT l_orderkey, l_linenumber::BIGINT, 'k/' || (l_partkey % 5) FROM lineitem""",
)
def c11_both(spark, sf):
    return structure.duplicate_keys(leaf_set(spark, sf, "l_suppkey"), leaf_set(spark, sf, "l_partkey"))


def leaf_set(spark, sf, column):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("config_id"),
        F.col("l_linenumber").cast("bigint").alias("rank"),
        F.concat(F.lit("k/"), (F.col(column) % 5).cast("string")).alias("path"),
    )


# Typed texts from events: the type by event type, some texts that do not fit.
TYPED = """
WITH v AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'int' WHEN 'view' THEN 'float' WHEN 'error' THEN 'bool'
    WHEN 'signup' THEN 'str' ELSE CASE WHEN user_id % 2 = 0 THEN 'none' ELSE 'date' END END AS dtype,
  CASE event_type WHEN 'click' THEN CASE WHEN event_id % 9 = 0 THEN 'x' ELSE user_id::VARCHAR END WHEN 'view' THEN printf('%.2f', value)
    WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'False' END ELSE 's' || user_id END AS value FROM events)
"""


def typed_texts(spark, sf):
    kind = F.col("event_type")
    even = F.col("user_id") % 2 == 0
    user = F.col("user_id").cast("string")
    dtype = (
        F.when(kind == "click", "int").when(kind == "view", "float").when(kind == "error", "bool").when(kind == "signup", "str")
        .otherwise(F.when(even, "none").otherwise("date"))
    )
    text = (
        F.when(kind == "click", F.when(F.col("event_id") % 9 == 0, "x").otherwise(user))
        .when(kind == "view", F.format_string("%.2f", "value"))
        .when(kind == "error", F.when(even, "True").otherwise("False"))
        .otherwise(F.concat(F.lit("s"), user))
    )
    return table(spark, sf, "events").select("event_id", dtype.alias("dtype"), text.alias("value"))


@query(
    "c12_parse_values",
    TYPED + """SELECT event_id, dtype, CASE WHEN dtype = 'str' THEN value END AS str_value, CASE WHEN dtype = 'int' THEN try_cast(value AS BIGINT) END AS int_value,
      CASE WHEN dtype = 'float' THEN try_cast(value AS DOUBLE) END AS float_value, CASE WHEN dtype = 'bool' THEN value = 'True' END AS bool_value
    FROM v WHERE dtype <> 'date' AND NOT (dtype = 'int' AND value = 'x')""",
)
def c12(spark, sf):
    return structure.parse_values(typed_texts(spark, sf))[0].drop("value")


@query(
    "c12_value_violations",
    TYPED + """SELECT event_id, dtype, value, CASE WHEN dtype = 'date' THEN 'unknown type' ELSE 'value does not fit its type' END AS reason
    FROM v WHERE dtype = 'date' OR (dtype = 'int' AND value = 'x')""",
)
def c12_violations(spark, sf):
    return structure.parse_values(typed_texts(spark, sf))[1]


C13_SQL = """SELECT o_orderstatus AS snapshot, o_orderkey AS rank, 3::BIGINT AS model_rng, o_custkey + 1 AS rows, o_orderkey AS iteration,
      o_totalprice AS lr, o_orderkey % 2 = 0 AS "on", 1::BIGINT AS param, o_orderpriority AS name FROM orders"""


@query("c13_restore_state", C13_SQL)
def c13(spark, sf):
    return looked_at(structure.restore_state(*state_tables(spark, sf)))


@query("c13_write_json", C13_SQL)
def c13_files(spark, sf):
    """The same as a file for each rank, read back."""
    out = new_shared_path(spark, "json")
    store(structure.write_state_json(*state_tables(spark, sf), out), "json-files")
    place = r"/([^/]+)/(\d+)\.json$"
    name = F.col("file")
    texts = read_texts(spark, out, r"\.json$").select(
        F.regexp_extract(name, place, 1).alias("snapshot"), F.regexp_extract(name, place, 2).cast("bigint").alias("rank"), F.col("text").alias("json")
    )
    return looked_at(texts)


def looked_at(nested):
    """Some of the leaves, by their places in the JSON."""

    def at(path, kind):
        return F.get_json_object("json", path).cast(kind)

    return nested.select(
        "snapshot", "rank", at("$.model.rng.tensor[0]", "bigint").alias("model_rng"),
        at("$.model.lm.weight.tensor[0]", "bigint").alias("rows"), at("$.iteration", "bigint").alias("iteration"),
        at("$.groups[0].lr", "double").alias("lr"), at("$.groups[1].on", "boolean").alias("on"),
        at("$.groups[0].params[1]", "bigint").alias("param"), at("$.args.name", "string").alias("name"),
    )
