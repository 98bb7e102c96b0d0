"""Query catalogue: each operator as a query over the driver's tables, with its SQL oracle.

The driver's tables hold no gateway logs, so events stand in for messages (user_id is
the device, props the payload), digests of keys for binary payloads, orders with their
lineitems for nested records, and embeddings for feature vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterglass.functions import exprs as X
from meterglass.functions.phy import FIELDS, decode_base64
from meterglass.operators import features, flatten, forests, hbos, knn, lof, metrics, models, prep, registry, training, vectors
from meterglass.runtime import scratch, settled, table
from meterglass.sources import io, store
from meterglass.sources.io import MESSAGE
from meterglass.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DEVICE, KEY, NUMERIC = "user_id", "event_id", ["value", "k"]
POOLS = {"k": [-5.0, -7.0, 1.0, 5000.0, 2.0], "value": [10000.5, 0.0, 20000.5, -3.25]}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as messages, with gaps in both features."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = (table(spark, sf_dir, "events") if events is None else events).filter("user_id is not null")
    return rows.select("event_id", "user_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 13 != 0, k).alias("k"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.prepare(messages(spark, sf_dir), DEVICE, KEY, NUMERIC)


def digest(c: Column) -> Column:
    return F.upper(F.md5(c.cast("string")))


M = """m AS (
  SELECT event_id, user_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value,
         CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k
  FROM events WHERE user_id IS NOT NULL)"""
P = (
    M
    + """, p AS (
  SELECT event_id, user_id, coalesce(value, avg(value) OVER w) AS value, coalesce(k, avg(k) OVER w) AS k,
         CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 AS training
  FROM m WHERE user_id IN (SELECT user_id FROM m GROUP BY 1 HAVING count(*) >= 50)
  WINDOW w AS (PARTITION BY user_id))"""
)


def hbos_ctes(train: str, rows: str, names: tuple[str, ...] = ("k", "value")) -> str:
    """CTEs model_* and scores: histogram models of `train`, scores s(user_id, event_id, score) of `rows`."""
    unpivot = lambda t: " UNION ALL ".join(f"SELECT user_id, event_id, '{n}' AS feature, {n} AS x FROM {t}" for n in names)
    parts = " + ".join(f"sum(CASE WHEN feature = '{n}' THEN part ELSE 0 END)" for n in names)
    scored = lambda name, cells: f"""{name} AS (
  SELECT user_id, event_id, round({parts}, 6) AS score FROM (
    SELECT c.user_id, c.event_id, c.feature, -log2(0.1 + CASE WHEN x < lo - 1e-20 * width OR x > hi + 1e-20 * width THEN rarest
      ELSE coalesce(h.c, 0) / (n * width) END) AS part
    FROM {cells} c JOIN rare r USING (user_id, feature)
    LEFT JOIN hist h ON h.user_id = c.user_id AND h.feature = c.feature AND h.bin = greatest(0, least(CAST(floor((x - lo) / width) AS INT), bins - 1)))
  GROUP BY ALL)"""  # noqa: E731
    return f"""tc AS ({unpivot(train)}), rc AS ({unpivot(rows)}),
shape0 AS (SELECT user_id, feature, count(*) AS n, min(x) AS a, max(x) AS b, CAST(greatest(1, round(sqrt(count(*)))) AS INT) AS bins FROM tc GROUP BY ALL),
shape AS (SELECT *, (hi - lo) / bins AS width FROM (SELECT user_id, feature, n, bins, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM shape0)),
hist AS (SELECT tc.user_id, tc.feature, least(CAST(floor((x - lo) / width) AS INT), bins - 1) AS bin, count(*) AS c FROM tc JOIN shape USING (user_id, feature) GROUP BY ALL),
rare AS (SELECT s.*, CASE WHEN filled < bins THEN 0 ELSE least_c / (n * width) END AS rarest FROM shape s JOIN (SELECT user_id, feature, count(*) AS filled, min(c) AS least_c FROM hist GROUP BY ALL) USING (user_id, feature)),
{scored("ts", "tc")}, {scored("rs", "rc")},
limits AS (SELECT user_id, round(quantile_cont(score, CAST({1 - hbos.CONTAMINATION!r} AS DOUBLE)), 9) AS threshold FROM ts GROUP BY ALL)"""


# --- scans, filters, expressions -------------------------------------------------


@query("SELECT event_id, user_id, value FROM events WHERE event_type IS NOT NULL AND event_type <> '' AND user_id = 7")
def scan_project_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(X.known(F.col("event_type")) & (F.col("user_id") == 7)).select("event_id", "user_id", "value")


@query("""SELECT event_type, count(*) AS n FROM events WHERE starts_with(props, '{"k"') AND starts_with(event_type, 'c') GROUP BY 1""")
def prefix_route(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("props").startswith('{"k"') & F.col("event_type").startswith("c")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_linenumber % 4 = 1 AND l_partkey % 3 = 0 THEN 'FSK' WHEN l_partkey % 5 = 0 THEN ''
  ELSE 'SF' || (7 + l_partkey % 6) || 'BW' || (125 * (1 + l_suppkey % 4)) END AS datr FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN datr IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract(datr, 'SF(\d+)BW(\d+)', 1), '') AS BIGINT), -1) END AS sf,
  CASE WHEN datr IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract(datr, 'SF(\d+)BW(\d+)', 2), '') AS BIGINT), -1) END AS bw FROM t""")
def regex_groups(spark, sf_dir):
    built = F.concat(F.lit("SF"), (7 + F.col("l_partkey") % 6).cast("string"), F.lit("BW"), (125 * (1 + F.col("l_suppkey") % 4)).cast("string"))
    line = F.col("l_linenumber") % 4
    datr = F.when(line == 0, F.lit(None)).when((line == 1) & (F.col("l_partkey") % 3 == 0), "FSK").when(F.col("l_partkey") % 5 == 0, "").otherwise(built)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", datr.alias("datr"))
    sf, bw = X.data_rate(F.col("datr"))
    return rows.select("l_orderkey", "l_linenumber", sf.alias("sf"), bw.alias("bw"))


@query(r"""SELECT event_id, regexp_extract(CASE event_id % 4 WHEN 0 THEN 'hd' || '{"rxpk":[' || props || ']}' WHEN 1 THEN 'x{' || '{"stat":' || props || '}' || chr(10) || 'cut' WHEN 2 THEN 'none' ELSE '' END,
  '(\{"(?:rxpk|stat)".*)', 1) AS message FROM events""")
def regex_json_tail(spark, sf_dir):
    at = F.col("event_id") % 4
    raw = F.when(at == 0, F.concat(F.lit('hd{"rxpk":['), "props", F.lit("]}"))).when(at == 1, F.concat(F.lit('x{{"stat":'), "props", F.lit("}\ncut"))).when(at == 2, "none").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", X.json_tail(raw).alias("message"))


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity::INT || '/' || (l_partkey % 7) WHEN 2 THEN 'OFF' WHEN 3 THEN NULL WHEN 4 THEN '4/5/6' ELSE ' 3 / ' || l_linenumber END AS codr FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN codr IS NULL THEN NULL WHEN regexp_full_match(codr, '\s*[+-]?\d+\s*/\s*[+-]?\d+\s*')
  THEN coalesce(try_cast(trim(split_part(codr, '/', 1)) AS INT)::DOUBLE / nullif(try_cast(trim(split_part(codr, '/', 2)) AS INT)::DOUBLE, 0), -1.0) ELSE -1.0 END AS codr FROM t""")
def fraction_to_double(spark, sf_dir):
    line = F.col("l_linenumber")
    raw = F.when(line == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/"), (F.col("l_partkey") % 7).cast("string"))).when(line == 2, "OFF").when(line == 3, F.lit(None)).when(line == 4, "4/5/6").otherwise(F.concat(F.lit(" 3 / "), line.cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.fraction_to_double(raw).alias("codr"))


HEX_SQL = "CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'zz' WHEN 2 THEN substr(h, 1, 2) WHEN 3 THEN substr(h, 1, 8) WHEN 4 THEN substr(h, 1, 16) WHEN 5 THEN substr(h, 1, 30) WHEN 6 THEN h WHEN 7 THEN '0000' || substr(h, 1, 12) END"


@query(f"""WITH t AS (SELECT o_orderkey, {HEX_SQL} AS h FROM (SELECT o_orderkey, upper(md5(CAST(o_orderkey AS VARCHAR))) AS h FROM orders)),
v AS (SELECT o_orderkey, h, try_cast('0x' || h AS HUGEINT) AS n FROM t)
SELECT o_orderkey, CAST(CASE WHEN h IS NULL OR h = '' THEN NULL WHEN n IS NULL OR n > 99999999999999999999999999999999999999::HUGEINT THEN -1 ELSE n END AS DECIMAL(38, 0)) AS number FROM v""")
def hex_to_decimal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", digest(F.col("o_orderkey")).alias("h"))
    return rows.select("o_orderkey", X.hex_to_decimal(F.expr(HEX_SQL)).alias("number"))


@query("""SELECT o_orderkey, array_to_string(list_reverse(regexp_extract_all(substr(upper(md5(CAST(o_orderkey AS VARCHAR))), 1, CAST(o_orderkey % 33 AS INT)), '.{1,2}')), '') AS reversed FROM orders""")
def reverse_octets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", X.reverse_octets(F.substring(digest(F.col("o_orderkey")), F.lit(1), (F.col("o_orderkey") % 33).cast("int"))).alias("reversed"))


@query("SELECT doc_id, CAST(length(h) AS BIGINT) AS n_digits, md5(h) AS digest FROM (SELECT doc_id, hex(from_base64(to_base64(encode(text)))) AS h FROM documents)")
def base64_roundtrip(spark, sf_dir):
    h = X.base64_to_hex(F.base64(F.encode("text", "utf-8")))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("h")).select("doc_id", F.length("h").cast("long").alias("n_digits"), F.md5("h").alias("digest"))


FRAME_SQL = "CASE WHEN event_id % 5 = 0 THEN h || h || substr(h, 1, 6) ELSE substr(h, 1, CAST(2 * (event_id % 17) AS INT)) END"
_REV = lambda e: f"array_to_string(list_reverse(regexp_extract_all({e}, '.{{1,2}}')), '')"
PHY_SQL = f"""WITH t AS (SELECT event_id, {FRAME_SQL} AS h FROM (SELECT event_id, upper(md5(CAST(event_id AS VARCHAR))) AS h FROM events)),
u AS (SELECT event_id, nullif(h, '') AS h, length(h) AS n, length(h) >= 12 AS ok, substr(h, 1, greatest(length(h) - 8, 0)) AS b,
  CASE WHEN length(h) >= 12 THEN CAST('0x' || substr(h, 1, 2) AS INT) >> 5 END AS kind FROM t),
v AS (SELECT *, substr(b, 11, 2) AS fctrl, substr(h, 27, greatest(n - 34, 0)) AS rest FROM u),
w AS (SELECT *, CASE WHEN length(fctrl) = 2 THEN substr(b, 17, (CAST('0x' || fctrl AS INT) & 15) * 2) ELSE '' END AS fopts FROM v)
SELECT event_id,
  CASE WHEN kind = 0 THEN {_REV("substr(h, 3, 16)")} END AS "AppEUI", CASE WHEN kind = 1 THEN {_REV("substr(h, 3, 6)")} END AS "AppNonce",
  CASE WHEN kind = 1 THEN substr(rest, 1, greatest(length(rest) - 2, 0)) END AS "CFList", CASE WHEN kind = 1 THEN right(rest, 2) END AS "CFListType",
  CASE WHEN kind = 1 THEN substr(h, 23, 2) END AS "DLSettings",
  CASE WHEN kind = 1 THEN {_REV("substr(h, 15, 8)")} WHEN kind > 1 THEN {_REV("substr(b, 3, 8)")} END AS "DevAddr",
  CASE WHEN kind = 0 THEN {_REV("substr(h, 19, 16)")} END AS "DevEUI", CASE WHEN kind = 0 THEN {_REV("substr(h, 35, 4)")} END AS "DevNonce",
  CASE WHEN kind > 1 THEN {_REV("substr(b, 13, 4)")} END AS "FCnt", CASE WHEN kind > 1 THEN fctrl END AS "FCtrl", CASE WHEN kind > 1 THEN fopts END AS "FOpts",
  CASE WHEN kind > 1 THEN CASE WHEN length(fctrl) = 2 THEN substr(b, 17 + length(fopts), 2) ELSE '' END END AS "FPort",
  CASE WHEN ok THEN substr(h, 1, 2) END AS "MHDR", CASE WHEN ok THEN right(h, 8) END AS "MIC",
  CASE WHEN n > 0 THEN CAST(n AS BIGINT) END AS "PHYPayloadLen", CASE WHEN kind = 1 THEN substr(h, 25, 2) END AS "RxDelay" FROM w"""


@query(PHY_SQL)
def phy_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", digest(F.col("event_id")).alias("h"))
    rows = rows.select("event_id", F.base64(F.unhex(F.expr(FRAME_SQL))).alias("data"))
    return rows.select("event_id", decode_base64(F.col("data")).alias("p")).select("event_id", *(F.col(f"p.{n}") for n in FIELDS))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE upper(md5(CAST(event_id AS VARCHAR))) END AS c FROM events)
SELECT event_id, CASE WHEN c <> '' THEN substr(c, 1, length(c) - 2) END AS cflist, CASE WHEN c <> '' THEN right(c, 2) END AS cflist_type FROM t""")
def cflist_split(spark, sf_dir):
    at = F.col("event_id") % 5
    rest, last = X.cflist_split(F.when(at == 0, F.lit(None)).when(at == 1, "").otherwise(digest(F.col("event_id"))))
    return table(spark, sf_dir, "events").select("event_id", rest.alias("cflist"), last.alias("cflist_type"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity > 25 AS INT) END AS large, CAST(l_returnflag = 'R' AS INT) AS returned FROM lineitem")
def bool_to_int(spark, sf_dir):
    large = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") > 25)
    return flatten.booleans_to_int(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", large.alias("large"), (F.col("l_returnflag") == "R").alias("returned")))


MESSAGE_SQL = """CASE WHEN event_id % 10 = 0 THEN '{"rxpk":[{' WHEN event_id % 7 = 0 THEN '{"rxpk":[]}'
  ELSE concat('{"rxpk":[{"chan":', CAST(event_id % 8 AS STRING), ',"datr":"SF', CAST(7 + event_id % 6 AS STRING), 'BW125"},{"chan":', CAST(event_id % 3 AS STRING), '}]}') END"""


@query(f"""WITH t AS (SELECT event_id, {MESSAGE_SQL} AS message FROM events),
u AS (SELECT event_id, unnest(CAST(json_extract(message, '$.rxpk') AS JSON[])) AS j FROM t WHERE json_valid(message))
SELECT event_id, CAST(json_extract_string(j, '$.chan') AS BIGINT) AS chan, json_extract_string(j, '$.datr') AS datr FROM u""")
def json_parse_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(F.expr(MESSAGE_SQL), MESSAGE)["rxpk"].alias("rxpk"))
    return rows.select("event_id", F.inline("rxpk")).select("event_id", "chan", "datr")


@query("SELECT o_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def nested_prune_explode(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")).alias("items"))
    nested = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    pruned = F.transform("items", lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_quantity"].alias("l_quantity"), (x["l_extendedprice"] * (1 - x["l_discount"])).alias("net")))
    return nested.select("o_orderkey", F.inline(pruned))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey % 4 END AS a, l_suppkey % 4 AS b, CAST(l_linenumber AS BIGINT) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(a, b) AS chan, CASE WHEN a IS NULL THEN CASE WHEN c <> b THEN c END WHEN b <> a THEN b WHEN c <> a THEN c END AS chan2 FROM t""")
def array_union_pick(spark, sf_dir):
    own = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 4)
    others = F.transform(F.array(F.struct((F.col("l_suppkey") % 4).alias("chan")), F.struct(F.lit(None).cast("long").alias("chan")), F.struct(F.col("l_linenumber").cast("long").alias("chan"))), lambda s: s["chan"])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.distinct_values(own, others).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", X.pick(F.col("v"), 0).alias("chan"), X.pick(F.col("v"), 1).alias("chan2"))


@query("SELECT c_custkey, c_name, o_orderkey AS tmst, o_totalprice AS freq FROM customer JOIN orders ON c_custkey = o_custkey")
def downlink_flatten(spark, sf_dir):
    sent = F.struct(F.col("o_orderkey").alias("tmst"), F.col("o_totalprice").alias("freq"), F.col("o_orderstatus").alias("modu"), F.col("o_orderpriority").alias("data"))
    nested = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", sent.alias("txpk"))
    return flatten.flatten_downlink(nested)


# --- devices and preparation -----------------------------------------------------


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def device_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy("user_id")


@query("SELECT user_id AS device FROM events UNION SELECT c_custkey FROM customer")
def device_universe(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("device")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query(f"WITH {M} SELECT count(event_id) AS event_id, count(user_id) AS user_id, count(value) AS value, count(k) AS k FROM m")
def null_census(spark, sf_dir):
    return prep.null_census(messages(spark, sf_dir), ["event_id", "user_id", "value", "k"])


@query(f"WITH {M} SELECT event_id, user_id, round(coalesce(value, avg(value) OVER w), 9) AS value, round(coalesce(k, avg(k) OVER w), 9) AS k FROM m WINDOW w AS (PARTITION BY user_id)")
def mean_impute(spark, sf_dir):
    out = prep.mean_impute(messages(spark, sf_dir), DEVICE, NUMERIC)
    return out.select("event_id", "user_id", F.round("value", 9).alias("value"), F.round("k", 9).alias("k"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 50)")
def size_gate(spark, sf_dir):
    return prep.size_gate(table(spark, sf_dir, "events").select("event_id", "user_id"), DEVICE)


@query("SELECT event_id, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 AS training FROM events")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", prep.in_train(F.col("event_id")).alias("training"))


@query("SELECT event_id, 1 AS sides FROM events")
def random_split(spark, sf_dir):
    """Each row is on one side of the split, whichever that is."""
    train, test = prep.random_split(table(spark, sf_dir, "events").select("event_id"))
    return train.union(test).groupBy("event_id").agg(F.count("*").cast("int").alias("sides"))


GAPS_SQL = "SELECT event_id, user_id, CASE WHEN user_id % 3 <> 0 THEN value END AS value, CASE WHEN user_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events WHERE user_id IS NOT NULL"


@query(f"SELECT user_id, list_filter([CASE WHEN count(k) > 0 THEN 'k' END, CASE WHEN count(value) > 0 THEN 'value' END], lambda x: x IS NOT NULL) AS features FROM ({GAPS_SQL}) GROUP BY 1")
def device_features(spark, sf_dir):
    rows = messages(spark, sf_dir)
    gone = rows.withColumns({"value": F.when(F.col("user_id") % 3 != 0, F.col("value")), "k": F.when(F.col("user_id") % 5 != 0, F.col("k"))})
    return features.fit_transforms(gone, DEVICE, NUMERIC).select("user_id", "features")


_list = lambda v: "[" + ", ".join(f"{x!r}::DOUBLE" for x in v) + "]"
ATTACK = f"""train AS (SELECT event_id, user_id, value, k FROM p WHERE training),
seen AS (SELECT user_id, list(DISTINCT value) AS sv, list(DISTINCT k) AS sk FROM train GROUP BY 1),
r AS (SELECT event_id, user_id, value, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM p WHERE NOT training),
f AS (SELECT r.*, list_filter({_list(POOLS["k"])}, lambda x: NOT list_contains(sk, x)) AS fk, list_filter({_list(POOLS["value"])}, lambda x: NOT list_contains(sv, x)) AS fv,
  i < greatest(1, least(CAST(round_even(n * 0.2, 0) AS INT), 30)) AS hit FROM r JOIN seen USING (user_id)),
g AS (SELECT *, CASE WHEN len(fk) + len(fv) > 0 THEN fk ELSE {_list(POOLS["k"])} END AS uk, CASE WHEN len(fk) + len(fv) > 0 THEN fv ELSE {_list(POOLS["value"])} END AS uv FROM f),
h AS (SELECT *, CASE WHEN len(uk) = 0 THEN 'value' WHEN len(uv) = 0 OR i % 2 = 0 THEN 'k' ELSE 'value' END AS name FROM g),
attacked AS (SELECT event_id, user_id, CASE WHEN hit AND name = 'value' THEN uv[1 + i % len(uv)] ELSE value END AS value, CASE WHEN hit AND name = 'k' THEN uk[1 + i % len(uk)] ELSE k END AS k,
  CASE WHEN hit THEN 1 ELSE 0 END AS intrusion FROM h)"""


@query(f"WITH {P}, {ATTACK} SELECT event_id, user_id, round(value, 9) AS value, round(k, 9) AS k, intrusion FROM attacked")
def attack_inject(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    out = prep.attack_inject(rows.filter("training"), rows.filter("not training"), DEVICE, KEY, POOLS)
    return out.select("event_id", "user_id", F.round("value", 9).alias("value"), F.round("k", 9).alias("k"), "intrusion")


@query(f"""WITH {P}, least AS (SELECT user_id, min(k) AS reset FROM p WHERE training GROUP BY 1),
r AS (SELECT event_id, user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM p WHERE NOT training)
SELECT event_id, user_id, round(CASE WHEN i < greatest(1, least(CAST(round_even(n * 0.2, 0) AS INT), 30)) THEN reset ELSE k END, 9) AS k FROM r JOIN least USING (user_id)""")
def counter_reset(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    out = prep.attack_inject(rows.filter("training"), rows.filter("not training"), DEVICE, KEY, {}, ("k",))
    return out.select("event_id", "user_id", F.round("k", 9).alias("k"))


@query("SELECT l_suppkey, l_linenumber FROM lineitem EXCEPT ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 25")
def multiset_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return prep.rows_difference(rows.select("l_suppkey", "l_linenumber"), rows.filter("l_quantity > 25").select("l_suppkey", "l_linenumber"))


@query("SELECT user_id AS device, event_type, NULL::DOUBLE AS total FROM events UNION ALL BY NAME SELECT o_custkey AS device, o_totalprice AS total FROM orders")
def union_by_name_missing(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), "event_type")
    return prep.union_missing(a, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device"), F.col("o_totalprice").alias("total")))


# --- features --------------------------------------------------------------------


@query(f"""WITH {P} SELECT event_id, user_id, round(CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END, 6) + 0.0 AS value,
  round(CASE WHEN stddev_samp(k) OVER w > 0 THEN (k - avg(k) OVER w) / stddev_samp(k) OVER w ELSE 0 END, 6) + 0.0 AS k FROM p WINDOW w AS (PARTITION BY user_id)""")
def standard_scale(spark, sf_dir):
    out = features.standard_scale(prepared(spark, sf_dir).drop("training"), DEVICE, NUMERIC)
    # adding zero makes -0.0 a plain zero
    return out.select("event_id", "user_id", (F.round("value", 6) + 0.0).alias("value"), (F.round("k", 6) + 0.0).alias("k"))


@query(f"WITH {M} SELECT event_id, [k, value] AS features FROM m WHERE k IS NOT NULL AND value IS NOT NULL")
def vector_assemble(spark, sf_dir):
    return features.assemble(messages(spark, sf_dir).na.drop(subset=NUMERIC), NUMERIC).select("event_id", "features")


@query("""WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.x * b.x), 4) AS g FROM t a JOIN t b USING (vec_id) GROUP BY ALL""")
def gramian(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return features.gramian(rows, "embedding").select("i", "j", F.round("g", 4).alias("g"))


def _energy(spark, sf_dir, centred):
    """Squared length of each vector in all directions of the reduced space: a rotation keeps it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    out = features.project(rows, "embedding", *features.reduction(rows, "embedding", centred, share=2.0))
    return out.select("vec_id", F.round(F.aggregate("projected", F.lit(0.0), lambda t, x: t + x * x), 4).alias("energy"))


_ENERGY = "WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT i, avg(x) AS m FROM t GROUP BY 1)"


@query(f"{_ENERGY} SELECT vec_id, round(sum((x - m) * (x - m)), 4) AS energy FROM t JOIN c USING (i) GROUP BY 1")
def pca_project(spark, sf_dir):
    return _energy(spark, sf_dir, True)


@query(f"{_ENERGY} SELECT vec_id, round(sum(x * x), 4) AS energy FROM t GROUP BY 1")
def svd_project(spark, sf_dir):
    return _energy(spark, sf_dir, False)


_POWERS = """, gm AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS g FROM t a JOIN t b USING (vec_id) GROUP BY ALL), g2 AS (SELECT a.i AS i, b.j AS j, sum(a.g * b.g) AS g FROM gm a JOIN gm b ON a.j = b.i GROUP BY ALL)
SELECT 1 AS power, sum(g) AS total FROM gm WHERE i = j UNION ALL SELECT 2, sum(g * g) FROM gm UNION ALL SELECT 3, sum(a.g * b.g) FROM gm a JOIN g2 b ON a.i = b.j AND a.j = b.i"""
_SCALED = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE * CASE WHEN generate_subscripts(embedding, 1) = 1 THEN 1e-6 ELSE 1 END AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def _components(spark, sf_dir, centred):
    """Sums of powers of the energies of all components. Energies are those of the eigenvectors if these sums are the traces of the
    Gramian's powers; of any other orthonormal directions the sums of squares and cubes are smaller."""
    x = F.transform("embedding", lambda x, i: x.cast("double") * F.when(i == 0, 1e-6).otherwise(1.0))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("embedding"))
    out = features.project(rows, "embedding", *features.reduction(rows, "embedding", centred, share=2.0))
    energy = out.select(F.posexplode("projected").alias("i", "z")).groupBy("i").agg(F.sum(F.col("z") * F.col("z")).alias("e"))
    total = energy.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("power"), "e").groupBy("power").agg(F.sum(F.pow("e", F.col("power"))).alias("total"))
    return total.select("power", F.round(F.log("total"), 6).alias("log_total"))


@query(f"WITH {_SCALED}, c AS (SELECT i, avg(x) AS m FROM v GROUP BY 1), t AS (SELECT vec_id, i, x - m AS x FROM v JOIN c USING (i)), s AS (SELECT * FROM ({('WITH z AS (SELECT 1)' + _POWERS).replace('WITH z AS (SELECT 1), gm', 'WITH gm')})) SELECT power, round(ln(total), 6) AS log_total FROM s")
def pca_components(spark, sf_dir):
    return _components(spark, sf_dir, True)


@query(f"WITH {_SCALED}, t AS (SELECT * FROM v), s AS (SELECT * FROM ({('WITH z AS (SELECT 1)' + _POWERS).replace('WITH z AS (SELECT 1), gm', 'WITH gm')})) SELECT power, round(ln(total), 6) AS log_total FROM s")
def svd_components(spark, sf_dir):
    return _components(spark, sf_dir, False)


def _two_directions(a: str, b: str, c: str) -> str:
    """Projection of (k, value) on the directions of the matrix [[a, b], [b, c]] by device, in closed form."""
    return f"""WITH {P}, g AS (SELECT user_id, {a} AS a, {b} AS b, {c} AS c FROM p GROUP BY 1),
l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM g),
v AS (SELECT user_id, l1 >= 0.99 * (l1 + l2) AS one, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS x1, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS y1 FROM l),
s AS (SELECT user_id, one, x1 * sign(CASE WHEN abs(x1) >= abs(y1) THEN x1 ELSE y1 END) AS x, y1 * sign(CASE WHEN abs(x1) >= abs(y1) THEN x1 ELSE y1 END) AS y FROM v),
t AS (SELECT *, CASE WHEN abs(x) > abs(y) THEN sign(x) ELSE -sign(y) END AS side FROM s)
SELECT user_id, event_id, round(k * x + value * y, 5) + 0.0 AS z0, CASE WHEN NOT one THEN round(side * (value * x - k * y), 5) + 0.0 END AS z1 FROM p JOIN t USING (user_id)"""


def _by_device(spark, sf_dir, reduction):
    rows = prepared(spark, sf_dir)
    out, names = features.apply_transforms(rows, features.fit_transforms(rows, DEVICE, NUMERIC, False, reduction), DEVICE, NUMERIC)
    return out.select("user_id", "event_id", *((F.round(n, 5) + 0.0).alias(f"z{i}") for i, n in enumerate(names)))


@query(_two_directions("var_samp(k)", "covar_samp(k, value)", "var_samp(value)"))
def device_pca(spark, sf_dir):
    return _by_device(spark, sf_dir, "PCA")


@query(_two_directions("sum(k * k)", "sum(k * value)", "sum(value * value)"))
def device_svd(spark, sf_dir):
    return _by_device(spark, sf_dir, "SVD")


@query("""WITH t AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), v AS (SELECT i, round(var_samp(x), 9) AS s FROM t GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY s DESC, i) AS r, sum(s) OVER (ORDER BY s DESC, i) AS cum, sum(s) OVER () AS whole FROM v)
SELECT CAST(coalesce(min(CASE WHEN cum >= 0.99 * whole THEN r END), max(r)) AS INT) AS k FROM c""")
def explained_variance_k(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    return features.explained_k(cells.groupBy("i").agg(F.round(F.var_samp(F.col("x").cast("double")), 9).alias("s")), "i", "s")


# --- detectors -------------------------------------------------------------------


@query(f"WITH {P}, {hbos_ctes('p', 'p')} SELECT r.user_id, r.feature, CAST(n AS BIGINT) AS n, bins, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(bin AS INT) AS bin, round(c / (n * width), 6) AS density FROM rare r JOIN hist USING (user_id, feature)")
def hbos_histogram(spark, sf_dir):
    model = hbos.fit(prepared(spark, sf_dir), DEVICE, KEY, NUMERIC)
    cells = model.select("user_id", "feature", "n", "bins", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.posexplode("density").alias("bin", "d"))
    return cells.filter("d > 0").select("user_id", "feature", "n", "bins", "lo", "hi", "bin", F.round("d", 6).alias("density"))


@query(f"WITH {P}, {hbos_ctes('p', 'p')} SELECT event_id, user_id, score, threshold, CAST(score > threshold AS INT) AS prediction FROM rs JOIN limits USING (user_id)")
def hbos_scores(spark, sf_dir):
    return hbos.train_and_label(prepared(spark, sf_dir), DEVICE, KEY, NUMERIC)


@query(f"WITH {P}, {hbos_ctes('p', 'p')} SELECT user_id, threshold FROM limits")
def hbos_threshold(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return hbos.thresholds(hbos.score(rows, hbos.fit(rows, DEVICE, KEY, NUMERIC), DEVICE, KEY, NUMERIC), DEVICE)


@query(f"""WITH {P}, {ATTACK}, {hbos_ctes('train', 'attacked')}, e AS (SELECT intrusion, CAST(score > threshold AS INT) AS prediction FROM attacked JOIN rs USING (user_id, event_id) JOIN limits USING (user_id))
SELECT count_if(intrusion = 1 AND prediction = 1) AS tp, count_if(intrusion = 0 AND prediction = 0) AS tn, count_if(intrusion = 0 AND prediction = 1) AS fp, count_if(intrusion = 1 AND prediction = 0) AS fn FROM e""")
def hbos_eval(spark, sf_dir):
    return metrics.confusion(training.evaluate(messages(spark, sf_dir), "hbos", DEVICE, KEY, NUMERIC, POOLS), "intrusion", "prediction")


LOF_SQL = f"""WITH {P}, t AS (SELECT * FROM p WHERE training), s AS (SELECT * FROM p WHERE NOT training),
sz AS (SELECT user_id, greatest(5, least(CAST(round_even(count(*) * 0.01, 0) AS INT), 15)) AS kk FROM t GROUP BY 1),
pa AS (SELECT a.user_id, a.event_id, b.event_id AS near, round(sqrt((a.k - b.k) * (a.k - b.k) + (a.value - b.value) * (a.value - b.value)), 9) AS d FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_id <> b.event_id),
own AS (SELECT user_id, event_id, near, d FROM (SELECT pa.*, kk, row_number() OVER (PARTITION BY user_id, event_id ORDER BY d, near) AS r FROM pa JOIN sz USING (user_id)) WHERE r <= kk),
reach AS (SELECT user_id, event_id AS near, max(d) AS kd FROM own GROUP BY ALL),
dens AS (SELECT user_id, event_id AS near, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM own JOIN reach USING (user_id, near) GROUP BY ALL),
pb AS (SELECT a.user_id, a.event_id, b.event_id AS near, round(sqrt((a.k - b.k) * (a.k - b.k) + (a.value - b.value) * (a.value - b.value)), 9) AS d FROM s a JOIN t b ON a.user_id = b.user_id),
found AS (SELECT user_id, event_id, near, d FROM (SELECT pb.*, kk, row_number() OVER (PARTITION BY user_id, event_id ORDER BY d, near) AS r FROM pb JOIN sz USING (user_id)) WHERE r <= kk),
o AS (SELECT user_id, event_id, round(avg(lrd) / (1 / (avg(greatest(d, kd)) + 1e-10)), 6) AS lof FROM found JOIN reach USING (user_id, near) JOIN dens USING (user_id, near) GROUP BY ALL)
SELECT user_id, event_id, lof, CAST(lof > 1.5 AS INT) AS prediction FROM o"""


@query(LOF_SQL)
def lof_scores(spark, sf_dir):
    rows = settled(prepared(spark, sf_dir), "rows")
    return lof.lof(rows.filter("training"), rows.filter("not training"), DEVICE, KEY, NUMERIC)


def forest_sql(trees: str, sample: str, cut: str) -> str:
    """A forest grown level by level in SQL from the same draws, on training rows; scores of all rows. Samples are whole here (devices of up to 256 rows)."""
    draw = f"list_reduce([CAST({forests.SEED} AS UBIGINT), tree::UBIGINT, node::UBIGINT, what::UBIGINT], lambda h, p: list_reduce([{', '.join(f'{c}::UBIGINT' for c in forests.MIXERS)}], lambda a, c: (xor(a, a >> 15) * c) % 4294967296::UBIGINT, (h + p) % 4294967296::UBIGINT), {forests.START}::UBIGINT)"
    path = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + {float(np.euler_gamma)!r}::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"
    most = 11
    ctes = [
        f"sz AS MATERIALIZED (SELECT user_id, n, {trees} AS trees, {sample} AS sample, CAST(ceil(log2(greatest(2, {sample}))) AS INT) AS lim FROM (SELECT user_id, count(*) AS n FROM p WHERE training GROUP BY 1))",
        f"rnd AS MATERIALIZED (SELECT tree, node, (xor(h0, h0 >> 16) + 1)::DOUBLE / 4294967296 AS u0, (xor(h1, h1 >> 16) + 1)::DOUBLE / 4294967296 AS u1, (xor(h2, h2 >> 16) + 1)::DOUBLE / 4294967296 AS u2 FROM (SELECT tree, node, {', '.join(draw.replace('what::', f'{i}::') + f' AS h{i}' for i in range(3))} FROM range((SELECT max(trees) FROM sz)) a(tree), range(1, 1 << (SELECT max(lim) FROM sz)) b(node)))",
        "t0 AS MATERIALIZED (SELECT p.user_id, event_id, k, value, training, 1 AS node, unnest(range(trees)) AS tree FROM p JOIN sz USING (user_id))",
    ]
    for d in range(most + 1):
        ctes += [
            f"""n{d} AS MATERIALIZED (SELECT *, n <= 1 OR (a0 = b0 AND a1 = b1) OR lim = {d} AS leaf, a0 < b0 AND (a1 = b1 OR u1 >= u2) AS by_k FROM (SELECT user_id, tree, node, count(*) FILTER (training) AS n, min(k) FILTER (training) AS a0, max(k) FILTER (training) AS b0, min(value) FILTER (training) AS a1, max(value) FILTER (training) AS b1 FROM t{d} GROUP BY ALL) JOIN (SELECT user_id, lim FROM sz) USING (user_id) LEFT JOIN rnd USING (tree, node))""",
            f"v{d} AS (SELECT t.user_id, t.event_id, {d} + {path('n.n')} AS depth FROM t{d} t JOIN n{d} n USING (user_id, tree, node) WHERE leaf)",
            f"t{d + 1} AS MATERIALIZED (SELECT t.user_id, event_id, k, value, training, node * 2 + CASE WHEN (CASE WHEN by_k THEN k >= a0 + (b0 - a0) * u0 ELSE value >= a1 + (b1 - a1) * u0 END) THEN 1 ELSE 0 END AS node, tree FROM t{d} t JOIN n{d} n USING (user_id, tree, node) WHERE NOT leaf)",
        ]
    ctes.append(f"depths AS (SELECT user_id, event_id, sum(depth) AS total FROM ({' UNION ALL '.join(f'SELECT * FROM v{d}' for d in range(most + 1))}) GROUP BY ALL)")
    ctes.append(f"scored AS (SELECT user_id, event_id, training, round(pow(2, -(total / trees) / ({path('sample')})), 6) AS score FROM depths JOIN sz USING (user_id) JOIN (SELECT user_id, event_id, training FROM p) USING (user_id, event_id))")
    return f"WITH {P}, {', '.join(ctes)}, cuts AS (SELECT user_id, {cut} AS cut FROM scored WHERE training GROUP BY 1) SELECT user_id, event_id, score, CAST(score > cut AS INT) AS prediction FROM scored JOIN cuts USING (user_id)"


def _fitted_and_scored(spark, sf_dir, algorithm):
    """Models of the training rows of each device score all of its rows."""
    rows = settled(prepared(spark, sf_dir), "rows")
    fitted = settled(models.fit(rows.filter("training"), algorithm, DEVICE, KEY, NUMERIC), "fitted")
    return rows, fitted, models.score(rows, fitted, algorithm, DEVICE, KEY, NUMERIC)


def _learned_scores(spark, sf_dir, algorithm):
    """The same, of models that nothing else needs."""
    rows = settled(prepared(spark, sf_dir), "rows")
    return models.learned_scores(rows.filter("training"), rows.filter("not training"), algorithm, DEVICE, KEY, NUMERIC, True)


@query(forest_sql("least(100 + round_even(n / 5, 0), 7000)::INT", "least(n, 256)", "0.5"))
def iforest_a(spark, sf_dir):
    return _learned_scores(spark, sf_dir, "if_sklearn")


@query(forest_sql("least(100 + n // 3, 3000)::INT", "n", "round(quantile_cont(score, 0.82::DOUBLE), 9)"))
def iforest_b(spark, sf_dir):
    return _learned_scores(spark, sf_dir, "if_custom")


@query(f"""WITH {P}, x AS (SELECT user_id, unnest([k, value]) AS x FROM p WHERE training), g AS (SELECT user_id, var_pop(x) AS v FROM x GROUP BY 1)
SELECT user_id, count(*) AS n, round(any_value(1 / (2 * v)), 6) AS gamma, true AS feasible, true AS optimal, true AS outliers_bounded, count(*) AS agreed FROM p JOIN g USING (user_id) WHERE training GROUP BY 1""")
def ocsvm(spark, sf_dir):
    """Certificates of optimality: from stored support vectors alone every training row's kernel sum is worked out anew by joins, and with them
    the conditions that hold for the solution of the dual and for nothing else: weights sum to 1 within their bounds (feasible), and no row's
    gradient violates them by more than 1e-6 (optimal). agreed: rows whose score is what these sums and rho give."""
    rows, fitted, found = _fitted_and_scored(spark, sf_dir, "ocsvm")
    rows = rows.filter("training")
    meta = F.from_json("params", models.META)
    cells = F.arrays_zip(F.element_at("arrays", "key").alias("key"), F.element_at("arrays", "a").alias("a"))
    support = fitted.select("user_id", meta.alias("m"), F.posexplode(cells).alias("i", "c"), F.element_at("arrays", "v").alias("v"))
    support = support.select("user_id", "m.gamma", "m.rho", F.col("c.key").cast("long").alias("event_id"), F.col("c.a").alias("a"), F.get("v", 2 * F.col("i")).alias("sk"), F.get("v", 2 * F.col("i") + 1).alias("sv"))
    near = F.exp(-F.col("gamma") * ((F.col("k") - F.col("sk")) ** 2 + (F.col("value") - F.col("sv")) ** 2))
    g = rows.join(support.drop("event_id"), "user_id").groupBy("user_id", "event_id").agg(F.sum(F.col("a") * near).alias("g"), F.first("gamma").alias("gamma"), F.first("rho").alias("rho"))
    each = g.join(support.select("user_id", "event_id", "a"), ["user_id", "event_id"], "left").na.fill(0.0, ["a"]).join(found, ["user_id", "event_id"])
    n, a = F.count("*"), F.col("a")
    each = each.join(rows.groupBy("user_id").agg((3 / n).alias("most")), "user_id")
    up, down = F.min(F.when(a < F.col("most") * (1 - 1e-9), F.col("g"))), F.max(F.when(a > 0, F.col("g")))
    out = each.groupBy("user_id").agg(
        n.alias("n"), F.round(F.first("gamma"), 6).alias("gamma"), (F.abs(F.sum("a") - 1) < 1e-9).alias("sums"), (F.max(a / F.col("most")) < 1 + 1e-9).alias("bounds"), (F.min("a") >= 0).alias("above"),
        ((down - up) * n / 3 < 1e-6).alias("optimal"), (F.count_if(F.col("score") > 1e-9) <= n / 3).alias("outliers_bounded"), F.count_if(F.abs(F.col("rho") - F.col("g") - F.col("score")) < 1e-8).alias("agreed"),
    )
    return out.select("user_id", "n", "gamma", (F.col("sums") & F.col("bounds") & F.col("above")).alias("feasible"), "optimal", "outliers_bounded", "agreed")


GAPPED = LOF_SQL.replace("t AS (SELECT * FROM p WHERE training), s AS (SELECT * FROM p WHERE NOT training)", "q AS (SELECT event_id, user_id, value, training, CASE WHEN user_id % 5 <> 0 THEN k END AS k FROM p), t AS (SELECT * FROM q WHERE training), s AS (SELECT * FROM q WHERE NOT training)").replace("(a.k - b.k) * (a.k - b.k)", "coalesce((a.k - b.k) * (a.k - b.k), 0)")


def _gapped(spark, sf_dir):
    return prepared(spark, sf_dir).withColumn("k", F.when(F.col("user_id") % 5 != 0, F.col("k")))


@query(f"SELECT user_id, event_id, round(ln(lof), 6) AS log_lof, prediction FROM ({GAPPED})")
def lof_gaps(spark, sf_dir):
    """A feature that some devices never have takes no part in their models, and costs no device."""
    rows = settled(_gapped(spark, sf_dir), "rows")
    out = lof.lof(rows.filter("training"), rows.filter("not training"), DEVICE, KEY, NUMERIC)
    return out.select("user_id", "event_id", F.round(F.log("lof"), 6).alias("log_lof"), "prediction")


@query(f"WITH {P} SELECT algorithm, user_id, count(*) AS n FROM p, (SELECT unnest({list(models.ALGORITHMS)}) AS algorithm) WHERE NOT training GROUP BY ALL")
def detectors_keep_devices(spark, sf_dir):
    """All five algorithms judge the same rows of the same devices, some of which lack a feature."""
    rows = settled(_gapped(spark, sf_dir), "rows")
    train, test = rows.filter("training"), rows.filter("not training")
    judged = lambda a: models.learned_scores(train, test, a, DEVICE, KEY, NUMERIC).filter("prediction is not null")
    return reduce(DataFrame.unionByName, (judged(a).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("algorithm", F.lit(a)) for a in models.ALGORITHMS))


@query(f"""WITH {P}, t AS (SELECT user_id, count(*) AS n FROM p WHERE training GROUP BY 1)
SELECT user_id, count(*) AS rows, any_value(CASE WHEN n <= 32 THEN 1 ELSE 0 END) = 1 AS one_cell, true AS fewer FROM p JOIN t USING (user_id) WHERE NOT training GROUP BY 1""")
def lof_cells(spark, sf_dir):
    """How many cells rows are compared with, where cells are small enough for these devices to have several."""
    rows = prepared(spark, sf_dir)
    of = vectors.usable(rows.filter("training"), DEVICE, NUMERIC)
    vector = lambda x: vectors.vectors(x, of, DEVICE, KEY, NUMERIC)
    train, test = vector(rows.filter("training")), vector(rows.filter("not training")).withColumn("own", F.lit(False))
    k = train.groupBy("user_id").agg(lof.k_of(F.count("*")).alias("_k"))
    seen = knn.Search(train, DEVICE, KEY, cell_rows=16).census(test, k)
    return seen.select("user_id", "rows", (F.col("cells") == 1).alias("one_cell"), (F.col("compared") <= F.col("cells")).alias("fewer"))


@query(LOF_SQL)
def lof_stored(spark, sf_dir):
    """The model that LOF training stores scores as the rows themselves do."""
    rows = settled(prepared(spark, sf_dir), "rows")
    kept = settled(training.stored(training.fit(rows.filter("training"), "lof", DEVICE, KEY, NUMERIC), DEVICE, "rxpk", "lof"), "stored")
    out = training.predict(rows.filter("not training"), training.loaded(kept, DEVICE, "long"), "lof", DEVICE, KEY, NUMERIC)
    return out.select("user_id", "event_id", F.col("score").alias("lof"), "prediction")


CONFUSION = "c AS (SELECT count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality = 0 AND toxic = 0) AS tn, count_if(quality = 0 AND toxic = 1) AS fp, count_if(quality = 1 AND toxic = 0) AS fn FROM labels)"


@query(f"WITH {CONFUSION} SELECT * FROM c")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"""WITH {CONFUSION}, a AS (SELECT CASE WHEN tp + tn + fp + fn = 0 THEN 0 ELSE (tp + tn)::DOUBLE / (tp + tn + fp + fn) END AS accuracy, unnest([
  {{'class': '0', 'hit': tn, 'said': tn + fn, 'support': tn + fp}}, {{'class': '1', 'hit': tp, 'said': tp + fp, 'support': tp + fn}}]) AS s FROM c),
b AS (SELECT accuracy, s.class AS class, CASE WHEN s.said = 0 THEN 0 ELSE s.hit::DOUBLE / s.said END AS precision, CASE WHEN s.support = 0 THEN 0 ELSE s.hit::DOUBLE / s.support END AS recall, s.support AS support FROM a),
e AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM b),
u AS (SELECT accuracy, class, precision, recall, f1, support FROM e
UNION ALL SELECT accuracy, 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM e GROUP BY accuracy
UNION ALL SELECT accuracy, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e GROUP BY accuracy)
SELECT class, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def class_report(spark, sf_dir):
    out = metrics.class_report(metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"))
    return out.select("class", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")), "support")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def registry_latest(spark, sf_dir):
    return registry.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(f"WITH {P}, {hbos_ctes('p', 'p')} SELECT event_id, user_id, score, CAST(score > threshold AS INT) AS prediction FROM rs JOIN limits USING (user_id)")
def registry_models(spark, sf_dir):
    """Models of all devices are fitted, stored, replaced by a later version, loaded and used."""
    rows = settled(prepared(spark, sf_dir), "rows")
    known = registry.Registry(spark, scratch(spark, "models"))
    for version, train in ((1, rows.filter("training")), (2, rows)):
        known.store(training.stored(training.fit(train, "hbos", DEVICE, KEY, NUMERIC), DEVICE, "rxpk", "hbos"), version)
    fitted = training.loaded(known.latest("rxpk", "hbos"), DEVICE, "long")
    return training.predict(rows, fitted, "hbos", DEVICE, KEY, NUMERIC)


@query(f"""WITH {P}, {ATTACK}, {hbos_ctes('train', 'attacked')}, e AS (SELECT user_id, intrusion, CAST(score > threshold AS INT) AS prediction FROM attacked JOIN rs USING (user_id, event_id) JOIN limits USING (user_id)),
d AS (SELECT user_id::VARCHAR AS device, count_if(intrusion = 1 AND prediction = 1) AS tp, count_if(intrusion = 0 AND prediction = 0) AS tn, count_if(intrusion = 0 AND prediction = 1) AS fp, count_if(intrusion = 1 AND prediction = 0) AS fn FROM e GROUP BY 1),
a AS (SELECT device, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy, unnest([{{'class': '0', 'hit': tn, 'said': tn + fn, 'support': tn + fp}}, {{'class': '1', 'hit': tp, 'said': tp + fp, 'support': tp + fn}}]) AS s FROM d),
b AS (SELECT device, accuracy, s.class AS class, CASE WHEN s.said = 0 THEN 0 ELSE s.hit::DOUBLE / s.said END AS precision, CASE WHEN s.support = 0 THEN 0 ELSE s.hit::DOUBLE / s.support END AS recall, s.support AS support FROM a),
fm AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM b),
u AS (SELECT device, accuracy, class, precision, recall, f1, support FROM fm
UNION ALL SELECT device, accuracy, 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM fm GROUP BY ALL
UNION ALL SELECT device, accuracy, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM fm GROUP BY ALL)
SELECT device, class, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def registry_metrics(spark, sf_dir):
    """What each device's model reached on injected attacks is stored with it, loaded, and reported by device."""
    found = training.evaluate(messages(spark, sf_dir), "hbos", DEVICE, KEY, NUMERIC, POOLS)
    known = registry.Registry(spark, scratch(spark, "models"))
    known.store_metrics(training.by_device(found, DEVICE), DEVICE, "rxpk", "hbos", 1)
    out = metrics.class_report(known.metrics(), ["device"])
    return out.select("device", "class", *(F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")), "support")


# --- logs and tables -------------------------------------------------------------

_H = "upper(md5(CAST(event_id AS STRING)))"
_FIELD = {
    "DevAddr": f"CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE substr({_H}, 1, 8) END",
    "FCnt": f"substr({_H}, 9, 4)",
    "MIC": f"substr({_H}, 13, 8)",
    "FPort": f"CASE WHEN event_id % 7 = 0 THEN 'zz' ELSE substr({_H}, 21, 2) END",
    "CFList": f"CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE substr({_H}, 1, 30) END",
    "PHYPayload": f"substr({_H}, 1, CAST(event_id % 30 AS INT))",
    "codr": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'OFF' ELSE concat('4/', CAST(event_id % 6 + 2 AS STRING)) END",
    "datr": "CASE event_id % 7 WHEN 0 THEN 'FSK' WHEN 1 THEN '' ELSE concat('SF', CAST(7 + event_id % 6 AS STRING), 'BW125') END",
}
_EVENT_FIELDS = "SELECT event_id, " + ", ".join(f'{x} AS "{n}"' for n, x in _FIELD.items()) + " FROM events WHERE user_id IS NOT NULL"


def _decimal(h: str) -> str:
    return f"CASE WHEN {h} IS NULL OR {h} = '' THEN NULL ELSE CAST(coalesce(try_cast('0x' || {h} AS HUGEINT), -1) AS DECIMAL(38, 0)) END"


def _rate(i: int) -> str:
    return f"CASE WHEN datr IS NULL THEN NULL ELSE coalesce(try_cast(nullif(regexp_extract(datr, 'SF([0-9]+)BW([0-9]+)', {i}), '') AS BIGINT), -1) END"


_HEX_SQL = {"FCnt": '"FCnt"', "MIC": '"MIC"', "FPort": '"FPort"', "CFList": 'substr("CFList", 1, greatest(length("CFList") - 2, 0))', "CFListType": 'right("CFList", 2)'}
_CODR = "CASE WHEN codr IS NULL THEN NULL WHEN codr = 'OFF' THEN -1.0 ELSE CAST(split_part(codr, '/', 1) AS DOUBLE) / CAST(split_part(codr, '/', 2) AS DOUBLE) END"
_CLEAN = ", ".join(f'{_decimal(x)} AS "{n}"' for n, x in _HEX_SQL.items()) + f', CAST(length("PHYPayload") AS INT) AS "PHYPayloadLen", {_CODR} AS codr, {_rate(1)} AS "SF", {_rate(2)} AS "BW", 0 AS intrusion'
_CLEAN_NAMES = ["DevAddr", *_HEX_SQL, "PHYPayloadLen", "codr", "SF", "BW", "intrusion"]


def _logged(spark, sf_dir, kind: str, record) -> DataFrame:
    """The clean table of a gateway log whose lines hold a record of each event."""
    folder = scratch(spark, "log")
    rows = table(spark, sf_dir, "events").filter("user_id is not null").select("event_id", *(F.expr(e).alias(n) for n, e in _FIELD.items()))
    lines = rows.select(F.to_json(record).alias("value"))
    # lines that hold no message
    lines.union(spark.createDataFrame([('{"other": 1}',), ("{broken",), ('{"rxpk": []}',)], "value string")).write.text(f"{folder}/{kind}_1.log")
    return flatten.etl(io.read_logs(spark, folder, kind), kind)


@query(f"""WITH e AS ({_EVENT_FIELDS}),
b AS (SELECT *, event_id % 8 AS own, CASE WHEN event_id % 4 <> 0 THEN event_id % 3 END AS other FROM e
  UNION ALL SELECT event_id, 'AABBCCDD', '0001', 'FF', '02', NULL, 'AB', '4/5', 'SF8BW500', NULL, NULL FROM e WHERE event_id % 3 = 0)
SELECT event_id AS tmst, "DevAddr", {_CLEAN}, coalesce(own, other) AS chan, CASE WHEN own IS NOT NULL AND other <> own THEN other END AS chan2 FROM b WHERE "DevAddr" <> ''""")
def uplink_etl(spark, sf_dir):
    fields = [F.col(n) for n in _FIELD]
    other = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 3)
    signals = F.array(F.struct((F.col("event_id") % 8).alias("chan"), F.lit(1.5).alias("lsnr")), F.struct(other.alias("chan"), F.lit(None).cast("double").alias("lsnr")))
    first = F.struct(*fields, (F.col("event_id") % 8).alias("chan"), signals.alias("rsig"), F.col("event_id").alias("tmst"))
    fixed = {"DevAddr": "AABBCCDD", "FCnt": "0001", "MIC": "FF", "FPort": "02", "CFList": None, "PHYPayload": "AB", "codr": "4/5", "datr": "SF8BW500"}
    second = F.struct(*(F.lit(fixed[n]).cast("string").alias(n) for n in _FIELD), F.lit(None).cast("long").alias("chan"), F.when(F.lit(False), signals).alias("rsig"), F.col("event_id").alias("tmst"))
    record = F.struct(F.when(F.col("event_id") % 3 == 0, F.array(first, second)).otherwise(F.array(first)).alias("rxpk"))
    return _logged(spark, sf_dir, "rxpk", record).select("tmst", *_CLEAN_NAMES, "chan", "chan2")


@query(f"""WITH e AS ({_EVENT_FIELDS}) SELECT event_id AS tmst, "DevAddr", {_CLEAN}, event_id % 27 AS powe FROM e WHERE "DevAddr" <> ''""")
def downlink_etl(spark, sf_dir):
    sent = F.struct("codr", "datr", (F.col("event_id") % 27).alias("powe"), F.col("event_id").alias("tmst"), F.lit(True).alias("ipol"), F.lit("LORA").alias("modu"))
    record = F.struct(*(n for n in _FIELD if n not in ("codr", "datr")), sent.alias("txpk"))
    return _logged(spark, sf_dir, "txpk", record).select("tmst", *_CLEAN_NAMES, "powe")


@query(f"""WITH p AS ({PHY_SQL}), e AS (SELECT event_id, {_FIELD["datr"]} AS datr FROM events)
SELECT event_id AS tmst, "DevAddr", {", ".join(f'{_decimal(_HEX_SQL[n])} AS "{n}"' for n in ("FCnt", "MIC", "FPort"))}, "PHYPayloadLen", {_rate(1)} AS "SF", event_id % 8 AS chan
FROM p JOIN e USING (event_id) WHERE "DevAddr" <> '' AND event_id % 9 <> 0""")
def stream_etl(spark, sf_dir):
    """Datagrams that arrive as files: the header is cut, messages are routed, parsed, decoded and cleaned."""
    folder = scratch(spark, "datagrams")
    rows = table(spark, sf_dir, "events").select("event_id", digest(F.col("event_id")).alias("h")).select("event_id", F.base64(F.unhex(F.expr(FRAME_SQL))).alias("data"))
    record = F.struct(F.array(F.struct((F.col("event_id") % 8).alias("chan"), "data", F.expr(_FIELD["datr"]).alias("datr"), F.col("event_id").alias("tmst"))).alias("rxpk"))
    kind = F.when(F.col("event_id") % 9 == 0, F.lit('{"stat":{"rxnb":1}}')).otherwise(F.to_json(record))
    rows.select(F.concat(F.lit("\u0002¡head"), kind)).write.text(f"{folder}/in")
    arrived = io.file_messages(spark, f"{folder}/in")
    cleaned = flatten.clean(flatten.flatten_stream(arrived.filter(scoring.is_uplink(F.col("message")))))
    scoring.run_available(cleaned.select("tmst", "DevAddr", "FCnt", "MIC", "FPort", "PHYPayloadLen", "SF", "chan"), scoring.append_batches(f"{folder}/rows"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/rows").drop("batch")


@query("SELECT event_id, user_id, event_type, CAST(NULL AS VARCHAR) AS never, CAST(upper(md5(CAST(event_id AS VARCHAR))) AS VARCHAR) AS h FROM events")
def json_table(spark, sf_dir):
    """A clean table kept as JSON: written once, skipped when it is there, read under its own schema (a column of nulls stays)."""
    path = f"{scratch(spark, 'table')}/t.json"
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit(None).cast("string").alias("never"), digest(F.col("event_id")).alias("h"))
    io.materialise(spark, path, lambda: rows, "json")
    return io.materialise(spark, path, lambda: rows.limit(0), "json")


@query("SELECT 'items.' || column_name AS leaf FROM (DESCRIBE lineitem) UNION ALL SELECT 'o.' || column_name FROM (DESCRIBE orders) UNION ALL SELECT 'n'")
def schema_leaves(spark, sf_dir):
    kinds = {t: table(spark, sf_dir, t).schema for t in ("lineitem", "orders")}
    nested = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("items", T.ArrayType(kinds["lineitem"])), T.StructField("o", kinds["orders"])])
    return spark.createDataFrame([(n,) for n in flatten.leaf_names(nested)], "leaf string")


@query("""WITH o AS (SELECT o_orderkey, count(*) AS items, count(o_totalprice) AS total, count(o_orderstatus) AS status FROM orders GROUP BY 1)
SELECT * FROM (SELECT 'items.l_quantity' AS leaf, count(l_quantity) AS known FROM lineitem JOIN o ON l_orderkey = o_orderkey UNION ALL SELECT 'items.l_comment', 0
UNION ALL SELECT 'items.l_returnflag', count(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END) FROM lineitem JOIN o ON l_orderkey = o_orderkey
UNION ALL SELECT 'o.status', sum(status)::BIGINT FROM o UNION ALL SELECT 'o.price.total', sum(total)::BIGINT FROM o UNION ALL SELECT 'o_orderkey', count(*) FROM o)""")
def leaf_census(spark, sf_dir):
    """How often each leaf of nested records holds a value."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_quantity", F.lit(None).cast("string").alias("l_comment"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("l_returnflag")).alias("i"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("price")).alias("o"))
    nested = orders.join(items.groupBy("o_orderkey").agg(F.collect_list("i").alias("items")), "o_orderkey", "left")
    return flatten.leaf_census(nested)


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value / 1000 WHEN 1 THEN value WHEN 2 THEN value * 100 WHEN 3 THEN 3600::DOUBLE * (event_id % 4) ELSE 0.99999::DOUBLE END AS s FROM events WHERE value IS NOT NULL),
u AS (SELECT event_id, s, CAST(round_even(s * 1000, 0) AS BIGINT) AS ms, CAST(round_even(s, 0) AS BIGINT) AS w FROM t)
SELECT event_id, CASE WHEN s < 1 THEN CASE WHEN ms < 1000 THEN ms || ' ms' ELSE '1 s' END
  ELSE coalesce(nullif(concat_ws(' ', CASE WHEN w // 3600 <> 0 THEN (w // 3600) || ' h' END, CASE WHEN w % 3600 // 60 <> 0 THEN (w % 3600 // 60) || ' min' END, CASE WHEN w % 60 <> 0 THEN (w % 60) || ' s' END), ''), '0 s') END AS took FROM u""")
def duration_format(spark, sf_dir):
    seconds = F.expr("CASE event_id % 5 WHEN 0 THEN value / 1000 WHEN 1 THEN value WHEN 2 THEN value * 100 WHEN 3 THEN 3600D * (event_id % 4) ELSE 0.99999D END")
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", X.duration(seconds).alias("took"))


# --- streams ---------------------------------------------------------------------


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_replay_counts(spark, sf_dir):
    folder = scratch(spark, "replay")
    scoring.run_available(events_stream(spark, sf_dir).select("event_id", "event_type"), scoring.append_batches(f"{folder}/rows"), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


def _replayed(spark, sf_dir, **named) -> scoring.Scorer:
    """A scorer whose history is all messages, and which has then seen them all once more as a stream."""
    folder = scratch(spark, "scored")
    scorer = scoring.Scorer(spark, folder, DEVICE, KEY, NUMERIC, prep.MIN_ROWS, **named)
    scorer.seed(messages(spark, sf_dir))
    scoring.run_available(messages(spark, sf_dir, events_stream(spark, sf_dir)), scorer.batch, f"{folder}/checkpoint")
    return scorer


STREAM_HBOS = f"WITH {P}, {hbos_ctes('p', 'p')}, found AS (SELECT event_id, user_id, score, CAST(score > threshold AS INT) AS prediction FROM rs JOIN limits USING (user_id))"


@query(f"{STREAM_HBOS} SELECT event_id, user_id, score, prediction FROM m LEFT JOIN found USING (event_id, user_id)")
def stream_score_hbos(spark, sf_dir):
    return _replayed(spark, sf_dir, refit="never").scored()


@query(f"{STREAM_HBOS} SELECT user_id, count(*) + count_if(coalesce(prediction, 0) = 0) AS kept FROM m LEFT JOIN found USING (event_id, user_id) GROUP BY 1")
def stream_history(spark, sf_dir):
    """The history of each device: what was there, and what was judged normal (or not at all)."""
    return _replayed(spark, sf_dir, refit="never").history(99).groupBy("user_id").agg(F.count("*").alias("kept"))


HALVES = """even AS (SELECT event_id, user_id, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_id % 2 = 0 AND user_id IN
  (SELECT user_id FROM events WHERE value IS NOT NULL AND event_id % 2 = 0 GROUP BY 1 HAVING count(*) >= 30)),
odd AS (SELECT event_id, user_id, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_id % 2 = 1)"""


def _halves(spark, sf_dir, **named) -> scoring.Scorer:
    """A scorer without a history that sees the even events, then the odd ones; the second batch comes twice."""
    scorer = scoring.Scorer(spark, scratch(spark, "halves"), DEVICE, KEY, ["value"], 30, **named)
    rows = table(spark, sf_dir, "events").filter("user_id is not null and value is not null")
    for number in (0, 1, 1):
        scorer.batch(rows.filter(F.col("event_id") % 2 == number), number)
    return scorer


@query(f"WITH {HALVES}, {hbos_ctes('even', 'odd', ('value',))} SELECT event_id, o.user_id, score, CAST(score > threshold AS INT) AS prediction FROM odd o LEFT JOIN (SELECT * FROM rs JOIN limits USING (user_id)) USING (user_id, event_id)")
def stream_cold_start(spark, sf_dir):
    """Devices gather history until they have a model; those that have one by the second batch are scored in it."""
    return _halves(spark, sf_dir).scored().filter(F.col("event_id") % 2 == 1)


@query(f"""WITH {HALVES}, {hbos_ctes('even', 'odd', ('value',))},
history AS (SELECT event_id, user_id, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_id % 2 = 0
  UNION ALL SELECT event_id, user_id, value FROM odd LEFT JOIN (SELECT user_id, event_id, score > threshold AS far FROM rs JOIN limits USING (user_id)) USING (user_id, event_id) WHERE NOT coalesce(far, false)),
gated AS (SELECT * FROM history WHERE user_id IN (SELECT user_id FROM history GROUP BY 1 HAVING count(*) >= 30)),
learned AS (SELECT user_id, min(value) AS a, max(value) AS b, count(*) AS n FROM gated GROUP BY 1)
SELECT user_id, n, round(CASE WHEN a = b THEN a - 0.5 ELSE a END, 9) AS lo, round(CASE WHEN a = b THEN b + 0.5 ELSE b END, 9) AS hi FROM learned""")
def stream_refit(spark, sf_dir):
    """What the models have learned from after the second batch: all that was kept."""
    fitted = _halves(spark, sf_dir).models(2, "long")
    cells = fitted.select("user_id", F.inline(F.from_json("params", models.HISTOGRAM)["cells"]))
    return cells.select("user_id", "n", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


_SCALE = "CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS value"
SCALED = f"""{HALVES}, st AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM even GROUP BY 1),
se AS (SELECT event_id, user_id, {_SCALE} FROM even JOIN st USING (user_id)), so AS (SELECT event_id, user_id, {_SCALE} FROM odd JOIN st USING (user_id)), {hbos_ctes('se', 'so', ('value',))},
judged AS (SELECT user_id, event_id, score, score > threshold AS far FROM rs JOIN limits USING (user_id))"""


@query(f"WITH {SCALED} SELECT event_id, user_id, score, CAST(far AS INT) AS prediction FROM odd LEFT JOIN judged USING (user_id, event_id)")
def stream_scaled(spark, sf_dir):
    """A streamed batch is scaled by the stored transforms of the batch before it, and scored by the models of what they gave."""
    return _halves(spark, sf_dir, scale=True).scored().filter(F.col("event_id") % 2 == 1)


@query(f"""WITH {SCALED}, history AS (SELECT user_id, value FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_id % 2 = 0
  UNION ALL SELECT user_id, value FROM odd LEFT JOIN judged USING (user_id, event_id) WHERE NOT coalesce(far, false))
SELECT user_id, round(avg(value), 6) AS shift, round(1 / stddev_samp(value), 6) AS factor FROM history GROUP BY 1 HAVING count(*) >= 30""")
def stream_refit_transforms(spark, sf_dir):
    """A refit learns the transforms anew: mean and inverse deviation of all that was kept."""
    fitted = _halves(spark, sf_dir, scale=True).models(2, "long")
    return fitted.select("user_id", F.round(F.get("shift", F.lit(0)), 6).alias("shift"), F.round(F.get("factor", F.lit(0)), 6).alias("factor"))


@query("SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids, true AS fewer_files FROM events WHERE user_id IS NOT NULL AND event_id % 7 <> 3 GROUP BY 1")
def store_compaction(spark, sf_dir):
    """Batches are appended, one is written again, a compaction is lost half-way, another ends, and unnamed folders go: the rows stay those of the last writes."""
    held = store.Store(spark, scratch(spark, "store"), "event_id bigint, user_id bigint", by=DEVICE)
    rows = table(spark, sf_dir, "events").filter("user_id is not null").select("event_id", "user_id")
    for n in range(7):
        held.write(rows.filter(F.col("event_id") % 7 == n), f"batch/{n}", n)
    held.write(rows.limit(0), "batch/3", 3)  # the batch runs again and has nothing this time
    held._written(held.read(lambda e: e["v"] < 6), True)  # what a compaction leaves that never reached its manifest
    held.compact(6)
    held.vacuum(1)
    out = held.read().groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return out.withColumn("fewer_files", F.lit(len(held.entries()) == 2))


@query("SELECT user_id::VARCHAR AS device, 7 AS version, 2 AS parts FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def registry_writers(spark, sf_dir):
    """Eight writers store models of all devices at once: each gets a version of its own, and what is loaded is one of them, whole."""
    known = registry.Registry(spark, scratch(spark, "writers"))
    devices = table(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").cast("string").alias("device")).distinct()
    rows = devices.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).select("device", F.lit("rxpk").alias("msg_type"), F.lit("lof").alias("algorithm"), "part", F.lit("{}").alias("params"), F.lit(None).cast("map<string, array<double>>").alias("arrays"))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: known.next(rows.withColumn("params", F.lit(str(n))), "rxpk-lof"), range(8)))
    return known.load().groupBy("device", "version").agg(F.count("*").alias("rows"), F.countDistinct("params").alias("writers")).filter("writers = 1").select("device", F.col("version").cast("int").alias("version"), F.col("rows").cast("int").alias("parts"))


__all__ = ["ORACLE_SQL", "QUERIES"]
