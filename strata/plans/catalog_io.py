"""Registered queries for ingest cleaning (S3, S4) and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..sources import csv as ingest
from ..sources.sinks import attach_segments, segment_cards
from ..operators import evaluate as E
from ..operators.prepare import dense_index
from .registry import r, register, rounded, tbl

_TOKENS_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in K.NA_TOKENS)


def price_text(spark, sf):
    """lineitem with a messy text price: sentinels on some line numbers, '$12,345' otherwise."""
    li = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    v = F.floor("l_extendedprice").cast("bigint")
    money = F.concat(F.lit("$"), F.expr("CAST(floor(l_extendedprice) AS BIGINT) div 1000").cast("string"), F.lit(","),
                     F.lpad((v % 1000).cast("string"), 3, "0"))
    raw = (F.when(F.col("l_linenumber") == 1, F.lit("-")).when(F.col("l_linenumber") == 2, F.lit("sin dato"))
           .when(F.col("l_linenumber") == 3, F.lit("  n/a")).otherwise(money))
    return li.select("l_orderkey", "l_linenumber", raw.alias("price_text"))


_PRICE_SQL = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN '-' WHEN l_linenumber = 2 THEN 'sin dato'
  WHEN l_linenumber = 3 THEN '  n/a' ELSE '$' || CAST(CAST(floor(l_extendedprice) AS BIGINT) // 1000 AS VARCHAR) || ',' ||
  lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END AS price_text FROM lineitem)"""


@register("null_tokens", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN ltrim(price_text) IN ({_TOKENS_SQL}) THEN NULL ELSE price_text END AS price_text
FROM {_PRICE_SQL} t
""")
def null_tokens_q(spark, sf):
    return ingest.null_tokens(price_text(spark, sf), ["price_text"])


@register("numeric_salvage", f"""
WITH t AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN ltrim(price_text) IN ({_TOKENS_SQL}) THEN NULL ELSE price_text END AS price_text FROM {_PRICE_SQL} x),
c AS (SELECT *, TRY_CAST(replace(regexp_replace(regexp_replace(trim(price_text), '[,\\s]', '', 'g'), '^[$€£]\\s?', ''), '%', '')
              AS DOUBLE) AS parsed FROM t),
d AS (SELECT count(parsed) / count(price_text) >= 0.9 AND count(DISTINCT price_text) > 2 AS ok FROM c)
SELECT l_orderkey, l_linenumber, {r('parsed', 2)} AS price_text FROM c, d WHERE d.ok
""")
def numeric_salvage(spark, sf):
    df = ingest.null_tokens(price_text(spark, sf), ["price_text"])
    return rounded(ingest.salvage_numeric(df), 2)


def customers_by_segment(spark, sf):
    c = tbl(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return dense_index(c.withColumn("cluster", F.col("c_mktsegment")), "cluster").withColumn(
        "cluster", F.col("cluster").cast("int"))


_CBS = "(SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS cluster FROM customer)"


@register("labelled_rows", f"""
WITH t AS {_CBS}, s AS (SELECT cluster, count(*) AS n FROM t GROUP BY 1),
seg AS (SELECT cluster, 'Segment ' || CAST(cluster AS VARCHAR) AS label FROM s WHERE cluster < 3)
SELECT t.c_custkey, t.c_mktsegment, t.cluster, coalesce(seg.label, 'Desconocido') AS segment
FROM t LEFT JOIN seg ON t.cluster = seg.cluster
""")
def labelled_rows(spark, sf):
    """Rows + cluster + segment name; clusters without a named segment → 'Desconocido'."""
    rows = customers_by_segment(spark, sf)
    seg = E.cluster_sizes(rows).where(F.col("cluster") < 3).select(
        "cluster", F.concat(F.lit("Segment "), F.col("cluster").cast("string")).alias("label"))
    return attach_segments(rows, seg)


@register("segment_cards", f"""
WITH t AS {_CBS}
SELECT cluster, 'Segment ' || CAST(cluster AS VARCHAR) AS label, count(*) AS size,
  string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS markets
FROM t GROUP BY cluster
""")
def segment_cards_q(spark, sf):
    """List fields flattened with ' | ' for CSV export."""
    rows = customers_by_segment(spark, sf)
    seg = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                      F.sort_array(F.collect_set("c_mktsegment")).alias("markets"))
    return segment_cards(seg.select("cluster", F.concat(F.lit("Segment "), F.col("cluster").cast("string"))
                                    .alias("label"), "size", "markets"))


@register("csv_ingest", f"""
SELECT c_mktsegment, count(*) AS n, count(c_acctbal) AS n_balance, {r("sum(c_acctbal)", 2)} AS balance, count(*) AS n_notes
FROM (SELECT c_mktsegment, CASE WHEN c_nationkey = 3 THEN NULL ELSE floor(c_acctbal) END AS c_acctbal FROM customer)
GROUP BY c_mktsegment
""")
def csv_ingest(spark, sf):
    """S1–S4 end to end: customer written as a ';' CSV in cp1252 bytes, with '$1,234' / '$-12' money text,
    'sin dato' sentinels and notes that hold quotes, a line break, a separator and the euro sign, into the
    session's shared scratch folder, read back through the salvaging reader."""
    import uuid

    from ..session import ensure_checkpoint_dir

    c = tbl(spark, sf, "customer")
    v = F.floor("c_acctbal").cast("bigint")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(v)
    money = F.when(a >= 1000, F.concat(F.lit("$"), sign, F.expr("CAST(abs(floor(c_acctbal)) AS BIGINT) div 1000")
                                       .cast("string"), F.lit(","), F.lpad((a % 1000).cast("string"), 3, "0"))) \
        .otherwise(F.concat(F.lit("$"), sign, a.cast("string")))

    def note(euro: str):
        return F.concat(F.lit('he said "'), F.col("c_mktsegment"), F.lit(f'; {euro}"\ncafé '), F.col("c_custkey").cast("string"))

    # the byte 0x80 is the euro sign in cp1252 and a control character in ISO-8859-1, in which Spark writes
    text = c.select("c_custkey", "c_name", "c_mktsegment", note("\x80").alias("note"),
                    F.when(F.col("c_nationkey") == 3, F.lit("sin dato")).otherwise(money).alias("c_acctbal"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/strata-csv/{uuid.uuid4().hex}"
    text.write.option("header", True).option("sep", ";").option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    back = ingest.read_csv(spark, path)
    return rounded(back.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("n_balance"),
        F.sum("c_acctbal").alias("balance"), F.count_if(F.col("note") == note("€")).alias("n_notes")), 2)


# ------------------------------------------------------------------ run store

_RUNS = (("001234567890", "first.csv", "2026-01-01T00:00:00+00:00"), ("0000000000a1", "second.csv", "2026-01-02T00:00:00+00:00"))


def run_store(spark, sf):
    """Two runs below the session's shared folder: customers by market segment, one run with an
    extra column, and edits of the first run's labels."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.runs import RunStore

    store = RunStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/strata-runs/{uuid.uuid4().hex}")
    segments = E.cluster_sizes(customers_by_segment(spark, sf)).select(
        "cluster", F.concat(F.lit("Segment "), F.col("cluster").cast("string")).alias("label"), F.col("n").alias("size"))
    n_rows = segments.agg(F.sum("size")).first()[0]
    for i, (run_id, name, at) in enumerate(_RUNS):
        store.write("segments", run_id, segments.where(F.col("cluster") < 3) if i else segments)
        store.publish(run_id, ["segments"], created_at=at, file_name=name, n_rows=n_rows, **({"grade": "B"} if i else {}))
    for label in ("draft", "final", None):
        store.edit_segment(_RUNS[0][0], 0, validated=label == "final" or None, **({"label": label} if label else {"barriers": [" a ", "", "b"]}))
    return store


@register("run_listing", f"""
WITH s AS (SELECT cluster, count(*) AS n FROM {_CBS} t GROUP BY 1), l AS (
  SELECT '{_RUNS[0][0]}' AS run_id, '{_RUNS[0][1]}' AS file_name, '—' AS grade,
    CASE WHEN cluster = 0 THEN 'final' ELSE 'Segment ' || cluster END AS label, cluster FROM s
  UNION ALL SELECT '{_RUNS[1][0]}', '{_RUNS[1][1]}', 'B', 'Segment ' || cluster, cluster FROM s WHERE cluster < 3)
SELECT run_id, file_name, (SELECT CAST(sum(n) AS BIGINT) FROM s) AS n_rows, count(*) AS n_segments, grade,
  string_agg(label, ',' ORDER BY cluster) AS labels FROM l GROUP BY run_id, file_name, grade
""")
def run_listing(spark, sf):
    """Ids as text, each run's own schema, defaults for missing fields, edited labels."""
    return run_store(spark, sf).list_runs().select("run_id", "file_name", "n_rows", "n_segments", "grade",
                                                   F.concat_ws(",", "segment_labels").alias("labels"))


@register("curated_segments", f"""
SELECT cluster, CASE WHEN cluster = 0 THEN 'final' ELSE 'Segment ' || cluster END AS label, count(*) AS size,
  CASE WHEN cluster = 0 THEN true END AS validated, CASE WHEN cluster = 0 THEN 'a,b' END AS barriers
FROM {_CBS} t GROUP BY cluster
""")
def curated_segments(spark, sf):
    """The latest edit of each field, in order of the edits, over the stored segments."""
    return run_store(spark, sf).effective_segments(_RUNS[0][0]).select(
        "cluster", "label", "size", "validated", F.when(F.col("barriers").isNotNull(), F.concat_ws(",", "barriers")).alias("barriers"))


_GROUPS = {"rich": "c_acctbal > 5000", "building": "lower(c_mktsegment) = 'building'", "low_nation": "c_nationkey < 5", "nobody": "c_acctbal < -1000000"}


@register("saved_groups", f"""
WITH g AS ({" UNION ALL ".join(f"SELECT '{name}' AS name, c_custkey FROM customer WHERE {where}" for name, where in _GROUPS.items())}),
names AS ({" UNION ALL ".join(f"SELECT '{name}' AS name" for name in _GROUPS)}),
s AS (SELECT names.name, count(g.c_custkey) AS size FROM names LEFT JOIN g ON g.name = names.name GROUP BY 1),
p AS (SELECT a.name AS a, b.name AS b, count(*) AS n FROM g a JOIN g b ON a.c_custkey = b.c_custkey GROUP BY 1, 2
  UNION ALL SELECT name, name, 0 FROM s WHERE size = 0)
SELECT p.a AS group_a, p.b AS group_b, p.n, {r("round_even(p.n / (SELECT count(*) FROM customer) * 1000.0, 0) / 10.0")} AS share,
  CASE WHEN s.size > 0 THEN {r("round_even(p.n / s.size * 1000.0, 0) / 10.0")} ELSE 0.0 END AS share_of_a
FROM p JOIN s ON s.name = p.a
""")
def saved_groups(spark, sf):
    """H4: groups saved with a run, read back: sizes, shares and overlaps of all by one scan of the rows."""
    from ..operators.groups import group_overlaps

    store, run_id = run_store(spark, sf), _RUNS[0][0]
    asked = {"rich": [("c_acctbal", "gt", "5000")], "building": [("c_mktsegment", "eq", "Building")], "low_nation": [("c_nationkey", "lt", 5)],
             "nobody": [("c_acctbal", "lt", -1000000)], "dropped": [("c_nationkey", "eq", 1)]}
    ids = {store.save_group(run_id, name, [{"column": c, "op": op, "value": v} for c, op, v in filters], 0, 0.0): name for name, filters in asked.items()}
    store.delete_group(run_id, next(i for i, name in ids.items() if name == "dropped"))
    found = group_overlaps(tbl(spark, sf, "customer"), {ids[i]: filters for i, filters in store.group_filters(run_id).items()})
    return rounded(found)
