"""Lineage of stored metrics."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, txt
from lodestat.operators import lineage as L
from lodestat.session import dealt, stage

BY = ("entity", "period_end")
CELLS = ("ocf", "capex", "da", "sbc", "debt", "cash")
OWNER = ("ocf", "capex", "da", "sbc")


def nodes(spark, d):
    """(sources, metrics) of every quarter: owner cash flow from its cells, its sum over four quarters, net debt, and the years of
    owner cash flow that pay it. Values are dealt out by entity before they are hashed: an id is several times as long as its value, and
    all groups below lie within an entity, so that ids are made where they are used."""
    quarters = stage(R.statements(spark, d).where("scope = 'quarterly'").select(*BY, *CELLS), "cells")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in CELLS]))      # keeps rows dealt, as unpivot does not
    src = L.sources(dealt(quarters, "entity").select(*BY, cells.alias("c")).select(*BY, "c.key", "c.value"), BY)
    owner = L.metrics(src.where(F.col("key").isin(*OWNER)), "owner_fcf", BY, needed=("ocf", "capex"))
    four = F.collect_list("id").over(W.partitionBy("entity").orderBy("period_end").rowsBetween(-3, 0))          # quarters of one entity
    quarters = owner.select(*BY, "key", four.alias("ids")).select(*BY, "key", F.explode("ids").alias("id"))
    ttm = L.metrics(quarters, "owner_fcf_ttm", BY, least=4)
    debt = L.metrics(src.where(F.col("key").isin("debt", "cash")), "net_debt", BY, needed=("debt", "cash"))
    parts = ttm.unionByName(debt)
    years = L.metrics(parts, "net_debt_years", BY, needed=("owner_fcf_ttm", "net_debt"))
    return src, owner.unionByName(parts).unionByName(years)


def _metric(name, ins):
    return f"sha256(concat_ws('|', 'metric', '{name}:1', entity, CAST(period_end AS VARCHAR), array_to_string({ins}, ',')))"


SQL_NODES = f"""{R.SQL_STATEMENTS}, cell AS (SELECT entity, period_end, unnest([{', '.join(f"'{c}'" for c in CELLS)}]) AS key, unnest([{', '.join(CELLS)}]) AS value FROM stm WHERE scope = 'quarterly'),
  src AS (SELECT entity, period_end, key, sha256(concat_ws('|', 'source', entity, CAST(period_end AS VARCHAR), key, CAST(round(value * {L.UNITS}) AS BIGINT))) AS id FROM cell WHERE value IS NOT NULL),
  o0 AS (SELECT entity, period_end, list_sort(list(id)) AS ins FROM src WHERE key IN ({', '.join(f"'{c}'" for c in OWNER)}) GROUP BY ALL HAVING bool_or(key = 'ocf') AND bool_or(key = 'capex')),
  ow AS (SELECT entity, period_end, 'owner_fcf' AS key, {_metric('owner_fcf', 'ins')} AS id, ins FROM o0),
  t0 AS (SELECT entity, period_end, list_sort(list(id) OVER (PARTITION BY entity ORDER BY period_end ROWS 3 PRECEDING)) AS ins FROM ow),
  tt AS (SELECT entity, period_end, 'owner_fcf_ttm' AS key, {_metric('owner_fcf_ttm', 'ins')} AS id, ins FROM t0 WHERE len(ins) = 4),
  d0 AS (SELECT entity, period_end, list_sort(list(id)) AS ins FROM src WHERE key IN ('debt', 'cash') GROUP BY ALL HAVING count(*) = 2),
  nd AS (SELECT entity, period_end, 'net_debt' AS key, {_metric('net_debt', 'ins')} AS id, ins FROM d0),
  y0 AS (SELECT tt.entity, tt.period_end, list_sort([tt.id, nd.id]) AS ins FROM tt JOIN nd ON nd.entity = tt.entity AND nd.period_end = tt.period_end),
  ny AS (SELECT entity, period_end, 'net_debt_years' AS key, {_metric('net_debt_years', 'ins')} AS id, ins FROM y0),
  met AS (SELECT * FROM ow UNION ALL SELECT * FROM tt UNION ALL SELECT * FROM nd UNION ALL SELECT * FROM ny)"""


@query("metric_ids", f"WITH {SQL_NODES} SELECT entity, {txt('period_end')}, key, id, len(ins) AS inputs FROM met")
def metric_ids(spark, d):
    """Every stored metric with the id made of its definition and inputs."""
    return nodes(spark, d)[1].select(*BY, "key", "id", F.size("inputs").cast("bigint").alias("inputs"))


@query("metric_ancestors", f"""WITH RECURSIVE {SQL_NODES}, ed AS (SELECT id, unnest(ins) AS input_id FROM met), an AS (SELECT id, input_id AS ancestor FROM ed UNION SELECT an.id, ed.input_id FROM an JOIN ed ON ed.id = an.ancestor),
  g AS (SELECT id, count(*) AS ancestors, count(*) FILTER (ancestor IN (SELECT id FROM src)) AS sources, sha256(string_agg(ancestor, ',' ORDER BY ancestor)) AS ancestors_sha256 FROM an GROUP BY id)
  SELECT entity, {txt('period_end')}, key, id, ancestors, sources, ancestors_sha256 FROM met JOIN g USING (id)""")
def metric_ancestors(spark, d):
    """All that a metric was made from, near or far: how many nodes, how many of them sources, and a digest of their ids."""
    met = nodes(spark, d)[1].select(*BY, "key", F.unhex("id").alias("id"), F.transform("inputs", F.unhex).alias("inputs"))      # half as long as the digits
    up = L.ancestors(met, within=("entity",))
    texts = F.transform(F.sort_array("ancestors"), lambda x: F.lower(F.hex(x)))          # bytes sort as their digits do
    return up.select(*BY, "key", F.lower(F.hex("id")).alias("id"), F.size("ancestors").cast("bigint").alias("ancestors"), "sources", F.sha2(F.array_join(texts, ","), 256).alias("ancestors_sha256"))
