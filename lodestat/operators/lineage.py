"""Content-addressed lineage of stored metrics.

A node's id is a hash of what it is: a source of its keys and value, a metric of its definition (name and version), its keys and the
ids of its inputs. The same inputs therefore give the same id in any run, and any other input, however deep, another one. Edges are
a table (id, input_id), and all ancestors are found by pointer doubling, or, where lineage keeps within small groups, group by group."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.session import stage

UNITS = 100_000          # values are hashed as whole units, so that the id does not hang on how a number is printed


def sources(rows: DataFrame, by, name: str = "key", value: str = "value") -> DataFrame:
    """(*by, key, id) of source observations that hold a value."""
    units = F.round(F.col(value) * UNITS).cast("bigint")
    held = rows.where(F.col(value).isNotNull())
    return held.select(*by, F.col(name).alias("key"), F.sha2(F.concat_ws("|", F.lit("source"), *[F.col(c).cast("string") for c in (*by, name)], units.cast("string")), 256).alias("id"))


def metrics(inputs: DataFrame, definition: str, by, version: int = 1, needed: tuple = (), least: int = 1) -> DataFrame:
    """(*by, key, id, inputs): one metric for each key of its inputs (*by, key, id) that has all ``needed`` input keys and at least
    ``least`` inputs. Inputs are a set: their order and repeats do not count. A definition reads a handful of inputs."""
    g = inputs.groupBy(*by).agg(F.sort_array(F.collect_set("id")).alias("inputs"), F.collect_set("key").alias("_keys"))
    enough = F.size("inputs") >= least
    for k in needed:
        enough = enough & F.array_contains("_keys", k)
    name = F.lit(f"{definition}:{version}")
    return g.where(enough).select(*by, F.lit(definition).alias("key"), F.sha2(F.concat_ws(
        "|", F.lit("metric"), name, *[F.col(c).cast("string") for c in by], F.array_join("inputs", ",")), 256).alias("id"), "inputs")


def edges(nodes: DataFrame) -> DataFrame:
    """(id, input_id) of metrics."""
    return nodes.select("id", F.explode("inputs").alias("input_id"))


def numbered(ids: DataFrame) -> DataFrame:
    """(id, no): a number for every different id of a column of hex digests. ``id`` comes back as bytes, half as long as the text;
    a path of two numbers is an eighth of one of two texts."""
    return stage(ids.select(F.unhex("id").alias("id")).distinct().withColumn("no", F.monotonically_increasing_id()), "numbers")


def ancestors(links: DataFrame, within=()) -> DataFrame:
    """(id, ancestor): every node that a node was made from, near or far. Each round joins the paths found in the last one to all paths
    and so doubles their length; only new paths are kept and written, each once, and rounds end when none is new. Lineage holds no
    cycle, as an id contains its inputs' ids; other tables may, which is an error.

    ``within`` are columns that a node shares with all its ancestors, such as the company, with a bounded number of nodes. Then ``links`` are
    nodes (*within, id, inputs, ...), which are exchanged once, by these columns, and followed where they lie; no path is written. Rows
    come back without inputs, with ``ancestors`` (an array of ids) and ``sources``, the number of those that have no inputs themselves."""
    if within:
        fields = [f for f in links.schema if f.name != "inputs"]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        kind = links.schema["id"].dataType.simpleString()
        return links.groupBy(*within).applyInArrow(_followed, f"{kinds}, ancestors array<{kind}>, sources long")
    reach = last = stage(links.select("id", F.col("input_id").alias("ancestor")).distinct(), "reach")
    while True:
        if last.where("id = ancestor").limit(1).count():
            raise ValueError("lineage with a cycle")
        further = last.join(reach.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("further")), "ancestor").select("id", F.col("further").alias("ancestor"))
        last = stage(further.distinct().join(reach, ["id", "ancestor"], "left_anti"), "reach")
        if not last.limit(1).count():
            return reach
        reach = reach.unionByName(last)


def _followed(nodes: pa.Table) -> pa.Table:
    """``ancestors`` of one group."""
    ids, inputs = nodes["id"].to_pylist(), nodes["inputs"].to_pylist()
    up, reach, open_ = {}, {}, set()
    for node, own in zip(ids, inputs, strict=True):
        up.setdefault(node, set()).update(own or ())
    for top in up:
        stack = [top]
        while stack:
            node = stack[-1]
            todo = [] if node in reach else [x for x in up[node] if x in up and x not in reach]
            open_.add(node)
            if any(x in open_ for x in todo):
                raise ValueError("lineage with a cycle")
            if todo:
                stack += todo
                continue
            if node not in reach:
                reach[node] = up[node].union(*(reach.get(x, ()) for x in up[node]))
            open_.discard(node)
            stack.pop()
    kind = nodes.schema.field("id").type
    sources = {node: sum(x not in up for x in far) for node, far in reach.items()}
    return (nodes.drop_columns(["inputs"]).append_column("ancestors", pa.array([list(reach[x]) for x in ids], pa.list_(kind)))
            .append_column("sources", pa.array([sources[x] for x in ids], pa.int64())))
