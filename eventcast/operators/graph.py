"""The event graph: typed nodes, undirected edges, neighbourhoods and propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast.functions.calendar import date_text
from eventcast.operators.attach import BROADCAST_BYTES, attach, prefilter, table_bytes
from eventcast.operators.rank import global_rank
from eventcast.session import new_path, stage, stage_table

SEPARATOR = "|"


def with_node_ids(events: DataFrame) -> DataFrame:
    """Text ids of the three nodes each event touches."""
    return events.withColumns({
        "date_node": F.concat(F.lit("Date|"), date_text(F.col("date"))),
        "location_node": F.concat(
            F.lit("Location|"), F.concat_ws(SEPARATOR, "country_txt", "region_txt", "city")
        ),
        "type_node": F.concat(F.lit("AttackType|"), F.col("attacktype1_txt")),
    })


def build_nodes(events: DataFrame) -> DataFrame:
    """(id, node_type): distinct dates, locations and attack types."""
    named = with_node_ids(events)
    typed = F.array(
        F.struct(F.col("date_node").alias("id"), F.lit("Date").alias("node_type")),
        F.struct(F.col("location_node").alias("id"), F.lit("Location").alias("node_type")),
        F.struct(F.col("type_node").alias("id"), F.lit("AttackType").alias("node_type")),
    )
    return named.select(F.inline(typed)).distinct()


def build_edges(events: DataFrame) -> DataFrame:
    """(src, dst, attrs): date-location and location-type edges, the last event's attributes win.

    Each undirected edge is stored once; the aggregation combines before its shuffle.
    """
    named = with_node_ids(events)
    details = F.struct(
        F.col("nkill").alias("killed"), F.col("nwound").alias("wounded"),
        F.col("casualties").alias("total_casualties"), F.col("weaptype1_txt").alias("weapon_type"),
    )
    empty = F.when(F.lit(False), details)
    pairs = named.select("date", "eventid", F.inline(F.array(
        F.struct(F.col("date_node").alias("src"), F.col("location_node").alias("dst"),
                 empty.alias("attrs")),
        F.struct(F.col("location_node").alias("src"), F.col("type_node").alias("dst"),
                 details.alias("attrs")),
    )))
    return pairs.groupBy("src", "dst").agg(
        F.max_by("attrs", F.struct("date", "eventid")).alias("attrs")
    )


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(
        F.struct(F.col("src"), F.col("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )))


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).select(
        "nodes", edges.agg(F.count(F.lit(1))).scalar().alias("edges")
    )


def degrees(edges: DataFrame) -> DataFrame:
    return both_directions(edges).groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("degree")
    )


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node, isolated ones included."""
    return nodes.join(degrees(edges), "id", "left").fillna(0, subset=["degree"])


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    others = nodes.agg(F.count(F.lit(1)) - 1).scalar()
    return node_degrees(nodes, edges).withColumn(
        "centrality", F.try_divide(F.col("degree").cast("double"), others)
    )


def most_central(nodes: DataFrame, edges: DataFrame, k: int = 11) -> DataFrame:
    return degree_centrality(nodes, edges).orderBy(F.desc("centrality"), "id").limit(k)


def _members_only(edges: DataFrame, members: DataFrame, end: str, size: int, broadcast_bytes: int) -> DataFrame:
    """Edges whose ``end`` is one of ``members`` (staged, column id).

    Small sets are broadcast and no edge moves. Larger ones go ahead of the join as a hashed bitmap, so that
    edges outside are dropped where they are read and only the others are shuffled.
    """
    named = members.select(F.col("id").alias(end))
    near = edges if table_bytes(named) <= broadcast_bytes else prefilter(edges, named, end, size)
    return attach(near, named, end, "left_semi", staged=True, broadcast_bytes=broadcast_bytes)


def ego_nodes(edges: DataFrame, centre: str, radius: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Nodes within ``radius`` hops of ``centre``.

    Per hop, only edges that touch the frontier leave the place where they are read; hubs are split by ``attach``, and
    each hop's result is staged so the plan does not grow with the radius.
    """
    links = stage_table(both_directions(edges))
    start = links.filter(F.col("src") == centre).select(F.col("src").alias("id")).distinct()
    reached = stage(start)
    frontier = reached
    for _ in range(radius):
        step = _members_only(links, frontier, "src", frontier.count(), broadcast_bytes)
        found = step.select(F.col("dst").alias("id")).distinct()
        frontier = stage(found.join(reached, "id", "left_anti"))
        reached = stage(reached.unionByName(frontier))
    return reached


def induced_subgraph(edges: DataFrame, members: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Edges whose two ends are both members."""
    members = stage(members.select("id").distinct())
    size = members.count()
    left = _members_only(edges, members, "src", size, broadcast_bytes)
    return _members_only(left, members, "dst", size, broadcast_bytes)


def index_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered from 0 by id, and the edges as integer pairs."""
    indexed = stage(global_rank(nodes.select("id", "node_type"), ["id"], out="node_index"))
    numbers = indexed.select("id", "node_index")
    pairs = edges.select("src", "dst")
    for end in ("src", "dst"):
        lookup = numbers.select(F.col("id").alias(end), F.col("node_index").alias(f"{end}_index"))
        pairs = attach(pairs, lookup, end, "inner", staged=True)
    return indexed, pairs.select("src_index", "dst_index")


HUB_SHARE = 1000
BUCKET_EDGES = 2_000_000


class _Links:
    """Edges in both directions, laid out once for joins by their source.

    Small node tables are broadcast to the edges as they lie. Otherwise the edges are written in buckets of their source,
    sorted; sources with at least 1/``HUB_SHARE`` of all edges are dealt over several buckets by their other end, and
    their node rows are repeated. Only node rows move from hop to hop.
    """

    def __init__(self, links: DataFrame, degrees: DataFrame, small: bool):
        self.small, self.table = small, links
        if small:
            return
        spark = links.sparkSession
        total = degrees.agg(F.coalesce(F.sum("_d"), F.lit(0))).first()[0]
        share = F.ceil(F.col("_d") * HUB_SHARE / max(1, total)).cast("int")
        self.hubs = stage(degrees.filter(F.col("_d") * HUB_SHARE >= total).select("id", share.alias("_parts")))
        buckets = max(spark.sparkContext.defaultParallelism, -(-total // BUCKET_EDGES))
        dealt = links.join(F.broadcast(self.hubs.withColumnRenamed("id", "src")), "src", "left").select(
            "src", F.pmod(F.xxhash64("dst"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part"), "dst")
        path = new_path(spark, "links")
        name = "eventcast_" + path.rsplit("-", 1)[1]
        writer = dealt.repartition(buckets, "src", "_part").write.format("parquet").option("path", path)
        writer.bucketBy(buckets, "src", "_part").sortBy("src", "_part").saveAsTable(name)
        self.table = spark.table(name)

    def messages(self, sent: DataFrame) -> DataFrame:
        """One row per edge: its target as ``id`` and the values of its source."""
        sent = sent.withColumnRenamed("id", "src")
        if self.small:
            return self.table.join(F.broadcast(sent), "src").drop("src").withColumnRenamed("dst", "id")
        copied = sent.join(F.broadcast(self.hubs.withColumnRenamed("id", "src")), "src", "left").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        return self.table.join(copied.hint("merge"), ["src", "_part"]).drop("src", "_part").withColumnRenamed("dst", "id")


def propagate(
    nodes: DataFrame, edges: DataFrame, features: Sequence[str], hops: int = 3, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``hops`` rounds of symmetric-normalised neighbour sums with self loops.

    With d = degree + 1, a round computes sum over v and its neighbours u of h(u)/sqrt(d(u)),
    divided by sqrt(d(v)): node rows are scaled before and after, so the edges carry no weights. The edges
    are laid out once; a round moves node rows and sums that were combined where the edges lie.
    """
    links = stage_table(both_directions(edges))
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_d"))
    current = stage(
        nodes.select("id", *features).join(degree, "id", "left")
        .withColumn("_root", F.sqrt(F.coalesce(F.col("_d"), F.lit(0)) + 1.0))
        .select("id", "_d", "_root", *[(F.col(c).cast("double") / F.col("_root")).alias(c) for c in features])
    )
    # The node table keeps its size from hop to hop, so it is measured once.
    laid = _Links(links, current.select("id", "_d"), table_bytes(current) <= broadcast_bytes)
    for hop in range(hops):
        received = laid.messages(current.select("id", *features)).groupBy("id").agg(
            *[F.sum(c).alias(f"_in_{c}") for c in features])
        # ``current`` holds h / sqrt(d): the last hop divides once, the others once more for the next.
        root = F.col("_root") if hop == hops - 1 else F.col("_root") * F.col("_root")
        current = current.join(received, "id", "left").select("id", "_d", "_root", *[
            ((F.col(c) + F.coalesce(F.col(f"_in_{c}"), F.lit(0.0))) / root).alias(c) for c in features])
        if hop < hops - 1:
            current = stage(current)
    if not hops:
        current = current.select("id", "_d", "_root", *[(F.col(c) * F.col("_root")).alias(c) for c in features])
    return current.drop("_d", "_root")
