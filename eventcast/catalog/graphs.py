"""Graph queries over the event graph of dates, places and types."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from eventcast.catalog import sqltext as Q
from eventcast.catalog.registry import query
from eventcast.catalog.texts import VECTOR_SIZE
from eventcast.operators import embed, encode, evaluate, graph, regress, split
from eventcast.operators.attach import attach
from eventcast.session import stage, stage_table
from eventcast.sources import tables as T

NAMED = """named AS (SELECT *, 'Date|' || strftime(date, '%Y-%m-%d') AS dn,
  'Location|' || country_txt || '|' || region_txt || '|' || city AS ln, 'AttackType|' || attacktype1_txt AS tn FROM feat)"""
GRAPH = Q.FEAT + f""", {NAMED},
nodes AS (SELECT DISTINCT dn AS id, 'Date' AS node_type FROM named UNION ALL
  SELECT DISTINCT ln, 'Location' FROM named UNION ALL SELECT DISTINCT tn, 'AttackType' FROM named),
edges AS (SELECT DISTINCT dn AS src, ln AS dst FROM named UNION ALL SELECT DISTINCT ln, tn FROM named),
links AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (SELECT src AS id, count(*) AS degree FROM links GROUP BY 1)"""
# The smallest date node, from the data.
CENTRE = "(SELECT min(dn) FROM named)"


def _graph(s, d):
    events = T.featured_incidents(s, d)
    return graph.build_nodes(events), graph.build_edges(events)


def _centre(edges):
    """The smallest date node."""
    return edges.filter(F.col("src").startswith("Date|")).agg(F.min("src")).first()[0]


def _edges(s, d):
    return graph.build_edges(T.featured_incidents(s, d)).select("src", "dst")


@query("n1_nodes", "id string, node_type string", f"WITH {GRAPH} SELECT * FROM nodes")
def n1(s, d):
    return graph.build_nodes(T.incidents(s, d, casualties=False))


@query("n2_edges", "src string, dst string, killed double, wounded double, total_casualties double, weapon_type string",
       f"""WITH {GRAPH} SELECT src, dst, NULL AS killed, NULL AS wounded, NULL AS total_casualties, NULL AS weapon_type
       FROM (SELECT DISTINCT dn AS src, ln AS dst FROM named) UNION ALL
       SELECT ln, tn, nkill, nwound, casualties, weaptype1_txt FROM (
         SELECT *, row_number() OVER (PARTITION BY ln, tn ORDER BY date DESC, eventid DESC) AS rn FROM named) WHERE rn = 1""")
def n2(s, d):
    return graph.build_edges(T.featured_incidents(s, d)).select("src", "dst", "attrs.*")


@query("n3_graph_size", "nodes long, edges long",
       f"WITH {GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def n3(s, d):
    return graph.graph_size(*_graph(s, d))


@query("n4_degree", "id string, node_type string, degree long",
       f"WITH {GRAPH} SELECT id, node_type, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id)")
def n4(s, d):
    return graph.node_degrees(*_graph(s, d))


def _reached(radius: int) -> str:
    return f"""reach(id, hop) AS (SELECT {CENTRE}, 0
      UNION SELECT l.dst, r.hop + 1 FROM reach r JOIN links l ON l.src = r.id WHERE r.hop < {radius}),
    ego AS (SELECT DISTINCT id FROM reach)"""


@query("n5_ego_nodes_1", "id string", f"WITH RECURSIVE {GRAPH}, {_reached(1)} SELECT id FROM ego")
def n5(s, d):
    edges = stage_table(_edges(s, d))
    return graph.ego_nodes(edges, _centre(edges), 1)


@query("n5_ego_nodes_2", "id string", f"WITH RECURSIVE {GRAPH}, {_reached(2)} SELECT id FROM ego")
def n5_two(s, d):
    edges = stage_table(_edges(s, d))
    return graph.ego_nodes(edges, _centre(edges), 2)


@query("n6_induced_subgraph", "src string, dst string",
       f"""WITH RECURSIVE {GRAPH}, {_reached(2)} SELECT src, dst FROM edges
       WHERE src IN (SELECT id FROM ego) AND dst IN (SELECT id FROM ego)""")
def n6(s, d):
    edges = stage_table(_edges(s, d))
    return graph.induced_subgraph(edges, graph.ego_nodes(edges, _centre(edges), 2))


@query("n7_degree_centrality", "id string, degree long, centrality r6",
       f"""WITH {GRAPH} SELECT id, coalesce(degree, 0) AS degree,
       coalesce(degree, 0) / ((SELECT count(*) FROM nodes) - 1) AS centrality FROM nodes LEFT JOIN deg USING (id)""")
def n7(s, d):
    return graph.degree_centrality(*_graph(s, d))


@query("k7_top_nodes", "id string, centrality r6",
       f"""WITH {GRAPH} SELECT id, degree / ((SELECT count(*) FROM nodes) - 1) AS centrality FROM nodes JOIN deg USING (id)
       ORDER BY centrality DESC, id LIMIT 11""")
def k7(s, d):
    return graph.most_central(*_graph(s, d))


@query("n8_edge_index", "src_index long, dst_index long",
       f"""WITH {GRAPH}, idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes)
       SELECT a.i AS src_index, b.i AS dst_index FROM edges JOIN idx a ON a.id = src JOIN idx b ON b.id = dst""")
def n8(s, d):
    return graph.index_graph(*_graph(s, d))[1]


@query("n8_node_index", "id string, node_index long",
       f"WITH {GRAPH} SELECT id, row_number() OVER (ORDER BY id) - 1 AS node_index FROM nodes")
def n8_nodes(s, d):
    return graph.index_graph(*_graph(s, d))[0]


def _node_features(s, d):
    """Mean killed and wounded of the events at each node."""
    events = graph.with_node_ids(T.featured_incidents(s, d))
    at = events.select("nkill", "nwound", F.explode(F.array("date_node", "location_node", "type_node")).alias("id"))
    return at.groupBy("id").agg(F.avg("nkill").alias("killed"), F.avg("nwound").alias("wounded"))


def _hop(k: int, source: str) -> str:
    return f"""hop{k} AS (SELECT v.id, v.d, (v.h / sqrt(v.d) + coalesce(s.t, 0)) / sqrt(v.d) AS h FROM {source} v LEFT JOIN
      (SELECT l.dst AS id, sum(u.h / sqrt(u.d)) AS t FROM links l JOIN {source} u ON u.id = l.src GROUP BY 1) s USING (id))"""


HOP0 = """touched AS (SELECT nkill, dn AS id FROM named UNION ALL SELECT nkill, ln FROM named UNION ALL SELECT nkill, tn FROM named),
hop0 AS (SELECT id, 1 + coalesce(any_value(degree), 0) AS d, avg(nkill) AS h FROM touched LEFT JOIN deg USING (id) GROUP BY id)"""


@query("n9_propagate_1", "id string, killed r6", f"WITH {GRAPH}, {HOP0}, {_hop(1, 'hop0')} SELECT id, h AS killed FROM hop1")
def n9_one(s, d):
    return graph.propagate(_node_features(s, d), _edges(s, d), ["killed"], 1)


@query("n9_propagate_3", "id string, killed r6",
       f"WITH {GRAPH}, {HOP0}, {_hop(1, 'hop0')}, {_hop(2, 'hop1')}, {_hop(3, 'hop2')} SELECT id, h AS killed FROM hop3")
def n9(s, d):
    return graph.propagate(_node_features(s, d), _edges(s, d), ["killed", "wounded"], 3)


@query("n10_node_classification", "eventid long, truth string, predicted string")
def n10(s, d):
    """Attack type from row features and propagated place features; the label is no feature.

    The graph here leaves out the type nodes, which would carry the label.
    """
    classes = ["weaptype1_txt", "targtype1_txt", "country_txt"]
    wanted = ["eventid", "date_node", "location_node", "attacktype1_txt", "city", *classes,
              "nkill", "nwound", "latitude", "longitude"]
    # Read by every step below, so the joins behind it run once.
    events = stage_table(graph.with_node_ids(T.featured_incidents(s, d)).select(*wanted))
    events = stage_table(split.random_split(events, "eventid"))
    edges = events.select(F.col("date_node").alias("src"), F.col("location_node").alias("dst")).distinct()
    at = events.select("nkill", "nwound", F.explode(F.array("date_node", "location_node")).alias("id"))
    means = at.groupBy("id").agg(F.avg("nkill").alias("killed"), F.avg("nwound").alias("wounded"))
    spread = graph.propagate(means, edges, ["killed", "wounded"], 3)
    places = spread.select(
        F.col("id").alias("location_node"), F.col("killed").alias("near_killed"), F.col("wounded").alias("near_wounded")
    )
    codes = encode.fit_label_codes(events, ["attacktype1_txt", *classes])
    rows = attach(encode.apply_label_codes(events, codes, ["attacktype1_txt", *classes]), places, "location_node")
    # Narrow rows, without the ids and texts of the joins; the scaler, the encoder and the fit read them again.
    rows = stage_table(rows.drop("date_node", "location_node", "attacktype1_txt", *classes))
    numeric = ["nkill", "nwound", "latitude", "longitude", "near_killed", "near_wounded"]
    seen = stage(encode.fit_scaler(rows.filter(F.col("split") == "train"), numeric))
    rows = encode.apply_scaler(rows, seen, numeric, "standard")
    cities = embed.fit_word_vectors(events.select(F.array("city").alias("tokens")), "tokens", VECTOR_SIZE)
    hot = OneHotEncoder(inputCols=[f"{c}_encoded" for c in classes], outputCols=[f"{c}_hot" for c in classes], dropLast=False)
    encoder = hot.fit(rows)
    rows = embed.attach_vectors(rows, cities, "city", VECTOR_SIZE, "_city").withColumn("city_vector", array_to_vector("_city"))
    rows = encoder.transform(rows)
    vectors = VectorAssembler(inputCols=[*numeric, *hot.getOutputCols(), "city_vector"], outputCol="features").transform(rows)
    found = regress.classify(
        vectors.select("eventid", "split", "features", "attacktype1_txt_encoded"), "features", "attacktype1_txt_encoded"
    )
    named = encode.decode_labels(found, codes, "attacktype1_txt", "predicted_code", "predicted")
    return encode.decode_labels(named, codes, "attacktype1_txt", "attacktype1_txt_encoded", "truth")


@query("n10_classification_scores", "accuracy r6, precision r6, recall r6, f1 r6")
def n10_scores(s, d):
    return evaluate.classification_scores(evaluate.label_pairs(n10(s, d), "truth", "predicted"))
