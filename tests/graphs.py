"""Hand-made graphs with answers known by construction: (undirected weighted edges, vertices)."""

PATH5 = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)]
STAR6 = [(0, i, 1.0) for i in range(1, 6)]
TIE = [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)]
DETOUR = [(0, 1, 10.0), (0, 2, 1.0), (2, 1, 1.0)]
SPLIT = [(0, 1, 1.0), (2, 3, 1.0)]
MULTI = [(0, 1, 5.0), (0, 1, 2.0), (1, 1, 1.0), (1, 2, 1.0)]
ZERO = [(0, 1, 0.0), (1, 2, 0.0)]
CYCLE8 = [(i, (i + 1) % 8, 1.0) for i in range(8)]


def make(spark, rows, extra=()):
    from graphloom.model import WEIGHTED_EDGE_SCHEMA, Graph

    g = Graph.from_edges(spark.createDataFrame(rows, WEIGHTED_EDGE_SCHEMA))
    if extra:
        g = Graph(g.edges, g.vertices.unionAll(spark.createDataFrame([(i,) for i in extra], "id long")))
    return g


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
