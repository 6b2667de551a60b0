"""Graph generators whose draws are hashes of (seed, edge, bit): any partitioning, one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.random import uniform
from graphloom.model import Graph
from graphloom.operators.construct import permute_ids

#: Probabilities of the quadrants; the fourth has the rest.
A, B, C = 0.57, 0.19, 0.19
SEED, MAX_SCALE = 27491095, 40
#: Draws from one 64-bit hash.
DRAWS = 4


def _check(scale: int, degree: int) -> None:
    if not 0 <= scale <= MAX_SCALE:
        raise ValueError(f"scale must be from 0 to {MAX_SCALE}")
    if degree < 1:
        raise ValueError("degree must be positive")


def rmat_edges(spark: SparkSession, scale: int, degree: int = 16, seed: int = SEED, permute: bool = True) -> DataFrame:
    """(src, dst): ``degree`` * 2^scale recursive-matrix draws, ids permuted unless told not to.

    Each bit of both ends comes from one uniform draw of 64 / DRAWS bits: the upper half for the
    source with chance 1 - A - B, and the right one for the target within the half's quadrants.
    """
    _check(scale, degree)
    edges = spark.range(degree << scale)
    edges = edges.select("id", *[F.xxhash64(F.lit(seed), F.lit(k), F.col("id")).alias(f"h{k}") for k in range(-(-scale // DRAWS))])
    bits = 64 // DRAWS
    draw = lambda bit: F.shiftrightunsigned(f"h{bit // DRAWS}", bits * (bit % DRAWS)).bitwiseAND((1 << bits) - 1)
    a, ab, abc = (F.lit(round(p * (1 << bits))) for p in (A, A + B, A + B + C))
    zero = F.lit(0).cast("long")
    src, dst = [zero], [zero]
    for bit in range(scale):
        p, place = draw(bit), 1 << (scale - 1 - bit)
        lower = p < ab
        src.append(F.when(lower, 0).otherwise(place))
        dst.append(F.when((lower & (p >= a)) | (p >= abc), place).otherwise(0))
    edges = edges.select(sum(src[1:], src[0]).alias("src"), sum(dst[1:], dst[0]).alias("dst"))
    if permute:
        edges = permute_ids(edges, 1 << scale, seed)
    # Drawn here, once: no later filter or projection repeats the draws.
    return edges.select(F.inline(F.array(F.struct("src", "dst"))))


def uniform_edges(spark: SparkSession, scale: int, degree: int = 16, seed: int = SEED) -> DataFrame:
    """(src, dst): ``degree`` * 2^scale draws of both ends, each uniform over the ids."""
    _check(scale, degree)
    end = lambda side: F.floor(uniform(seed, F.lit(side), F.col("id")) * (1 << scale)).cast("long")
    return spark.range(degree << scale).select(end("src").alias("src"), end("dst").alias("dst"))


def add_weights(edges: DataFrame, seed: int = SEED, kind: str = "uniform") -> DataFrame:
    """Weights from each row's ends: in [0, 1), or whole numbers from 1 to 255 for ``int``.

    A row and its reverse get one weight, so the result does not depend on when it is added.
    """
    if kind not in ("uniform", "int"):
        raise ValueError(f"no weights of kind {kind!r}")
    draw = uniform(seed, F.lit("w"), F.least("src", "dst"), F.greatest("src", "dst"))
    return edges.withColumn("w", draw if kind == "uniform" else (F.floor(draw * 255) + 1).cast("double"))


def generate(
    spark: SparkSession, scale: int, degree: int = 16, kind: str = "rmat", weights: str | None = "uniform", seed: int = SEED, ordered: bool = False
) -> Graph:
    """A symmetric graph without loops and repeats, over ids 0 to the greatest one drawn."""
    if kind not in ("rmat", "uniform"):
        raise ValueError(f"no generator {kind!r}")
    edges = (rmat_edges if kind == "rmat" else uniform_edges)(spark, scale, degree, seed)
    if weights is not None:
        edges = add_weights(edges, seed, weights)
    graph = Graph.from_edges(edges, dense=True)
    return graph.ordered() if ordered else graph


def file_name(scale: int, degree: int, weighted: bool, folder: str = ".") -> str:
    return f"{folder.rstrip('/')}/graph_scale{scale}_degree{degree}.{'wsg' if weighted else 'sg'}"


def main(args: list[str] | None = None) -> int:
    """Command line: write a generated graph as Parquet or as a CSR file."""
    import argparse

    from graphloom.sources.csr import write_csr

    parser = argparse.ArgumentParser(description="Generate a graph.")
    parser.add_argument("-s", "--scale", type=int, required=True)
    parser.add_argument("-k", "--degree", type=int, default=16)
    parser.add_argument("-u", "--uniform", action="store_true")
    parser.add_argument("-o", "--out", default=".")
    parser.add_argument("--format", choices=("parquet", "csr"), default="parquet")
    parser.add_argument("--unweighted", action="store_true")
    args = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    graph = generate(spark, args.scale, args.degree, "uniform" if args.uniform else "rmat", None if args.unweighted else "uniform", ordered=True)
    path = file_name(args.scale, args.degree, graph.weighted, args.out)
    if args.format == "csr":
        write_csr(graph, path)
    else:
        graph.edges.write.mode("overwrite").parquet(path.rsplit(".", 1)[0] + ".parquet")
    return 0
