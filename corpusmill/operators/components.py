"""Connected components: local union-find forests, merged level by level.

Each level runs union-find inside the partitions as they are, so a vertex with very many edges costs every
partition at most one row per partition. The roots a vertex got in different partitions are the edges of the next,
smaller level. From level two on, edges are partitioned by their larger end: every vertex that has a smaller
neighbour then disappears into it, so the levels shrink geometrically whatever the shape of the graph. Below
``finish_rows`` edges (a fixed bound) one task merges what is left. Labels come back down by one join a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmill.runtime import Stage, shuffle_partitions

#: Vertices of a local forest before it is written out and a new one begun; bounds the memory of a task.
FOREST_VERTICES = 400_000


def _forest(batches):
    import pyarrow as pa

    parent: dict = {}

    def find(v):
        root = v
        while (up := parent[root]) != root:
            root = up
        while (up := parent[v]) != root:
            parent[v] = root
            v = up
        return root

    def rows():
        names = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([find(v) for v in names], kind)], ["v", "root"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a not in parent:
                parent[a] = a
            if b not in parent:
                parent[b] = b
            ra, rb = find(a), find(b)
            if ra != rb:
                if rb < ra:
                    ra, rb = rb, ra
                parent[rb] = ra
        if len(parent) > FOREST_VERTICES:
            yield rows()
            parent.clear()
    if parent:
        yield rows()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", finish_rows: int = 200_000, max_levels: int = 60) -> DataFrame:
    """``(v, root)`` for every vertex of the edges; ``root`` is the smallest vertex of its component.

    ``a`` and ``b`` have one type (string, binary or bigint), compared bytewise or numerically. Rows with a null
    end count as absent; an edge of a vertex to itself makes a component of one; repeated edges change nothing.
    Empty edges give no rows. Raises if ``max_levels`` levels do not suffice (each removes every vertex that has a
    smaller neighbour, so 60 are enough for any graph that can be stored).
    """
    kind = edges.schema[a].dataType.simpleString()
    current = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    levels: list[Stage] = []
    for _ in range(max_levels):
        forest = current.mapInArrow(_forest, f"v {kind}, root {kind}")
        # One row for each forest that met the vertex: as many as partitions at most, never as many as edges.
        level = Stage(forest.groupBy("v").agg(F.array_sort(F.collect_set("root")).alias("roots")), "forest")
        levels.append(level)
        left = level.df.where("size(roots) > 1").select(F.col("roots")[0].alias("b"), F.explode(F.slice("roots", 2, 1 << 30)).alias("a"))
        n = left.count()
        if n == 0:
            break
        current = left.coalesce(1) if n <= finish_rows else left.repartition(shuffle_partitions(edges.sparkSession), "a")
    else:
        raise RuntimeError(f"components: {max_levels} levels were not enough")
    found = None
    for level in reversed(levels):
        here = level.df.select("v", F.col("roots")[0].alias("m"))
        if found is None:
            found = here.select("v", F.col("m").alias("root"))
        else:
            up = found.select(F.col("v").alias("m"), "root")
            found = here.join(up, "m", "left").select("v", F.coalesce("root", "m").alias("root"))
    return found
