"""Domain tables derived from the provided ones by plain arithmetic, in Spark and as DuckDB common table expressions.

Every builder takes (spark, sf_dir) and derives its rows from a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Height and width of every scene.
FRAME = 128
TILE, STRIDE = 64, 48


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Rows that one task makes of its share of a table.
TASK_ROWS = 1 << 20


def dealt(rows: DataFrame, key: str, times: int, n: int | None = None) -> DataFrame:
    """Rows (``n``, if the caller knows how many) spread by ``key`` over as many tasks as it takes when each becomes ``times`` rows, so that what is made of a key stays in its task without another shuffle.

    Spark takes the size of the table before it is exploded for that after it and would broadcast cells
    and runs; the hint keeps joins of whatever is made of these rows from that.
    """
    return rows.repartition(max(1, -(-(rows.count() if n is None else n) * times // TASK_ROWS)), key).hint("merge")


def instance(spark: SparkSession, d: str) -> DataFrame:
    """Detections (``pred``) and annotations (``gt``): ``(scene, inst, label, side, x1, y1, w, h, score)``."""
    o = table(spark, d, "orders")
    return o.selectExpr(
        "o_orderkey div 50 AS scene", "o_orderkey AS inst", "o_custkey % 3 AS label", "if(o_orderkey % 2 = 0, 'gt', 'pred') AS side",
        "((o_orderkey div 2) * 37) % 80 + o_custkey % 5 AS x1", "((o_orderkey div 2) * 53) % 80 + o_custkey % 4 AS y1",
        "12 + (o_orderkey div 2) % 20 AS w", "12 + (o_orderkey div 2) % 17 AS h", "round(0.05D + ((o_orderkey * 31) % 90) / 100D, 2) AS score",
    )


def run(spark: SparkSession, d: str, times: int = 20) -> DataFrame:
    """Rows of cells of each instance: ``(scene, inst, label, side, score, y, x0, x1)``, ``x1`` exclusive, dealt for ``times`` rows that become of an instance."""
    return dealt(instance(spark, d), "scene", times).selectExpr("scene", "inst", "label", "side", "score", "explode(sequence(y1, y1 + h - 1)) AS y", "x1 AS x0", "x1 + w AS x1")


def normal(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """A unit normal for each instance: ``(scene, inst, nx, ny, nz)`` and ``more`` columns of the instance; instances take the vectors of the whole table in turn."""
    e = table(spark, d, "embeddings").selectExpr("vec_id", "double(embedding[0]) AS a", "double(embedding[1]) AS b", "abs(double(embedding[2])) AS c")
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    more = [c for c in more if c not in ("scene", "inst")]
    i = instance(spark, d).select("scene", "inst", *more, (F.col("inst") % max(1, e.count())).alias("vec_id"))
    return i.join(e, "vec_id").select("scene", "inst", *more, (F.col("a") / n).alias("nx"), (F.col("b") / n).alias("ny"), (F.col("c") / n).alias("nz"))


def vertex(spark: SparkSession, d: str, times: int = 4, key: str = "scene") -> DataFrame:
    """Four corners of each instance as a ring: ``(scene, inst, ord, x, y)``, dealt by ``key`` for ``times`` rows that become of an instance."""
    i = dealt(instance(spark, d), key, times)
    return i.selectExpr("scene", "inst", "posexplode(array(named_struct('x', x1, 'y', y1), named_struct('x', x1 + w, 'y', y1), named_struct('x', x1 + w, 'y', y1 + h), named_struct('x', x1, 'y', y1 + h))) AS (ord, p)").selectExpr("scene", "inst", "ord", "double(p.x) AS x", "double(p.y) AS y")


def skewed_vertex(spark: SparkSession, d: str, times: int = 4, key: str = "scene") -> DataFrame:
    """The same rings, each corner moved by up to a few cells, so that angles differ from 90 degrees."""
    return vertex(spark, d, times, key).selectExpr("scene", "inst", "ord", "x + (inst * 7 + ord * 3) % 5 AS x", "y + (inst * 3 + ord * 5) % 4 AS y")


def notched_vertex(spark: SparkSession, d: str, times: int = 5, key: str = "scene") -> DataFrame:
    """The skewed rings with a fifth corner inside, so that they are concave and no side is sure to be level: ``(scene, inst, ord, x, y)``."""
    corner = lambda k, x, y: f"named_struct('ord', {k}, 'x', double({x} + (inst * 7 + {k} * 3) % 5), 'y', double({y} + (inst * 3 + {k} * 5) % 4))"
    four = [corner(k, x, y) for k, (x, y) in enumerate((("x1", "y1"), ("x1 + w", "y1"), ("x1 + w", "y1 + h"), ("x1", "y1 + h")))]
    more = "named_struct('ord', 4, 'x', double(x1 + w div 3), 'y', double(y1 + h div 2))"
    return dealt(instance(spark, d), key, times).selectExpr("scene", "inst", f"inline(array({', '.join(four)}, {more}))")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Noisy points of twenty planes with outliers: ``(facet, x, y, z)``."""
    return table(spark, d, "lineitem").selectExpr("l_suppkey % 20 AS facet", "l_quantity AS x", "double(l_partkey % 64) AS y", "0.1D * l_quantity + 0.2D * double(l_partkey % 64) + 5D + (l_discount - 0.05D) + if(l_tax >= 0.08D, 15D, 0D) AS z")


def height(spark: SparkSession, d: str) -> DataFrame:
    """A 16 x 16 height raster for each of the parts: ``(sample_id, y, x, z)``."""
    return dealt(table(spark, d, "part").selectExpr("p_partkey AS sample_id", "p_size"), "sample_id", 256).selectExpr("sample_id", "p_size", "explode(sequence(0, 15)) AS y").selectExpr("sample_id", "p_size", "y", "explode(sequence(0, 15)) AS x").selectExpr("sample_id", "y", "x", "double((x * p_size + y * 3) % 17) AS z")


def sample(spark: SparkSession, d: str) -> DataFrame:
    """Manifest ids: ``(source, sample_id, has_normal)``."""
    return table(spark, d, "documents").selectExpr("lang AS source", "concat(lang, '_', doc_id) AS sample_id", "doc_id % 3 <> 0 AS has_normal")


def hard(spark: SparkSession, d: str) -> DataFrame:
    """Ids of hard samples."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return table(spark, d, "labels").where("quality = 0").join(docs, "doc_id").selectExpr("concat(lang, '_', doc_id) AS sample_id")


def log(spark: SparkSession, d: str) -> DataFrame:
    """Training-log records: ``(run, iter, key, value, ts, event_id)``."""
    e = table(spark, d, "events")
    return e.selectExpr("user_id AS run", "bigint(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS iter", "event_type AS key", "value", "ts", "event_id")


def query_score(spark: SparkSession, d: str) -> DataFrame:
    """Class logits of decoder queries: ``(sample, q, cls, logit)``."""
    e = table(spark, d, "embeddings").hint("merge")
    return e.selectExpr("label AS sample", "vec_id AS q", "posexplode(slice(embedding, 1, 6)) AS (cls, v)").selectExpr("sample", "q", "cls", "double(v) * 10D AS logit")


#: The same tables for DuckDB, each as the body of a common table expression.
CTE = {
    "instance": """SELECT o_orderkey // 50 AS scene, o_orderkey AS inst, o_custkey % 3 AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'gt' ELSE 'pred' END AS side,
        ((o_orderkey // 2) * 37) % 80 + o_custkey % 5 AS x1, ((o_orderkey // 2) * 53) % 80 + o_custkey % 4 AS y1, 12 + (o_orderkey // 2) % 20 AS w,
        12 + (o_orderkey // 2) % 17 AS h, round(0.05::DOUBLE + ((o_orderkey * 31) % 90) / 100::DOUBLE, 2) AS score FROM orders""",
    "run": "SELECT scene, inst, label, side, score, y, x1 AS x0, x1 + w AS x1 FROM (SELECT *, unnest(range(y1, y1 + h)) AS y FROM instance)",
    "normal": """SELECT scene, inst, a / n AS nx, b / n AS ny, c / n AS nz FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (
        SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, abs(embedding[3]::DOUBLE) AS c FROM embeddings) JOIN instance ON vec_id = inst % (SELECT count(*) FROM embeddings))""",
    "vertex": """SELECT scene, inst, ord, CASE WHEN ord IN (1, 2) THEN x1 + w ELSE x1 END::DOUBLE AS x, CASE WHEN ord IN (2, 3) THEN y1 + h ELSE y1 END::DOUBLE AS y
        FROM instance, (SELECT unnest(range(4))::INTEGER AS ord)""",
    "skewed_vertex": "SELECT scene, inst, ord, x + (inst * 7 + ord * 3) % 5 AS x, y + (inst * 3 + ord * 5) % 4 AS y FROM vertex",
    "notched_vertex": "SELECT * FROM skewed_vertex UNION ALL SELECT scene, inst, 4, (x1 + w // 3)::DOUBLE, (y1 + h // 2)::DOUBLE FROM instance",
    "points": """SELECT l_suppkey % 20 AS facet, l_quantity AS x, (l_partkey % 64)::DOUBLE AS y, 0.1::DOUBLE * l_quantity + 0.2::DOUBLE * (l_partkey % 64)::DOUBLE
        + 5::DOUBLE + (l_discount - 0.05::DOUBLE) + CASE WHEN l_tax >= 0.08::DOUBLE THEN 15::DOUBLE ELSE 0::DOUBLE END AS z FROM lineitem""",
    "height": """SELECT p_partkey AS sample_id, y, x, ((x * p_size + y * 3) % 17)::DOUBLE AS z FROM part, (SELECT unnest(range(16))::INTEGER AS y),
        (SELECT unnest(range(16))::INTEGER AS x)""",
    "sample": "SELECT lang AS source, lang || '_' || doc_id AS sample_id, doc_id % 3 <> 0 AS has_normal FROM documents",
    "hard": "SELECT lang || '_' || doc_id AS sample_id FROM labels JOIN documents USING (doc_id) WHERE quality = 0",
    "log": "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iter, event_type AS key, value, ts, event_id FROM events",
    "query_score": "SELECT label AS sample, vec_id AS q, cls, embedding[cls + 1]::DOUBLE * 10::DOUBLE AS logit FROM embeddings, (SELECT unnest(range(6))::INTEGER AS cls)",
    # Foreground and labels cell by cell: what the run operators compute without ever making cells.
    "cell": "SELECT scene, inst, label, side, score, y, unnest(range(x0, x1)) AS x FROM run",
    "label_cell": "SELECT scene, side, y, x, arg_max(label, inst) + 1 AS cls FROM cell GROUP BY ALL",
}


def sql(body: str, *names: str) -> str:
    """A query over the named derived tables, in the order in which they depend on each other."""
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({CTE[n]})' for n in names)}\n{body}" if names else body
