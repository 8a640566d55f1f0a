"""Records for visualisation: built by joins, written as JSON, read back, and laid out as a plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.functions.colors import channels, rgb_text

SCHEMA = "id string, x double, y double, title string, description string, color string"
TEST_SUFFIX = " - TEST POINT"


def _ranked(categories: DataFrame) -> DataFrame:
    """(category, rank, n): categories are few; their ranks colour them."""
    own = categories.select("category").filter(F.col("category").isNotNull()).distinct()
    return own.select("category", (F.row_number().over(Window.orderBy("category")) - 1).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))


def viz_records(docs: DataFrame, coords: DataFrame, labels: DataFrame, names: DataFrame | None = None, test_coords: DataFrame | None = None) -> DataFrame:
    """(id, x, y, title, description, color) of every document with coordinates and a category.

    docs: (doc_id, text); labels: (doc_id, category); names: (category, name), whose categories are the ones coloured if given. The title names the category.
    """
    ranks = _ranked(labels if names is None else names)
    if names is not None:
        ranks = ranks.join(names.select("category", "name"), "category")
    else:
        ranks = ranks.withColumn("name", F.col("category").cast("string"))
    every = coords.select("doc_id", "x", "y", F.lit("").alias("suffix"))
    if test_coords is not None:
        every = every.unionByName(test_coords.select("doc_id", "x", "y", F.lit(TEST_SUFFIX).alias("suffix")))
    found = every.join(docs.select("doc_id", "text"), "doc_id").join(labels.select("doc_id", "category"), "doc_id").join(F.broadcast(ranks), "category")
    title = F.concat(F.col("doc_id").cast("string"), F.lit(" ("), F.col("name"), F.lit(")"), F.col("suffix"))
    return found.select(F.col("doc_id").alias("id"), "x", "y", title.alias("title"), F.col("text").alias("description"), rgb_text(F.col("rank"), F.col("n")).alias("color"))


def write_json_lines(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_json_array(records: DataFrame, path: str) -> None:
    """One array in one file, in the order of ids, as a page can show it; on any file system that Spark writes to. Records pass through the driver one partition at a time."""
    spark = records.sparkSession
    lines = records.select("id", "x", "y", "title", "description", "color").orderBy("id").select(F.to_json(F.struct("*")).alias("value"))
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, True)
    try:
        head, waiting, size = "[\n", [], 0
        for row in lines.toLocalIterator():
            waiting.append(head + row.value)
            head, size = ",\n", size + len(row.value)
            if size > 1_000_000:
                stream.write(bytearray("".join(waiting).encode()))
                waiting, size = [], 0
        stream.write(bytearray(("".join(waiting) + ("[\n" if head[0] == "[" else "") + "\n]").encode()))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records from an array or from lines, with the category taken from the title: what follows the last bracket, less a character."""
    records = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    tail = F.substring_index("title", "(", -1)
    return records.withColumn("category", F.regexp_replace(tail, rf"\)({TEST_SUFFIX})?$", ""))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    records = spark.read.schema(SCHEMA).json(path)
    return records.withColumn("category", F.regexp_replace(F.substring_index("title", "(", -1), rf"\)({TEST_SUFFIX})?$", ""))


def plot_spec(coords: DataFrame, labels: DataFrame, names: DataFrame | None = None, test_coords: DataFrame | None = None) -> DataFrame:
    """(series, category, alpha, r, g, b, x, y, x_low, x_high, y_low, y_high): a scatter plot, one series for each category; limits are those of the training points."""
    ranks = _ranked(labels if names is None else names)
    every = coords.select("doc_id", "x", "y", F.lit(0.6).alias("alpha"))
    if test_coords is not None:
        every = every.unionByName(test_coords.select("doc_id", "x", "y", F.lit(1.0).alias("alpha")))
    ends = coords.agg(F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.min("y").alias("y_low"), F.max("y").alias("y_high"))
    r, g, b = channels(F.col("rank").cast("double"), F.col("n"))
    found = every.join(labels.select("doc_id", "category"), "doc_id").join(F.broadcast(ranks), "category").crossJoin(ends)
    return found.select(F.col("rank").alias("series"), "category", "alpha", r.alias("r"), g.alias("g"), b.alias("b"), "x", "y", "x_low", "x_high", "y_low", "y_high")


#: Points that a picture takes.
MOST_POINTS = 200_000


def draw(spec: DataFrame, path: str, title: str = "") -> None:
    """The plot as a picture; needs matplotlib. More than MOST_POINTS points raise ValueError."""
    from matplotlib.figure import Figure

    points = spec.limit(MOST_POINTS + 1).toPandas()
    if len(points) > MOST_POINTS:
        raise ValueError(f"a picture takes {MOST_POINTS} points at most")
    figure = Figure()
    axes = figure.add_subplot()
    for (_, category, alpha), own in points.groupby(["series", "category", "alpha"]):
        axes.scatter(own.x, own.y, color=[own[["r", "g", "b"]].iloc[0].tolist()], alpha=alpha, label=str(category))
    axes.set_xticks([])
    axes.set_yticks([])
    if len(points):
        axes.set(xlim=(points.x_low[0], points.x_high[0]), ylim=(points.y_low[0], points.y_high[0]), title=title)
        figure.legend(loc="outside right upper")
    figure.savefig(path, bbox_inches="tight")


def json_to_plot(spark: SparkSession, source: str, path: str | None = None, title: str = "", names: list[str] | None = None) -> DataFrame:
    """The plot of records that write_json_array() wrote, drawn to path if one is given. Categories are those of the titles, in their order, or names in theirs;
    records of other categories are left out then."""
    records = read_json(spark, source)
    coords = records.select(F.col("id").alias("doc_id"), "x", "y")
    labels = records.select(F.col("id").alias("doc_id"), "category")
    listed = None
    if names is not None:
        listed = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "number int, name string")
        labels = labels.join(F.broadcast(listed), labels.category == listed.name).select("doc_id", F.col("number").alias("category"))
        spec = plot_spec(coords, labels, listed.select(F.col("number").alias("category"), "name"))
        spec = spec.join(F.broadcast(listed), spec.category == listed.number).select(*[F.col("name").alias("category") if c == "category" else spec[c] for c in spec.columns])
    else:
        spec = plot_spec(coords, labels)
    if path is not None:
        draw(spec, path, title)
    return spec
