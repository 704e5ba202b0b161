"""Content graph walks, path indexes and entry pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.detect import file_extension
from tessera.storage import kept, new_folder

HTML = ("html", "htm", "xhtml")
#: Extensions of paths worth an entry in the path index; fixed values.
INDEXED = (
    "html", "htm", "xhtml", "txt", "md", "markdown", "srt", "vtt", "pdf", "epub", "jpg", "jpeg", "png", "gif", "webp", "avif", "svg",
)


def reachable(roots: DataFrame, edges: DataFrame, most_rounds: int | None = None, merge_every: int = 8, most_nodes: int | None = None) -> DataFrame:
    """G1: (owner, cid) of all items that an owner's roots reach, the roots included.

    A frontier per round: its join with the edges, less what has been visited. The walk goes on
    until a round finds nothing new; with ``most_rounds`` it raises an error if that bound comes
    first, and never returns a part. With ``most_nodes`` an owner that has reached more goes no
    further: it has that many nodes and the rest of its last level at most. Rounds are written to the shared folder and merged into one
    table every few rounds, so neither lineage nor the number of files grows with the depth.
    """
    spark, base, schema = roots.sparkSession, new_folder(roots.sparkSession, "walk"), "owner string, cid string"

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(schema).parquet(f"{base}/{name}")

    edges.select("parent_cid", "child_cid").distinct().write.parquet(f"{base}/edges")
    links = spark.read.schema("parent_cid string, child_cid string").parquet(f"{base}/edges")
    visited = frontier = put(roots.select("owner", "cid").distinct(), "0")
    number = 0
    while not frontier.isEmpty():
        number += 1
        if most_rounds is not None and number > most_rounds:
            raise RuntimeError(f"the walk has more than {most_rounds} rounds")
        step = frontier.join(links, frontier.cid == links.parent_cid).select("owner", F.col("child_cid").alias("cid")).distinct()
        frontier = put(step.join(visited, ["owner", "cid"], "left_anti"), str(number))
        visited = visited.unionByName(frontier)
        if most_nodes is not None:
            spent = visited.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_nodes)
            frontier = frontier.join(spent.select("owner"), "owner", "left_anti")
        if number % merge_every == 0:
            visited = put(visited, f"merged{number}")
    return visited


def reachable_counts(roots: DataFrame, edges: DataFrame, most_nodes: int = 10_000) -> DataFrame:
    """G1: (owner, nodes, truncated): how many items an owner reaches, up to ``most_nodes``, and whether there are more."""
    per = reachable(roots, edges, most_nodes=most_nodes).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return per.select("owner", F.least("n", F.lit(most_nodes)).alias("nodes"), (F.col("n") > most_nodes).alias("truncated"))


def is_directory(kind: Column, name: Column) -> Column:
    """Directories, and links of unknown type without a dot in their name."""
    return (kind == "dir") | ((kind == "unknown") & ~F.contains(name, F.lit(".")))


def path_index(listing: DataFrame, roots: DataFrame, max_depth: int = 10, max_files: int = 1000, max_dirs: int = 200, extensions: tuple[str, ...] = INDEXED) -> DataFrame:
    """(root_cid, path, leaf_cid, depth) of files of known extensions below every root.

    ``listing`` has (parent_cid, cid, name, type). One join a level, each level written before the
    next one reads it. A root's first ``max_dirs`` directories, itself included, are opened, level
    by level and by path; it gives ``max_files`` files at most, the shallowest first, then by path.
    """
    links = listing.select("parent_cid", "cid", "name", is_directory(F.col("type"), F.col("name")).alias("is_dir"))
    level = roots.select(F.col("cid").alias("root_cid"), F.col("cid").alias("at"), F.lit("").alias("prefix"), F.lit(1).alias("opened"))
    found = None
    for depth in range(1, max_depth + 1):
        step = level.join(links, level["at"] == links["parent_cid"]).select(
            "root_cid", "opened", "cid", "is_dir", F.concat("prefix", "name").alias("path"), F.lit(depth).alias("depth")
        )
        step = kept(step.filter(F.col("is_dir") | file_extension(F.col("path")).isin(*extensions)), f"level{depth}")
        files = step.filter(~F.col("is_dir")).select("root_cid", "path", F.col("cid").alias("leaf_cid"), "depth")
        found = files if found is None else found.unionByName(files)
        place = F.row_number().over(Window.partitionBy("root_cid").orderBy("path"))
        dirs = step.filter("is_dir").withColumn("n", F.col("opened") + place).filter(F.col("n") <= max_dirs)
        opened = dirs.groupBy("root_cid").agg(F.max("n").alias("_opened"))
        level = dirs.join(opened, "root_cid").select(
            "root_cid", F.col("cid").alias("at"), F.concat("path", F.lit("/")).alias("prefix"), F.col("_opened").alias("opened")
        )
        if depth < max_depth:
            level = kept(level, f"open{depth}")
            if level.isEmpty():
                break
    rank = F.row_number().over(Window.partitionBy("root_cid").orderBy("depth", "path"))
    return found.withColumn("r", rank).filter(F.col("r") <= max_files).drop("r")


def html_entry_score(path: Column) -> Column:
    """An index page at the root, then one below, then any HTML page, shorter paths first; null for others."""
    p = F.lower(F.trim(path))
    score = (
        100
        + F.when(p.isin("index.html", "index.htm"), 1000).otherwise(0)
        + F.when(p.rlike(r"/index\.html?$"), 500).otherwise(0)
        - F.size(F.split(p, "/"))
    )
    return F.when(p.rlike(r"\.html?$"), score)


def html_entries(listing: DataFrame, roots: DataFrame, max_depth: int = 3, max_dirs: int = 25, max_files: int = 200) -> DataFrame:
    """(root_cid, path, leaf_cid, score) of the best HTML entry below each directory.

    A breadth-first search over ``max_depth`` levels of files in the first ``max_dirs`` directories;
    of equal scores the shallowest, then the first by path.
    """
    files = path_index(listing, roots, max_depth, max_files, max_dirs, ("html", "htm"))
    rows = files.withColumn("score", html_entry_score(F.col("path")))
    best = F.row_number().over(Window.partitionBy("root_cid").orderBy(F.desc("score"), "depth", "path"))
    return rows.withColumn("b", best).filter("b = 1").select("root_cid", "path", "leaf_cid", "score")


def level_entries(listing: DataFrame) -> DataFrame:
    """(parent_cid, name): each directory's index.html, else index.htm, else its first HTML file by name."""
    n = F.lower(F.trim("name"))
    rows = listing.filter((F.col("type") == "file") & n.rlike(r"\.html?$"))
    order = F.struct(F.when(n == "index.html", 0).when(n == "index.htm", 1).otherwise(2), "name")
    return rows.groupBy("parent_cid").agg(F.min_by("name", order).alias("name"))


def top_children(edges: DataFrame, last_seen: str, limit: int) -> DataFrame:
    """A parent's children, the newest first, then by id."""
    rank = F.row_number().over(Window.partitionBy("parent_cid").orderBy(F.desc(last_seen), "child_cid"))
    return edges.withColumn("r", rank).filter(F.col("r") <= limit).drop("r")


def entry_score(path: Column) -> Column:
    """T5: how well a path serves as a site's entry; null for what isn't HTML."""
    p = F.lower(F.trim(path))
    score = (
        500
        + F.when(p.isin(*(f"index.{e}" for e in HTML)), 2000).otherwise(0)
        + F.when(p.rlike(r"/index\.(html|htm|xhtml)$"), 1500).otherwise(0)
        + F.when((p == "home.html") | p.endswith("/home.html"), 1200).otherwise(0)
        + F.when((p == "default.html") | p.endswith("/default.html"), 1100).otherwise(0)
        - F.size(F.split(p, "/"))
        - F.least(F.length(p), F.lit(256)) / 128.0
    )
    return F.when(file_extension(p).isin(*HTML), score)


def entry_pages(paths: DataFrame, max_depth: int = 2, most: int = 500) -> DataFrame:
    """T5: every root's best entry page among its ``most`` shallowest and shortest HTML paths."""
    rows = paths.withColumn("score", entry_score(F.col("path"))).filter(F.col("score").isNotNull() & (F.col("depth") <= max_depth))
    order = Window.partitionBy("root_cid")
    near = F.row_number().over(order.orderBy("depth", F.length("path"), "path"))
    rows = rows.withColumn("near", near).filter(F.col("near") <= most)
    best = F.row_number().over(order.orderBy(F.desc("score"), "near"))
    return rows.withColumn("b", best).filter("b = 1").select("root_cid", "path", "leaf_cid", F.round("score", 6).alias("score"))


def listing_entries(listing: DataFrame) -> DataFrame:
    """Every directory's entry by name class, then size, then name."""
    n = F.lower(F.trim("name"))
    rank = (
        F.when(n.isin(*(f"index.{e}" for e in HTML)), 100).when(n.isin("home.html", "default.html"), 90)
        .when(n.rlike(r"\.(html|htm|xhtml)$"), 80).when(n.isin("readme.md", "readme.txt"), 70)
        .when(n.rlike(r"\.(md|markdown|txt)$"), 60)
    )
    size = F.when(F.col("size") >= 0, F.col("size")).otherwise(-1)
    rows = listing.withColumns({"class": rank, "s": size, "n": n}).filter("class IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("parent_cid").orderBy(F.desc("class"), F.desc("s"), "n"))
    return rows.withColumn("f", first).filter("f = 1").select("parent_cid", "cid", "name", F.col("class").alias("score"))
