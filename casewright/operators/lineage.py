"""Process hierarchy: nodes, flags, ancestors and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.ordering import numbered_within
from casewright.schema import make_items, severity_name, severity_rank
from casewright.session import checkpointed

PROCESS_TYPES = ["process", "memprocfs_process"]


def process_nodes(items: DataFrame) -> DataFrame:
    """One row for each process id of a case: the strongest severity, all matches, and the first name, parent and id."""
    match = F.col("ioc_match") if "ioc_match" in items.columns else F.array().cast("array<string>")
    pid, ppid = (F.nullif(F.regexp_extract("value", rf"(?:^|[^P]){p}[:\s]+(\d+)" if p == "PID" else rf"{p}[:\s]+(\d+)", 1), F.lit("")) for p in ("PID", "PPID"))
    name = F.coalesce(F.nullif(F.split_part(F.trim("value"), F.lit(" "), F.lit(1)), F.lit("")), F.col("artifact_id"))
    rows = items.where(F.col("evidence_type").isin(PROCESS_TYPES)).select("case_id", "seq", pid.alias("pid"), ppid.alias("ppid"), name.alias("name"), severity_rank(F.lower("severity")).alias("rank"), "artifact_id", "source_tool", match.alias("m")).where("pid is not null")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq")))
    per = rows.groupBy("case_id", "pid").agg(first("ppid").alias("ppid"), first("name").alias("name"), F.max("rank").alias("severity_rank"), first("artifact_id").alias("artifact_id"), first("source_tool").alias("source_tool"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("m")))).alias("ioc_match"), F.min("seq").alias("first_seq"))
    return per.withColumn("severity", severity_name(F.col("severity_rank")))


def lineage_children(items: DataFrame) -> DataFrame:
    """The child process ids of relation rows: from the last link, else from the id."""
    last = F.regexp_extract(F.coalesce(F.try_element_at("linked_artifacts", F.lit(-1)), F.lit("")), r"(\d+)", 1)
    in_id = F.regexp_extract("artifact_id", r"relation_\d+_(\d+)", 1)
    return items.where("evidence_type = 'process_relation'").select("case_id", F.coalesce(F.nullif(last, F.lit("")), F.nullif(in_id, F.lit(""))).alias("pid")).where("pid is not null").distinct()


def flagged(nodes: DataFrame, children: DataFrame | None = None, anomalies: DataFrame | None = None) -> DataFrame:
    """Adds is_flagged: high or critical, a child of a suspicious pair, anomalous, or matched."""
    out = nodes.withColumn("_f", (F.col("severity_rank") >= 4) | (F.size("ioc_match") > 0))
    for extra, key in ((children, "pid"), (anomalies, "artifact_id")):
        if extra is not None:
            out = out.join(extra.select("case_id", key, F.lit(True).alias("_x")).distinct(), ["case_id", key], "left").withColumn("_f", F.col("_f") | F.coalesce("_x", F.lit(False))).drop("_x")
    return out.withColumnRenamed("_f", "is_flagged")


def _parents(nodes: DataFrame) -> DataFrame:
    """case_id, pid and up: the parent's id, null for roots (no parent, an unknown one, or the node itself)."""
    known = nodes.select("case_id", F.col("pid").alias("up")).distinct()
    wanted = nodes.select("case_id", "pid", F.when(F.col("ppid") != F.col("pid"), F.col("ppid")).alias("up"))
    return wanted.join(known.withColumn("_known", F.lit(True)), ["case_id", "up"], "left").select("case_id", "pid", F.when(F.col("_known"), F.col("up")).alias("up"))


def ancestor_closure(nodes: DataFrame) -> DataFrame:
    """Nodes that are flagged or an ancestor of a flagged one, at any depth; circles of parents end where they close.

    Pointer doubling: each round marks the nodes that lie as far above the
    marked ones as the jumps reach, and doubles the jumps. A chain of a
    million generations takes twenty rounds, each cut by a checkpoint.
    """
    jumps = checkpointed(_parents(nodes).where("up is not null"))
    marked = checkpointed(nodes.where("is_flagged").select("case_id", "pid").distinct())
    n = marked.count()
    while n:
        above = marked.join(jumps, ["case_id", "pid"]).select("case_id", F.col("up").alias("pid"))
        marked = checkpointed(marked.union(above).distinct())
        before, n = n, marked.count()
        if n == before:
            break
        jumps = checkpointed(jumps.join(jumps.select("case_id", F.col("pid").alias("up"), F.col("up").alias("next")), ["case_id", "up"]).select("case_id", "pid", F.col("next").alias("up")))
    return nodes.join(marked, ["case_id", "pid"], "left_semi")


def tree_order(nodes: DataFrame, most: int | None = 40) -> DataFrame:
    """Nodes depth first with depth, path (ids from the root on) and row; children in first-seen order; the report shows `most` rows.

    With most=None all nodes are numbered, by range partitions of their paths;
    otherwise Spark limits the rows before the shuffle. Neither sorts a case in one task.

    Paths grow by pointer doubling: each round puts the path of the node that
    a jump reaches in front and doubles the jump, so the rounds grow with the
    logarithm of the depth. Nodes of a circle, and those below one, have no
    path and follow after all others.
    """
    parents = nodes.select("case_id", "pid", "first_seq").join(_parents(nodes), ["case_id", "pid"])
    step = F.struct(F.when(F.col("up").isNotNull(), F.col("first_seq")).alias("seq"), F.col("pid"))  # roots by id, children in first-seen order
    paths = checkpointed(parents.select("case_id", "pid", "up", F.array(step).alias("path")))
    left = paths.where("up is not null").count()
    while left:
        above = paths.select("case_id", F.col("pid").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"))
        longer = paths.where("up is not null").join(above, ["case_id", "up"]).select("case_id", "pid", F.col("next").alias("up"), F.concat("front", "path").alias("path"))
        done = paths.where("up is null")
        paths = checkpointed(done.unionByName(longer))
        before, left = left, paths.where("up is not null").count()
        if left == before:  # only circles are left, and what hangs on them
            break
    walk = paths.where("up is null").select("case_id", "pid", F.col("path").alias("_p"))
    out = nodes.join(walk, ["case_id", "pid"], "left").withColumn("depth", F.coalesce(F.size("_p") - 1, F.lit(0)))
    order = [F.col("_p").asc_nulls_last(), F.col("pid")]
    if most is None:
        out = numbered_within(out, ["case_id"], *order, name="row")
    else:
        out = out.withColumn("row", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where(F.col("row") <= most)
    return out.withColumn("path", F.array_join(F.transform("_p", lambda s: s["pid"]), ".")).drop("_p")


def tree_summaries(processes: DataFrame, most_depth: int = 5) -> DataFrame:
    """One process_tree row for each root, its value the tree below it as indented text down to most_depth.

    processes: case_id, pid, ppid, name, first_seq. A root's parent is unknown;
    children come in first-seen order. One join for each level, so circles,
    which no root reaches, are never entered.
    """
    known = processes.select("case_id", F.col("pid").alias("ppid")).distinct()
    step = F.array(F.struct("first_seq", "pid"))
    roots = processes.join(known, ["case_id", "ppid"], "left_anti")
    level = checkpointed(roots.select("case_id", F.col("pid").alias("root"), "pid", "name", step.alias("path")))
    every, children = level, processes.select("case_id", F.col("ppid").alias("up"), "pid", "name", step.alias("step"))
    for _ in range(most_depth):
        above = level.select("case_id", "root", F.col("pid").alias("up"), "path")
        level = checkpointed(children.join(above, ["case_id", "up"]).select("case_id", "root", "pid", "name", F.concat("path", "step").alias("path")))
        every = every.unionByName(level)
    line = F.concat(F.repeat(F.lit("  "), F.size("path") - 1), "name", F.lit(" (PID:"), "pid", F.lit(")"))
    whole = every.withColumn("line", line).groupBy("case_id", "root").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY path)").alias("text"))
    return make_items(whole, F.concat(F.lit("process_tree_"), "root"), "volatility3", "process_tree", F.col("text"), "medium", 0.95, keep=("case_id",))
