"""Which processes, threads and mappings belong to what is traced (STR8, JN13)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathglass.operators.records import process_tree
from pathglass.storage import counted, cut

# The command name under which a launched workload is first seen, and
# how much of a command name the kernel keeps.
LAUNCHER, COMM_LENGTH = "perf-exec", 15


class Traced(NamedTuple):
    """``processes``: (pid, exec_seq, exec_ns), of which both may be null; ``excluded``: (pid, tid); ``tree``: (pid),
    all that was forked, whether or not it has executed the target."""

    processes: DataFrame
    excluded: DataFrame
    gated: bool
    tree: DataFrame


def traced(records: DataFrame, root_pid: int | None = None, target: str | None = None) -> Traced:
    """The traced tree: an attached process, or the launched ones, and everything they fork.

    With ``target`` (a launched program's path) a process counts once it has executed
    the target, or if a process that had forked it. Threads that a process made
    before are excluded for good, unless they exit. Side records alone decide;
    rounds follow the depth of the tree.
    """
    tasks = records.filter("record_type = 'task' and pid is not null").select("seq", "pid", "tid", "ppid", "task_kind", "comm", "time_ns")
    roots = tasks.filter(F.col("comm") == LAUNCHER).select("pid") if root_pid is None else records.sparkSession.createDataFrame([(root_pid,)], "pid int")
    forks = cut(tasks.filter("task_kind = 'fork' and ppid is not null and ppid <> pid").select(F.col("ppid").alias("parent"), F.col("pid").alias("child"), "seq"), "forks")
    tree = process_tree(forks.select("parent", "child"), roots).select("pid")
    if target is None:
        nobody = tasks.select("pid", "tid").limit(0)
        return Traced(tree.withColumns({"exec_seq": F.lit(None).cast("long"), "exec_ns": F.lit(None).cast("long")}), nobody, False, tree)
    name = target.rsplit("/", 1)[-1][:COMM_LENGTH]
    runs = tasks.filter((F.col("comm") == name) & F.col("task_kind").isin("comm", "exec")).join(tree, "pid").groupBy("pid").agg(F.min("seq").alias("exec_seq"), F.max_by("time_ns", "seq").alias("exec_ns"))
    done = cut(runs, "executed")
    front = done
    while True:
        step = front.select(F.col("pid").alias("parent"), "exec_seq").join(forks, "parent").filter("seq > exec_seq").groupBy(F.col("child").alias("pid")).agg(F.min("seq").alias("exec_seq"))
        front = cut(step.withColumn("exec_ns", F.lit(None).cast("long")).join(done.select("pid"), "pid", "left_anti"), "executed-front")
        if front.isEmpty():
            break
        done = cut(done.unionByName(front), "executed")
    made = tasks.filter("task_kind = 'fork' and ppid = pid and tid <> pid").select("pid", "tid", "seq").join(tree, "pid").join(done.select("pid", "exec_seq"), "pid", "left")
    early = made.filter("exec_seq is null or seq < exec_seq").groupBy("pid", "tid").agg(F.max("seq").alias("made"))
    left = tasks.filter("task_kind = 'exit'").groupBy("pid", "tid").agg(F.max("seq").alias("left"))
    excluded = early.join(left, ["pid", "tid"], "left").filter("left is null or left < made").select("pid", "tid")
    return Traced(done, excluded, True, tree)


def live(records: DataFrame, what: Traced) -> tuple[DataFrame, DataFrame]:
    """(records, foreign): without samples and errors of other tasks, task records of other processes and mappings
    from before the target; foreign counts samples by pid.

    Records of lost data, and errors that name no process, stay; an error that names a
    process but no thread of it goes.
    """
    processes, excluded = counted(cut(what.processes, "traced")), counted(cut(what.excluded, "excluded"))
    tree = counted(cut(what.tree.select("pid"), "tree-pids")).withColumn("forked", F.lit(True))
    marked = records.join(processes.withColumn("in_tree", F.lit(True)), "pid", "left").join(excluded.withColumn("early", F.lit(True)), ["pid", "tid"], "left").join(tree, "pid", "left")
    sample, mapping, error, task = (F.col("record_type") == t for t in ("sample", "mmap", "decoder_error", "task"))
    belongs = F.coalesce("in_tree", F.lit(False))
    runs = belongs & F.col("early").isNull()
    mapped = belongs if not what.gated else belongs & (F.col("exec_ns").isNull() | F.coalesce(F.col("time_ns") >= F.col("exec_ns"), F.lit(False)))
    keep = F.when(sample, runs).when(mapping, mapped).when(error, F.col("pid").isNull() | (F.col("tid").isNotNull() & runs)).when(task, F.coalesce("forked", F.lit(False))).otherwise(True)
    foreign = marked.filter(sample & ~runs).groupBy("pid").agg(F.count(F.lit(1)).alias("samples"))
    return marked.filter(keep).drop("in_tree", "early", "forked", "exec_seq", "exec_ns"), foreign
