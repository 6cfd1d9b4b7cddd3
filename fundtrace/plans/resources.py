"""What a query costs besides time: the tasks' own metrics, from the status that Spark keeps of its stages."""

from contextlib import contextmanager

from pyspark.sql import SparkSession

METRICS = ("cpu_s", "shuffle_mb", "spill_mb", "peak_memory_mb", "gc_s", "tasks")


@contextmanager
def measured(spark: SparkSession, group: str):
    """Runs its block as a job group, and gives a dictionary that holds METRICS of the group's stages afterwards; skipped stages cost nothing."""
    sc, out = spark.sparkContext, dict.fromkeys(METRICS, 0.0)
    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, group)
    try:
        yield out
    finally:
        for k, v in before.items():
            sc.setLocalProperty(k, v)
        jsc = sc._jsc.sc()
        jsc.listenerBus().waitUntilEmpty(30_000)
        status, tracker = jsc.statusStore(), sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        for stage in sorted(stages):
            attempts = status.stageData(stage, False, sc._jvm.java.util.ArrayList(), False, sc._gateway.new_array(sc._jvm.double, 0))
            for i in range(attempts.size()):
                s = attempts.apply(i)
                out["cpu_s"] += s.executorCpuTime() / 1e9
                out["shuffle_mb"] += s.shuffleWriteBytes() / 1e6
                out["spill_mb"] += s.diskBytesSpilled() / 1e6
                out["peak_memory_mb"] = max(out["peak_memory_mb"], s.peakExecutionMemory() / 1e6)
                out["gc_s"] += s.jvmGcTime() / 1e3
                out["tasks"] += s.numCompleteTasks()
        out.update({k: round(v, 3) for k, v in out.items()})
