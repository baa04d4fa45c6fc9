"""The catalogue of groups, projects, versions and scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions

STATES = ("Idle", "Started", "Running", "Aborted", "Finished")
#: State to the states that may follow it.
TRANSITIONS = {"Idle": ("Started",), "Started": ("Running", "Aborted"), "Running": ("Finished", "Aborted"), "Aborted": ("Started",), "Finished": ("Started",)}


def children(table: DataFrame, parent: str, parent_id: int) -> DataFrame:
    """(id, name) of the rows of a parent."""
    return table.where(F.col(parent) == parent_id).select("id", "name")


def add(table: DataFrame, name: str, **parent: int) -> DataFrame:
    """table with a row after its largest id."""
    new = table.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).withColumn("name", F.lit(name))
    for k, v in parent.items():
        new = new.withColumn(k, F.lit(v).cast("long"))
    return table.unionByName(new, allowMissingColumns=True)


def rename(table: DataFrame, row_id: int, name: str) -> DataFrame:
    return table.withColumn("name", F.when(F.col("id") == row_id, name).otherwise(F.col("name")))


def remove(tables: dict[str, DataFrame], level: str, row_id: int) -> dict[str, DataFrame]:
    """tables (group, project, version, scan) without a row and all below it; a table has the key of the level above."""
    levels, out = ["group", "project", "version", "scan"], dict(tables)
    gone = tables[level].where(F.col("id") == row_id).select("id")
    for k in levels[levels.index(level) :]:
        out[k] = tables[k].join(gone, "id", "left_anti")
        below = levels[levels.index(k) + 1 : levels.index(k) + 2]
        if below:
            gone = tables[below[0]].join(gone.withColumnRenamed("id", f"{k}_id"), f"{k}_id", "left_semi").select("id")
    return out


def moved(scans: DataFrame, scan_id: int, state: str) -> DataFrame:
    """scans with a scan in a new state, where its state allows that."""
    allowed = [s for s, after in TRANSITIONS.items() if state in after]
    return scans.withColumn("status", F.when((F.col("id") == scan_id) & F.col("status").isin(*allowed), state).otherwise(F.col("status")))


def restarted(scans: DataFrame, scan_id: int) -> DataFrame:
    """scans with a scan started again, whatever its state: one that is started or running is aborted first."""
    return moved(moved(scans, scan_id, "Aborted"), scan_id, "Started")


def status_log(events: DataFrame) -> DataFrame:
    """(scan_id, event_id, ts, event, status, accepted) of events (scan_id, event_id, ts, event): the status of a scan after each event, an event being the state that it is to enter, by TRANSITIONS from Idle on. An event that the status does not allow changes nothing. The events of one scan are folded in the row of the scan."""
    held = events.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event"))).alias("_e"))
    allowed = " or ".join(f"(s.status = '{state}' and e.event in ({', '.join(repr(x) for x in after)}))" for state, after in TRANSITIONS.items())
    step = f"named_struct('status', if({allowed}, e.event, s.status), 'done', concat(s.done, array(named_struct('status', if({allowed}, e.event, s.status), 'accepted', {allowed}))))"
    folded = F.expr(f"aggregate(_e, named_struct('status', 'Idle', 'done', cast(array() as array<struct<status: string, accepted: boolean>>)), (s, e) -> {step}).done")
    rows = held.select("scan_id", F.explode(F.arrays_zip(F.col("_e"), folded.alias("_d"))).alias("z"))
    return rows.select("scan_id", "z._e.event_id", "z._e.ts", "z._e.event", "z._d.status", F.coalesce("z._d.accepted", F.lit(False)).alias("accepted"))


def next_scan(scans: DataFrame) -> DataFrame:
    """The started scan with the smallest id."""
    return scans.where("status = 'Started'").orderBy("id").limit(1)


def progress(files: DataFrame) -> DataFrame:
    """(scan_id, max_count, finished_count) of files (scan_id, done)."""
    return files.groupBy("scan_id").agg(F.count("*").alias("max_count"), F.count_if("done").alias("finished_count"))


def nested(tables: dict[str, DataFrame]) -> DataFrame:
    """(group_id, project_id, version_id, scans): the hierarchy as rows with their scans in an array."""
    v = tables["version"].select(F.col("id").alias("version_id"), "project_id")
    p = tables["project"].select(F.col("id").alias("project_id"), "group_id")
    s = tables["scan"].groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("scans"))
    return v.join(p, "project_id").join(s, "version_id", "left").select("group_id", "project_id", "version_id", "scans")


LEVELS = ("group", "project", "version", "scan")


def save(tables: dict[str, DataFrame], path: str, base: int | None = None) -> int:
    """Stores the catalogue's tables, or some of them, as the version after base and gives its number; base is the version that they were made from, the newest by default. A save that fails leaves the catalogue as it was; one that another has overtaken raises versions.Conflict."""
    spark = next(iter(tables.values())).sparkSession
    return versions.save(spark, tables, path, base)


def load(spark: SparkSession, path: str, version: int | None = None) -> versions.Snapshot:
    """The catalogue's tables, of the newest version by default."""
    return versions.load(spark, path, version)


def update(spark: SparkSession, path: str, change: Callable[[versions.Snapshot], dict[str, DataFrame] | None], tries: int = 20) -> int:
    """Applies change, which gives the tables that are new, to the newest version, again if another writer was faster; gives the version made, or the one found if change gives nothing."""
    for _ in range(tries):
        held = load(spark, path)
        new = change(held)
        if not new:
            return held.version
        try:
            return save(new, path, held.version)
        except versions.Conflict:
            continue
    raise versions.Conflict(f"{tries} other writers were faster")


def claim(spark: SparkSession, path: str) -> int | None:
    """Takes the started scan with the smallest id, which is running from then on, and gives its id; None if there is none. Of two that claim at once each gets another scan."""
    taken: list[int | None] = []

    def change(held: versions.Snapshot) -> dict[str, DataFrame] | None:
        job = next_scan(held["scan"]).select("id").first() if "scan" in held else None
        taken.append(job.id if job else None)
        return {"scan": moved(held["scan"], job.id, "Running")} if job else None

    update(spark, path, change)
    return taken[-1]
