"""Project completeness and effort.

Input is the classified file table (op 104: project_id, name, step).  The
ten steps are generated per project with ``explode(sequence(1, 10))`` – no
join – and files are counted per step, so a project with many files never
has to be held in one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolake.functions import lexicons as L
from convolake.functions.columns import round_half_up

# Recommendation texts and the readiness threshold.
REC_MISSING = "Upload missing critical documents before proceeding"
REC_TAPER = "Consider uploading taper plan for accurate insulation takeoff"
READY_SCORE = 70
FINDING_EXCLUDES = "Scope excludes: "
# Score weights (critical steps, all steps) and the effort model
# (base hours, square feet per hour, hours per detail, complexity bounds).
CRITICAL_WEIGHT, COMPLETE_WEIGHT = 70, 30
EFFORT = {"base_hours": 5.0, "sf_per_hour": 1000, "hours_per_detail": 0.5, "high_details": 15, "medium_details": 8}


def project_steps(files: DataFrame, project: str = "project_id") -> DataFrame:
    """Op 106: project × 10 steps with status (complete when the step has
    files), file count and the first file name."""
    per = files.groupBy(project, "step").agg(F.count("*").alias("n_files"), F.min("name").alias("first_file"))
    projects = files.select(project).distinct()
    grid = projects.select(project, F.explode(F.sequence(F.lit(1), F.lit(10))).alias("step"))
    names = F.array(*[F.lit(n) for n in L.STEP_NAMES])
    x = grid.join(per, [project, "step"], "left")
    return x.select(project, "step", F.try_element_at(names, F.col("step")).alias("step_name"),
                    F.when(F.col("n_files") > 0, "complete").otherwise("pending").alias("status"),
                    F.coalesce("n_files", F.lit(0)).alias("n_files"), "first_file")


def project_step_files(files: DataFrame, project: str = "project_id") -> DataFrame:
    """Op 106, long form: one row per file of a step."""
    names = F.array(*[F.lit(n) for n in L.STEP_NAMES])
    return files.select(project, "step", F.try_element_at(names, F.col("step")).alias("step_name"), "name")


def project_exclusions(scope_files: DataFrame, project: str = "project_id") -> DataFrame:
    """Op 107, long form: one row per exclusion line, with its file and place."""
    from convolake.operators.labels import extract_references
    lines = extract_references(scope_files.select(project, "name", "text"), "text")
    return lines.select(project, "name", F.posexplode("exclusions").alias("place", "exclusion"))


def project_score(steps: DataFrame, project: str = "project_id",
                  scope_files: DataFrame | None = None) -> DataFrame:
    """Op 107: score = int(critical/4·70 + done/10·30) in exact integer
    arithmetic, missing critical documents, readiness, recommendations and
    key findings.

    ``scope_files`` (project_id, name, text) are the scope-of-work files; the
    exclusion lines found in them (op 97) give the "Scope excludes: …"
    finding, all of them in the order of the files' names;
    ``project_exclusions`` has them as rows."""
    done = F.col("status") == "complete"
    crit = F.col("step").between(1, 4)
    missing = F.array_compact(F.array(*[
        F.max(F.when((F.col("step") == s) & ~done, F.lit(n))) for s, n in sorted(L.CRITICAL_DOCS.items())]))
    g = steps.groupBy(project).agg(
        F.count_if(crit & done).alias("critical_complete"),
        F.count_if(done).alias("completed_steps"),
        missing.alias("missing_docs"),
        F.max(F.when((F.col("step") == 6) & ~done, F.lit(True))).alias("__taper_missing"))
    n_crit, n_steps = len(L.CRITICAL_DOCS), len(L.STEP_NAMES)
    # int(crit/n_crit·W1 + done/n_steps·W2) on integers: no float rounding at the boundaries
    score = F.floor((F.col("critical_complete") * (CRITICAL_WEIGHT * n_steps)
                     + F.col("completed_steps") * (COMPLETE_WEIGHT * n_crit)) / (n_crit * n_steps)).cast("int")
    g = g.withColumn("score", score)
    recs = F.array_compact(F.array(F.when(F.col("score") < READY_SCORE, F.lit(REC_MISSING)),
                                   F.when(F.coalesce(F.col("__taper_missing"), F.lit(False)), F.lit(REC_TAPER))))
    out = g.select(project, "critical_complete", "completed_steps", "score", "missing_docs",
                   (F.col("score") >= READY_SCORE).alias("ready"), recs.alias("recommendations"))
    if scope_files is None:
        return out.withColumn("key_findings", F.array().cast("array<string>"))
    from convolake.operators.labels import extract_references
    ex = (extract_references(scope_files.select(project, "name", "text"), "text")
          .where(F.size("exclusions") > 0)
          .groupBy(project).agg(F.array_sort(F.collect_list(F.struct("name", "exclusions"))).alias("__files"))
          .select(project, F.flatten(F.transform("__files", lambda f: f["exclusions"])).alias("__ex")))
    finding = F.when(F.col("__ex").isNotNull(),
                     F.array(F.concat(F.lit(FINDING_EXCLUDES), F.array_join("__ex", ", "))))
    return (out.join(ex, project, "left")
            .withColumn("key_findings", F.coalesce(finding, F.array().cast("array<string>"))).drop("__ex"))


def project_effort(areas: DataFrame, details: DataFrame, project: str = "project_id",
                   conflicts: DataFrame | None = None) -> DataFrame:
    """Op 108: hours = 5 + sf/1000 + 0.5·details (1 dp); complexity High when
    > 15 details or any conflict, Medium when > 8, else Low.  A project
    with no area rows counts 0 sf (Q14)."""
    a = areas.groupBy(project).agg(F.sum("sf").alias("total_sf"))
    d = details.groupBy(project).agg(F.count("*").alias("detail_count"))
    x = a.join(d, project, "full_outer")
    if conflicts is not None:
        c = conflicts.groupBy(project).agg(F.count("*").alias("__conf"))
        x = x.join(c, project, "left")
    else:
        x = x.withColumn("__conf", F.lit(0))
    sf = F.coalesce(F.col("total_sf"), F.lit(0.0))
    dc = F.coalesce(F.col("detail_count"), F.lit(0))
    e = EFFORT
    hours = round_half_up(F.lit(e["base_hours"]) + sf / e["sf_per_hour"] + dc * e["hours_per_detail"], 1)
    cx = (F.when((dc > e["high_details"]) | (F.coalesce(F.col("__conf"), F.lit(0)) > 0), "High")
          .when(dc > e["medium_details"], "Medium").otherwise("Low"))
    return x.select(project, sf.alias("total_sf"), dc.alias("detail_count"), hours.alias("est_hours"),
                    cx.alias("complexity"))
