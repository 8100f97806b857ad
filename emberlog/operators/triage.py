"""From scored rows to ranked incidents.

Anomalies are rows of (id, timestamp, score, entity, templates array, context array, seq);
seq is the input's order and decides ties.
"""

from __future__ import annotations

import atexit
import json
import uuid
from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import fixed_point, shown_timestamp
from .ordered import in_ranges, with_place_in, with_position, with_previous, with_running_sum
from .scratch import remove_local, shared_folder, written

#: Priorities, and the words of each category in the order in which they are tried.
PRIORITIES = ("P1", "P2", "P3", "P4")
KEYWORDS = {
    "data_loss": ("delete", "deleting", "lost", "corrupt", "missing"),
    "replication_failure": ("replicat", "under-replicat", "addstoredblock", "ask"),
    "network": ("connection", "socket", "timeout", "unreachable", "reset"),
    "resource_exhaustion": ("memory", "disk", "full", "quota", "capacity"),
    "hardware_fault": ("ecc", "parity", "dimm", "temperature", "fan", "card"),
    "kernel_fault": ("kernel", "panic", "trap", "exception", "fatal"),
}
UNKNOWN = "unknown"
ACTIONS = {
    "data_loss": "Stop deletions that touch these entities and compare their copies before anything else.",
    "replication_failure": "See which storage nodes lag and start copying what has too few copies.",
    "network": "Test the links between the nodes named here; look for losses and slow answers.",
    "resource_exhaustion": "Measure free memory and disk on these nodes, then free some or add more.",
    "hardware_fault": "Plan a hardware test of the nodes named here and watch their error counters.",
    "kernel_fault": "Save the kernel's messages; if they repeat, take the nodes out of service and restart them.",
    UNKNOWN: "Read the lines around these events and check what was changed shortly before.",
}


def severity_rank(flagged: DataFrame, name: str = "severity") -> DataFrame:
    """The average rank of the score over the number of rows, in (0, 1]."""
    groups = in_ranges(flagged.groupBy("score").agg(F.count("*").alias("same")), ["score"])
    ran = with_running_sum(groups, ["score"], F.col("same"), "upto")
    total = F.broadcast(flagged.agg(F.count("*").alias("total")))
    pct = ran.crossJoin(total).select("score", ((F.col("upto") - (F.col("same") - 1) / 2) / F.col("total")).alias(name))
    return flagged.join(pct, "score")


def top_flagged(scored: DataFrame, key: str, top: int = 200) -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(top)


def with_context(flagged: DataFrame, lines: DataFrame, key: str, order: Sequence[str], most_templates: int = 8, most_lines: int = 4) -> DataFrame:
    """Adds the first distinct templates and the first lines of each flagged key; rows are ranked and cut before they are collected."""
    own = lines.join(flagged.select(key), key).select(key, F.struct(*order, "template", "content").alias("row"))
    none = F.array().cast("array<string>")

    def first(rows: DataFrame, most: int, field: str, name: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(key).orderBy("row"))
        kept = rows.withColumn("place", place).where(F.col("place") <= most).groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("rows"))
        return kept.select(key, F.transform("rows", lambda r: r[field]).alias(name))

    firsts = own.groupBy(key, F.col("row.template").alias("template")).agg(F.min("row").alias("row"))
    joined = flagged.join(first(firsts, most_templates, "template", "templates"), key, "left").join(first(own, most_lines, "content", "context"), key, "left")
    return joined.withColumns({"templates": F.coalesce("templates", none), "context": F.coalesce("context", none)})


def dedup(anomalies: DataFrame) -> DataFrame:
    """The highest score of each (entity, set of templates), the first of equal ones, with their number."""
    signature = F.struct("entity", F.array_sort("templates").alias("templates"))
    rows = anomalies.withColumn("signature", signature)
    best = F.max_by(F.struct(*anomalies.columns), F.struct(F.col("score"), (-F.col("seq")).alias("s")))
    out = rows.groupBy("signature").agg(best.alias("best"), F.count("*").alias("dedup_n"), F.min("seq").alias("first_seq"))
    return out.select("best.*", "dedup_n", "first_seq")


def correlate(anomalies: DataFrame, gap_seconds: float = 30.0, same_entity: bool = False) -> DataFrame:
    """Adds incident_no, from 1 in time order: a longer gap starts an incident, and on request a change of entity."""
    order = ["micros", "first_seq"]
    rows = anomalies.withColumn("micros", F.unix_micros(F.col("timestamp").cast("timestamp")))
    if "first_seq" not in rows.columns:
        rows = rows.withColumn("first_seq", F.col("seq"))
    ranged = in_ranges(rows, order)
    paired = with_previous(ranged, order, {"micros_before": "micros", "entity_before": "entity"})
    new = F.col("micros_before").isNull() | ((F.col("micros") - F.col("micros_before")) / F.lit(1e6) > gap_seconds)
    if same_entity:
        new = new | ~F.col("entity").eqNullSafe(F.col("entity_before"))
    out = with_running_sum(paired.withColumn("new", new.cast("int")), order, F.col("new"), "incident_no")
    return out.drop("new", "micros_before", "entity_before", "range_no")


def incidents(correlated: DataFrame) -> DataFrame:
    """One row for each incident, its anomalies nested in time order."""
    count = F.col("dedup_n") if "dedup_n" in correlated.columns else F.lit(1)
    context = F.col("context") if "context" in correlated.columns else F.array().cast("array<string>")
    rows = F.array_sort(F.collect_list(F.struct("micros", "first_seq", "id", "timestamp", "score", "entity", "templates", context.alias("context"))))
    out = correlated.groupBy("incident_no").agg(
        rows.alias("anomalies"), F.count("*").alias("n_anomalies"), F.sum(count).alias("dedup_count"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.max("score").alias("peak"), F.array_sort(F.collect_set(F.when(F.length("entity") > 0, F.col("entity")))).alias("all_entities"),
    )
    templates = F.array_distinct(F.flatten(F.transform("anomalies", lambda a: a["templates"])))
    return out.withColumns({"templates": templates, "id": F.concat(F.lit("INC-"), F.when(F.col("incident_no") < 10_000, F.lpad(F.col("incident_no").cast("string"), 4, "0")).otherwise(F.col("incident_no").cast("string")))})


def incident_segments(correlated: DataFrame, most: int = 10_000) -> DataFrame:
    """The anomalies of each incident in time order, in segments of ``most``: for floods, whose rows no one row should hold."""
    placed = with_place_in(correlated, "incident_no", ["micros", "first_seq"]).withColumn("segment_no", F.expr(f"place div {most}"))
    rows = F.array_sort(F.collect_list(F.struct("place", "id", "timestamp", "score", "entity", "templates")))
    return placed.groupBy("incident_no", "segment_no").agg(rows.alias("anomalies"), F.count("*").alias("n_anomalies"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


def category(templates: Column) -> Column:
    """The first category with a word that occurs anywhere in the templates."""
    text = F.lower(F.concat_ws(" ", templates))
    out = F.lit(UNKNOWN)
    for name, words in reversed(KEYWORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def priority(peak: Column, n: Column) -> Column:
    return F.when((peak >= 0.8) | (n >= 20), "P1").when((peak >= 0.5) | (n >= 5), "P2").when(peak >= 0.2, "P3").otherwise("P4")


def explained(found: DataFrame) -> DataFrame:
    """The rule-based fields of each incident."""
    span = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / F.lit(1e6)
    n, entities = F.col("n_anomalies"), F.col("all_entities")
    where = F.when(F.size(entities) == 1, F.concat(F.lit(" at "), F.get(entities, F.lit(0)))).when(F.size(entities) > 1, F.concat(F.lit(" at "), F.size(entities), F.lit(" entities"))).otherwise("")
    kind = category(F.col("templates"))
    summary = F.concat(n, F.when(n == 1, " anomaly").otherwise(" anomalies"), F.lit(" within "), fixed_point(span, 0), F.lit(" s"), where, F.lit(", mostly "), kind)
    action = F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), kind)
    shown = F.concat(F.array_join(F.slice("templates", 1, 5), "; "), F.when(F.size("templates") > 5, "; and more").otherwise(""))
    text = F.concat(F.lit("Stands for "), F.col("dedup_count"), F.lit(" flagged rows from "), shown_timestamp(F.col("start")), F.lit(" to "), shown_timestamp(F.col("end")), F.lit("; highest score "), fixed_point(F.col("peak"), 3), F.lit("; templates: "), shown)
    return found.withColumns({"priority": priority(F.col("peak"), n), "category": kind, "summary": summary, "recommended_action": action, "explanation": text})


def prompt(found: DataFrame) -> Column:
    """The text that a model backend gets for an incident."""
    lines = F.flatten(F.transform(F.slice("anomalies", 1, 3), lambda a: F.transform(F.slice(a["context"], 1, 4), lambda c: F.concat(F.lit("- "), c))))
    head = F.array(
        F.lit("Sort this incident of a distributed system's logs into the given fields."), F.concat(F.lit("Incident "), F.col("id"), F.lit(", anomalies: "), F.col("n_anomalies")),
        F.concat(F.lit("From "), shown_timestamp(F.col("start")), F.lit(" to "), shown_timestamp(F.col("end"))), F.concat(F.lit("Highest score: "), fixed_point(F.col("peak"), 3)),
        F.concat(F.lit("Entities: "), F.when(F.size("all_entities") > 0, F.array_join("all_entities", ", ")).otherwise("n/a")), F.concat(F.lit("Templates: "), F.array_join("templates", ", ")), F.lit("Lines:"),
    )
    return F.array_join(F.concat(head, lines), "\n")


FIELDS = ("priority", "category", "summary", "recommended_action", "explanation")


class Backend(Protocol):
    def __call__(self, prompt: str) -> str:
        """A JSON object with the fields; anything else, or an error, means the rules decide."""


def valid_answer(text: str) -> dict | None:
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        return None
    ok = isinstance(data, dict) and set(FIELDS) == set(data) and all(isinstance(data[f], str) for f in FIELDS)
    return data if ok and data["priority"] in PRIORITIES and data["category"] in (*KEYWORDS, UNKNOWN) else None


class Answers:
    """A backend's answers, one file for each prompt, named by the prompt's hash, in a folder that all tasks share.

    An answer is kept as soon as it is there, before the next prompt is asked: a task that
    fails and is run again, or a later run, asks only what has no answer yet. A failure
    of the backend isn't kept.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _place(self, name: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder if ":" in self.folder.split("/")[0] else f"file://{self.folder}")
        store.create_dir(path, recursive=True)
        return store, f"{path}/{name}.json"

    def of(self, name: str, text: str, backend: Backend) -> str | None:
        from pyarrow import fs

        store, path = self._place(name)
        if store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_stream(path) as f:
                return f.read().decode()
        try:
            answer = backend(text)
        except Exception:  # noqa: BLE001  any failure of the backend falls back on the rules
            return None
        if not isinstance(answer, str):
            return None
        aside = f"{path}.{uuid.uuid4().hex[:8]}"  # so that no one reads half an answer
        with store.open_output_stream(aside) as f:
            f.write(answer.encode())
        store.move(aside, path)
        return answer


def asked(found: DataFrame, backend: Backend, answers: str | None = None) -> DataFrame:
    """explained(), with the backend's fields wherever it gives a valid answer.

    answers: a folder for the answers; without one they go to a folder of this call.
    Each distinct prompt is asked once.
    """
    rows = explained(found).withColumn("prompt", prompt(found)).withColumn("prompt_hash", F.sha2("prompt", 256))
    spark = found.sparkSession
    if answers is None:
        answers = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex[:12]}"
        atexit.register(remove_local, answers)
    held = Answers(answers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            valid = [valid_answer(held.of(name, text, backend)) or {} for name, text in zip(pdf["prompt_hash"], pdf["prompt"], strict=True)]
            yield pd.DataFrame({"prompt_hash": pdf["prompt_hash"], **{f"said_{f}": [v.get(f) for v in valid] for f in FIELDS}})

    prompts = rows.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    # written: a plan that is run twice doesn't ask twice
    said = written(prompts.mapInPandas(run, "prompt_hash string, " + ", ".join(f"said_{f} string" for f in FIELDS)), "said")
    joined = rows.join(said, "prompt_hash", "left")
    return joined.withColumns({f: F.coalesce(f"said_{f}", f) for f in FIELDS}).drop("prompt", "prompt_hash", *[f"said_{f}" for f in FIELDS])


def ranked(fields: DataFrame) -> DataFrame:
    """The records in order: priority, then the rounded peak; rank is their place."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")), F.lit(10))
    rows = fields.withColumns({"prio": F.when(order == 0, 10).otherwise(order), "max_score": F.bround("peak", 4)}).withColumn("down", -F.col("max_score"))
    keys = ["prio", "down", "incident_no"]
    placed = with_position(in_ranges(rows.drop("anomalies"), keys), keys, "rank")
    return placed.select(
        "rank", "id", "priority", "category", "summary", "recommended_action", "explanation", "n_anomalies", "dedup_count",
        shown_timestamp(F.col("start")).alias("start"), shown_timestamp(F.col("end")).alias("end"), "max_score", F.slice("all_entities", 1, 10).alias("entities"),
    )


def triage(anomalies: DataFrame, gap_seconds: float = 30.0, same_entity: bool = False, backend: Backend | None = None, answers: str | None = None) -> DataFrame:
    found = incidents(correlate(dedup(anomalies), gap_seconds, same_entity))
    return ranked(explained(found) if backend is None else asked(found, backend, answers))


def with_priorities(records: DataFrame, priorities: Sequence[str]) -> DataFrame:
    return records.where(F.col("priority").isin(list(priorities))).orderBy("priority", F.desc("max_score"), "id")


def one_incident(records: DataFrame, incident_id: str) -> DataFrame:
    return records.where(F.col("id") == incident_id)


def totals(records: DataFrame) -> DataFrame:
    """Incidents, flagged rows behind them, and incidents by priority."""
    return records.groupBy("priority").agg(F.count("*").alias("incidents"), F.sum("dedup_count").alias("flags"))
