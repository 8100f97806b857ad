"""Template mining: masked lines are routed by length and first tokens, then clustered by equal tokens.

Lines of another length or other first tokens never meet, so each route is mined by
itself, in the order of first appearance, over its distinct masked lines only. A task
holds the templates of one route, never its lines; a route of very many lines is mined in
parts, whose templates are merged by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import masked
from .scratch import written

WILDCARD = "<*>"
MINED_COLUMNS = ["route", "cluster", "masked_line", "template"]


def masked_templates(lines: DataFrame, masks, column: str = "content") -> DataFrame:
    """(template, event_id, n): lines that differ only in masked parts."""
    template = F.trim(F.regexp_replace(masked(F.col(column), masks), r"\s+", " "))
    return lines.select(template.alias("template")).groupBy("template").agg(F.count("*").alias("n")).withColumn("event_id", F.left(F.md5("template"), F.lit(8)))


class Clusters:
    """The templates of one route; unequal tokens become wildcards. Memory is that of the templates, not of the lines.

    An index tells for each token and place which templates have it there, so that a line is
    compared with those only that share a token with it.
    """

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.rows: list[list[str]] = []
        self.wild: list[int] = []
        self.index: dict[tuple[int, str], set[int]] = {}

    def add(self, tokens: list[str]) -> int:
        """The cluster of a line: the template with most equal tokens, then with most wildcards, then the oldest; or a new one."""
        same: dict[int, int] = {}
        for place, w in enumerate(tokens):
            for k in self.index.get((place, w), ()):
                same[k] = same.get(k, 0) + 1
        if self.similarity <= 0:  # then templates without an equal token will do, too
            same = dict.fromkeys(range(len(self.rows)), 0) | same
        best = max(same, key=lambda k: (same[k], self.wild[k], -k), default=None)
        if best is None or same[best] / len(tokens) < self.similarity:
            best = len(self.rows)
            self.rows.append(list(tokens))
            self.wild.append(tokens.count(WILDCARD))
            for place, w in enumerate(tokens):
                if w != WILDCARD:
                    self.index.setdefault((place, w), set()).add(best)
            return best
        row = self.rows[best]
        for place, w in enumerate(tokens):
            if row[place] != w and row[place] != WILDCARD:
                held = self.index[place, row[place]]
                held.discard(best)
                if not held:
                    del self.index[place, row[place]]
                row[place] = WILDCARD
                self.wild[best] += 1
        return best

    def templates(self) -> list[str]:
        return [" ".join(row) for row in self.rows]


def _mined(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Rows in order of route and first line to the cluster of each line; a route's templates follow its lines."""
    route, clusters = None, Clusters(similarity)

    def finished() -> list[tuple]:
        return [(route, k, None, t) for k, t in enumerate(clusters.templates())]

    for batch in batches:
        out = []
        for own, line in zip(batch["route"], batch["masked_line"], strict=True):
            if own != route:
                out += finished()
                route, clusters = own, Clusters(similarity)
            out.append((route, clusters.add(line.split(" ")), line, None))
        yield pd.DataFrame(out, columns=MINED_COLUMNS)
    yield pd.DataFrame(finished(), columns=MINED_COLUMNS)


def _clustered(lines: DataFrame, similarity: float, name: str) -> DataFrame:
    """(route, masked_line, first_line) to (route, masked_line, template): each route in the order of its lines, one task for a route."""
    sorted_ = lines.repartition("route").sortWithinPartitions("route", "first_line", "masked_line").select("route", "masked_line")
    found = written(sorted_.mapInPandas(lambda batches: _mined(batches, similarity), "route string, cluster long, masked_line string, template string"), name)
    named = found.where("template IS NOT NULL").select("route", "cluster", "template")
    return found.where("template IS NULL").drop("template").join(named, ["route", "cluster"]).select("route", "masked_line", "template")


def _mined_counts(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Rows in order of route and first line to the templates of each route, with their first line and number of lines."""
    route, clusters, first, n = None, Clusters(similarity), [], []

    def finished() -> pd.DataFrame:
        return pd.DataFrame({"route": route, "masked_line": clusters.templates(), "first_line": first, "lines": n})

    for batch in batches:
        out = []
        for own, line, at, some in zip(batch["route"], batch["masked_line"], batch["first_line"], batch["lines"], strict=True):
            if own != route:
                if n:
                    out.append(finished())
                route, clusters, first, n = own, Clusters(similarity), [], []
            k = clusters.add(line.split(" "))
            if k == len(n):
                first.append(at)
                n.append(0)
            n[k] += some
        if out:
            yield pd.concat(out)
    if n:
        yield finished()


def _clustered_counts(lines: DataFrame, similarity: float) -> DataFrame:
    """(route, masked_line, first_line, lines) to the same of templates: no line leaves the task that mines its route."""
    columns = ["route", "masked_line", "first_line", "lines"]
    sorted_ = lines.select(*columns).repartition("route").sortWithinPartitions("route", "first_line", "masked_line")
    schema = f"route string, masked_line string, first_line {lines.schema['first_line'].dataType.simpleString()}, lines long"
    return written(sorted_.mapInPandas(lambda batches: _mined_counts(batches, similarity), schema), "counted")


def _route(depth: int) -> Column:
    tokens = F.split("masked_line", " ")
    heads = [F.when(F.get(tokens, F.lit(k)).rlike(r"\d"), WILDCARD).otherwise(F.coalesce(F.get(tokens, F.lit(k)), F.lit(""))) for k in range(depth - 2)]
    return F.concat_ws("\x1f", F.size(tokens), *heads)


def template_counts(lines: DataFrame, order: str, masks, depth: int = 4, similarity: float = 0.5, column: str = "content", part_lines: int = 50_000) -> DataFrame:
    """(template, event_id, n): the templates of mine_templates() and their lines, a NULL one for NULL lines.

    Distinct lines carry their number, so that texts move twice, when they are made distinct
    and when they are dealt to their routes; only templates come out of that.
    """
    tidy = F.trim(F.regexp_replace(masked(F.col(column), masks), r"\s+", " "))
    distinct = lines.select(tidy.alias("masked_line"), F.col(order).alias("at")).groupBy("masked_line").agg(F.min("at").alias("first_line"), F.count("*").alias("lines"))
    routed = written(distinct.select(_route(depth).alias("route"), "masked_line", "first_line", "lines"), "routed")
    whole = routed.where("masked_line IS NOT NULL")
    parts = whole.groupBy("route").agg(F.ceil(F.count("*") / F.lit(part_lines)).alias("parts"))
    large = written(parts.where("parts > 1"), "large")
    if large.isEmpty():
        found = _clustered_counts(whole, similarity)
    else:
        part = F.coalesce(F.pmod(F.xxhash64("masked_line"), F.col("parts")), F.lit(0))
        dealt = whole.join(large, "route", "left").withColumn("route", F.concat_ws("\x1e", part.cast("string"), "route"))
        own = _clustered_counts(dealt, similarity).withColumn("route", F.substring_index("route", "\x1e", -1))
        again = own.join(large, "route", "left_semi").groupBy("route", "masked_line").agg(F.min("first_line").alias("first_line"), F.sum("lines").alias("lines"))
        found = own.join(large, "route", "left_anti").unionByName(_clustered_counts(again, similarity))
    found = found.unionByName(routed.where("masked_line IS NULL")).groupBy(F.col("masked_line").alias("template")).agg(F.sum("lines").alias("n"))
    return found.withColumn("event_id", F.left(F.md5("template"), F.lit(8)))


def mine_templates(lines: DataFrame, order: str, masks, depth: int = 4, similarity: float = 0.5, column: str = "content", part_lines: int = 50_000) -> DataFrame:
    """lines with template and event_id (the first 8 hex digits of the template's MD5), NULL for NULL lines.

    A route of more than ``part_lines`` distinct lines is dealt to parts by the hash of the
    line. Parts are mined apart, and then their templates, as lines with wildcards and in the
    order of their first lines, by the same rule: a line has the template that its part's
    template falls into. Routes of fewer lines have one part, whose templates are final.
    """
    tidy = F.trim(F.regexp_replace(masked(F.col(column), masks), r"\s+", " "))
    rows = lines.withColumn("masked_line", tidy)
    distinct = rows.where("masked_line IS NOT NULL").groupBy("masked_line").agg(F.min(order).alias("first_line"))
    routed = written(distinct.select(_route(depth).alias("route"), "masked_line", "first_line"), "routed")
    parts = routed.groupBy("route").agg(F.ceil(F.count("*") / F.lit(part_lines)).alias("parts"))
    large = written(parts.where("parts > 1"), "large")
    if large.isEmpty():
        of_line = _clustered(routed, similarity, "mined").select("masked_line", "template")
    else:
        dealt = routed.join(large, "route", "left")
        part = F.coalesce(F.pmod(F.xxhash64("masked_line"), F.col("parts")), F.lit(0))
        dealt = dealt.select(F.concat_ws("\x1e", part.cast("string"), "route").alias("route"), "masked_line", "first_line")
        own = written(_clustered(dealt, similarity, "mined").join(dealt, ["route", "masked_line"]), "parts")
        whole_route = F.substring_index("route", "\x1e", -1)
        heard = own.withColumn("whole", whole_route)
        again = heard.join(large.select(F.col("route").alias("whole")), "whole", "left_semi")
        again = again.groupBy(F.col("whole").alias("route"), F.col("template").alias("masked_line")).agg(F.min("first_line").alias("first_line"))
        merged = _clustered(again, similarity, "merged").select(F.col("route").alias("whole"), F.col("masked_line").alias("template"), F.col("template").alias("final"))
        of_line = heard.join(merged, ["whole", "template"], "left").select("masked_line", F.coalesce("final", "template").alias("template"))
    return rows.join(of_line, "masked_line", "left").drop("masked_line").withColumn("event_id", F.left(F.md5("template"), F.lit(8)))
