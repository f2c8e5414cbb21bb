"""Parts of packages: content types, names, media, fonts, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running_before


def extension(name: Column) -> Column:
    """The lower-case extension of a part's name or address; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)([?#]|$)", 1))


def content_types(parts: DataFrame, part: str, name: str, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """(part, kind): the part's own type, else that of its extension, else null. ``overrides`` has (part, kind),
    ``defaults`` (ext, kind); both are lists of a package, and Spark broadcasts them by their size."""
    own = overrides.select(F.col(part), F.col("kind").alias("_own"))
    usual = defaults.select(F.lower("ext").alias("_ext"), F.col("kind").alias("_usual"))
    found = parts.select(part, extension(F.col(name)).alias("_ext")).join(own, part, "left").join(usual, "_ext", "left")
    return found.select(part, F.coalesce("_own", "_usual").alias("kind"))


def plain_name(name: Column) -> Column:
    """A part's name without regard to case, the kind of slash and a leading slash."""
    return F.lower(F.regexp_replace(F.translate(name, "\\", "/"), "^/+", ""))


def part_lookup(wanted: DataFrame, name: str, parts: DataFrame, part_name: str, place: str) -> DataFrame:
    """The wanted rows with ``found``: the first part, by ``place``, of an equal name; rows without one go."""
    first = parts.groupBy(plain_name(F.col(part_name)).alias("_name")).agg(F.min(place).alias("found"))
    return wanted.withColumn("_name", plain_name(F.col(name))).join(first, "_name").drop("_name")


def media_ids(media: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Adds ``media_id``: the rank of the row's digest among the distinct ones of its key, from 0."""
    distinct = media.select(*keys, digest).distinct()
    return media.join(running_before(distinct, keys, [digest], F.lit(1).cast("long"), "media_id"), [*keys, digest])


def media_dedup(media: DataFrame, digest: Column, place: str) -> DataFrame:
    """One row for each content: its digest, the first place and the number of copies."""
    return media.groupBy(digest.alias("digest")).agg(F.min(place).alias(place), F.count("*").alias("n"))


def font_choice(asked: DataFrame, request: str, faces: DataFrame, face: str, family: str, exact: str, kin: str) -> DataFrame:
    """(request, face, rank): of the faces of the request's family the first with the same ``exact`` value (0), else
    of the same ``kin`` (1), else any (2). Both frames have the three columns; a request without a family goes.
    Faces are reduced to the first of each kind, so no join makes pairs."""
    firsts = [faces.groupBy(*k).agg(F.min(face).alias(f"_f{i}")) for i, k in enumerate(([family, exact], [family, kin], [family]))]
    found = asked.join(firsts[2], family).join(firsts[0], [family, exact], "left").join(firsts[1], [family, kin], "left")
    rank = F.when(F.col("_f0").isNotNull(), 0).when(F.col("_f1").isNotNull(), 1).otherwise(2)
    return found.select(request, F.coalesce("_f0", "_f1", "_f2").alias(face), rank.alias("rank"))


def without_target(references: DataFrame, key: str, targets: DataFrame, target: str) -> DataFrame:
    """References whose target isn't there; null references count as such."""
    known = targets.select(F.col(target).alias("_target"))
    return references.join(known, references[key] == F.col("_target"), "left_anti")


def cited_by_all(targets: DataFrame, target: str, citations: list[DataFrame], key: str) -> DataFrame:
    """Targets that every one of the citation tables names."""
    for rows in citations:
        targets = targets.join(rows.select(F.col(key).alias("_target")), targets[target] == F.col("_target"), "left_semi")
    return targets


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their numbers of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def distinct_values(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The sorted distinct values of each key, and their number."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name), F.count_distinct(value).alias("n"))


def set_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, n): how many distinct rows are in both frames, in the left one only, and in any."""
    side = lambda df, k: df.select(F.struct(*df.columns).alias("_row"), F.lit(k).alias("_in")).distinct()
    rows = side(a, 1).unionByName(side(b, 2)).groupBy("_row").agg(F.sum("_in").alias("_in"))
    counts = rows.agg(F.count_if(F.col("_in") == 3).alias("both"), F.count_if(F.col("_in") == 1).alias("left"), F.count("*").alias("any"))
    return counts.unpivot([], ["both", "left", "any"], "part", "n")


def search(lines: DataFrame, text: str, wanted: str) -> DataFrame:
    """Rows whose text holds the wanted one, without regard to case."""
    return lines.where(F.contains(F.lower(text), F.lower(F.lit(wanted))))
