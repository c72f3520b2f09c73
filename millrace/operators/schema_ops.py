"""Lake schemas: inference, registration under the BACKWARD rule, checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import once

FIELD = "struct<name:string,type:string,required:boolean>"


def infer_schema(lines: DataFrame) -> DataFrame:
    """Union of top-level field names, all text, in first-seen order; from
    ``line, file, pos``. Blank and unparsable lines are skipped."""
    parsed = once(lines, "names", F.json_object_keys("line")).where("names is not null")
    return (
        parsed.select("file", "pos", F.posexplode("names").alias("at", "name"))
        .groupBy("name").agg(F.min(F.struct("file", "pos", "at")).alias("first"))
        .orderBy("first").select("name", F.lit("string").alias("type"))
    )


def require_fields(schema: DataFrame) -> DataFrame:
    """Fail when inference found nothing."""
    if schema.isEmpty():
        raise ValueError("no fields found: no readable JSON lines in this topic")
    return schema


def infer_schema_typed(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One merged schema with real types (per group), e.g. ``OBJECT<a: BIGINT>``."""
    return (once(lines, "v", F.try_parse_json("line"))
            .where(F.schema_of_variant("v").startswith("OBJECT"))
            .groupBy(*(by or [])).agg(F.schema_of_variant_agg("v").alias("schema")))


def _find(fields: Column, name: Column) -> Column:
    return F.filter(fields, lambda f: f["name"] == name)


def violations(old: Column, new: Column) -> Column:
    """Fields of ``new`` that break readers of data written with ``old``."""
    def broken(n):
        match = F.try_element_at(_find(old, n["name"]), F.lit(1))
        return F.when(match.isNull(), n["required"]).otherwise(
            (match["type"] != n["type"]) | (n["required"] & ~match["required"]))
    return F.transform(F.filter(new, broken), lambda f: f["name"])


def register_schema(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decide on one candidate per (org, topic) against the latest version.

    Registry: ``org, topic, version, format, fields``; candidates the same
    without a version. Returns ``outcome``, the version that is now current and
    the violations. Equal content keeps the version; another format or a
    violation is refused.
    """
    latest = registry.groupBy("org", "topic").agg(
        F.max_by(F.struct("version", "format", "fields"), "version").alias("cur"))
    joined = candidates.join(latest, ["org", "topic"], "left")
    cur = F.col("cur.fields")
    bad = F.when(F.col("cur").isNotNull(), violations(cur, F.col("fields")))
    same = F.sort_array(cur) == F.sort_array(F.col("fields"))
    outcome = (
        F.when(F.col("cur").isNull(), "created")
        .when(F.col("cur.format") != F.col("format"), "format_conflict")
        .when(same, "unchanged").when(F.size("broken") > 0, "incompatible")
        .otherwise("registered"))
    return (
        joined.withColumn("broken", bad).withColumn("outcome", outcome)
        .select("org", "topic", "format", "fields", "outcome",
                F.when(F.col("outcome") == "created", F.lit(1).cast("long"))
                .when(F.col("outcome") == "registered", F.col("cur.version") + 1)
                .otherwise(F.col("cur.version")).alias("version"),
                F.when(F.col("outcome") == "incompatible", F.col("broken")).alias("broken"))
    )


def next_registry(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    new = decisions.where(F.col("outcome").isin("created", "registered"))
    return registry.unionByName(new.select(*registry.columns))


# fixed values: leading words of a value's type, by declared type
TYPE_WORDS = {
    "string": ["STRING"], "long": ["BIGINT"], "double": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"],
    "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"],
}


def check_schema(lines: DataFrame, schema: list[tuple[str, str, bool]],
                 by: list[str] | None = None) -> DataFrame:
    """Count broken rules per field: ``malformed`` lines, ``missing`` required
    fields, ``type`` mismatches and ``unknown`` fields. ``schema`` lists
    (name, type, required)."""
    value = F.col("v")

    def problem(name, type_, required):
        got = F.schema_of_variant(F.variant_get(value, f"$['{name}']", "variant"))
        absent = got.isNull() | (got == "VOID")
        fits = F.regexp(got, F.lit("^(" + "|".join(TYPE_WORDS[type_]) + ")"))
        reason = F.when(absent, F.lit("missing") if required else F.lit(None)).when(~fits, "type")
        return F.struct(F.lit(name).alias("field"), reason.alias("reason"))

    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    unknown = F.transform(
        F.array_except(F.json_object_keys("line"), F.array(*[F.lit(n) for n, _, _ in schema])),
        lambda n: F.struct(n.alias("field"), F.lit("unknown").alias("reason")))
    found = F.when(
        is_object, F.concat(F.array(*[problem(*f) for f in schema]), unknown)
    ).otherwise(F.array(F.struct(F.lit("").alias("field"), F.lit("malformed").alias("reason"))))
    by = by or []
    parsed = once(lines, "v", F.try_parse_json("line"))
    return (
        once(parsed, "found", F.filter(found, lambda p: p["reason"].isNotNull()))
        .select(*by, F.explode("found").alias("p"))
        .groupBy(*by, F.col("p.field").alias("field"), F.col("p.reason").alias("reason"))
        .agg(F.count("*").alias("n"))
    )
