"""Schemas of the evidence model and the severity scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def struct(**fields: T.DataType) -> T.StructType:
    """A struct of nullable fields."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: The eight fields that every evidence item must have.
ITEM = struct(artifact_id=_TEXT, source_tool=_TEXT, evidence_type=_TEXT, timestamp=_TEXT, value=_TEXT, severity=_TEXT, confidence=T.DoubleType(), linked_artifacts=_TEXTS)
#: Item fields as files hold them: the required ones and those that enrichment may have added.
RAW_ITEM = T.StructType([*ITEM.fields, *struct(machine_id=_TEXT, raw_value=_TEXT, normalized_value=_TEXT, ioc_match=_TEXTS).fields])
RAW_FILE = struct(tool=_TEXT, items=T.ArrayType(RAW_ITEM))
CASE_CONTEXT = struct(case_id=_TEXT, case_type=_TEXT, artifact_types=_TEXTS, artifact_types_claimed=_TEXTS, hypotheses=_TEXTS, affected_systems=_TEXTS, known_bad_hosts=_TEXTS, classifier_confidence=T.DoubleType(), generated_at=_TEXT, raw_incident_summary=_TEXT)
CATALOG = struct(
    indicators=T.ArrayType(struct(id=_TEXT, match=_TEXTS, severity=_TEXT, category=_TEXT)),
    bad_hosts=struct(domains=_TEXTS, ips=_TEXTS, severity=_TEXT),
    c2_ports=struct(ports=T.ArrayType(T.IntegerType()), severity=_TEXT),
    exfil_keywords=struct(keywords=_TEXTS, severity=_TEXT),
)
ONTOLOGY = struct(name=_TEXT, domains=_TEXTS, input_types=_TEXTS, output_types=_TEXTS, dependencies=_TEXTS, case_relevance=T.MapType(_TEXT, T.DoubleType()), default_order=T.IntegerType(), args_template=T.MapType(_TEXT, T.BooleanType()))

#: Fixed: severities from the strongest down, with their ranks; anything else has rank 0.
SEVERITY_RANKS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "informational": 1}


def severity_rank(severity: Column) -> Column:
    """5 for critical down to 1 for informational, 0 for anything else."""
    rank = F.lit(0)
    for name, value in SEVERITY_RANKS.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    """The severity of a rank; null for 0."""
    name = F.lit(None).cast("string")
    for value, number in SEVERITY_RANKS.items():
        name = F.when(rank == number, value).otherwise(name)
    return name


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a costly column so that later filters and projections read it instead of repeating its expression.

    A one-element explode: the optimizer moves no filter through a generator.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def make_items(df: DataFrame, artifact_id: Column, source_tool: Column | str, evidence_type: Column | str, value: Column, severity: Column | str = "medium", confidence: Column | float = 0.7, timestamp: Column | str = "", linked: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the eight-field shape, after the columns named in keep."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    links = linked if linked is not None else F.array().cast("array<string>")
    return df.select(
        *keep,
        artifact_id.alias("artifact_id"),
        as_column(source_tool).alias("source_tool"),
        as_column(evidence_type).alias("evidence_type"),
        as_column(timestamp).cast("string").alias("timestamp"),
        value.alias("value"),
        as_column(severity).alias("severity"),
        as_column(confidence).cast("double").alias("confidence"),
        links.alias("linked_artifacts"),
    )


def violations(items: DataFrame) -> DataFrame:
    """Adds violations, the names of the contract's rules that a row breaks; every row is kept."""
    missing = [F.when(F.col(f).isNull(), f"missing:{f}") for f in ITEM.fieldNames()]
    bad_severity = F.when(~F.col("severity").isin("critical", "high", "medium", "low"), "enum:severity")
    bad_confidence = F.when(~F.col("confidence").between(0, 1), "range:confidence")
    return items.withColumn("violations", F.array_compact(F.array(*missing, bad_severity, bad_confidence)))
