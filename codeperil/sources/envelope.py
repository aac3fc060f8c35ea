"""Earlier results: the JSON document that the json sink writes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMA_VERSIONS, VERDICT
from ..staging import staged
from .jsonparts import Parts


class EnvelopeError(ValueError):
    """kind: NotFound, Io, Parse or UnsupportedSchemaVersion."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Envelope:
    """verdicts, and what the document says about itself."""

    verdicts: DataFrame
    language: str
    metric: str | None
    threshold: float | None
    policy: str
    epsilon: float
    tool_version: str | None


#: How deep the functions of a document stand: its object, the result's, the array.
DEPTH = 3


def read_envelope(spark: SparkSession, path: str) -> Envelope:
    """Reads one document, a file or the folder that sinks.documents writes, of any size: functions are rows. The view and the comparison that it may hold are left out: a baseline is its result."""
    try:
        parts = Parts(spark, path, "qualified_name", folder=True)
    except Exception as error:
        text = str(error)
        if "PATH_NOT_FOUND" in text:
            raise EnvelopeError("NotFound", f"no baseline at {path}") from error
        raise EnvelopeError("Parse", f"{path} is no result document: {text.splitlines()[0]}") from error
    if len(parts.reports) != 1:
        raise EnvelopeError("Parse", f"{path} is empty" if not parts.reports else f"{path} holds several documents")
    ((name, document),) = parts.reports.items()
    if not document.closed:
        raise EnvelopeError("Parse", f"{path} is no result document: its braces don't close")
    tops = sorted(parts.members({name: 1}, shallow=True).select("place", "text").collect())  # the document's own keys
    try:
        head = json.loads("{" + ",".join(r["text"] for r in tops) + "}")
    except ValueError as error:
        raise EnvelopeError("Parse", f"{path} is no result document: {error}") from error
    if head.get("schema_version") not in SCHEMA_VERSIONS:
        raise EnvelopeError("UnsupportedSchemaVersion", f"{path} has schema version {head.get('schema_version')}; known are {', '.join(map(str, SCHEMA_VERSIONS))}")
    rows = parts.members({name: DEPTH}).where("inside = 'functions'").select("place", F.explode(F.array(F.from_json("text", VERDICT))).alias("v"))
    rows = staged(rows, "functions")
    if not rows.where("v IS NULL OR v.scored.identity IS NULL").isEmpty():
        raise EnvelopeError("Parse", f"{path} is no result document: a function can't be read")
    return Envelope(verdicts_of(numbered(rows)), head.get("language"), head.get("metric"), head.get("threshold"), head.get("missing_coverage_policy") or "pessimistic", head.get("epsilon") or 0.0, head.get("tool_version"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ordinal, their place from 0, by counts of the ranges before; a range's elements are numbered without gaps."""
    counts = rows.groupBy("place.offset").agg(F.count(F.lit(1)).alias("n"), F.min("place.number").alias("first")).orderBy("offset").collect()  # a row for each range
    before = [0, *accumulate(r["n"] for r in counts)]
    bases = rows.sparkSession.createDataFrame([(r["offset"], b - r["first"]) for r, b in zip(counts, before, strict=False)], "offset long, base long")
    return rows.withColumn("offset", F.col("place.offset")).join(bases, "offset").select((F.col("base") + F.col("place.number")).alias("ordinal"), "v")


def verdicts_of(v: DataFrame) -> DataFrame:
    """Verdicts (ordinal, v), flat."""
    s = "v.scored"
    span = lambda c: F.coalesce(F.col(f"{s}.identity.span.{c}"), F.lit(0)).cast("long").alias(c)
    return v.select(
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col(f"{s}.identity.file_path").alias("file_path"),
        F.col(f"{s}.identity.qualified_name").alias("qualified_name"),
        span("start_line"), span("end_line"), span("start_column"), span("end_column"),
        F.col(f"{s}.complexity").alias("complexity"),
        F.col(f"{s}.complexity_metric").alias("metric"),
        F.col(f"{s}.contributors").alias("contributors"),
        F.col(f"{s}.coverage_percent").alias("coverage_percent"),
        F.col(f"{s}.branch_coverage_percent").alias("branch_coverage_percent"),
        F.col(f"{s}.crap.value").alias("crap"),
        F.col(f"{s}.crap.risk_level").alias("risk_level"),
        F.col("v.threshold").alias("threshold"),
        F.col("v.exceeds").alias("exceeds"),
    )


def parse_input_specs(specs: Sequence[str]) -> dict[str, str]:
    """LANG=FILE arguments; a language may come once."""
    out: dict[str, str] = {}
    for spec in specs:
        language, sep, path = spec.partition("=")
        if not sep or not language or not path:
            raise ValueError(f"expected LANG=FILE, not {spec!r}")
        if language in out:
            raise ValueError(f"language {language!r} comes more than once")
        out[language] = path
    return out


def read_envelopes(spark: SparkSession, inputs: Sequence[str], baselines: Sequence[str] = ()) -> tuple[dict[str, Envelope], dict[str, Envelope]]:
    """Documents by language, and their baselines; each baseline needs an input."""
    own, then = parse_input_specs(inputs), parse_input_specs(baselines)
    if lone := sorted(set(then) - set(own)):
        raise ValueError(f"baseline without input: {', '.join(lone)}")
    return {k: read_envelope(spark, p) for k, p in own.items()}, {k: read_envelope(spark, p) for k, p in then.items()}


def local_document(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
