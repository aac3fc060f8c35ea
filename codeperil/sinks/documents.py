"""JSON, SARIF and CSV documents of any size, written by the executors.

A document is a folder of text files whose names give their order: read one behind the other they are the document that
`plain` makes. Rows are ranked (by ranges, see operators.order), made into text where they lie, with the separator that
their rank asks for, and dealt by ranges of ranks, so file n holds what comes before file n + 1. What stands before and
behind the rows is a row as well, so the writer's own commit makes the document whole or leaves none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delta, view
from ..shipping import ship
from . import plain
from .model import Report

KINDS = ("json", "sarif", "csv")
#: Stands for the rows in a frame; no text holds it.
_MARK = "\0rows\0"

#: Rows that are Python objects at one time.
_AT_ONCE = 500


def write_document(report: Report, path: str, kind: str) -> None:
    """Write the report as `kind` (one of KINDS) into the folder `path`, which must not exist.

    JSON: all functions, their summary and the view without its rows. SARIF: the functions over their threshold. CSV: the
    changes to show if there is a comparison, else the files if grouped, else the functions to show.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    spark = report.verdicts.sparkSession
    ship(spark)
    rows, head, tail, form = _json(report) if kind == "json" else _sarif(report) if kind == "sarif" else _csv(report)
    texts = rows.mapInArrow(_formed(form, "" if kind == "csv" else ","), "rank long, text string")
    edges = [(0, head)] * bool(head) + [((1 << 62), tail)] * bool(tail)
    if edges:
        texts = texts.unionByName(spark.createDataFrame(edges, "rank long, text string"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("text").write.text(path)


def _formed(form: Callable[[dict], str], separator: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _AT_ONCE) for b in batches for at in range(0, len(b), _AT_ONCE)):
            rows = batch.to_pylist()
            texts = [(separator if r["rank"] > 1 else "") + form(r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["rank"] for r in rows], pa.int64()), pa.array(texts, pa.string())], ["rank", "text"])

    return work


def _framed(frame: dict) -> tuple[str, str]:
    head, _, tail = json.dumps(frame, ensure_ascii=False).partition(json.dumps(_MARK))
    return head, tail


def _with_hints(rows: DataFrame, report: Report) -> DataFrame:
    return rows if report.diagnostics is None else rows.join(report.diagnostics, "ordinal", "left")


def _json(report: Report):
    rows = view.with_rank(_with_hints(report.verdicts, report), [F.col("ordinal").asc()])
    return rows, *_framed(plain.document(report, [_MARK], minimal_view=True)), _json_text


def _sarif(report: Report):
    rows = view.with_rank(_with_hints(report.verdicts.where("exceeds"), report), [F.col("ordinal").asc()])
    return rows, *_framed(plain.sarif_log(report, [_MARK])), _sarif_text


def _csv(report: Report):
    spec, c = report.spec, report.comparison
    if c is not None:
        changes = delta.delta_view(c.changes, c.spec).select("kind", "file_path", "qualified_name", "signed_impact", "score_delta", "current_crap", "baseline_crap", *[F.struct(*[F.col(f"{s}.{x}").alias(x) for x in ("ordinal", "complexity", "coverage_percent", "crap")]).alias(s) for s in ("baseline", "current")])
        # a missing side is null as a whole
        changes = changes.withColumns({s: F.when(F.col(f"{s}.ordinal").isNotNull(), F.col(s)) for s in ("baseline", "current")})
        rows, head, line = view.with_rank(changes, delta.delta_sort_keys(c.spec.sort), c.spec.limit), plain.DELTA_HEADER, plain.change_line
    elif spec.group_by_file:
        rows, head, line = view.with_rank(report.grouped_frame, view.file_sort_keys(spec.sort), spec.limit), plain.FILE_HEADER, plain.file_line
    else:
        rows, head, line = view.with_rank(view.filtered(report.verdicts, spec), view.sort_keys(spec.sort), spec.limit), plain.FUNCTION_HEADER, plain.function_line
    metric = report.metric
    return rows, head, "", lambda r: line(r, metric)


def _json_text(r: dict) -> str:
    return json.dumps(plain.verdict_json(r), ensure_ascii=False)


def _sarif_text(r: dict) -> str:
    return json.dumps(plain.sarif_result(r), ensure_ascii=False)
