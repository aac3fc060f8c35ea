"""Best-fit packing of token sequences, bulk-synchronous.

Documents become pieces (only what is longer than a sequence is cut), and pieces go into sequences in rounds. All
lengths and gaps are at most `capacity`, so the range-sorted tables of open pieces and of gaps are kept as runs of equal
values with consecutive ranks or sequence numbers; what a round moves does not grow with the number of rows.

A round sorts gaps and open pieces together by size and sweeps them downwards: each piece, the longest first, takes its
successor, the smallest gap at least as long that no longer piece has taken. Told by ranks this is the matching of
brackets: the running number of gaps less pieces gives every unit a level, and a piece takes the last gap before it on
its own level. Levels are cut where runs begin or end, so the match is one window over each stretch of levels, all
stretches side by side. A gap takes one piece in a round, or as many of one length as fit if more of that length are
open. Then gaps are updated, and the next round follows, until no piece is open.

The first round opens as many sequences as any packing needs: one for each piece longer than half a sequence, or the
volume's number if larger. Lengths join in octave by octave, so short pieces stay to fill what longer ones leave; when no
piece of the octaves so far fits, as many sequences are opened as its volume asks for. A round yields spans (ranks lo to hi of a
length go to sequences from first_seq on), and rows find their places by joining spans with their distributed ranks,
slot by slot: a slot is a bounded part of a length's rows, so no length, however frequent, is gathered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, ship, written
from .token_files import encoded_batches
from .words import encoder_of

PIECES = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"
#: Rows that one slot of a length may hold; fewer where that leaves less than SLOTS slots for each shuffle partition.
SLOT_ROWS, SLOTS = 100_000, 4
#: Tasks of a round: its tables have runs, not rows, so they stay small at any scale.
ROUND_TASKS = 4
#: The session of the rounds: their tables have the same few thousand rows at any scale, so there is nothing to plan anew
#: between stages and nothing to gain by compiling; what the driver keeps and drops for each of many plans counts instead.
ROUND_CONF = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": str(ROUND_TASKS), "spark.sql.maxPlanStringLength": "2000", "spark.sql.ui.explainMode": "simple"}
#: side 0: n sequences, numbered from `at`, with the gap `size`; side 1: n open pieces of the length `size`, ranks from `at`;
#: side 2: a span, ranks lo to hi of a length to sequences from `at` on, `in_each` to each, the first at `place`.
STATE = "side int, size long, n long, at long, lo long, hi long, in_each long, place long"


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: ids with `end_id` behind them, cut at `capacity`. A null text counts as empty."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        end = np.array([end_id], np.uint32)
        for batch, ids in encoded_batches(batches, encoder):
            rows = []
            for doc, uid, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids, strict=True):
                own = np.concatenate([own, end]).astype("<u4")
                for k, a in enumerate(range(0, len(own), capacity)):
                    part = own[a : a + capacity]
                    rows.append((doc, uid, k, a, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


#: A round. `down`: gaps and pieces from the largest size on, a gap before pieces as long; `level` and `floor`: the running
#: number of gaps less pieces and where it has run out of gaps; `cuts`: the levels where a run begins or ends. All tables
#: have runs, so a few thousand rows at any scale: `cuts` may be broadcast.
ROUND = f"""
WITH runs AS (
    SELECT side, size, n, at FROM {{state}} WHERE (side = 0 AND size >= :least) OR (side = 1 AND size >= :shortest)
    UNION ALL SELECT * FROM VALUES (0, CAST(:capacity AS BIGINT), CAST(:fresh AS BIGINT), CAST(:opened AS BIGINT)) AS new(side, size, n, at) WHERE n > 0
), depth AS (
    SELECT *, sum(if(side = 0, n, -n)) OVER down AS level, row_number() OVER down AS pos
    FROM runs WINDOW down AS (ORDER BY size DESC, side, at ROWS UNBOUNDED PRECEDING)
), floors AS (
    SELECT *, least(0, coalesce(min(level) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS floor FROM depth
), stretches AS (
    SELECT side, size, n, at, pos, if(side = 0, level - n, greatest(level, floor)) AS low, if(side = 0, level, level + n) AS high FROM floors
), edges AS (
    SELECT *, inline(array(named_struct('edge', low), named_struct('edge', high))) FROM stretches WHERE low < high
), numbered AS (
    SELECT *, dense_rank() OVER (ORDER BY edge) AS i FROM edges
), cuts AS (
    SELECT i AS cut, edge AS bottom, lead(edge) OVER (ORDER BY edge) AS top FROM (SELECT DISTINCT i, edge FROM numbered)
), reach AS (
    SELECT *, lead(i) OVER (PARTITION BY pos ORDER BY edge) AS until FROM numbered
), pieces_of_levels AS (
    SELECT *, explode(sequence(i, until - 1)) AS cut FROM reach WHERE until IS NOT NULL
), levels AS (
    SELECT /*+ BROADCAST(cuts) */ * FROM pieces_of_levels JOIN cuts USING (cut)
), dealt AS (
    SELECT /*+ REPARTITION({ROUND_TASKS}, cut) */ cut, pos, side, size, n - (high - low) AS open, at, low, high, bottom, top - bottom AS width FROM levels
), met AS (
    SELECT *, lag(size) OVER turn AS gap, lag(at - low) OVER turn + bottom AS first, lead(pos) OVER turn AS next
    FROM dealt WINDOW turn AS (PARTITION BY cut ORDER BY pos)
), pairs AS (
    -- pieces with their gaps, or a gap that is left
    SELECT /*+ REPARTITION({ROUND_TASKS}, side, size) */ side, size, open, width, gap, if(side = 0, at - low + bottom, first) AS first, at + bottom - low AS rank, at + high - low AS next_rank, if(side = 0, 0, gap div size - 1) AS more
    FROM met WHERE side = 1 OR next IS NULL
), rooms AS (
    -- open pieces of a length that found no gap go where one of theirs went
    SELECT *, coalesce(sum(width * more) OVER (PARTITION BY side, size ORDER BY gap, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM pairs
), shares AS (
    SELECT *, greatest(0, least(open - room, width * more)) AS extra FROM rooms
), takers AS (
    -- sequences that take `more` pieces besides their first, one that takes the rest, those that take no other
    SELECT *, inline(array(
        named_struct('skip', 0L, 'taking', if(more > 0, extra div more, 0), 'others', more, 'before', 0L),
        named_struct('skip', if(more > 0, extra div more, 0), 'taking', if(more > 0 AND extra % more > 0, 1L, 0L), 'others', if(more > 0, extra % more, 0), 'before', if(more > 0, extra - extra % more, 0)),
        named_struct('skip', if(more > 0, ceil(extra / more), 0), 'taking', width - if(more > 0, ceil(extra / more), 0), 'others', 0L, 'before', 0L)))
    FROM shares
), moves AS (
    SELECT inline(if(side = 0, array(named_struct('side', 0, 'size', size, 'n', taking, 'at', first + skip, 'lo', NULL, 'hi', NULL, 'in_each', NULL, 'place', NULL)), array(
        named_struct('side', 0, 'size', gap - (others + 1) * size, 'n', taking, 'at', first + skip, 'lo', NULL, 'hi', NULL, 'in_each', NULL, 'place', NULL),
        named_struct('side', 1, 'size', size, 'n', -taking * (others + 1), 'at', taking * (others + 1), 'lo', NULL, 'hi', NULL, 'in_each', NULL, 'place', NULL),
        named_struct('side', 2, 'size', size, 'n', 1L, 'at', first + skip, 'lo', rank + skip, 'hi', rank + skip + taking, 'in_each', 1L, 'place', :capacity - gap),
        named_struct('side', 2, 'size', size, 'n', if(others > 0, 1L, 0L), 'at', first + skip, 'lo', next_rank + room + before, 'hi', next_rank + room + before + taking * others, 'in_each', others, 'place', :capacity - gap + size))))
    FROM takers WHERE taking > 0
), after AS (
    SELECT * FROM moves WHERE size > 0 UNION ALL SELECT side, size, n, at, NULL, NULL, NULL, NULL FROM {{state}} WHERE side = 1
), joined AS (
    SELECT /*+ REPARTITION({ROUND_TASKS}, side, size) */ * FROM after
), breaks AS (
    SELECT *, if(side = 0 AND NOT at <=> lag(at + n) OVER (PARTITION BY side, size ORDER BY at, n), 1, 0) AS break FROM joined
), whole AS (
    -- runs that follow one another become one
    SELECT *, sum(break) OVER (PARTITION BY side, size ORDER BY at, n ROWS UNBOUNDED PRECEDING) AS run FROM breaks
)
SELECT side, size, sum(n) AS n, if(side = 1, sum(at), min(at)) AS at, lo, hi, in_each, place
FROM whole GROUP BY side, size, run, lo, hi, in_each, place HAVING sum(n) > 0
"""


def spans_of(counts: DataFrame, capacity: int) -> DataFrame:
    """Spans (length, lo, hi, first_seq, in_each, place) from the number of pieces of each length (length, n: `capacity` rows at most).

    Rank r of a length, lo <= r < hi, goes to sequence first_seq + (r - lo) // in_each, at place + (r - lo) % in_each * length.
    """
    spark = counts.sparkSession
    folder, n_rounds = shared_path(spark, "runs"), 0
    rounds = spark.newSession()
    for name, value in ROUND_CONF.items():
        rounds.conf.set(name, value)

    def put(state: DataFrame) -> DataFrame:
        state.write.parquet(f"{folder}/round={n_rounds}")
        return rounds.read.schema(STATE).parquet(f"{folder}/round={n_rounds}")

    none = F.lit(None).cast("long")
    state = put(counts.select(F.lit(1).alias("side"), F.col("length").alias("size"), "n", F.lit(0).cast("long").alias("at"), *[none.alias(c) for c in ("lo", "hi", "in_each", "place")]).coalesce(1))
    halvings = F.length(F.bin(F.expr(f"{capacity} div size"))) - 1  # 0: longer than half a sequence, 1: than a quarter, ...
    opened, octave = 0, 0
    while True:
        octaves = state.where("side < 2").coalesce(1).groupBy("side", halvings.alias("octave"))
        octaves = octaves.agg(F.min("size").alias("least"), F.max("size").alias("most"), F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("volume")).collect()  # 2 * log2(capacity) rows at most
        left = [r for r in octaves if r["side"] == 1]
        if not left:
            break
        top = max((r["most"] for r in octaves if r["side"] == 0), default=0)
        new = 0
        if not n_rounds:
            new = max(sum(r["n"] for r in left if not r["octave"]), -(-sum(r["volume"] for r in left) // capacity))
        while not new:
            open_ = [r for r in left if r["octave"] <= octave]
            if any(r["least"] <= top for r in open_):
                break
            new = -(-sum(r["volume"] for r in open_) // capacity)
            octave += not new
        n_rounds += 1
        least = min(r["least"] for r in left)
        args = {"least": least, "shortest": (capacity >> octave + 1) + 1, "capacity": capacity, "fresh": new, "opened": opened}
        state = put(rounds.sql(ROUND, args, state=state))
        opened += new
    spans = spark.read.schema(STATE).parquet(folder).where("side = 2")
    return spans.select(F.col("size").alias("length"), "lo", "hi", F.col("at").alias("first_seq"), "in_each", "place")


def pack(pieces: DataFrame, capacity: int = 2048, order: Iterable[str] = ("doc_id", "uid", "piece")) -> DataFrame:
    """`pieces` (written: they are read several times) with sequence_id and offset.

    An empty table stays empty. Ties in length are broken by `order`. Lengths must lie in 1 to `capacity`.
    """
    counts = written(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")  # `capacity` rows at most
    if not counts.where(~F.col("length").between(1, capacity)).isEmpty():
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    spans = spans_of(counts, capacity)
    # a length's rows are dealt to slots, whose ranks follow one another
    order = list(order)
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(1, min(SLOT_ROWS, total // (SLOTS * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    slots = counts.select("length", F.ceil(F.col("n") / most).alias("slots"))
    rows = pieces.join(F.broadcast(slots), "length").withColumn("slot", F.pmod(F.xxhash64(*order), F.col("slots"))).drop("slots")
    sizes = rows.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes.withColumn("base", F.sum("rows").over(Window.partitionBy("length").orderBy("slot")) - F.col("rows")), "slots")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slot").orderBy(*order)) - 1)
    # a slot's spans, with ranks counted from its first
    own = sizes.join(spans, "length").where((F.col("lo") < F.col("base") + F.col("rows")) & (F.col("hi") > F.col("base")))
    own = own.select("length", "slot", (F.col("lo") - F.col("base")).alias("lo"), (F.col("hi") - F.col("base")).alias("hi"), "first_seq", "in_each", "place")
    met = rows.join(own.hint("merge"), ["length", "slot"]).where("rank >= lo AND rank < hi")
    nth = F.col("rank") - F.col("lo")
    return met.select(*pieces.columns, (F.col("first_seq") + F.expr("(rank - lo) div in_each")).alias("sequence_id"), (F.col("place") + nth % F.col("in_each") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and gives one piece, the end id. Identifiers are whole numbers or their digits as strings;
    null and repeated ones are rows like others. An empty table gives an empty result. Other columns are not looked at.
    """
    pieces = written(token_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
