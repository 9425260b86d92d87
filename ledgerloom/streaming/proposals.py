"""The state machine of a proposal as a keyed state: every move as it comes, legal ones and others, equal to the fold of all of them.

State is kept by Spark's own store, so it survives restarts: proposals are dealt to SLICES, and a slice's state is read and written once in a batch that touches it,
however many of its proposals move (a call of the store for each proposal takes far longer than the moves). A move that isn't newer than the last one seen isn't taken
again: the same number is a replay, a smaller one came late; both are told apart from moves that the state or its guards forbid.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.reversal import EDGES

#: A slice's proposals and where each stands, side by side.
STATE = "proposal array<string>, state array<string>, conservation array<boolean>, validation array<boolean>, sure array<boolean>, last array<long>"
#: Fixed value: slices that proposals are dealt to; a checkpoint holds for one number of them.
SLICES = 4096
MOVES = "proposal string, seq long, event string, before string, after string, verdict string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = ("observed", False, False, False, None)
#: Verdicts of a move.
LEGAL, ILLEGAL, REPLAY, LATE = "legal", "illegal", "replay", "late"


def moved(state: tuple, event: str, reason: bool, operation: bool, person: bool) -> tuple | None:
    """The state after a move; None if no edge allows it. state: name, conservation passed, validation passed, sure."""
    name, conservation, validation, sure = state
    facts = {"not conservation": not conservation, "conservation": conservation, "not validation": not validation, "validation": validation, "reason": reason, "operation": operation, "high or a person": sure or person}
    for of, before, guards, after in EDGES:
        if of == event and name in before.split() and all(facts[g] for g in guards):
            return after, conservation or event == "conservation_passed", validation or event == "validation_passed", sure or event in ("confidence_high", "answered")
    return None


def _given(x: object) -> bool:
    return isinstance(x, str) and x.strip() != ""


class Proposals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls
        held = self.state.get()
        standing = {} if held is None else dict(zip(held[0], zip(*held[1:], strict=True), strict=True))
        moves, out = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        for proposal, seq, event, reason, operation, actor in zip(*[moves[c].tolist() for c in ("proposal", "seq", "event", "reason", "operation_id", "actor")], strict=True):
            *now, last = standing.get(proposal, START)
            before = now[0]
            if last is not None and seq <= last:
                out.append((proposal, seq, event, before, before, REPLAY if seq == last else LATE))
                continue
            after = moved(tuple(now), event, _given(reason), _given(operation), _given(actor))
            standing[proposal] = (*(after or now), seq)
            out.append((proposal, seq, event, before, (after or now)[0], LEGAL if after else ILLEGAL))
        self.state.update((list(standing), *map(list, zip(*standing.values(), strict=True))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MOVES.split(", ")])

    def close(self) -> None:
        pass


def moves(events: DataFrame) -> DataFrame:
    """A stream of events (proposal, seq, event, reason, operation_id, actor; one number is one event) to its moves: proposal, seq, event, before, after, verdict.

    Events of one proposal come in order of seq, batch by batch; inside a batch they may come in any.
    """
    own = events.select("proposal", F.col("seq").cast("long").alias("seq"), "event", "reason", "operation_id", "actor")
    own = own.withColumn("slice", F.pmod(F.xxhash64("proposal"), F.lit(SLICES)))
    return own.groupBy("slice").transformWithStateInPandas(Proposals(), outputStructType=MOVES, outputMode="Append", timeMode="None")


def follow(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes legal moves to ``folder/moves`` and all others to ``folder/refused``; a batch's part is replaced if the batch is repeated."""
    spark = events.sparkSession
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed processors need it; a query keeps what it started with

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("refused", F.col("verdict") != LEGAL).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("refused", "batch").parquet(f"{folder}/moves")

    try:
        return moves(events).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def told(spark, folder: str, refused: bool) -> DataFrame:
    """The moves that were made, or those that were refused."""
    rows = spark.read.schema(f"{MOVES}, refused boolean, batch long").parquet(f"{folder}/moves")
    return rows.filter(F.col("refused") == refused).drop("refused")


def states(spark, folder: str) -> DataFrame:
    """proposal, state, illegal: as the fold of all events has it."""
    rows = spark.read.schema(f"{MOVES}, refused boolean, batch long").parquet(f"{folder}/moves").filter(F.col("verdict").isin(LEGAL, ILLEGAL))
    return rows.groupBy("proposal").agg(F.max_by("after", "seq").alias("state"), F.count_if(F.col("verdict") == ILLEGAL).alias("illegal"))
