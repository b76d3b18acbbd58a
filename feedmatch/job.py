"""One run over landed postings: funnel, fresh matches, verdicts, digest, audits and the seen history.

Modes (SNK-03): ``read`` writes nothing; ``mark`` writes the digest and marks
its rows as seen; ``deliver`` also hands the digest to the sink and marks its
rows as notified.  Every step is committed to the run's ledger, digest and
delivery before the history.  Rows held back by the cap are never marked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmatch.operators import dedupe as D
from feedmatch.operators import digest as G
from feedmatch.operators import matching as M
from feedmatch.operators import state as S
from feedmatch.operators import verdicts as V
from feedmatch.operators.backlog import RankedQueue
from feedmatch.operators.ledger import Ledger
from feedmatch.operators.store import BUCKETS
from feedmatch.operators.history import IdentityIndex, SeenHistory, identity_rows
from feedmatch.prefs import Prefs
from feedmatch.session import cut_lineage, new_folder

MODES = ("read", "mark", "deliver")


@dataclass(frozen=True)
class Outcome:
    """What a run found; every frame is lazy over checkpointed rows."""

    digest: DataFrame
    facts: DataFrame
    backlog: int
    matched: DataFrame
    rejects: DataFrame
    to_classify: DataFrame
    verdicts: DataFrame
    seen: DataFrame
    ledger: Ledger


def digest_rank() -> Column:
    """SRT-01: score descending, lower(title), then fetch order (total order)."""
    return F.struct((-F.col("score")).alias("neg_score"), F.lower(F.col("title")).alias("title_l"),
                    F.col("ord").alias("ord"))


def fresh_top(rows: DataFrame, seen: DataFrame, rank: Column, cap: int, limit: int | None = None) -> tuple[DataFrame, int]:
    """JN-02, WIN-01, SRT-02: the best ``cap`` rows that neither the history nor a better row has, and the backlog.

    ``rows`` and ``seen`` carry job_key, url_norm and fingerprint.
    """
    fresh = cut_lineage(D.greedy_dedupe(D.anti_seen(rows, seen), rank, "ord"))
    top, backlog = G.top_n(fresh, cap, rank, limit)
    return cut_lineage(top), backlog


def run(postings: DataFrame, seen: DataFrame, prefs: Prefs, now: datetime, mode: str = "read", out: str | None = None,
        register: DataFrame | None = None, verdicts: DataFrame | None = None, replies: DataFrame | None = None,
        limit: int | None = None, sink: Callable[[DataFrame], None] | None = None, run_id: str | None = None,
        redeliver: bool = False) -> Outcome:
    """Run once over ``postings`` (as ``map_records`` gives them) against the ``seen`` snapshot.

    ``out`` is the run's folder: matched, top, digest, rejects, to_classify,
    verdicts, seen and the ledger are written below it.  A run called again
    with the same folder and ``run_id`` (default: the folder) goes on at the
    step it stopped at; a digest is delivered once under a run id (see
    ``Ledger``).  ``verdicts`` (stored) or ``replies`` (landed, with the columns
    job_key and reply) turn on the classifier step, which judges the capped
    rows only (EXT-04).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode != "read" and not out:
        raise ValueError("a run that marks rows needs a folder to write to")
    if mode == "deliver" and sink is None:
        raise ValueError("a run that delivers needs a sink")
    spark = postings.sparkSession
    out = out if mode != "read" else new_folder(spark, "read")  # a read leaves nothing in the run's own folder
    ledger = Ledger(spark, out, run_id or out)
    seen = S.normalise_seen(seen)
    matched = ledger.table("matched", lambda: M.narrow(M.match(postings, prefs, now, register)))

    held: list[int] = []

    def best() -> DataFrame:
        rows = D.with_identities(matched.filter(F.col("reject_reason").isNull()))
        top, backlog = fresh_top(rows, seen, digest_rank(), prefs.max_jobs, limit)
        held.append(backlog)
        return top

    top = ledger.table("top", best, note=lambda: held[0])
    backlog = ledger.find("top")["note"]
    stored = spark.createDataFrame([], "job_key string, verdict string, reason string") if verdicts is None else verdicts
    pending = ledger.table("to_classify", lambda: V.to_classify(top, stored, postings))
    judged = top
    if verdicts is not None or replies is not None:
        landed = spark.createDataFrame([], "job_key string, reply string") if replies is None else replies
        judged = ledger.table("judged", lambda: V.apply_verdicts(top, stored, landed))
        stored = V.merge_verdicts(stored, landed)
    digest = ledger.table("digest", lambda: G.group_digest(judged, now))
    rejects = ledger.table("rejects", lambda: M.rejects(matched), by=("reject_reason",))
    stored = ledger.table("verdicts", lambda: stored)
    after = S.upsert_seen(seen, top, now, notified=mode == "deliver")
    if mode == "deliver":
        ledger.deliver(digest, sink, redeliver)
    if mode != "read":
        after = ledger.table("seen", lambda: after)
    return Outcome(digest, G.facts(judged, now), backlog, matched, rejects, pending, stored, after, ledger)


def stream_fresh(landing: str, schema, seen: DataFrame, out: str, cap: int, now: datetime,
                 rank: Callable[[], Column] = lambda: F.struct("ord"), fmt: str = "parquet", buckets: int = BUCKETS) -> RankedQueue:
    """STR-03: one availableNow pass over what landed since the last one, deduplicated against earlier batches.

    A batch admits the rows that neither the history nor an earlier batch has, best first among its own, and appends
    them to a ranked queue; the best ``cap`` rows of the queue are delivered, the others stay in it (SRT-03), so every
    admitted row is delivered once, by this batch, a later one or ``deliver_rest``.  Admission looks identities up in a
    stored index behind a filter, so neither held rows nor the history are read again.  Batch ``n`` writes version
    ``n + 1`` of index and history from version ``n`` and version ``n`` of the queue: run again, it gives the same.
    ``seen`` is the history before batch 0.
    """
    spark = seen.sparkSession
    queue = _queue(spark, out, schema, rank)

    def each(batch: DataFrame, n: int) -> None:
        known, history = IdentityIndex(spark, f"{out}/known", buckets), SeenHistory(spark, f"{out}/seen", buckets).rows
        if n == 0:
            history.create(S.normalise_seen(seen))
            known.create(identity_rows(history.read(version=0)))
        landed = cut_lineage(D.with_identities(batch))
        admitted = cut_lineage(D.greedy_dedupe(known.anti_known(landed, version=n), rank(), "ord"))
        known.change(identity_rows(admitted), version=n)
        top = queue.step(n, admitted, cap)
        top.withColumn("held", F.lit(queue.left(n))).write.mode("overwrite").parquet(f"{out}/delivered/batch={n}")
        history.update(top, lambda old, new: S.upsert_seen(old, new, now, notified=True), version=n)

    stream = spark.readStream.schema(schema).format(fmt).load(landing)
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/state")
                   .trigger(availableNow=True).start())
    query.awaitTermination()
    return queue


def deliver_rest(queue: RankedQueue, out: str, cap: int, batches: int) -> None:
    """What the batches after the first ``batches`` deliver when nothing more lands, in one pass: batch, position and held."""
    rest = queue.drain(batches - 1, cap).withColumn("batch", F.col("step") + batches - 1).drop("step")
    total = queue.left(batches - 1)
    rest = rest.withColumn("held", F.greatest(F.lit(0).cast("bigint"), F.lit(total) - (F.col("batch") - batches + 1) * F.lit(cap)))
    rest.write.mode("overwrite").parquet(f"{out}/rest")


def _queue(spark, out: str, schema, rank: Callable[[], Column]) -> RankedQueue:
    return RankedQueue(spark, f"{out}/queue", D.with_identities(spark.createDataFrame([], schema)).schema, rank)
