"""Review requests as a stream: each micro-batch is one many-repository run.

The reviewed service takes review requests one by one over HTTP.  Here the
requests arrive as files in a folder (``repo_url, mode, requested_at``);
Structured Streaming picks up new files, and ``foreachBatch`` runs the
batch job :func:`codesieve.plans.corpus.run_review` on them.  A batch is
named by the stream's own id, which its checkpoint keeps, and the batch
number: a batch that failed half-way is redone under the same name, and no
other stream or checkpoint ever uses it.  Requests without a repository are
part of the batch: their outcome is recorded as rejected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codesieve import rules
from codesieve.plans.corpus import run_review

REQUEST_SCHEMA = "repo_url string, mode string, requested_at timestamp_ntz"


def start_review_stream(spark: SparkSession, requests_dir: str, files: DataFrame, refs: DataFrame, tables,
                        checkpoint_location: str, max_files: int | None = None,
                        available_now: bool = False, branch: str = rules.DEFAULT_BRANCH,
                        default_mode: str = rules.DEFAULT_MODE, smart_cap: int | None = rules.SMART_CAP,
                        recent_cap: int | None = rules.RECENT_FALLBACK_CAP) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes what is there and stops.

    ``checkpoint_location`` belongs to this stream alone, in a shared folder.
    """
    requests = spark.readStream.schema(REQUEST_SCHEMA).parquet(requests_dir)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # the run time is the latest request time of the batch: the same on a retry
        latest, n = batch.agg(F.max("requested_at"), F.count(F.lit(1))).first()
        if not n:
            return
        stream_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run_ts = (dt.datetime(1970, 1, 1) if latest is None else
                  latest if isinstance(latest, dt.datetime) else dt.datetime.fromisoformat(str(latest)))
        run_review(tables, files, refs, batch, run_ts, run_id=f"{stream_id}/{batch_id}", max_files=max_files,
                   branch=branch, default_mode=default_mode, smart_cap=smart_cap, recent_cap=recent_cap)

    w = requests.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
