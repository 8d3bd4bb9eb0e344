"""The pipeline over a stream of documents: micro-batches through the batch plan, with the template table between.

A batch resolves against the templates that the one before left. The table is written as a new version for each batch
and a batch that is run again writes its own version again, so a restart neither loses nor doubles what was taught.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.options import Options
from ..plans.pipeline import Ports, run_batch
from ..plans.schemas import TEMPLATE

TEMPLATES = f"template_id string, ids struct<vat_id:string,tax_number:string,ibans:array<string>,name_hash:string>, body {TEMPLATE}, version int, source string"


def _version(root: str, batch: int) -> str:
    return f"{root}/templates/v={batch}"


def templates_before(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The table that batch ``batch`` starts from; empty before the first."""
    if batch == 0:
        return spark.createDataFrame([], TEMPLATES)
    return spark.read.schema(TEMPLATES).parquet(_version(root, batch - 1))


def process(root: str, options: Options | None = None, ports: Ports | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does: documents, templates, escalations and events, each in a folder of the batch."""

    def one(docs: DataFrame, batch: int) -> None:
        spark = docs.sparkSession
        done = run_batch(docs, templates_before(spark, root, batch), options, ports=ports)
        columns = [F.col(n).cast(t.simpleString()).alias(n) for n, t in ((f.name, f.dataType) for f in spark.createDataFrame([], TEMPLATES).schema)]
        for name, rows in (("documents", done.documents), ("escalations", done.escalations), ("events", done.events)):
            rows.write.mode("overwrite").parquet(f"{root}/{name}/v={batch}")
        done.templates.select(*columns).write.mode("overwrite").parquet(_version(root, batch))

    return one


def start(docs: DataFrame, root: str, options: Options | None = None, once: bool = True, ports: Ports | None = None) -> StreamingQuery:
    """Run a stream of positioned documents; with ``once``, until all there is has been read."""
    writer = docs.writeStream.foreachBatch(process(root, options, ports)).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def health(query: StreamingQuery, root: str, layout: bool | None = None) -> dict:
    """Whether the store can be read and the worker runs; both decide on ``ok``. The layout service is told, if known,
    but does not decide."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    try:
        store = bool(there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there))
    except Exception as e:  # any store that does not answer is down
        return {"ok": False, "store": str(e)[:200], "worker": query.isActive, "layout": layout}
    worker = query.isActive or query.exception() is None
    return {"ok": store and worker, "store": store, "worker": worker, "layout": layout}
