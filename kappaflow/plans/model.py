"""Model connector, response cache and stage tables.

A *model* turns a DataFrame of requests
    (request_key, method, report_id, messages ARRAY<STRUCT<role, content>>)
into responses (request_key, payload STRING, error STRING).  Providers:

* ``ReplayModel``   recorded responses; the answer is a join (no Python).
* ``PandasModel``   any user callable (HTTP client, local model) run by
                    ``mapInPandas`` in waves of small tasks: one client per
                    task, a limit of calls in flight and of calls a second,
                    errors kept per row, answers logged wave by wave.
* ``RuleModel``     offline grader: the pattern rules of ``annotate`` applied
                    to the report inside Spark (JVM-side, no Python).

``cached_model_call`` sends each distinct request key once: known keys are
answered from a cache table by join, the rest go to the model, and the new
answers can be appended to the cache and written as a stage table before
anyone reads them twice (a lazy plan that feeds two branches would
otherwise call the model twice, and a retried task must not call again).
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, stage_root

RESPONSE_SCHEMA = T.StructType([
    T.StructField("request_key", T.StringType(), False),
    T.StructField("payload", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])


DEFAULT_WORKERS = 5
#: Calls of one task: what is repeated when a task is lost.
CALLS_PER_TASK = 50
#: Where the caller names no number, tasks get more calls as long as a wave of them takes less time than this.
WAVE_SECONDS = 20.0
#: Open requests lie in so many folders, by ranges of the keys' hashes.
REQUEST_FOLDERS = 128
HASHES = 1 << 63


def request_key(model_name: str, method: str, template: str, values: list[Column]) -> Column:
    """SHA-256 over model, method, template and the values put into it, each with its length."""
    parts = [x for v in values for x in (F.length(v).cast("string"), v)]
    return F.sha2(F.concat_ws("\u001f", F.lit(model_name), F.lit(method), F.sha2(F.lit(template).cast("binary"), 256), *parts), 256)


class ReplayModel:
    """Answers from a recorded table.

    ``by="request_key"`` for a cache-shaped table (request_key, payload), or
    ``by=("method", "report_id")`` for responses recorded per report.
    """

    needs_stage = False
    reads = ()

    def __init__(self, responses: DataFrame, by=("method", "report_id")):
        self.responses = responses
        self.by = [by] if isinstance(by, str) else list(by)

    def answer(self, requests: DataFrame, methods: list[str] | None = None) -> DataFrame:
        r = self.responses
        if methods and "method" in r.columns:  # lets Catalyst drop other methods' branches
            r = r.where(F.col("method").isin(methods))
        r = r.select(*self.by, "payload")
        return (requests.select("request_key", *[c for c in self.by if c != "request_key"])
                .join(r, self.by, "left")
                .select("request_key", "payload",
                        F.when(F.col("payload").isNull(), F.lit("no recorded response")).alias("error")))


class PandasModel:
    """A user callable per request, run inside Spark tasks, with a log of answers.

    ``make_client()`` runs once per partition task (X6); ``call(client,
    messages, method) -> str`` once per request; exceptions become the
    ``error`` column and a NULL payload (Q8 defaults apply downstream).

    Requests are sent in waves of ``partitions`` tasks with ``calls_per_task`` calls each, so
    at most ``partitions`` calls are in flight however many requests there are (X7), and
    a table of requests is many small tasks.  Without a number a task has ``CALLS_PER_TASK`` calls at first and
    twice as many as before while a wave takes less than half of ``WAVE_SECONDS``: quick calls do not make
    a wave for every few hundred requests, and a lost task still repeats seconds of work.
    Each wave is appended to the log, a folder
    in the shared stage folder: a lost task repeats its own calls only, and a restarted run
    (same log) sends nothing again that was answered.  ``per_second`` limits the rate of all tasks
    together, whatever their number; ``delay`` is a pause after each call of a task.
    """

    needs_stage = False  # the log is the stage
    logs = True
    reads = ("messages",)

    def __init__(self, call: Callable, make_client: Callable | None = None, delay: float = 0.0,
                 partitions: int = DEFAULT_WORKERS, calls_per_task: int | None = None, per_second: float | None = None):
        self.call, self.make_client = call, make_client or (lambda: None)
        self.delay, self.partitions, self.calls_per_task, self.per_second = delay, partitions, calls_per_task, per_second

    def _runner(self):
        call, make_client, delay = self.call, self.make_client, self.delay
        # A task's share of the rate: the time from one call's start to the next one's.
        apart = self.partitions / self.per_second if self.per_second else 0.0

        def run(batches):
            import pandas as pd
            client, due = make_client(), 0.0
            for pdf in batches:
                payloads, errors = [], []
                for msgs, method in zip(pdf["messages"], pdf["method"]):
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + apart
                    try:
                        m = [{"role": x["role"], "content": x["content"]} for x in msgs]
                        payloads.append(call(client, m, method))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - isolate one failed request
                        payloads.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                    if delay:
                        time.sleep(delay)
                yield pd.DataFrame({"request_key": pdf["request_key"], "payload": payloads, "error": errors})

        return run

    def answer(self, requests: DataFrame, methods: list[str] | None = None, log: str | None = None) -> DataFrame:
        spark = requests.sparkSession
        shared, log = log is not None, log or f"{stage_root(spark)}/answers-{uuid.uuid4().hex[:12]}"
        open_ = requests.select("request_key", "method", "messages")
        if shared:
            done = read_answers(spark, f"{log}/answers")
            open_ = open_.join(done.where(F.col("payload").isNotNull()).select("request_key").distinct(), "request_key", "left_anti")
        self._send(open_, log)
        # One row per request: an answer counts more than the failure before it.
        found = read_answers(spark, f"{log}/answers").groupBy("request_key").agg(
            F.max("payload").alias("payload"), F.max("error").alias("error"))
        found = found.withColumn("error", F.when(F.col("payload").isNull(), F.col("error")))
        # A log of its own holds these requests only.
        return found.join(requests.select("request_key").distinct(), "request_key", "left_semi") if shared else found

    def _send(self, open_: DataFrame, log: str) -> None:
        """Prompts are built once, one for each key, in folders by ranges of the keys' hashes; a wave is the next range."""
        spark, asked = open_.sparkSession, f"{log}/requests-{uuid.uuid4().hex[:12]}"
        hashed = open_.withColumn("hash", F.shiftrightunsigned(F.xxhash64("request_key"), 1))
        folder = F.shiftright("hash", 63 - REQUEST_FOLDERS.bit_length() + 1).cast("int")
        one = hashed.withColumn("folder", folder).repartition("folder").dropDuplicates(["folder", "hash", "request_key"])
        one.sortWithinPartitions("folder", "hash").write.partitionBy("folder").parquet(asked)
        fs, root = _file_system(spark, asked)
        folders = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if "=" in s.getPath().getName()}
        number = spark.read.schema(hashed.schema).parquet(*[f"{asked}/folder={k}" for k in sorted(folders)]).count() if folders else 0
        low, calls = 0, self.calls_per_task or CALLS_PER_TASK
        while number and low < HASHES:
            waves = -(-number // (self.partitions * calls))  # if all were of this size
            high = low + -(-HASHES // waves)
            touched = [k for k in sorted(folders) if low < (k + 1) * (HASHES // REQUEST_FOLDERS) and k * (HASHES // REQUEST_FOLDERS) < high]
            if touched:
                began = time.monotonic()
                wave = spark.read.schema(hashed.schema).parquet(*[f"{asked}/folder={k}" for k in touched])
                wave = wave.where((F.col("hash") >= low) & (F.col("hash") <= min(high, HASHES) - 1)).drop("hash")
                # By number: AQE does not coalesce it, and no task holds more than its share.
                wave.repartition(self.partitions).mapInPandas(self._runner(), RESPONSE_SCHEMA).write.mode("append").parquet(f"{log}/answers")
                took = time.monotonic() - began
                if self.calls_per_task is None:
                    calls = calls * 2 if took < WAVE_SECONDS / 2 else max(CALLS_PER_TASK, calls // 2) if took > WAVE_SECONDS else calls
            low = high
        drop_folder(spark, asked)


def read_answers(spark, path: str) -> DataFrame:
    """The answers that are in a log; none where there is no log."""
    fs, folder = _file_system(spark, path)
    if not fs.exists(folder):
        return spark.createDataFrame([], RESPONSE_SCHEMA)
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)


def drop_folder(spark, path: str) -> bool:
    fs, folder = _file_system(spark, path)
    return fs.delete(folder, True)


class RuleModel:
    """Offline grader: max grade of the rules that a report's own text meets, 1 if none.

    Requests need a ``report`` column: the prompt also holds instructions and term lists.
    """

    needs_stage = False
    reads = ("report",)

    def __init__(self, rules: dict[int, list[str]] | None = None):
        self.rules = rules

    def answer(self, requests: DataFrame, methods: list[str] | None = None) -> DataFrame:
        from ..operators.annotate import rule_grade
        g = rule_grade(requests.select("request_key", F.col("report").alias("text")), "text", self.rules, key="request_key")
        answer = F.struct(F.col("grade"), F.lit(1).alias("choice"), F.lit("rules").alias("explanation"))
        return g.select("request_key", F.to_json(answer).alias("payload"),
                        F.lit(None).cast("string").alias("error"))


def _file_system(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


MANIFEST = "_manifest"


def table_version(*tables: DataFrame, **params) -> str:
    """Fingerprint of tables and parameters: rows and the sum of row hashes of each, whatever their order.

    Maps have no hash in Spark, so they enter as their JSON text.
    """
    parts = []
    for df in tables:
        cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
        n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
        parts.append(f"{df.dtypes}:{n}:{total}")
    parts += [f"{k}={v!r}" for k, v in sorted(params.items())]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def stage_table(df: DataFrame, name: str, folder: str | None = None, version: str | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared stage folder and read it back.

    Cuts the lineage (a retried downstream task reads the file, it does not
    call the model again).  The folder is a sub-folder of the cluster's
    ``spark.checkpoint.dir`` unless one is given.  A name with a slash,
    ``<run>/<stage>``, belongs to a run that can be resumed: a stage that was
    completed (it has its _SUCCESS file) for the same ``version`` (see ``table_version``; kept beside the
    data) is read, not computed again; one of another version is computed anew.
    ``clear_run`` removes the run, ``clear_old_stages`` what is old.  Other names get a folder of their own.
    """
    spark = df.sparkSession
    root = (folder or stage_root(spark)).rstrip("/")
    found = read_stage(spark, name, folder, version, df.schema)
    if found is not None:
        return found
    path = f"{root}/{name}" if "/" in name else f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    if version:
        fs, at = _file_system(spark, f"{path}/{MANIFEST}")
        out = fs.create(at, True)
        out.write(bytearray(version.encode()))
        out.close()
    return spark.read.parquet(path)


def read_stage(spark, name: str, folder: str | None = None, version: str | None = None, schema: T.StructType | None = None) -> DataFrame | None:
    """The stage of a run, if it was completed for this version; else None."""
    path = f"{(folder or stage_root(spark)).rstrip('/')}/{name}"
    if "/" not in name:
        return None
    fs, done = _file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done) or _read_manifest(spark, path) != (version or ""):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _read_manifest(spark, path: str) -> str:
    fs, at = _file_system(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _run_name(run: str) -> str:
    if not run or "/" in run.strip("/") or run.startswith("."):
        raise ValueError(f"not the name of a run: {run!r}")
    return run


def clear_run(spark, run: str, folder: str | None = None) -> bool:
    """Remove the stages of a run; True if there were any."""
    return drop_folder(spark, f"{(folder or stage_root(spark)).rstrip('/')}/{_run_name(run)}")


def clear_old_stages(spark, older_than_seconds: float, folder: str | None = None) -> list[str]:
    """Remove runs and unnamed stages that nothing has been added to for so long; their names."""
    fs, root = _file_system(spark, (folder or stage_root(spark)).rstrip("/"))
    if not fs.exists(root):
        return []
    limit, gone = (time.time() - older_than_seconds) * 1000, []
    for status in fs.listStatus(root):
        inside = [s.getModificationTime() for s in fs.listStatus(status.getPath())] if status.isDirectory() else []
        if max([status.getModificationTime(), *inside]) < limit:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().getName())
    return sorted(gone)


def timed_stage(df: DataFrame, name: str, status_col: str | None = None, folder: str | None = None) -> tuple[DataFrame, dict]:
    """A stage table and its statistics: rows, failures, seconds, seconds per row.

    Rows and failures are observed while the stage is written; no second scan.
    ``name`` must not be a completed stage of a run, which would not be written.
    """
    from pyspark.sql import Observation
    seen = Observation(f"stage-{uuid.uuid4().hex[:8]}")
    failed = F.count(F.when(F.col(status_col) != "ok" if status_col else F.lit(False), 1))
    began = time.perf_counter()
    out = stage_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), failed.alias("failures")), name, folder)
    seconds = time.perf_counter() - began
    got = seen.get
    rows = got["rows"]
    return out, {"stage": name, "rows": rows, "failures": got["failures"], "seconds": seconds,
                 "seconds_per_row": seconds / rows if rows else None}


def cached_model_call(requests: DataFrame, model, cache: DataFrame | None = None,
                      stage: str | None = None, cache_path: str | None = None,
                      methods: list[str] | None = None) -> DataFrame:
    """M3: answer every request, calling the model once per distinct key.

    requests: report_id, method, messages, request_key (one row per report).
    Returns (report_id, request_key, payload, error, cached): narrow.

    The keys are taken in one pass over the texts and kept in the checkpoint
    folder; prompts are built only for the requests that a provider reads,
    after equal ones have been dropped, and never travel with the answers.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    keys = requests.select("report_id", "method", "request_key").checkpoint()
    uniq = keys.groupBy("request_key").agg(F.min("report_id").alias("report_id"), F.any_value("method").alias("method"))
    known = None
    if cache is not None:
        # One row per key: a cache that two runs have filled may hold a key twice.
        known = cache.where(F.col("payload").isNotNull()).groupBy("request_key").agg(
            F.min("payload").alias("payload")).select("request_key", "payload", F.lit(None).cast("string").alias("error"))
        uniq = uniq.join(known.select("request_key"), "request_key", "left_anti")
    reads = getattr(model, "reads", ("messages",))
    if reads:
        uniq = uniq.join(requests.select("report_id", *reads), "report_id")
    if getattr(model, "logs", False):
        fresh = model.answer(uniq, methods, log=f"{stage_root(uniq.sparkSession)}/{stage}-log" if stage and "/" in stage else None)
    else:
        fresh = model.answer(uniq, methods)
    if getattr(model, "needs_stage", True):
        # Real calls are written once and read back: the answers feed the
        # cache append and the result, and a lazy plan would call twice.
        fresh = stage_table(fresh, stage or "model-answers")
    if cache_path is not None:
        fresh.where(F.col("payload").isNotNull()).select("request_key", "payload").write.mode("append").parquet(cache_path)
    answers = fresh.withColumn("cached", F.lit(False))
    if known is not None:
        answers = answers.unionByName(known.withColumn("cached", F.lit(True)))
    return keys.select("report_id", "request_key").join(answers, "request_key", "left")


CACHE_SCHEMA = "request_key string, payload string"
#: Key buckets of a cache; an append and a compaction write each as files of its own.
CACHE_BUCKETS = 64


def append_cache(answers: DataFrame, path: str) -> None:
    """Add (request_key, payload) to a cache as a new generation, dealt out by key buckets."""
    bucket = F.pmod(F.xxhash64("request_key"), F.lit(CACHE_BUCKETS)).cast("int")
    rows = answers.where(F.col("payload").isNotNull()).select("request_key", "payload", bucket.alias("bucket"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/generation={time.time_ns()}-{uuid.uuid4().hex[:6]}")


def _generations(spark, path: str) -> list[str]:
    """Complete generations, oldest first; one that is merged away is no longer named by the list."""
    fs, root = _file_system(spark, path)
    if not fs.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("generation="))
    done = [n for n in names if fs.exists(_file_system(spark, f"{path}/{n}/_SUCCESS")[1])]
    # A merged generation is named after the newest it holds: what is not newer is in it.
    merged = [n for n in done if n.endswith("-merged")]
    return [f"{path}/{n}" for n in done if not merged or n >= merged[-1]]


def read_cache(spark, path: str) -> DataFrame:
    """The cache's rows; after ``compact_cache`` one for each key.  Generations are read bucket by bucket, without a shuffle."""
    out = None
    for folder in _generations(spark, path):
        part = spark.read.schema(CACHE_SCHEMA).parquet(folder).select("request_key", "payload")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], CACHE_SCHEMA)


def compact_cache(spark, path: str, *, drop: bool = True) -> int:
    """Merge all generations into one with one row for each key; returns the number merged.

    The merged generation counts as soon as it is complete, and only then are the old ones removed (``drop``),
    so a lost job loses nothing.
    """
    parts = _generations(spark, path)
    if len(parts) < 2:
        return 0
    newest = parts[-1].rsplit("=", 1)[1].removesuffix("-merged")
    rows = read_cache(spark, path).groupBy("request_key").agg(F.min("payload").alias("payload"))
    bucket = F.pmod(F.xxhash64("request_key"), F.lit(CACHE_BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/generation={newest}-merged")
    for folder in parts if drop else ():
        drop_folder(spark, folder)
    return len(parts)
