"""Resource catalogs: single files, CSV, SQLite, broker JSON and message streams, behind one registry."""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.filters import Filters, all_of, resource_conditions
from ..operators.records import kept_ribs
from ..types import RESOURCE

CSV = "url string, project string, record_type string, collector string, initial_time bigint, duration bigint, added bigint"
#: How far before the interval a file may begin, and the spans of single files.
SLACK, CSV_SLACK, RIB_SPAN, UPDATE_SPAN = 120, 900 + 120, 1800, 120
BROKER = "version int, time bigint, error string, data struct<resources:array<struct<url:string,project:string,collector:string,type:string,initialTime:bigint,duration:bigint,transport:string,format:string,attr:map<string,string>>>>"


def _resources(rows: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in RESOURCE.replace("map<string,string>", "map").split(", ")]
    return rows.select(*names)


def select(resources: DataFrame, f: Filters, slack: int | None = None) -> DataFrame:
    """Resources that may hold records of the filters; the file time counts with the file's span and a slack for late ones."""
    conditions = resource_conditions(f)
    if f.begin is not None:
        reach = F.coalesce("duration", F.lit(0)) + SLACK if slack is None else F.lit(slack)
        conditions.append(F.col("duration").isNull() | (F.col("initial_time") >= f.begin - reach))
    if f.end is not None:
        conditions.append(F.col("initial_time") <= f.end)
    found = resources.where(all_of(conditions))
    if f.rib_period:
        ribs = found.where("record_type = 'ribs'")
        kept = ribs.join(kept_ribs(ribs, f.rib_period), ["project", "collector", "initial_time"], "left_semi")
        found = found.where("record_type <> 'ribs'").unionByName(kept.select(*found.columns))
    return found


def single_file(spark: SparkSession, f: Filters, rib_file: str | None = None, upd_file: str | None = None, rib_type: str = "mrt", upd_type: str = "mrt", now: int | None = None) -> DataFrame:
    if not (rib_file or upd_file):
        raise ValueError("give rib_file or upd_file")
    now = int(time.time()) if now is None else now
    rows = [("file", form, url, now, span, "singlefile", "singlefile", kind, {}) for url, form, span, kind in ((rib_file, rib_type, RIB_SPAN, "ribs"), (upd_file, upd_type, UPDATE_SPAN, "updates")) if url]
    return spark.createDataFrame(rows, RESOURCE)


def csv_file(spark: SparkSession, f: Filters, csv_file: str, processed: int = 0, now: int | None = None) -> DataFrame:
    """Rows added after `processed` and before this second."""
    now = int(time.time()) if now is None else now
    rows = spark.read.schema(CSV).csv(csv_file).where((F.col("added") > processed) & (F.col("added") <= now - 1))
    dressed = rows.select("*", F.lit("file").alias("transport"), F.lit("mrt").alias("format"), F.create_map().cast("map<string,string>").alias("attrs"))
    return select(_resources(dressed), f, CSV_SLACK)


#: The catalog database.
TABLES = {
    "collectors": "id INTEGER PRIMARY KEY, project TEXT, name TEXT",
    "bgp_types": "id INTEGER PRIMARY KEY, name TEXT",
    "time_span": "collector_id INTEGER, bgp_type_id INTEGER, time_span INTEGER, PRIMARY KEY (collector_id, bgp_type_id)",
    "bgp_data": "collector_id INTEGER, type_id INTEGER, file_time INTEGER, file_path TEXT, ts INTEGER, PRIMARY KEY (collector_id, type_id, file_time)",
}
_SCHEMAS = {"collectors": "id bigint, project string, name string", "bgp_types": "id bigint, name string", "time_span": "collector_id bigint, bgp_type_id bigint, time_span bigint", "bgp_data": "collector_id bigint, type_id bigint, file_time bigint, file_path string, ts bigint"}


def read_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a catalog file; such a file is a driver's file and small."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return {t: spark.createDataFrame(db.execute(f"SELECT {', '.join(c.split()[0] for c in s.split(', '))} FROM {t}").fetchall(), s) for t, s in _SCHEMAS.items()}


def join_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """The catalog join: files with their collector, type and span."""
    c, t, s, d = (tables[x].alias(x) for x in ("collectors", "bgp_types", "time_span", "bgp_data"))
    joined = d.join(c, F.col("bgp_data.collector_id") == F.col("collectors.id")).join(t, F.col("bgp_data.type_id") == F.col("bgp_types.id"))
    joined = joined.join(s, (F.col("time_span.collector_id") == F.col("bgp_data.collector_id")) & (F.col("time_span.bgp_type_id") == F.col("bgp_data.type_id")))
    return joined.select(
        F.lit("file").alias("transport"), F.lit("mrt").alias("format"), F.col("file_path").alias("url"), F.col("file_time").alias("initial_time"), F.col("time_span.time_span").alias("duration"),
        "project", F.col("collectors.name").alias("collector"), F.col("bgp_types.name").alias("record_type"), F.create_map().cast("map<string,string>").alias("attrs"), F.col("ts").alias("added"),
    )


def listing(tables: dict[str, DataFrame]) -> DataFrame:
    """(project, collector, record_type, initial_time, url, added) of every file that the catalog knows, whether or not its span is known."""
    d, c, t = (tables[x].alias(x) for x in ("bgp_data", "collectors", "bgp_types"))
    joined = d.join(c, F.col("bgp_data.collector_id") == F.col("collectors.id")).join(t, F.col("bgp_data.type_id") == F.col("bgp_types.id"))
    return joined.select("project", F.col("collectors.name").alias("collector"), F.col("bgp_types.name").alias("record_type"), F.col("file_time").alias("initial_time"), F.col("file_path").alias("url"), F.col("ts").alias("added"))


def sqlite(spark: SparkSession, f: Filters, db_file: str, processed: int = 0, now: int | None = None) -> DataFrame:
    now = int(time.time()) if now is None else now
    joined = join_catalog(read_database(spark, db_file)).where((F.col("added") > processed) & (F.col("added") <= now))
    return select(_resources(joined), f).orderBy(F.col("initial_time").desc(), F.col("record_type").desc())


def upsert(catalog: DataFrame, added: DataFrame) -> DataFrame:
    """(project, collector, record_type, initial_time, url, duration, added): the newest row of a file wins; of update files
    the largest span of a collector holds for all, dumps have RIB_FILE_SPAN."""
    both = catalog.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    keys = ["project", "collector", "record_type", "initial_time"]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct("url", "added"), F.struct("_new", "added")).alias("_row"))
    spans = both.groupBy("project", "collector", "record_type").agg(F.max("duration").alias("_span"))
    span = F.when(F.col("record_type") == "ribs", SLACK).otherwise(F.col("_span")).cast("long")
    return newest.join(spans, ["project", "collector", "record_type"]).select(*keys, F.col("_row.url").alias("url"), span.alias("duration"), F.col("_row.added").alias("added"))


def write_database(catalog: DataFrame, path: str) -> None:
    """Create or replace the catalog file from catalog rows."""
    rows = catalog.select("project", "collector", "record_type", "initial_time", "url", "duration", "added").collect()
    with sqlite3.connect(path) as db:
        for name, columns in TABLES.items():
            db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
        db.executemany("INSERT OR IGNORE INTO bgp_types VALUES (?, ?)", [(1, "ribs"), (2, "updates")])
        types = {"ribs": 1, "updates": 2}
        for project, collector in sorted({(r.project, r.collector) for r in rows}):
            if not db.execute("SELECT 1 FROM collectors WHERE project = ? AND name = ?", (project, collector)).fetchone():
                db.execute("INSERT INTO collectors (project, name) VALUES (?, ?)", (project, collector))
        ids = {(p, n): i for i, p, n in db.execute("SELECT id, project, name FROM collectors")}
        db.executemany("INSERT OR REPLACE INTO bgp_data VALUES (?, ?, ?, ?, ?)", [(ids[r.project, r.collector], types[r.record_type], r.initial_time, r.url, r.added) for r in rows])
        db.executemany("INSERT OR REPLACE INTO time_span VALUES (?, ?, ?)", sorted({(ids[r.project, r.collector], types[r.record_type], r.duration) for r in rows}))


def broker_url(base: str, f: Filters, params: tuple[str, ...] = (), since: int | None = None) -> str:
    """The query of a broker for these filters."""
    lists = (("projects", f.project), ("collectors", f.collector), ("routers", f.router), ("peer_asns", f.peer), ("types", f.type), ("resourceTypes", f.resourcetype))
    parts = [f"{name}[]={quote(str(v))}" for name, values in lists for v in values] + list(params)
    if f.begin is not None:
        parts.append(f"intervals[]={f.begin},{f.end or 0}")
    if since is not None:
        parts += [f"dataAddedSince={since}", f"minInitialTime={f.begin or 0}"]
    return f"{base}/data?{'&'.join(parts)}"


def parse_broker(responses: DataFrame, column: str = "value") -> DataFrame:
    """Resources of broker responses; a response with an error or of another version gives none."""
    parsed = responses.select(F.from_json(F.col(column), BROKER).alias("r")).where("r.error is null and r.version = 2")
    rows = parsed.select(F.explode("r.data.resources").alias("x")).select("x.*")
    dressed = rows.select(
        F.coalesce("transport", F.lit("file")).alias("transport"), F.coalesce("format", F.lit("mrt")).alias("format"), "url", F.col("initialTime").alias("initial_time"),
        F.nullif("duration", F.lit(0)).alias("duration"), "project", "collector", F.col("type").alias("record_type"), F.coalesce("attr", F.create_map().cast("map<string,string>")).alias("attrs"),
    )
    return _resources(dressed).dropDuplicates(["project", "collector", "record_type", "initial_time", "duration", "url"])


def broker(spark: SparkSession, f: Filters, responses: str) -> DataFrame:
    """Resources from broker responses kept as files (one JSON a line), fetched from `broker_url` beforehand."""
    return select(parse_broker(spark.read.text(responses)), f)


def kafka(spark: SparkSession, f: Filters, brokers: str, topic: str, group: str = "", offset: str = "latest", data_type: str = "bmp", project: str = "", collector: str = "") -> DataFrame:
    """One endless resource."""
    if offset not in ("earliest", "latest"):
        raise ValueError(f"bad offset: {offset}")
    row = ("kafka", data_type, brokers, 0, None, project, collector, "updates", {"topic": topic, "group": group, "offset": offset})
    return spark.createDataFrame([row], RESOURCE)


@dataclass(frozen=True)
class Interface:
    name: str
    about: str
    load: Callable[..., DataFrame]
    options: tuple[str, ...]


INTERFACES = {
    i.name: i
    for i in (
        Interface("broker", "resources from broker responses", broker, ("responses",)),
        Interface("singlefile", "one dump and one update file", single_file, ("rib_file", "rib_type", "upd_file", "upd_type", "now")),
        Interface("csvfile", "a catalog in CSV", csv_file, ("csv_file", "processed", "now")),
        Interface("sqlite", "a catalog in SQLite", sqlite, ("db_file", "processed", "now")),
        Interface("kafka", "a message stream", kafka, ("brokers", "topic", "group", "offset", "data_type", "project", "collector")),
    )
}
DEFAULT = "broker"


def load(spark: SparkSession, name: str, f: Filters | None = None, **options: str) -> DataFrame:
    """Resources of an interface by its name."""
    if name not in INTERFACES:
        raise ValueError(f"unknown interface: {name}")
    if bad := set(options) - set(INTERFACES[name].options):
        raise ValueError(f"unknown options of {name}: {', '.join(sorted(bad))}")
    return INTERFACES[name].load(spark, f or Filters(), **options)


def append_catalog(resources: DataFrame, path: str) -> DataFrame:
    """Add resources to a Parquet catalog, once each, and return it; the catalog is partitioned for pruning."""
    spark = resources.sparkSession
    keys = ["project", "collector", "record_type", "initial_time"]
    try:
        fresh = resources.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException:  # no catalog yet
        fresh = resources
    fresh.write.mode("append").partitionBy("project", "record_type").parquet(path)
    return spark.read.parquet(path)
