"""Live providers of metrics as a stream, and the table of their latest values.

A provider is a Unix socket that writes one snapshot in the text exposition format and closes, or an address that
answers with one over HTTP. A scrape asks all of them, within a deadline each, and is kept in a spool until the batch
that holds it is committed, so that a query that restarts gets the same rows again although the providers have moved on.
"""

from __future__ import annotations

import json
import re
import socket
import threading
import time
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from weir.session import shared_dir
from weir.sources.prometheus import samples_of

#: Milliseconds that a provider has, and bytes that its snapshot may have; beyond either it is passed over.
DEADLINE, LARGEST = 50, 16 << 20
SAMPLES = "provider string, scrape long, scraped timestamp, line_no int, name string, labels map<string,string>, value double, type string"


def scrape_socket(path: str, deadline_ms: int = DEADLINE) -> str | None:
    """What the socket writes until it closes; None if it doesn't answer in time, or without end."""
    ends, parts, size = time.monotonic() + deadline_ms / 1000, [], 0
    try:
        with socket.socket(socket.AF_UNIX, socket.SOCK_STREAM) as s:
            s.settimeout(deadline_ms / 1000)
            s.connect(path)
            while size <= LARGEST:
                s.settimeout(max(ends - time.monotonic(), 1e-3))
                part = s.recv(1 << 16)
                if not part:
                    return b"".join(parts).decode("utf-8", "replace")
                if time.monotonic() > ends:
                    return None
                parts.append(part)
                size += len(part)
    except OSError:
        pass
    return None


def scrape_url(url: str, deadline_ms: int = DEADLINE) -> str | None:
    try:
        with urllib.request.urlopen(url, timeout=deadline_ms / 1000) as r:
            text = r.read(LARGEST + 1)
            return text.decode("utf-8", "replace") if len(text) <= LARGEST else None
    except (OSError, ValueError):
        return None


def _spool(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class ProviderReader(SimpleDataSourceStreamReader):
    """Offsets are numbers of scrapes."""

    def __init__(self, options):
        self.folder, self.own = options.get("path"), options.get("own", "weir")
        self.urls = [u.split("=", 1) if re.match(r"\w[\w.-]*=", u) else [u, u] for u in (options.get("urls") or "").split(",") if u]
        self.deadline = int(options.get("deadlineMs", str(DEADLINE)))
        if not options.get("spool"):
            raise ValueError("providers needs the option spool: a folder that outlives the driver")
        self.spool = options["spool"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"scrape": 0}

    def _path(self, n: int) -> tuple[FileSystem, str]:
        fs, folder = _spool(self.spool)
        return fs, f"{folder}/{n:012d}.json"

    def _load(self, n: int) -> dict | None:
        fs, path = self._path(n)
        if fs.get_file_info(path).type == FileType.NotFound:
            return None
        with fs.open_input_stream(path, compression=None) as f:
            return json.loads(f.read())

    def _keep(self, n: int, scrape: dict) -> None:
        fs, path = self._path(n)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{path}.part", compression=None) as f:
            f.write(json.dumps(scrape).encode())
        fs.move(f"{path}.part", path)

    def _scrape(self) -> dict:
        """Texts of the providers that gave a sample at least, by name; a folder that isn't there has none."""
        found = {}
        if self.folder:
            fs, folder = _spool(self.folder)
            for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
                if f.base_name.endswith(".sock") and len(f.base_name) > 5 and f.base_name != f"{self.own}.sock":
                    found[f.base_name[:-5]] = scrape_socket(f.path, self.deadline)
        for name, url in self.urls:
            found[name] = scrape_url(url, self.deadline)
        texts = {k: found[k] for k in sorted(found) if found[k] and next(samples_of(found[k]), None)}
        return {"at": datetime.now(timezone.utc).isoformat(), "texts": texts}

    @staticmethod
    def _rows(n: int, scrape: dict) -> Iterator[tuple]:
        at = datetime.fromisoformat(scrape["at"])
        for provider, text in scrape["texts"].items():
            for line, name, labels, value, kind in samples_of(text):
                yield provider, n, at, line, name, labels, value, kind

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next scrape: the one kept under that number, if a query failed before it counted, else a new one. Without providers there is nothing new."""
        n = start["scrape"]
        scrape = self._load(n)
        if scrape is None:
            scrape = self._scrape()
            if not scrape["texts"]:
                return iter(()), start
            self._keep(n, scrape)
        return iter(list(self._rows(n, scrape))), {"scrape": n + 1}  # Spark copies the iterator, so it is one of a list

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for n in range(start["scrape"], end["scrape"]):
            if (scrape := self._load(n)) is None:
                raise ValueError(f"scrape {n} is not in {self.spool} any more")
            yield from self._rows(n, scrape)

    def commit(self, end: dict) -> None:
        """Scrapes before end have been processed; they go."""
        fs, folder = _spool(self.spool)
        for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
            if re.fullmatch(r"\d+\.json", f.base_name) and int(f.base_name[:-5]) < end["scrape"]:
                fs.delete_file(f.path)


class Providers(DataSource):
    """spark.readStream.format("providers") with options path (folder of *.sock) or urls (name=address, by commas), spool, deadlineMs and own (the name that is not asked)."""

    @classmethod
    def name(cls) -> str:
        return "providers"

    def schema(self) -> str:
        return SAMPLES

    def simpleStreamReader(self, schema) -> ProviderReader:
        return ProviderReader(self.options)


def read_providers(spark: SparkSession, folder: str | None = None, urls: dict[str, str] | None = None, spool: str | None = None, deadline_ms: int = DEADLINE, own: str = "weir") -> DataFrame:
    """A stream of the providers' samples, a scrape a trigger. spool must be the same after a restart; by default it is `providers` in the session's shared folder."""
    spark.dataSource.register(Providers)
    source = spark.readStream.format("providers").option("spool", spool or f"{shared_dir(spark)}/providers").option("deadlineMs", deadline_ms).option("own", own)
    source = source.option("path", folder) if folder else source
    return (source.option("urls", ",".join(f"{k}={v}" for k, v in urls.items())) if urls else source).load()


class LatestSnapshot:
    """The latest sample of each series (provider, name, labels) of a stream, for foreachBatch.

    Each batch makes a version of the table, from the version before and the batch's own rows: it takes time in
    proportion to the series, not to what was ever sent. A version counts when Spark has finished it; a batch that is
    run again makes the same version again. Series that were not in a scrape for stale seconds, by the scrapes' clock, go.
    """

    def __init__(self, path: str, stale: float = 300.0, keep: int = 2):
        self.path, self.stale, self.keep = path.rstrip("/"), stale, keep

    def _versions(self, spark: SparkSession) -> tuple[object, list[int]]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return fs, sorted(int(n[2:]) for n in found if re.fullmatch(r"v-\d+", n))

    def _at(self, version: int) -> str:
        return f"{self.path}/v-{version:012d}"

    def _done(self, spark: SparkSession) -> tuple[object, list[int]]:
        fs, versions = self._versions(spark)
        return fs, [v for v in versions if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self._at(v)}/_SUCCESS"))]

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last whole version; without one, an empty table."""
        _, done = self._done(spark)
        return spark.read.schema(f"{SAMPLES}, series string").parquet(self._at(done[-1])) if done else spark.createDataFrame([], f"{SAMPLES}, series string")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, done = self._done(spark)
        older = [v for v in done if v < batch_id]
        rows = batch.withColumn("series", F.to_json(F.array_sort(F.map_entries("labels"))))
        if older:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(self._at(older[-1])))
        last = rows.groupBy("provider", "name", "series").agg(F.max_by(F.struct(*(c for c in rows.columns)), F.struct("scrape", "line_no")).alias("r")).select("r.*")
        newest = rows.agg(F.max("scraped").alias("newest"))
        fresh = last.crossJoin(F.broadcast(newest)).where(F.unix_micros("newest") - F.unix_micros("scraped") <= int(self.stale * 1e6)).drop("newest")
        fresh.write.mode("overwrite").parquet(self._at(batch_id))
        for v in older[: -(self.keep - 1) or None]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(self._at(v)), True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Start a query that keeps the table up to date."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def render(samples: DataFrame) -> DataFrame:
    """Lines of the exposition format (name, at, line), in order of name and at: a TYPE line before each family that has a type, then its samples."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    inner = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_concat("labels", F.create_map(F.lit("provider"), "provider")))), lambda e: F.concat(e["key"], F.lit('="'), text(e["value"]), F.lit('"'))), ",")
    value = F.when(F.col("value") == float("inf"), "+Inf").when(F.col("value") == -float("inf"), "-Inf").otherwise(F.col("value").cast("string"))
    lines = samples.select("name", F.concat("name", F.lit("{"), inner, F.lit("} "), value).alias("line"))
    family = F.when(F.col("type") == "histogram", F.regexp_replace("name", "_(bucket|sum|count)$", "")).otherwise(F.col("name"))
    types = samples.where("type is not null").groupBy(family.alias("family")).agg(F.min("type").alias("type"), F.min("name").alias("name"))
    types = types.select("name", F.concat(F.lit("# TYPE "), "family", F.lit(" "), "type").alias("line"))
    return types.withColumn("at", F.lit(0)).unionByName(lines.withColumn("at", F.lit(1))).orderBy("name", "at", "line")


class MetricsServer:
    """GET /metrics answers with the table's current lines, sent as Spark gives them; other paths are not found."""

    def __init__(self, spark: SparkSession, snapshot: LatestSnapshot, port: int = 0, host: str = "127.0.0.1"):
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                if self.path != "/metrics":
                    self.send_error(404)
                    return
                lines = render(snapshot.read(spark)).select("line").toLocalIterator()
                self.send_response(200)
                self.send_header("Content-Type", "text/plain; version=0.0.4")
                self.end_headers()
                for row in lines:
                    self.wfile.write(f"{row.line}\n".encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.server.server_port}/metrics"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
