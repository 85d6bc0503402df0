"""Contracts of data sources, the paged source over a real connection, delimited texts."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, WriterCommitMessage

from weftline.sources import conformance, files
from weftline.sources.http_json import HttpJson


class _Pages(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        asked = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
        body = json.dumps({"items": [{"i": i, "ü": "ß"} for i in range(25)][(asked["page"] - 1) * asked["size"] :][: asked["size"]]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    running = ThreadingHTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}/list"
    running.shutdown()


def local_json():
    """The class is made here, so that workers get it whole and need not import this file."""

    class LocalJson(HttpJson):
        """The paged source over plain HTTP, which the library itself refuses."""

        @classmethod
        def name(cls):
            return "local_http_json"

        def reader(self, schema):
            from urllib.request import urlopen

            from weftline.sources import http_json

            class Reader(http_json._Reader):
                def read(self, partition):
                    found = http_json.pages(lambda u: urlopen(u, timeout=5).read().decode(), partition.value, self.options["records"], size=10)
                    for n, record in enumerate(found, 1):
                        yield n, json.dumps(record, ensure_ascii=False)

            return Reader(dict(self.options))

    return LocalJson


def outcomes(df):
    return {r["code"]: r["status"] for r in df.collect()}


def test_pages_over_a_connection(spark, server):
    found = conformance.require(spark, local_json(), "source", {"url": f"{server} {server}", "records": "/items"})
    assert set(outcomes(found).values()) == {"passed"} and "source.repeatable" in outcomes(found)
    rows = spark.read.format("local_http_json").option("url", f"{server} {server}").option("records", "/items").load()
    assert rows.groupBy("record").count().filter("count = 2").count() == 25
    assert rows.agg(F.max("record_number")).first()[0] == 25
    # The library's own source takes https only.
    assert outcomes(conformance.checks(spark, HttpJson, "source", {"url": server, "records": "/items"}))["source.schema_holds"] == "failed"


def test_what_breaks_a_contract(spark):
    class Nothing(DataSource):
        pass

    class Unsteady(DataSource):
        @classmethod
        def name(cls):
            return "unsteady"

        def schema(self):
            return "x double"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield (random.random(),)

            return Reader()

    class Half(Unsteady):
        def writer(self, schema, overwrite):
            class Writer(DataSourceWriter):
                def write(self, rows):
                    return WriterCommitMessage()

                def commit(self, messages):
                    pass

            return Writer(self.options)

    assert outcomes(conformance.checks(spark, Nothing, "source")) == {"capabilities.immutable_contract": "passed", "capabilities.name": "passed", "schema.inspect_method": "failed", "source.records": "failed"}
    assert outcomes(conformance.checks(spark, Unsteady, "source", {}))["source.repeatable"] == "failed"
    assert outcomes(conformance.checks(spark, Half, "destination", {}))["destination.atomic_batch_method"] == "failed"
    assert outcomes(conformance.checks(spark, Half, "destination"))["destination.atomic_batch_method"] == "advisory"
    assert outcomes(conformance.checks(spark, str, "source")) == {"capabilities.immutable_contract": "failed"}
    with pytest.raises(conformance.NotConformant, match="source.records"):
        conformance.require(spark, Nothing, "source")
    with pytest.raises(ValueError):
        conformance.checks(spark, Nothing, "both")


def test_delimited_texts(spark):
    texts = [None, "", "a,b", "a,b\nc,d", "a,b\nc", "a;b\r\nc;d \n \t\ne;f;g\nh;i\nj;k", "a|b\nc|d|e\nf|g\nh|i|j", "x\ny\nz", "\n".join(["a,b"] * 4 + ["none"]), "\n".join(["a,b"] * 40 + ["none"] * 60), "\n".join(["none"] * 40 + ["a,b"] * 60)]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab,;|\t\n\r\x85 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", files.delimited(F.col("text")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in rows] == [files.looks_delimited(t) if t else False for t in texts]
    assert [r["d"] for r in rows[:11]] == [False, False, False, True, False, True, False, False, True, True, False]
