"""State that outlives a job: keyed Parquet tables, and what the engine keeps in them (pages, plans, seen URLs)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagequery.errors import StateError


class StateTable:
    """A table of one row per key in a folder that the cluster shares.

    Each change writes a new version beside the old one and then moves a
    pointer, so readers see one or the other and a job that dies leaves the old
    state. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = StructType.fromDDL(schema)
        if missing := sorted(set(keys) - set(self.schema.names)):
            raise StateError("keys are not in the schema", keys=missing)

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        path, store = self._at("CURRENT")
        return self.spark.read.text(f"{self.folder}/CURRENT").first()[0] if store.exists(path) else None

    def read(self) -> DataFrame:
        name = self._version()
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], self.schema)
        except AnalysisException as e:
            raise StateError("the current version can't be read", folder=self.folder, version=name) from e

    def write(self, rows: DataFrame) -> None:
        """Replaces all rows."""
        old, new = self._version(), f"v-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.folder}/{new}")
        marked, store = self._at(f"{new}.pointer")
        out = store.create(marked, True)
        out.write(bytearray(new.encode()))
        out.close()
        current, _ = self._at("CURRENT")
        if store.exists(current):
            store.delete(current, False)
        if not store.rename(marked, current):
            raise StateError("the pointer could not be moved", folder=self.folder)
        if old:
            store.delete(self._at(old)[0], True)

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> None:
        """Adds rows, in place of those of the same keys. Of several new rows of a key the last by ``order`` (default: all columns) counts."""
        from pyspark.sql import Window

        w = Window.partitionBy(*self.keys).orderBy(*(order or [F.desc(c) for c in self.schema.names]))
        new = rows.select(*self.schema.names).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        self.write(self.read().join(new.select(*self.keys), self.keys, "left_anti").unionByName(new))

    def delete(self, where: Column) -> None:
        self.write(self.read().where(~F.coalesce(where, F.lit(False))))

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], self.schema))

    def stats(self) -> dict[str, int]:
        return {"entries": self.read().count()}


class SeenUrls(StateTable):
    """URLs that some crawl has met."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "url string", ["url"])

    def add(self, urls: DataFrame) -> DataFrame:
        """The URLs (trimmed, not blank, each once) that were not there; they are there from now on."""
        from pagequery.operators.crawl import unseen, written

        new = written(unseen(urls, self.read()))
        self.upsert(new)
        return new


class PageCache(StateTable):
    """Pages by URL and hash of their markup; the last of a URL is its current one."""

    def __init__(self, spark: SparkSession, folder: str, max_bytes: int = 10_000_000):
        super().__init__(spark, folder, "url string, hash string, html string, status int, headers map<string,string>, tier int, fetched_at timestamp", ["url", "hash"])
        self.max_bytes = max_bytes

    def put(self, pages: DataFrame) -> None:
        """Adds fetched pages (see ``fetching.fetch``); failures and pages over ``max_bytes`` stay out."""
        ok = pages.where(F.col("html").isNotNull() & (F.octet_length("html") <= self.max_bytes))
        ok = ok.where(F.col("error").isNull()) if "error" in pages.columns else ok
        self.upsert(ok.withColumn("hash", F.sha2("html", 256)), [F.desc("fetched_at")])

    def current(self, ttl_seconds: int | None = None, now: Column | None = None) -> DataFrame:
        """The last page of each URL that is not expired."""
        from pagequery.operators.fetching import latest_cached

        return latest_cached(self.read(), now, ttl_seconds)


class PlanCache(StateTable):
    """Extraction plans by domain and template."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, "domain string, template string, plan map<string,array<string>>", ["domain", "template"])

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> None:
        super().upsert(rows, order or [F.desc(F.to_json("plan"))])

    def invalidate(self, keys: DataFrame) -> None:
        from pagequery.plans.extract import invalidate

        self.write(invalidate(self.read(), keys))

    def clear(self, domain: str | None = None) -> None:
        """All plans, or those of a domain, go."""
        super().clear() if domain is None else self.delete(F.col("domain") == domain.lower())


class CacheManager:
    """The engine's state below one folder: pages, plans, seen URLs."""

    def __init__(self, spark: SparkSession, folder: str, max_bytes: int = 10_000_000):
        if not folder:
            raise StateError("state needs a folder that the cluster shares")
        base = folder.rstrip("/")
        self.pages, self.plans, self.seen = PageCache(spark, f"{base}/pages", max_bytes), PlanCache(spark, f"{base}/plans"), SeenUrls(spark, f"{base}/seen")

    def stats(self) -> dict[str, int]:
        return {name: getattr(self, name).stats()["entries"] for name in ("pages", "plans", "seen")}

    def clear(self) -> None:
        for table in (self.pages, self.plans, self.seen):
            table.clear()
