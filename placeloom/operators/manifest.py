"""URL intake, batches, the download manifest and its retries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions.url import domain, normalize_url, part

#: Names under which a URL column is looked for, in this order.
URL_COLUMNS = ("url", "URL", "loc", "matched_url", "canonical_url", "source_url")
ERROR_LENGTH, BODY_BYTES = 4000, 10_000_000
#: Responses that are tried again, and the delays between tries in seconds.
TRANSIENT = (408, 409, 425, 429, 500, 502, 503, 504)
RETRIES, BACKOFF, MOST_BACKOFF, DELAY, JITTER = 3, 10.0, 300.0, 3.0, 1.5


@dataclass(frozen=True)
class Batches:
    """Which hosts have map pages (paths /maps and below), each with a batch for the rest of its pages."""

    hosts: tuple[str, ...] = ("guide.example.com", "www.example.com")
    maps_folder: str = "01_maps"
    other_folder: str = "99_other"

    def classified(self, url: Column) -> Column:
        """struct(key, order, folder) of a URL: maps, else its host's, else other."""
        host, path = domain(url), F.coalesce(F.nullif(part(url, "path"), F.lit("")), F.lit("/"))
        one = lambda key, order, folder: F.struct(F.lit(key).alias("key"), F.lit(order).alias("order"), F.lit(folder).alias("folder"))
        is_map = (F.regexp_replace(path, "/+$", "") == "/maps") | F.startswith(path, F.lit("/maps/"))
        case = F.when(host.isin(*self.hosts) & is_map, one("maps", 1, self.maps_folder))
        for k, h in enumerate(self.hosts, 2):
            name = h.replace(".", "_")
            case = case.when(host == h, one(f"{name}_rest", k, f"{k:02d}_{name}_rest"))
        return case.otherwise(one("other", 99, self.other_folder))


def url_column(columns: list[str], wanted: str | None = None) -> str:
    """The column to read URLs from: the wanted one, else a known name, else the only one."""
    if wanted:
        if wanted not in columns:
            raise ValueError(f"no column {wanted!r} among {columns}")
        return wanted
    known = [c for c in URL_COLUMNS if c in columns]
    if known:
        return known[0]
    if len(columns) == 1:
        return columns[0]
    raise ValueError(f"no URL column among {columns}")


def intake(rows: DataFrame, batches: Batches = Batches(), url_col: str | None = None, limit: int | None = None) -> DataFrame:
    """(url, input_row_number, input_data, batch_key, batch_order, batch_folder) of rows with an ordinal (0: the first).

    Blank URLs go; of URLs that are one when normalised the first row stays. Rows are numbered from 2,
    as below a header. limit counts distinct URLs in input order.
    """
    name = url_column([c for c in rows.columns if c != "ordinal"], url_col)
    data = F.create_map(*(x for c in rows.columns if c != "ordinal" for x in (F.lit(c), F.col(c).cast("string"))))
    url = F.col(name).cast("string")
    own = rows.where(F.trim(F.coalesce(url, F.lit(""))) != "").select(normalize_url(url).alias("url"), (F.col("ordinal") + 2).alias("input_row_number"), data.alias("input_data"))
    first = own.groupBy("url").agg(F.min_by(F.struct("input_row_number", "input_data"), "input_row_number").alias("f")).select("url", "f.*")
    if limit is not None:
        first = first.orderBy("input_row_number").limit(limit)
    return first.withColumn("b", batches.classified(F.col("url"))).select("url", "input_row_number", "input_data", F.col("b.key").alias("batch_key"), F.col("b.order").alias("batch_order"), F.col("b.folder").alias("batch_folder"))


def selected(records: DataFrame, keys: list[str] | None = None, per_batch: int | None = None) -> DataFrame:
    """Records of the chosen batches (None: all but other), the first per_batch of each in input order."""
    rows = records.where(F.col("batch_key") != "other") if keys is None else records.where(F.col("batch_key").isin(keys))
    if per_batch is None:
        return rows
    order = Window.partitionBy("batch_key").orderBy("batch_order", "input_row_number", "url")
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_batch).drop("__n")


def plan(records: DataFrame) -> DataFrame:
    return records.groupBy("batch_order", "batch_key", "batch_folder").agg(F.count("*").alias("urls")).orderBy("batch_order")


def pending(records: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Records that aren't downloaded yet; with force all."""
    if force:
        return records
    return records.join(manifest.where("status = 'downloaded'").select("url").distinct(), "url", "left_anti")


def status_of(http_status: Column, skipped: Column | None = None) -> Column:
    case = F.when(skipped, "skipped_content_type") if skipped is not None else None
    ok = http_status.between(200, 399)
    return (F.when(ok, "downloaded") if case is None else case.when(ok, "downloaded")).otherwise("http_error")


HTML_TYPES = ("text/html", "application/xhtml+xml")
TEXT_TYPES = (*HTML_TYPES, "text/plain", "application/json", "application/ld+json", "application/xml", "text/xml")


def skipped_by_type(content_type: Column, html_only: bool = False, text_only: bool = False) -> Column:
    """Whether a content type isn't among those wanted; html_only is the narrower."""
    ct = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return ~ct.isin(*HTML_TYPES) if html_only else ~ct.isin(*TEXT_TYPES) if text_only else F.lit(False)


def within_size(rows: DataFrame, column: str = "content", most: int = BODY_BYTES) -> DataFrame:
    return rows.where(F.octet_length(column) <= most)


def backoff(attempt: Column, asked: Column | None = None, base: float = BACKOFF, most: float = MOST_BACKOFF) -> Column:
    """Seconds before the next try after attempt 1, 2, ...: doubling up to a limit, or what the server asked for, without one."""
    own = F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
    return own if asked is None else F.coalesce(asked.cast("double"), own)


def outcome(attempts: DataFrame, retries: int = RETRIES) -> DataFrame:
    """(url, attempts, status, http_status, error) of attempts (url, attempt, http_status, error): what the manifest keeps.

    The first response that isn't transient decides. Without one the row is failed after all tries, without a
    status, and its error is the last failure to connect, if any: a transient response leaves none.
    """
    rows = attempts.where(F.col("attempt") <= retries + 1)
    final = F.col("http_status").isNotNull() & ~F.col("http_status").isin(*TRANSIENT)
    one = F.struct("attempt", "http_status")
    r = rows.groupBy("url").agg(F.min(F.when(final, one)).alias("d"), F.max_by("error", F.when(F.col("http_status").isNull(), F.col("attempt"))).alias("e"))
    done = F.col("d").isNotNull()
    status = F.when(done, status_of(F.col("d.http_status"))).otherwise("failed")
    error = F.when(status == "downloaded", F.lit("")).when(done, F.concat(F.lit("HTTP "), F.col("d.http_status").cast("string"))).otherwise(F.coalesce("e", F.lit("")))
    return r.select("url", F.coalesce("d.attempt", F.lit(retries + 1)).alias("attempts"), status.alias("status"), F.col("d.http_status").alias("http_status"), error.alias("error"))


def politeness(base: Column, robots: Column, jitter: Column) -> Column:
    """Seconds between requests to one host."""
    return F.greatest(base, F.coalesce(robots, F.lit(0.0))) + jitter


def upserted(manifest: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """The manifest after changes: for each url all columns of its last version; errors are cut to a length.

    A null version is older than any other. Of equal versions a change wins over the manifest, and of changes the
    last by their columns as JSON. Null urls are one url. Empty tables change nothing. Whether versions of a url are equal is
    looked up at once, by keys alone; as long as none are, no row is made JSON, and columns that nobody reads aren't carried.
    """
    tagged = "__change"
    rows = manifest.withColumn(tagged, F.lit(0)).unionByName(changes.withColumn(tagged, F.lit(1)), allowMissingColumns=True)
    if "error" in rows.columns:
        rows = rows.withColumn("error", F.substring("error", 1, ERROR_LENGTH))
    columns = [c for c in rows.columns if c != tagged]
    if rows.groupBy("url", version, tagged).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        order = F.struct(version, tagged)
        return rows.groupBy("url").agg(*(F.max_by(c, order).alias(c) for c in columns if c != "url")).select(*columns)
    one = F.struct(*(F.col(c) for c in columns))
    return rows.groupBy("url").agg(F.max_by(one, F.struct(version, tagged, F.to_json(one).alias("j"))).alias("r")).select("r.*")


def summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("batch_order", "batch_key", "status").agg(F.count("*").alias("urls")).orderBy("batch_order", F.desc("urls"), "status")


def retained(versions: DataFrame, keep: int = 2, by: str = "recorded_at") -> DataFrame:
    """The newest ``keep`` versions."""
    return versions.orderBy(F.desc(by), F.desc("version")).limit(keep)


def missing(required: DataFrame, present: DataFrame, key: str = "url") -> DataFrame:
    """What is required and not there."""
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def progress(required: DataFrame, present: DataFrame, key: str = "url", size: str = "bytes") -> DataFrame:
    """(files, files_there, bytes, bytes_there, percent) of required (key, size); 100 percent of nothing is 100."""
    there = present.select(F.col(key)).distinct().withColumn("__there", F.lit(True))
    rows = required.join(there, key, "left")
    done = F.coalesce("__there", F.lit(False))
    total = F.coalesce(F.sum(size), F.lit(0))
    part = F.coalesce(F.sum(F.when(done, F.col(size))), F.lit(0))
    return rows.agg(F.count("*").alias("files"), F.count_if(done).alias("files_there"), total.alias("bytes"), part.alias("bytes_there"), F.when(total == 0, F.lit(100)).otherwise(F.floor(100 * part / total)).cast("int").alias("percent"))
