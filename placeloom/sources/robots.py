"""robots.txt: which URLs may be fetched, and how far apart."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions.url import domain

RULES = pa.struct([("allowed", pa.bool_()), ("delay", pa.float64())])


def with_rules(urls: DataFrame, robots: DataFrame, agent: str, allow_unknown: bool = False) -> DataFrame:
    """urls (url, ...) with allowed and delay by robots (host, body): null bodies and unknown hosts can't be asked.

    Those are denied unless allow_unknown. A host's rules go with each of its URLs, read once in a batch.
    """

    def run(found: pa.Array, bodies: pa.Array) -> pa.Array:
        known: dict[str, RobotFileParser] = {}
        out = []
        for url, body in zip(found.to_pylist(), bodies.to_pylist(), strict=True):
            if body is None:
                out.append({"allowed": allow_unknown, "delay": None})
                continue
            if body not in known:
                known[body] = RobotFileParser()
                known[body].parse(body.splitlines())
            delay = known[body].crawl_delay(agent)
            out.append({"allowed": known[body].can_fetch(agent, url), "delay": None if delay is None else float(delay)})
        return pa.array(out, RULES)

    rules = robots.select(F.lower("host").alias("__host"), F.col("body").alias("__body")).dropDuplicates(["__host"])
    rows = urls.withColumn("__host", domain(F.col("url"))).join(rules, "__host", "left")
    rows = rows.withColumn("__rules", F.arrow_udf(run, "allowed boolean, delay double")(F.col("url"), F.col("__body")))
    return rows.select(*urls.columns, F.col("__rules.allowed").alias("allowed"), F.col("__rules.delay").alias("delay"))
