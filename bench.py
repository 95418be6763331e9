"""Headline queries at one scale: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "fuzzy_ignore_location", "fuzzy_default", "fuzzy_whole_documents", "multi_key_weighted", "array_key", "ext_prefix", "ext_and",
    "ext_fuzzy_term", "ext_inverse_all_keys", "obj_or", "logical_or", "logical_nested", "token_df", "token_any", "token_all_cross_field",
    "topk_tie_break", "matches_ranges", "index_fields", "index_roundtrip", "remove_where",
)

#: The published parallel workload: 100,000 people, four keys, threshold 0.4, five queries and the index.
PEOPLE = 100_000
PEOPLE_QUERIES = ("john", "jhon smith", "developer", "enginer", "new york")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__))  # for Python tasks
    return spark


def people(spark: SparkSession):
    """Names, jobs and cities drawn from short lists by the row's number."""

    def pick(values: list[str], salt: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    first = ["John", "Mary", "Alan", "Grace", "Linus", "Ada", "Edsger", "Barbara", "Ken", "Margaret"]
    last = ["Smith", "Jones", "Turing", "Hopper", "Lovelace", "Dijkstra", "Liskov", "Thompson", "Hamilton", "Ritchie"]
    job = ["software developer", "data engineer", "designer", "product manager", "site reliability engineer"]
    city = ["New York", "London", "Berlin", "Tokyo", "San Francisco", "Paris"]
    number = F.col("id").cast("string")
    return spark.range(PEOPLE).select(
        F.col("id").alias("ref_index"), F.concat_ws(" ", pick(first, 1), pick(last, 2)).alias("name"), F.concat_ws(" ", pick(job, 3), number).alias("job"),
        pick(city, 4).alias("city"), F.concat(F.lower(pick(first, 5)), number, F.lit("@example.com")).alias("email"),
    )


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 4)


def main() -> None:
    from quillseek import Collection
    from quillseek.plans import catalogue

    spark = session()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda q=catalogue.QUERIES[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        run()
        seconds[name] = min(timed(run) for _ in range(2))

    rows = people(spark)
    keys = ["name", "job", "city", "email"]

    def build():
        collection = Collection.of(rows, keys=keys, threshold=0.4, include_score=True)
        return Collection.of(rows, collection.options, collection.get_index().persist())

    def five(collection):
        for query in PEOPLE_QUERIES:
            collection.search(query, 100).collect()

    collection = build()
    seconds["people_index_build"] = timed(lambda: collection.index.frame.count())
    five(collection)
    seconds["people_five_queries"] = min(timed(lambda: five(collection)) for _ in range(2))
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
