"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from tidewire.operators import tables
from tidewire.sources import feeds
from tidewire.streaming import ingest

FEED = '<rss version="2.0"><channel>{}</channel></rss>'
ITEM = "<item><title>{t}</title><link>https://x.org/{u}</link><description>{b}</description><pubDate>Mon, 01 Jan 2024 1{h}:00:00 GMT</pubDate></item>"


def drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def test_tumbling_stream_equals_batch(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(ingest.tumbling(stream, size="1 day"), "tumble", "complete")
    want = ingest.tumbling(batch, size="1 day")
    assert got.select("window_start", "event_type", "n").exceptAll(want.select("window_start", "event_type", "n")).isEmpty() and got.count() == want.count()


def test_feed_stream_is_stored_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.xml").write_text(FEED.format(ITEM.format(t="Alpha beta", u="1?utm_x=1", b="Body one is here", h=1) + ITEM.format(t="Gamma", u="2", b="Body two is there", h=2)))
    snap, seen, totals = (tables.Snapshots(spark, f"file://{tmp_path}/{name}") for name in ("articles", "seen", "totals"))
    batches = []

    def run():
        items = feeds.normalise(feeds.entries(feeds.read_files(spark, f"file://{src}", stream=True, per_trigger=1)), "2024-02-01 00:00:00")
        store = ingest.store_batch(snap, seen, totals)

        def twice(batch, batch_id):
            batches.append(batch_id)
            store(batch, batch_id)
            store(batch, batch_id)  # as after a failure

        ingest.start(items, "poll", twice, f"file://{tmp_path}/cp", once=True).awaitTermination()

    run()
    assert snap.read().count() == 2
    (src / "b.xml").write_text(FEED.format(ITEM.format(t="Alpha beta", u="1", b="Body one is here", h=3) + ITEM.format(t="Delta", u="3", b="Body one is here", h=4)))
    run()
    rows = {r.canonical_url: r for r in snap.read().collect()}
    assert sorted(rows) == ["https://x.org/1", "https://x.org/2", "https://x.org/3"]
    assert rows["https://x.org/3"].dedup_status == "exact_duplicate" and rows["https://x.org/3"].duplicate_of == rows["https://x.org/1"].id
    assert sorted(r.id for r in rows.values()) == [1, 2, 3]
    assert seen.read().count() == 4 and sorted((r.fetched, r.stored, r.duplicates, r.skipped) for r in totals.read().collect()) == [(2, 1, 1, 0), (2, 2, 0, 0)]
    (src / "c.xml").write_text("<broken")
    (src / "d.xml").write_text(FEED.format(ITEM.format(t="Eps", u="9", b="Another body", h=5)))
    run()
    assert snap.read().count() == 4 and totals.read().where("skipped = 1").count() == 1 and len(batches) == 4  # a file a trigger


def test_circuit_state(spark, tmp_path):
    schema = "provider string, at int, ok boolean"
    spark.createDataFrame([("a", i, False) for i in range(5)] + [("b", 1, True)], schema).coalesce(1).write.parquet(f"{tmp_path}/p")
    got = drain(ingest.circuits(spark.readStream.schema(schema).parquet(f"{tmp_path}/p")), "circuits", "update")
    assert sorted((r.provider, r.consecutive_failures, r.circuit_state) for r in got.collect()) == [("a", 5, "open"), ("b", 0, "closed")]


def test_open_stories(spark, tmp_path):
    schema = "story_id bigint, at timestamp"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 01:00:00")], "story_id bigint, at string").select("story_id", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/p")
    got = drain(ingest.open_stories(spark.readStream.schema(schema).parquet(f"{tmp_path}/p")), "stories", "update")
    assert sorted((r.story_id, r.articles, r.open) for r in got.collect()) == [(1, 2, True), (2, 1, True)]


def test_story_closes_and_timers_run_out(spark, tmp_path):
    """A later file moves the watermark past a story's 48 hours and a lease's 900 seconds."""
    rows = lambda *r: spark.createDataFrame(list(r), "k bigint, at string").select(F.col("k").alias("story_id"), F.col("k").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at")).coalesce(1)
    for n, part in enumerate((rows((1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00")), rows((2, "2024-01-06 00:00:00")), rows((2, "2024-01-06 00:01:00")))):
        part.write.parquet(f"{tmp_path}/p/{n}")
    schema = "story_id bigint, key string, at timestamp"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/p")
    closed = [(r.story_id, r.articles) for r in drain(ingest.open_stories(read().select("story_id", "at")), "closing", "update").where("NOT open").collect()]
    assert closed == [(1, 2)]
    gone = drain(ingest.expiries(read().select("key", "at"), 900), "leases").collect()
    assert [(r.key, str(r["last"])) for r in gone if r.key == "1"] == [("1", "2024-01-01 00:05:00")]


def test_late_rows_are_known_by_their_key(spark, tmp_path):
    for n, at in enumerate(("2024-01-01 10:00:00", "2024-01-01 08:00:00", "2024-01-01 11:00:00")):
        spark.createDataFrame([("u", at), (f"v{n}", at)], "url_hash string, at string").select("url_hash", F.col("at").cast("timestamp").alias("published_at")).coalesce(1).write.parquet(f"{tmp_path}/p/{n}")
    stream = spark.readStream.schema("url_hash string, published_at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/p")
    assert sorted(r.url_hash for r in drain(ingest.late_tolerant(stream), "late").collect()) == ["u", "v0", "v1", "v2"]
