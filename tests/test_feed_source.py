"""The feed source: pages by cursor, restarts, unchanged feeds."""

import os

from tidewire.sources import feed_source, feeds
from tidewire.operators import tables
from tidewire.streaming import ingest

FEED = '<rss version="2.0"><channel>{}</channel></rss>'
ITEM = "<item><title>{t}</title><link>https://x.org/{t}</link><description>body of {t}</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"


def put(folder, name, *titles, at):
    (folder / name).write_text(FEED.format("".join(ITEM.format(t=t) for t in titles)))
    os.utime(folder / name, (at, at))


def test_feeds_by_cursor(spark, tmp_path):
    spark.dataSource.register(feed_source.FeedSource)
    src = tmp_path / "in"
    src.mkdir()
    uri, pages = f"file://{src}", []

    def run():
        got = []
        stream = spark.readStream.format("feeds").load(uri)
        q = stream.writeStream.foreachBatch(lambda df, _: got.append(sorted((os.path.basename(r.feed), r.body is None) for r in df.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        pages.append([row for page in got for row in page])

    put(src, "a.xml", "one", "two", at=1000)
    put(src, "b.xml", "three", at=1000)
    run()
    run()  # nothing changed: nothing is opened
    put(src, "b.xml", "three", "four", at=2000)
    (src / "c.xml").write_text("x" * (feeds.MOST_BYTES + 1))
    (src / ".hidden").write_text("x")
    run()
    assert pages == [[("a.xml", False), ("b.xml", False)], [], [("b.xml", False), ("c.xml", True)]]
    whole = spark.read.format("feeds").load(uri)
    assert whole.count() == 3 and spark.read.format("feeds").load(f"file://{tmp_path}/none").count() == 0
    items = feeds.read("rss", whole, "2024-02-01 00:00:00").collect()
    assert sorted(r.title for r in items if not r.skip_reason) == ["four", "one", "three", "two"] and sum(r.skip_reason == "document too large" for r in items) == 1


def test_feed_stream_to_stored_items(spark, tmp_path):
    """Recorded feeds through the source into the store: an item that comes again is stored once."""
    spark.dataSource.register(feed_source.FeedSource)
    src = tmp_path / "in"
    src.mkdir()
    snap = tables.Snapshots(spark, f"file://{tmp_path}/articles")

    def run():
        items = feeds.normalise(feeds.entries(spark.readStream.format("feeds").load(f"file://{src}")), "2024-02-01 00:00:00")
        q = items.writeStream.foreachBatch(ingest.store_batch(snap)).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    put(src, "a.xml", "one", "two", at=1000)
    run()
    put(src, "a.xml", "two", "three", at=2000)
    run()
    assert sorted(r.title for r in snap.read().collect()) == ["one", "three", "two"]
