"""Join-or-create on a stream: open stories as state by part, closed by timers of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators import folding
from tidewire.operators.clustering import CANDIDATES, JOIN

#: A stored story: all that a decision reads. Times are microseconds.
STORY = "founded bigint, n bigint, sums array<double>, entities array<bigint>, names array<string>, domains array<string>, labels array<string>, last bigint"
OUT = "part bigint, article_id bigint, story_id bigint, joined boolean, similarity double, shared_entities int, articles bigint, last_activity timestamp, open boolean"
WINDOW_MS = folding.WINDOW_HOURS * 3_600_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streams' state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).value // 1000)


class JoinOrCreate(StatefulProcessor):
    """The open stories of a part as map state, a story an entry; a timer for each story's end."""

    def __init__(self, join: float, k: int):
        self.join, self.k = join, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stories = handle.getMapState("stories", "story_id bigint", STORY)

    def _known(self) -> folding.Fold:
        fold = folding.Fold(self.join, self.k, forget=False)
        for (story,), (founded, n, sums, entities, names, domains, labels, last) in self.stories.iterator():
            at = pd.Timestamp(founded, unit="us")
            fold.changed.add({"id": story, "founded": at, "n": n, "entities": dict(zip(entities, names, strict=True)), "domains": set(domains), "labels": set(labels), "last": pd.Timestamp(last, unit="us")}, np.array(sums))
        return fold

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["published_at", "article_id"]).rename(columns={"article_id": "id"})
        pdf["domains"] = [[d] for d in pdf["domain"]]
        fold, out, touched = self._known(), [], set()
        for a in pdf.itertuples():
            article, story, joined, similarity, shared = fold.place(a)
            touched.add(story)
            out.append([key[0], article, story, joined, similarity, shared, None, a.published_at, True])
        size = {}
        for i, s in enumerate(fold.changed.stories):
            if s["id"] in touched:
                size[s["id"]] = s["n"]
                value = (_micros(s["founded"]), s["n"], fold.changed.sums[i].tolist(), list(s["entities"]), list(s["entities"].values()), sorted(s["domains"]), sorted(s["labels"]), _micros(s["last"]))
                self.stories.updateValue((int(s["id"]),), value)
                self.handle.registerTimer(_micros(s["last"]) // 1000 + WINDOW_MS + 1)
        for row in out:
            row[6] = size[row[2]]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() - WINDOW_MS
        over = [(story, v[1], v[-1]) for (story,), v in self.stories.iterator() if v[-1] // 1000 < end]
        for story, _, _ in over:
            self.stories.removeKey((story,))
        rows = [(key[0], None, story, None, None, None, n, pd.Timestamp(last, unit="us"), False) for story, n, last in over]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stories(articles: DataFrame, join: float = JOIN, k: int = CANDIDATES, late: str = "6 hours") -> DataFrame:
    """Decisions on a stream of articles, and a last row (open = false) for each story that ends.

    articles(part, article_id, published_at, domain, vector, labels, entities, names), as the rounds
    of folding.fold_in_rounds take them; `part` is the caller's: what lies in two parts never meets (a desk, a
    language, a component found before). A batch's articles are taken by time, each with the decision that
    the rounds make if batches come in order of time. A story ends WINDOW_HOURS of event time after
    its last article. State is one entry a story, in RocksDB, so a restart goes on from the
    checkpoint, and what a batch writes is what it changed. Needs use_rocksdb().
    """
    rows = articles.selectExpr("part", "article_id", "published_at", "domain", "transform(vector, x -> cast(x AS double)) AS vector", "labels", "entities", "names")
    keyed = rows.withWatermark("published_at", late).groupBy("part")
    return keyed.transformWithStateInPandas(JoinOrCreate(join, k), OUT, "Append", "EventTime")
