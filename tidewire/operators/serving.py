"""Read side: visible rows, pages, latest rows, slots, child collections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def visible(articles: DataFrame, status: str = "status", deleted: str | None = None) -> DataFrame:
    out = articles.where(F.col(status) == "published")
    return out.where(F.col(deleted).isNull()) if deleted else out


def optional(df: DataFrame, column: str, value) -> DataFrame:
    """No predicate for a falsy value."""
    return df.where(F.col(column) == value) if value else df


def allowed(df: DataFrame, column: str, value: str | None, values: tuple[str, ...]) -> DataFrame:
    """A value beyond the allowed ones is no predicate."""
    return df.where(F.col(column) == value) if value in values else df


@dataclass
class PageRequest:
    """Page and size in range; errors() names all that are not, in order."""

    page: int = 1
    size: int = 20
    most_pages: int = 500
    most_size: int = 50
    problems: list[str] = field(default_factory=list)

    def errors(self) -> list[str]:
        out = []
        if not 1 <= self.page <= self.most_pages:
            out.append(f"page must be from 1 to {self.most_pages}")
        if not 1 <= self.size <= self.most_size:
            out.append(f"size must be from 1 to {self.most_size}")
        return out

    def clamped(self, most_size: int = 100) -> PageRequest:
        return PageRequest(max(1, self.page), min(max(1, self.size), most_size))


def page(df: DataFrame, order: list[Column], request: PageRequest) -> DataFrame:
    """One page of rows; `order` must end in a unique key."""
    return df.orderBy(*order).offset((request.page - 1) * request.size).limit(request.size)


def page_state(df: DataFrame, order: list[Column], request: PageRequest) -> DataFrame:
    """items, has_more and the estimated total of a page, from one row more than it shows."""
    start = (request.page - 1) * request.size
    some = df.orderBy(*order).offset(start).limit(request.size + 1)
    n = F.count("*")
    items = F.least(n, F.lit(request.size))
    more = n > request.size
    return some.agg(items.cast("bigint").alias("items"), more.alias("has_more"), (F.lit(start) + items + more.cast("int")).cast("bigint").alias("total_estimate"))


def latest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n first rows of each key; the rank filter reaches the window as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def homepage_slots(df: DataFrame, order: list[Column], shown: int = 30) -> DataFrame:
    """Of the `shown` latest rows: one lead, four secondary, six latest, the rest."""
    few = df.orderBy(*order).limit(shown)
    at = F.row_number().over(Window.orderBy(*order))
    slot = F.when(F.col("position") == 1, "lead").when(F.col("position") <= 5, "secondary").when(F.col("position") <= 11, "latest").otherwise("rest")
    return few.withColumn("position", at).withColumn("slot", slot)


def children(parents: DataFrame, kids: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """Each parent with its children's values in order; parents without children keep an empty list."""
    lists = kids.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]).alias(out))
    return parents.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def renderable_price(source: Column, age_hours: Column, most_hours: int) -> Column:
    return source.isin("api", "admin_override") & (age_hours <= most_hours)


def renderable_rating(rating: Column, source: Column) -> Column:
    """Ratings come from a merchant's API or aren't shown."""
    return rating.isNotNull() & F.coalesce(source == "api", F.lit(False))


def link_safe(active: Column, health: Column) -> Column:
    """Never a link that is known to be dead."""
    return active & ~F.coalesce(health.isin("broken", "expired"), F.lit(False))


def without_commerce(df: DataFrame, column: str, kinds: DataFrame) -> DataFrame:
    """Rows whose kind is none of those that forbid commerce, kinds(name); a row without a kind goes, as nothing allows it."""
    return df.where(F.col(column).isNotNull()).join(kinds.select(F.col("name").alias(column)).distinct(), column, "left_anti").select(*df.columns)


def forbidding(kinds: DataFrame) -> DataFrame:
    """(name) of kinds(name, forbids_commercial) that forbid it, however many."""
    return kinds.where("forbids_commercial").select("name")


def kinds_from_json(spark: SparkSession, path: str) -> DataFrame:
    """kinds(name, forbids_commercial) from a JSON document of a list of objects; an object that doesn't say so doesn't forbid."""
    rows = spark.read.schema("name string, forbids_commercial boolean").option("multiLine", True).json(path)
    return rows.where("name IS NOT NULL").withColumn("forbids_commercial", F.coalesce("forbids_commercial", F.lit(False)))


def bundle(articles: DataFrame, refs: DataFrame, corrections: DataFrame, tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """articles(id) with references in their order, public corrections by time, and tags by slug; empty lists without any."""
    sorted_list = lambda rows, key, *cols: rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(key))
    lists = {
        "refs": sorted_list(refs, "refs", "display_order", "ref_id", "url"),
        "corrections": sorted_list(corrections.where("is_public"), "corrections", "issued_at", "summary"),
        "tags": sorted_list(article_tags.join(tags, "tag_id"), "tags", "slug", "name"),
    }
    out = articles
    for name, rows in lists.items():
        none = F.array().cast(rows.schema[name].dataType)
        out = out.join(rows, "id", "left").withColumn(name, F.coalesce(name, none))
    return out
