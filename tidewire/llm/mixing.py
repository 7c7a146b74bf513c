"""Mix sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, let, uniform, work_table

#: Rows that one fold of the reduction tree takes, about (level one) or at most (above).
FAN_IN = 64
#: Documents of one source and size class that are more than one in HOT of all are dealt over SALTS tasks; there are fewer than HOT such classes.
HOT, SALTS = 1024, 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row for each source of sizes(source, size, n): source_size, n_docs, target.

    Sources by code point, null last, take the weights in turn and share all words by
    weight. A target stops at cap times its source's size; the level that then holds for
    the others is the largest of the levels (words left) / (weight left) as sources are
    capped in the order of cap * size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double")
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(rest))
    target = F.least(F.col("most"), F.max("level").over(whole) * F.col("weight"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


#: A decided document; `free` says whether both numbers of copies, base and one more, are open to it.
DECIDED = "struct<at:bigint,doc_id:bigint,size:bigint,base:bigint,copies:bigint,free:boolean>"


def _decided(i: Column, up: Column | int, free: Column) -> Column:
    values = ((-i["size"]).alias("at"), *(i[c].alias(c) for c in ("doc_id", "size", "base")), (i["base"] + up).cast("bigint").alias("copies"), free.alias("free"))
    return F.struct(*values)


def _balanced(decided: Column, over: Column) -> Column:
    """The decided documents, largest first, with copies given or taken back until less than the smallest is over or missing."""

    def step(acc: Column, i: Column) -> Column:
        down = i["free"] & (i["copies"] > i["base"]) & (acc["over"] >= i["size"])
        up = i["free"] & (i["copies"] == i["base"]) & (-acc["over"] >= i["size"])
        change = F.when(down, -1).when(up, 1).otherwise(0)
        new = F.struct(*(i[c].alias(c) for c in ("at", "doc_id", "size", "base")), (i["copies"] + change).cast("bigint").alias("copies"), i["free"].alias("free"))
        return F.struct((acc["over"] + change * i["size"]).cast("double").alias("over"), F.concat(acc["out"], F.array(new)).alias("out"))

    start = F.struct(over.cast("double").alias("over"), F.array().cast(f"array<{DECIDED}>").alias("out"))
    return F.aggregate(F.sort_array(decided), start, lambda acc, i: let(i, lambda u: step(acc, u)), lambda acc: acc["out"])


def _settle(items: Column, seed: int, level: int) -> Column:
    """Fold an array of (at, key, doc_id, size, base, x): each pair leaves one open item at most.

    Of an open item r and the next item t, words move from one to the other (their sum
    stays) until x of one is 0 or 1; which way is drawn so that each x keeps its mean.
    """
    decided = F.array().cast(f"array<{DECIDED}>")
    none = F.lit(None).cast("struct<key:bigint,doc_id:bigint,size:bigint,base:bigint,x:double>")

    def item(i: Column, x: Column) -> Column:
        return F.struct(*(i[c].alias(c) for c in ("key", "doc_id", "size", "base")), x.alias("x"))

    def done(i: Column, up: Column | int, free: bool = True) -> Column:
        return F.array(_decided(i, up, F.lit(free)))

    def state(r: Column, out: Column) -> Column:
        return F.struct(r.alias("r"), out.alias("out"))

    def pair(acc: Column, t: Column) -> Column:
        r = acc["r"]
        a, b = r["size"].cast("double"), t["size"].cast("double")
        up, down = t["x"] * b / a, (F.lit(1.0) - t["x"]) * b / a
        room = F.lit(1.0) - r["x"]
        d1, d2 = F.least(room, up), F.least(r["x"], down)
        rises = uniform(r["key"], t["key"], F.lit(seed), F.lit(level)) < d2 / (d1 + d2)
        one = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        return (
            F.when(rises & (room <= up), state(item(t, one(t["x"] - room * a / b)), F.concat(acc["out"], done(r, 1))))
            .when(rises, state(item(r, one(r["x"] + up)), F.concat(acc["out"], done(t, 0))))
            .when(r["x"] <= down, state(item(t, one(t["x"] + r["x"] * a / b)), F.concat(acc["out"], done(r, 0))))
            .otherwise(state(item(r, one(r["x"] - down)), F.concat(acc["out"], done(t, 1))))
        )

    def step(acc: Column, t: Column) -> Column:
        return (
            F.when((t["x"] <= 0) | (t["size"] <= 0), state(acc["r"], F.concat(acc["out"], done(t, 0, False))))
            .when(t["x"] >= 1, state(acc["r"], F.concat(acc["out"], done(t, 1, False))))
            .when(acc["r"].isNull(), state(item(t, t["x"]), acc["out"]))
            .otherwise(pair(acc, t))
        )

    return F.aggregate(items, state(none, decided), lambda acc, t: let(t, lambda u: step(acc, u)))


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    return [F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")]


def _size_class(size: Column) -> Column:
    return F.floor(F.log2(size + 1)).cast("int")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 11,
) -> DataFrame:
    """Copies of each document, so that each source comes near its target of words.

    A source of target/size = 2.3 gives each of its documents 2 copies and 0.3 of one
    more. Folds of about 64 documents of like size settle these fractions pair by pair
    and hand one open document up; level after level, the open ones of 64 folds meet in
    the next, until one for each source is left. It is settled against one fold of each
    size class that was set aside for it; what then is open is drawn, and the words by
    which that draw departs are given to, or taken back from, documents of those folds.
    So a source misses its target by about its smallest documents. Words move only within
    a source. Draws depend on ids and the seed alone, so reruns agree.

    Returns one row for each input row: doc_id, source, size, source_size, target,
    copies, taken (copies * size). Null text and texts without words have size 0 and no
    copies; very long texts count whole; null is a source of its own, and null ids are
    drawn like others; repeated rows count and are drawn one by one; no rows give no
    rows. Other columns are not read.
    """
    sizes = docs.select(*_sizes(docs, id_col, source_col, text_col)).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    sizes = work_table(sizes.withColumn("kind", _size_class(F.col("size"))), "mix-sizes")
    per = source_targets(sizes, weights, cap)
    kinds = sizes.groupBy("source", "kind").agg(F.sum("n").alias("n"))
    larger = Window.partitionBy("source").orderBy(F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)  # 64 classes a source at most
    kinds = kinds.withColumn("folds", F.ceil(F.col("n") / F.lit(float(FAN_IN))))
    kinds = kinds.select("*", F.coalesce(F.sum("folds").over(larger), F.lit(0)).alias("first"), F.sum("folds").over(Window.partitionBy("source")).alias("all_folds"))
    named = kinds.withColumnRenamed("source", "of")
    rate = F.least(F.lit(float(cap)), F.when(F.col("source_size") > 0, F.try_divide("target", "source_size")).otherwise(0.0))
    targets = named.join(per, named["of"].eqNullSafe(per["source"])).select("of", "kind", "n", "folds", "first", "all_folds", "source_size", "target", rate.alias("rate"))
    targets = work_table(targets, "mix-targets")
    most, total = targets.agg(F.max("all_folds"), F.sum("n")).first()
    # A source may hold a third of the rows: its classes are dealt by salt too.
    hot = targets.where(F.col("n") * HOT > F.lit(total)).select(F.col("of").alias("hot_of"), F.col("kind").alias("hot_kind"), F.lit(SALTS).alias("salts"))

    def salted(rows: DataFrame, source: str) -> DataFrame:
        return rows.join(F.broadcast(hot), rows[source].eqNullSafe(hot["hot_of"]) & (rows["kind"] == hot["hot_kind"]), "left")  # fewer than HOT rows

    wide = salted(targets, "of").drop("hot_of", "hot_kind").withColumn("t_salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).withColumnRenamed("kind", "t_kind").drop("salts", "n")
    own = salted(sizes, "source").withColumn("nth", F.explode(F.expr("sequence(1, n)")))
    key = F.xxhash64("doc_id", "nth", F.lit(seed))
    own = own.select("doc_id", "source", "size", "kind", key.alias("key"), F.pmod(key, F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    same = own["source"].eqNullSafe(wide["of"]) & (own["kind"] == wide["t_kind"]) & (own["salt"] == wide["t_salt"])
    base = F.when(F.col("size") > 0, F.floor("rate")).otherwise(0).cast("bigint")
    rows = own.join(wide, same).withColumn("nth", F.pmod(F.xxhash64("key", F.lit(1)), F.col("folds"))).select(
        "source", "source_size", "target", (F.col("first") + F.col("nth")).alias("fold"), (F.col("nth") == 0).alias("late"),
        F.struct((-F.col("size")).alias("at"), "key", "doc_id", "size", base.alias("base"), (F.col("rate") - F.floor("rate")).alias("x")).alias("item"),
    )
    of, fields = ["source", "source_size", "target"], ("key", "doc_id", "size", "base", "x")
    items = rows.groupBy(*of, "fold", "late").agg(F.sort_array(F.collect_list("item")).alias("items"))
    level, width = 0, most or 0
    settled = items.select(*of, "fold", F.when(F.col("late"), F.col("items")).alias("late"), F.when(~F.col("late"), _settle(F.col("items"), seed, 0)).alias("s"))
    settled = work_table(settled, "mix-level0")
    late, parts = settled.select(*of, F.explode("late").alias("item")), []
    while True:
        parts.append(settled.select(*of, F.explode("s.out").alias("d")))
        open_ = settled.where("s.r IS NOT NULL").withColumn("item", F.struct((-F.col("s.r.size")).alias("at"), *(F.col(f"s.r.{c}").alias(c) for c in fields)))
        if width <= 1:
            break
        level, width = level + 1, -(-width // FAN_IN)
        rows = open_.select(*of, F.floor(F.col("fold") / F.lit(FAN_IN)).alias("fold"), "item")
        settled = work_table(rows.groupBy(*of, "fold").agg(_settle(F.sort_array(F.collect_list("item")), seed, level).alias("s")), f"mix-level{level}")
    # The last open document of each source meets what was set aside, FAN_IN documents of each size class.
    last = late.unionByName(open_.select(*of, "item")).groupBy(*of).agg(_settle(F.sort_array(F.collect_list("item")), seed, level + 1).alias("s"))
    r = F.col("s.r")
    up = (uniform(r["key"], F.lit(seed), F.lit(-1)) < r["x"]).cast("bigint")
    over = F.coalesce((up - r["x"]) * r["size"], F.lit(0.0))
    drawn = F.when(r.isNotNull(), F.array(_decided(r, up, F.lit(False)))).otherwise(F.array().cast(f"array<{DECIDED}>"))
    last = work_table(last.select(*of, F.concat(_balanced(F.col("s.out"), over), drawn).alias("out")), "mix-last")
    out = last.select(*of, F.explode("out").alias("d"))
    for part in parts:
        out = out.unionByName(part)
    return out.select("d.doc_id", "source", "d.size", "source_size", "target", "d.copies", (F.col("d.copies") * F.col("d.size")).alias("taken"))


def repeat_by_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as mix_sources takes it.

    Rows that repeat an id, source and size share the copies that the mix takes of them
    as evenly as can be. Null texts and texts without words go; null ids and sources are
    taken like others; no rows give no rows. Columns may have any names.
    """
    taken = mix_sources(docs, id_col, source_col, text_col).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = work_table(taken.where("copies > 0"), "mix-taken").toDF("t_id", "t_source", "t_size", "copies", "rows")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = own.select("row", *_sizes(own, f"row.{id_col}", f"row.{source_col}", f"row.{text_col}"))
    same = own["doc_id"].eqNullSafe(taken["t_id"]) & own["source"].eqNullSafe(taken["t_source"]) & (own["size"] == taken["t_size"])
    again = F.explode(F.expr("sequence(1, times)"))
    single, repeated = taken.where("rows = 1"), taken.where("rows > 1")
    out = own.join(single, same).select("row", F.col("copies").alias("times")).withColumn("time", again).select("row.*")
    if repeated.isEmpty():
        return out
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64(F.col(f"row.{text_col}"))))
    times = F.floor(F.col("copies") / F.col("rows")) + (nth <= F.col("copies") % F.col("rows")).cast("bigint")
    more = own.join(repeated, same).select("row", times.alias("times")).where("times > 0")
    return out.unionByName(more.withColumn("time", again).select("row.*"))
