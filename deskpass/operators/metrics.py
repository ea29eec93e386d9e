"""Classification metrics, class balance and the hold-out report.

Metrics first reduce rows to confusion counts (at most classes² rows, combined
map-side); everything after that works on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """A1: share of rows where the prediction equals the label."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: list, label: str = "label", pred: str = "prediction") -> DataFrame:
    """A4: one row per true class, one column per predicted class (listed values, zeros filled)."""
    cm = confusion_counts(df, label, pred).groupBy("label").pivot("prediction", classes).agg(F.first("n"))
    return cm.fillna(0, subset=[str(c) for c in classes])


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """A2: precision, recall, F1 and support per class; zero denominators give 0."""
    cm = confusion_counts(df, label, pred)
    actual = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = cm.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    t = (actual.join(predicted, "cls", "full").join(tp, "cls", "left")
         .fillna(0, subset=["support", "predicted", "tp"]))
    precision = _safe_div(F.col("tp"), F.col("predicted"))
    recall = _safe_div(F.col("tp"), F.col("support"))
    t = t.withColumn("precision", precision).withColumn("recall", recall)
    f1 = _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return t.select(F.col("cls").alias("class"), "precision", "recall", f1.alias("f1"),
                    F.col("support").cast("long").alias("support"))


def averages(report: DataFrame) -> DataFrame:
    """A3: macro and support-weighted precision, recall and F1 over ``per_class``."""
    w = lambda m: F.sum(F.col(m) * F.col("support")) / F.sum("support")
    macro = report.agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")]).withColumn("average", F.lit("macro"))
    weighted = report.agg(*[w(m).alias(m) for m in ("precision", "recall", "f1")]).withColumn("average", F.lit("weighted"))
    return macro.unionByName(weighted)


def report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """M9: (name, precision, recall, f1, support): a row per class, macro and weighted averages, accuracy (in f1)."""
    rep = per_class(df, label, pred)
    none = F.lit(None).cast("double")
    rows = rep.select(F.col("class").cast("string").alias("name"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    avg = averages(rep).select(F.col("average").alias("name"), "precision", "recall", "f1", none.alias("support"))
    acc = accuracy(df, label, pred).select(F.lit("accuracy").alias("name"), none.alias("precision"), none.alias("recall"),
                                           F.col("accuracy").alias("f1"), none.alias("support"))
    return rows.unionByName(avg).unionByName(acc)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A5: rows per class and their share."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weight n / (classes × n_class) on every row (for ``weightCol``).

    The per-class table has one row per class; the join back is planned by
    AQE (broadcast when its runtime size allows).
    """
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    all_ = Window.partitionBy()
    c = c.withColumn(out, F.sum("__nc").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("__nc")))
    return df.join(c.select(label, out), label, "left")


def id_hash(key: Column | str) -> Column:
    """Deterministic 60-bit hash of an id (same value in DuckDB:
    ``('0x' || substr(md5(id::varchar), 1, 15))::bigint``)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 15), 16, 10).cast("bigint")


_BUCKET_SHIFT = 44  # top 16 of 60 hash bits


def _kth_per_class(df: DataFrame, label: str, h: str, key: str, quotas: DataFrame) -> DataFrame:
    """Rows whose (hash, id) rank within their class is <= the class quota, without
    ranking a whole class in one task.

    Hashes are cut into 65,536 buckets; counts per (class, bucket) are small and
    give, per class, the bucket holding the quota-th row. Rows below it are kept
    outright; only that one bucket is ranked row by row. ``quotas`` has columns
    (label, __quota), one row per class.
    """
    b = df.withColumn("__b", F.shiftright(F.col(h), _BUCKET_SHIFT))
    bc = b.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    wc = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bc = (bc.withColumn("__cum", F.sum("__bn").over(wc)).join(quotas, label, "inner")
          .withColumn("__before", F.col("__cum") - F.col("__bn")))
    cut = bc.filter(F.col("__before") < F.col("__quota"))
    rows = b.join(cut.select(label, "__b", "__cum", "__before", "__quota"), [label, "__b"], "inner")
    whole = rows.filter(F.col("__cum") <= F.col("__quota"))
    edge = rows.filter(F.col("__cum") > F.col("__quota"))
    rk = F.row_number().over(Window.partitionBy(label, "__b").orderBy(h, key))
    edge = edge.withColumn("__rk", rk).filter(F.col("__before") + F.col("__rk") <= F.col("__quota")).drop("__rk")
    return whole.unionByName(edge).drop("__b", "__cum", "__before", "__quota")


def _class_sizes(d: DataFrame, label: str) -> DataFrame:
    sizes = d.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    everything = Window.partitionBy()
    return (sizes.withColumn("__min", F.min("__n").over(everything))
            .withColumn("__max", F.max("__n").over(everything)))


def undersample(df: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """A10: keep, per class, the rows with the smallest id hashes, as many as the smallest class has."""
    d = df.withColumn("__h", id_hash(key))
    quotas = _class_sizes(d, label).select(label, F.col("__min").alias("__quota"))
    return _kth_per_class(d, label, "__h", key, quotas).drop("__h")


def oversample(df: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """A10: repeat rows of every class up to the largest class's size.

    Each row is repeated floor(max/n) times; the remainder is taken by the
    smallest id hashes, as in ``undersample``. Adds ``copy_no``.
    """
    d = df.withColumn("__h", id_hash(key))
    sizes = _class_sizes(d, label).select(
        label, (F.col("__max") / F.col("__n")).cast("long").alias("__rep"),
        (F.col("__max") % F.col("__n")).alias("__quota"))
    full = (d.join(sizes.select(label, "__rep"), label, "inner")
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__rep")))).drop("__rep"))
    extra = _kth_per_class(d, label, "__h", key, sizes.select(label, "__quota"))
    extra = extra.join(sizes.select(label, (F.col("__rep") + 1).alias("copy_no")), label, "inner")
    return full.unionByName(extra).drop("__h")


def holdout_flag(key: Column | str, percent: int = 20) -> Column:
    """M1: reproducible test flag from the id hash (does not depend on partitioning)."""
    return F.pmod(id_hash(key), F.lit(100)) < percent
