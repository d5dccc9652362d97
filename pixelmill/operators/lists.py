"""Lists, loops, order, state and reports as relational operators, and the format contract of tables."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from pixelmill.functions.args import ID
from pixelmill.functions.scalars import Arg, case, col, is_image, is_video, number_to_text, saturate, text_to_number, valid_file_name
from pixelmill.operators.pixels import note
from pixelmill.plans.storage import exists, materialize, touch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

MOST_REPEATS = 100_000
MOST_BRANCHES = 32
CHUNK = 4096


def for_each(df: DataFrame, list_col: str, limit: int = 0, element: str = "element") -> DataFrame:
    """One row per element with its ``index`` from 0; ``limit`` 0 is none. Nested calls extend ``iter_path``."""
    out = df.select("*", F.posexplode(list_col).alias("index", element))
    if limit:
        out = out.where(F.col("index") < limit)
    return _with_path(df, out)


def repeat(df: DataFrame, times: Arg = 3) -> DataFrame:
    """Each row ``times`` times with ``index`` 0 to times - 1; 0 times or less gives none, over MOST_REPEATS as many as that."""
    n = F.greatest(F.lit(0), F.least(F.lit(MOST_REPEATS), saturate(times, "int")))
    turns = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return _with_path(df, df.select("*", F.explode(turns).alias("index")))


def _with_path(before: DataFrame, after: DataFrame) -> DataFrame:
    path = F.col("iter_path") if "iter_path" in before.columns else F.array().cast("array<int>")
    return after.withColumn("iter_path", F.concat(path, F.array("index")))


def in_sequence(*branches: DataFrame) -> DataFrame:
    """All branches with their ``branch`` number from 0; readers order by (branch, their own order)."""
    if not 1 <= len(branches) <= MOST_BRANCHES:
        raise ValueError(f"1 to {MOST_BRANCHES} branches")
    numbered = [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    out = numbered[0]
    for b in numbered[1:]:
        out = out.unionByName(b)
    return out


def run_in_order(spark: SparkSession, steps: list[Callable[[], None]], folder: str) -> list[int]:
    """Run ``steps``, which write something each, one after the other; returns the numbers of those that ran now.

    A step begins when all before it are done. One that fails raises, and none after it runs. Each leaves a marker in
    ``folder`` when it is done, so a rerun with that folder begins at the one that failed.
    """
    if not 1 <= len(steps) <= MOST_BRANCHES:
        raise ValueError(f"1 to {MOST_BRANCHES} branches")
    ran = []
    for i, step in enumerate(steps):
        done = f"{folder.rstrip('/')}/_done/{i}"
        if not exists(done, spark):
            step()
            touch(done, spark)
            ran.append(i)
    return ran


def write_in_sequence(branches: list[DataFrame], folder: str) -> DataFrame:
    """``in_sequence`` as tables that are written in order, ``branch=0`` first, and read back together.

    A branch that was left half written is written anew; finished ones aren't computed again (``run_in_order``).
    """
    spark, base = branches[0].sparkSession, folder.rstrip("/")
    run_in_order(spark, [lambda df=df, i=i: df.write.mode("overwrite").parquet(f"{base}/branch={i}") for i, df in enumerate(branches)], folder)
    return in_sequence(*[spark.read.schema(df.schema).parquet(f"{base}/branch={i}") for i, df in enumerate(branches)])


def on_complete(groups: DataFrame, elements: DataFrame, group: list[str]) -> DataFrame:
    """Groups all of whose elements are ok; a group without elements is complete."""
    bad = elements.where("status <> 'ok'").select(*group).distinct()
    return groups.join(bad, group, "left_anti")


def halt_on_failure(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Drop what comes after the first failed row of its group; that row stays."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max((F.col("status") == "failed").cast("int")).over(before)
    return df.withColumn("_failed", F.coalesce(failed, F.lit(0))).where("_failed = 0").drop("_failed")


def running_add(df: DataFrame, group: list[str], order: list[str], value: str, init: Arg = 0.0) -> DataFrame:
    """``state`` after each row: init plus all values so far."""
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("state", col(init) + F.sum(value).over(so_far))


def fold(df: DataFrame, group: list[str], order: list[str], value: str, init: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Final state per group: ``merge(state, value)`` over its values in order.

    A group's values become one array, so a group must fit in a task; sums have ``running_add`` or ``sum``, and
    groups of any length ``fold_associative`` or ``fold_streamed``.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"])
    return df.groupBy(*group).agg(F.aggregate(ordered, init, merge).alias("state"))


def fold_associative(df: DataFrame, group: list[str], order: list[str], state: Column, merge: Callable[[Column, Column], Column], chunk: int = CHUNK) -> DataFrame:
    """``fold`` of groups of any length where ``merge`` is associative: ``state`` of each row, merged in order, per group.

    ``merge`` needn't be commutative: f after g, texts end to end, the last value that isn't null. Rows are dealt by ranges of
    (group, order), so a large group is spread over many tasks; each merges chunks of so many rows, then chunks of
    chunks, until one state of its part is left. The parts of a group, at most as many as there are tasks, are merged last.
    No array is longer than ``chunk`` or the number of tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.select(*group, *order, state.alias("_state")).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    part = [*group, "_part"]
    most = dealt.groupBy(*part).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    left = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)

    def merged(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
        states = F.transform(F.sort_array(F.collect_list(F.struct(place, "_state"))), lambda x: x["_state"])
        return rows.groupBy(*keys).agg(states.alias("_states")).withColumn("_state", F.aggregate(F.slice("_states", 2, F.size("_states")), F.get("_states", F.lit(0)), merge)).drop("_states")

    while most > 1:
        left = merged(left.withColumn("_chunk", F.floor(F.col("_at") / chunk).cast("int")), [*part, "_chunk"], "_at").withColumnRenamed("_chunk", "_at")
        most = -(-most // chunk)
    return merged(left.drop("_at"), group, "_part").withColumnRenamed("_state", "state")


def fold_streamed(df: DataFrame, group: list[str], order: list[str], value: str, init, merge: Callable, state_type: str) -> DataFrame:
    """``fold`` of groups of any length by any Python ``merge(state, value)``, which need not be associative.

    Such a fold takes a group's rows one after the other: they are sorted on disk and go through one task as a stream,
    which keeps the state alone. Groups are folded side by side. Null values are passed on; groups may have null keys.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema.fields), f"state {state_type}"])
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        key, state = None, init
        for b in batches:
            done = []
            for *at, v in zip(*(b.column(c).to_pylist() for c in range(len(group) + 1)), strict=True):
                if key is None or at != key:
                    if key is not None:
                        done.append((*key, state))
                    key, state = at, init
                state = merge(state, v)
            yield told(done)
        if key is not None:
            yield told([(*key, state)])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    ordered = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.col(value).alias("v"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"g{i}" for i in range(len(group))]
    dealt = ordered.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *[f"o{i}" for i in range(len(order))])
    return dealt.mapInArrow(run, schema)


def last_write(df: DataFrame, key: list[str], order: list[str], value: str, default: Arg | None = None) -> DataFrame:
    """The value written last under each key; ``default`` where that is null."""
    latest = F.max_by(value, F.struct(*order))
    return df.groupBy(*key).agg((F.coalesce(latest, col(default)) if default is not None else latest).alias(value))


def literal(df: DataFrame, name: str, value: str | float | bool) -> DataFrame:
    """A constant text, number (double) or bool column."""
    number = isinstance(value, int | float) and not isinstance(value, bool)
    return df.withColumn(name, F.lit(float(value) if number else value))


def set_value(df: DataFrame, name: str, source: Column, kind: str) -> DataFrame:
    """A column passed on as number, text or bool; what doesn't convert is null."""
    types = dict(df.select(source.alias("v")).dtypes)
    if kind == "number":
        out = text_to_number(source) if types["v"] == "string" else source.cast("double") if types["v"] != "boolean" else F.lit(None).cast("double")
    elif kind == "bool":
        out = source if types["v"] == "boolean" else F.lit(None).cast("boolean")
    else:
        out = source if types["v"] == "string" else source.cast("string") if types["v"] == "boolean" else number_to_text(source)
    return df.withColumn(name, out)


def rename_outputs(images: DataFrame, name: Arg, auto_extension: bool = True) -> tuple[DataFrame, DataFrame]:
    """(images, notes): the name as given, untrimmed. A blank one clears the hint; an invalid one fails the row."""
    text = col(name)
    blank, ok = F.trim(text) == "", valid_file_name(text)
    notes = images.withColumn("_s", case([(blank, "ok"), (~ok, "failed")])).where("_s is not null")
    message = F.when(F.col("_s") == "ok", F.lit("the name is blank: the former rule applies")).otherwise(F.lit("invalid file name"))
    kept = images.where(blank | ok).withColumns({"name_stem": F.when(~blank, text), "name_auto_ext": F.when(~blank, F.lit(auto_extension))})
    return kept, note(notes, "rename", F.col("_s"), message)


def run_report(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, warnings). The report has op, elapsed_ms (total), status (worst), warnings (how many rows that didn't
    fail have a message) and error (the last). ``warnings`` has op, message and how often: rows, so that an op of very
    many images gathers nothing in one place."""
    rank = case([(F.col("status") == "failed", 2), (F.col("status") == "skipped", 1)], 0)
    failed, told = F.col("status") == "failed", (F.col("status") != "failed") & (F.col("message") != "")
    out = notes.withColumn("_rank", rank).groupBy("op").agg(
        F.sum("elapsed_ms").alias("elapsed_ms"), F.max("_rank").alias("_rank"), F.count_if(told).alias("warnings"), F.max_by(F.when(failed, F.col("message")), F.when(failed, F.struct("seq", ID))).alias("error")
    )
    status = F.get(F.array(F.lit("ok"), F.lit("skipped"), F.lit("failed")), F.col("_rank"))
    return out.select("op", "elapsed_ms", status.alias("status"), "warnings", "error"), notes.where(told).groupBy("op", "message").agg(F.count("*").alias("n"))


def require_format(images: DataFrame, fmt: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images of the format, failed notes of the others); ``img`` is any image format, ``vid`` any video's, ``file`` both, ``any`` all."""
    f = F.col("format")
    fits = {"img": is_image(f), "vid": is_video(f), "file": is_image(f) | is_video(f), "any": F.lit(True)}.get(fmt, f == fmt)
    fits = F.coalesce(fits, F.lit(False))
    if strict:
        message = F.concat(F.lit(f"{fmt} is asked for, but there is "), F.coalesce(f, F.lit("nothing")))
        return images.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))), note(images.where("false"), "require_format", "ok", "")
    return images.where(fits), note(images.where(~fits), "require_format", "failed", F.concat(F.lit(f"not {fmt}: "), F.coalesce(f, F.lit("unknown"))))


def common_format(df: DataFrame, group: list[str], fmt: str = "format") -> DataFrame:
    """The type of each group's mixed list: the format if all are equal, else img, vid, file or any."""
    f = F.col(fmt)
    image, video = F.coalesce(is_image(f), F.lit(False)), F.coalesce(is_video(f), F.lit(False))
    out = df.groupBy(*group).agg(
        F.min(f).alias("_a"), F.max(f).alias("_b"), F.bool_and(image).alias("_i"), F.bool_and(video).alias("_v"), F.bool_and(image | video).alias("_f"), F.count(f).alias("_n"), F.count("*").alias("_m")
    )
    same = (F.col("_a") == F.col("_b")) & (F.col("_n") == F.col("_m"))
    return out.select(*group, case([(same, F.col("_a")), (F.col("_i"), "img"), (F.col("_v"), "vid"), (F.col("_f"), "file")], "any").alias("common_format"))
