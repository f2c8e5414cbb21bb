"""What the operators share: written intermediate tables, span columns, null-safe input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import new_path, written


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; a lost executor loses none of it."""
    return written(df, new_path(df.sparkSession, name), partition_by)


def _in_store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    store, target = _in_store(spark, path)
    store.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    store, target = _in_store(spark, path)
    return store.exists(target)


class Scratch:
    """The intermediate tables of one job, removed as soon as they have been read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        return written(df, path, partition_by)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                remove(self.spark, path)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones; other columns can't clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# Span columns -------------------------------------------------------------------------------

#: ``before`` is the text since the match before, at most CONTEXT characters of it.
SPAN_ROW = "struct<start:int,end:int,rank:int,kind:string,match:string,before:string>"
SPAN = f"array<{SPAN_ROW}>"
CONTEXT, FOLD = 40, 256


def fold(items: Column, state: Column, step, kind: str, last=None) -> Column:
    """The arrays that ``step(state, item)`` emits, one after the other.

    ``step`` gives a struct of the next ``state`` and ``out``, an array of type ``kind``; ``last(state)`` gives
    what follows the last item. Items are folded in blocks, as an array that grows by one element at a
    time is copied each time: the time is linear in the items up to some ten thousands, and little more beyond.
    """
    none, nothing = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def inner(acc, x):
        return let(step(acc["state"], x), lambda y: F.struct(y["state"].alias("state"), F.concat(acc["out"], y["out"]).alias("out")))

    def outer(acc, block):
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return let(done, lambda y: F.struct(y["state"].alias("state"), F.concat(acc["out"], F.array(y["out"])).alias("out")))

    def run(xs):
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / FOLD).cast("int"))
        blocks = F.transform(starts, lambda i: F.slice(xs, i * FOLD + 1, FOLD))
        end = lambda acc: F.flatten(acc["out"] if last is None else F.concat(acc["out"], F.array(last(acc["state"]))))
        return F.aggregate(blocks, F.struct(state.alias("state"), nothing.alias("out")), outer, end)

    return let(items, lambda xs: F.when(F.size(xs) > 0, run(xs)).otherwise(none))


def spans_of(text: str, pattern: str, kind: str, rank: int, keep=None, guard: Column | None = None) -> Column:
    """Every leftmost non-overlapping match of a Java pattern in column ``text``, with code-point offsets.

    Spark returns matches without offsets. ``split`` runs the same matcher, so offsets are the running
    sum of the lengths of the pieces between matches and of the matches. Texts without a match are
    scanned once. ``keep`` filters by the match (after matching: dropped matches stay consumed).
    """
    col = F.col(text)
    empty = F.expr(f"cast(array() as {SPAN})")

    def judged(m: Column) -> Column:
        return F.struct(m.alias("m"), (F.lit(True) if keep is None else F.coalesce(keep(m), F.lit(False))).alias("ok"))

    def place(matches: Column) -> Column:
        pieces = F.split(col, pattern, -1)
        steps = F.zip_with(
            F.slice(pieces, F.lit(1), F.size(matches)), matches,
            lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("size"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"), x["m"].alias("m"), x["ok"].alias("ok")),
        )

        def step(at, x):
            begin = at + x["gap"]
            end = begin + x["size"]
            span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["m"].alias("match"), x["before"].alias("before"))
            return F.struct(end.alias("state"), F.when(x["ok"], F.array(span)).otherwise(empty).alias("out"))

        return fold(steps, F.lit(0), step, SPAN)

    # most texts hold no match that would be kept
    found = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), judged)
    out = let(found, lambda xs: F.when(F.exists(xs, lambda x: x["ok"]), place(xs)).otherwise(empty))
    return out if guard is None else F.when(guard, out).otherwise(empty)


def join_spans(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
